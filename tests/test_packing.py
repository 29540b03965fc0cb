import pytest
from pyspark.sql import functions as F

from evalkit.operators import packing


def _conv(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_pack_edges(spark):
    rows = [(1, 0, "user", "x" * 4000), (1, 1, "assistant", "y" * 40),            # first above budget: kept alone
            (2, 0, "user", "a" * 400), (2, 1, "assistant", "b" * 400), (2, 2, "user", "c")]  # boundary at 100
    df = _conv(spark, rows)
    got = sorted((r.conv_id, r.turn) for r in packing.pack_to_budget(df, 100).collect())
    assert got == [(1, 0), (2, 0)]
    assert packing.pack_to_budget(df, 0).count() == 0
    assert sorted((r.conv_id, r.turn) for r in packing.pack_to_budget(df, 101).collect()) == [(1, 0), (2, 0), (2, 1)]


@pytest.mark.parametrize("inputs, turns", [
    # (turn, session, turn in session) of the inputs that count
    (["hi", "", "reset", "a", "b", "  RESET ", "c", "exit", "after"], [(0, 1, 1), (3, 2, 1), (4, 2, 2), (6, 3, 1)]),
    (["reset", "reset", "x"], [(2, 3, 1)]),
    (["quit", "x"], []),
    ([" ", "a", "", "b", "QUIT"], [(1, 1, 1), (3, 1, 2)]),
    (["a", "b", "reset"], [(0, 1, 1), (1, 1, 2)]),
    (["exit now", "resetting", "b"], [(0, 1, 1), (1, 1, 2), (2, 1, 3)]),
])
def test_session_turns(spark, inputs, turns):
    df = _conv(spark, [(5, i, "user", t) for i, t in enumerate(inputs)])
    got = [(r.turn, r.session, r.session_turn) for r in packing.session_turns(df).orderBy("turn").collect()]
    assert got == turns


def test_numbering_and_render(spark):
    df = _conv(spark, [(1, 0, "system", "S"), (1, 1, "user", "U")])
    r = packing.render_messages(df).first()
    assert r.rendered == "=== [system] (msg 1/2) ===\nS\n\n=== [user] (msg 2/2) ===\nU\n\n"
    c = packing.render_messages(df, template="chatml").first()
    assert c.rendered == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\n"
    ht = packing.head_tail_messages(df).select("msg_no", "n_msgs").orderBy("msg_no").collect()
    assert [(x.msg_no, x.n_msgs) for x in ht] == [(1, 2), (2, 2)]
    assert packing.prompt_cell_stats(df, ["conv_id"]).select(F.col("total_chars")).first()[0] == 2


def test_long_conversations_are_kept_whole_in_chunks(spark, tmp_path):
    """A conversation of over 10,000 tokens: render, dump and request hold every message."""
    import json

    from evalkit.operators import chat
    from evalkit.sources import results_io as IO
    n, body = 700, "word " * 20
    df = _conv(spark, [(7, i, "user" if i % 2 else "assistant", f"{i} {body}") for i in range(n)] + [(8, 0, "user", None)])
    assert n * len(body) // 4 > 10_000
    chunks = sorted(packing.render_messages(df).collect(), key=lambda r: (r.conv_id, r.chunk))
    assert [(r.conv_id, r.chunk, r.n_msgs) for r in chunks] == [(7, 0, 256), (7, 1, 256), (7, 2, 188), (8, 0, 1)]
    whole = "".join(r.rendered for r in chunks if r.conv_id == 7)
    assert all(f"(msg {i + 1}/{n}) ===\n{i} {body}\n\n" in whole for i in range(n))
    named = packing.render_messages(df).withColumn("file", F.format_string("sample_%03d.txt", "conv_id"))
    index = IO.write_named_files(named, f"file://{tmp_path}/dump", "file", "rendered", order=["chunk"])
    assert (tmp_path / "dump" / "sample_007.txt").read_text() == whole
    assert {r.file: (r.n_chars, r.n_parts) for r in index.collect()}["sample_007.txt"] == (len(whole), 3)
    parts = sorted(chat.chat_requests(df, "m", 16, 0.5).filter("conv_id = 7").collect(), key=lambda r: r.chunk)
    request = json.loads("".join(r.request for r in parts))
    assert [m["content"] for m in request["messages"]] == [f"{i} {body}" for i in range(n)]
    assert (request["model"], request["max_tokens"], request["temperature"]) == ("m", 16, 0.5)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

convs = st.lists(st.lists(st.text(alphabet="ab \n", max_size=30), min_size=0, max_size=12), min_size=1, max_size=6)


@settings(max_examples=15, deadline=None)
@given(convs, st.integers(min_value=0, max_value=20))
def test_packing_keeps_the_shortest_prefix_that_reaches_the_budget(spark, conversations, budget):
    rows = [(c, t, "user", text) for c, texts in enumerate(conversations) for t, text in enumerate(texts)]
    if not rows:
        return
    got = {}
    for r in packing.pack_to_budget(_conv(spark, rows), budget).collect():
        got.setdefault(r.conv_id, []).append(r.turn)
    for c, texts in enumerate(conversations):
        kept = sorted(got.get(c, []))
        cost = [len(t) // 4 for t in texts]
        assert kept == list(range(len(kept)))  # a prefix
        assert not kept or sum(cost[:len(kept) - 1]) < budget  # its last message began below the budget
        assert len(kept) == len(texts) or sum(cost[:len(kept)]) >= budget  # and nothing more fits


words = st.sampled_from(["hi", "", " ", "reset", "RESET", "quit", "exit", "x y"])


@settings(max_examples=10, deadline=None)
@given(st.lists(words, min_size=1, max_size=15))
def test_properties_of_sessions(spark, texts):
    df = _conv(spark, [(9, i, "user", t) for i, t in enumerate(texts)])
    got = [(r.turn, r.session, r.session_turn) for r in packing.session_turns(df).orderBy("turn").collect()]
    for (t, session, turn), (t2, session2, turn2) in zip(got, got[1:]):
        assert t < t2 and (turn2 == turn + 1 if session2 == session else session2 > session and turn2 == 1)
    assert all(texts[t] in ("hi", "x y") for t, _, _ in got) and (not got or got[0][2] == 1)
    assert all(s == 1 + sum(x.lower() == "reset" for x in texts[:t]) for t, s, _ in got)


ODD = [(1, 0, "user", "x" * 40), (1, None, "user", "y" * 8), (None, 3, "user", "z" * 4), (None, None, None, "w"), (2, 0, "user", None)]


def test_null_keys_turns_roles_and_texts_are_kept(spark):
    df = _conv(spark, ODD)
    assert packing.pack_to_budget(df, 100).count() == 5
    assert sorted(((r.conv_id or 0, r.msg_no, r.n_msgs, r.header) for r in packing.message_numbering(df).collect())) == [
        (0, 1, 2, "=== [None] (msg 1/2) ==="), (0, 2, 2, "=== [user] (msg 2/2) ==="),
        (1, 1, 2, "=== [user] (msg 1/2) ==="), (1, 2, 2, "=== [user] (msg 2/2) ==="), (2, 1, 1, "=== [user] (msg 1/1) ===")]
    assert sum(r.n_msgs for r in packing.render_messages(df).collect()) == 5
    assert {r.conv_id: r.n_msgs for r in packing.prompt_cell_stats(df, ["conv_id"]).collect()} == {None: 2, 1: 2, 2: 1}
    assert packing.head_tail_messages(df).count() == 5
    from evalkit.operators import chat
    assert sum(r.n_msgs for r in chat.chat_requests(df, "m", 1, 0.5).collect()) == 5
    turns = sorted((r.conv_id or 0, r.turn or -1, r.session_turn) for r in packing.session_turns(df).collect())
    assert turns == [(0, -1, 1), (0, 3, 2), (1, -1, 1), (1, -1, 2)]  # the null text is skipped; turn 0 is written as -1 here


def test_turns_that_repeat_have_a_fixed_order(spark):
    rows = [(1, 5, "user", f"t{i}") for i in range(30)]
    orders = set()
    for seed in range(3):
        df = _conv(spark, rows).repartition(3 + seed)
        orders.add(tuple(r.text for r in packing.message_numbering(df).orderBy("msg_no").collect()))
    assert len(orders) == 1


@pytest.mark.parametrize("bucket_rows", [10, 100_000])
def test_sessions_of_a_huge_conversation_by_hand(spark, bucket_rows):
    """Conversations of hundreds of inputs, cut into buckets: the composed states give what a
    walk over the inputs gives."""
    import random
    rng = random.Random(3)
    rows = []
    for c in (1, 2, None):
        turns = rng.sample(range(10**12), 400)
        rows += [(c, t, "user", rng.choice(["a", "b", "reset", " ", "c"])) for t in turns]
        if c == 2:
            rows.append((c, sorted(turns)[350], "zz", "quit"))
    want = {}
    for c in (1, 2, None):
        session, n = 1, 0
        import hashlib
        tie = lambda r: hashlib.md5(f"{r[2]}:{r[3]}".encode()).hexdigest()
        for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], tie(r))):
            word = r[3].strip().lower()
            if word == "quit":
                break
            if word == "reset":
                session, n = session + 1, 0
            elif word:
                n += 1
                want[c, r[1], r[3]] = (session, n)
    got = packing.session_turns(_conv(spark, rows), bucket_rows=bucket_rows).collect()
    assert {(r.conv_id, r.turn, r.text): (r.session, r.session_turn) for r in got} == want and len(got) == len(want)


def test_packing_a_huge_conversation_drops_whole_buckets(spark):
    rows = [(1, i * 10**6, "user", "x" * 40) for i in range(500)] + [(None, i, "user", "y" * 40) for i in range(300)]
    df = _conv(spark, rows)
    got = packing.pack_to_budget(df, 1000, bucket_rows=20).collect()
    assert sorted((r.conv_id or 0, r.turn) for r in got) == [(0, i) for i in range(100)] + [(1, i * 10**6) for i in range(100)]
