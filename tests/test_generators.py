import hashlib

import pytest
from pyspark.sql import functions as F

from evalkit import pools
from evalkit.operators import prompts as G


def _cycle(spark):
    return spark.createDataFrame(
        [(i, tool, "u" * u, "c" * c, "r" * r) for i, ((u, c, r), tool) in
         enumerate(zip(pools.AGENTIC_CYCLE_LENGTHS, pools.AGENTIC_CYCLE_TOOLS))],
        "step int, tool string, user_text string, call_text string, result_text string")


def test_agentic_history_golden_counts(spark):
    budgets = [max(0, c - pools.HARD_RESERVE) for c in (4096, 8192, 16384, 24576, 32768, 49152, 65536)]
    h = G.agentic_history(spark.createDataFrame([(b,) for b in [0, *budgets]], "budget int"), _cycle(spark))
    got = {r.budget: (r.n, r.reads, r.tokens, r.least) for r in h.groupBy("budget").agg(
        F.count_if(F.col("slot") == 0).alias("n"),
        F.count_if((F.col("tool") == "read_file") & (F.col("slot") == 0)).alias("reads"), F.sum("tokens").alias("tokens"),
        F.min(F.length("content")).alias("least")).collect()}
    assert 0 not in got
    assert [got[b][0] for b in budgets] == [17, 41, 90, 141, 190, 289, 389]
    assert [got[b][1] for b in budgets] == [9, 21, 45, 70, 95, 144, 195]
    assert all(got[b][2] >= b and got[b][3] == len("Step 6: ") + 23 for b in budgets)
    first = h.filter("budget = 2546 and interaction = 1").orderBy("slot").collect()
    assert [(r.role, r.content[:8]) for r in first] == [("user", "Step 1: "), ("assistant", "c" * 8), ("user", "r" * 8)]


def _question(n):
    return F.concat(F.lit("q" * pools.HISTORY_QUESTION_CHARS), n.cast("string"))


def test_padded_history_golden_turns(spark):
    contexts = (4096, 8192, 16384, 24576, 32768)
    budgets = [c - pools.EASY_RESERVE for c in contexts]
    df = spark.createDataFrame([(b,) for b in [0, 1, *budgets]], "budget int")
    h = G.padded_history(df, _question, F.lit("para"))
    got = {r.budget: (r.turns, r.tokens) for r in h.groupBy("budget").agg(
        F.count_if(F.col("role") == "user").alias("turns"), F.sum("tokens").alias("tokens")).collect()}
    assert 0 not in got and [got[b][0] for b in budgets] == [15, 33, 69, 105, 141]
    assert all(b <= got[b][1] < b + 30 for b in [1, *budgets])  # only the last question goes beyond
    rows = h.filter("budget = 1").orderBy("slot").collect()
    assert [(r.role, r.content) for r in rows] == [("user", "q" * pools.HISTORY_QUESTION_CHARS + "1"), ("assistant", "para")]


@pytest.mark.parametrize("text, depth, sep, at", [
    ("aa\nbb\ncc", 0.0, "\n", 0), ("aa\nbb\ncc", 0.25, "\n", 2), ("aa\nbb\ncc", 0.75, "\n", 5),
    ("aa\nbb\ncc", 1.0, "\n", 5), ("aa\n\nbb\ncc", 1.0, "\n\n", 2), ("abcdef", 0.5, "\n", 3), ("", 0.5, "\n", 0),
    ("é😀\né😀\n", 1.0, "\n", 5), ("é😀\né😀\n", 0.5, "\n", 2), ("\n\n\n", 1.0, "\n", 2), ("\nabc", 0.25, "\n", 0),
])
def test_needle_position(spark, text, depth, sep, at):
    df = spark.createDataFrame([(text, depth)], "t string, d double")
    assert df.select(G.insert_position("t", "d", sep)).first()[0] == at


def test_needle_removed_gives_text_back(spark):
    df = spark.createDataFrame([("one\ntwo\nthree", 0.5), ("", 0.3), ("abc", 1.0)], "t string, d double")
    n = "\n**NEEDLE**\n"
    out = df.select("t", G.insert_needle("t", F.lit(n), G.insert_position("t", "d", "\n")).alias("c")).collect()
    for r in out:
        assert r.c.replace(n, "", 1) == r.t


def test_filler_text(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 10, 14)], "n int").orderBy("n")
    got = [r.f for r in df.select(G.filler_text(F.lit("para"), F.col("n")).alias("f")).collect()]
    assert got == ["", "p", "para\n\npara", "para\n\npara\n\npa"]


def test_passkey_is_six_digits(spark):
    df = spark.range(500).select(G.passkey("id").alias("k"))
    assert all(len(r.k) == 6 and r.k.isdigit() for r in df.collect())


@pytest.mark.parametrize("m,lo,hi", [(8192, 3, 6), (4096, 3, 6), (3000, 2, 4), (2048, 2, 4), (1536, 1, 2)])
def test_exchange_range(spark, m, lo, hi):
    r = spark.createDataFrame([(m,)], "m int").select(G.exchange_range("m").alias("r")).first().r
    assert (r.lo, r.hi) == (lo, hi)


def test_fixed_quota_undershoots(spark):
    from evalkit.operators.calibration import fixed_quota
    items = spark.createDataFrame([(i,) for i in range(3)], "k int")
    got = fixed_quota(items, "k", 7).orderBy("sample").collect()
    # 7 // 3 = 2 repetitions each -> 6 samples (the reference undershoots too)
    assert [(r.sample, r.k, r.rep) for r in got] == [(0, 0, 1), (1, 0, 2), (2, 1, 1), (3, 1, 2), (4, 2, 1), (5, 2, 2)]


def test_prompt_messages(spark):
    cells = spark.createDataFrame([(1, 400, "Read it."), (2, 0, "Run it.")], "cell int, budget int, instruction string")
    hist = G.padded_history(cells.select("budget"), _question, F.lit("para"))
    rows = G.prompt_messages(cells, hist, "SYS").orderBy("cell", "part", "turn", "slot").collect()
    assert [(r.role, r.content) for r in rows if r.cell == 2] == [("system", "SYS"), ("user", "Run it. /no_think")]
    one = [r for r in rows if r.cell == 1]
    assert [r.role for r in one] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert one[2].content.startswith("para\n\npara") and len(one[2].content) == 800


def test_gathered_prompts_are_the_messages_in_order(spark):
    cells = spark.createDataFrame([(1, 400, "Read it."), (2, 0, "Run it."), (3, None, None), (4, 400, "x")],
                                  "cell int, budget int, instruction string")
    hist = G.padded_history(cells.select("budget"), _question, F.lit("para"))
    rows = G.prompt_messages(cells, hist, "SYS").orderBy("cell", "part", "turn", "slot").collect()
    whole = G.prompt_messages(cells, hist, "SYS", gathered=lambda h: [F.size(h).alias("n"), h.alias("messages")]).collect()
    for r in whole:
        history = r.messages or []
        assert r.n == (len(history) or None)
        assert [(m.role, m.content) for m in (r.system, *history, r.user)] == [
            (m.role, m.content) for m in rows if m.cell == r.cell]
    assert len(whole) == 4


def _messages_by_hand(spark, sf):
    """n_msgs, total_chars and digest per event, from the rows of every message."""
    from evalkit.queries import q_generators as Q
    want = {}
    for suite, reserve, history, system, order in (
            ("tool_call", pools.EASY_RESERVE, Q.easy_history(spark, sf), Q.SYSTEM_EASY, ("turn", "slot")),
            ("tool_call_hard", pools.HARD_RESERVE, Q.hard_history(spark, sf), Q.SYSTEM_HARD, ("interaction", "slot"))):
        cells = Q._cells(spark, sf, suite, reserve).select("event_id", "budget", "instruction")
        per = {}
        for r in G.prompt_messages(cells, history, system, order=order).collect():
            per.setdefault(r.event_id, []).append(((r.part, r[order[0]], r[order[1]]), r.role, r.content))
        for event, ms in per.items():
            digests = sorted((o, f"{role}:{hashlib.md5(c.encode()).hexdigest()}") for o, role, c in ms if c is not None)
            want[event] = (len(ms), sum(len(c or "") for _, _, c in ms),
                           hashlib.md5(",".join(d for _, d in digests).encode()).hexdigest())
    return want


def test_prompts_of_repeated_events_and_no_shuffled_message(spark, tmp_path):
    """Messages used to be joined and shuffled one by one, texts and all; now only cells are shuffled."""
    from evalkit.queries import QUERIES, load_all
    load_all()
    rows = [(i, 1, t, 1.0, "{}") for i, t in [(1, "view"), (2, "view"), (2, "view"), (3, "click"), (3, "view"), (3, "view"),
                                              (4, None), (5, "view"), (None, "view"), (None, "click"), (14, "view")]]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = QUERIES["prompt_messages"](spark, str(tmp_path))
    got = {r.event_id: (r.n_msgs, r.total_chars, r.messages_md5) for r in found.collect()}
    assert got == _messages_by_hand(spark, str(tmp_path)) and len(got) == 7
    # below an exchange by event there is no join with histories
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    exchanges = [i for i, s in enumerate(plan) if "Exchange hashpartitioning(event_id" in s]
    assert exchanges
    for i in exchanges:
        below = plan[i + 1:next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(plan[i])), len(plan))]
        assert not any("Join" in s for s in below)


def test_seeded_samples_follow_the_length_policy(spark):
    from evalkit.operators.calibration import seeded_samples
    exchanges = spark.createDataFrame([(i, f"call{i}", f"result{i}") for i in range(5)], "exchange_id int, call string, result string")
    lines = spark.createDataFrame([("user", "U1"), ("user", "U2"), ("analysis", "A1"), ("snippet", "SHORT"), ("long", "LONG")],
                                  "kind string, line string")
    finals = spark.createDataFrame([("Do x", "x", "k", "v")], "final_request string, expected_tool string, arg_key string, arg_value string")
    system = spark.createDataFrame([("SYS",)], "system_text string")
    samples = spark.range(40).withColumnRenamed("id", "sample")
    for limit, lo, hi, long in ((4096, 3, 6, True), (2048, 2, 4, False), (16, 1, 2, False)):
        rows = seeded_samples(samples, exchanges, lines, finals, system, limit).collect()
        assert len(rows) == 40 and {r.num_exchanges for r in rows} == set(range(lo, hi + 1))
        assert any("LONG" in r.text for r in rows) == long
        for r in rows:
            assert r.text.startswith("<|im_start|>system\nSYS<|im_end|>\n")
            assert r.text.endswith('<tool_call>\n{"name":"x","arguments":{"k":"v"}}\n</tool_call>')
            assert r.text.count("<tool_call>") == r.num_exchanges + 1
            assert r.token_len == min(limit, r.pre_len) == len(r.input_ids) and r.truncated == (r.pre_len > limit)


def _char_codes(text):
    return [ord(c) for c in text]


def test_arrow_tokenizer_plugs_into_truncation(spark):
    from evalkit.operators.calibration import arrow_tokenizer, calib_profile, tokenise_truncate
    df = spark.createDataFrame([(1, "abcdef"), (2, "xy"), (3, "")], "doc_id int, text string")
    t = tokenise_truncate(df, 4, tokenizer=arrow_tokenizer(_char_codes)).orderBy("doc_id").collect()
    assert [(r.pre_len, r.token_len, r.truncated, r.at_max) for r in t] == [(6, 4, True, True), (2, 2, False, False),
                                                                            (0, 0, False, False)]
    assert t[0].input_ids == [97, 98, 99, 100] and t[0].position_ids == [0, 1, 2, 3] and t[2].position_ids == []
    p = calib_profile(tokenise_truncate(df, 4, tokenizer=arrow_tokenizer(_char_codes))).first()
    assert (p.samples, p.truncated_pre, p.truncated_at_max) == (3, 1, 1)
