from evalkit.operators import summaries as S


def test_model_compare_three_runs(spark):
    rows = [("r1", "tool_call", 4096, None, "x", 5, None), ("r2", "tool_call", 4096, None, "x", 3, None),
            ("r3", "tool_call", 4096, None, "x", 4, None), ("r3", "tool_call", 8192, None, "x", 1, None),
            ("r1", "niah", 4096, 0.5, None, None, True), ("r2", "niah", 4096, 0.5, None, None, False)]
    df = spark.createDataFrame(rows, "run_id string, test string, context_length int, depth double, "
                                     "expected_tool string, score int, correct boolean")
    got = {(r.test, r.context_length): r for r in S.model_compare(df, "r1", "r2", "r3").collect()}
    a = got[("tool_call", "4096")]
    assert (a.score_a, a.score_b, a.score_c, a.delta, a.n_a) == (5.0, 3.0, 4.0, -1.0, 1)
    b = got[("tool_call", "8192")]
    assert (b.score_a, b.n_a, b.score_c, b.delta) == (None, None, 1.0, None)
    c = got[("niah", "4096")]
    assert (c.score_a, c.score_b, c.score_c) == (5.0, 0.0, None)


def test_niah_matrix_first_row_and_missing_cells(spark):
    rows = [(0.5, 4096, True, 2), (0.5, 4096, False, 1), (0.25, 8192, True, 3)]
    df = spark.createDataFrame(rows, "depth double, context_length int, correct boolean, seq int")
    got = {r.depth: (r.c4096, r.c8192) for r in S.niah_matrix(df, [4096, 8192]).collect()}
    assert got == {0.5: ("FAIL", "--"), 0.25: ("--", "PASS")}


def test_degradation_onset(spark):
    rows = [("m", 4096, 5), ("m", 8192, 5), ("m", 16384, 4), ("m", 32768, 5), ("n", 4096, 5), ("n", 8192, 5)]
    df = spark.createDataFrame(rows, "model string, context_length int, score int")
    got = {r.model: r.onset_context for r in S.degradation_onset(df, ["model"], bound=4.5).collect()}
    assert got == {"m": 16384, "n": None}


def test_chatml_render(spark):
    from evalkit.operators.packing import render_messages
    df = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "user", "U")], "conv_id long, turn long, role string, text string")
    r = render_messages(df, template="chatml").first()
    assert r.rendered == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\n"


def test_batch_metadata_and_dropped_targets(spark):
    from evalkit.operators import catalog as K
    meta = spark.createDataFrame([(2, 64, "b2"), (0, 32, "b0"), (1, 16, "b1")], "batch int, subset_size int, note string")
    m = K.first_metadata(meta).first()
    assert (m.subset_size, m.note) == (32, "b0")
    t = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "saved_name string")
    keys = spark.createDataFrame([("t2", 0), ("t9", 0)], "saved_name string, batch int")
    assert [r.saved_name for r in K.dropped_targets(t, keys).orderBy("saved_name").collect()] == ["t1", "t3"]
    kd = K.target_keep_drop(t, keys).first()
    assert (kd.batch, kd.kept, kd.removed) == (0, 1, 2)


def test_rows_of_failed_runs_count_in_summaries_and_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from evalkit.operators import summaries as S
    from evalkit.sources import results_io as IO
    bad = spark.createDataFrame([(4096, 0.5, "000123", "x" * 300)], "context_length int, depth double, passkey string, message string")
    good = spark.createDataFrame([(4096, 0.25, "000123", "000123")], "context_length int, depth double, passkey string, raw_answer string")
    niah = S.suite_union(S.score_niah(good).withColumn("test", F.lit("niah")), S.failed_niah(bad))
    assert S.niah_accuracy(niah).first().accuracy_pct == 50.0
    row = niah.filter("answer = 'ERROR'").first()
    assert (row.correct, row.elapsed, row.output_tokens, row.error) == (False, 0.0, 0, "x" * 200)
    cells = spark.createDataFrame([("tool_call", 4096, "read_file", "Read.", "boom")],
                                  "test string, context_length int, expected_tool string, instruction string, message string")
    ok = spark.createDataFrame([("tool_call", 4096, '{"name": "read_file", "arguments": {"path": "a"}}', "read_file", "path", "a")],
                               "test string, context_length int, answer string, expected_tool string, expected_arg_key string, "
                               "expected_arg_contains string")
    scored = S.suite_union(S.score_responses(ok), S.failed_tool_calls(cells))
    a3 = S.tool_call_summary(scored).first()
    assert (a3.n, a3.avg_score, a3.perfect, a3.has_tags) == (2, 2.5, 1, 1)
    both = S.suite_union(niah, scored.select("test", "context_length", "expected_tool", "score", "error"))
    IO.write_results_json(both, f"{tmp_path}/out")
    back = IO.read_results_json(spark, f"{tmp_path}/out", "test string, error string, score int")
    assert sorted(r.error for r in back.filter("error is not null").collect()) == ["boom", "x" * 200]
    IO.write_results_csv(both, f"{tmp_path}/csv", first_columns=["test", "context_length", "answer", "correct"])
    assert IO.read_results_csv(spark, f"{tmp_path}/csv", "test string, context_length int, answer string, correct boolean").count() == 4


def test_first_valid_attempt_by_hand(spark):
    import random

    from evalkit.operators import summaries as S
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([1, 2, 3, 4, None]), rng.choice([True, False, None]), rng.choice([True, False, None]))
            for _ in range(60)] + [(9, None, True, True), (8, 2, True, False), (7, 1, False, True)]
    df = spark.createDataFrame(rows, "case_id int, attempt int, has_code boolean, ok boolean")
    got = {r.case_id: tuple(r)[1:] for r in S.first_valid_attempt(df).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c and r[1] is not None]
        first = min((a for _, a, h, o in own if h and o), default=None)
        before = [(h, o) for _, a, h, o in own if first is None or a < first]
        used = first if first is not None else max((a for _, a, _, _ in own), default=None)
        assert got[c] == (first, sum(bool(h and not o) for h, o in before), sum(not h for h, o in before), used, first is not None)
    plan = S.first_valid_attempt(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_tool_lists_in_parts(spark):
    import json

    import pytest

    from evalkit.operators import prompts as G
    rows = [(f"tool{i % 37:03d}", f"does {i % 37}", "string") for i in range(90)]
    tools = spark.createDataFrame(rows, "name string, description string, parameters string")
    parts = sorted(G.tool_definitions(tools, part_tools=10).collect(), key=lambda r: r.part)
    assert [(r.part, r.n_tools) for r in parts] == [(0, 10), (1, 10), (2, 10), (3, 7)]
    whole = json.loads("".join(r.tools_json for r in parts))
    assert [t["name"] for t in whole] == [f"tool{i:03d}" for i in range(37)] and whole[3]["description"] == "does 3"
    one = G.whole_definitions(G.tool_definitions(tools, part_tools=10)).first()
    assert one.n_tools == 37 and json.loads(one.tools_json) == whole
    assert G.whole_definitions(G.tool_definitions(tools.limit(0))).first().tools_json == "[]"
    with pytest.raises(ValueError, match="tool list"):
        G.whole_definitions(G.tool_definitions(tools), max_bytes=100)
