"""Golden checks: stored result rows of the reference (embedded as data; tests
never read the reference files) re-scored natively, and the published per-context
averages recomputed with the summary operator."""

from pyspark.sql import functions as F

from evalkit import pools
from evalkit.functions.scoring import score_tool_calls
from evalkit.operators.summaries import tool_call_summary

# ---- fixed values: stored answers (untruncated) and their stored scores ---------
STORED = [
    ("tool_call_hard", "search_code", 5, '{"name": "search_code", "arguments": {"pattern": "process_request", '
     '"directory": "/workspace/src", "file_pattern": "*.py"}}\n</tool_call>'),
    ("tool_call_hard", "get_diagnostics", 5, '{"name": "get_diagnostics", "arguments": {"path": '
     '"/workspace/src/models/user.py", "severity": "error"}}\n</tool_call>'),
    ("tool_call_hard", "replace_in_file", 4, '{"name": "read_file", "arguments": {"path": "/workspace/src/utils.py"}}'
     '\n</tool_call>'),
    ("tool_call_hard", "run_command", 5, '{"name": "run_command", "arguments": {"command": "pytest tests/ -v '
     '--tb=short", "cwd": "/workspace", "timeout": 60}}\n</tool_call>'),
    ("tool_call_hard", "replace_in_file", 5, '{"name": "replace_in_file", "arguments": {"path": "/workspace/src/utils.py", '
     '"old_text": "import os", "new_text": "import os\\nimport sys"}}\n</tool_call>'),
    ("tool_call", "search_web", 5, '{"name": "search_web", "arguments": {"query": "OpenVINO 2026 release notes"}}'
     '\n</tool_call>'),
    ("tool_call", "read_file", 5, '{"name": "read_file", "arguments": {"path": "/home/user/config.json"}}\n</tool_call>'),
    ("tool_call", "run_command", 5, '{"name": "run_command", "arguments": {"command": "pip install numpy"}}\n</tool_call>'),
    ("tool_call", "list_directory", 5, '{"name": "list_directory", "arguments": {"path": "/var/log"}}\n</tool_call>'),
    ("tool_call", "calculate", 5, '{"name": "calculate", "arguments": {"expression": "2**32 - 1"}}\n</tool_call>'),
]
# hard suite, INT4, per context: stored scores of the five cases
HARD_INT4_SCORES = {4096: [5, 5, 5, 4, 5], 8192: [5, 5, 5, 4, 5], 16384: [5, 5, 5, 5, 5],
                    24576: [1, 5, 5, 4, 5], 32768: [1, 5, 5, 5, 5]}
PUBLISHED_HARD_INT4 = {4096: 4.8, 8192: 4.8, 16384: 5.0, 24576: 4.0, 32768: 4.2}
# ---------------------------------------------------------------------------------


def test_stored_answers_rescore_to_stored_scores(spark):
    cases = {(suite, tool): (key, needle) for suite, tool, key, needle in pools.CASE_TRIPLES}
    rows = [(i, suite, tool, *cases[(suite, tool)], ans, score)
            for i, (suite, tool, score, ans) in enumerate(STORED)]
    df = spark.createDataFrame(rows, "i int, test string, tool string, k string, needle string, answer string, "
                                     "stored int")
    out = score_tool_calls(df, "answer", "tool", "k", "needle").collect()
    assert [(r.i, r.score) for r in sorted(out, key=lambda r: r.i)] == [(r[0], r[-1]) for r in rows]


def test_published_hard_averages(spark):
    rows = [("tool_call_hard", c, s) for c, ss in HARD_INT4_SCORES.items() for s in ss]
    df = (spark.createDataFrame(rows, "test string, context_length int, score int")
          .withColumn("has_tool_call_tags", F.lit(True)).withColumn("valid_json", F.col("score") > 1)
          .withColumn("correct_tool", F.col("score") == 5))
    got = {r.context_length: round(r.avg_score, 1) for r in tool_call_summary(df).collect()}
    assert got == PUBLISHED_HARD_INT4


def test_old_scorer_run_rescores_to_five(spark):
    """A stored run scored 0 by an older scorer: its answers are complete calls
    without the opening tag, which the present cascade accepts."""
    from evalkit.operators.summaries import cases_table, rescore_results
    stored = [  # ---- fixed values: three stored rows of that run (score 0 as stored) ----
        ("tool_call", 4096, "search_web", 0,
         '{"name": "search_web", "arguments": {"query": "OpenVINO 2026 release notes"}}\n</tool_call>'),
        ("tool_call", 4096, "read_file", 0,
         '{"name": "read_file", "arguments": {"path": "/home/user/config.json"}}\n</tool_call>'),
        ("tool_call", 4096, "run_command", 0,
         '{"name": "run_command", "arguments": {"command": "pip install numpy"}}\n</tool_call>'),
    ]
    df = spark.createDataFrame(stored, "test string, context_length int, expected_tool string, score int, "
                                       "answer_preview string")
    out = rescore_results(df, cases_table(spark)).collect()
    assert sorted((r.expected_tool, r.stored_score, r.score, r.reliable) for r in out) == [
        ("read_file", 0, 5, True), ("run_command", 0, 5, True), ("search_web", 0, 5, True)]
