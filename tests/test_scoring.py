import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalkit.functions import text as T
from evalkit.functions.scoring import score_status, score_tool_calls

# answer -> the five checks (tags, JSON, tool, key, value; T or -), or the error of the row
EDGE = [
    ('<tool_call>{"name": "read_file", "arguments": {"path": "a/config.json"}}</tool_call>',
     'TTTTT'),
    ('<tool_call>{"name": "read_file", "arguments": {"path": "x"}} trailing</tool_call>',
     'T----'),
    ("<tool_call>{'name': 'read_file'}</tool_call>",
     'T----'),
    ('<tool_call>{"name": "a", "name": "read_file", "arguments": {"path": "config.json", "path": "zz"}}</tool_call>',
     'TTTT-'),
    ('<tool_call>{"name": "read_file", "arguments": {"path": NaN}}</tool_call>',
     'TTTT-'),
    ('<tool_call>[1, 2]</tool_call>',
     'TT---'),
    ('<tool_call>"just a string"</tool_call>',
     'TT---'),
    ('<tool_call>{"name": "read_file"}</tool_call>',
     'TTT--'),
    ('<tool_call>{"name": "read_file", "arguments": null}</tool_call>',
     "argument of type 'NoneType' is not iterable"),
    ('<tool_call>{"name": "read_file", "arguments": 5}</tool_call>',
     "argument of type 'int' is not iterable"),
    ('<tool_call>{"name": "read_file", "arguments": 2.5}</tool_call>',
     "argument of type 'float' is not iterable"),
    ('<tool_call>{"name": "read_file", "arguments": true}</tool_call>',
     "argument of type 'bool' is not iterable"),
    ('<tool_call>{"name": "read_file", "arguments": "path here"}</tool_call>',
     "string indices must be integers, not 'str'"),
    ('<tool_call>{"name": "read_file", "arguments": "nothing"}</tool_call>',
     'TTT--'),
    ('<tool_call>{"name": "read_file", "arguments": ["path"]}</tool_call>',
     'list indices must be integers or slices, not str'),
    ('<tool_call>{"name": "read_file", "arguments": ["other", 3]}</tool_call>',
     'TTT--'),
    ('<tool_call>{"name": "read_file", "arguments": {"path": null}}</tool_call>',
     'TTTT-'),
    ('<tool_call>{"name": "read_file", "arguments": {"path": "CONFIG.JSON"}}</tool_call>',
     'TTTTT'),
    ('<tool_call>{"name": "read_file", "arguments": {"path": "a\nconfig.json"}}</tool_call>',
     'T----'),
    ('<think>x</think><think>y <tool_call>{"name": "z"}</tool_call></think>\n<tool_call>{"name": "read_file", "arguments": {"path": "config.json"}}</tool_call>',
     'TTTTT'),
    ('<think>unclosed <tool_call>{"name": "read_file", "arguments": {"path": "config.json"}}</tool_call>',
     'TTTTT'),
    ('',
     '-----'),
    ('   \n\t ',
     '-----'),
    ('<tool_call>1, "y": 2</tool_call>',
     'T----'),
    ('<tool_call>{"a": 1}, {"b": 2}</tool_call>',
     'T----'),
    ('<tool_call>\n{"name": "read_file", "arguments": {"path": "config.json"}}',
     'TTTTT'),
    ('{"name": "read_file", "arguments": {"path": "config.json"}}\n</tool_call>',
     'TTTTT'),
    ('{"name": "read_file", "arguments": {"path": "config.json"}}',
     'TTTTT'),
    ('prose {"name": "read_file", "arguments": {"path": "config.json"}}   ',
     'TTTTT'),
    ('<tool_call></tool_call>',
     'T----'),
    ('<tool_call>{"name": "run_command", "arguments": {"path": "config.json"}}</tool_call>',
     'TT-TT'),
    ('\xa0<tool_call>{"name": "read_file", "arguments": {"path": "config.json"}}</tool_call>\u3000',
     'TTTTT'),
]


def _score_rows(spark, answers, tool="read_file", key="path", needle="config.json"):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, answer string")
    out = score_tool_calls(df, "answer", F.lit(tool), F.lit(key), F.lit(needle))
    rows = sorted(out.collect(), key=lambda r: r.i)
    return [(r.has_tool_call_tags, r.valid_json, r.correct_tool, r.correct_arg_key, r.correct_arg_value,
             r.score, r.error) for r in rows]


def _row(expected):
    if len(expected) != 5:
        return (None, None, None, None, None, 0, expected)
    flags = [c == "T" for c in expected]
    return (*flags, sum(flags), None)


def test_edge_rows(spark):
    assert _score_rows(spark, [a for a, _ in EDGE]) == [_row(e) for _, e in EDGE]


def test_wrong_tool_can_score_four(spark):
    (row,) = _score_rows(spark, ['<tool_call>{"name": "read_file", "arguments": {"path": "/w/utils.py"}}</tool_call>'],
                         tool="replace_in_file", key="path", needle="utils.py")
    assert row[5] == 4 and row[2] is False


fragments = st.sampled_from(["<tool_call>", "</tool_call>", "<think>", "</think>", '{"name": ', '"read_file"',
                             ', "arguments": ', '{"path": "config.json"}', "}", "{", " ", "\n", "x", "[", "]",
                             '"', ":", ",", "null", "5", '"path"'])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(fragments, max_size=12).map("".join), min_size=1, max_size=25))
def test_properties_of_any_answer(spark, answers):
    rows = _score_rows(spark, answers)
    for *checks, score, error in rows:
        if error is None:
            assert score == sum(checks)
            assert checks[0] or not any(checks)  # nothing holds without a call
            assert checks[1] or not any(checks[2:])  # nor beyond the tags without JSON
            assert checks[3] or not checks[4]  # a value needs its key
        else:
            assert score == 0 and checks == [None] * 5
    # white space around an answer and a closed think block before it change nothing
    assert _score_rows(spark, ["<think>plan</think>\n " + a + " \n" for a in answers if "think>" not in a]) == [
        r for a, r in zip(answers, rows) if "think>" not in a]


def test_status_labels(spark):
    df = spark.createDataFrame([(s,) for s in range(6)], "score int")
    got = [r[0] for r in df.select(score_status("score")).orderBy("score").collect()]
    assert got == ["FAIL (0/5)", "FAIL (1/5)", "FAIL (2/5)", "PARTIAL (3/5)", "PARTIAL (4/5)", "PERFECT"]


def test_strip_and_words(spark):
    texts = ["  a  b\tc\n", "", "<think>\nhidden\n</think>  kept ", " x y　", "no think"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.strip_thinking("t").alias("c"), T.word_count("t").alias("w")).collect()
    assert [r.c for r in got] == ["a  b\tc", "", "kept", "x\xa0y", "no think"]
    assert [r.w for r in got] == [3, 0, 4, 2, 2]


@pytest.mark.parametrize("answer,passkey,found,ok", [
    ("123456", "123456", "123456", True),
    ("The key is 012345.", "012345", "012345", True),
    ("I think it is 999999 or 123456", "123456", "999999", True),
    ("no digits here at all, sorry", "123456", "no digits here at al", False),
    ("<think>123456</think> 654321", "123456", "654321", False),
])
def test_passkey(spark, answer, passkey, found, ok):
    df = spark.createDataFrame([(answer, passkey)], "a string, p string").withColumn("c", T.strip_thinking("a"))
    r = df.select(T.passkey_extract("c").alias("f"), T.passkey_correct("c", "p").alias("ok")).first()
    assert (r.f, r.ok) == (found, ok)


def test_code_block_and_report(spark):
    texts = ["Report\n```python\nx = 1\n```\nend", "R\n```\ny = 2\n```", "R\n```python\nz = 3", "plain",
             "a ``` b ```python c ``` d", "```python\n\n```"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.code_block("t").alias("c"), T.report_before_fence("t").alias("r")).collect()
    assert [r.c for r in got] == ["x = 1", "y = 2", "z = 3", None, "c", None]
    assert [r.r for r in got] == ["Report", "R", "R", "plain", "a", ""]


def test_alloc_failure(spark):
    msgs = ["Failed to allocate 2147483648 bytes", "allocate something else", "other error"]
    df = spark.createDataFrame([(m,) for m in msgs], "m string").select(T.alloc_failure("m").alias("t"))
    got = [(r.t.kind, r.t.alloc_bytes) for r in df.collect()]
    assert got == [("OOM", 2147483648), ("OOM", None), ("FAILED", None)]


def test_numeric_name_never_equals_text(spark):
    rows = ['<tool_call>{"name": 5, "arguments": {"path": "x"}}</tool_call>',
            '<tool_call>{"name": "5", "arguments": {"path": "x"}}</tool_call>']
    got = _score_rows(spark, rows, tool="5", key="path", needle="x")
    assert got == [_row("TT-TT"), _row("TTTTT")]


@pytest.mark.parametrize("value, needle, found", [
    ("2.50", "2.5", True), ("2.50", "50", False), ("25", "25", True), ("25", "2.5", False), ("true", "true", True),
    ("true", "1", False), ("null", "none", True), ("null", "null", False), ('"x50"', "50", True),
    # floats as Python prints them, integers of any length, lists and objects
    ("12345678.5", "12345678.5", True), ("0.0005", "0.0005", True), ("1e16", "1e+16", True), ("1e15", "1000000000000000.0", True),
    ("1E-7", "1e-07", True), ("-0.0", "-0.0", True), ("123456789012345678901234567890123456789012",
                                                     "123456789012345678901234567890123456789012", True),
    ('{"a": 1}', "{'a': 1}", True), ('["x"]', "['x']", True), ('["x", 2.50, null, {"b": true}]', "['x', 2.5, none, {'b': true}]", True),
    ('["it\'s"]', '["it\'s"]', True), ("[1,2]", "1, 2", True), ("[1,2]", "1,2", False),
])
def test_value_is_compared_through_python_str(spark, value, needle, found):
    row = '<tool_call>{"name": "read_file", "arguments": {"path": ' + value + '}}</tool_call>'
    assert _score_rows(spark, [row], needle=needle) == [_row("TTTTT" if found else "TTTT-")]
