"""Queries over scored runs and conversations: U1, F3, O2, A1, A2, A4, A5, A11,
J2, W2, W4-W8, F7."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalkit import fixtures as fx
from evalkit import pools
from evalkit.functions import text as T
from evalkit.operators import packing, summaries as S
from evalkit.queries import register
from evalkit.queries.q_scoring import FX2, FX14
from evalkit.queries.sqlfx import FX1, FX15, MESSAGE_ORDER, SCORED, strip_sql, words_sql
from evalkit.queries.util import rounded
from evalkit.sources.tables import table

RUN_TS = "2026-01-01 00:00:00"


def runs(spark, sf):
    """FX3: both suites scored, two models by id parity, one run each."""
    tool = S.score_responses(fx.responses(spark, sf)).select(
        F.col("event_id").alias("id"), F.concat(F.lit("m"), F.pmod("event_id", F.lit(2)).cast("string")).alias("model"),
        "test", "context_length", "expected_tool", "instruction", "has_tool_call_tags", "valid_json",
        "correct_tool", "correct_arg_key", "correct_arg_value", "score", "answer_preview",
        T.round2("elapsed").alias("elapsed"), "output_tokens", "error")
    niah = S.score_niah(fx.needle_cells(spark, sf)).select(
        F.col("doc_id").alias("id"), F.concat(F.lit("m"), F.pmod("doc_id", F.lit(2)).cast("string")).alias("model"),
        F.lit("niah").alias("test"), "context_length", "depth", "passkey", "answer", "correct",
        T.round2(F.col("depth") * 10 + 1).alias("elapsed"), "output_tokens", "seq")
    u = S.suite_union(niah, tool)
    return (u.withColumn("run_ts", F.to_timestamp_ntz(F.lit(RUN_TS)))
            .withColumn("run_id", F.concat("model", F.lit("_20260101_000000"))))


FX3 = f"""{FX1}, {SCORED}, {FX2},
 fx3 AS (SELECT doc_id AS id, 'm' || CAST(doc_id % 2 AS VARCHAR) AS model, 'niah' AS test, context_length, depth, passkey,
     answer, correct, round(depth * 10 + 1, 2) AS elapsed, output_tokens, seq FROM niah
   UNION ALL BY NAME
   SELECT event_id AS id, 'm' || CAST(event_id % 2 AS VARCHAR) AS model, test, context_length, expected_tool, instruction,
     has_tool_call_tags, valid_json, correct_tool, correct_arg_key, correct_arg_value, score, substring(answer, 1, 200) AS answer_preview,
     round(elapsed, 2) AS elapsed, {words_sql('answer')} AS output_tokens, error FROM scored_r),
 runs AS (SELECT *, TIMESTAMP '{RUN_TS}' AS run_ts, model || '_20260101_000000' AS run_id FROM fx3)"""
W3 = f"WITH {FX3} "


@register("suite_union", W3 + "SELECT id, model, test, context_length, depth, score, correct FROM runs")
def q_suite_union(spark, sf):
    return runs(spark, sf).select("id", "model", "test", "context_length", "depth", "score", "correct")


@register("suite_filter", W3 + "SELECT id, model, test FROM runs WHERE test IN ('niah', 'tool_call')")
def q_suite_filter(spark, sf):
    return S.suite_filter(runs(spark, sf), ["niah", "tool_call"]).select("id", "model", "test")


@register("sorted_distinct_axes", W3 + """SELECT axis, value, row_number() OVER (PARTITION BY axis ORDER BY value) AS pos FROM (
  SELECT DISTINCT 'context_length' AS axis, CAST(context_length AS DOUBLE) AS value FROM runs WHERE context_length IS NOT NULL
  UNION SELECT DISTINCT 'depth', depth FROM runs WHERE depth IS NOT NULL) a""")
def q_sorted_axes(spark, sf):
    return S.sorted_distinct_axes(runs(spark, sf), ["context_length", "depth"])


@register("niah_accuracy", W3 + """SELECT model, context_length, count(*) AS n, round(avg(CAST(correct AS INTEGER)) * 100, 6) AS accuracy_pct
  FROM runs WHERE test = 'niah' GROUP BY model, context_length""")
def q_niah_accuracy(spark, sf):
    r = S.suite_filter(runs(spark, sf), ["niah"])
    return rounded(S.niah_accuracy(r, ["model", "context_length"]))


MATRIX_CTX = pools.QUICK_LENGTHS + [65536]


@register("niah_matrix", W3 + "SELECT model, depth, " + ", ".join(
    f"coalesce(min_by(CASE WHEN correct THEN 'PASS' ELSE 'FAIL' END, seq) FILTER (WHERE context_length = {c}), '--') AS c{c}"
    for c in MATRIX_CTX) + " FROM runs WHERE test = 'niah' GROUP BY model, depth")
def q_niah_matrix(spark, sf):
    return S.niah_matrix(S.suite_filter(runs(spark, sf), ["niah"]), MATRIX_CTX, by=["model"])


TOOLS = ["click", "error", "purchase", "signup", "view"]


@register("tool_context_matrix", W3 + "SELECT context_length, " + ", ".join(
    f"round(avg(score) FILTER (WHERE expected_tool = '{t}'), 6) AS {t}_score, "
    f"round(avg(elapsed) FILTER (WHERE expected_tool = '{t}'), 6) AS {t}_time" for t in TOOLS)
    + " FROM runs WHERE test <> 'niah' GROUP BY context_length")
def q_tool_context_matrix(spark, sf):
    r = runs(spark, sf).filter(F.col("test") != "niah")
    return rounded(S.tool_context_matrix(r, TOOLS))


@register("model_compare", W3 + """, cells AS (SELECT run_id, test, coalesce(CAST(context_length AS VARCHAR), '') AS context_length,
    coalesce(CAST(depth AS VARCHAR), '') AS depth, coalesce(expected_tool, '') AS expected_tool,
    avg(coalesce(CAST(score AS DOUBLE), CAST(correct AS INTEGER) * 5.0)) AS s, count(*) AS n FROM runs GROUP BY ALL),
  a AS (SELECT * FROM cells WHERE run_id = 'm0_20260101_000000'), b AS (SELECT * FROM cells WHERE run_id = 'm1_20260101_000000')
  SELECT coalesce(a.test, b.test) AS test, coalesce(a.context_length, b.context_length) AS context_length,
    coalesce(a.depth, b.depth) AS depth, coalesce(a.expected_tool, b.expected_tool) AS expected_tool,
    round(a.s, 6) AS score_a, a.n AS n_a, round(b.s, 6) AS score_b, b.n AS n_b, round(b.s - a.s, 6) AS delta
  FROM a FULL OUTER JOIN b ON a.test = b.test AND a.context_length = b.context_length AND a.depth = b.depth
    AND a.expected_tool = b.expected_tool""")
def q_model_compare(spark, sf):
    return rounded(S.model_compare(runs(spark, sf), "m0_20260101_000000", "m1_20260101_000000"))


@register("degradation_onset", W3 + """, per AS (SELECT model, test, context_length, avg(score) AS a FROM runs WHERE test <> 'niah' GROUP BY ALL),
  f AS (SELECT *, max(a) OVER (PARTITION BY model, test ORDER BY context_length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM per)
  SELECT model, test, min(context_length) FILTER (WHERE a < 4.5 OR a < coalesce(best, a)) AS onset_context,
    round(max(a), 6) AS best_avg, round(min(a), 6) AS worst_avg FROM f GROUP BY model, test""")
def q_degradation_onset(spark, sf):
    r = runs(spark, sf).filter(F.col("test") != "niah")
    return rounded(S.degradation_onset(r, ["model", "test"], bound=4.5))


@register("narration_outliers", W3 + """, m AS (SELECT test, context_length, median(output_tokens) AS median_words FROM runs
    WHERE test <> 'niah' GROUP BY ALL)
  SELECT id, test, context_length, output_tokens, round(median_words, 6) AS median_words FROM runs JOIN m USING (test, context_length)
  WHERE test <> 'niah' AND NOT coalesce(valid_json, false) AND output_tokens > median_words * 1.2""")
def q_narration_outliers(spark, sf):
    r = runs(spark, sf).filter(F.col("test") != "niah")
    out = S.narration_outliers(r, ["test", "context_length"], factor=1.2)
    return rounded(out.select("id", "test", "context_length", "output_tokens", "median_words"))


@register("throughput_by_prompt", f"""WITH {FX14}, t AS (SELECT *, CASE WHEN elapsed > 0 THEN tokens / elapsed ELSE 0.0 END AS tps FROM fx14)
  SELECT prompt, round(median(tps), 6) AS median_tps, round(median(elapsed), 6) AS median_elapsed,
    round(median(tokens), 6) AS median_tokens FROM t GROUP BY prompt""")
def q_throughput_by_prompt(spark, sf):
    return rounded(S.throughput_by_prompt(fx.throughput_runs(spark, sf)))


@register("throughput_overall", f"""WITH {FX14}, t AS (SELECT *, CASE WHEN elapsed > 0 THEN tokens / elapsed ELSE 0.0 END AS tps FROM fx14)
  SELECT count(*) AS runs, round(avg(tps), 6) AS mean_tps, round(min(tps), 6) AS min_tps, round(max(tps), 6) AS max_tps,
    round(avg(elapsed), 6) AS mean_elapsed, round(avg(tokens), 6) AS mean_tokens, round(median(tps), 6) AS median_tps,
    round(median(elapsed), 6) AS median_elapsed, round(median(tokens), 6) AS median_tokens FROM t""")
def q_throughput_overall(spark, sf):
    return rounded(S.throughput_overall(fx.throughput_runs(spark, sf)))


@register("pack_to_budget", f"""WITH {FX15} SELECT conv_id, turn, tokens, CAST(tokens_before AS BIGINT) AS tokens_before FROM (SELECT conv_id, turn, length(text) // 4 AS tokens,
  coalesce(sum(length(text) // 4) OVER ({MESSAGE_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tokens_before
  FROM fx15) x WHERE tokens_before < 300""")
def q_pack_to_budget(spark, sf):
    p = packing.pack_to_budget(fx.messages(spark, sf), 300)
    return p.select("conv_id", "turn", "tokens", F.col("tokens_before").cast("long").alias("tokens_before"))


FX5 = f"""{FX15}, fx5 AS (SELECT conv_id, turn, text, md5(coalesce(role, '') || ':' || coalesce(text, '')) AS tie FROM (
  SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'reset'
    WHEN conv_id % 10 = 0 AND turn = 4 THEN 'quit' WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE text END AS text FROM fx15) c)"""


@register("session_turns", f"""WITH {FX5}, f AS (SELECT *, lower({strip_sql('text')}) AS inp, row_number() OVER ({MESSAGE_ORDER}) AS pos FROM fx5),
  q AS (SELECT conv_id, min(pos) AS qt FROM f WHERE inp IN ('quit', 'exit') GROUP BY conv_id),
  l AS (SELECT f.* FROM f LEFT JOIN q ON f.conv_id IS NOT DISTINCT FROM q.conv_id WHERE q.qt IS NULL OR f.pos < q.qt),
  r AS (SELECT *, sum(CASE WHEN inp = 'reset' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS resets FROM l)
  SELECT conv_id, turn, CAST(resets + 1 AS BIGINT) AS session,
    row_number() OVER (PARTITION BY conv_id, resets ORDER BY pos) AS session_turn FROM r WHERE inp <> '' AND inp <> 'reset'""")
def q_session_turns(spark, sf):
    s = packing.session_turns(fx.chat_turns(spark, sf))
    return s.select("conv_id", "turn", "session", F.col("session_turn").cast("long").alias("session_turn"))


@register("first_valid_attempt", """WITH a AS (SELECT event_id // 3 AS case_id, CAST(event_id % 3 + 1 AS INTEGER) AS attempt,
    event_type <> 'error' AS has_code, event_type = 'purchase' AS ok FROM events),
  f AS (SELECT case_id, min(attempt) FILTER (WHERE ok AND has_code) AS first_ok, max(attempt) AS last FROM a GROUP BY case_id)
  SELECT case_id, first_ok, count(*) FILTER (WHERE attempt < coalesce(first_ok, last + 1) AND has_code AND NOT ok) AS syntax_errors,
    count(*) FILTER (WHERE attempt < coalesce(first_ok, last + 1) AND NOT has_code) AS no_code,
    coalesce(first_ok, last) AS attempts_used, first_ok IS NOT NULL AS succeeded FROM a JOIN f USING (case_id) GROUP BY case_id, first_ok, last""")
def q_first_valid_attempt(spark, sf):
    return S.first_valid_attempt(fx.attempts(spark, sf))


@register("message_numbering", f"""WITH {FX15} SELECT conv_id, turn, row_number() OVER w AS msg_no, count(*) OVER (PARTITION BY conv_id) AS n_msgs,
  '=== [' || role || '] (msg ' || CAST(row_number() OVER w AS VARCHAR) || '/' || CAST(count(*) OVER (PARTITION BY conv_id) AS VARCHAR) || ') ===' AS header
  FROM fx15 WINDOW w AS ({MESSAGE_ORDER})""")
def q_message_numbering(spark, sf):
    m = packing.message_numbering(fx.messages(spark, sf))
    return m.select("conv_id", "turn", F.col("msg_no").cast("long").alias("msg_no"), "n_msgs", "header")


@register("head_tail_messages", f"""WITH {FX15} SELECT conv_id, turn, msg_no, n_msgs, CASE WHEN msg_no = n_msgs THEN text WHEN msg_no = 1 THEN substring(text, 1, 500)
  ELSE substring(text, 1, 200) END AS preview FROM (SELECT conv_id, turn, text, row_number() OVER ({MESSAGE_ORDER}) AS msg_no,
  count(*) OVER (PARTITION BY conv_id) AS n_msgs FROM fx15) x WHERE msg_no <= 4 OR msg_no > n_msgs - 3""")
def q_head_tail(spark, sf):
    h = packing.head_tail_messages(fx.messages(spark, sf))
    return h.select("conv_id", "turn", F.col("msg_no").cast("long").alias("msg_no"), "n_msgs", "preview")
