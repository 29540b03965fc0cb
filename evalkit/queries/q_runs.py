"""Queries over whole runs: rows of runs that raised, through summaries and result files (A1, A3,
S1, S2), JSON arrays (S1), re-scoring of stored runs, the contexts x cases grid (G1), layer
metrics (A12), metadata of batches (U2), and large packed tensors (T1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalkit import fixtures as fx
from evalkit import pools
from evalkit.functions import tensors as TF
from evalkit.operators import catalog as K
from evalkit.operators import prompts as G
from evalkit.operators import summaries as S
from evalkit.operators import tensors as TO
from evalkit.queries import register
from evalkit.queries.q_catalog import QUANT, packed
from evalkit.queries.q_generators import PASSKEY_SQL
from evalkit.queries.q_results import FX3, runs
from evalkit.queries.q_scoring import FX12, scored
from evalkit.queries.q_sources import NIAH_KEYS, NIAH_SCHEMA
from evalkit.queries.sqlfx import CTX5, FX1, SCORED
from evalkit.queries.util import rounded
from evalkit.session import scratch_path
from evalkit.sources import results_io as IO
from evalkit.sources.tables import table

FAILED = f"""{FX12}, fx16 AS (SELECT event_id, message, {CTX5.format(id='event_id')} AS context_length,
    [{', '.join(map(str, pools.QUICK_DEPTHS))}][event_id % 3 + 1]::DOUBLE AS depth, {PASSKEY_SQL.replace('doc_id', 'event_id')} AS passkey,
    CASE WHEN (event_id // 2) % 2 = 0 THEN 'tool_call' ELSE 'tool_call_hard' END AS test, event_type AS expected_tool,
    'Call ' || event_type || ' for event ' || CAST(event_id AS VARCHAR) AS instruction
  FROM events JOIN fx12 USING (event_id) WHERE event_type = 'error'),
 failed AS (SELECT event_id AS id, 'niah' AS test, context_length, depth, passkey, 'ERROR' AS answer, false AS correct, 0.0 AS elapsed,
     0 AS output_tokens, substring(message, 1, 200) AS error FROM fx16
   UNION ALL BY NAME SELECT event_id AS id, test, context_length, expected_tool, instruction, 0 AS score, 0.0 AS elapsed,
     substring(message, 1, 200) AS error FROM fx16),
 all_runs AS (SELECT id, test, context_length, depth, passkey, answer, correct, elapsed, output_tokens, expected_tool, instruction,
     has_tool_call_tags, valid_json, correct_tool, score, error FROM runs UNION ALL BY NAME SELECT * FROM failed)"""
WITH = f"WITH {FX3}, {FAILED} "
KEPT = ["id", "test", "context_length", "depth", "passkey", "answer", "correct", "elapsed", "output_tokens", "expected_tool",
        "instruction", "has_tool_call_tags", "valid_json", "correct_tool", "score", "error"]


def all_runs(spark, sf):
    """The rows of all runs, those that raised among them."""
    cells = fx.failed_cells(spark, sf)
    return S.suite_union(runs(spark, sf).select(*KEPT), S.failed_niah(cells, keep=["id"]), S.failed_tool_calls(cells, keep=["id"]))


@register("error_rows_accuracy", WITH + """SELECT context_length, count(*) AS n, round(avg(CAST(correct AS INTEGER)) * 100, 6) AS accuracy_pct,
  count(error) AS errors FROM all_runs WHERE test = 'niah' GROUP BY context_length""")
def q_error_rows_accuracy(spark, sf):
    r = S.suite_filter(all_runs(spark, sf), ["niah"])
    errors = r.groupBy("context_length").agg(F.count("error").alias("errors"))
    return rounded(S.niah_accuracy(r).join(errors, "context_length"))


@register("error_rows_summary", WITH + """SELECT test, context_length, count(score) AS n, round(avg(score), 6) AS avg_score,
  count(*) FILTER (WHERE score = 5) AS perfect, count(*) FILTER (WHERE score IS NOT NULL AND has_tool_call_tags) AS has_tags,
  count(*) FILTER (WHERE score IS NOT NULL AND valid_json) AS valid_json, count(*) FILTER (WHERE score IS NOT NULL AND correct_tool) AS right_tool,
  CAST(context_length // 1024 AS VARCHAR) || 'K' AS label FROM all_runs GROUP BY test, context_length HAVING count(score) > 0""")
def q_error_rows_summary(spark, sf):
    return rounded(S.tool_call_summary(all_runs(spark, sf)))


ERROR_COLUMNS = ["id", "test", "context_length", "expected_tool", "score", "answer", "error"]


@register("error_rows_json", WITH + f"SELECT {', '.join(ERROR_COLUMNS)} FROM all_runs")
def q_error_rows_json(spark, sf):
    path = scratch_path(spark, "error-rows-json")
    IO.write_results_json(all_runs(spark, sf).select(*ERROR_COLUMNS), path)
    return IO.read_results_json(spark, path, "id long, test string, context_length int, expected_tool string, score int, "
                                             "answer string, error string")


@register("error_rows_csv", WITH + f"SELECT {', '.join(NIAH_KEYS)} FROM all_runs")
def q_error_rows_csv(spark, sf):
    path = scratch_path(spark, "error-rows-csv")
    IO.write_results_csv(all_runs(spark, sf), path, first_columns=NIAH_KEYS)
    return IO.read_results_csv(spark, path, NIAH_SCHEMA)


@register("results_json_arrays", f"""WITH {FX1}, {SCORED} SELECT event_id, test, context_length, score,
  substring(answer, 1, 200) AS answer_preview, valid_json FROM scored_r""")
def q_results_json_arrays(spark, sf):
    path = scratch_path(spark, "results-arrays")
    IO.write_results_json_arrays(scored(spark, sf).select("event_id", "test", "context_length", "score", "answer_preview", "valid_json"), path)
    return IO.read_results_json(spark, path, "event_id long, test string, context_length int, score int, answer_preview string, "
                                             "valid_json boolean", multiline=True)


@register("rescore_stored", f"""WITH {FX1}, {SCORED}, cut AS (SELECT event_id, test, context_length, event_type, expected_tool, expected_arg_key,
    expected_arg_contains, user_id, score AS stored_score, substring(answer, 1, 200) AS answer FROM scored_r),
  again AS (SELECT * FROM ({f"WITH fx1 AS (SELECT * EXCLUDE stored_score FROM cut), {SCORED} SELECT event_id, score FROM scored_r"}) s)
  SELECT event_id, test, stored_score, again.score, length(answer) < 200 AS reliable FROM cut JOIN again USING (event_id)""")
def q_rescore_stored(spark, sf):
    stored = scored(spark, sf)
    cases = stored.select("event_id", "expected_arg_key", "expected_arg_contains")
    out = S.rescore_results(stored.drop("expected_arg_key", "expected_arg_contains"), cases, on=["event_id"])
    return out.select("event_id", "test", "stored_score", "score", "reliable")


CASES = ", ".join(f"('{t}', '{e}')" for t, e, _, _ in pools.CASE_TRIPLES)


@register("case_grid", f"""SELECT event_id, c AS context_length, test, expected_tool FROM events,
  (VALUES {', '.join(f'({c})' for c in pools.QUICK_LENGTHS)}) cl(c), (VALUES {CASES}) cs(test, expected_tool) WHERE event_type = expected_tool
  OR event_id % 10 = (c // 4096) % 10""")
def q_case_grid(spark, sf):
    grid = G.eval_grid(spark, pools.QUICK_LENGTHS, cases=S.cases_table(spark).select("test", "expected_tool"))
    cells = G.expand_grid(table(spark, sf, "events").select("event_id", "event_type"), grid)
    due = (F.col("event_type") == F.col("expected_tool")) | (F.col("event_id") % 10 == F.floor(F.col("context_length") / 4096) % 10)
    return cells.filter(due).select("event_id", "context_length", "test", "expected_tool")


@register("layer_sensitivity", """WITH c AS (SELECT label, channel, var_pop(x) AS v, avg(abs(x)) AS m, avg(x * x) AS q FROM (
    SELECT label, unnest(range(len(embedding))) AS channel, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e GROUP BY label, channel)
  SELECT label, round(max(v), 6) AS max_activation_variance, round(avg(v), 6) AS mean_activation_variance,
    round(avg(m), 6) AS mean_activation_magnitude, round(avg(q), 6) AS hessian_input_activation, count(*) AS channels FROM c GROUP BY label""")
def q_layer_sensitivity(spark, sf):
    stats = TO.channel_stats(table(spark, sf, "embeddings"), "embedding", by=["label"])
    return rounded(TO.layer_sensitivity(stats, ["label"]))


@register("batch_metadata", """WITH m AS (SELECT p_size AS batch, min(CASE WHEN p_size % 7 >= 3 THEN p_brand END) AS dataset,
    min(CASE WHEN p_size % 7 >= 5 THEN p_type END) AS subset FROM part GROUP BY p_size)
  SELECT arg_min({'d': dataset, 's': subset}, batch).d AS dataset, arg_min({'d': dataset, 's': subset}, batch).s AS subset
  FROM m WHERE dataset IS NOT NULL OR subset IS NOT NULL""")
def q_batch_metadata(spark, sf):
    meta = table(spark, sf, "part").groupBy(F.col("p_size").alias("batch")).agg(
        F.min(F.expr("CASE WHEN p_size % 7 >= 3 THEN p_brand END")).alias("dataset"),
        F.min(F.expr("CASE WHEN p_size % 7 >= 5 THEN p_type END")).alias("subset"))
    return K.first_metadata(meta)


@register("unpack_chunks", f"""WITH {QUANT} SELECT vec_id, CAST((i - 1) // 16 AS INTEGER) AS chunk, CAST((i - 1) // 16 * 16 AS BIGINT) AS first,
    string_agg(CAST(x AS VARCHAR), ',' ORDER BY i) AS vals
  FROM (SELECT vec_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM vec) e GROUP BY vec_id, (i - 1) // 16""")
def q_unpack_chunks(spark, sf):
    cut = TF.packed_chunks(packed(spark, sf).select("vec_id", "packed"), "packed", chunk_bytes=8)
    return cut.select("vec_id", "chunk", "first", F.array_join(TF.unpack_uint4("packed"), ",").alias("vals"))
