"""Queries for sources and sinks (S1-S3, S5-S9). Each writes to a fresh folder
under the shared checkpoint folder and returns the lazy read-back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalkit import fixtures as fx
from evalkit.functions import tensors as TF
from evalkit.operators import packing
from evalkit.queries import register
from evalkit.queries.q_catalog import FX7
from evalkit.queries.q_generators import CALIB_MAX, CALIB_WITH, RENDER_SQL, seeded
from evalkit.queries.q_results import FX3, runs
from evalkit.queries.q_scoring import scored
from evalkit.queries.sqlfx import FX1, SCORED
from evalkit.session import scratch_path
from evalkit.sources import results_io as IO
from evalkit.sources.tables import table


@register("results_json_roundtrip", f"""WITH {FX1}, {SCORED} SELECT event_id, test, context_length, score,
  substring(answer, 1, 200) AS answer_preview, valid_json FROM scored_r""")
def q_results_json(spark, sf):
    path = scratch_path(spark, "results-json")
    cols = ["event_id", "test", "context_length", "score", "answer_preview", "valid_json"]
    IO.write_results_json(scored(spark, sf).select(*cols), path)
    return IO.read_results_json(spark, path, "event_id long, test string, context_length int, score int, "
                                             "answer_preview string, valid_json boolean")


# ---- fixed values -----------------------------------------------------------
SAMPLE_FILE = "sample_%03d.txt"
# -----------------------------------------------------------------------------
NIAH_KEYS = ["test", "context_length", "depth", "passkey", "answer", "correct", "elapsed", "output_tokens"]
NIAH_SCHEMA = ("test string, context_length int, depth double, passkey string, answer string, correct boolean, "
               "elapsed double, output_tokens int")


@register("results_csv_first_row_columns", f"WITH {FX3} SELECT {', '.join(NIAH_KEYS)} FROM runs")
def q_results_csv(spark, sf):
    path = scratch_path(spark, "results-csv")
    IO.write_results_csv(runs(spark, sf), path, first_columns=NIAH_KEYS)
    return IO.read_results_csv(spark, path, NIAH_SCHEMA)


@register("run_identity", f"""WITH {FX3} SELECT model, run_ts, count(*) AS n, CAST(sum(score) AS BIGINT) AS score_sum
  FROM runs GROUP BY model, run_ts""")
def q_run_identity(spark, sf):
    path = scratch_path(spark, "runs")
    r = runs(spark, sf).withColumn("run_file", F.concat(F.lit("benchmark_"), "model", F.lit("_20260101_000000")))
    r.drop("model", "run_ts").write.mode("overwrite").partitionBy("run_file").json(path)
    back = IO.with_run_identity(spark.read.schema("id long, test string, score int").json(path))
    return back.groupBy("model", "run_ts").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum"))


def sample_file(sample: str):
    return F.when(F.col(sample).isNotNull(), F.format_string(SAMPLE_FILE, F.col(sample))).otherwise(F.lit("sample_none.txt"))


@register("prompt_text_dump", f"""WITH {RENDER_SQL},
  r AS (SELECT conv_id, string_agg(piece, '' ORDER BY msg_no) AS rendered FROM pieces GROUP BY conv_id)
  SELECT coalesce(printf('sample_%03d.txt', conv_id), 'sample_none.txt') AS file, CAST(length(rendered) AS BIGINT) AS n_chars, md5(rendered) AS text_md5 FROM r""")
def q_prompt_text_dump(spark, sf):
    r = packing.render_messages(fx.messages(spark, sf)).withColumn("file", sample_file("conv_id"))
    path = scratch_path(spark, "prompts")
    index = IO.write_named_files(r, path, "file", "rendered", order=["chunk"])
    back = IO.read_whole_files(spark, path).select("file", F.md5("value").alias("text_md5"))
    return index.select("file", "n_chars").join(back, "file")


@register("prompt_manifest", CALIB_WITH + f"""
  SELECT sample, printf('sample_%03d.txt', sample) AS file, least(pre_len, {CALIB_MAX}) AS token_len,
    CAST(num_exchanges AS INTEGER) AS num_exchanges, final_request, expected_tool AS expected_name,
    '{{"k":"' || expected_tool || '"}}' AS expected_args, CAST(length(text) AS BIGINT) AS char_len, md5(text) AS file_md5
  FROM rt""")
def q_prompt_manifest(spark, sf):
    s = seeded(spark, sf).withColumn("file", sample_file("sample"))
    files, path = scratch_path(spark, "samples"), scratch_path(spark, "manifest")
    IO.write_named_files(s, files, "file", "text")
    IO.write_manifest(s.select(
        F.col("sample").cast("long").alias("sample"), "file", "token_len", "num_exchanges", "final_request",
        F.from_json("expected_tool_call", "name string, arguments map<string,string>").alias("expected_tool_call"),
        F.length("text").cast("long").alias("char_len")), path)
    back = IO.read_whole_files(spark, files).select("file", F.md5("value").alias("file_md5"))
    return IO.read_manifest(spark, path).join(back, "file").select(
        "sample", "file", "token_len", "num_exchanges", "final_request",
        F.col("expected_tool_call.name").alias("expected_name"),
        F.to_json("expected_tool_call.arguments").alias("expected_args"), "char_len", "file_md5")


@register("whole_file_scan", """SELECT 'page-' || CAST(page_id AS VARCHAR) || '.html' AS file, CAST(length(html) AS BIGINT) AS n_chars,
  md5(html) AS html_md5 FROM pages""")
def q_whole_file_scan(spark, sf):
    path = scratch_path(spark, "pages")
    named = table(spark, sf, "pages").withColumn("file", F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")))
    index = IO.write_named_files(named, path, "file", "html").select("file")
    back = index.join(IO.read_whole_files(spark, path), "file", "left").select("file", F.coalesce("value", F.lit("")).alias("value"))
    return back.select("file", F.length("value").cast("long").alias("n_chars"), F.md5("value").alias("html_md5"))


@register("tensor_catalog", f"""WITH {FX7} SELECT id, name, 'Const' AS type, element_type, shape, "offset", size,
  CASE WHEN contains(name, '/zero_point') THEN 'zero_point' WHEN contains(name, '/scale') THEN 'scale' ELSE 'weight' END AS component_class,
  coalesce(TRY_CAST(nullif(regexp_extract(name, 'layers[._](\\d+)', 1), '') AS INTEGER), -1) AS layer FROM fx7b""")
def q_tensor_catalog(spark, sf):
    cat = fx.tensor_catalog(spark, sf).withColumn("size", TF.tensor_bytes("shape", "element_type"))
    path = scratch_path(spark, "catalog-xml")
    IO.write_catalog_xml(cat, path)
    back = IO.read_catalog_xml(spark, path)
    return back.select("id", "name", "type", "element_type", "shape", "offset", "size",
                       TF.component_class("name").alias("component_class"), TF.layer_number("name").alias("layer"))


@register("idempotent_write", "SELECT conv_id, turn, role FROM conversations")
def q_idempotent_write(spark, sf):
    path = scratch_path(spark, "once")
    first = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    IO.write_once(first, path)
    second = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"),
                                                  F.col("lang").alias("role"))
    IO.write_once(second, path)  # skipped: the output exists and force is off
    return spark.read.parquet(path)
