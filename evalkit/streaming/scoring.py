"""Score model responses as they land in a folder.

Responses arrive as JSON lines (event_id, test, context_length, expected_tool,
expected_arg_key, expected_arg_contains, answer). Scoring is a narrow projection
(no state); the optional summary keeps one aggregate row per (test, context)
in the state store. Checkpoints go under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from evalkit.operators.summaries import score_responses, tool_call_summary
from evalkit.session import scratch_path

RESPONSE_SCHEMA = ("event_id long, test string, context_length int, expected_tool string, "
                   "expected_arg_key string, expected_arg_contains string, answer string")


def response_stream(spark: SparkSession, source: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.schema(RESPONSE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .json(source))


def start_scoring(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None,
                  available_now: bool = False) -> StreamingQuery:
    """Append scored rows to ``sink`` (parquet)."""
    scored = score_responses(response_stream(spark, source))
    w = (scored.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-scoring-ckpt")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink)


def start_summary(spark: SparkSession, source: str, table_name: str, checkpoint: str | None = None,
                  available_now: bool = False) -> StreamingQuery:
    """Keep the per-context tool-call summary (A3) up to date in a memory table
    (complete mode; state is one row per (test, context_length))."""
    summary = tool_call_summary(score_responses(response_stream(spark, source)))
    w = (summary.writeStream.format("memory").queryName(table_name).outputMode("complete")
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-summary-ckpt")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
