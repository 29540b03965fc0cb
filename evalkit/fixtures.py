"""Derived inputs (FX1-FX14): reference-shaped tables computed from the provided
tables, so Spark and the DuckDB oracle see the same rows. Each is a plain
projection / filter of one table (no shuffle) unless noted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalkit import pools
from evalkit.sources.tables import table

CTX5 = "element_at(array(4096, 8192, 16384, 24576, 32768), cast(pmod({id}, 5) + 1 as int))"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1: one model answer per event, eight answer shapes."""
    ev = table(spark, sf_dir, "events")
    return ev.selectExpr(
        "event_id",
        "event_type",
        "user_id",
        "CASE WHEN pmod(event_id div 2, 2) = 0 THEN 'tool_call' ELSE 'tool_call_hard' END AS test",
        CTX5.format(id="event_id") + " AS context_length",
        "event_type AS expected_tool",
        "'k' AS expected_arg_key",
        "cast(pmod(event_id, 10) as string) AS expected_arg_contains",
        "concat('Call ', event_type, ' for event ', cast(event_id as string)) AS instruction",
        "concat('{\"name\": \"', event_type, '\", \"arguments\": ', props, '}') AS call",
        "value AS elapsed",
    ).selectExpr(
        "*",
        """CASE pmod(event_id div 5, 8)
             WHEN 0 THEN concat('<tool_call>\n', call, '\n</tool_call>')
             WHEN 1 THEN concat('<tool_call>\n', call)
             WHEN 2 THEN concat(call, '\n</tool_call>')
             WHEN 3 THEN call
             WHEN 4 THEN concat('<think>Maybe <tool_call>{\"name\": \"decoy\", \"arguments\": {}}</tool_call> first.</think>\n<tool_call>\n', call, '\n</tool_call>')
             WHEN 5 THEN concat('<tool_call>\n', substring(call, 1, length(call) - 2), '\n</tool_call>')
             WHEN 6 THEN concat('<tool_call>\n{\"name\": \"view\", \"arguments\": ', substring(call, instr(call, '\"arguments\": ') + 13), '\n</tool_call>')
             ELSE concat('I would need more details before acting on event ', cast(event_id as string), '.')
           END AS answer""",
    ).drop("call")


def passkey_sql(id_col: str) -> str:
    """Deterministic six-digit passkey (leading zeros kept)."""
    return (f"lpad(cast(pmod(cast(conv(substring(md5(concat('42:', cast({id_col} as string))), 1, 8), 16, 10)"
            f" as bigint), 1000000) as string), 6, '0')")


def needle_cells(spark: SparkSession, sf_dir: str, depths=None) -> DataFrame:
    """FX2: documents x depths with a passkey and a model answer."""
    depths = depths or pools.QUICK_DEPTHS
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grid = spark.createDataFrame([(float(d),) for d in depths], "depth double")
    cells = docs.crossJoin(F.broadcast(grid))  # literal 3-row side
    return cells.selectExpr(
        "doc_id", "text", "depth",
        CTX5.format(id="doc_id") + " AS context_length",
        passkey_sql("doc_id") + " AS passkey",
    ).selectExpr(
        "*",
        """CASE pmod(doc_id, 4)
             WHEN 0 THEN passkey
             WHEN 1 THEN concat('The secret passkey is ', passkey, '.')
             WHEN 2 THEN concat('I think it is ', lpad(cast(pmod(cast(passkey as int) + 1, 1000000) as string), 6, '0'))
             ELSE 'I could not find a passkey in the text.'
           END AS raw_answer""",
        "doc_id AS seq",
    )


def history_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: the six-step cycle, its texts cut from the first six ``benchmark`` passages to
    the fixed lengths (six rows come to the driver)."""
    rows = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(len(pools.AGENTIC_CYCLE_TOOLS)).collect()
    fit = lambda text, n: (text * (n // max(1, len(text)) + 1))[:n]
    steps = zip(pools.AGENTIC_CYCLE_LENGTHS, pools.AGENTIC_CYCLE_TOOLS, rows)
    return spark.createDataFrame(
        [(i, tool, fit(r.text, u), fit(f'{{"name": "{tool}"}} ' + r.text, a), fit(r.text, n))
         for i, ((u, a, n), tool, r) in enumerate(steps)],
        "step int, tool string, user_text string, call_text string, result_text string")


def history_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: one row: what filler questions are made of, and the paragraph of the answers."""
    first = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1)
    return first.select(F.col("text").alias("topic"), F.col("text").alias("paragraph"))


def history_question(number):
    """The question about a topic number, of the fixed length besides the number."""
    n = pools.HISTORY_QUESTION_CHARS
    return F.concat(F.rpad("topic", n, "."), number.cast("string"))


def calibration_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4 pools (kind, line) from ``benchmark``: user lines, analysis lines, snippets and
    long snippets."""
    b = table(spark, sf_dir, "benchmark")
    kinds = F.array(F.struct(F.lit("user").alias("kind"), F.substring("text", 1, 80).alias("line")),
                    F.struct(F.lit("analysis").alias("kind"), F.substring("text", 1, 60).alias("line")),
                    F.struct(F.when(F.expr("pmod(item_id, 2) = 0"), "snippet").otherwise("long").alias("kind"),
                             F.col("text").alias("line")))
    return b.select(F.explode(kinds).alias("k")).select("k.*")


def calibration_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: final requests and their expected calls, from the event types."""
    return table(spark, sf_dir, "events").select("event_type").distinct().select(
        F.concat(F.lit("Handle "), "event_type").alias("final_request"), F.col("event_type").alias("expected_tool"),
        F.lit("k").alias("arg_key"), F.col("event_type").alias("arg_value"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX15: the conversations with what real message tables hold besides: messages without a
    conversation, without a turn, with the turn of their predecessor, and turns far apart."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "CASE WHEN pmod(conv_id, 13) <> 5 THEN conv_id END AS conv_id",
        """CASE WHEN pmod(conv_id + turn, 17) = 3 THEN NULL WHEN pmod(conv_id, 5) = 2 THEN turn * 1000003
                WHEN pmod(conv_id * 3 + turn, 19) = 4 THEN greatest(turn - 1, 0) ELSE turn END AS turn""",
        "role", "text")


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5: conversations (FX15) with control words typed by the user."""
    return messages(spark, sf_dir).selectExpr(
        "conv_id", "turn", "role",
        """CASE WHEN pmod(conv_id + turn, 7) = 0 THEN 'reset'
                WHEN pmod(conv_id, 10) = 0 AND turn = 4 THEN 'quit'
                WHEN pmod(conv_id + turn, 11) = 0 THEN ''
                ELSE text END AS text""")


def corpus_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6 second frame: the text column is called ``content``."""
    return table(spark, sf_dir, "documents").withColumnRenamed("text", "content")


def tensor_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX7: tensor constants of several models, from ``part``."""
    part = table(spark, sf_dir, "part").filter("pmod(p_partkey, 41) <> 0")
    return part.selectExpr(
        "p_partkey",
        "concat('m', cast(p_partkey div 144 as string)) AS model",
        "cast(pmod(p_partkey, 48) as int) AS layer",
        "element_at(array('weight', 'scale', 'zero_point'), cast(pmod(p_partkey div 48, 3) + 1 as int)) AS component",
        "element_at(array('embed_tokens', 'lm_head', 'self_attn.q_proj', 'mlp.gate', 'mlp.shared_expert.up_proj', 'mlp.experts.down_proj'), cast(pmod(pmod(p_partkey, 48), 6) + 1 as int)) AS part_path",
        "p_size",
    ).selectExpr(
        "cast(p_partkey as string) AS id",
        "model", "layer", "component",
        "concat('self.model.layers.', cast(layer as string), '.', part_path, '.weight', "
        "CASE component WHEN 'scale' THEN '/scale' WHEN 'zero_point' THEN '/zero_point' ELSE '' END) AS name",
        "CASE component WHEN 'scale' THEN 'float16' WHEN 'zero_point' THEN 'uint4' "
        "ELSE element_at(array('uint4', 'uint8', 'float16', 'bfloat16'), cast(pmod(p_size, 4) + 1 as int)) END AS element_type",
        "CASE component WHEN 'weight' THEN concat('128, 16, ', cast(p_size as string)) ELSE '128, 16, 1' END AS shape",
        "p_partkey * 65536 AS offset",
    )


def stat_targets(spark: SparkSession, sf_dir: str, repeated: bool = True) -> DataFrame:
    """FX9: statistics mapping rows (saved_name, original_name, batch); every 50th
    key repeated in the next batch (unless ``repeated`` is off)."""
    part = table(spark, sf_dir, "part")
    base = part.selectExpr(
        "p_partkey",
        "concat('t', cast(p_partkey as string)) AS saved_name",
        "CASE WHEN pmod(p_partkey, 9) = 0 THEN concat('MatMul_', cast(p_partkey as string)) "
        "ELSE concat('self.model.layers.', cast(pmod(p_partkey, 48) as string), "
        "CASE WHEN pmod(p_partkey, 2) = 0 THEN '.mlp.gate/MatMul' ELSE '.self_attn.q_proj/MatMul' END) END AS original_name",
        "cast(pmod(p_partkey, 3) as int) AS batch",
    )
    if not repeated:
        return base
    again = (base.filter("pmod(p_partkey, 50) = 0")
             .selectExpr("p_partkey", "saved_name", "concat(original_name, '#2') AS original_name",
                         "cast(batch + 1 as int) AS batch"))
    return base.unionByName(again)


def stat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX9 files present per batch folder: with suffix, without, longer name, or none."""
    t = stat_targets(spark, sf_dir)
    return t.selectExpr(
        "batch",
        """CASE WHEN pmod(p_partkey, 20) < 8 THEN concat(saved_name, '.safetensors')
                WHEN pmod(p_partkey, 20) < 14 THEN saved_name
                WHEN pmod(p_partkey, 20) < 19 THEN concat(saved_name, '_stats.bin')
           END AS file""").filter("file IS NOT NULL")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX10: up to three fix attempts per case."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 3 AS case_id", "cast(pmod(event_id, 3) + 1 as int) AS attempt",
        "event_type <> 'error' AS has_code", "event_type = 'purchase' AS ok")


def fenced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX11: model replies with and without code fences around whole documents."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text AS body").selectExpr(
        "doc_id",
        """CASE pmod(doc_id, 4)
             WHEN 0 THEN concat('Report first.\n```python\n', body, '\n```\nDone.')
             WHEN 1 THEN concat('Report first.\n```\n', body, '\n```')
             WHEN 2 THEN concat('Report first.\n```python\n', body)
             ELSE body END AS response""")


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX12: error messages of memory probes."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """CASE pmod(event_id, 3)
             WHEN 0 THEN concat('Exception from src/plugin.cpp: Failed to allocate ', cast(cast(value * 1000000000 as bigint) as string), ' bytes of memory')
             WHEN 1 THEN concat('Cannot allocate memory for tensor ', cast(event_id as string))
             ELSE concat('Model compile error at node ', cast(event_id as string)) END AS message""")


def failed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX16: needle and tool-call runs that raised: the events of type ``error``, with the
    messages of FX12."""
    depths = ", ".join(f"cast({d} as double)" for d in pools.QUICK_DEPTHS)
    cells = table(spark, sf_dir, "events").filter("event_type = 'error'").selectExpr(
        "event_id", "event_id AS id", CTX5.format(id="event_id") + " AS context_length",
        f"element_at(array({depths}), cast(pmod(event_id, 3) + 1 as int)) AS depth", passkey_sql("event_id") + " AS passkey",
        "CASE WHEN pmod(event_id div 2, 2) = 0 THEN 'tool_call' ELSE 'tool_call_hard' END AS test",
        "event_type AS expected_tool", "concat('Call ', event_type, ' for event ', cast(event_id as string)) AS instruction")
    return cells.join(job_log(spark, sf_dir), "event_id")


def chat_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX13: chat-completion reply JSON per conversation turn; usage only on even turns."""
    conv = table(spark, sf_dir, "conversations")
    reply = F.to_json(F.struct(
        F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"),
        F.when(F.expr("pmod(turn, 2) = 0"),
               F.struct(F.expr("cast(length(text) div 4 as bigint)").alias("completion_tokens"))).alias("usage")))
    return conv.select("conv_id", "turn", reply.alias("reply"))


def throughput_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX14: generation runs (prompt, tokens, elapsed)."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type AS prompt", "cast(value * 10 as int) AS tokens",
        "CASE WHEN pmod(event_id, 97) = 0 THEN 0.0 ELSE value END AS elapsed")
