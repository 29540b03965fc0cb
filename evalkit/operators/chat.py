"""Chat request/reply data shapes (P17, P18). Sending requests is out of scope:
requests are a table to hand to a serving system; replies come back as a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalkit import schemas
from evalkit.functions import text as T
from evalkit.operators.packing import CHUNK_MESSAGES, join_chunks, message_numbering, pack_to_budget

REPLY_SCHEMA = schemas.CHAT_REPLY


def chat_requests(msgs: DataFrame, model: str, max_tokens: int, temperature: float, budget: int | None = None,
                  key: str = "conv_id", order: str = "turn", chunk_messages: int = CHUNK_MESSAGES) -> DataFrame:
    """One JSON request per conversation with all its messages (or, with ``budget``,
    those that W2 packs). A request comes in parts of ``chunk_messages`` messages: (key,
    chunk from 0, n_msgs, request); the parts put end to end are the request, so no row
    holds more of a conversation than one part."""
    rows = msgs if budget is None else pack_to_budget(msgs, budget, key, order).drop("tokens", "tokens_before")
    num = message_numbering(rows, key, order)
    message = F.to_json(F.struct(F.col("role"), F.col("text").alias("content")), {"ignoreNullFields": "false"})
    tail = F.to_json(F.struct(F.lit(max_tokens).alias("max_tokens"), F.lit(float(temperature)).alias("temperature")))
    head = F.lit('{"model":' + json.dumps(model) + ',"messages":[')
    first, last = F.col("msg_no") == 1, F.col("msg_no") == F.col("n_msgs")
    piece = F.concat(F.when(first, head).otherwise(F.lit(",")), message,
                     F.when(last, F.concat(F.lit("],"), F.substring(tail, 2, 2147483647))).otherwise(F.lit("")))
    return join_chunks(num, piece, key, order, chunk_messages, "request")


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Content of the first choice; completion tokens, else its word count."""
    p = replies.withColumn("_r", F.from_json(reply, REPLY_SCHEMA))
    content = F.try_element_at(F.col("_r.choices"), F.lit(1)).getField("message").getField("content")
    return (p.withColumn("content", content)
            .withColumn("tokens", F.coalesce(F.col("_r.usage.completion_tokens"),
                                             T.word_count("content").cast("long")))
            .drop("_r"))
