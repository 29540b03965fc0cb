"""Queries for response scoring and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalkit import fixtures as fx
from evalkit.functions import text as T
from evalkit.functions.scoring import score_status as status_col
from evalkit.functions.scoring import score_tool_calls
from evalkit.operators import chat, packing, summaries
from evalkit.queries import register
from evalkit.queries.sqlfx import FX1, FX15, MESSAGE_ORDER, NL, SCORED, clean_sql, strip_sql, words_sql
from evalkit.queries.util import rounded
from evalkit.sources.tables import table


def scored(spark, sf):
    return summaries.score_responses(fx.responses(spark, sf))


def _scored_work(spark, sf):
    r = fx.responses(spark, sf)
    return score_tool_calls(r, "answer", "expected_tool", "expected_arg_key",
                            "expected_arg_contains", keep_work=True)


W = f"WITH {FX1}, {SCORED} "


@register("strip_thinking", W + "SELECT event_id, clean FROM sc_a")
def q_strip_thinking(spark, sf):
    return fx.responses(spark, sf).select("event_id", T.strip_thinking("answer").alias("clean"))


@register("tool_call_body", W + "SELECT event_id, body FROM sc_b")
def q_tool_call_body(spark, sf):
    return _scored_work(spark, sf).select("event_id", F.col("_sc_body").alias("body"))


@register("strict_json_flag", W + "SELECT event_id, valid_json FROM scored_r")
def q_strict_json(spark, sf):
    return scored(spark, sf).select("event_id", "valid_json")


@register("tool_name_match", W + "SELECT event_id, correct_tool FROM scored_r")
def q_tool_name(spark, sf):
    return scored(spark, sf).select("event_id", "correct_tool")


@register("arg_key_present", W + "SELECT event_id, correct_arg_key FROM scored_r")
def q_arg_key(spark, sf):
    return scored(spark, sf).select("event_id", "correct_arg_key")


@register("arg_value_contains", W + "SELECT event_id, correct_arg_value FROM scored_r")
def q_arg_value(spark, sf):
    return scored(spark, sf).select("event_id", "correct_arg_value")


@register("tool_call_score", W + """SELECT event_id, has_tool_call_tags, valid_json, correct_tool,
  correct_arg_key, correct_arg_value, score, error FROM scored_r""")
def q_tool_call_score(spark, sf):
    return scored(spark, sf).select("event_id", "has_tool_call_tags", "valid_json", "correct_tool",
                                    "correct_arg_key", "correct_arg_value", "score", "error")


@register("score_status", W + """SELECT event_id, score,
  CASE WHEN score = 5 THEN 'PERFECT' WHEN score >= 3 THEN 'PARTIAL (' || score || '/5)'
       ELSE 'FAIL (' || score || '/5)' END AS status FROM scored_r""")
def q_score_status(spark, sf):
    return scored(spark, sf).select("event_id", "score", status_col("score").alias("status"))


@register("tool_call_summary", W + """SELECT test, context_length, count(*) AS n,
  round(avg(score), 6) AS avg_score, count(*) FILTER (WHERE score = 5) AS perfect,
  count(*) FILTER (WHERE has_tool_call_tags) AS has_tags, count(*) FILTER (WHERE valid_json) AS valid_json,
  count(*) FILTER (WHERE correct_tool) AS right_tool, CAST(context_length // 1024 AS VARCHAR) || 'K' AS label
  FROM scored_r GROUP BY test, context_length""")
def q_tool_call_summary(spark, sf):
    return rounded(summaries.tool_call_summary(scored(spark, sf)))


@register("expect_response_join", W + """SELECT event_id, event_type AS case_id, expected_tool,
  expected_arg_key, score FROM scored_r""")
def q_expect_response_join(spark, sf):
    r = fx.responses(spark, sf).select("event_id", F.col("event_type").alias("case_id"),
                                       "answer", "expected_arg_contains")
    cases = (r.select("case_id").distinct()
             .select("case_id", F.col("case_id").alias("expected_tool"), F.lit("k").alias("expected_arg_key")))
    joined = summaries.attach_cases(r, cases, "case_id")
    out = score_tool_calls(joined, "answer", "expected_tool", "expected_arg_key", "expected_arg_contains")
    return out.select("event_id", "case_id", "expected_tool", "expected_arg_key", "score")


@register("token_estimates", f"""WITH {FX1} SELECT event_id, length(answer) // 4 AS chars_div4,
  {words_sql('answer')} AS words, CAST(floor({words_sql('answer')} / 0.75) AS BIGINT) AS word_tokens FROM fx1""")
def q_token_estimates(spark, sf):
    r = fx.responses(spark, sf).withColumn("words", T.word_count("answer").cast("int"))
    return r.select("event_id", T.chars_div4("answer").alias("chars_div4"), "words",
                    T.words_to_tokens("words").alias("word_tokens"))


@register("text_preview", """SELECT doc_id, substring(text, 1, 200) AS preview_200,
  CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS preview_500
  FROM documents""")
def q_text_preview(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.preview("text", 200).alias("preview_200"),
                    T.preview_ellipsis("text", 500).alias("preview_500"))


FX14 = """fx14 AS (SELECT event_id, event_type AS prompt, CAST(trunc(value * 10) AS INTEGER) AS tokens,
  CASE WHEN event_id % 97 = 0 THEN 0.0 ELSE value END AS elapsed FROM events)"""


@register("latency_columns", f"""WITH {FX14} SELECT event_id, round(elapsed, 2) AS elapsed_2dp,
  round(CASE WHEN elapsed > 0 THEN tokens / elapsed ELSE 0.0 END, 6) AS throughput FROM fx14""")
def q_latency(spark, sf):
    r = fx.throughput_runs(spark, sf)
    return rounded(r.select("event_id", T.round2("elapsed").alias("elapsed_2dp"),
                            T.throughput("tokens", "elapsed").alias("throughput")))


FX12 = f"""fx12 AS (SELECT event_id, CASE event_id % 3
  WHEN 0 THEN 'Exception from src/plugin.cpp: Failed to allocate ' || CAST(CAST(trunc(value * 1000000000) AS BIGINT) AS VARCHAR) || ' bytes of memory'
  WHEN 1 THEN 'Cannot allocate memory for tensor ' || CAST(event_id AS VARCHAR)
  ELSE 'Model compile error at node ' || CAST(event_id AS VARCHAR) END AS message FROM events)"""


@register("alloc_failure_parse", f"""WITH {FX12}, p AS (SELECT event_id, message,
  CASE WHEN contains(message, 'allocate') THEN TRY_CAST(nullif(regexp_extract(message, 'allocate (\\p{{Nd}}+) bytes', 1), '') AS BIGINT) END AS nb
  FROM fx12)
  SELECT event_id, CASE WHEN contains(message, 'allocate') THEN 'OOM' ELSE 'FAILED' END AS kind,
  nb AS alloc_bytes, round(nb / 1073741824.0, 6) AS alloc_gib,
  CASE WHEN nb IS NULL THEN substring(message, 1, 300) END AS detail FROM p""")
def q_alloc_failure(spark, sf):
    log = fx.job_log(spark, sf).withColumn("t", T.alloc_failure("message"))
    return rounded(log.select("event_id", "t.kind", "t.alloc_bytes", "t.alloc_gib", "t.detail"))


FX2 = f"""fx2 AS (SELECT doc_id, text, depth, [4096, 8192, 16384, 24576, 32768][doc_id % 5 + 1] AS context_length,
    passkey, CASE doc_id % 4 WHEN 0 THEN passkey
      WHEN 1 THEN 'The secret passkey is ' || passkey || '.'
      WHEN 2 THEN 'I think it is ' || lpad(CAST((CAST(passkey AS INTEGER) + 1) % 1000000 AS VARCHAR), 6, '0')
      ELSE 'I could not find a passkey in the text.' END AS raw_answer, doc_id AS seq
  FROM (SELECT doc_id, text, lpad(CAST(CAST(('0x' || substring(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000000 AS VARCHAR), 6, '0') AS passkey
        FROM documents) d, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) g(depth)),
niah AS (SELECT *, coalesce(nullif(regexp_extract(c, '\\p{{Nd}}{{6}}', 0), ''), substring(c, 1, 20)) AS answer,
    coalesce(contains(c, passkey), false) AS correct, {words_sql('raw_answer')} AS output_tokens
  FROM (SELECT *, {clean_sql(strip_sql('raw_answer'))} AS c FROM fx2) x)"""


def niah(spark, sf):
    return summaries.score_niah(fx.needle_cells(spark, sf))


@register("passkey_extract", f"WITH {FX2} SELECT doc_id, depth, passkey, answer FROM niah")
def q_passkey_extract(spark, sf):
    return niah(spark, sf).select("doc_id", "depth", "passkey", "answer")


@register("passkey_correct", f"WITH {FX2} SELECT doc_id, depth, correct FROM niah")
def q_passkey_correct(spark, sf):
    return niah(spark, sf).select("doc_id", "depth", "correct")


FX11 = f"""fx11 AS (SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN 'Report first.' || {NL} || '```python' || {NL} || body || {NL} || '```' || {NL} || 'Done.'
    WHEN 1 THEN 'Report first.' || {NL} || '```' || {NL} || body || {NL} || '```'
    WHEN 2 THEN 'Report first.' || {NL} || '```python' || {NL} || body
    ELSE body END AS response FROM (SELECT doc_id, text AS body FROM documents) d)"""


@register("code_block", f"""WITH {FX11} SELECT doc_id, nullif({strip_sql('''CASE WHEN contains(response, '```python')
    THEN split_part(split_part(response, '```python', 2), '```', 1)
    WHEN contains(response, '```') THEN split_part(split_part(response, '```', 2), '```', 1) END''')}, '') AS code FROM fx11""")
def q_code_block(spark, sf):
    return fx.fenced_texts(spark, sf).select("doc_id", T.code_block("response").alias("code"))


@register("report_before_fence", f"""WITH {FX11} SELECT doc_id, CASE WHEN contains(response, '```')
    THEN {strip_sql("split_part(response, '```', 1)")} ELSE response END AS report FROM fx11""")
def q_report_before_fence(spark, sf):
    return fx.fenced_texts(spark, sf).select("doc_id", T.report_before_fence("response").alias("report"))


@register("chat_request_json", f"""WITH {FX15}, num AS (SELECT conv_id, role, text,
    row_number() OVER ({MESSAGE_ORDER}) AS msg_no, count(*) OVER (PARTITION BY conv_id) AS n FROM fx15),
  p AS (SELECT conv_id, msg_no, (msg_no - 1) // {packing.CHUNK_MESSAGES} AS chunk,
    CASE WHEN msg_no = 1 THEN '{{"model":"local-model","messages":[' ELSE ',' END
    || json_object('role', role, 'content', text)::VARCHAR
    || CASE WHEN msg_no = n THEN '],"max_tokens":256,"temperature":0.5}}' ELSE '' END AS piece FROM num)
  SELECT conv_id, chunk, count(*) AS n_msgs, md5(string_agg(piece, '' ORDER BY msg_no)) AS request_md5 FROM p GROUP BY conv_id, chunk""")
def q_chat_request(spark, sf):
    req = chat.chat_requests(fx.messages(spark, sf), model="local-model", max_tokens=256, temperature=0.5)
    return req.select("conv_id", "chunk", "n_msgs", F.md5("request").alias("request_md5"))


@register("chat_reply_parse", """WITH r AS (SELECT conv_id, turn,
    json_object('choices', [json_object('message', json_object('content', text))],
                'usage', CASE WHEN turn % 2 = 0 THEN json_object('completion_tokens', length(text) // 4) END)::VARCHAR AS reply
  FROM conversations)
  SELECT conv_id, turn, json_extract_string(reply, '$.choices[0].message.content') AS content,
    coalesce(CAST(json_extract(reply, '$.usage.completion_tokens') AS BIGINT),
             CAST(""" + words_sql("json_extract_string(reply, '$.choices[0].message.content')") + """ AS BIGINT)) AS tokens
  FROM r""")
def q_chat_reply(spark, sf):
    return chat.parse_replies(fx.chat_replies(spark, sf)).select("conv_id", "turn", "content", "tokens")
