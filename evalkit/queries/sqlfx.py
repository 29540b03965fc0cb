"""DuckDB text of the derived inputs (FX1-FX14) and shared oracle fragments.

These mirror ``evalkit.fixtures`` expression by expression; only integer
division, casts, newline literals and list indexing are spelled differently."""

from evalkit.functions.scoring import TOOL_CALL_PATTERNS
from evalkit.functions.text import PY_WS

NL = "chr(10)"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\A{PY_WS}+|{PY_WS}+\\z', '', 'g')"


def clean_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '(?s)<think>.*?</think>', '', 'g')")


def body_sql(c: str) -> str:
    parts = " ".join(f"WHEN regexp_matches({c}, '{p}') THEN regexp_extract({c}, '{p}', 1)"
                     for p in TOOL_CALL_PATTERNS)
    return f"CASE {parts} END"


def words_sql(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({x}, '{PY_WS}+'), lambda w: w <> '')) AS INTEGER)"


# FX15, with what orders messages of one turn
FX15 = """fx15 AS (SELECT *, md5(coalesce(role, '') || ':' || coalesce(text, '')) AS tie FROM (
  SELECT CASE WHEN conv_id % 13 <> 5 THEN conv_id END AS conv_id,
    CASE WHEN (conv_id + turn) % 17 = 3 THEN NULL WHEN conv_id % 5 = 2 THEN turn * 1000003
         WHEN (conv_id * 3 + turn) % 19 = 4 THEN greatest(turn - 1, 0) ELSE turn END AS turn, role, text FROM conversations) m)"""
MESSAGE_ORDER = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie"

CTX5 = "[4096, 8192, 16384, 24576, 32768][{id} % 5 + 1]"

FX1 = f"""fx1 AS (
  SELECT event_id, event_type, user_id,
    CASE WHEN (event_id // 2) % 2 = 0 THEN 'tool_call' ELSE 'tool_call_hard' END AS test,
    {CTX5.format(id='event_id')} AS context_length,
    event_type AS expected_tool, 'k' AS expected_arg_key,
    CAST(event_id % 10 AS VARCHAR) AS expected_arg_contains,
    'Call ' || event_type || ' for event ' || CAST(event_id AS VARCHAR) AS instruction,
    value AS elapsed,
    CASE (event_id // 5) % 8
      WHEN 0 THEN '<tool_call>' || {NL} || call || {NL} || '</tool_call>'
      WHEN 1 THEN '<tool_call>' || {NL} || call
      WHEN 2 THEN call || {NL} || '</tool_call>'
      WHEN 3 THEN call
      WHEN 4 THEN '<think>Maybe <tool_call>{{"name": "decoy", "arguments": {{}}}}</tool_call> first.</think>' || {NL} || '<tool_call>' || {NL} || call || {NL} || '</tool_call>'
      WHEN 5 THEN '<tool_call>' || {NL} || substring(call, 1, length(call) - 2) || {NL} || '</tool_call>'
      WHEN 6 THEN '<tool_call>' || {NL} || '{{"name": "view", "arguments": ' || substring(call, strpos(call, '"arguments": ') + 13) || {NL} || '</tool_call>'
      ELSE 'I would need more details before acting on event ' || CAST(event_id AS VARCHAR) || '.'
    END AS answer
  FROM (SELECT *, '{{"name": "' || event_type || '", "arguments": ' || props || '}}' AS call FROM events) e
)"""

# Scoring of FX1 answers. FX1 arguments are always JSON objects, so the
# TypeError branches of the scorer never fire here (they are unit-tested).
SCORED = f"""sc_a AS (SELECT *, {clean_sql('answer')} AS clean FROM fx1),
sc_b AS (SELECT *, {body_sql('clean')} AS body FROM sc_a),
sc_c AS (SELECT *, {strip_sql('body')} AS sbody FROM sc_b),
sc_d AS (SELECT *, body IS NOT NULL AS tags,
           coalesce(body IS NOT NULL AND json_valid(sbody), false) AS vj FROM sc_c),
sc_e AS (SELECT *,
           CASE WHEN vj AND starts_with(sbody, '{{') THEN true ELSE false END AS isobj,
           CASE WHEN vj AND starts_with(sbody, '{{') THEN json_extract_string(sbody, '$.name') END AS pname,
           CASE WHEN vj AND starts_with(sbody, '{{') THEN json_type(sbody, '$.arguments') END AS atype,
           CASE WHEN vj AND starts_with(sbody, '{{') THEN json_keys(json_extract(sbody, '$.arguments')) END AS akeys,
           CASE WHEN vj AND starts_with(sbody, '{{') AND json_type(sbody, '$.arguments') = 'OBJECT'
                THEN json_extract(sbody, '$.arguments') END AS ajson
         FROM sc_d),
scored AS (
  SELECT *, tags AS has_tool_call_tags, vj AS valid_json,
    coalesce(isobj AND pname = expected_tool, false) AS correct_tool,
    coalesce(atype = 'OBJECT' AND list_contains(akeys, expected_arg_key), false) AS correct_arg_key,
    coalesce(atype = 'OBJECT' AND list_contains(akeys, expected_arg_key)
      AND contains(lower(coalesce(json_extract_string(ajson, '$.' || expected_arg_key), 'None')),
                   lower(expected_arg_contains)), false) AS correct_arg_value,
    CAST(NULL AS VARCHAR) AS error
  FROM sc_e),
scored_r AS (
  SELECT *, CAST(has_tool_call_tags::INT + valid_json::INT + correct_tool::INT + correct_arg_key::INT
              + correct_arg_value::INT AS INTEGER) AS score
  FROM scored)"""
