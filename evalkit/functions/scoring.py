"""Tool-call extraction and 0-5 scoring (P2-P8) as Spark Columns.

Semantics follow the reference scorer:

* body: four patterns tried in order (closed tags; opening tag to the end;
  object before a closing tag; trailing object starting with ``"name"``);
  any match earns the *tags* point;
* strict JSON of the stripped body earns the *json* point;
* a JSON object payload may then earn *tool* (name equals expected), *key*
  (expected key in ``arguments``) and *value* (case-insensitive substring of the
  stringified value, only when the key is present);
* ``arguments`` that are null, a number or a boolean, or a string/list that
  contains the key, raise TypeError in the reference: the row becomes an error
  row (score 0, check columns NULL, ``error`` set);
* a payload that is not an object keeps score 2.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalkit.functions.text import JAVA_WS, PY_WS, PY_WS_CHARS, py_strip, strip_thinking


# ---- fixed values -----------------------------------------------------------
def tool_call_patterns(ws: str, flags: str) -> tuple[str, ...]:
    """The four body patterns with a whitespace class ``ws`` and inline flags."""
    return (
        rf"(?{flags})<tool_call>{ws}*(.*?){ws}*</tool_call>",
        rf"(?{flags})<tool_call>{ws}*(.*?)\z",
        rf"(?{flags})(\{{.*?\}}){ws}*</tool_call>",
        rf"(?{flags})(\{{\"name\"{ws}*:.*?\}}){ws}*\z",
    )


# portable spelling (also used by the DuckDB oracle) and the fast Java one
TOOL_CALL_PATTERNS = tool_call_patterns(PY_WS, "s")
JAVA_TOOL_CALL_PATTERNS = tool_call_patterns(JAVA_WS, "sU")
STRICT_JSON = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false",
               "allowComments": "false", "allowNumericLeadingZeros": "false",
               "allowBackslashEscapingAnyCharacter": "false",
               "allowUnquotedControlChars": "false", "mode": "PERMISSIVE"}
TYPE_ERROR_NOT_ITERABLE = "argument of type '{}' is not iterable"
TYPE_ERROR_STRING_INDEX = "string indices must be integers, not 'str'"
TYPE_ERROR_LIST_INDEX = "list indices must be integers or slices, not str"
PERFECT, PARTIAL, FAIL = "PERFECT", "PARTIAL", "FAIL"
# -----------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


OPEN_TAG, CLOSE_TAG = "<tool_call>", "</tool_call>"
# array wrapper end marker for the strict JSON check
SENTINEL = "__evalkit_end_7f3a__"


def tool_call_body(clean: Column | str) -> Column:
    """The extracted call text (NULL when no pattern matches).

    Patterns 1 and 2 match exactly when an opening tag is followed by a closing
    tag (1) or when there is an opening tag at all (2), so those tests are plain
    string searches; pattern 2's group is the rest after the tag, left-stripped.
    Patterns 3 and 4 run as regexes only on rows without an opening tag."""
    c = _c(clean)
    open_at = F.locate(OPEN_TAG, c)
    has_open = open_at > 0
    closes = F.call_function("locate", F.lit(CLOSE_TAG), c, open_at + len(OPEN_TAG)) > 0
    p1, p2, p3, p4 = JAVA_TOOL_CALL_PATTERNS
    rest = F.substring(c, open_at + len(OPEN_TAG), F.lit(2147483647))
    return (F.when(has_open & closes, F.regexp_extract(c, p1, 1))
            .when(has_open, F.ltrim(rest, F.lit(PY_WS_CHARS)))
            .when(F.contains(c, F.lit(CLOSE_TAG)) & c.rlike(p3), F.regexp_extract(c, p3, 1))
            .when(F.contains(c, F.lit('{"name"')) & c.rlike(p4), F.regexp_extract(c, p4, 1)))


def _wrapped(stripped: Column) -> Column:
    """Parse ``[body, "<sentinel>"]`` as an array of variants. Spark's JSON reader
    stops after the first value, so the sentinel is only seen as the second
    element when the body is exactly one JSON value (a body that closes early,
    carries extra values or injects keys gives another size or no parse)."""
    return F.from_json(F.concat(F.lit("["), stripped, F.lit(f'\n,"{SENTINEL}"]')), "array<variant>", STRICT_JSON)


def _wrapped_ok(w: Column) -> Column:
    return F.coalesce((F.size(w) == 2)
                      & (F.try_variant_get(F.try_element_at(w, F.lit(2)), "$", "string") == SENTINEL), F.lit(False))


def strict_json_flag(body: Column | str) -> Column:
    """The whole (stripped) text is exactly one JSON value (Python ``json.loads``:
    strict quoting, no control characters in strings, NaN allowed)."""
    return _wrapped_ok(_wrapped(py_strip(_c(body))))


def python_float(text: Column) -> Column:
    """The shortest decimal form of a double as Python prints it, from Spark's spelling
    (``1.23E8``): plain digits for exponents from -4 to 15, else ``d.dde+XX``."""
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_extract(text, r"^-?([0-9]+(?:\.[0-9]+)?)", 1)
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    exp = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    digits = F.concat(whole, part)  # a value of digits * 10 ** (exp - length(part))
    sig = F.coalesce(F.nullif(F.regexp_extract(digits, "^0*(.*?)0*$", 1), F.lit("")), F.lit("0"))
    lead = F.length(F.regexp_extract(digits, "^(0*)", 1))
    point = F.length(whole) + exp - lead  # digits before the decimal point
    n = F.length(sig)
    plain = (F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), sig))
             .when(point >= n, F.concat(sig, F.repeat(F.lit("0"), point - n), F.lit(".0")))
             .otherwise(F.concat(F.substring(sig, F.lit(1), point), F.lit("."), F.substring(sig, point + 1, n))))
    shown = F.concat(F.when(point - 1 < 0, F.lit("-")).otherwise(F.lit("+")),
                     F.lpad(F.abs(point - 1).cast("string"), 2, "0"))
    tail = F.when(n > 1, F.concat(F.lit("."), F.substring(sig, F.lit(2), n))).otherwise(F.lit(""))
    scientific = F.concat(F.substring(sig, 1, 1), tail, F.lit("e"), shown)
    return (F.when(text.isin("NaN", "Infinity", "-Infinity"),
                   F.element_at(F.create_map(F.lit("NaN"), F.lit("nan"), F.lit("Infinity"), F.lit("inf"),
                                             F.lit("-Infinity"), F.lit("-inf")), text))
            .when(sig == "0", F.concat(sign, F.lit("0.0")))
            .otherwise(F.concat(sign, F.when((point > -4) & (point <= 16), plain).otherwise(scientific))))


def python_number(raw: Column) -> Column:
    """``str`` of a JSON number: its spelling decides its kind, as in Python (an integer of
    any length stays as it is, a point or an exponent makes a float)."""
    return F.when(raw.rlike(r"^-?[0-9]+$"), raw).otherwise(python_float(raw.try_cast("double").cast("string")))


def python_repr(raw: Column) -> Column:
    """``str`` of a JSON list or object, from its compact text: tokens are spelled as Python
    spells them and put together again, whatever the nesting."""
    tokens = F.regexp_extract_all(raw, F.lit(r'"(?:[^"\\\\]|\\\\.)*"|[-+0-9.eE]+|NaN|-?Infinity|true|false|null|[\[\]{},:]'), F.lit(0))
    names = {"true": "True", "false": "False", "null": "None", ",": ", ", ":": ": ", "NaN": "nan", "Infinity": "inf",
             "-Infinity": "-inf"}

    def spell(t: Column) -> Column:
        text = F.try_variant_get(F.try_parse_json(t), "$", "string")
        for char, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(char), F.lit(escape))
        double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
        quoted = F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))
        out = F.when(t.startswith('"'), quoted).when(t.rlike(r"^-?[0-9]"), python_number(t))
        for name, shown in names.items():
            out = out.when(t == name, F.lit(shown))
        return out.otherwise(t)

    return F.array_join(F.transform(tokens, spell), "")


#: Kinds of variants whose Python text is found without the JSON text.
PLAIN_KINDS = ("STRING", "BOOLEAN", "VOID", "BIGINT")


def python_str(v: Column, kind: Column, raw: Column, double: Column) -> Column:
    """``str(value)`` of a JSON value held as a variant: strings as is, None, True/False,
    integers of any length, floats, lists and objects as Python prints them. ``kind`` is
    the variant's schema, ``raw`` the value's JSON text and ``double`` Spark's text of it as
    a double (both needed for other kinds than the plain ones only)."""
    return (F.when(v.isNull() | (kind == "VOID"), F.lit("None"))
            .when(kind.isin("STRING", "BIGINT"), F.try_variant_get(v, "$", "string"))
            .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
            .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), python_repr(raw))
            .when(raw.rlike(r"^-?[0-9]+$"), raw)
            .otherwise(python_float(double)))


def arguments_kind(args: Column) -> Column:
    """JSON kind of the ``arguments`` variant: missing/null/object/array/string/bool/int/float."""
    t = F.schema_of_variant(args)
    return (F.when(args.isNull(), F.lit("missing"))
            .when(t == "VOID", F.lit("null"))
            .when(t.startswith("OBJECT"), F.lit("object"))
            .when(t.startswith("ARRAY"), F.lit("array"))
            .when(t == "STRING", F.lit("string"))
            .when(t == "BOOLEAN", F.lit("bool"))
            .when(t.isin("DOUBLE", "FLOAT") | t.startswith("DECIMAL"), F.lit("float"))
            .otherwise(F.lit("int")))


def _stage_columns(answer: Column, tool: Column, key: Column, needle: Column) -> list[list[Column]]:
    """Column expressions of each scoring step (each list is one projection)."""
    stages: list[list[Column]] = [
        [strip_thinking(answer).alias("_sc_clean")],
        [tool_call_body("_sc_clean").alias("_sc_body")],
        [py_strip("_sc_body").alias("_sc_sb")],
        [F.when(F.col("_sc_sb").isNotNull(), _wrapped(F.col("_sc_sb"))).alias("_sc_w")],
        [_wrapped_ok(F.col("_sc_w")).alias("_sc_json")],
        [(F.col("_sc_json") & F.col("_sc_sb").startswith("{")).alias("_sc_obj")],
    ]
    x = F.try_element_at(F.col("_sc_w"), F.lit(1))
    name_v = F.try_variant_get(x, "$.name", "variant")
    stages.append([F.when(F.col("_sc_obj") & (F.schema_of_variant(name_v) == "STRING"),
                          F.try_variant_get(name_v, "$", "string")).alias("_sc_name"),
                   F.when(F.col("_sc_obj"), F.try_variant_get(x, "$.arguments", "variant")).alias("_sc_args")])
    args = F.col("_sc_args")
    stages.append([F.when(F.col("_sc_obj"), arguments_kind(args)).alias("_sc_kind"),
                   F.try_variant_get(args, "$", "map<string,variant>").alias("_sc_map")])
    kind, amap = F.col("_sc_kind"), F.col("_sc_map")
    arr_has = F.exists(F.try_variant_get(args, "$", "array<variant>"),
                       lambda v: (F.schema_of_variant(v) == "STRING")
                       & (F.try_variant_get(v, "$", "string") == key))
    str_has = F.contains(F.try_variant_get(args, "$", "string"), key)
    stages.append([F.when(kind == "object", F.map_contains_key(amap, key))
                   .when(kind == "array", arr_has)
                   .when(kind == "string", str_has)
                   .when(kind == "missing", F.lit(False)).alias("_sc_has")])
    has = F.coalesce(F.col("_sc_has"), F.lit(False))
    py_type = (F.when(kind == "null", F.lit("NoneType")).when(kind == "bool", F.lit("bool"))
               .when(kind == "int", F.lit("int")).when(kind == "float", F.lit("float")))
    err = (F.when(kind.isin("null", "bool", "int", "float"),
                  F.format_string(TYPE_ERROR_NOT_ITERABLE.replace("{}", "%s"), py_type))
           .when((kind == "string") & has, F.lit(TYPE_ERROR_STRING_INDEX))
           .when((kind == "array") & has, F.lit(TYPE_ERROR_LIST_INDEX)))
    obj = F.coalesce(F.col("_sc_obj"), F.lit(False))
    key_ok = obj & F.coalesce(kind == "object", F.lit(False)) & has
    # the value, its kind, its text as written (parsed again only where the kind needs it),
    # and that text as a double: a projection each, so nothing is computed twice
    stages.append([F.element_at(amap, key).alias("_sc_value"), err.alias("_sc_error"),
                   key_ok.alias("_sc_key_ok")])
    stages.append([F.schema_of_variant(F.col("_sc_value")).alias("_sc_type")])
    texts = F.from_json(F.col("_sc_sb"), "struct<arguments: map<string, string>>", STRICT_JSON)["arguments"]
    stages.append([F.when(~F.col("_sc_type").isin(*PLAIN_KINDS), F.element_at(texts, key)).alias("_sc_raw")])
    stages.append([F.col("_sc_raw").try_cast("double").cast("string").alias("_sc_double")])
    value = python_str(F.col("_sc_value"), F.col("_sc_type"), F.col("_sc_raw"), F.col("_sc_double"))
    key_ok, err = F.col("_sc_key_ok"), F.col("_sc_error")
    checks = {
        "has_tool_call_tags": F.col("_sc_body").isNotNull(),
        "valid_json": F.col("_sc_json"),
        "correct_tool": obj & F.coalesce(F.col("_sc_name") == tool, F.lit(False)),
        "correct_arg_key": key_ok,
        "correct_arg_value": key_ok & F.coalesce(F.contains(F.lower(value), F.lower(needle)), F.lit(False)),
    }
    stages.append([err.alias("error"), *[c.alias(f"_sc_{n}") for n, c in checks.items()]])
    ok = F.col("error").isNull()
    pts = sum(F.col(f"_sc_{n}").cast("int") for n in checks)
    final = [F.when(ok, F.col(f"_sc_{n}")).alias(n) for n in checks]
    final.append(F.when(ok, pts).otherwise(F.lit(0)).cast("int").alias("score"))
    final.append(F.col("error"))
    stages.append(final)
    return stages


@functools.lru_cache(maxsize=64)
def _cached_stage_columns(answer: str, tool: str, key: str, needle: str) -> list[list[Column]]:
    # Column expressions are unresolved trees, so they can be reused by any DataFrame
    # with these column names; building them once saves driver round trips per query.
    return _stage_columns(F.col(answer), F.col(tool), F.col(key), F.col(needle))


CHECK_COLUMNS = ("has_tool_call_tags", "valid_json", "correct_tool", "correct_arg_key", "correct_arg_value")


def score_tool_calls(df: DataFrame, answer: str, expected_tool: str | Column,
                     expected_key: str | Column, expected_contains: str | Column,
                     keep_work: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """P1-P7 on a DataFrame of responses.

    Adds ``has_tool_call_tags, valid_json, correct_tool, correct_arg_key,
    correct_arg_value`` (booleans, NULL on error rows), ``score`` (int 0-5) and
    ``error`` (NULL unless the reference would have raised). Each step is its own
    projection (several columns at a time), so every regex and JSON parse runs
    once per row. ``extra`` columns are added in the final projection."""
    names = (answer, expected_tool, expected_key, expected_contains)
    if all(isinstance(n, str) for n in names):
        stages = _cached_stage_columns(*names)
    else:
        stages = _stage_columns(_c(answer), _c(expected_tool), _c(expected_key), _c(expected_contains))
    base = [c for c in df.columns if c not in ("error", "score") and c not in CHECK_COLUMNS]
    s = df
    for cols in stages[:-1]:
        s = s.select("*", *cols)
    work = [c for c in s.columns if c.startswith("_sc_")] if keep_work else []
    extras = [c.alias(n) for n, c in (extra or {}).items()]
    return s.select(*base, *work, *stages[-1], *extras)


def score_status(score: Column | str) -> Column:
    """PERFECT at 5, PARTIAL (k/5) at 3-4, FAIL (k/5) below."""
    s = _c(score)
    frac = F.concat(F.lit(" ("), s.cast("string"), F.lit("/5)"))
    return (F.when(s == 5, F.lit(PERFECT))
            .when(s >= 3, F.concat(F.lit(PARTIAL), frac))
            .otherwise(F.concat(F.lit(FAIL), frac)))
