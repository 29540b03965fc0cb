"""Text cleaning, extraction and estimates as Spark Columns.

Regular expressions run in Java; the character classes below are written out so
they match what Python's ``str.strip``/``str.split``/``\\s``/``\\d`` accept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# Characters Python treats as whitespace (str.isspace, re's \s for str patterns).
PY_WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same characters as a literal set, for btrim.
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
               "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# The same set in Java's fast form: with the (?U) flag \s is Unicode White_Space,
# and Python adds U+001C..U+001F. Java only (RE2 reads (?U) as "ungreedy").
JAVA_WS = r"[\s\x{1C}-\x{1F}]"
# A run of non-whitespace characters (one word of str.split()).
PY_WORD = r"(?U)[^\s\x{1C}-\x{1F}]+"
# A Python \d (any Unicode decimal digit).
PY_DIGIT = r"\p{Nd}"
THINK_BLOCK = r"(?s)<think>.*?</think>"
PASSKEY_RUN = PY_DIGIT + "{6}"
FENCE = "```"
PY_FENCE = "```python"
ALLOC_BYTES = r"allocate (" + PY_DIGIT + r"+) bytes"
ANSWER_PREVIEW_CHARS = 200
SAMPLE_PREVIEW_CHARS = 500
ERROR_PREVIEW_CHARS = 200
ERROR_ANSWER = "ERROR"
LOG_PREVIEW_CHARS = 300
NO_THINK_SUFFIX = " /no_think"
# -----------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(text: Column | str) -> Column:
    """``str.strip()``: remove leading and trailing Python whitespace."""
    return F.btrim(_c(text), F.lit(PY_WS_CHARS))


def strip_thinking(text: Column | str) -> Column:
    """Drop every ``<think>...</think>`` block (lazy, dot matches newline), then strip.
    The regex only runs on texts that contain the opening tag."""
    t = _c(text)
    return py_strip(F.when(F.contains(t, F.lit("<think>")), F.regexp_replace(t, THINK_BLOCK, "")).otherwise(t))


def word_count(text: Column | str) -> Column:
    """``len(text.split())``: whitespace-separated words (runs of non-space;
    the pattern is compiled once per task, unlike ``split`` with a class)."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(PY_WORD)), F.lit(0))


def py_split(text: Column | str) -> Column:
    """``text.split()`` as an array of words."""
    return F.regexp_extract_all(_c(text), F.lit(f"({PY_WORD})"), F.lit(1))


def chars_div4(text: Column | str) -> Column:
    """Characters // 4 (the reference's token estimate for prompts)."""
    return F.floor(F.length(_c(text)) / 4).cast("long")


def words_to_tokens(words: Column | str) -> Column:
    """``int(words / 0.75)``."""
    return F.floor(_c(words).cast("double") / F.lit(0.75)).cast("long")


def preview(text: Column | str, n: int = ANSWER_PREVIEW_CHARS) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(text), 1, n)


def preview_ellipsis(text: Column | str, n: int = SAMPLE_PREVIEW_CHARS) -> Column:
    """First ``n`` characters plus ``...`` when longer."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def passkey_extract(clean: Column | str) -> Column:
    """First run of six digits in the cleaned answer, else its first 20 characters."""
    c = _c(clean)
    return F.coalesce(F.nullif(F.regexp_extract(c, PASSKEY_RUN, 0), F.lit("")), F.substring(c, 1, 20))


def passkey_correct(clean: Column | str, passkey: Column | str) -> Column:
    """P10: the passkey occurs anywhere in the cleaned answer."""
    return F.coalesce(F.contains(_c(clean), _c(passkey)), F.lit(False))


def code_block(text: Column | str) -> Column:
    """First ```python block, else first ``` block; unclosed runs to the end;
    stripped; NULL when absent or empty."""
    t = _c(text)
    after_py = F.try_element_at(F.split(t, PY_FENCE, 2), F.lit(2))
    after_any = F.try_element_at(F.split(t, FENCE, 2), F.lit(2))
    body = (F.when(F.contains(t, F.lit(PY_FENCE)), F.substring_index(after_py, FENCE, 1))
            .when(F.contains(t, F.lit(FENCE)), F.substring_index(after_any, FENCE, 1)))
    return F.nullif(py_strip(body), F.lit(""))


def report_before_fence(text: Column | str) -> Column:
    """Text before the first fence, stripped; the whole text when no fence."""
    t = _c(text)
    return F.when(F.contains(t, F.lit(FENCE)), py_strip(F.substring_index(t, FENCE, 1))).otherwise(t)


def round2(x: Column | str) -> Column:
    """Elapsed to 2 decimals, ties to even as Python's ``round``."""
    return F.bround(_c(x).cast("double"), 2)


def throughput(tokens: Column | str, elapsed: Column | str) -> Column:
    """Tokens per second with a zero guard."""
    e = _c(elapsed).cast("double")
    return F.when(e > 0, _c(tokens).cast("double") / e).otherwise(F.lit(0.0))


def alloc_failure(message: Column | str) -> Column:
    """Triage of an error text. Returns struct(kind, alloc_bytes, alloc_gib, detail)
    where kind is OOM (mentions allocate) or FAILED."""
    m = _c(message)
    raw = F.nullif(F.regexp_extract(m, ALLOC_BYTES, 1), F.lit(""))
    nbytes = F.when(F.contains(m, F.lit("allocate")), raw.try_cast("long"))
    kind = F.when(F.contains(m, F.lit("allocate")), F.lit("OOM")).otherwise(F.lit("FAILED"))
    detail = F.when(nbytes.isNull(), F.substring(m, 1, LOG_PREVIEW_CHARS))
    return F.struct(kind.alias("kind"), nbytes.alias("alloc_bytes"),
                    (nbytes.cast("double") / F.lit(1024.0 ** 3)).alias("alloc_gib"),
                    detail.alias("detail"))
