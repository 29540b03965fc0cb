"""Calibration-corpus preparation.

Tokenisation is pluggable: the default splits on whitespace in the JVM; a real
vocabulary can be plugged in as an Arrow UDF returning token ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from evalkit import pools
from evalkit.functions import text as T
from evalkit.operators.prompts import exchange_range, position_columns
from evalkit.plans.joins import bounded_broadcast
from evalkit.plans.ordering import global_index

Tokenizer = Callable[[Column], Column]


def pick_text_column(df: DataFrame, preferred: Sequence[str] = tuple(pools.TEXT_COLUMN_PREFERENCE)) -> str:
    """First of text/content/sentence/input present, else the first column
    (a choice over the schema, made on the driver without reading data)."""
    for c in preferred:
        if c in df.columns:
            return c
    return df.columns[0]


def with_text(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    c = pick_text_column(df)
    return df.select(*keep, F.col(c).alias("text"))


def usable_text(df: DataFrame, min_chars: int = pools.MIN_USABLE_CHARS) -> DataFrame:
    """drop NULL/empty texts and those whose stripped length is below ``min_chars``."""
    return df.filter(F.length(T.py_strip("text")) >= min_chars)


def first_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """the first ``n`` rows in an explicit order (TakeOrderedAndProject: each
    task keeps its top n, the driver merges n rows per task)."""
    return df.orderBy(*order).limit(n)


def whitespace_tokens(text: Column) -> Column:
    return T.py_split(text)


def arrow_tokenizer(encode: Callable[[str], Sequence[int]]) -> Tokenizer:
    """A real vocabulary plugged into G13: ``encode`` (text -> token ids, e.g. a
    loaded tokenizer's method) runs in an Arrow-batched pandas UDF, one batch of
    texts per call, inside the tasks that already hold the rows."""
    def _batch(texts: pd.Series) -> pd.Series:  # a closure: pickled by value with ``encode``
        return texts.map(lambda t: None if t is None else [int(i) for i in encode(t)])

    udf = pandas_udf(_batch, ArrayType(LongType()))
    return lambda col: udf(col)


def tokenise_truncate(df: DataFrame, max_len: int, tokenizer: Tokenizer = whitespace_tokens,
                      text: str = "text") -> DataFrame:
    """Tokens of the whole text, the first ``max_len`` kept; ``pre_len`` is the
    length before truncation, ``truncated`` = pre_len > max_len, and
    ``at_max`` = kept length equals max_len (the second notion the reference counts)."""
    t = df.withColumn("_tok", tokenizer(F.col(text)))
    t = (t.withColumn("pre_len", F.size("_tok"))
         .withColumn("input_ids", F.slice("_tok", 1, max_len))
         .withColumn("token_len", F.size("input_ids"))
         .withColumn("truncated", F.col("pre_len") > max_len)
         .withColumn("at_max", F.col("token_len") == max_len))
    pos, beam = position_columns("token_len")
    return t.withColumn("position_ids", pos).withColumn("beam_idx", beam).drop("_tok")


def calib_profile(samples: DataFrame) -> DataFrame:
    """Sample count, average length and both truncation counts."""
    return samples.agg(F.count(F.lit(1)).alias("samples"), F.avg("token_len").alias("avg_len"),
                       F.count_if("truncated").alias("truncated_pre"),
                       F.count_if("at_max").alias("truncated_at_max"))


def fixed_quota(items: DataFrame, key: str, n: int) -> DataFrame:
    """Each item repeated max(1, n // k) times (k = number of items) in item
    order, stopping after ``n`` samples (fewer when n % k > 0).

    Only the first ``n`` items can be used: a top-n of the distinct keys and one count
    are enough, and the positions are those of at most ``n`` rows."""
    distinct = items.select(key).distinct()
    k = distinct.agg(F.count(F.lit(1)).alias("_k"))
    first = distinct.orderBy(key).limit(n)
    ranked = first.withColumn("_rank", F.row_number().over(Window.orderBy(key)) - 1)  # at most n rows
    reps = ranked.crossJoin(F.broadcast(k)).withColumn("_r", F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_k"))).cast("long"))
    out = (reps.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_r"))))
           .withColumn("sample", F.col("_rank") * F.col("_r") + F.col("rep") - 1))
    return out.filter(F.col("sample") < n).select("sample", key, F.col("rep").cast("int").alias("rep"))


def _pick(seed: Column, slot: str, size: Column) -> Column:
    """Deterministic pseudo-random index in [0, size) from md5(seed:slot)."""
    h = F.md5(F.concat(seed.cast("string"), F.lit(":" + slot)))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), size.cast("long"))


def snippet_kinds(max_seq_len: int) -> list[str]:
    """G12 (second half): long snippets are used only from the longest limit on."""
    return ["snippet", "long"] if max_seq_len >= pools.EXCHANGE_RANGES[0][0] else ["snippet"]


def line_pool(lines: DataFrame, max_seq_len: int) -> DataFrame:
    """(kind, line) rows as (kind, idx, line, size): idx from 0 in line order within the
    kind, size the kind's number of lines. Snippets are those the length limit allows."""
    keep = ["user", "analysis", *snippet_kinds(max_seq_len)]
    kind = F.when(F.col("kind") == "long", F.lit("snippet")).otherwise(F.col("kind"))
    used = lines.filter(F.col("kind").isin(keep)).select(kind.alias("kind"), "line")
    placed = global_index(used, ["kind", "line"], name="_pos")
    per = placed.groupBy("kind").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("size"))
    return placed.join(F.broadcast(per), "kind").select("kind", (F.col("_pos") - F.col("_first")).alias("idx"), "line", "size")


def seeded_samples(samples: DataFrame, exchanges: DataFrame, lines: DataFrame, finals: DataFrame, system: DataFrame,
                   max_seq_len: int, sample: str = "sample", tokenizer: Tokenizer = whitespace_tokens) -> DataFrame:
    """Per sample (seed = 42 + sample): an exchange count in the range of G12,
    exchanges drawn with replacement, each with a user line, the call, its result with a
    code snippet, and an analysis line; then a final request and its expected call. The
    text is tokenised and cut to ``max_seq_len`` by G13. Picks are md5-based
    (deterministic, engine independent), not Mersenne Twister.

    Pools are tables: ``exchanges`` (exchange_id, call, result), ``lines`` (kind: user,
    analysis, snippet or long; line), ``finals`` (final_request, expected_tool, arg_key,
    arg_value); ``system`` is one row with the system message (``system_text``). Returns
    one row per sample: text, manifest fields, pre_len, token_len, truncated, input_ids;
    the gather per sample is bounded by the exchange range (at most 6)."""
    pool = global_index(exchanges.select("exchange_id", "call", "result"), ["exchange_id"], name="idx")
    line = line_pool(lines, max_seq_len)
    final = global_index(finals, ["final_request"], name="final_idx")
    kinds = {k: line.filter(F.col("kind") == k) for k in ("user", "analysis", "snippet")}
    sizes = pool.agg(F.count(F.lit(1)).alias("_pn")).crossJoin(F.broadcast(final.agg(F.count(F.lit(1)).alias("_fn"))))
    for k, t in kinds.items():
        sizes = sizes.crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias(f"_n_{k}"))))
    seed = F.col("sample") + F.lit(pools.CALIB_SEED_BASE)
    s = samples.select(F.col(sample).alias("sample")).distinct().crossJoin(F.broadcast(sizes))  # one row of counts
    s = s.withColumn("_rng", exchange_range(F.lit(max_seq_len)))
    s = s.withColumn("num_exchanges", (F.col("_rng.lo") + _pick(seed, "n", F.col("_rng.hi") - F.col("_rng.lo") + 1)).cast("int"))
    s = s.withColumn("final_idx", _pick(seed, "final", F.col("_fn")))
    slots = s.withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("num_exchanges"))))
    draw = lambda name, size: _pick(F.concat(seed.cast("string"), F.lit(f":{name}"), F.col("slot").cast("string")),
                                    "x", F.col(size))
    j = slots.withColumn("idx", draw("ex", "_pn")).join(bounded_broadcast(pool), "idx").drop("idx")
    for k, name in (("snippet", "sn"), ("user", "us"), ("analysis", "an")):
        side = kinds[k].select("idx", F.col("line").alias(f"_{k}"))
        j = j.withColumn("idx", draw(name, f"_n_{k}")).join(bounded_broadcast(side), "idx").drop("idx")

    def turn(role: str, *content: Column) -> list[Column]:
        return [F.lit(f"<|im_start|>{role}\n"), *content, F.lit("<|im_end|>\n")]

    block = F.concat(*turn("user", F.col("_user")),
                     *turn("assistant", F.lit("<tool_call>\n"), F.col("call"), F.lit("\n</tool_call>")),
                     *turn("user", F.col("result"), F.lit("\n\n```\n"), F.col("_snippet"), F.lit("\n```")),
                     *turn("assistant", F.col("_analysis")))
    per = (j.groupBy("sample", "num_exchanges", "final_idx")
           .agg(F.array_sort(F.collect_list(F.struct("slot", block.alias("b")))).alias("_bl")))
    per = per.join(bounded_broadcast(final), "final_idx").crossJoin(bounded_broadcast(system.select("system_text")))
    expected = F.to_json(F.struct(F.col("expected_tool").alias("name"),
                                  F.create_map(F.col("arg_key"), F.col("arg_value")).alias("arguments")))
    text = F.concat(*turn("system", F.col("system_text")), F.array_join(F.transform("_bl", lambda x: x["b"]), ""),
                    *turn("user", F.col("final_request")), F.lit("<|im_start|>assistant\n<tool_call>\n"), expected,
                    F.lit("\n</tool_call>"))
    out = per.select("sample", "num_exchanges", "final_request", "expected_tool", expected.alias("expected_tool_call"),
                     text.alias("text"))
    return tokenise_truncate(out, max_seq_len, tokenizer)
