"""Mixing sources to target weights.

Sizes are summed per source (a partial aggregate, so a hot source costs nothing),
targets follow from weights by sharing a total and capping each source at a multiple
of its size, and each document is emitted ``floor(rate)`` times plus one copy with the
probability of the fraction, drawn from a hash of the seed and its id. Reruns agree.

Defined cases: a null or empty text has size 0; null is a source of its own, ordered
last; a source of size 0 has target 0 and rate 0; rows that repeat with one id share
their draw; an empty table gives an empty mix; input columns that carry the name of a
result column give way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalkit.llm.common import WORD, fresh, materialize, small_enough, with_columns
from evalkit.plans.ordering import global_index

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2.0
SEED = "mix-1"
#: Salts of the join on the source when the table of sources is too large to broadcast.
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, size: Column, source: str = "source", weights: Sequence[float] = WEIGHTS,
                   share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) per source.

    The level ``lam`` at which targets ``min(max_repeat * size, lam * weight)`` add up
    to the shared total is found by passes over the table of sources; each pass brings
    three sums to the driver, and caps every source the last level puts above its limit.
    """
    sizes = docs.groupBy(F.col(source).alias("_s")).agg(F.sum(size).alias("_n"))
    ranked = global_index(sizes, [F.col("_s").asc_nulls_last()], name="_r")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("_r") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("_s", "_n", weight.alias("_w")), "mix-sources")
    limit = max_repeat * F.col("_n")
    lam, capped = 0.0, -1
    while True:
        over = F.col("_w") * F.lit(lam) >= limit
        row = ranked.agg(F.sum("_n").alias("n"), F.sum(F.when(over, limit)).alias("full"),
                         F.sum(F.when(~over, F.col("_w"))).alias("w"), F.count(F.when(over, 1)).alias("k")).first()
        if row["k"] == capped or not row["w"]:
            break
        capped = row["k"]
        lam = max(0.0, share * row["n"] - (row["full"] or 0.0)) / row["w"]
    target = F.when(F.col("_w") * F.lit(lam) >= limit, limit).otherwise(F.col("_w") * F.lit(lam))
    return ranked.select(F.col("_s").alias("source"), F.col("_n").alias("source_size"), target.alias("target"))


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT,
           seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, rate and the number of copies to emit."""
    targets = source_targets(docs, word_count(F.col(text)), source, weights, share, max_repeat)
    sized = with_columns(docs, {"size": word_count(F.col(text))})
    own, n, goal, salt, spread = (fresh(sized, x) for x in ("source", "source_size", "target", "salt", "spread"))
    t = targets.select(F.col("source").alias(own), F.col("source_size").alias(n), F.col("target").alias(goal))
    on = F.col(source).eqNullSafe(F.col(own))
    if small_enough(t, F.coalesce(F.octet_length(own), F.lit(0)) + 64):
        joined = sized.join(F.broadcast(t), on)
    else:
        sized = sized.withColumn(salt, F.pmod(F.xxhash64(doc_id, "size"), F.lit(SALTS)))
        t = t.withColumn(spread, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.join(t, on & (F.col(salt) == F.col(spread)))
    rate = F.when(F.col(n) > 0, F.col(goal) / F.col(n)).otherwise(0.0)
    whole = F.floor(rate).cast("long")
    extra = (uniform(seed, F.col(doc_id)) < rate - whole).cast("long")
    out = with_columns(joined, {"source_size": F.col(n), "target": F.col(goal), "rate": rate,
                                "copies": whole + extra})
    return out.drop(own, n, goal, salt, spread)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: the columns of ``docs``, each document as often as its copies say."""
    names, row = [f"`{c}`" for c in docs.columns], fresh(docs, "row")
    plan = copies(docs.select(*names, F.struct(*names).alias(row)), **options)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return plan.filter(F.col("copies") > 0).select(row, times.alias("copy")).select(f"{row}.*")
