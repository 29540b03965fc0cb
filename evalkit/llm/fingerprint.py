"""Document fingerprints: threshold-scaled sketches of word shingles.

Every shingle of five words is hashed, and every hash below a fixed fraction of the
range is retained. A sketch therefore grows with its document, sketches of parts merge into
the sketch of the whole, and containment is estimated even between documents of very
different length. A text none of whose hashes lies below the threshold keeps its smallest
hash as a name: it tells equal texts, but is no part of a longer text's sketch, so it says
nothing about containment. DataFrame functions only.

Neighbours in the order of ids come from a window per range of ids. The bounds of the ranges
are ids of rows, from a bounded sample, found by halving; the first row of each range is
added to the range before as a guest, so no range has to look into another and the texts
are shuffled once.

Defined cases: null is the empty text; a text of one to four words is one shingle, which no
longer text holds; a text without words has an empty fingerprint; equal fingerprints have
likeness 1, an empty one has 0 to any other, and one that is a name only has none (null) to
any other; rows with one id are ordered by a hash of the text, null ids come last; a table of
one row is its own neighbour; an empty table gives an empty table; extra columns are not
carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalkit.llm.common import WORD, materialize

SHINGLE = 5
#: The fraction of hashes retained is 1 / SCALE.
SCALE = 4
#: Rows per range of ids aimed at, ids sampled per range, and ids sampled at most (beyond that
#: many ranges, they hold more rows: 40,000 in a table of 10**10).
RANGE_ROWS, SAMPLED, MAX_SAMPLED = 1000, 8, 1 << 21


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` lower-case words (all words, if fewer)."""
    gap = WORD.replace("[^", "[")
    words = F.filter(F.split(F.lower(text), gap), lambda w: w != "")

    def shingles(h: Column) -> Column:
        long_enough = F.transform(F.sequence(F.lit(0), F.size(h) - size),
                                  lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
        return (F.when(F.size(h) >= size, long_enough)
                .when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))

    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def threshold(scale: int = SCALE) -> int:
    return -(2**63) + 2**64 // scale


def sketch(text: Column, scale: int = SCALE) -> Column:
    """The retained hashes of a text, sorted and distinct."""
    def retain(h: Column) -> Column:
        below = F.filter(h, lambda x: x < F.lit(threshold(scale)))
        return F.when(F.size(h) == 0, h).when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).otherwise(
            F.array(F.array_min(h)))

    return let(shingle_hashes(F.coalesce(text, F.lit(""))), retain)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two documents together, from their sketches."""
    def retain(u: Column) -> Column:
        below = F.filter(u, lambda x: x < F.lit(threshold(scale)))
        return F.when((F.size(below) > 0) | (F.size(u) == 0), below).otherwise(F.array(F.array_min(u)))

    return let(F.array_sort(F.array_union(a, b)), retain)


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Containment: the share of the retained hashes of sketch ``a`` that ``b`` holds. Equal
    sketches: 1; an empty one to another: 0; null where ``a`` has no hash below the threshold."""
    return (F.when(a == b, F.lit(1.0)).when(F.size(a) == 0, F.lit(0.0))
            .when(F.array_min(a) < F.lit(threshold(scale)), F.size(F.array_intersect(a, b)) / F.size(a)))


def as_string(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), " ")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, its sketch, and text and sketch of the next document in descending
    order of ids (``next_text``, ``next_sketch``); the last one's next is the first."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # ascending in this key is descending in the id, without overflow
    key = F.struct(F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(2**63 - 1)).alias("o"),
                   F.xxhash64("text").alias("t"))
    keyed = rows.withColumn("_key", key)
    known = keyed.agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("first")).first()
    ranges = max(1, min(-(-known["n"] // RANGE_ROWS), MAX_SAMPLED // SAMPLED))
    share = min(1.0, SAMPLED * ranges / max(known["n"], 1))
    every = SAMPLED if share < 1 else max(1, known["n"] // ranges)
    # one row: the bounds, every so many of the sampled keys (16 bytes each; at most MAX_SAMPLED / SAMPLED)
    sampled = keyed.select("_key").sample(share, seed=11).agg(F.sort_array(F.collect_set("_key")).alias("k"))
    bounds = materialize(sampled.select(F.filter("k", lambda x, i: (i % every == 0) & (i > 0)).alias("_bounds")), "fingerprint-bounds")
    # the number of bounds up to a key, by halving; a bound is the first key of its range
    steps = F.array(*[F.lit(1 << i) for i in range((MAX_SAMPLED // SAMPLED).bit_length(), -1, -1)])
    place = F.aggregate(steps, F.lit(0), lambda n, s: n + F.when(F.get("_bounds", n + s - 1) <= F.col("_key"), s).otherwise(0))
    placed = keyed.crossJoin(F.broadcast(bounds)).withColumn("_range", place)
    # the range before takes the first row as a guest; the last range takes the first of all
    first = F.lit(False) if known["first"] is None else F.col("_key") == F.struct(
        F.lit(known["first"]["o"]).alias("o"), F.lit(known["first"]["t"]).alias("t"))
    seat = lambda r, guest: F.struct(r.cast("int").alias("range"), F.lit(guest).alias("guest"))
    own = seat(F.col("_range"), False)
    seats = (F.when(first, F.array(own, seat(F.size("_bounds"), True)))
             .when(F.get("_bounds", F.col("_range") - 1) == F.col("_key"), F.array(own, seat(F.col("_range") - 1, True)))
             .otherwise(F.array(own)))
    seated = (placed.select("doc_id", "text", "_key", F.explode(seats).alias("_seat"))
              .select("doc_id", "text", "_key", "_seat.range", "_seat.guest").repartition("range"))
    ahead = Window.partitionBy("range").orderBy("guest", "_key")
    return (seated.withColumn("sketch", sketch(F.col("text")))
            .withColumn("next_text", F.lead("text").over(ahead))
            .withColumn("next_sketch", F.lead("sketch").over(ahead))
            .filter(~F.col("guest")).drop("range", "guest", "_key"))


def with_edited(docs: DataFrame) -> DataFrame:
    """The rows of ``with_next`` with n_chars and edited: the text whose last half gave way
    to as many first characters of the next document."""
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    return docs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
