"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence number.
A sketch takes, under one hash function, the smallest few labelled shingles and keeps
them in text order; texts of high edit similarity share sketches, texts that only share
passages hardly do. Texts that share a sketch are candidates, and a pair is linked if an
alignment of the two shingle sequences within a diagonal band matches at least 0.8 of
their union. Classes are the connected components of the links.

No pairs of a group are spelled out, and no candidate is capped:
1. Equal texts are one vertex (a 64-bit hash of the text).
2. A text whose sketches are all its own has no candidate and leaves.
3. A shingle that only one remaining text has cannot be matched, so a text with more than
   a fifth of such shingles has no partner at this similarity and leaves (an exact bound).
4. Every remaining text is compared with the best of its groups' centers (the member with
   the smallest share of shingles of its own). Their links join most of each group. Then the
   members still outside their group's largest component are compared with two members of
   each of their groups, drawn by a hash.
5. Pairs that share a sketch but not yet a component are all verified, unless their counts
   of unmatchable shingles or their distances from a common center rule the similarity out
   (exact bounds too): in each group, the members outside its largest component against the
   others. A parity sketch of the two texts gives a further exact bound on the way: two sets
   of shingles differ in at least as many as the bits in which their sketches differ, so the
   members of a group of near misses are ruled out where the group is joined, and are not
   written, shuffled or compared.
Joins that a large group could skew read written tables, so that adaptive execution can
split them.

Defined cases: null texts are linked to nothing; equal texts share a class, also empty
ones; a text of one to four words is one shingle, a text without words is linked to its
equals only; case is ignored by shingles; rows that repeat share a class; an empty table
gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalkit.llm.common import WORD, materialize, small_enough

SHINGLE = 5
SIMILARITY = 0.8
#: Sketches of long texts (functions, shingles each) and of short ones. A text of at most
#: SHORT_MAX shingles gets the short set, one of at least LONG_MIN the long set, and the two
#: overlap so that texts of similarity 0.8 always have a set in common.
LONG_SET, SHORT_SET = (64, 8), (16, 2)
LONG_MIN, SHORT_MAX = 40, 50
#: Rounds of comparisons with members drawn by a hash, and how many of each group.
ROUNDS, PARTNERS = 1, 2
#: Products of a sketch computed at a time.
PRODUCTS = 1 << 19
#: Words of 64 bits of a parity sketch.
PARITY = 32
MIX = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> Column:
    """Hashes of the lower-case words of a text column, in order (in the JVM)."""
    words = F.filter(F.split(F.lower(F.col(text)), WORD.replace("[^", "[")), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles in text order; equal shingles differ by their occurrence."""
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    h = words[:n].copy()
    for i in range(1, size):
        h *= np.uint64(MIX)
        h += words[i:i + n]
    h = mix(h)
    ordered = np.sort(h)
    if (ordered[1:] != ordered[:-1]).all():
        return h
    order = np.argsort(h, kind="stable")
    first = np.r_[True, h[order[1:]] != h[order[:-1]]]
    at = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return np.where(occurrence > 0, mix(h ^ (occurrence * np.uint64(MIX))), h)


def smallest(h: np.ndarray, factors: np.ndarray, size: int) -> np.ndarray:
    """Positions, in text order, of the ``size`` smallest values under each hash function
    (a product of 32 bits).

    Only values below a limit that about three times ``size`` of them pass are looked at;
    a function that too few pass is done in full."""
    n = len(h)
    values = (h >> np.uint64(32)).astype(np.uint32)[None, :] * factors.astype(np.uint32)[:, None]
    if n <= 6 * size:
        return np.sort(np.argsort(values, axis=1, kind="stable")[:, :size], axis=1)
    flat = values.ravel()
    found = np.flatnonzero(flat < np.uint32(3 * size / n * 2.0**32))
    row = found // n
    found = found[np.argsort((row.astype(np.uint64) << np.uint64(32)) | flat[found])]
    start = np.searchsorted(row, np.arange(len(factors) + 1))
    low = found[np.minimum(start[:-1, None] + np.arange(size), max(len(found) - 1, 0))] if len(found) else \
        np.zeros((len(factors), size), np.int64)
    low -= np.arange(len(factors))[:, None] * n
    for i in np.flatnonzero(np.diff(start) < size):
        low[i] = np.argsort(values[i], kind="stable")[:size]
    return np.sort(low, axis=1)


def sketch_set(h: np.ndarray, functions: int, size: int, seed: int) -> np.ndarray:
    """One key per hash function: the ``size`` smallest labelled shingles in text order."""
    size = min(size, len(h))
    factors = mix(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(MIX) + np.uint64(seed)) | np.uint64(1)
    keys = mix(factors)
    per = max(1, PRODUCTS // len(h))
    for start in range(0, functions, per):
        chosen = h[smallest(h, factors[start:start + per], size)]
        acc = keys[start:start + per]
        for i in range(size):
            acc = mix(acc ^ chosen[:, i])
        keys[start:start + per] = acc
    return keys


def sketches(h: np.ndarray) -> np.ndarray:
    parts = []
    if 0 < len(h) <= SHORT_MAX:
        parts.append(sketch_set(h, *SHORT_SET, seed=1))
    if len(h) >= LONG_MIN:
        parts.append(sketch_set(h, *LONG_SET, seed=2))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Positions of the equal labelled shingles of two texts, and their Jaccard similarity."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return ia, ib, len(ia) / max(1, len(a) + len(b) - len(ia))


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether an order-preserving matching of equal labelled shingles, within the band that
    this similarity leaves, covers ``similarity`` of their union."""
    return matched(len(a) + len(b), *overlap(a, b)[:2], similarity)


def matched(total: int, ia: np.ndarray, ib: np.ndarray, similarity: float = SIMILARITY) -> bool:
    least = similarity * total / (1 + similarity)  # matches that the similarity needs
    if len(ia) < least - 1e-9:
        return False
    band = total - 2 * least + 1  # more unmatched shingles than this fall short
    near = np.abs(ia - ib) <= band
    order = np.argsort(ia[near])
    to = ib[near][order]
    if len(to) < least - 1e-9:
        return False
    if (np.diff(to) > 0).all():
        return True
    tails: list[int] = []  # longest increasing run of partners
    for x in to.tolist():
        k = bisect_left(tails, x)
        tails[k:k + 1] = [x]
    return len(tails) >= least - 1e-9


def long_lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def lists_of(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays of unsigned numbers, not copied."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def to_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shingles = [labelled_shingles(w) for w in lists_of(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array([len(h) for h in shingles], pa.int32()),
                               long_lists([sketches(h) for h in shingles])], ["tid", "n", "keys"])


def parity(h: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of shingles falls on them."""
    at = mix(h ^ np.uint64(MIX)) % np.uint64(64 * PARITY)
    odd = np.bincount(at.astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def to_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shingles = [labelled_shingles(w) for w in lists_of(batch.column(1))]
        yield pa.record_batch([batch.column(0), long_lists(shingles), long_lists([parity(h) for h in shingles])],
                              ["tid", "shingles", "bits"])


def may_match(n: str, bits: str, m: str, others: str) -> Column:
    """Whether the parity sketches of two texts of n and m shingles leave room for the similarity:
    each bit that differs takes a shingle that only one of them has."""
    apart = sum((F.bit_count(F.get(F.col(bits), i).bitwiseXOR(F.get(F.col(others), i))) for i in range(PARITY)), F.lit(0))
    return apart * (1 + SIMILARITY) <= (F.col(n) + F.col(m)) * (1 - SIMILARITY) + 1e-9


def to_checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked, jaccard = [], []
        for a, b in zip(lists_of(batch.column(2)), lists_of(batch.column(3))):
            ia, ib, j = overlap(a, b)
            linked.append(matched(len(a) + len(b), ia, ib))
            jaccard.append(j)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(jaccard, pa.float64()),
                               pa.array(linked, pa.bool_())], ["a", "b", "jaccard", "linked"])


def checked(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) with their Jaccard similarity and whether an alignment links them.
    Both joins read written tables."""
    side = {c: shingles.select(F.col("tid").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "sa", "sb")
    return materialize(both.mapInArrow(to_checked, "a long, b long, jaccard double, linked boolean"), "near-checked")


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    return checked(pairs, shingles).filter("linked").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex of each vertex's connected component. Labels spread
    along the edges and then jump to their own labels, until nothing changes."""
    both = materialize(edges.select(F.col("a").alias("v"), F.col("b").alias("near"))
                       .union(edges.select(F.col("b"), F.col("a"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy("v").agg(F.least(F.col("v"), F.min("near")).alias("label")), "cc")
    while True:
        heard = (both.join(labels.withColumnRenamed("v", "near"), "near").groupBy("v").agg(F.min("label").alias("heard")))
        spread = materialize(labels.join(heard, "v").select(
            "v", F.least("label", "heard").alias("label"), F.col("label").alias("old")), "cc")
        up = spread.select(F.col("v").alias("label"), F.col("label").alias("root"))
        jumped = materialize(spread.join(up, "label").select("v", F.least("label", "root").alias("label"),
                                                             (F.col("old") != F.least("label", "root")).alias("moved")),
                             "cc")
        labels = jumped.select("v", "label")
        if not jumped.filter("moved").limit(1).count():
            return labels


def keep_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose tid is in ``ids``; texts are not shuffled if the ids are few."""
    return df.join(F.broadcast(ids) if small_enough(ids, 16) else ids, "tid", "left_semi")


def matchable(n: str, own: str, m: str, mine: str) -> Column:
    """Whether two texts of n and m shingles, own and mine of which no other text has, can
    reach the similarity: the matches are at most the shared shingles of either."""
    matches = F.least(F.col(n) - F.col(own), F.col(m) - F.col(mine))
    return matches * (1 + SIMILARITY) >= (F.col(n) + F.col(m)) * SIMILARITY - 1e-9


def links(texts: DataFrame) -> DataFrame:
    """Links (a, b) between different texts of (tid, text), as many as join each class."""
    words = texts.select("tid", word_hashes("text").alias("words"))
    sketched = materialize(words.mapInArrow(to_sketches, "tid long, n int, keys array<long>")
                           .filter("n > 0").dropDuplicates(["tid"]), "near-sketches")
    alone = (sketched.select("tid", F.explode("keys").alias("key")).groupBy("key")
             .agg(F.count(F.lit(1)).alias("c"), F.min("tid").alias("tid")).filter("c = 1")
             .groupBy("tid").agg(F.count(F.lit(1)).alias("own")))
    some = materialize(sketched.select("tid", F.size("keys").alias("k")).join(alone, "tid", "left")
                       .filter(F.coalesce("own", F.lit(0)) < F.col("k")).select("tid"), "near-candidates")
    shingles = materialize(keep_of(texts, some).select("tid", word_hashes("text").alias("words"))
                           .mapInArrow(to_shingles, "tid long, shingles array<long>, bits array<long>")
                           .dropDuplicates(["tid"]), "near-shingles")
    unique = (shingles.select("tid", F.explode("shingles").alias("s")).groupBy("s")
              .agg(F.count(F.lit(1)).alias("c"), F.min("tid").alias("tid")).filter("c = 1")
              .groupBy("tid").agg(F.count(F.lit(1)).alias("own")))
    n, own = F.size("shingles"), F.coalesce("own", F.lit(0))
    able = materialize(shingles.select("tid", n.alias("n")).join(unique, "tid", "left")
                       .filter(F.col("n") - own >= F.col("n") * SIMILARITY - 1e-9)
                       .select("tid", "n", own.cast("int").alias("own")), "near-able")
    shingles = materialize(keep_of(shingles, able.select("tid")), "near-able-shingles")
    # members of the groups (texts that share a sketch), each with its group's center
    member = materialize(keep_of(sketched.select("tid", "keys"), able.select("tid")).join(able, "tid")
                         .select("tid", "n", "own", F.explode("keys").alias("key")), "near-members")
    best = F.struct((F.col("own") / F.col("n")).alias("share"), "tid", "n", "own")
    center = materialize(member.groupBy("key").agg(F.min(best).alias("center"), F.count(F.lit(1)).alias("c"))
                         .filter("c > 1").drop("c"), "near-centers")
    member = materialize(member.join(center, "key"), "near-groups")
    first = materialize(to_centers(member), "near-pairs")
    ends = [F.least("tid", "c").alias("a"), F.greatest("tid", "c").alias("b")]
    tried = first.select(*ends)
    done = checked(tried, shingles)
    found = done.filter("linked").select("a", "b")
    # each text's distance from its center; a text without one is its own
    distance = first.select("tid", "c", *ends).join(done, ["a", "b"]).select("tid", "c", (1 - F.col("jaccard")).alias("d"))
    member = materialize(member.drop("center").join(distance, "tid", "left").select(
        "key", "tid", "n", "own", F.coalesce("c", "tid").alias("c"), F.coalesce("d", F.lit(0.0)).alias("d")), "near-placed")
    for r in range(ROUNDS):
        # members outside their group's largest component against a few of the group
        rest, stray = outside(member, components(found))
        some = rest.groupBy("key").agg(*[
            F.min(F.struct(F.xxhash64("tid", F.lit(r * PARTNERS + i)).alias("h"), "tid", "n", "own", "comp")).alias(f"p{i}")
            for i in range(PARTNERS)])
        some = materialize(some.select("key", F.array(*[f"p{i}" for i in range(PARTNERS)]).alias("some")), "near-some")
        near = stray.join(some, "key").withColumn("center", F.explode("some")).filter(F.col("comp") != F.col("center.comp"))
        near = near.filter(matchable("n", "own", "center.n", "center.own"))
        more = near.select(F.least("tid", "center.tid").alias("a"), F.greatest("tid", "center.tid").alias("b")).distinct()
        more = materialize(more.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        found, tried = found.union(verified(more, shingles)), tried.union(more)
    rest, stray = outside(member, components(found))
    # both sides with their parity sketches (a few hundred bytes each), for groups that are still split
    bits = keep_of(shingles.select("tid", "bits"), rest.select("tid").distinct())
    rest = materialize(rest.join(bits, "tid"), "near-rest-bits")
    stray = materialize(stray.join(bits, "tid").select(
        "key", F.col("tid").alias("t"), F.col("n").alias("m"), F.col("own").alias("mine"), F.col("comp").alias("other"),
        F.col("c").alias("oc"), F.col("d").alias("od"), F.col("bits").alias("others")), "near-stray-bits")
    # Jaccard distance obeys the triangle inequality
    apart = (F.col("c") == F.col("oc")) & (F.abs(F.col("d") - F.col("od")) > 1 - SIMILARITY + 1e-9)
    last = (stray.join(rest, "key")
            .filter((F.col("comp") != F.col("other")) & ((F.col("comp") == F.col("top")) | (F.col("t") < F.col("tid")))
                    & matchable("m", "mine", "n", "own") & ~apart & may_match("n", "bits", "m", "others"))
            .select(F.least("t", "tid").alias("a"), F.greatest("t", "tid").alias("b")).distinct())
    last = materialize(last.join(tried, ["a", "b"], "left_anti"), "near-last-pairs")
    return found.union(verified(last, shingles))


def to_centers(member: DataFrame) -> DataFrame:
    """(tid, c): each text with the best of its groups' centers that it could match."""
    fit = matchable("n", "own", "center.n", "center.own") & (F.col("tid") != F.col("center.tid"))
    best = member.filter(fit).groupBy("tid").agg(F.min("center").alias("c"))
    return best.select("tid", F.col("c.tid").alias("c")).filter("tid != c")


def outside(member: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of groups of several components, with their component (comp) and the
    group's largest (top); and those outside the largest."""
    placed = materialize(member.join(label.withColumnRenamed("v", "tid"), "tid", "left")
                         .select("key", "tid", "n", "own", "c", "d", F.coalesce("label", "tid").alias("comp")), "near-placed")
    split = (placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
             .agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k"))
             .filter("k > 1").select("key", F.col("top.comp").alias("top")))
    rest = materialize(placed.join(materialize(split, "near-split"), "key"), "near-rest")
    return rest, materialize(rest.filter("comp != top"), "near-strays")


def text_id(text: str):
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


def roots(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tid, root) per row: root names the class (null texts: tid and root null)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_id(text).alias("tid"), F.col(text).alias("text"))
    label = components(links(rows.filter("tid is not null").select("tid", "text")))
    ids = materialize(rows.select("doc_id", "tid"), "near-ids")
    return materialize(ids.join(label.withColumnRenamed("v", "tid"), "tid", "left")
                       .select("doc_id", "tid", F.coalesce("label", "tid").alias("root")), "near-roots")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest id of the class) and class_size, one row per document."""
    rows = roots(docs, doc_id, text)
    known = rows.filter("root is not null")
    each = materialize(known.groupBy("root").agg(F.min("doc_id").alias("class_id"),
                                                 F.count(F.lit(1)).alias("class_size")), "near-classes")
    single = rows.filter("root is null").select("doc_id", F.col("doc_id").alias("class_id"),
                                                F.lit(1).cast("long").alias("class_size"))
    return known.join(each, "root").select("doc_id", "class_id", "class_size").union(single)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that of the smallest id. All columns are kept."""
    rows = roots(docs, doc_id, text).filter("root is not null")
    groups = (rows.groupBy("root").agg(F.min(F.struct("doc_id", "tid")).alias("keep"), F.count(F.lit(1)).alias("c"))
              .filter("c > 1"))
    groups = materialize(groups.select("root", "keep.*"), "near-keep")
    # per text of a class of several rows: the id that stays, or none
    fate = (rows.select("tid", "root").distinct().join(groups.withColumnRenamed("tid", "kept"), "root")
            .select("tid", (F.col("tid") == F.col("kept")).alias("_llm_stays"), F.col("doc_id").alias("_llm_id")))
    fate = materialize(fate, "near-fate")
    again = (rows.groupBy("tid", "doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
             .join(groups.select("tid", F.col("doc_id").alias("d")), "tid").filter(F.col("doc_id").eqNullSafe(F.col("d")))
             .select("tid"))
    again = materialize(again, "near-repeated")
    names = docs.columns
    keyed = docs.withColumn("_llm_tid", text_id(text))
    fate = fate.withColumnRenamed("tid", "_llm_tid")
    joined = keyed.join(F.broadcast(fate) if small_enough(fate, 32) else fate, "_llm_tid", "left")
    stays = F.col("_llm_stays").isNull() | (F.col("_llm_stays") & F.col(doc_id).eqNullSafe(F.col("_llm_id")))
    kept = joined.filter(stays)
    if again.limit(1).count():  # rows that repeat as a whole: one of them stays
        again = again.select(F.col("tid").alias("_llm_tid"))
        again = F.broadcast(again) if small_enough(again, 16) else again
        once = kept.join(again, "_llm_tid", "left_semi").dropDuplicates(["_llm_tid"])
        kept = kept.join(again, "_llm_tid", "left_anti").union(once)
    return kept.select(*[F.col(f"`{c}`") for c in names])
