"""Hard negatives by exact integer scores from subset-sum tables.

Four-Russians scoring. Vectors are scaled and floored to integers. The candidates are
packed once: their components in groups of eight, and of every group one byte per binary
digit (a bit plane in two's complement). For a block of anchors a table holds, per group,
the sum of every subset of its eight components. A byte of a plane is an index into the
table of its group, so a plane's share of a score is one lookup per group; planes are
added up from the highest by doubling (the highest one counts negative). Scores are whole
inner products, not estimates.

The anchors are a stated query set against all rows, in blocks. They are sent to the packed
candidates by broadcast, as many at once as a checked bound of bytes allows; beyond it
there are several passes. A task keeps what is best per anchor over all its candidates, so
a few rows per anchor and task are shuffled, whatever the frequency of a label. First come
the positives, the best other rows of the anchor's label; their scores set the bounds
within which, in a second run over the candidates, the best rows of other labels are the
negatives.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component take no part, neither do rows with a scaled component of 2**24 or more in
magnitude (below it sums over 32,768 components are exact in 64 bits); a missing component
of a shorter vector is 0, so the empty vector scores 0 with all; rows with the id of an
anchor are the anchor itself (of several the smallest in label and vector) and never its
positives or negatives; other repeated rows count as often as they occur; an anchor
without positives, or a positive without negatives, gives no row; equal scores are ordered
by id; an empty table has no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalkit.llm.common import BROADCAST_BYTES, materialize

SCALE = 256.0
#: Positives of an anchor, negatives of a positive, and the bounds of a negative's score in
#: hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Candidates packed in one row, anchors scored together, components of a group.
CHUNK, BLOCK, GROUP = 2048, 128, 8
LARGEST = 2.0**24
PACKED = "n int, planes int, groups int, ids binary, labels binary, bits binary"
FOUND = "anchor_id long, slot int, id long, score long"


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: float = SCALE) -> DataFrame:
    """(id, label, v) of the rows that take part: v holds the scaled and floored components."""
    v = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fine = F.forall(F.col(vector), lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(LARGEST)), F.lit(False)))
    own = rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"),
                      F.col(vector).alias(vector), v.alias("v"))
    return own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & fine).drop(vector)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of integers, filled with zeros up to the longest and to whole groups."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = -(-int(n.max(initial=0)) // GROUP) * GROUP
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width)[None, :] < n[:, None]] = flat
    return out


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes: binary digits of the components, the sign's plane last."""
    n, width = values.shape
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    planes = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
    grouped = values.reshape(n, width // GROUP, GROUP)
    out = np.empty((planes, width // GROUP, n), np.uint8)
    for b in range(planes):
        out[b] = np.packbits(((grouped >> b) & 1).astype(np.uint8), axis=2, bitorder="little")[:, :, 0].T
    return out


def subset_sums(anchors: np.ndarray, kind) -> np.ndarray:
    """(groups, 256, anchors): the sum of every subset of a group's components."""
    n, width = anchors.shape
    parts = anchors.astype(kind).T.reshape(width // GROUP, GROUP, n)
    out = np.zeros((width // GROUP, 1 << GROUP, n), kind)
    for i in range(GROUP):
        out[:, 1 << i:2 << i] = out[:, :1 << i] + parts[:, i, None]
    return out


def exact_scores(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products of packed rows with anchors."""
    planes, groups, n = bits.shape
    groups = min(groups, anchors.shape[1] // GROUP)
    largest = int(np.abs(anchors).max(initial=0)) * GROUP * max(groups, 1) << planes + 1
    kind = np.int32 if largest < 2**31 else np.int64
    sums = subset_sums(anchors[:, :groups * GROUP], kind)
    total, looked = np.zeros((n, len(anchors)), kind), np.empty((n, len(anchors)), kind)
    for b in range(planes - 1, -1, -1):
        if b < planes - 1:
            total <<= 1
        for g in range(groups):
            np.take(sums[g], bits[b, g], axis=0, out=looked)
            if b == planes - 1:
                total -= looked
            else:
                total += looked
    return total


def pack(rows: DataFrame) -> DataFrame:
    """Candidates in rows of up to ``CHUNK``, each in the order of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids = part.column(0).to_numpy()
                order = np.argsort(ids, kind="stable")
                bits = bit_planes(matrix(part.column(2))[order])
                yield pa.record_batch([pa.array([x], t) for x, t in (
                    (len(ids), pa.int32()), (bits.shape[0], pa.int32()), (bits.shape[1], pa.int32()),
                    (ids[order].tobytes(), pa.binary()), (part.column(1).to_numpy()[order].tobytes(), pa.binary()),
                    (bits.tobytes(), pa.binary()))], ["n", "planes", "groups", "ids", "labels", "bits"])

    return rows.select("id", "label", "v").mapInArrow(run, PACKED)


def blocks(anchors: DataFrame, n: int) -> DataFrame:
    """Anchors (id, label, v, bounds) in rows of up to ``BLOCK``; bounds are the scores of
    their positives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = matrix(part.column(2))
                yield pa.record_batch([
                    pa.array([part.column(0).to_numpy().tobytes()], pa.binary()),
                    pa.array([part.column(1).to_numpy().tobytes()], pa.binary()),
                    pa.array([v.tobytes()], pa.binary()),
                    pa.array([part.column(3).to_pylist()], pa.list_(pa.list_(pa.int64())))],
                    ["anchor_ids", "anchor_labels", "anchors", "bounds"])

    dealt = anchors.select("id", "label", "v", "bounds").repartition(max(1, -(-n // BLOCK)))
    return dealt.mapInArrow(run, "anchor_ids binary, anchor_labels binary, anchors binary, bounds array<array<bigint>>")


def best(kept: tuple | None, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """The ``k`` highest scores (ties by id) of those kept and the new ones."""
    if kept is not None:
        scores, ids = np.concatenate([kept[0], scores]), np.concatenate([kept[1], ids])
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def leading(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; of equal ones the first places."""
    if len(scores) <= k:
        return np.arange(len(scores))
    at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def search(packed: DataFrame, asked: DataFrame, want: str, k: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, slot, id, score): per task the ``k`` best positives (slot 0) of every anchor,
    or the ``k`` best negatives within the bounds of each of its positives (slots from 0)."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple] = {}
        for n, planes, groups, ids, labels, bits, a_ids, a_labels, a_rows, bounds in pairs(batches):
            ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
            a_ids, a_labels = np.frombuffer(a_ids, np.int64), np.frombuffer(a_labels, np.int64)
            anchors = np.frombuffer(a_rows, np.int64).reshape(len(a_ids), len(a_rows) // 8 // len(a_ids))
            scores = exact_scores(np.frombuffer(bits, np.uint8).reshape(planes, groups, n), anchors).T.astype(np.int64)
            for j, (anchor, label) in enumerate(zip(a_ids.tolist(), a_labels.tolist())):
                if want == "positives":
                    mine = np.flatnonzero((labels == label) & (ids != anchor))
                    at = mine[leading(scores[j, mine], k)]
                    if len(at):
                        kept[anchor, 0] = best(kept.get((anchor, 0)), scores[j, at], ids[at], k)
                    continue
                if not bounds[j]:
                    continue
                limits = [(-(-low * s // 100), high * s // 100) for s in bounds[j]]
                row = scores[j]
                mine = np.flatnonzero((labels != label) & (ids != anchor) & (row >= min(x for x, _ in limits))
                                      & (row <= max(y for _, y in limits)))
                mine = mine[np.argsort(-row[mine], kind="stable")]
                falling = -row[mine]
                for slot, (x, y) in enumerate(limits):
                    a = int(np.searchsorted(falling, -y, "left"))
                    at = mine[a:min(a + k, int(np.searchsorted(falling, -x, "right")))]
                    if len(at):
                        kept[anchor, slot] = best(kept.get((anchor, slot)), row[at], ids[at], k)
        if kept:
            yield pa.record_batch([
                pa.array([a for (a, _), (s, _) in kept.items() for _ in s], pa.int64()),
                pa.array([p for (_, p), (s, _) in kept.items() for _ in s], pa.int32()),
                pa.array(np.concatenate([i for _, i in kept.values()])),
                pa.array(np.concatenate([s for s, _ in kept.values()]))], ["anchor_id", "slot", "id", "score"])

    return packed.crossJoin(F.broadcast(asked)).mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the tasks' rows per anchor and slot, with their rank from 1."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hard negatives for ``rows`` (id, label, v as of ``whole_vectors``); ``is_anchor`` is a
    condition on id. Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score."""
    packed = materialize(pack(rows), "negatives-packed")
    anchors = (rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x"))
               .select("id", "x.label", "x.v"))
    anchors = materialize(anchors, "negatives-anchors")
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    each = 8 * (-(-(size["d"] or 0) // GROUP) * GROUP) + 64 + 16 * positives
    passes = max(1, -(-size["n"] * each * 2 // broadcast_bytes))
    out = None
    for i in range(passes):
        own = anchors if passes == 1 else anchors.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == i)
        n = -(-size["n"] // passes)
        first = blocks(own.withColumn("bounds", F.array().cast("array<bigint>")), n)
        best_rows = materialize(ranked(search(packed, first, "positives", positives), positives), "negatives-positives")
        bounds = (best_rows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("x"))
                  .select(F.col("anchor_id").alias("id"), F.transform("x", lambda s: s["score"]).alias("bounds")))
        second = blocks(own.join(bounds, "id"), n)
        worst = ranked(search(packed, second, "negatives", negatives, low, high), negatives)
        named = best_rows.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"),
                                 F.col("score").alias("positive_score"))
        part = worst.join(named, ["anchor_id", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"))
        if passes > 1:
            part = materialize(part, "negatives-found")
        out = part if out is None else out.unionByName(part)
    return out
