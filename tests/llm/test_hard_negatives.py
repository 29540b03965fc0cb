"""Hard negatives, against scores computed pair by pair."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalkit.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(n=700, width=20, seed=3):
    r = random.Random(seed)
    return [(i, [round(r.uniform(-1, 1), 3) for _ in range(width)], r.randrange(3)) for i in range(n)]


def by_hand(rows, every=50, positives=5, negatives=10):
    ok = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, l in rows
          if i is not None and l is not None and v is not None
          and all(x is not None and math.isfinite(x) and abs(x) * 256 < 2**24 for x in v)]
    out, anchors = [], {}
    for i, l, v in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (l, v)), (l, v))
    for a, (al, av) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(av, v)), i, l) for i, l, v in ok if i != a]
        own = sorted((s, i) for s, i, l in scored if l == al)[:positives]
        for ps, p in own:
            fit = sorted((s, i) for s, i, l in scored if l != al and 30 * -ps <= 100 * -s <= 90 * -ps)[:negatives]
            out += [(a, p, k, i, -ps, -s) for k, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=50, **options):
    df = spark.createDataFrame(rows, SCHEMA) if isinstance(rows, list) else rows
    whole = H.whole_vectors(df.repartition(5), "vec_id", "embedding", F.col("label"))
    return sorted(map(tuple, H.mine(whole, F.col("id") % every == 0, **options).collect()))


def test_scores_are_whole_inner_products():
    r = np.random.default_rng(1)
    for low, high, width in ((-256, 256, 64), (0, 2, 8), (-1, 0, 16), (-2**24 + 1, 2**24, 40), (0, 1, 24), (-5, 900, 0)):
        rows, anchors = r.integers(low, high, (300, width)), r.integers(low, high, (7, width))
        assert (H.exact_scores(H.bit_planes(rows), anchors) == rows @ anchors.T).all()


def test_shorter_vectors_are_filled_with_zeros():
    got = H.matrix(pa.array([[1, 2, 3], [], list(range(9))], pa.list_(pa.int64())))
    assert got.shape == (3, 16) and got[0, :4].tolist() == [1, 2, 3, 0] and not got[1].any() and got[2, 8] == 8
    assert (H.exact_scores(H.bit_planes(got), got[:, :8]) == got[:, :8] @ got[:, :8].T).all()


def test_matches_pairs_by_hand(spark):
    rows = table()
    expected = by_hand(rows)
    assert len(expected) > 100 and mined(spark, rows) == expected


def test_several_passes_give_the_same(spark):
    rows = table(300)
    assert mined(spark, rows, every=10, broadcast_bytes=4000) == by_hand(rows, 10)


def test_ties_and_a_hot_label(spark):
    rows = [(i, [0.5, 0.25], 1) if i % 3 else (i, [0.25, 0.25], 2) for i in range(400)]
    assert mined(spark, rows) == by_hand(rows)


def test_edges(spark):
    good = table(120, 9)
    odd = [(None, [1.0], 1), (1001, None, 1), (1002, [1.0], None), (1003, [None, 1.0], 1), (1004, [float("nan")], 1),
           (1005, [float("inf")], 1), (1006, [], 1), (1000, [], 2), (1007, [1e30], 1), (1008, [0.1] * 70, 0),
           (50, [0.3, 0.2], 0), (50, [0.3, 0.2], 0), (7, good[7][1], good[7][2])]
    rows = good + odd
    assert mined(spark, rows) == by_hand(rows)
    named = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("id"), F.lit("y").alias("v"), F.lit(1).alias("n"))
    assert mined(spark, named) == by_hand(rows)
    assert mined(spark, spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1)]) == []


@pytest.mark.parametrize("k", [1, 3, 50])
def test_leading_keeps_the_first_of_equal_scores(k):
    r = np.random.default_rng(k)
    scores = r.integers(0, 4, 40)
    assert sorted(H.leading(scores, k).tolist()) == sorted(sorted(range(40), key=lambda i: (-scores[i], i))[:k])
