import random

from pyspark.sql import functions as F

from evalkit.functions import tensors as TF
from evalkit.operators import tensors as TO


def test_unpack_low_nibble_first(spark):
    df = spark.createDataFrame([(bytes([0x2F, 0x10]),)], "b binary")
    assert df.select(TF.unpack_uint4("b").alias("v")).first().v == [15, 2, 0, 1]


def test_quantise_error_bound_and_edges(spark):
    rng = random.Random(5)
    vecs = [[rng.uniform(-2, 2) for _ in range(40)] for _ in range(30)]
    vecs += [[0.7] * 16, [-1.5, -0.2, -3.0] * 6, [0.0] * 16, [1.0, 2.0, 3.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id int, v array<double>")
    g = TO.quantise_groups(df, "v", 16, "id").collect()
    assert len(g) == sum((len(v) + 15) // 16 for v in vecs)
    for r in g:
        assert 0 <= r.zero_point <= 15 and all(0 <= q <= 15 for q in r.q)
        assert r.max_err <= r.scale / 2 + 1e-9


def test_second_dequantisation_with_neutral_params_is_identity(spark):
    df = spark.createDataFrame([([3, 15, 0, 7], [8, 2], [0.5, 0.25])], "q array<int>, zp array<int>, s array<double>")
    d = df.select(TO.dequantise("q", "zp", "s", 2).alias("d"))
    ones, zeros = TO.neutral_params(F.lit(2))
    r = d.select("d", TO.dequantise("d", zeros, ones, 2).alias("e")).first()
    assert r.d == [-2.5, 3.5, -0.5, 1.25] and r.e == r.d


def test_shape_and_layer_helpers(spark):
    df = spark.createDataFrame([("128, 16, 128", "uint4", "model.layers.7.mlp.gate.weight"),
                                ("3", "float16", "MatMul_9")], "s string, e string, n string")
    got = df.select(TF.shape_elements("s").alias("el"), TF.tensor_bytes("s", "e").alias("b"),
                    TF.layer_number("n").alias("l"), TF.component_class("n").alias("c")).collect()
    assert [(r.el, r.b, r.l, r.c) for r in got] == [(262144, 131072, 7, "weight"), (3, 6, -1, "weight")]


def test_channel_stats_and_layer_sensitivity(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    rows = [(int(lbl), [float(x) for x in rng.normal(size=8)]) for lbl in (0, 0, 0, 1, 1) for _ in range(3)]
    df = spark.createDataFrame(rows, "label int, v array<double>")
    st = TO.channel_stats(df, "v", by=["label"])
    got = {r.label: r for r in TO.layer_sensitivity(st, ["label"]).collect()}
    for lbl in (0, 1):
        m = np.array([v for k, v in rows if k == lbl])
        assert abs(got[lbl].max_activation_variance - m.var(axis=0).max()) < 1e-9
        assert abs(got[lbl].mean_activation_variance - m.var(axis=0).mean()) < 1e-9
        assert abs(got[lbl].mean_activation_magnitude - np.abs(m).mean()) < 1e-9
        assert abs(got[lbl].hessian_input_activation - (m * m).mean()) < 1e-9


def test_unpacking_takes_time_in_proportion_to_the_length(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(bytes(i % 256 for i in range(n // 2)),)], "b binary")
        start = time.time()
        values = df.select(TF.unpack_uint4("b").alias("v")).first().v
        assert values[:6] == [0, 0, 1, 0, 2, 0] and len(values) == n
        return time.time() - start
    seconds(1024)
    short, long = min(seconds(65_536) for _ in range(3)), min(seconds(1_048_576) for _ in range(2))
    assert short < 1 and long < 16 * short + 3


def test_unpack_edges(spark):
    df = spark.createDataFrame([(b"",), (None,), (bytes([0xF0]),)], "b binary")
    assert [r.v for r in df.select(TF.unpack_uint4("b").alias("v")).collect()] == [[], None, [0, 15]]
    assert [r.v for r in df.select(TF.unpack_uint4("b", 1).alias("v")).collect()] == [[], None, [0]]


def test_large_tensors_are_cut_into_chunks(spark):
    rows = [(1, bytes(i * 7 % 256 for i in range(1001))), (2, b""), (3, None), (4, b"x" * 64)]
    df = spark.createDataFrame(rows, "id int, packed binary")
    cut = TF.packed_chunks(df, "packed", chunk_bytes=64).withColumn("v", TF.unpack_uint4("packed")).collect()
    for i, packed in rows[:2] + rows[3:]:
        own = sorted((r for r in cut if r.id == i), key=lambda r: r.chunk)
        assert [r.first for r in own] == [128 * k for k in range(len(own))] and all(len(r.packed) <= 64 for r in own)
        assert [x for r in own for x in r.v] == [x for b in packed for x in (b & 15, b >> 4)]
    assert {r.id for r in cut} == {1, 2, 4} and len(cut) == 16 + 1 + 1


def hand_moments(vectors, channel):
    import math
    seen = [v[channel] for v in vectors if v is not None and len(v) > channel]
    x = [a for a in seen if a is not None]
    if not x:
        return (None, None, None, None, len(seen))
    mean = math.fsum(x) / len(x)
    return (max(map(abs, x)), math.fsum(map(abs, x)) / len(x), math.fsum((a - mean) ** 2 for a in x) / len(x),
            math.fsum(a * a for a in x) / len(x), len(seen))


def test_moment_vectors_match_the_values(spark):
    import pytest
    rng = random.Random(11)
    vectors = [(rng.choice(["a", "b", None]), [rng.choice([None, rng.gauss(1e6, 1)]) for _ in range(rng.randrange(9))]) for _ in range(300)]
    vectors += [("c", None), ("c", [None, None]), ("d", [1.5])]
    df = spark.createDataFrame(vectors, "g string, v array<double>").repartition(6)
    got = {(r.g, r.channel): (r.max_abs, r.mean_abs, r.var_pop, r.mean_sq, r.n) for r in TO.channel_stats(df, "v", by=["g"]).collect()}
    for g in ("a", "b", None, "c", "d"):
        own = [v for k, v in vectors if k == g]
        for channel in range(max(len(v) for v in own if v is not None)):
            want = hand_moments(own, channel)
            assert [x is None for x in got[g, channel]] == [x is None for x in want]
            # deviations stay exact although the mean is a million times as large
            assert [x for x in got[g, channel] if x is not None] == pytest.approx([x for x in want if x is not None], rel=1e-9)
    assert len(got) == sum(max(len(v) for k, v in vectors if k == g and v is not None) for g in ("a", "b", None, "c", "d"))
    assert TO.channel_stats(df.limit(0), "v", by=["g"]).count() == 0
    assert TO.channel_stats(spark.createDataFrame([([1.0, float("nan")],), ([3.0, 2.0],)], "v array<double>"), "v").filter(
        "channel = 0").first().var_pop == 1.0
