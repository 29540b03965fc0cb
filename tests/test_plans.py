import random
import statistics

import pandas as pd
import pytest
from pyspark.sql.functions import lit as F_lit

from evalkit.operators import catalog as K
from evalkit.plans.ordering import exact_median, exact_medians, global_index, running_sum, running_sums, successors


def test_global_index_is_a_total_order(spark):
    rng = random.Random(1)
    vals = [rng.randint(0, 50) for _ in range(1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v int")
    got = global_index(df, ["v", "i"], num_partitions=7).collect()
    want = {i: pos for pos, (i, _) in enumerate(sorted(enumerate(vals), key=lambda p: (p[1], p[0])))}
    assert {r.i: r.gidx for r in got} == want


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_global_index_beyond_the_range_sample(spark, reuse, monkeypatch, tmp_path):
    """More rows than range partitioning samples, five distinct order values and a column
    that is not part of the order; with and without exchange reuse and adaptive plans."""
    from pyspark.sql import functions as F
    from evalkit.plans import ordering
    monkeypatch.setattr(ordering, "scratch_path", lambda s, name: f"{tmp_path}/{name}")
    n = 400_000
    df = spark.range(n).select("id", (F.col("id") % 5).alias("v"), F.lit("x").alias("extra"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled",)}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.adaptive.enabled", reuse)
    try:
        got = global_index(df, ["v"], num_partitions=16)
        r = got.agg(F.countDistinct("gidx").alias("d"), F.min("gidx").alias("lo"), F.max("gidx").alias("hi"),
                    F.count_if(F.floor(F.col("gidx") / (n // 5)) != F.col("v")).alias("wrong"),
                    F.countDistinct("id").alias("ids")).first()
        assert (r.d, r.lo, r.hi, r.wrong, r.ids) == (n, 0, n - 1, 0, n)
        # equal values are spread over the range partitions (a file each)
        written = spark.read.parquet(f"{tmp_path}/global-index")
        assert written.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < n / 8
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
        for k, v in old.items():
            spark.conf.set(k, v)


def test_medians_do_not_depend_on_exchange_reuse(spark):
    from pyspark.sql import functions as F
    df = spark.range(400_001).select((F.col("id") % 3).alias("g"), (F.col("id") / 400_000).alias("x"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.g: r.median for r in exact_median(df, ["g"], "x").collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = {g: statistics.median([i / 400_000 for i in range(g, 400_001, 3)]) for g in range(3)}
    assert all(abs(got[g] - want[g]) < 1e-12 for g in want)


def test_layout_starts_after_constants_of_any_type(spark):
    rows = [("m", i, c, f"layers.{i}.mlp.gate.weight{s}", t, "4, 4, 4", o, None)
            for i in range(2) for c, s, t, o in (("weight", "", "u4", i * 96), ("scale", "/scale", "f16", i * 96 + 32),
                                                 ("zero_point", "/zero_point", "u4", i * 96 + 64))]
    rows.append(("m", -1, "other", "shape_of", "i64", "1000", 200, 8000))
    cat = spark.createDataFrame([(str(n), *r) for n, r in enumerate(rows)], "id string, model string, layer int, "
                                "component string, name string, element_type string, shape string, offset long, size long")
    assert K.append_layout(cat).agg({"new_offset": "min"}).first()[0] == 8200
    strange = cat.withColumn("element_type", F_lit("mystery")).withColumn("size", F_lit(None).cast("long"))
    with pytest.raises(Exception, match="unknown element type"):
        K.append_layout(strange).collect()


def test_first_metadata_takes_one_batch_that_has_any(spark):
    meta = spark.createDataFrame([(0, None, None), (2, "c", "z"), (1, "b", None)], "batch int, a string, z string")
    assert tuple(K.first_metadata(meta).first()) == ("b", None)


def test_shared_prefixes_do_not_multiply_rows(spark):
    names = [f"self.model.layers.{i}.gate" for i in range(300)] + ["t"]
    files = [n + ".safetensors" for n in names[:200]] + [n + "_x" for n in names[200:300]]
    t = spark.createDataFrame([(0, n) for n in names], "batch int, saved_name string")
    f = spark.createDataFrame([(0, x) for x in files], "batch int, file string")
    got = {r.saved_name: r.match for r in K.mapping_file_lookup(t, f).collect()}
    assert [got[n] for n in names] == ["safetensors"] * 200 + ["prefix"] * 100 + ["missing"]


def test_running_sum_across_buckets(spark):
    rng = random.Random(2)
    rows = [(k, t, rng.randint(0, 9)) for k in range(5) for t in range(rng.randint(0, 60))]
    rows += [(99, t, 1) for t in range(500)]  # one hot key over many buckets
    df = spark.createDataFrame(rows, "k int, t int, v int")
    for inclusive in (True, False):
        got = running_sum(df, ["k"], "t", "v", "s", inclusive=inclusive, bucket_rows=7).toPandas()
        pdf = pd.DataFrame(rows, columns=["k", "t", "v"]).sort_values(["k", "t"])
        pdf["s"] = pdf.groupby("k")["v"].cumsum() - (0 if inclusive else pdf["v"])
        m = got.merge(pdf, on=["k", "t"], suffixes=("", "_w"))
        assert len(m) == len(rows) and (m["s"] == m["s_w"]).all()


def test_exact_median(spark):
    rng = random.Random(3)
    rows = [(g, rng.random() * 100) for g in "abc" for _ in range(rng.randint(1, 40))] + [("d", 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "x").collect()}
    for g in "abcd":
        assert abs(got[g] - statistics.median([x for k, x in rows if k == g])) < 1e-9
    (overall,) = exact_median(df, [], "x").collect()
    assert abs(overall.median - statistics.median([x for _, x in rows])) < 1e-9


def test_prefix_lookup_matches_brute_force(spark):
    names = ["t1", "t10", "t2", "t3", "t4", "t5"]
    files = ["t1_stats.bin", "t10", "t100.safetensors", "t2.safetensors", "t2", "t3x", "t3y", "t5"]
    t = spark.createDataFrame([(0, n) for n in names], "batch int, saved_name string")
    f = spark.createDataFrame([(0, x) for x in files], "batch int, file string")
    got = {r.saved_name: (r.file, r.match) for r in K.mapping_file_lookup(t, f).collect()}

    def brute(n):
        if n + ".safetensors" in files:
            return n + ".safetensors", "safetensors"
        if n in files:
            return n, "exact"
        m = sorted(x for x in files if x.startswith(n))
        return (m[0], "prefix") if m else (None, "missing")
    assert got == {n: brute(n) for n in names}


def test_exact_median_by_counts_and_stacked(spark):
    rng = random.Random(4)
    rows = [(g, rng.randint(0, 6), rng.random()) for g in "abc" for _ in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "g string, k int, x double")
    got = {r.g: r.m for r in exact_median(df, ["g"], "k", name="m", method="counts").collect()}
    for g in "abc":
        assert got[g] == statistics.median([k for h, k, _ in rows if h == g])
    both = {r.g: (r.mk, r.mx) for r in exact_medians(df, ["g"], ["k", "x"], ["mk", "mx"]).collect()}
    for g in "abc":
        assert both[g][0] == statistics.median([k for h, k, _ in rows if h == g])
        assert abs(both[g][1] - statistics.median([x for h, _, x in rows if h == g])) < 1e-12


def test_throughput_medians_exact_and_approx(spark):
    from evalkit.operators.summaries import throughput_by_prompt
    rows = [("p", t, e) for t, e in [(10, 1.0), (30, 2.0), (20, 0.0), (40, 4.0)]] + [("q", 5, 0.5)]
    df = spark.createDataFrame(rows, "prompt string, tokens int, elapsed double")
    ex = {r.prompt: (r.median_tps, r.median_elapsed, r.median_tokens) for r in throughput_by_prompt(df).collect()}
    assert ex["p"] == (statistics.median([10.0, 15.0, 0.0, 10.0]), 1.5, 25.0) and ex["q"] == (10.0, 0.5, 5.0)
    ap = {r.prompt: r.median_tokens for r in throughput_by_prompt(df, exact=False).collect()}
    assert ap["q"] == 5.0 and ap["p"] in (20.0, 30.0)


def test_hot_conversation_is_split_into_buckets(spark):
    """One conversation with most of the rows: the prefix sum is exact and no
    window partition holds more than one bucket of turns."""
    from pyspark.sql import functions as F

    from evalkit.operators.packing import pack_to_budget
    hot = spark.range(150_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                      F.lit("user").alias("role"), F.lit("abcdefgh").alias("text"))
    small = spark.range(2_000).select((F.col("id") % 50 + 2).alias("conv_id"), (F.col("id") / 50).cast("long")
                                      .alias("turn"), F.lit("user").alias("role"), F.lit("abcd").alias("text"))
    df = hot.unionByName(small)
    budget = 250_000  # hot: 2 tokens per turn -> 125,000 turns kept; small ones keep everything
    out = pack_to_budget(df, budget)
    got = out.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("tokens_before").alias("mx"))
    g = {r.conv_id: (r.n, r.mx) for r in got.collect()}
    assert g[1] == (125_000, 249_998)
    assert all(g[c] == (40, 39) for c in range(2, 52))
    buckets = out.filter("conv_id = 1").select(F.floor(F.col("turn") / 4096).alias("b")).groupBy("b").count()
    assert buckets.agg(F.max("count")).first()[0] <= 4096


def hand_sums(rows, inclusive=True):
    """Running sums over (key, order, tie, value), in Python's order with nulls first."""
    out, sums = {}, {}
    for i, (k, o, t, v) in sorted(enumerate(rows), key=lambda r: (r[1][1] is not None, r[1][1] or 0, r[1][2])):
        before = sums.get(k, 0)
        sums[k] = before + (v or 0)
        out[i] = sums[k] if inclusive else before
    return out


@pytest.mark.parametrize("orders", ["sparse", "timestamps", "one", "nulls", "dense"])
def test_running_sums_lose_no_row_whatever_the_orders(spark, orders):
    rng = random.Random(6)
    of = {"sparse": lambda i: i * 10**9, "timestamps": lambda i: 1_700_000_000_000 + rng.randrange(10**9), "one": lambda i: 5,
          "nulls": lambda i: None if i % 2 else i, "dense": lambda i: i}[orders]
    rows = [(None if i % 7 == 0 else ("hot" if i % 3 else f"k{i % 11}"), of(i), f"t{i:05d}", rng.choice([None, 1, 2, 5])) for i in range(900)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, o long, t string, v int")
    # ties are ordered by md5 of the tie columns
    import hashlib
    hashed = [(k, o, hashlib.md5(t.encode()).hexdigest(), v) for k, o, t, v in rows]
    totals = {}
    for k, _, _, v in rows:
        totals[k] = totals.get(k, 0) + (v or 0)
    for inclusive in (True, False):
        for size in (20, 100_000):
            from pyspark.sql import functions as F
            got = running_sums(df, ["k"], "o", {"s": F.col("v")}, inclusive, size, totals={"s": "all"}, ties=["t"]).collect()
            assert {r.i: r.s for r in got} == hand_sums(hashed, inclusive) and len(got) == len(rows)
            assert all(r["all"] == totals[r.k] for r in got)


def test_buckets_hold_about_as_many_rows_on_sparse_orders(spark):
    from pyspark.sql import functions as F
    from evalkit.plans.ordering import cut_keys
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                    (F.col("id") * F.col("id") * 1_000).alias("o"))
    cut, large = cut_keys(df, ["k"], "o", [], bucket_rows=1000)
    assert [r[0] for r in large.select("_ek_k0").collect()] == ["hot"]
    per = [r["count"] for r in cut.filter("k = 'hot'").groupBy("_ek_b").count().collect()]
    assert sum(per) == 20_000 and max(per) <= 1100 and len(per) >= 18
    assert cut.count() == 60_000


def test_sums_without_rows_or_columns_beside_the_key(spark):
    from pyspark.sql import functions as F
    assert running_sums(spark.createDataFrame([], "k int, o int"), ["k"], "o", {"s": F.lit(1)}).count() == 0
    one = running_sums(spark.createDataFrame([(None, None)], "k int, o int"), ["k"], "o", {"s": F.lit(1)}).collect()
    assert [tuple(r) for r in one] == [(None, None, 1)]


MEDIAN_ROWS = {
    "outlier": [1e12] + [random.Random(1).random() * 100 for _ in range(5000)],
    "ties": [3.0] * 3000 + [float(i) for i in range(2000)],
    "two values": [1.0, 2.0] * 2500,
    "powers": [10.0 ** random.Random(i).uniform(-300, 300) for i in range(3001)],
    "negative": [-float(i) ** 3 for i in range(2500)] + [0.0, -0.0],
    "infinite": [float("inf")] * 40 + [float("-inf")] * 40 + [float(i) for i in range(1001)],
}


@pytest.mark.parametrize("kind", MEDIAN_ROWS)
@pytest.mark.parametrize("n", [0, 1])
def test_medians_by_splitters(spark, kind, n):
    """Many rounds: few values may be ordered at once, few are drawn."""
    values = MEDIAN_ROWS[kind][n:]
    rows = [("a", x) for x in values] + [(None, 5.0), (None, 7.0), ("b", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r.g: r.m for r in exact_medians(df, ["g"], ["x"], ["m"], select_rows=60, drawn=100).collect()}
    assert got == {"a": pytest.approx(statistics.median(values), rel=1e-15), None: 6.0, "b": 1.0}


def test_no_task_orders_more_than_its_share_with_an_outlier(spark, monkeypatch):
    """One value of 1e12 among many small ones: what is left between the splitters stays small."""
    from pyspark.sql import functions as F
    from evalkit.plans import ordering
    seen, middle = [], ordering._middle_values

    def watched(vals, keys, state):
        seen.append(ordering._between(vals, state.filter("_v1 IS NULL"), keys).count())
        return middle(vals, keys, state)
    monkeypatch.setattr(ordering, "_middle_values", watched)
    df = spark.range(400_000).select((F.col("id") % 100_003 / 1000.0).alias("x")).union(spark.range(1).select(F.lit(1e12)))
    want = statistics.median([i % 100_003 / 1000.0 for i in range(400_000)] + [1e12])
    assert exact_median(df, [], "x", select_rows=5000, drawn=4000).first().median == pytest.approx(want)
    assert len(seen) == 1 and seen[0] <= 5000


def test_nan_is_the_largest_value(spark):
    rows = [(float("nan"),)] * 3 + [(float(i),) for i in range(4)]
    assert exact_median(spark.createDataFrame(rows, "x double"), [], "x").first().median == 3.0
    assert exact_median(spark.createDataFrame([], "x double"), [], "x").first().median is None


@pytest.mark.parametrize("parts", [1, 7])
def test_successors_match_brute_force(spark, parts):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab/") for _ in range(rng.randrange(1, 6)))
    left = {(rng.choice([0, 1, None]), word()) for _ in range(150)} | {(0, None), (2, "zz"), (3, "a")}
    right = {(rng.choice([0, 1, None, 2]), word()) for _ in range(120)} | {(0, None)}
    t = spark.createDataFrame(list(left), "s int, k string")
    f = spark.createDataFrame(list(right), "s int, o string")
    got = {(r.s, r.k): r.n for r in successors(t, f, ["s"], "k", "o", "n", num_partitions=parts).collect()}
    assert got == {(s, k): min((o for z, o in right if z == s and o is not None and k is not None and o >= k), default=None)
                   for s, k in left}
