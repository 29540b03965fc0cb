"""Group-quantised vectors (T2-T4) and per-channel statistics.

Vectors stay arrays inside rows; group work uses higher-order functions
(``transform``/``slice``/``aggregate``), so it is a narrow projection with no
shuffle. Channel statistics merge moment vectors inside the tasks, so the shuffle
carries one row per channel, group and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
UINT4_MAX = 15
# -----------------------------------------------------------------------------


def dequantise(q: Column | str, zero_points: Column | str, scales: Column | str, group_size: int) -> Column:
    """(q - zero_point[g]) * scale[g] per element, g = i // group_size, as
    FloatType (Spark has no float16)."""
    q = F.col(q) if isinstance(q, str) else q
    zp = F.col(zero_points) if isinstance(zero_points, str) else zero_points
    sc = F.col(scales) if isinstance(scales, str) else scales
    g = lambda i: F.floor(i / group_size).cast("int") + 1
    return F.transform(q, lambda x, i: ((x.cast("double") - F.element_at(zp, g(i)).cast("double"))
                                        * F.element_at(sc, g(i)).cast("double")).cast("float"))


def neutral_params(n_groups: Column | str) -> tuple[Column, Column]:
    """Scale of ones and zero point of zeros, so a second dequantisation is a no-op."""
    n = F.col(n_groups) if isinstance(n_groups, str) else n_groups
    return F.array_repeat(F.lit(1.0).cast("float"), n.cast("int")), F.array_repeat(F.lit(0), n.cast("int"))


def quantise_groups(df: DataFrame, vec: str, group_size: int, key: str) -> DataFrame:
    """T4: asymmetric 4-bit quantisation per group of ``group_size`` values.
    Range widened to include 0; scale = (hi - lo) / 15 (1 for an all-zero group);
    zero point = clamp(round(-lo / scale)); q = clamp(round(x / scale) + zp);
    round is floor(x + 0.5). One row per (key, group) with scale, zero point,
    codes and the round-trip error (max |x - deq| and mean square)."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    n_groups = F.ceil(F.size(F.col(vec)) / F.lit(group_size)).cast("int")
    g = (df.select(key, v.alias("_v"), n_groups.alias("_ng"))
         .select(key, "_v", F.explode(F.sequence(F.lit(0), F.col("_ng") - 1)).alias("grp"))
         .withColumn("x", F.slice("_v", F.col("grp") * group_size + 1, F.lit(group_size)))
         .drop("_v"))
    g = (g.withColumn("lo", F.least(F.array_min("x"), F.lit(0.0)))
         .withColumn("hi", F.greatest(F.array_max("x"), F.lit(0.0))))
    g = g.withColumn("scale", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / UINT4_MAX)
                     .otherwise(F.lit(1.0)))
    clamp = lambda e: F.least(F.greatest(e, F.lit(0)), F.lit(UINT4_MAX))
    g = g.withColumn("zero_point", clamp(F.floor(-F.col("lo") / F.col("scale") + 0.5)).cast("int"))
    g = g.withColumn("q", F.transform("x", lambda x: clamp(F.floor(x / F.col("scale") + 0.5) + F.col("zero_point"))
                                      .cast("int")))
    deq = F.transform("q", lambda q: (q - F.col("zero_point")) * F.col("scale"))
    err = F.zip_with("x", deq, lambda a, b: F.abs(a - b))
    g = (g.withColumn("max_err", F.array_max(err))
         .withColumn("mse", F.aggregate(err, F.lit(0.0), lambda a, e: a + e * e) / F.size("x")))
    return g.drop("x", "lo", "hi")


MOMENTS = ["n", "seen", "mean", "m2", "max_abs", "sum_abs", "sum_sq"]
#: Groups whose moment vectors a task keeps before it passes them on.
KEPT_GROUPS = 4096


def _vector_moments(n_by: int):
    """A task's function: moment vectors per group of its rows (nested, so that it travels by
    value). Columns are the group's key as JSON, the ``n_by`` group columns and the vector."""
    names, kept_groups = list(MOMENTS), KEPT_GROUPS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def of(values):
            """Moments of the rows of one group in one batch."""
            lengths = values.value_lengths().to_numpy(zero_copy_only=False)
            flat = values.flatten()
            place = np.arange(int(lengths.max(initial=0)))[None, :] < lengths[:, None]
            x, known = np.zeros(place.shape), np.zeros(place.shape, bool)
            known[place] = flat.is_valid().to_numpy(zero_copy_only=False)
            x[place] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            n = known.sum(0)
            with np.errstate(all="ignore"):
                mean = np.where(n > 0, np.where(known, x, 0.0).sum(0) / np.maximum(n, 1), 0.0)
                apart = np.where(known, x - mean, 0.0)
                size = np.where(known, np.abs(x), 0.0)
                return [n, place.sum(0), mean, (apart * apart).sum(0), size.max(0, initial=0.0), size.sum(0), (size * size).sum(0)]

        def merged(a, b):
            """Moments of two sets of rows together (the parallel-variance rule)."""
            wide = max(len(a[0]), len(b[0]))
            a, b = ([np.concatenate([v, np.zeros(wide - len(v), v.dtype)]) for v in side] for side in (a, b))
            n = a[0] + b[0]
            with np.errstate(all="ignore"):
                delta, share = b[2] - a[2], b[0] / np.maximum(n, 1)
                # a side without values leaves the other's mean as it is
                mean = np.where(a[0] == 0, b[2], np.where(b[0] == 0, a[2], a[2] + delta * share))
                m2 = a[3] + b[3] + np.where((a[0] == 0) | (b[0] == 0), 0.0, delta * delta * a[0] * share)
                return [n, a[1] + b[1], mean, m2, np.maximum(a[4], b[4]), a[5] + b[5], a[6] + b[6]]

        def rows(kept):
            keys = list(zip(*[k for k, _ in kept.values()])) if n_by else []
            columns = [pa.array(c, t) for c, t in zip(keys, by_types)]
            columns += [pa.array([m[i].tolist() for _, m in kept.values()], pa.list_(pa.int64() if i < 2 else pa.float64()))
                        for i in range(len(names))]
            return pa.record_batch(columns, [*by_names, *names])

        kept, by_types, by_names = {}, [], []
        for batch in batches:
            by_types, by_names = [batch.schema.field(i + 1).type for i in range(n_by)], batch.schema.names[1:n_by + 1]
            groups = batch.column(0).dictionary_encode()
            codes, values = groups.indices.to_numpy(zero_copy_only=False), batch.column(n_by + 1)
            for code, name in enumerate(groups.dictionary.to_pylist()):
                at = np.flatnonzero(codes == code)
                own = of(values if len(at) == len(codes) else values.take(pa.array(at)))
                if name in kept:
                    kept[name] = (kept[name][0], merged(kept[name][1], own))
                else:
                    kept[name] = (tuple(batch.column(i + 1)[int(at[0])].as_py() for i in range(n_by)), own)
            if len(kept) > kept_groups:
                yield rows(kept)
                kept = {}
        if kept:
            yield rows(kept)
    return run


def _merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments per key from those of parts, by the parallel-variance rule."""
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("seen"),
                     *[F.lit(0.0).alias(c) for c in MOMENTS[2:]])

    def add(a, b):
        n = a["n"] + b["n"]
        delta = b["mean"] - a["mean"]
        mean = F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"]).otherwise(a["mean"] + delta * b["n"] / n)
        between = F.when((a["n"] == 0) | (b["n"] == 0), 0.0).otherwise(delta * delta * a["n"] * b["n"] / n)
        return F.struct(n.alias("n"), (a["seen"] + b["seen"]).alias("seen"), mean.alias("mean"),
                        (a["m2"] + b["m2"] + between).alias("m2"), F.greatest(a["max_abs"], b["max_abs"]).alias("max_abs"),
                        (a["sum_abs"] + b["sum_abs"]).alias("sum_abs"), (a["sum_sq"] + b["sum_sq"]).alias("sum_sq"))

    got = parts.groupBy(*keys).agg(F.aggregate(F.collect_list(F.struct(*MOMENTS)), first, add).alias("_m"))
    return got.select(*keys, "_m.*")


def channel_stats(df: DataFrame, vec: str, by: list[str] | None = None, spread: int = 64) -> DataFrame:
    """Per channel (and per ``by`` group, e.g. layer): max |x|, mean |x|,
    population variance, mean square over the sample vectors.

    Every task turns the vectors of a batch into moment vectors (count, mean, sum of squared
    deviations, maximum, sums) and merges those of its batches, so only one short row per
    group and task is passed on, and no row per element is made. These parts are merged by
    the parallel-variance rule, first in ``spread`` shares, then together. Null elements
    count in ``n`` only; vectors may differ in length; null vectors are passed over."""
    by = list(by or [])
    own = F.to_json(F.struct(*[F.col(c) for c in by], F.lit(0).alias("_")), {"ignoreNullFields": "false"})
    rows = df.filter(F.col(vec).isNotNull()).select(own.alias("_g"), *by, F.col(vec).alias("_v"))
    types = "".join(f"`{c}` {t}, " for c, t in df.select(*by).dtypes)
    schema = types + "n array<bigint>, seen array<bigint>, " + ", ".join(f"{c} array<double>" for c in MOMENTS[2:])
    parts = rows.mapInArrow(_vector_moments(len(by)), schema).withColumn("_share", F.pmod(F.spark_partition_id(), F.lit(spread)))
    each = parts.select(*by, "_share", F.posexplode(F.arrays_zip(*MOMENTS)).alias("channel", "_m")).select(*by, "_share", "channel", "_m.*")
    merged = _merge_moments(_merge_moments(each, [*by, "_share", "channel"]), [*by, "channel"])
    known = F.col("n") > 0
    return merged.select(
        *by, "channel", F.when(known, F.col("max_abs")).alias("max_abs"), F.when(known, F.col("sum_abs") / F.col("n")).alias("mean_abs"),
        F.when(known, F.col("m2") / F.col("n")).alias("var_pop"), F.when(known, F.col("sum_sq") / F.col("n")).alias("mean_sq"),
        F.col("seen").alias("n"))


def layer_sensitivity(stats: DataFrame, by: list[str]) -> DataFrame:
    """A12 per-layer metrics from channel statistics: max and mean activation
    variance, mean activation magnitude, and the mean square (a Hessian-trace
    proxy for input activations). One small aggregate per layer."""
    return stats.groupBy(*by).agg(
        F.max("var_pop").alias("max_activation_variance"),
        F.avg("var_pop").alias("mean_activation_variance"),
        F.avg("mean_abs").alias("mean_activation_magnitude"),
        F.avg("mean_sq").alias("hessian_input_activation"),
        F.count(F.lit(1)).alias("channels"))
