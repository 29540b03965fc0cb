"""Global positions, running sums and exact medians without a one-partition window.

* ``global_index``: a 0-based position in a total order. The table is range
  partitioned on the order and a tie column (so equal values are split across
  partitions), sorted within partitions, numbered locally, written once to the
  shared folder, and shifted by the row counts of the earlier partitions. Only one
  row per partition reaches the small offset table.
* ``successors``: an ordered join with the next value of another table, by one range layout.
* ``cut_keys`` and ``running_sums``: per-key prefix sums. Keys with many rows are cut into
  buckets at places drawn from a bounded sample of the rows, so buckets hold about as many
  rows whatever the order values are; the window runs per (key, bucket), and the totals of
  earlier buckets, a table bounded by the sample, are added.
* ``exact_medians``: the middle value(s) per group, by rank selection: two splitters
  from a bounded sample enclose the middle, the values outside are only counted, and what
  is left is cut down again until it is small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalkit.plans.joins import bounded_broadcast
from evalkit.session import scratch_path

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row
#: Rows of a bucket of a running sum that are aimed at, and rows drawn to find where to cut.
BUCKET_ROWS, DRAWN_ROWS = 65_536, 1 << 18
#: Values of a group that are put in order in one task, and values drawn per group to enclose its middle.
SELECT_ROWS, SELECT_DRAWN = 65_536, 16_384


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def global_index(df: DataFrame, order_cols: Sequence[str | Column], name: str = "gidx",
                 num_partitions: int | None = None, materialize: bool = False) -> DataFrame:
    """Append ``name`` = 0-based position of each row in ``order_cols`` order.

    The range layout is evaluated once: rows are range partitioned, numbered within
    their partition and written to the shared folder, and both the per-partition
    offsets and the result read that copy, so they cannot disagree about where the
    ranges were cut. A per-row tie column follows the order columns, so rows with
    equal order values spread over partitions (their mutual order is arbitrary).
    ``materialize`` checkpoints the input first when it is expensive to recompute:
    range partitioning samples it in a job of its own."""
    order = _cols(order_cols)
    if materialize:
        df = df.checkpoint(eager=True)
    n = _num_partitions(df, num_partitions)
    ranged = (df.withColumn("_ek_tie", F.xxhash64(F.monotonically_increasing_id()))
              .repartitionByRange(n, *order, F.col("_ek_tie")).sortWithinPartitions(*order, F.col("_ek_tie"))
              .drop("_ek_tie").withColumn("_ek_mid", F.monotonically_increasing_id()))
    path = scratch_path(df.sparkSession, "global-index")
    ranged.write.parquet(path)
    placed = (df.sparkSession.read.schema(ranged.schema).parquet(path)
              .withColumn("_ek_pid", F.shiftright("_ek_mid", _LOCAL_BITS))
              .withColumn("_ek_loc", F.col("_ek_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)))
    before = Window.orderBy("_ek_pid").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per range partition: a proven bound, so broadcasting is safe
    offsets = (placed.groupBy("_ek_pid").agg(F.count(F.lit(1)).alias("_ek_n"))
               .select("_ek_pid", F.coalesce(F.sum("_ek_n").over(before), F.lit(0)).alias("_ek_off")))
    return (placed.join(F.broadcast(offsets), "_ek_pid")
            .withColumn(name, (F.col("_ek_off") + F.col("_ek_loc")).cast("long"))
            .drop("_ek_mid", "_ek_pid", "_ek_loc", "_ek_off"))


def successors(rows: DataFrame, others: DataFrame, scope: Sequence[str], key: str, other: str,
               name: str, num_partitions: int | None = None) -> DataFrame:
    """Ordered join: ``rows`` (scope columns, ``key``) with the smallest ``other`` of the same
    scope that is not below the key, or null.

    Both sides share one written range layout on (scope, value). Within a range the next
    ``other`` is the last one met from the end; what follows a range is carried over from a
    table with one row per range. Scopes of any size are thus spread over all ranges. Both
    sides should be distinct; null keys have no successor, null scopes are a scope."""
    scope = list(scope)
    n = _num_partitions(rows, num_partitions)
    side = lambda df, value, kind: df.select(*scope, F.col(value).alias("_ek_x"), F.lit(kind).alias("_ek_kind"))
    both = side(rows, key, 0).unionByName(side(others.filter(F.col(other).isNotNull()), other, 1))
    order = [*[F.col(c) for c in scope], F.col("_ek_x"), F.col("_ek_kind")]
    ranged = (both.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_ek_mid", F.monotonically_increasing_id()))
    placed = _written(ranged, "successors").withColumn("_ek_pid", F.shiftright("_ek_mid", _LOCAL_BITS))
    met = F.when(F.col("_ek_kind") == 1, F.struct(*scope, F.col("_ek_x").alias("_ek_next")))
    back = Window.partitionBy("_ek_pid").orderBy(F.col("_ek_mid").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.orderBy(F.col("_ek_pid").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: its first ``other``, and from that the first one after every range
    carried = (placed.groupBy("_ek_pid").agg(F.min_by(met, F.when(F.col("_ek_kind") == 1, F.col("_ek_mid"))).alias("_ek_first"))
               .select("_ek_pid", F.last("_ek_first", ignorenulls=True).over(later).alias("_ek_after")))
    found = placed.withColumn("_ek_s", F.last(met, ignorenulls=True).over(back)).filter("_ek_kind = 0")
    found = found.join(F.broadcast(carried), "_ek_pid").withColumn("_ek_s", F.coalesce("_ek_s", "_ek_after"))
    same = F.col("_ek_x").isNotNull()
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col("_ek_s")[c])
    return found.select(*scope, F.col("_ek_x").alias(key), F.when(same, F.col("_ek_s._ek_next")).alias(name))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Keys are equal, null with null."""
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def tie_of(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """What orders rows of one key and order value: md5 over the given columns (all others, if
    none are given). Rows equal in them are interchangeable."""
    names = [c for c in (df.columns if columns is None else columns) if c in df.columns]
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]))


def cut_keys(df: DataFrame, keys: Sequence[str], order_col: str, ties: Sequence[str] | None = None,
             bucket_rows: int = BUCKET_ROWS, drawn_rows: int = DRAWN_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with ``_ek_t`` (the tie) and ``_ek_b`` (the bucket, from 0), and the keys that are
    cut (``_ek_k0`` .. and their bounds), or None if there are none.

    At most about ``drawn_rows`` rows are drawn from the table. A key with more of them than
    two buckets should hold is cut at every so many of its drawn places, so sparse, clustered
    and repeated order values are dealt alike. The bounds take no more rows than were drawn,
    which bounds their broadcast. Null keys are a key of their own; null orders come first."""
    keys = list(keys)
    tied = df.withColumn("_ek_t", tie_of(df, ties) if ties is not None else
                         tie_of(df, [c for c, t in df.dtypes if "<" not in t]))
    rows = df.count()
    if rows <= bucket_rows:
        return tied.withColumn("_ek_b", F.lit(0)), None
    place = F.struct(F.col(order_col).alias("o"), F.col("_ek_t").alias("t"))
    rate = min(1.0, drawn_rows / rows)
    each = max(1, int(bucket_rows * rate))
    names = [f"_ek_k{i}" for i in range(len(keys))]
    large = (tied.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], place.alias("_ek_at")).sample(rate, seed=17)
             .groupBy(*names).agg(F.sort_array(F.collect_list("_ek_at")).alias("_ek_at")).filter(F.size("_ek_at") > 2 * each)
             .select(*names, F.array_distinct(F.filter("_ek_at", lambda x, i: i % each == each - 1)).alias("_ek_cuts")))
    large = _written(large, "bucket-bounds")
    if large.isEmpty():
        return tied.withColumn("_ek_b", F.lit(0)), None
    # the number of bounds up to a place, by halving
    steps = F.array(*[F.lit(1 << i) for i in range(drawn_rows.bit_length(), -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda n, s: n + F.when(F.get("_ek_cuts", n + s - 1) <= place, s).otherwise(0))
    cut = tied.join(F.broadcast(large), _same(keys, names), "left")
    bucket = F.when(F.col("_ek_cuts").isNotNull(), found).otherwise(F.lit(0))
    return cut.select(*tied.columns, bucket.alias("_ek_b")), large


def of_cut_keys(cut: DataFrame, large: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is cut."""
    names = [c for c in large.columns if c.startswith("_ek_k")]
    return cut.join(F.broadcast(large.drop("_ek_cuts")), _same(keys, names), "left_semi")


def with_offsets(cut: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``cut`` with the columns of ``offsets`` (one row per bucket of a cut key, so no more than
    were drawn: broadcast); null for keys that are not cut."""
    names = {k: f"_ek_o{i}" for i, k in enumerate([*keys, "_ek_b"])}
    right = offsets.select(*[F.col(names.get(c, c)) if c not in names else F.col(c).alias(names[c]) for c in offsets.columns])
    return cut.join(F.broadcast(right), _same([*keys, "_ek_b"], list(names.values())), "left").drop(*names.values())


def running_sums(df: DataFrame, keys: Sequence[str], order_col: str, values: dict[str, Column],
                 inclusive: bool = True, bucket_rows: int = BUCKET_ROWS,
                 keep_bucket: Callable[[Column], Column] | None = None,
                 totals: dict[str, str] | None = None, ties: Sequence[str] | None = None) -> DataFrame:
    """Several per-key running sums in the order of a column, with one exchange of the rows.

    Keys with many rows are cut into buckets (``cut_keys``). A window partitioned by (key,
    bucket) sums within buckets; the sums of the earlier buckets of a cut key, a small table,
    are added. ``inclusive=False`` sums the rows strictly before. ``keep_bucket`` receives
    what the first value's sum is before a bucket and may drop whole buckets before the
    window runs. ``totals`` names a column for the key's total of a value.

    No row is lost: null keys are one key, rows with a null order come first, rows with equal
    orders are ordered by ``ties`` (see ``tie_of``), null values count 0."""
    keys, totals = list(keys), totals or {}
    tmp = {n: f"_ek_v_{i}" for i, n in enumerate(values)}
    valued = df.select("*", *[F.coalesce(v, F.lit(0)).alias(tmp[n]) for n, v in values.items()])
    if ties is None:
        ties = [c for c, t in df.dtypes if "<" not in t]
    cut, large = cut_keys(valued, keys, order_col, ties, bucket_rows)
    offset = {n: F.lit(0) for n in values}
    if large is not None:
        sums = (of_cut_keys(cut, large, keys).groupBy(*keys, "_ek_b")
                .agg(*[F.sum(tmp[n]).alias(tmp[n] + "_s") for n in values]))
        earlier = Window.partitionBy(*keys).orderBy("_ek_b").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys)
        sums = sums.select(*keys, "_ek_b", *[F.coalesce(F.sum(tmp[n] + "_s").over(earlier), F.lit(0)).alias(tmp[n] + "_o")
                                             for n in values],
                           *[F.sum(tmp[n] + "_s").over(whole).alias(tmp[n] + "_w") for n in totals])
        cut = with_offsets(cut, sums, keys)
        offset = {n: F.coalesce(F.col(tmp[n] + "_o"), F.lit(0)) for n in values}
        if keep_bucket is not None:
            cut = cut.filter(keep_bucket(offset[next(iter(values))]))
    within = Window.partitionBy(*keys, "_ek_b")
    upto = within.orderBy(order_col, "_ek_t").rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    summed = [(offset[n] + F.coalesce(F.sum(tmp[n]).over(upto), F.lit(0))).alias(n) for n in values]
    for n, t in totals.items():
        own = F.sum(tmp[n]).over(within)
        summed.append((own if large is None else F.coalesce(F.col(tmp[n] + "_w"), own)).alias(t))
    return cut.select(*df.columns, *summed)


def running_sum(df: DataFrame, keys: Sequence[str], order_col: str, value: str | Column,
                name: str, inclusive: bool = True, bucket_rows: int = BUCKET_ROWS,
                keep_bucket: Callable[[Column], Column] | None = None, ties: Sequence[str] | None = None) -> DataFrame:
    """Per-key running sum of ``value`` in ``order_col`` order (see ``running_sums``)."""
    val = F.col(value) if isinstance(value, str) else value
    return running_sums(df, keys, order_col, {name: val}, inclusive, bucket_rows, keep_bucket, ties=ties)


def running_count(df: DataFrame, keys: Sequence[str], order_col: str, flag: Column, name: str,
                  inclusive: bool = True, bucket_rows: int = BUCKET_ROWS, ties: Sequence[str] | None = None) -> DataFrame:
    """Running count of rows where ``flag`` holds (a running sum of 0/1)."""
    return running_sum(df, keys, order_col, F.when(flag, 1).otherwise(0), name, inclusive, bucket_rows, ties=ties)


def exact_median(df: DataFrame, group_cols: Sequence[str], value: str, name: str = "median",
                 method: str = "select", materialize: bool = True, **limits) -> DataFrame:
    """Exact median per group (mean of the two middle values for even counts),
    as Python's ``statistics.median``.

    ``select``: rank selection by sampled splitters (``exact_medians``).
    ``counts``: rows are first counted per (group, value) with a partial
    aggregate; the cumulative counts then run over the distinct values only.
    Use it for integral values with a bounded domain (token or word counts)."""
    return exact_medians(df, group_cols, [value], [name], method, materialize, **limits)


def exact_medians(df: DataFrame, group_cols: Sequence[str], values: Sequence[str], names: Sequence[str] | None = None,
                  method: str = "select", materialize: bool = True, select_rows: int = SELECT_ROWS,
                  drawn: int = SELECT_DRAWN) -> DataFrame:
    """Exact medians of several columns per group in one pass: the columns are stacked as
    (metric, value) rows. The values are read a few times; with ``materialize`` the narrow
    (group, metric, value) table is written first, so an expensive upstream (e.g. scoring)
    runs once.

    A group with at most ``select_rows`` values is put in order at once. In a larger one,
    about ``drawn`` values give two splitters around the middle, one pass counts the values
    below, at, between and above them, and the part that holds the middle is what the next
    round works on, whatever the distribution: a group ends when a splitter is the middle or
    few enough values are left. NaN counts as the largest value; null groups are groups."""
    group_cols = list(group_cols)
    names = list(names or [f"median_{v}" for v in values])
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("m"), F.col(v).cast("double").alias("x"))
                                  for v, n in zip(values, names)]))
    keys = [f"_ek_g{i}" for i in range(len(group_cols))] + ["_ek_m"]
    vals = (df.select(*[F.col(g).alias(k) for g, k in zip(group_cols, keys)], stacked.alias("_ek_s"))
            .select(*keys[:-1], F.col("_ek_s.m").alias("_ek_m"), F.col("_ek_s.x").alias("_ek_x"))
            .filter(F.col("_ek_x").isNotNull()))
    state = None
    if method != "counts":
        if materialize:
            vals = _written(vals, "median-values")
        counted = vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ek_n"))
        state = _select_ranks(vals, counted, keys, select_rows, drawn)
    middle = _middle_values(vals, keys, state)
    # every group has its few metrics on one row
    picked = [F.max(F.when(F.col("_ek_m") == n, F.col("_ek_med"))).alias(n) for n in names]
    if group_cols:
        return middle.groupBy(*keys[:-1]).agg(*picked).select(
            *[F.col(k).alias(g) for g, k in zip(group_cols, keys)], *names)
    return middle.agg(*picked)


def _between(vals: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values that lie between the ends their group has in ``state`` (one row per group and
    metric; broadcast where its size allows)."""
    names = {k: f"{k}_s" for k in keys}
    side = bounded_broadcast(state.select(*[F.col(c).alias(names.get(c, c)) for c in state.columns]))
    met = vals.join(side, _same(keys, list(names.values()))).drop(*names.values())
    return met.filter((F.col("_lo").isNull() | (F.col("_ek_x") > F.col("_lo")))
                      & (F.col("_hi").isNull() | (F.col("_ek_x") < F.col("_hi"))))


def _select_ranks(vals: DataFrame, counted: DataFrame, keys: Sequence[str], select_rows: int, drawn: int) -> DataFrame | None:
    """Ends around the middle of every group with at most ``select_rows`` values between them, or
    the middle values themselves; None if no group is larger than that to begin with."""
    largest = counted.agg(F.max("_ek_n").alias("n")).first()["n"]
    if (largest or 0) <= select_rows:
        return None
    none, n = F.lit(None).cast("double"), F.col("_ek_n")
    state = counted.select(*keys, none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_before"),
                           n.alias("_n"), F.expr("(_ek_n - 1) div 2").alias("_k1"), F.expr("_ek_n div 2").alias("_k2"),
                           none.alias("_v1"), none.alias("_v2"))
    state = _written(state, "median-state")
    open_ = F.col("_v1").isNull() & (F.col("_n") > select_rows)
    seed = 0
    while not state.filter(open_).isEmpty():
        seed += 1
        active = state.filter(open_)
        sample = (_between(vals, active, keys).filter(F.rand(seed) < drawn / F.col("_n")).groupBy(*keys)
                  .agg(F.sort_array(F.collect_list("_ek_x")).alias("_s"),
                       F.first((F.col("_k1") - F.col("_before") + 0.5) / F.col("_n")).alias("_q")))
        at = F.size("_s") * F.col("_q")
        width = 3 * F.sqrt(F.size("_s") * F.col("_q") * (1 - F.col("_q"))) + 1
        ends = sample.select(*[F.col(k).alias(f"{k}_d") for k in keys], F.get("_s", F.floor(at - width).cast("int")).alias("_a"),
                             F.get("_s", F.ceil(at + width).cast("int")).alias("_b"))
        split = active.join(ends, _same(keys, [f"{k}_d" for k in keys]), "left").select(*active.columns, "_a", "_b")
        split = _written(split, "median-splitters")
        state = _written(state.filter(~open_).unionByName(_descend(vals, split, keys).select(*state.columns)), "median-state")
    return state


def _descend(vals: DataFrame, split: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``split`` with the ends moved to the part that holds the middle, or the middle found."""
    x, a, b = F.col("_ek_x"), F.col("_a"), F.col("_b")
    inner = (a.isNull() | (x > a)) & (b.isNull() | (x < b))
    counts = _between(vals, split, keys).groupBy(*keys).agg(
        F.count_if(x < a).alias("_below"), F.count_if(x == a).alias("_at_a"), F.count_if(inner).alias("_inner"),
        F.count_if((x == b) & (a.isNull() | (b > a))).alias("_at_b"),
        F.min(F.when(inner, x)).alias("_next_a"), F.min(F.when(x > b, x)).alias("_next_b"))
    named = counts.select(*[F.col(c).alias(f"{c}_c") if c in keys else F.col(c) for c in counts.columns])
    met = split.join(named, _same(keys, [f"{k}_c" for k in keys]))
    r1, r2 = F.col("_k1") - F.col("_before"), F.col("_k2") - F.col("_before")
    t1, t2 = F.col("_below"), F.col("_below") + F.col("_at_a")
    t3, t4 = t2 + F.col("_inner"), t2 + F.col("_inner") + F.col("_at_b")
    after_b = F.coalesce("_next_b", "_hi")
    after_a = F.coalesce(F.col("_next_a"), F.when(F.col("_at_b") > 0, b), after_b)

    def part(below, at_a, between, at_b, above) -> Column:
        return F.when(r1 < t1, below).when(r1 < t2, at_a).when(r1 < t3, between).when(r1 < t4, at_b).otherwise(above)

    lo, hi, none = F.col("_lo"), F.col("_hi"), F.lit(None).cast("double")
    return met.select(
        *keys, part(lo, lo, F.coalesce(a, lo), lo, b).alias("_lo"), part(a, hi, F.coalesce(b, hi), hi, hi).alias("_hi"),
        (F.col("_before") + part(F.lit(0), F.lit(0), t2, F.lit(0), t4)).alias("_before"),
        part(t1, F.lit(0), F.col("_inner"), F.lit(0), F.col("_n") - t4).cast("long").alias("_n"), "_k1", "_k2",
        part(none, a, none, b, none).alias("_v1"),
        part(none, F.when(r2 < t2, a).otherwise(after_a), none, F.when(r2 < t4, b).otherwise(after_b), none).alias("_v2"))


def _middle_values(vals: DataFrame, keys: Sequence[str], state: DataFrame | None) -> DataFrame:
    """(keys, ``_ek_med``): the distinct values that are left, counted and put in order."""
    upto = Window.partitionBy(*keys).orderBy("_ek_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if state is None:
        counted = vals.groupBy(*keys, "_ek_x").agg(F.count(F.lit(1)).alias("_c"))
        n = F.sum("_c").over(Window.partitionBy(*keys))
        placed = (counted.withColumn("_to", F.sum("_c").over(upto)).withColumn("_n", n)
                  .withColumn("_k1", F.expr("(_n - 1) div 2")).withColumn("_k2", F.expr("_n div 2"))
                  .withColumn("_hi", F.lit(None).cast("double")))
    else:
        left = _between(vals, state.filter("_v1 IS NULL"), keys)
        counted = left.groupBy(*keys, "_ek_x").agg(F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(c) for c in (
            "_before", "_k1", "_k2", "_hi")])
        placed = counted.withColumn("_to", F.col("_before") + F.sum("_c").over(upto))
    covers = lambda k: (F.col("_to") - F.col("_c") <= F.col(k)) & (F.col(k) < F.col("_to"))
    # what follows the last value that is left is the upper end
    found = placed.groupBy(*keys).agg(F.max(F.when(covers("_k1"), F.col("_ek_x"))).alias("_v1"),
                                      F.coalesce(F.max(F.when(covers("_k2"), F.col("_ek_x"))), F.first("_hi")).alias("_v2"))
    if state is not None:
        found = found.unionByName(state.filter("_v1 IS NOT NULL").select(*keys, "_v1", "_v2"))
    return found.select(*keys, ((F.col("_v1") + F.col("_v2")) / 2).alias("_ek_med"))
