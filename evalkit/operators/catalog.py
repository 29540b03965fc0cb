"""Tensor-catalog and statistics-target work (S8 helpers, F4-F6, O1, A6, A7, A9,
A10, J3-J6, T5, U2, W1, W3).

Catalog tables are small next to the data they describe, but nothing here
assumes that: orders go through ``global_index`` (range partitioning), prefix
matching is an ordered join with the next file name, groups are aggregated partially."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalkit import pools
from evalkit.functions import tensors as TF
from evalkit.plans.ordering import global_index, running_sum, successors

# ---- fixed values -----------------------------------------------------------
COMPONENTS = ["weight", "scale", "zero_point"]
LAYER_RANGE_LABEL = "layers %d-%d"
NON_LAYER_LABEL = "%d non-layer nodes"
EMPTY_BATCH_LABEL = "empty"
# -----------------------------------------------------------------------------


def weight_constants(cat: DataFrame, pattern: str | None = None) -> DataFrame:
    """weight constants, optionally only those whose name contains ``pattern``."""
    out = cat.filter(TF.is_weight_constant("name"))
    return out.filter(F.contains("name", F.lit(pattern))) if pattern else out


def precision_counts(cat: DataFrame) -> DataFrame:
    """Weight tensors per element type."""
    return weight_constants(cat).groupBy("element_type").agg(F.count(F.lit(1)).alias("tensors"))


def precision_by_category(spark: SparkSession, cat: DataFrame,
                          categories: Sequence[tuple[str, str]] = tuple(pools.TENSOR_CATEGORIES)) -> DataFrame:
    """Category x precision counts. A tensor may fall in several categories;
    matching is a projection over the fixed category list, not a join."""
    cats = F.array(*[F.struct(F.lit(n).alias("category"), F.lit(p).alias("pattern")) for n, p in categories])
    w = weight_constants(cat).select("name", TF.precision_class("element_type").alias("cls"))
    hits = (w.select("cls", F.explode(F.filter(cats, lambda c: F.contains(F.col("name"), c["pattern"]))).alias("_c"))
            .select("cls", F.col("_c.category").alias("category")))
    counts = [F.count_if(F.col("cls") == k).alias(k.lower()) for k in ("INT4", "INT8", "FP16", "BF16", "other")]
    return hits.groupBy("category").agg(*counts, F.count(F.lit(1)).alias("total"))


def complete_groups(cat: DataFrame, keys: Sequence[str] = ("model", "layer")) -> DataFrame:
    """per layer the components present and whether weight, scale and
    zero_point are all there (the set per layer has at most three values)."""
    keys = list(keys)
    g = cat.groupBy(*keys).agg(F.array_sort(F.collect_set("component")).alias("_cs"))
    have = F.size(F.filter("_cs", lambda x: x.isin(*COMPONENTS)))
    return g.select(*keys, F.array_join("_cs", ",").alias("components"), (have == 3).alias("complete"))


def component_join(cat: DataFrame, keys: Sequence[str] = ("model", "layer")) -> DataFrame:
    """Weight, scale and zero_point of a layer on one row (pivot with an
    explicit value list, so no extra job to find the values)."""
    keys = list(keys)
    return (cat.groupBy(*keys).pivot("component", COMPONENTS)
            .agg(F.max("id").alias("id"), F.max("offset").alias("offset"), F.max("shape").alias("shape")))


def with_size(cat: DataFrame) -> DataFrame:
    """The catalog with ``size`` in bytes: the stored one, else shape times element type. A
    row that has neither a stored size nor a known type stops the job: a layout must not
    be built over data of unknown extent."""
    computed = TF.tensor_bytes("shape", "element_type")
    size = F.coalesce(F.col("size"), computed) if "size" in cat.columns else computed
    unknown = F.concat(F.lit("no size and unknown element type: "), F.coalesce(F.col("element_type"), F.lit("null")))
    return cat.withColumn("size", F.when(size.isNotNull(), size).otherwise(F.raise_error(unknown).cast("long")))


def size_impact(cat: DataFrame, router_pattern: str = "mlp.gate.weight") -> DataFrame:
    """A10: per model, bytes of the INT4 router weights and zero points now,
    bytes of FP16 weights after dequantisation, and the increase. Only layers
    with all three components count. Each layer uses its own shape and the stored size
    (only a missing size is computed from shape and type)."""
    r = with_size(cat.filter(F.contains("name", F.lit(router_pattern))))
    ok = complete_groups(r).filter("complete").select("model", "layer")
    r = r.join(ok, ["model", "layer"], "left_semi")
    per = r.groupBy("model", "layer").agg(
        F.sum(F.when(F.col("component") == "weight", F.col("size"))).alias("w"),
        F.sum(F.when(F.col("component") == "zero_point", F.col("size"))).alias("zp"),
        F.sum(F.when(F.col("component") == "weight", TF.shape_elements("shape") * 2)).alias("w16"))
    return per.groupBy("model").agg(
        F.count(F.lit(1)).alias("routers"),
        F.sum(F.col("w") + F.col("zp")).cast("long").alias("total_old"),
        F.sum("w16").cast("long").alias("total_new_weights"),
        F.sum(F.col("w16") - F.col("w")).cast("long").alias("size_increase"))


def append_layout(cat: DataFrame, router_pattern: str = "mlp.gate.weight") -> DataFrame:
    """New offsets when the dequantised FP16 weight, a ones scale and a zeros
    zero point of every complete router layer are appended, in layer order,
    after the end of the model's binary (max offset + size over all its constants, of
    whatever type)."""
    sized = with_size(cat)
    base = sized.groupBy("model").agg(F.max(F.col("offset") + F.col("size")).alias("base"))
    r = sized.filter(F.contains("name", F.lit(router_pattern)))
    ok = complete_groups(r).filter("complete").select("model", "layer")
    r = r.join(ok, ["model", "layer"], "left_semi")
    new_size = (F.when(F.col("component") == "weight", TF.shape_elements("shape") * 2)
                .when(F.col("component") == "scale", TF.shape_elements("shape") * 2)
                .otherwise(F.col("size")))
    order = F.col("layer") * 3 + F.array_position(F.array(*[F.lit(c) for c in COMPONENTS]), F.col("component")) - 1
    r = r.withColumn("new_size", new_size.cast("long")).withColumn("_o", order.cast("long"))
    r = running_sum(r, ["model"], "_o", "new_size", "_before", inclusive=False, ties=["id"])
    return (r.join(base, "model")
            .select("model", "layer", "component", "id", "new_size",
                    (F.col("base") + F.col("_before")).cast("long").alias("new_offset")))


def layer_order(keys: DataFrame, key: str = "key", num_partitions: int | None = None) -> DataFrame:
    """O1: position of each key sorted by (layer number or -1, key)."""
    k = keys.withColumn("layer", TF.layer_number(key))
    return global_index(k, ["layer", key], name="pos", num_partitions=num_partitions)


def round_robin_batches(keys: DataFrame, n_batches: int, key: str = "key",
                        num_partitions: int | None = None) -> DataFrame:
    """Key i of the O1 order goes to batch i mod N (empty batches simply
    have no rows). Positions come from a range-partitioned sort, not a
    one-partition window."""
    return layer_order(keys, key, num_partitions).withColumn("batch", F.pmod("pos", F.lit(n_batches)).cast("int"))


def batch_layer_range(batches: DataFrame) -> DataFrame:
    """Per batch the layer range and the count of keys without a layer."""
    g = batches.groupBy("batch").agg(
        F.min(F.when(F.col("layer") >= 0, F.col("layer"))).alias("min_layer"),
        F.max(F.when(F.col("layer") >= 0, F.col("layer"))).alias("max_layer"),
        F.count_if(F.col("layer") < 0).alias("non_layer"))
    label = F.concat_ws(", ",
                        F.when(F.col("min_layer").isNotNull(),
                               F.format_string(LAYER_RANGE_LABEL, F.col("min_layer"), F.col("max_layer"))),
                        F.when(F.col("non_layer") > 0, F.format_string(NON_LAYER_LABEL, F.col("non_layer"))))
    return g.withColumn("label", F.when(label == "", F.lit(EMPTY_BATCH_LABEL)).otherwise(label))


def target_keep_drop(targets: DataFrame, batch_keys: DataFrame, key: str = "saved_name") -> DataFrame:
    """Per batch, targets kept (semi join with the batch key set) and
    removed (the rest: anti join counted as total - kept)."""
    all_t = targets.select(key).distinct()
    total = all_t.agg(F.count(F.lit(1)).alias("_total"))
    kept = (batch_keys.select("batch", key).distinct().join(all_t, key, "left_semi")
            .groupBy("batch").agg(F.count(F.lit(1)).alias("kept")))
    return kept.crossJoin(total).select("batch", "kept", (F.col("_total") - F.col("kept")).alias("removed"))


def dropped_targets(targets: DataFrame, batch_keys: DataFrame, key: str = "saved_name") -> DataFrame:
    """J3 (rows): targets not in the batch key set (left anti join)."""
    return targets.join(batch_keys.select(key).distinct(), key, "left_anti")


def mapping_file_lookup(targets: DataFrame, files: DataFrame, key: str = "saved_name",
                        scope: Sequence[str] = ("batch",)) -> DataFrame:
    """Statistics file of each saved name within its batch folder:
    ``name.safetensors``, else ``name``, else the first file (by name) that
    starts with ``name``; ``missing`` when none.

    The files that start with a name follow it in the order of names, so the first of them is
    the name's successor among the files, if it starts with the name at all: an ordered join
    finds it, without spelling out prefixes. Null names are missing."""
    scope, suffix = list(scope), ".safetensors"
    t = targets.select(*scope, key).distinct()
    f = files.select(*scope, "file").filter(F.col("file").isNotNull()).distinct()
    near = successors(t, f, scope, key, "file", "_next")
    whole = f.filter(F.col("file").endswith(suffix)).select(
        *[F.col(c).alias(f"_{c}") for c in scope], F.col("file").alias("_whole"),
        F.expr(f"substring(file, 1, length(file) - {len(suffix)})").alias("_stem"))
    on = F.col(key) == F.col("_stem")
    for c in scope:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = near.join(whole, on, "left")
    exact, prefix = F.col("_next") == F.col(key), F.startswith(F.col("_next"), F.col(key))
    kind = (F.when(F.col("_whole").isNotNull(), F.lit("safetensors")).when(exact, F.lit("exact"))
            .when(prefix, F.lit("prefix")).otherwise(F.lit("missing")))
    file = F.coalesce(F.col("_whole"), F.when(prefix, F.col("_next")))
    return out.select(*scope, key, file.alias("file"), kind.alias("match"))


def merge_batches(mapping: DataFrame, key: str = "saved_name", found: DataFrame | None = None) -> DataFrame:
    """Union of batch mappings; the later batch wins on duplicates, which
    are counted. With ``found`` (batch, key rows whose statistics file exists,
    e.g. J4 without ``missing``) entries without a file are skipped first."""
    if found is not None:
        mapping = mapping.join(found.select("batch", key).distinct(), ["batch", key], "left_semi")
    return mapping.groupBy(key).agg(
        F.max_by("original_name", "batch").alias("original_name"),
        F.max("batch").alias("from_batch"),
        (F.count(F.lit(1)) - 1).alias("duplicates"))


def first_metadata(meta: DataFrame, order: str = "batch") -> DataFrame:
    """Non-mapping metadata, taken as one row from the first batch that has any
    (batches whose metadata are all NULL are passed over; columns never mix batches)."""
    cols = [c for c in meta.columns if c != order]
    some = meta.filter(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull())
    return some.agg(F.min_by(F.struct(*cols), order).alias("_m")).select("_m.*")


def default_on_missing(nodes: DataFrame, stats: DataFrame, key: str, value: str,
                       default: float, eligible: str) -> DataFrame:
    """Nodes without statistics, or not eligible (e.g. not 4-bit), get the
    default value (left join + when)."""
    j = nodes.join(stats, key, "left")
    use_default = F.col(value).isNull() | ~F.col(eligible)
    return (j.withColumn("used_default", use_default)
            .withColumn("stat", F.when(use_default, F.lit(default)).otherwise(F.col(value))))
