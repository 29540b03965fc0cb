"""Queries over the tensor catalog (FX7), statistics targets (FX9) and vectors
(FX8, embeddings): F4-F6, O1, W1, W3, A6, A7, A9, A10, J3-J6, T1-T5, U2, A12."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalkit import fixtures as fx
from evalkit.functions import tensors as TF
from evalkit.operators import catalog as K
from evalkit.operators import tensors as TO
from evalkit.queries import register
from evalkit.queries.util import rounded
from evalkit.sources.tables import table

FX7 = """fx7r AS (SELECT p_partkey, 'm' || CAST(p_partkey // 144 AS VARCHAR) AS model, CAST(p_partkey % 48 AS INTEGER) AS layer,
    ['weight', 'scale', 'zero_point'][(p_partkey // 48) % 3 + 1] AS component,
    ['embed_tokens', 'lm_head', 'self_attn.q_proj', 'mlp.gate', 'mlp.shared_expert.up_proj', 'mlp.experts.down_proj'][(p_partkey % 48) % 6 + 1] AS part_path,
    p_size FROM part WHERE p_partkey % 41 <> 0),
 fx7 AS (SELECT CAST(p_partkey AS VARCHAR) AS id, model, layer, component,
    'self.model.layers.' || CAST(layer AS VARCHAR) || '.' || part_path || '.weight'
      || CASE component WHEN 'scale' THEN '/scale' WHEN 'zero_point' THEN '/zero_point' ELSE '' END AS name,
    CASE component WHEN 'scale' THEN 'float16' WHEN 'zero_point' THEN 'uint4'
      ELSE ['uint4', 'uint8', 'float16', 'bfloat16'][p_size % 4 + 1] END AS element_type,
    CASE component WHEN 'weight' THEN '128, 16, ' || CAST(p_size AS VARCHAR) ELSE '128, 16, 1' END AS shape,
    p_partkey * 65536 AS "offset" FROM fx7r),
 fx7s AS (SELECT *, list_reduce(list_transform(string_split(shape, ','), lambda x: CAST(trim(x) AS BIGINT)), lambda a, b: a * b) AS elements,
    CASE element_type WHEN 'uint4' THEN 4 WHEN 'uint8' THEN 8 ELSE 16 END AS bits FROM fx7),
 fx7b AS (SELECT *, CAST(ceil(elements * bits / 8) AS BIGINT) AS size FROM fx7s)"""

WEIGHTS = "contains(name, 'weight') AND NOT contains(name, '/scale') AND NOT contains(name, '/zero_point')"


def cat(spark, sf):
    return fx.tensor_catalog(spark, sf)


@register("tensor_name_filter", f"""WITH {FX7} SELECT id, name, element_type, shape FROM fx7
  WHERE {WEIGHTS} AND contains(name, 'mlp.gate')""")
def q_tensor_name_filter(spark, sf):
    return K.weight_constants(cat(spark, sf), "mlp.gate").select("id", "name", "element_type", "shape")


@register("protected_scope", f"""WITH {FX7} SELECT id, name, regexp_matches(name, '.*mlp\\.gate.*') AS protected FROM fx7""")
def q_protected_scope(spark, sf):
    return cat(spark, sf).select("id", "name", TF.protected("name").alias("protected"))


@register("complete_groups", f"""WITH {FX7} SELECT model, layer,
  array_to_string(list_sort(list_distinct(list(component))), ',') AS components,
  count(DISTINCT component) FILTER (WHERE component IN ('weight', 'scale', 'zero_point')) = 3 AS complete
  FROM fx7 GROUP BY model, layer""")
def q_complete_groups(spark, sf):
    return K.complete_groups(cat(spark, sf))


@register("component_class", f"""WITH {FX7} SELECT id, CASE WHEN contains(name, '/zero_point') THEN 'zero_point'
  WHEN contains(name, '/scale') THEN 'scale' WHEN NOT contains(name, '/fq_weights') AND NOT contains(name, '/subtract')
  THEN 'weight' END AS component_class FROM fx7""")
def q_component_class(spark, sf):
    return cat(spark, sf).select("id", TF.component_class("name").alias("component_class"))


@register("precision_counts", f"""WITH {FX7} SELECT element_type, count(*) AS tensors FROM fx7 WHERE {WEIGHTS}
  GROUP BY element_type""")
def q_precision_counts(spark, sf):
    return K.precision_counts(cat(spark, sf))


CATS = ", ".join(f"('{n}', '{p}')" for n, p in K.pools.TENSOR_CATEGORIES)


@register("precision_by_category", f"""WITH {FX7}, w AS (SELECT name, CASE WHEN contains(element_type, 'int4') THEN 'INT4'
    WHEN contains(element_type, 'int8') THEN 'INT8' WHEN contains(element_type, 'bfloat16') THEN 'BF16'
    WHEN contains(element_type, 'float16') THEN 'FP16' ELSE 'other' END AS cls FROM fx7 WHERE {WEIGHTS}),
  c AS (SELECT * FROM (VALUES {CATS}) v(category, pattern))
  SELECT category, count(*) FILTER (WHERE cls = 'INT4') AS int4, count(*) FILTER (WHERE cls = 'INT8') AS int8,
   count(*) FILTER (WHERE cls = 'FP16') AS fp16, count(*) FILTER (WHERE cls = 'BF16') AS bf16,
   count(*) FILTER (WHERE cls = 'other') AS other, count(*) AS total
  FROM w JOIN c ON contains(w.name, c.pattern) GROUP BY category""")
def q_precision_by_category(spark, sf):
    return K.precision_by_category(spark, cat(spark, sf))


ROUTERS = """r AS (SELECT * FROM fx7b WHERE contains(name, 'mlp.gate.weight')),
  okl AS (SELECT model, layer FROM r GROUP BY model, layer
          HAVING count(DISTINCT component) FILTER (WHERE component IN ('weight', 'scale', 'zero_point')) = 3),
  rr AS (SELECT r.* FROM r JOIN okl USING (model, layer))"""


@register("size_impact", f"""WITH {FX7}, {ROUTERS},
  per AS (SELECT model, layer, sum(size) FILTER (WHERE component = 'weight') AS w,
     sum(size) FILTER (WHERE component = 'zero_point') AS zp,
     sum(elements * 2) FILTER (WHERE component = 'weight') AS w16 FROM rr GROUP BY model, layer)
  SELECT model, count(*) AS routers, CAST(sum(w + zp) AS BIGINT) AS total_old, CAST(sum(w16) AS BIGINT) AS total_new_weights,
   CAST(sum(w16 - w) AS BIGINT) AS size_increase FROM per GROUP BY model""")
def q_size_impact(spark, sf):
    return K.size_impact(cat(spark, sf))


@register("component_join", f"""WITH {FX7} SELECT model, layer,
  max(id) FILTER (WHERE component = 'weight') AS weight_id, max("offset") FILTER (WHERE component = 'weight') AS weight_offset,
  max(shape) FILTER (WHERE component = 'weight') AS weight_shape,
  max(id) FILTER (WHERE component = 'scale') AS scale_id, max("offset") FILTER (WHERE component = 'scale') AS scale_offset,
  max(shape) FILTER (WHERE component = 'scale') AS scale_shape,
  max(id) FILTER (WHERE component = 'zero_point') AS zero_point_id, max("offset") FILTER (WHERE component = 'zero_point') AS zero_point_offset,
  max(shape) FILTER (WHERE component = 'zero_point') AS zero_point_shape
  FROM fx7 GROUP BY model, layer""")
def q_component_join(spark, sf):
    return K.component_join(cat(spark, sf))


@register("append_layout", f"""WITH {FX7}, {ROUTERS},
  base AS (SELECT model, max("offset" + size) AS base FROM fx7b GROUP BY model),
  ns AS (SELECT model, layer, component, id, CAST(CASE WHEN component IN ('weight', 'scale') THEN elements * 2 ELSE size END AS BIGINT) AS new_size,
     layer * 3 + CASE component WHEN 'weight' THEN 0 WHEN 'scale' THEN 1 ELSE 2 END AS o FROM rr)
  SELECT ns.model, layer, component, id, new_size, CAST(base + coalesce(sum(new_size) OVER (PARTITION BY ns.model ORDER BY o
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset FROM ns JOIN base USING (model)""")
def q_append_layout(spark, sf):
    return K.append_layout(cat(spark, sf))


FX9 = """fx9b AS (SELECT p_partkey, 't' || CAST(p_partkey AS VARCHAR) AS saved_name,
    CASE WHEN p_partkey % 9 = 0 THEN 'MatMul_' || CAST(p_partkey AS VARCHAR)
      ELSE 'self.model.layers.' || CAST(p_partkey % 48 AS VARCHAR) ||
        CASE WHEN p_partkey % 2 = 0 THEN '.mlp.gate/MatMul' ELSE '.self_attn.q_proj/MatMul' END END AS original_name,
    CAST(p_partkey % 3 AS INTEGER) AS batch FROM part),
  fx9 AS (SELECT * FROM fx9b UNION ALL SELECT p_partkey, saved_name, original_name || '#2', batch + 1 FROM fx9b WHERE p_partkey % 50 = 0),
  files AS (SELECT batch, CASE WHEN p_partkey % 20 < 8 THEN saved_name || '.safetensors' WHEN p_partkey % 20 < 14 THEN saved_name
    WHEN p_partkey % 20 < 19 THEN saved_name || '_stats.bin' END AS file FROM fx9 WHERE p_partkey % 20 < 19),
  keys AS (SELECT original_name || ':' || saved_name AS key,
    coalesce(TRY_CAST(nullif(regexp_extract(original_name || ':' || saved_name, 'layers[._](\\d+)', 1), '') AS INTEGER), -1) AS layer FROM fx9b)"""


def targets_keys(spark, sf):
    t = fx.stat_targets(spark, sf, repeated=False)
    return t.select(F.concat("original_name", F.lit(":"), "saved_name").alias("key"))


@register("layer_order", f"WITH {FX9} SELECT key, layer, row_number() OVER (ORDER BY layer, key) - 1 AS pos FROM keys")
def q_layer_order(spark, sf):
    return K.layer_order(targets_keys(spark, sf))


@register("round_robin_batches", f"""WITH {FX9} SELECT key, layer, row_number() OVER (ORDER BY layer, key) - 1 AS pos,
  CAST((row_number() OVER (ORDER BY layer, key) - 1) % 4 AS INTEGER) AS batch FROM keys""")
def q_round_robin(spark, sf):
    return K.round_robin_batches(targets_keys(spark, sf), 4)


@register("batch_layer_range", f"""WITH {FX9}, b AS (SELECT layer, CAST((row_number() OVER (ORDER BY layer, key) - 1) % 4 AS INTEGER) AS batch FROM keys),
  g AS (SELECT batch, min(layer) FILTER (WHERE layer >= 0) AS min_layer, max(layer) FILTER (WHERE layer >= 0) AS max_layer,
    count(*) FILTER (WHERE layer < 0) AS non_layer FROM b GROUP BY batch)
  SELECT *, coalesce(nullif(concat_ws(', ', CASE WHEN min_layer IS NOT NULL THEN 'layers ' || min_layer || '-' || max_layer END,
    CASE WHEN non_layer > 0 THEN non_layer || ' non-layer nodes' END), ''), 'empty') AS label FROM g""")
def q_batch_layer_range(spark, sf):
    return K.batch_layer_range(K.round_robin_batches(targets_keys(spark, sf), 4))


@register("target_keep_drop", f"""WITH {FX9}, t AS (SELECT DISTINCT saved_name FROM fx9b),
  k AS (SELECT batch, count(DISTINCT saved_name) AS kept FROM fx9 WHERE saved_name IN (SELECT saved_name FROM t) GROUP BY batch)
  SELECT batch, kept, (SELECT count(*) FROM t) - kept AS removed FROM k""")
def q_target_keep_drop(spark, sf):
    t = fx.stat_targets(spark, sf)
    return K.target_keep_drop(fx.stat_targets(spark, sf, repeated=False), t)


@register("mapping_file_lookup", f"""WITH {FX9}, t AS (SELECT DISTINCT batch, saved_name FROM fx9),
  c AS (SELECT t.batch, t.saved_name, f.file, CASE WHEN f.file = t.saved_name || '.safetensors' THEN 1
      WHEN f.file = t.saved_name THEN 2 ELSE 3 END AS rk
    FROM t JOIN files f ON f.batch = t.batch AND starts_with(f.file, t.saved_name)),
  b AS (SELECT batch, saved_name, file, rk FROM (SELECT *, row_number() OVER (PARTITION BY batch, saved_name ORDER BY rk, file) AS rn FROM c) x WHERE rn = 1)
  SELECT t.batch, t.saved_name, b.file, CASE b.rk WHEN 1 THEN 'safetensors' WHEN 2 THEN 'exact' WHEN 3 THEN 'prefix' ELSE 'missing' END AS match
  FROM t LEFT JOIN b USING (batch, saved_name)""")
def q_mapping_file_lookup(spark, sf):
    return K.mapping_file_lookup(fx.stat_targets(spark, sf), fx.stat_files(spark, sf))


@register("merge_batches", f"""WITH {FX9}, m AS (SELECT * FROM fx9 f WHERE EXISTS (
    SELECT 1 FROM files x WHERE x.batch = f.batch AND starts_with(x.file, f.saved_name)))
  SELECT saved_name, arg_max(original_name, batch) AS original_name, max(batch) AS from_batch,
  count(*) - 1 AS duplicates FROM m GROUP BY saved_name""")
def q_merge_batches(spark, sf):
    t = fx.stat_targets(spark, sf)
    found = K.mapping_file_lookup(t, fx.stat_files(spark, sf)).filter(F.col("match") != "missing")
    return K.merge_batches(t, found=found)


@register("default_on_missing_stat", """WITH n AS (SELECT 't' || CAST(p_partkey AS VARCHAR) AS saved_name, p_partkey % 4 <> 0 AS four_bit FROM part),
  s AS (SELECT 't' || CAST(p_partkey AS VARCHAR) AS saved_name, p_retailprice AS value FROM part WHERE p_partkey % 7 <> 0)
  SELECT saved_name, four_bit, value IS NULL OR NOT four_bit AS used_default,
    CASE WHEN value IS NULL OR NOT four_bit THEN 1.0 ELSE value END AS stat FROM n LEFT JOIN s USING (saved_name)""")
def q_default_on_missing(spark, sf):
    p = table(spark, sf, "part")
    nodes = p.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("saved_name"),
                     (F.pmod("p_partkey", F.lit(4)) != 0).alias("four_bit"))
    stats = p.filter(F.pmod("p_partkey", F.lit(7)) != 0).select(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("saved_name"), F.col("p_retailprice").alias("value"))
    out = K.default_on_missing(nodes, stats, "saved_name", "value", 1.0, "four_bit")
    return rounded(out.select("saved_name", "four_bit", "used_default", "stat"))


# 4-bit groups of the embeddings (T4), and per vector their codes, zero points and scales
QUANT = """g AS (SELECT vec_id, grp, list_transform(list_slice(embedding, grp * 16 + 1, grp * 16 + 16), lambda v: CAST(v AS DOUBLE)) AS x
    FROM (SELECT vec_id, embedding, CAST(unnest(range(CAST(ceil(len(embedding) / 16) AS BIGINT))) AS INTEGER) AS grp FROM embeddings) e),
  s AS (SELECT *, least(list_min(x), 0.0) AS lo, greatest(list_max(x), 0.0) AS hi FROM g),
  s2 AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 15 ELSE 1.0 END AS scale FROM s),
  s3 AS (SELECT *, CAST(least(greatest(floor(-lo / scale + 0.5), 0), 15) AS INTEGER) AS zero_point FROM s2),
  s4 AS (SELECT *, list_transform(x, lambda v: CAST(least(greatest(floor(v / scale + 0.5) + zero_point, 0), 15) AS INTEGER)) AS q FROM s3),
  vec AS (SELECT vec_id, flatten(list(q ORDER BY grp)) AS v, list(zero_point ORDER BY grp) AS zp, list(scale ORDER BY grp) AS sc
    FROM s4 GROUP BY vec_id)"""


def packed(spark, sf):
    """Per vector its T4 codes as packed bytes, with the groups' zero points and scales (a
    vector has as many groups as its length allows: four here)."""
    g = TO.quantise_groups(table(spark, sf, "embeddings"), "embedding", 16, "vec_id")
    per = g.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("grp", "q", "zero_point", "scale"))).alias("g"))
    return per.select("vec_id", TF.pack_uint4(F.flatten(F.transform("g", lambda x: x["q"]))).alias("packed"),
                      F.transform("g", lambda x: x["zero_point"]).alias("zp"),
                      F.transform("g", lambda x: x["scale"]).alias("scale"))


@register("unpack_uint4", f"""WITH {QUANT} SELECT vec_id, array_to_string(v, ',') AS vals, CAST(list_sum(v) AS BIGINT) AS total FROM vec""")
def q_unpack_uint4(spark, sf):
    p = packed(spark, sf).withColumn("v", TF.unpack_uint4("packed"))
    return p.select("vec_id", F.array_join("v", ",").alias("vals"),
                    F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


DEQ = "list_transform(v, lambda x, i: CAST((x - zp[(i - 1) // 16 + 1]) * sc[(i - 1) // 16 + 1] AS FLOAT))"


def dequantised(spark, sf):
    p = packed(spark, sf).withColumn("q", TF.unpack_uint4("packed"))
    return p.withColumn("deq", TO.dequantise("q", "zp", "scale", 16))


@register("dequantise_groups", f"""WITH {QUANT} SELECT vec_id, round(list_sum(list_transform(d, lambda x: CAST(x AS DOUBLE))), 6) AS deq_sum,
  round(list_min(d), 6) AS deq_min, round(list_max(d), 6) AS deq_max FROM (SELECT vec_id, {DEQ} AS d FROM vec) c""")
def q_dequantise(spark, sf):
    d = dequantised(spark, sf)
    dd = F.transform("deq", lambda x: x.cast("double"))
    return rounded(d.select("vec_id", F.aggregate(dd, F.lit(0.0), lambda a, x: a + x).alias("deq_sum"),
                            F.array_min(dd).alias("deq_min"), F.array_max(dd).alias("deq_max")))


@register("neutral_params", f"""WITH {QUANT} SELECT vec_id, array_to_string(list_transform(sc, lambda x: '1.0'), ',') AS scales, array_to_string(list_transform(zp, lambda x: '0'), ',') AS zero_points,
  round(list_sum(list_transform(d, lambda x: CAST(x AS DOUBLE))), 6) AS again_sum FROM (SELECT vec_id, sc, zp, {DEQ} AS d FROM vec) c""")
def q_neutral_params(spark, sf):
    d = dequantised(spark, sf)
    ones, zeros = TO.neutral_params(F.size("scale"))
    d = d.withColumn("ones", ones).withColumn("zeros", zeros)
    again = F.transform(TO.dequantise("deq", "zeros", "ones", 16), lambda x: x.cast("double"))
    return rounded(d.select(
        "vec_id", F.array_join(F.transform("ones", lambda x: x.cast("double").cast("string")), ",").alias("scales"),
        F.array_join(F.transform("zeros", lambda x: x.cast("int").cast("string")), ",").alias("zero_points"),
        F.aggregate(again, F.lit(0.0), lambda a, x: a + x).alias("again_sum")))


@register("quantise_groups", f"""WITH {QUANT},
  s5 AS (SELECT *, list_transform(list_zip(x, q), lambda p: abs(p[1] - (p[2] - zero_point) * scale)) AS err FROM s4)
  SELECT vec_id, grp, round(scale, 6) AS scale, zero_point, array_to_string(q, ',') AS codes, round(list_max(err), 6) AS max_err,
    round(list_sum(list_transform(err, lambda e: e * e)) / len(x), 6) AS mse FROM s5""")
def q_quantise_groups(spark, sf):
    g = TO.quantise_groups(table(spark, sf, "embeddings"), "embedding", 16, "vec_id")
    return rounded(g.select("vec_id", "grp", "scale", "zero_point", F.array_join("q", ",").alias("codes"),
                            "max_err", "mse"))


@register("channel_stats", """SELECT CAST(channel AS INTEGER) AS channel, round(max(abs(x)), 6) AS max_abs, round(avg(abs(x)), 6) AS mean_abs,
  round(var_pop(x), 6) AS var_pop, round(avg(x * x), 6) AS mean_sq, count(*) AS n FROM (
  SELECT unnest(range(len(embedding))) AS channel, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e GROUP BY channel""")
def q_channel_stats(spark, sf):
    return rounded(TO.channel_stats(table(spark, sf, "embeddings"), "embedding"))
