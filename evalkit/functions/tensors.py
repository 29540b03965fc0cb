"""Tensor-catalog and packed-array Column functions (T1, T5, shapes, sizes).

Spark has no float16 or uint4 types: 4-bit values are ints, float16 results
are FloatType."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalkit import pools

# ---- fixed values -----------------------------------------------------------
BITS_PER_ELEMENT = {"uint4": 4, "int4": 4, "u4": 4, "i4": 4, "uint8": 8, "int8": 8, "u8": 8, "i8": 8,
                    "float16": 16, "bfloat16": 16, "f16": 16, "bf16": 16, "float32": 32, "f32": 32,
                    "float64": 64, "f64": 64, "int16": 16, "i16": 16, "uint16": 16, "u16": 16, "int32": 32, "i32": 32,
                    "uint32": 32, "u32": 32, "int64": 64, "i64": 64, "uint64": 64, "u64": 64, "boolean": 8, "bool": 8,
                    "u1": 1}
# parts of node names
WEIGHT_MARK, SCALE_MARK, ZERO_POINT_MARK = "weight", "/scale", "/zero_point"
HELPER_MARKS = ("/fq_weights", "/subtract")
# -----------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shape_elements(shape: Column | str) -> Column:
    """A10: product of a ``"128, 16, 128"`` shape string (1 for an empty shape)."""
    dims = F.transform(F.split(_c(shape), ","), lambda x: F.trim(x).try_cast("long"))
    return F.aggregate(dims, F.lit(1).cast("long"), lambda a, x: a * x)


def element_bits(element_type: Column | str) -> Column:
    et = F.lower(_c(element_type))
    out = F.lit(None).cast("int")
    for name, bits in BITS_PER_ELEMENT.items():
        out = F.when(et == name, F.lit(bits)).otherwise(out)
    return out


def tensor_bytes(shape: Column | str, element_type: Column | str) -> Column:
    """Bytes of a packed tensor: ceil(elements * bits / 8)."""
    return F.ceil(shape_elements(shape) * element_bits(element_type) / F.lit(8)).cast("long")


def layer_number(name: Column | str) -> Column:
    """O1: number after ``layers.`` / ``layers_``; -1 for anonymous nodes."""
    n = F.nullif(F.regexp_extract(_c(name), pools.LAYER_NUMBER, 1), F.lit(""))
    return F.coalesce(n.try_cast("int"), F.lit(-1))


def component_class(name: Column | str) -> Column:
    """T5: zero_point, scale or weight by name, tested in this order; helper
    nodes (fq_weights, subtract) are NULL."""
    n = _c(name)
    helper = F.contains(n, F.lit(HELPER_MARKS[0])) | F.contains(n, F.lit(HELPER_MARKS[1]))
    return (F.when(F.contains(n, F.lit(ZERO_POINT_MARK)), F.lit("zero_point"))
            .when(F.contains(n, F.lit(SCALE_MARK)), F.lit("scale")).when(~helper, F.lit("weight")))


def is_weight_constant(name: Column | str) -> Column:
    """weight-like constants, without the scale / zero_point helpers."""
    n = _c(name)
    return (F.contains(n, F.lit(WEIGHT_MARK)) & ~F.contains(n, F.lit(SCALE_MARK))
            & ~F.contains(n, F.lit(ZERO_POINT_MARK)))


def protected(name: Column | str, pattern: str = pools.PROTECTED_SCOPE) -> Column:
    """node inside the scope kept out of compression."""
    return _c(name).rlike(pattern)


def precision_class(element_type: Column | str) -> Column:
    """INT4 / INT8 / FP16 / BF16 / other (bfloat16 is tested before float16)."""
    et = F.lower(_c(element_type))
    return (F.when(F.contains(et, F.lit("int4")), F.lit("INT4"))
            .when(F.contains(et, F.lit("int8")), F.lit("INT8"))
            .when(F.contains(et, F.lit("bfloat16")), F.lit("BF16"))
            .when(F.contains(et, F.lit("float16")), F.lit("FP16"))
            .otherwise(F.lit("other")))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row (inside a lambda it would be worked
    out for every element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pack_uint4(values: Column | str) -> Column:
    """The inverse of T1: two 4-bit values per byte, low nibble first (an odd last value
    gets an empty high nibble)."""
    def digits(v: Column) -> Column:
        last = F.ceil(F.size(v) / 2).cast("int") - 1
        digit = lambda i: F.hex(F.coalesce(F.get(v, i), F.lit(0)).cast("long"))
        pairs = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(digit(i * 2 + 1), digit(i * 2)))
        return F.when(F.size(v) > 0, F.unhex(F.array_join(pairs, ""))).otherwise(F.unhex(F.lit("")))
    return _let(_c(values), digits)


def unpack_uint4(packed: Column | str, n_values: Column | int | None = None) -> Column:
    """Two 4-bit values per byte, low nibble first (bytes 2F 10 -> [15, 2, 0, 1]), or the
    first ``n_values`` of them. The bytes are cut into pieces once and every piece is decoded
    once, so the time is proportional to the length. No bytes give no values, null gives null."""
    def nibble(digit: Column) -> Column:
        code = F.ascii(digit)
        return F.when(code < 58, code - 48).otherwise(code - 55)  # 0 to 9, A to F
    pieces = F.regexp_extract_all(F.hex(_c(packed)), F.lit(".."), 0)
    values = F.flatten(F.transform(pieces, lambda p: F.array(nibble(F.substring(p, 2, 1)), nibble(p))))
    if n_values is None:
        return values
    return F.slice(values, F.lit(1), F.lit(n_values) if isinstance(n_values, int) else n_values)


#: Bytes of a packed tensor that one row decodes.
CHUNK_BYTES = 1 << 16


def packed_chunks(df: DataFrame, packed: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """T1 for large tensors: one row per ``chunk_bytes`` of ``packed``, with ``chunk`` (from 0)
    and ``first`` (the place of its first value), so the values of a tensor are decoded by
    many tasks and no row holds them all. An empty tensor has one empty chunk, null none."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(packed) / chunk_bytes)).cast("int")
    others = [c for c in df.columns if c not in (packed, "chunk", "first")]
    cut = df.filter(F.col(packed).isNotNull()).select(*others, packed, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    piece = F.substring(F.col(packed), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
    return cut.select(*others, "chunk", (F.col("chunk").cast("long") * chunk_bytes * 2).alias("first"), piece.alias(packed))
