"""Join helper: a broadcast behind a check of its size in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest side that is broadcast, by an upper estimate of its rows' bytes.
DEFAULT_BROADCAST_BYTES = 32 * 1024 * 1024
ROW_OVERHEAD = 64


def row_bytes(df: DataFrame):
    """Upper estimate of a row's bytes: strings and arrays by their length, 16 for the rest."""
    size = F.lit(ROW_OVERHEAD)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif "array" in kind or "struct" in kind or "map" in kind:
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            size = size + 16
    return size


def bounded_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its rows take at most ``max_bytes``; otherwise return it
    unhinted, so the planner shuffles or adaptive execution decides at run time. The
    check is one aggregate over ``df``; nothing is materialised before the size is known."""
    if df.isLocal():  # rows held by the driver (a literal table)
        return F.broadcast(df)
    total = df.agg(F.sum(row_bytes(df)).alias("b")).first()["b"]
    return F.broadcast(df) if (total or 0) <= max_bytes else df
