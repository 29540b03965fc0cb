"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalkit.session import scratch_path

#: Largest table that is broadcast, by a measured upper estimate of its bytes.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Largest Arrow batch handed to a Python worker, whatever the length of the texts.
ARROW_BATCH_BYTES = 4 * 1024 * 1024
#: Characters that a worker turns into arrays at a time (many bytes of arrays for each).
CHUNK = 1 << 18
#: A word, as the word statistics here count it: no space and none of \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession) -> None:
    """Python workers get batches bounded by bytes, so long texts cannot exhaust them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, lost
    executors cost nothing, and the planner learns the table's size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` takes at most ``limit`` bytes (an aggregate over its rows)."""
    total = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)).alias("b")).first()["b"]
    return (total or 0) <= limit


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Append columns; an input column of the same name gives way."""
    taken = {n.lower() for n in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken],
                     *[c.alias(n) for n, c in new.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"_llm_{name}"
    while name in taken:
        name += "_"
    return name


def per_worker(key: tuple, make: Callable):
    """An object made once per Python worker (functions pickled by value have no
    module globals that outlive a task). A worker keeps the objects of one operator, those that
    were made last; they go before another's are made, so the two are never held together."""
    store = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store")).__dict__
    kept = store.setdefault("_llm_kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()  # beside what it makes on the way
    return kept[key]


def spans(lengths: Sequence[int], chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chunk`` characters together (a longer text is alone)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > chunk:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
