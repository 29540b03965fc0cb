"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per key,
plus, where SQL can express it, the DuckDB oracle for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

MODULES = ("q_scoring", "q_generators", "q_catalog", "q_results", "q_sources", "q_runs")

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every query module (registration happens at import)."""
    import importlib
    for m in MODULES:
        try:
            importlib.import_module(f"evalkit.queries.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"evalkit.queries.{m}":
                raise
