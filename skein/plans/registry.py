"""The named queries of the engine and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans.surrogates import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(tables) as query `name`; `sql` is what DuckDB runs for the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["r01_hybrid_recall"](spark, sf_dir)


for _module in ("scans", "text", "relational", "graph", "retrieval", "lifecycle", "analytics", "trimming", "streams", "memory", "more", "code", "traces", "records", "ranking", "trees"):
    importlib.import_module(f"skein.plans.{_module}")
