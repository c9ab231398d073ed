"""Named queries, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """A query whose Spark SQL is `text` over the named tables; the same text serves as oracle unless given."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[name] = run
    ORACLES[name] = text if oracle is None else oracle


def query(name: str, oracle: str | None = None, *tables: str):
    """Registers a function of DataFrames of the named tables."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def load() -> None:
    """Registers every query."""
    from . import dialect, formats, relational, retrieval, scalar, searching  # noqa: F401
