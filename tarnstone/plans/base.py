"""Registration of queries with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnstone.sources.files import shared_folder as shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None, *tables: str) -> Callable:
    """Registers a function of the named tables' DataFrames (documents if none is named)."""

    def put(build: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(*[table(spark, sf_dir, t) for t in tables or ("documents",)])

        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return build

    return put
