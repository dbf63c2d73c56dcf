"""Registry of the named queries and of the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("relations", "censuses", "sequences", "vectors", "judgements", "sets", "streams", "checks", "ladders", "gauges", "pools", "genres", "runs")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with DuckDB SQL for its rows where SQL can express them."""

    def put(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return put


def _load() -> None:
    import importlib

    for module in _MODULES:
        importlib.import_module(f"marlstone.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
