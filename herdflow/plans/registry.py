"""Registry of named queries over the driver's test tables.

Each query is ``fn(spark, sf_dir) -> DataFrame``; an optional DuckDB oracle SQL
string computes the same result over the pre-registered parquet views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn`` under ``name`` with an optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their ``@register`` calls run."""
    from herdflow.plans import (  # noqa: F401
        history_plans, grade_plans, farm_plans, lineage_plans, weather_plans,
        series_plans, learn_plans, quality_plans, io_plans, stream_plans, contract_plans, builder_plans,
        matrix_plans,
    )
