"""Query registry: one entry per SURVEY section-2 operator (key = SURVEY key).

Each query is `fn(spark, sf_dir) -> DataFrame` over the whole driver tables; `ORACLES[name]` is its DuckDB twin.
Modules under `termlens.plans.q_*` register themselves on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termlens.plans.sql_bindings import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is the final SELECT (CTEs it names are prepended automatically)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn
    return deco


def load_all() -> None:
    from termlens.plans import q_mart, q_model, q_prep, q_serving, q_sources, q_text  # noqa: F401
