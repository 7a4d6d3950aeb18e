"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables.  Oracle SQL runs on DuckDB views with the same table
names; computed columns carry the same aliases on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from starledger.plans import queries_reports  # noqa: F401
    from starledger.plans import queries_listings  # noqa: F401
    from starledger.plans import queries_intake  # noqa: F401
    from starledger.plans import queries_maintain  # noqa: F401
    from starledger.plans import queries_sources  # noqa: F401
