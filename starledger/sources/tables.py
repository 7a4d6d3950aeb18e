"""A1: table scans.  Reads stay lazy so Catalyst prunes columns and pushes
filters into the Parquet scan (see ``ReadSchema`` / ``PushedFilters``)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_SCANS: dict[tuple, DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str,
               schema: T.StructType | None = None, reuse: bool = True) -> DataFrame:
    """Parquet scan of ``<sf_dir>/<name>.parquet``; an explicit schema skips
    footer inference when the caller knows the layout.

    Input tables are immutable snapshots, so the (lazy) scan DataFrame is
    reused per session and path: the file listing and footer read happen once.
    """
    key = (id(spark), sf_dir, name, None if schema is None else schema.json())
    if reuse and key in _SCANS:
        return _SCANS[key]
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(table_path(sf_dir, name))
    if reuse:
        _SCANS[key] = df
    return df


def read_star_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan a star table written by ``starledger.sources.sinks`` (Parquet)."""
    return spark.read.schema(schema).parquet(path)
