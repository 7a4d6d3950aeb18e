"""Constant frames built as SQL ``VALUES`` relations.

A ``VALUES`` relation becomes a ``LocalRelation``: it lives in the JVM, its
size is known to the optimizer, and reading it never starts a Python worker
(unlike ``createDataFrame`` on a Python list, which plans an RDD scan).
"""

from __future__ import annotations

import weakref
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Frames whose row count is known when they are built (constant relations).
KNOWN_ROWS: "weakref.WeakKeyDictionary[DataFrame, int]" = weakref.WeakKeyDictionary()


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    s = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{s}'"


def values_frame(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType) -> DataFrame:
    """``rows`` as a LocalRelation with exactly ``schema`` (names, types)."""
    names = [f.name for f in schema.fields]
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields)
    df = spark.sql(f"SELECT {cols} FROM VALUES {body} AS t({', '.join(f'`{n}`' for n in names)})")
    KNOWN_ROWS[df] = len(rows)
    return df


def array_literal(values: Sequence) -> Column:
    """An array literal in one expression (one JVM call, not one per item)."""
    return F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")")
