"""Sorts, limits, top-k and paging.

``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: every task keeps
its own top ``n`` and only those rows reach the final merge, so a top-k never
sorts the whole input.  Paging uses ``offset`` the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions.scalars import num_prefix
from starledger.spec import DEFAULT_SPEC, LIST_LIMIT_DEFAULT, PAGE_SIZE, StarSpec


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows; all rows for ``None``.  There is no ceiling."""
    if limit is None:
        return df
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return df.limit(limit)


def subject_list_keys(spec: StarSpec = DEFAULT_SPEC) -> list[Column]:
    """Numeric grade, section, last name, first name, id."""
    return [num_prefix(spec.grade).asc(), F.col(spec.section).asc(), F.col(spec.last_name).asc(),
            F.col(spec.first_name).asc(), F.col(spec.subject_key).asc()]


def subject_list_order(df: DataFrame, spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    return df.orderBy(*subject_list_keys(spec))


def list_subjects(df: DataFrame, spec: StarSpec = DEFAULT_SPEC, limit: int | None = LIST_LIMIT_DEFAULT) -> DataFrame:
    return limited(subject_list_order(df, spec), limit)


def recent_keys(date_col: str = "incident_date", key: str = "id") -> list[Column]:
    """Date DESC, id DESC."""
    return [F.col(date_col).desc(), F.col(key).desc()]


def recent_first(df: DataFrame, date_col: str = "incident_date", key: str = "id") -> DataFrame:
    return df.orderBy(*recent_keys(date_col, key))


def catalog_keys(spec: StarSpec = DEFAULT_SPEC) -> list[Column]:
    """Category DESC ('Minor' before 'Major'), then code."""
    return [F.col(spec.category).desc(), F.col(spec.code).asc()]


def catalog_order(df: DataFrame, spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    return df.orderBy(*catalog_keys(spec))


def first_errors(errors: DataFrame, n: int = 10, row_col: str = "row") -> DataFrame:
    """The first ``n`` errors in file order."""
    return errors.orderBy(F.col(row_col).asc()).limit(n)


def page(df: DataFrame, order: list, p: int, n: int = PAGE_SIZE) -> DataFrame:
    """Rows of page ``p`` (0-based) of size ``n`` under a total ``order``."""
    return df.orderBy(*order).offset(p * n).limit(n)


def page_info(df: DataFrame, p: int, n: int = PAGE_SIZE) -> DataFrame:
    """Total rows, page count (at least 1), first and last row numbers of page ``p``."""
    return page_numbers(df.agg(F.count(F.lit(1)).alias("total_rows")), p, n)


def page_numbers(totals: DataFrame, p: int, n: int = PAGE_SIZE) -> DataFrame:
    """E8 from a row with ``total_rows``."""
    return totals.select(
        "total_rows",
        F.greatest(F.ceil(F.col("total_rows") / F.lit(n)), F.lit(1)).cast("bigint").alias("page_count"),
        F.when(F.col("total_rows") > 0, F.lit(p * n + 1)).otherwise(0).cast("bigint").alias("first_row"),
        F.least(F.lit((p + 1) * n), F.col("total_rows")).cast("bigint").alias("last_row"),
    )
