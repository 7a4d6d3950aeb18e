"""Predicate Column builders.

Date predicates are half-open ranges on the raw column, never
``year(c) = y`` or ``date_format(c) = m``: a range reaches the Parquet scan
as ``PushedFilters: [GreaterThanOrEqual, LessThan]`` and prunes row groups by
min/max statistics, a function of the column does not.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from starledger.functions.scalars import col_


def in_year(c: str | Column, year: int) -> Column:
    """``c`` falls in calendar ``year``."""
    lo, hi = _dt.date(year, 1, 1), _dt.date(year + 1, 1, 1)
    x = col_(c)
    return (x >= F.lit(lo)) & (x < F.lit(hi))


def in_month(c: str | Column, month: str) -> Column:
    """``c`` falls in month ``'yyyy-MM'``."""
    y, m = (int(p) for p in month.split("-")[:2])
    lo = _dt.date(y, m, 1)
    hi = _dt.date(y + (m == 12), 1 if m == 12 else m + 1, 1)
    x = col_(c)
    return (x >= F.lit(lo)) & (x < F.lit(hi))


def eq_filters(**kv) -> Column | None:
    """B2: AND of ``col == value`` for the non-blank values; None = no filter."""
    terms = [F.col(k) == v for k, v in kv.items() if v not in (None, "")]
    return reduce(lambda a, b: a & b, terms) if terms else None


def contains_ci(c: str | Column, q: str) -> Column:
    """Literal, case-insensitive substring match (``%``/``_`` are not wildcards)."""
    return F.lower(col_(c)).contains(q.lower())


def any_contains(cols: Sequence[str | Column], q: str) -> Column:
    """Any of ``cols`` contains ``q`` (case-insensitive)."""
    return reduce(lambda a, b: a | b, [F.coalesce(contains_ci(c, q), F.lit(False)) for c in cols])


def haystack(cols: Sequence[str | Column], sep: str = " ") -> Column:
    """One lower-cased string of the rendered cells."""
    return F.lower(F.concat_ws(sep, *[col_(c).cast("string") for c in cols]))
