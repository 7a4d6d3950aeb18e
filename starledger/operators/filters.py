"""Projections, filters and searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions.predicates import any_contains, eq_filters, haystack, in_month, in_year
from starledger.functions.scalars import dash_if_blank, strip_text
from starledger.spec import DEFAULT_SPEC, SUGGEST_SIZE, StarSpec

# Public subject columns (secrets such as credential hashes are never listed).
SUBJECT_PUBLIC = ("id", "student_no", "first_name", "last_name", "grade", "section", "adviser", "status")

__all__ = ["project_public", "filter_eq", "search_any", "in_year", "in_month", "active_only",
           "search_table", "suggest", "lookup_label", "subject_by_no", "subject_by_id", "with_labels"]


def project_public(df: DataFrame, cols: Sequence[str] = SUBJECT_PUBLIC) -> DataFrame:
    """B1: keep only the public columns that exist in ``df``."""
    return df.select(*[c for c in cols if c in df.columns])


def filter_eq(df: DataFrame, **kv) -> DataFrame:
    """B2: equality filters; a blank value means no filter on that column."""
    cond = eq_filters(**kv)
    return df if cond is None else df.filter(cond)


def search_any(df: DataFrame, q: str, cols: Sequence[str]) -> DataFrame:
    """Rows where any of ``cols`` contains ``q`` ignoring case; blank q = all."""
    return df if not q else df.filter(any_contains(cols, q))


def active_only(df: DataFrame, active_col: str = "active", on: bool = True) -> DataFrame:
    """B6."""
    return df.filter(F.col(active_col)) if on else df


def search_table(df: DataFrame, q: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Table-wide search over rendered cells: a row is kept when any
    searchable cell, as text, contains ``q`` ignoring case.  Blank q = all."""
    if not q:
        return df
    cols = list(cols or df.columns)
    return df.filter(any_contains([F.col(c).cast("string") for c in cols], q))


def grade_section(spec: StarSpec = DEFAULT_SPEC) -> Column:
    return F.concat_ws("-", F.col(spec.grade), F.col(spec.section))


def subject_haystack(spec: StarSpec = DEFAULT_SPEC) -> Column:
    return haystack([F.col(spec.subject_no), F.col(spec.first_name), F.col(spec.last_name),
                     grade_section(spec), F.col(spec.adviser)])


def suggest(subject: DataFrame, q: str, spec: StarSpec = DEFAULT_SPEC, n: int = SUGGEST_SIZE) -> DataFrame:
    """First ``n`` subjects (list order E1) whose haystack contains the
    trimmed, lower-cased query; a blank query gives the first ``n``."""
    from starledger.operators.ordering import subject_list_order
    t = (q or "").strip().lower()
    df = subject if not t else subject.filter(subject_haystack(spec).contains(t))
    return subject_list_order(df, spec).limit(n)


def option_label(spec: StarSpec = DEFAULT_SPEC) -> Column:
    """'<no> - <first> <last> (<grade>-<section>)'."""
    return F.concat(F.col(spec.subject_no), F.lit(" - "), F.col(spec.first_name), F.lit(" "),
                    F.col(spec.last_name), F.lit(" ("), grade_section(spec), F.lit(")"))


def label_is(text: Column, spec: StarSpec = DEFAULT_SPEC) -> Column:
    """The subject's option label equals the trimmed text, ignoring case."""
    return F.lower(option_label(spec)) == F.lower(strip_text(text))


def lookup_label(subject: DataFrame, text: str, spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """B10 for one typed text."""
    return subject.filter(label_is(F.lit(text or ""), spec))


def lookup_labels(subject: DataFrame, typed: DataFrame, col: str, spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """B10 for many typed texts: ``typed`` with the subjects each one names
    (null columns where it names none); an equi-join on the folded label."""
    return typed.join(subject, label_is(F.coalesce(typed[col], F.lit("")), spec), "left")


def subject_by_no(subject: DataFrame, number: str, spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """Point lookup by subject number, ignoring case."""
    return subject.filter(F.lower(F.col(spec.subject_no)) == (number or "").lower())


def subject_by_id(subject: DataFrame, key: int, spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """Point lookup by id (pushed to the scan as an equality filter)."""
    return subject.filter(F.col(spec.subject_key) == key)


def with_labels(subject: DataFrame, spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """Display columns: full name, grade-section, option label, adviser or '—'."""
    return subject.select(
        F.col(spec.subject_key).alias("id"),
        F.concat_ws(" ", F.col(spec.first_name), F.col(spec.last_name)).alias("full_name"),
        grade_section(spec).alias("grade_section"),
        option_label(spec).alias("option_label"),
        dash_if_blank(spec.adviser).alias("adviser_display"),
    )
