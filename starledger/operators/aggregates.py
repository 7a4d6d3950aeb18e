"""Aggregations.

Every roll-up aggregates the fact table *before* joining subject names:
the group key is the bare foreign key, Spark's partial (map-side) aggregation
collapses a hot key inside each map task, and only one row per key crosses
the shuffle.  When the catalog is not provably small, facts are first reduced
to one row per (subject, catalog item) so that the catalog join runs on the
reduced rows, never on raw facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions.predicates import in_year
from starledger.functions.scalars import count_when, month_text, risk_band, seq_suffix
from starledger.operators.joins import catalog_cols, is_constant, with_catalog
from starledger.spec import DEFAULT_SPEC, StarSpec


YEAR_PARTITION = "incident_year"


def with_year_partition(fact: DataFrame, spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """Add the ``incident_year`` column to write facts ``partitionBy`` year."""
    return fact.withColumn(YEAR_PARTITION, F.year(spec.fact_date))


def year_facts(fact: DataFrame, spec: StarSpec = DEFAULT_SPEC, year: int | None = None) -> DataFrame:
    """B4 applied: the facts of one calendar year.  The date range is pushed to
    the Parquet scan (row-group pruning); when the table is partitioned by
    ``incident_year`` the equality on it prunes whole directories too."""
    if year is None:
        return fact
    f = fact.filter(in_year(spec.fact_date, year))
    if YEAR_PARTITION in fact.columns:
        f = f.filter(F.col(YEAR_PARTITION) == year)
    return f


def subject_rollup(fact: DataFrame, catalog: DataFrame, spec: StarSpec = DEFAULT_SPEC,
                   how: str = "inner") -> DataFrame:
    """Per-subject totals of ``fact ⋈ catalog``: ``_sid, total, minor, major,
    points, last_date``.  ``how="inner"`` drops facts whose catalog row is
    missing; ``how="left"`` counts them with no category and no points."""
    if is_constant(catalog):
        f = with_catalog(fact.select(spec.fact_subject, spec.fact_catalog, spec.fact_date, spec.fact_status),
                         catalog, spec, (spec.category, spec.points), how=how)
        return f.groupBy(F.col(spec.fact_subject).alias("_sid")).agg(
            F.count(F.lit(1)).alias("total"),
            count_when(F.col(spec.category) == spec.minor).alias("minor"),
            count_when(F.col(spec.category) == spec.major).alias("major"),
            F.sum(spec.points).cast("bigint").alias("points"),
            F.max(spec.fact_date).alias("last_date"),
            count_when(F.col(spec.fact_status) == spec.open_status).alias("open"),
        )
    # Large catalog: collapse facts to (subject, item) pairs, join, re-aggregate.
    pairs = fact.groupBy(F.col(spec.fact_subject).alias("_sid"),
                         F.col(spec.fact_catalog).alias("_cid")).agg(
        F.count(F.lit(1)).alias("n"), F.max(spec.fact_date).alias("d"),
        count_when(F.col(spec.fact_status) == spec.open_status).alias("o"))
    cat = catalog_cols(catalog, spec, (spec.category, spec.points))
    j = pairs.join(cat, pairs["_cid"] == cat["_cat_id"], how)
    return j.groupBy("_sid").agg(
        F.sum("n").cast("bigint").alias("total"),
        F.sum(F.when(F.col(spec.category) == spec.minor, F.col("n")).otherwise(0)).cast("bigint").alias("minor"),
        F.sum(F.when(F.col(spec.category) == spec.major, F.col("n")).otherwise(0)).cast("bigint").alias("major"),
        F.sum(F.col("n") * F.col(spec.points)).cast("bigint").alias("points"),
        F.max("d").alias("last_date"),
        F.sum("o").cast("bigint").alias("open"),
    )


KPI_COLS = ("total_incidents", "minor_incidents", "major_incidents", "severity_points",
            "open_cases", "students_with_incidents")


def kpi_and_risk(fact: DataFrame, catalog: DataFrame, spec: StarSpec = DEFAULT_SPEC,
                 year: int | None = None, threshold: int | None = None) -> DataFrame:
    """D1 + D3 from ONE per-subject roll-up of ``fact ⋈ catalog``.

    The roll-up has one row per subject, so the exact distinct-subject count
    is its non-null key count (no separate distinct aggregation) and the
    high-risk count is a conditional count over it: the year's facts are
    scanned and shuffled once for all seven values.
    """
    t = spec.high_points if threshold is None else threshold
    per = subject_rollup(year_facts(fact, spec, year), catalog, spec)
    out = per.agg(
        F.sum("total").alias("total_incidents"),
        F.sum("minor").alias("minor_incidents"),
        F.sum("major").alias("major_incidents"),
        F.sum("points").alias("severity_points"),
        F.sum("open").alias("open_cases"),
        F.count(F.col("_sid")).alias("students_with_incidents"),
        F.count_if(F.col("points") >= t).alias("high_risk_students"),
    )
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                        for c in (*KPI_COLS, "high_risk_students")])


def kpi_totals(fact: DataFrame, catalog: DataFrame, spec: StarSpec = DEFAULT_SPEC,
               year: int | None = None) -> DataFrame:
    """One row of year KPIs.  Conditional sums are coalesced to 0 on an
    empty year (decision Q1).  ``students_with_incidents`` is exact."""
    return kpi_and_risk(fact, catalog, spec, year).select(*KPI_COLS)


def active_subjects(subject: DataFrame, spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """Count of Active subjects (not limited by year, Q10)."""
    return subject.filter(F.col(spec.subject_status) == spec.active_status) \
        .agg(F.count(F.lit(1)).alias("active_students"))


def high_risk_count(fact: DataFrame, catalog: DataFrame, spec: StarSpec = DEFAULT_SPEC,
                    year: int | None = None, threshold: int | None = None) -> DataFrame:
    """D3: number of subjects whose year points reach ``threshold``."""
    t = spec.high_points if threshold is None else threshold
    per = subject_rollup(year_facts(fact, spec, year), catalog, spec)
    return per.filter(F.col("points") >= t).agg(F.count(F.lit(1)).alias("high_risk_students"))


def monthly_trend(fact: DataFrame, catalog: DataFrame, spec: StarSpec = DEFAULT_SPEC,
                  year: int | None = None, fill_gaps: bool = False) -> DataFrame:
    """Total, minor, major, points per 'yyyy-MM'; empty months are absent
    unless ``fill_gaps`` (needs ``year``): then a 12-month spine (a constant
    12-row relation) is left-joined and empty months show zeros."""
    f = year_facts(fact, spec, year).select(spec.fact_date, spec.fact_catalog)
    f = with_catalog(f, catalog, spec, (spec.category, spec.points))
    out = f.groupBy(month_text(spec.fact_date).alias("month")).agg(
        F.count(F.lit(1)).alias("total"),
        count_when(F.col(spec.category) == spec.minor).alias("minor"),
        count_when(F.col(spec.category) == spec.major).alias("major"),
        F.coalesce(F.sum(spec.points), F.lit(0)).cast("bigint").alias("points"),
    )
    if not fill_gaps:
        return out
    if year is None:
        raise ValueError("fill_gaps needs a year")
    from pyspark.sql import types as T
    from starledger.sources.constants import values_frame
    spine = values_frame(out.sparkSession, [(f"{year:04d}-{m:02d}",) for m in range(1, 13)],
                         T.StructType([T.StructField("month", T.StringType())]))
    j = spine.join(out, "month", "left")
    zero = F.lit(0).cast("bigint")
    return j.select("month", *[F.coalesce(c, zero).alias(c) for c in ("total", "minor", "major", "points")])


def top_subjects(fact: DataFrame, subject: DataFrame, catalog: DataFrame,
                 spec: StarSpec = DEFAULT_SPEC, year: int | None = None, n: int = 10) -> DataFrame:
    """Top ``n`` subjects by points DESC, count DESC (id breaks ties).

    Aggregated per subject first; the join to subject names runs on the
    aggregate (one row per subject), and the limit is a TakeOrderedAndProject.
    """
    per = subject_rollup(year_facts(fact, spec, year), catalog, spec)
    s = subject.select(F.col(spec.subject_key).alias("id"), F.col(spec.subject_no).alias("student_no"),
                       F.col(spec.first_name).alias("first_name"), F.col(spec.last_name).alias("last_name"),
                       F.col(spec.grade).alias("grade"), F.col(spec.section).alias("section"))
    j = per.join(s, per["_sid"] == s["id"], "inner")
    out = j.select("id", "student_no", "first_name", "last_name", "grade", "section",
                   F.col("total").alias("incident_count"), F.col("points"))
    return out.orderBy(F.desc("points"), F.desc("incident_count"), F.asc("id")).limit(n)


def top_catalog(fact: DataFrame, catalog: DataFrame, spec: StarSpec = DEFAULT_SPEC,
                year: int | None = None, n: int = 10) -> DataFrame:
    """Top ``n`` catalog items by fact count DESC, name (id breaks ties)."""
    per = year_facts(fact, spec, year).groupBy(F.col(spec.fact_catalog).alias("_cid")) \
        .agg(F.count(F.lit(1)).alias("incident_count"))
    c = catalog.select(F.col(spec.catalog_key).alias("id"), F.col(spec.code).alias("code"),
                       F.col(spec.catalog_name).alias("name"), F.col(spec.category).alias("category"))
    j = per.join(c, per["_cid"] == c["id"], "inner")
    return j.select("id", "code", "name", "category", "incident_count") \
        .orderBy(F.desc("incident_count"), F.asc("name"), F.asc("id")).limit(n)


def subject_summary(subject: DataFrame, fact: DataFrame, catalog: DataFrame,
                    spec: StarSpec = DEFAULT_SPEC, year: int | None = None) -> DataFrame:
    """Every subject with year totals, last date and risk band.

    Equivalent to ``subject LEFT JOIN fact ON (key AND year) LEFT JOIN
    catalog``: the year predicate filters facts *before* the join, so
    subjects without facts that year stay with zero counts and NULL date.
    """
    return summary_of(subject, subject_rollup(year_facts(fact, spec, year), catalog, spec, how="left"), spec)


def summary_of(subject: DataFrame, per: DataFrame, spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """D7 from per-subject totals (``_sid, total, minor, major, points, last_date``)."""
    s = subject.select(F.col(spec.subject_key).alias("id"), F.col(spec.subject_no).alias("student_no"),
                       F.col(spec.first_name).alias("first_name"), F.col(spec.last_name).alias("last_name"),
                       F.col(spec.grade).alias("grade"), F.col(spec.section).alias("section"))
    j = s.join(per, s["id"] == per["_sid"], "left")
    zero = F.lit(0).cast("bigint")
    total = F.coalesce(F.col("total"), zero)
    points = F.coalesce(F.col("points"), zero)
    return j.select(
        "id", "student_no", "first_name", "last_name", "grade", "section",
        total.alias("total_offenses"),
        F.coalesce(F.col("minor"), zero).alias("minor_offenses"),
        F.coalesce(F.col("major"), zero).alias("major_offenses"),
        points.alias("severity_points"),
        F.col("last_date").alias("last_incident_date"),
        risk_band(points, total, spec.high_points, spec.monitor_points).alias("risk_band"),
    )


def summary_keys() -> list[Column]:
    """Points DESC, total DESC, grade (as text), section, last name, id."""
    return [F.desc("severity_points"), F.desc("total_offenses"), F.asc("grade"),
            F.asc("section"), F.asc("last_name"), F.asc("id")]


def summary_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*summary_keys())


def subject_totals(subject: DataFrame, fact: DataFrame, catalog: DataFrame,
                   spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """D8 (batch form): all-time totals per subject, every value coalesced to 0."""
    per = subject_rollup(fact, catalog, spec)
    s = subject.select(F.col(spec.subject_key).alias("id"))
    j = s.join(per, s["id"] == per["_sid"], "left")
    zero = F.lit(0).cast("bigint")
    return j.select("id",
                    F.coalesce("total", zero).alias("total_incidents"),
                    F.coalesce("minor", zero).alias("minor_incidents"),
                    F.coalesce("major", zero).alias("major_incidents"),
                    F.coalesce("points", zero).alias("severity_points"))


def risk_band_counts(summary: DataFrame) -> DataFrame:
    """Subjects per risk band."""
    return summary.groupBy("risk_band").agg(F.count(F.lit(1)).alias("subjects"))


def next_seq(fact: DataFrame, col: str = "incident_no", prefix: str = "INC-") -> DataFrame:
    """1 + the largest numeric suffix after ``prefix`` (1 when none)."""
    return fact.agg((F.coalesce(F.max(seq_suffix(col, prefix)), F.lit(0)) + 1).cast("bigint").alias("next_no"))


def row_counts(**tables: DataFrame) -> DataFrame:
    """(table_name, row_count) for each named frame."""
    frames = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def merge_single_rows(*frames: DataFrame) -> DataFrame:
    """Combine one-row frames with disjoint columns into one row without a
    cross join: union (missing columns NULL) and take each column's value."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.first(F.col(c), ignorenulls=True).alias(c) for c in out.columns])

