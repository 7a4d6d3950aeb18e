"""Composite reports (R1-R4) and the nested report sink shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions.scalars import month_label
from starledger.operators import aggregates as agg
from starledger.operators.filters import project_public, subject_by_no
from starledger.operators.ranged import materialize
from starledger.operators.rollup import KeptRollup, report_rollup
from starledger.operators.versions import Versioned
from starledger.spec import DEFAULT_SPEC, StarSpec


def dashboard_totals(subject: DataFrame, fact: DataFrame, catalog: DataFrame,
                     spec: StarSpec = DEFAULT_SPEC, year: int | None = None) -> DataFrame:
    """D1 + D2 + D3 as one KPI row: the fact-side values come from one
    per-subject roll-up, the active count from the subject table."""
    return agg.merge_single_rows(
        agg.kpi_and_risk(fact, catalog, spec, year),
        agg.active_subjects(subject, spec),
    ).select(*agg.KPI_COLS, "active_students", "high_risk_students")


def dashboard(subject: DataFrame, fact: DataFrame, catalog: DataFrame,
              spec: StarSpec = DEFAULT_SPEC, year: int | None = None, n: int = 10,
              checkpoint: bool = True) -> dict[str, DataFrame]:
    """The dashboard parts for one year, as lazy frames over one roll-up
    of the year's facts, which is written once (``checkpoint=False`` leaves it
    a plan that each part runs)."""
    rolled = materialize(report_rollup(agg.year_facts(fact, spec, year), catalog, spec), checkpoint, "dashboard")
    return dashboard_parts(rolled, subject, catalog, spec, n)


def dashboard_parts(rolled: DataFrame, subject: DataFrame, catalog: DataFrame,
                    spec: StarSpec = DEFAULT_SPEC, n: int = 10) -> dict[str, DataFrame]:
    """The parts from the rows of ``report_rollup``, of facts or kept."""
    def level(name: str) -> DataFrame:
        return rolled.filter(F.col("level") == name)
    per = level("subject").filter(F.col("known") > 0)
    zero = F.lit(0).cast("bigint")
    kpi = per.agg(F.sum("known").alias("total_incidents"), F.sum("minor").alias("minor_incidents"),
                  F.sum("major").alias("major_incidents"), F.sum("points").alias("severity_points"),
                  F.sum("open").alias("open_cases"), F.count("key_id").alias("students_with_incidents"),
                  F.count_if(F.col("points") >= spec.high_points).alias("high_risk_students"))
    kpi = kpi.select(*[F.coalesce(c, zero).cast("bigint").alias(c) for c in kpi.columns])
    totals = agg.merge_single_rows(kpi, agg.active_subjects(subject, spec)) \
        .select(*agg.KPI_COLS, "active_students", "high_risk_students")
    monthly = level("month").filter(F.col("known") > 0).select(
        F.col("key_text").alias("month"), F.col("known").alias("total"), "minor", "major", "points")
    s = subject.select(F.col(spec.subject_key).alias("id"), F.col(spec.subject_no).alias("student_no"),
                       F.col(spec.first_name).alias("first_name"), F.col(spec.last_name).alias("last_name"),
                       F.col(spec.grade).alias("grade"), F.col(spec.section).alias("section"))
    tops = per.join(s, per["key_id"] == s["id"]).select(*s.columns, F.col("known").alias("incident_count"), "points")
    c = catalog.select(F.col(spec.catalog_key).alias("id"), F.col(spec.code).alias("code"),
                       F.col(spec.catalog_name).alias("name"), F.col(spec.category).alias("category"))
    items = level("item")
    top_items = items.join(c, items["key_id"] == c["id"]).select(*c.columns, F.col("total").alias("incident_count"))
    return {
        "totals": totals,
        "monthly": monthly,
        "top_subjects": tops.orderBy(F.desc("points"), F.desc("incident_count"), F.asc("id")).limit(n),
        "top_catalog": top_items.orderBy(F.desc("incident_count"), F.asc("name"), F.asc("id")).limit(n),
    }


def dashboard_bundle(parts: dict[str, DataFrame], year: int) -> DataFrame:
    """One row ``year, totals struct, monthly[], top_subjects[], top_catalog[]``.

    Every array is built from an already bounded frame (12 months at most,
    two top-N lists), so no unbounded group is collected.  Arrays are sorted
    by an explicit key so the document is deterministic.
    """
    t = parts["totals"]
    totals = t.select(F.struct(*t.columns).alias("totals"))
    monthly = parts["monthly"].agg(F.array_sort(F.collect_list(F.struct(*parts["monthly"].columns))).alias("monthly"))
    ts = parts["top_subjects"]
    top_s = ts.agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("points")).alias("_k1"), (-F.col("incident_count")).alias("_k2"), F.col("id").alias("_k3"),
        *ts.columns))).alias("_ts"))
    top_s = top_s.select(F.transform("_ts", lambda x: x.dropFields("_k1", "_k2", "_k3")).alias("top_students"))
    tc = parts["top_catalog"]
    top_c = tc.agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("incident_count")).alias("_k1"), F.col("name").alias("_k2"), F.col("id").alias("_k3"),
        *tc.columns))).alias("_tc"))
    top_c = top_c.select(F.transform("_tc", lambda x: x.dropFields("_k1", "_k2", "_k3")).alias("top_offenses"))
    out = agg.merge_single_rows(totals, monthly, top_s, top_c)
    return out.select(F.lit(year).alias("year"), "totals", "monthly", "top_students", "top_offenses")


def kept_dashboard(kept: KeptRollup, subject: DataFrame, catalog: DataFrame, year: int | None = None,
                   n: int = 10) -> dict[str, DataFrame]:
    """R1 from the kept roll-up: no fact is read."""
    rolled = materialize(kept.report_rollup(catalog, year), name="dashboard")
    return dashboard_parts(rolled, subject, catalog, kept.spec, n)


def kept_summary(kept: KeptRollup, subject: DataFrame, catalog: DataFrame, year: int | None = None) -> DataFrame:
    """D7/R2 from the kept roll-up."""
    r = kept.report_rollup(catalog, year).filter(F.col("level") == "subject")
    per = r.select(F.col("key_id").alias("_sid"), "total", "minor", "major", "points", "last_date")
    return agg.summary_of(subject, per, kept.spec)


def flat_bundle(bundle: DataFrame) -> DataFrame:
    """The nested document as rows (part, position from 1, field, value): the
    shape in which it can be compared with a flat query."""
    def cells(part: str, position: Column, row: Column, fields: list[str]) -> Column:
        return F.array(*[F.struct(F.lit(part).alias("part"), position.cast("bigint").alias("position"), F.lit(f).alias("field"),
                                  row.getField(f).cast("string").alias("value")) for f in fields])
    fields = {c: [x.name for x in (t.elementType if hasattr(t, "elementType") else t).fields]
              for c, t in ((f.name, f.dataType) for f in bundle.schema.fields) if c != "year"}
    parts = [cells("totals", F.lit(1), F.col("totals"), fields["totals"])]

    def listed(part: str) -> Column:
        return F.flatten(F.transform(part, lambda row, i: cells(part, i + 1, row, fields[part])))
    parts += [listed(c) for c in fields if c != "totals"]
    return bundle.select("year", F.explode(F.concat(*parts)).alias("_c")).select("year", "_c.*")


def monthly_labels(monthly: DataFrame) -> DataFrame:
    """Chart series rows: month, label, total, minor, major, points."""
    return monthly.select("month", month_label("month").alias("label"), "total", "minor", "major", "points")


def subject_record(subject: DataFrame, fact: DataFrame, catalog: DataFrame,
                   spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """R3 (batch form): profile + all-time totals for every Active subject.

    The portal serves only Active subjects; the history part is the flat
    ``record_history`` listing, never a per-subject collected array.
    """
    prof = subject.filter(F.col(spec.subject_status) == spec.active_status).select(
        F.col(spec.subject_key).alias("id"), F.col(spec.subject_no).alias("student_no"),
        F.col(spec.first_name).alias("first_name"), F.col(spec.last_name).alias("last_name"),
        F.col(spec.grade).alias("grade"), F.col(spec.section).alias("section"),
        F.col(spec.adviser).alias("adviser"), F.col(spec.subject_status).alias("status"))
    tot = agg.subject_totals(subject, fact, catalog, spec).withColumnRenamed("id", "_tid")
    j = prof.join(tot, prof["id"] == tot["_tid"], "left").drop("_tid")
    zero = F.lit(0).cast("bigint")
    return j.select(*prof.columns, *[F.coalesce(c, zero).alias(c) for c in (
        "total_incidents", "minor_incidents", "major_incidents", "severity_points")])


def record_history(subject: DataFrame, fact: DataFrame, catalog: DataFrame,
                   spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """R3 history for Active subjects: fact rows with catalog details, to be
    read in (subject, date DESC, id DESC) order (a global sort, which range
    partitions on the whole composite key and so spreads a hot subject)."""
    act = subject.filter(F.col(spec.subject_status) == spec.active_status) \
        .select(F.col(spec.subject_key).alias("_sid"))
    f = fact.join(act, fact[spec.fact_subject] == act["_sid"], "left_semi")
    c = catalog.select(F.col(spec.catalog_key).alias("_cid"), F.col(spec.code).alias("offense_code"),
                       F.col(spec.catalog_name).alias("offense_name"), F.col(spec.category).alias("category"),
                       F.col(spec.points).alias("severity_points"))
    from starledger.operators.joins import bounded_broadcast
    j = f.join(bounded_broadcast(c, within=catalog), f[spec.fact_catalog] == c["_cid"], "inner")
    return j.select(F.col(spec.fact_subject).alias("student_id"), F.col(spec.fact_key).alias("id"),
                    spec.fact_no, spec.fact_date, spec.action, spec.fact_status, spec.reporter, spec.notes,
                    "offense_code", "offense_name", "category", "severity_points")


def record_by_no(subject: DataFrame, facts: Versioned, catalog: DataFrame, number: str,
                 spec: StarSpec = DEFAULT_SPEC) -> dict[str, DataFrame]:
    """One Active person's record by number, ignoring case.  ``facts``
    is kept in buckets of the subject key: the files of one bucket are read.
    The driver collects the person's id (the lowest, where a number repeats
    in other case)."""
    prof = subject_by_no(subject, number, spec).filter(F.col(spec.subject_status) == spec.active_status)
    key = prof.agg(F.min(spec.subject_key).alias("k")).first()["k"]
    prof = prof.filter(F.col(spec.subject_key) == F.lit(key))
    own = facts.rows_of([]) if key is None else facts.lookup(key)
    return {
        "subject": project_public(prof),
        "totals": agg.subject_totals(prof, own, catalog, spec),
        "history": history_order(record_history(prof, own, catalog, spec)),
    }


def history_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc("student_id"), F.desc("incident_date"), F.desc("id"))
