"""Registered report queries (dashboard, summary, record) on Map 1 / Map 2."""

from __future__ import annotations

from starledger.operators import aggregates as agg
from starledger.plans import fixtures as fx
from starledger.plans import reports
from starledger.plans.registry import register

Y = fx.REPORT_YEAR
M1 = fx.orders_star_cte()
M2 = fx.lineitem_star_cte()
SUBJECT_COLS = "subj.id, subj.student_no, subj.first_name, subj.last_name, subj.grade, subj.section"


# The oracles count per foreign key first and attach names afterwards.
def per_subject_cte(name: str, only: str, how: str = "") -> str:
    """CTE: number, kinds, points, open cases and last date of each subject's facts."""
    return f"""{name} AS (
  SELECT student_id, count(*) AS n, max(incident_date) AS latest,
         count(*) FILTER (WHERE cat.category = 'Minor') AS n_minor,
         count(*) FILTER (WHERE cat.category = 'Major') AS n_major,
         count(*) FILTER (WHERE fact.status = 'Open') AS n_open,
         CAST(coalesce(sum(cat.severity_points), 0) AS BIGINT) AS pts
  FROM fact {how} JOIN cat ON fact.offense_id = cat.id
  WHERE {only} GROUP BY student_id)"""


def summary_cte(year: int) -> str:
    """CTE ``sm``: the subject summary of one year."""
    return per_subject_cte("sums", f"year(incident_date) = {year}", "LEFT") + f""",
sm AS (
  SELECT {SUBJECT_COLS}, coalesce(sums.n, 0) AS total_offenses, coalesce(n_minor, 0) AS minor_offenses,
         coalesce(n_major, 0) AS major_offenses, coalesce(pts, 0) AS severity_points, latest AS last_incident_date,
         CASE WHEN sums.n IS NULL THEN 'None' WHEN pts < 6 THEN 'Low' WHEN pts < 12 THEN 'Monitor' ELSE 'High' END AS risk_band
  FROM subj LEFT JOIN sums ON sums.student_id = subj.id)"""


SUMMARY_CTE = summary_cte(Y)
YEAR_SUMS = per_subject_cte("sums", f"year(incident_date) = {Y}")


def _m1(spark, sf_dir):
    return fx.orders_star(spark, sf_dir)


@register("subject_summary", f"{M1}, {SUMMARY_CTE} SELECT * FROM sm")
def q_subject_summary(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return agg.subject_summary(st.subject, st.fact, st.catalog, year=Y)


@register("subject_summary_lineitem", f"{M2}, {SUMMARY_CTE} SELECT * FROM sm")
def q_subject_summary_lineitem(spark, sf_dir):
    st = fx.lineitem_star(spark, sf_dir)
    return agg.subject_summary(st.subject, st.fact, st.catalog, year=Y)


@register("dashboard_totals", f"""{M1}, {YEAR_SUMS}
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_incidents, CAST(coalesce(sum(n_minor), 0) AS BIGINT) AS minor_incidents,
       CAST(coalesce(sum(n_major), 0) AS BIGINT) AS major_incidents, CAST(coalesce(sum(pts), 0) AS BIGINT) AS severity_points,
       CAST(coalesce(sum(n_open), 0) AS BIGINT) AS open_cases, count(student_id) AS students_with_incidents,
       (SELECT count(*) FROM subj WHERE status = 'Active') AS active_students,
       count(*) FILTER (WHERE pts >= 12) AS high_risk_students
FROM sums""")
def q_dashboard_totals(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return reports.dashboard_totals(st.subject, st.fact, st.catalog, year=Y)


@register("active_subjects", f"{M1} SELECT COUNT(*) AS active_students FROM subj WHERE status = 'Active'")
def q_active_subjects(spark, sf_dir):
    return agg.active_subjects(_m1(spark, sf_dir).subject)


@register("high_risk_count", f"{M1}, {YEAR_SUMS} SELECT count(*) AS high_risk_students FROM sums WHERE pts >= 12")
def q_high_risk_count(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return agg.high_risk_count(st.fact, st.catalog, year=Y)


def monthly_sql(year: int) -> str:
    """Counts per month and item first, then weighed by the catalog."""
    return f"""SELECT ym AS month, CAST(sum(n) AS BIGINT) AS total,
       CAST(coalesce(sum(n) FILTER (WHERE category = 'Minor'), 0) AS BIGINT) AS minor,
       CAST(coalesce(sum(n) FILTER (WHERE category = 'Major'), 0) AS BIGINT) AS major,
       CAST(coalesce(sum(n * severity_points), 0) AS BIGINT) AS points
FROM (SELECT strftime(incident_date, '%Y-%m') AS ym, offense_id, count(*) AS n
      FROM fact WHERE year(incident_date) = {year} GROUP BY ALL) per_item
JOIN cat ON per_item.offense_id = cat.id GROUP BY ym"""


MONTHLY_SQL = monthly_sql(Y)


@register("monthly_trend", f"{M1} {MONTHLY_SQL}")
def q_monthly_trend(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return agg.monthly_trend(st.fact, st.catalog, year=Y)


@register("monthly_labels", f"""{M1}, m AS ({MONTHLY_SQL})
SELECT month, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][CAST(substr(month, 6, 2) AS INTEGER)] AS label,
       total, minor, major, points FROM m""")
def q_monthly_labels(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return reports.monthly_labels(agg.monthly_trend(st.fact, st.catalog, year=Y))


TOP_SUBJECTS_SQL = f"""SELECT {SUBJECT_COLS}, n AS incident_count, pts AS points
FROM subj JOIN sums ON sums.student_id = subj.id
ORDER BY pts DESC, n DESC, subj.id LIMIT 10"""


@register("top_subjects", f"{M1}, {YEAR_SUMS} {TOP_SUBJECTS_SQL}")
def q_top_subjects(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return agg.top_subjects(st.fact, st.subject, st.catalog, year=Y)


@register("top_subjects_lineitem", f"{M2}, {YEAR_SUMS} {TOP_SUBJECTS_SQL}")
def q_top_subjects_lineitem(spark, sf_dir):
    st = fx.lineitem_star(spark, sf_dir)
    return agg.top_subjects(st.fact, st.subject, st.catalog, year=Y)


TOP_CATALOG_SQL = f"""SELECT cat.id, cat.code, cat.name, cat.category, per_item.n AS incident_count
FROM cat JOIN (SELECT offense_id, count(*) AS n FROM fact WHERE year(incident_date) = {Y} GROUP BY offense_id) per_item
  ON per_item.offense_id = cat.id
ORDER BY per_item.n DESC, cat.name, cat.id LIMIT 10"""


@register("top_catalog", f"{M1} {TOP_CATALOG_SQL}")
def q_top_catalog(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return agg.top_catalog(st.fact, st.catalog, year=Y)


@register("top_catalog_lineitem", f"{M2} {TOP_CATALOG_SQL}")
def q_top_catalog_lineitem(spark, sf_dir):
    st = fx.lineitem_star(spark, sf_dir)
    return agg.top_catalog(st.fact, st.catalog, year=Y)


@register("top_catalog_share", f"""{M2}, t AS ({TOP_CATALOG_SQL}),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY incident_count DESC, name, id) AS rank_no FROM t)
SELECT rank_no, id, code, name, incident_count,
       CAST(GREATEST(8, ROUND(100.0 * incident_count / GREATEST(MAX(incident_count) OVER (), 1))) AS BIGINT) AS share_pct
FROM r WHERE rank_no <= 5""")
def q_top_catalog_share(spark, sf_dir):
    from starledger.operators.windows import rank_share
    st = fx.lineitem_star(spark, sf_dir)
    return rank_share(agg.top_catalog(st.fact, st.catalog, year=Y), k=5)


@register("summary_ranked", f"""{M1}, {SUMMARY_CTE}
SELECT *, ROW_NUMBER() OVER (ORDER BY severity_points DESC, total_offenses DESC, grade, section, last_name, id) AS rank_no FROM sm""")
def q_summary_ranked(spark, sf_dir):
    from starledger.operators.paging import ranked
    return ranked(q_subject_summary(spark, sf_dir), agg.summary_keys())


@register("risk_band_counts", f"{M1}, {SUMMARY_CTE} SELECT risk_band, COUNT(*) AS subjects FROM sm GROUP BY risk_band")
def q_risk_band_counts(spark, sf_dir):
    return agg.risk_band_counts(q_subject_summary(spark, sf_dir))


@register("summary_filtered", f"{M1}, {SUMMARY_CTE} SELECT * FROM sm WHERE risk_band = 'Monitor' AND grade = '7'")
def q_summary_filtered(spark, sf_dir):
    from starledger.operators.filters import filter_eq
    return filter_eq(q_subject_summary(spark, sf_dir), risk_band="Monitor", grade="7")


ALL_SUMS = per_subject_cte("sums", "TRUE")
TOTALS_SQL = """SELECT subj.id, coalesce(n, 0) AS total_incidents, coalesce(n_minor, 0) AS minor_incidents,
       coalesce(n_major, 0) AS major_incidents, coalesce(pts, 0) AS severity_points
FROM subj LEFT JOIN sums ON sums.student_id = subj.id"""


@register("subject_totals", f"{M1}, {ALL_SUMS} {TOTALS_SQL}")
def q_subject_totals(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return agg.subject_totals(st.subject, st.fact, st.catalog)


@register("record_for_subject", f"""{M1}, {ALL_SUMS}, tt AS ({TOTALS_SQL})
SELECT s.id, s.student_no, s.first_name, s.last_name, s.grade, s.section, s.adviser, s.status,
       tt.total_incidents, tt.minor_incidents, tt.major_incidents, tt.severity_points
FROM subj s JOIN tt ON tt.id = s.id WHERE s.status = 'Active'""")
def q_record_for_subject(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return reports.subject_record(st.subject, st.fact, st.catalog)


@register("record_history", f"""{M1}
SELECT i.student_id, i.id, i.incident_no, i.incident_date, i.action_taken, i.status, i.reported_by, i.notes,
       o.code AS offense_code, o.name AS offense_name, o.category, o.severity_points
FROM fact i JOIN cat o ON o.id = i.offense_id
WHERE i.student_id IN (SELECT id FROM subj WHERE status = 'Active')""")
def q_record_history(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return reports.record_history(st.subject, st.fact, st.catalog)


# The nested document, flattened on both sides: (part, position, field, value).
def _flat_sql(part: str, source: str, order: str, fields: list[str]) -> str:
    rows = f"(SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS position FROM ({source}) q)"
    return " UNION ALL ".join(f"SELECT '{part}' AS part, position, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM {rows}" for f in fields)


TOTAL_FIELDS = [*agg.KPI_COLS, "active_students", "high_risk_students"]
TOTALS_ROW_SQL = """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_incidents, CAST(coalesce(sum(n_minor), 0) AS BIGINT) AS minor_incidents,
       CAST(coalesce(sum(n_major), 0) AS BIGINT) AS major_incidents, CAST(coalesce(sum(pts), 0) AS BIGINT) AS severity_points,
       CAST(coalesce(sum(n_open), 0) AS BIGINT) AS open_cases, count(student_id) AS students_with_incidents,
       (SELECT count(*) FROM subj WHERE status = 'Active') AS active_students, count(*) FILTER (WHERE pts >= 12) AS high_risk_students
FROM sums"""


def bundle_sql(cte: str) -> str:
    parts = [
        _flat_sql("totals", TOTALS_ROW_SQL, "total_incidents", TOTAL_FIELDS),
        _flat_sql("monthly", MONTHLY_SQL, "month", ["month", "total", "minor", "major", "points"]),
        _flat_sql("top_students", TOP_SUBJECTS_SQL, "points DESC, incident_count DESC, id",
                  ["id", "student_no", "first_name", "last_name", "grade", "section", "incident_count", "points"]),
        _flat_sql("top_offenses", TOP_CATALOG_SQL, "incident_count DESC, name, id", ["id", "code", "name", "category", "incident_count"]),
    ]
    return f"{cte}, {YEAR_SUMS} SELECT CAST({Y} AS INTEGER) AS year, * FROM ({' UNION ALL '.join(parts)}) u"


@register("dashboard_bundle", bundle_sql(M1))
def q_dashboard_bundle(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return reports.flat_bundle(reports.dashboard_bundle(reports.dashboard(st.subject, st.fact, st.catalog, year=Y), Y))


@register("dashboard_bundle_lineitem", bundle_sql(M2))
def q_dashboard_bundle_lineitem(spark, sf_dir):
    st = fx.lineitem_star(spark, sf_dir)
    return reports.flat_bundle(reports.dashboard_bundle(reports.dashboard(st.subject, st.fact, st.catalog, year=Y), Y))


# The kept roll-up through a write: a fifth of the facts is deleted, a seventh
# moves to other subjects, items, dates and states, an eleventh is added.
def _write(spark, sf_dir):
    from pyspark.sql import functions as F
    st = fx.lineitem_star(spark, sf_dir)
    f, k = st.fact, F.col("id")
    deleted = f.filter(k % 5 == 0)
    before = f.filter((k % 5 != 0) & (k % 7 == 0))
    moved = before.withColumns({"student_id": F.col("student_id") % 50 + 1, "incident_date": F.date_add("incident_date", 40),
                                "status": F.when(F.col("status") == "Open", "Resolved").otherwise("Open")})
    new = f.filter(k % 11 == 0).withColumns({"id": k + 100_000_000, "offense_id": F.col("offense_id") % 90 + 1})
    after = f.filter((k % 5 != 0) & (k % 7 != 0)).unionByName(moved).unionByName(new)
    return st, deleted.unionByName(before), moved.unionByName(new), after


def _kept(spark, sf_dir):
    from starledger.operators.ranged import materialize
    from starledger.operators.rollup import KeptRollup, build_rollup
    st, removed, added, after = _write(spark, sf_dir)
    kept = KeptRollup(materialize(build_rollup(st.fact).cells, name="rollup"))
    return st, KeptRollup(materialize(kept.changed(removed, added, after).cells, name="rollup"))


AFTER_CTE = f"""{M2.replace('fact AS (', 'fact0 AS (')},
fact AS (SELECT * FROM fact0 WHERE id % 5 <> 0 AND id % 7 <> 0
  UNION ALL SELECT id, incident_no, incident_date + 40, student_id % 50 + 1, offense_id, action_taken,
                   CASE WHEN status = 'Open' THEN 'Resolved' ELSE 'Open' END, reported_by, notes FROM fact0 WHERE id % 5 <> 0 AND id % 7 = 0
  UNION ALL SELECT id + 100000000, incident_no, incident_date, student_id, offense_id % 90 + 1, action_taken, status, reported_by, notes
            FROM fact0 WHERE id % 11 = 0)"""


@register("rollup_after_write", f"""{AFTER_CTE}
SELECT student_id, offense_id, strftime(incident_date, '%Y-%m') AS month, count(*) AS n,
       count(*) FILTER (WHERE status = 'Open') AS open, max(incident_date) AS last_date
FROM fact GROUP BY ALL""")
def q_rollup_after_write(spark, sf_dir):
    from starledger.operators.rollup import ITEM, MONTH, SUBJECT
    return _kept(spark, sf_dir)[1].cells.withColumnsRenamed({SUBJECT: "student_id", ITEM: "offense_id", MONTH: "month"})


@register("rollup_summary", f"{AFTER_CTE}, {SUMMARY_CTE} SELECT * FROM sm")
def q_rollup_summary(spark, sf_dir):
    st, kept = _kept(spark, sf_dir)
    return reports.kept_summary(kept, st.subject, st.catalog, Y)


@register("rollup_dashboard", bundle_sql(AFTER_CTE))
def q_rollup_dashboard(spark, sf_dir):
    st, kept = _kept(spark, sf_dir)
    return reports.flat_bundle(reports.dashboard_bundle(reports.kept_dashboard(kept, st.subject, st.catalog, Y), Y))


@register("row_counts", f"""{M1}
SELECT 'subject' AS table_name, COUNT(*) AS row_count FROM subj
UNION ALL SELECT 'catalog', COUNT(*) FROM cat
UNION ALL SELECT 'fact', COUNT(*) FROM fact""")
def q_row_counts(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return agg.row_counts(subject=st.subject, catalog=st.catalog, fact=st.fact)


@register("next_seq", f"""{M1}
SELECT CAST(COALESCE(MAX(COALESCE(TRY_CAST(regexp_extract(substr(incident_no, 5), '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0)), 0) + 1 AS BIGINT) AS next_no
FROM fact WHERE upper(substr(incident_no, 1, 4)) = 'INC-'""")
def q_next_seq(spark, sf_dir):
    return agg.next_seq(_m1(spark, sf_dir).fact)


@register("monthly_trend_filled", f"""{M1}, m AS ({monthly_sql(2001)}),
spine AS (SELECT strftime(make_date(2001, g, 1), '%Y-%m') AS month FROM generate_series(1, 12) t(g))
SELECT spine.month, COALESCE(m.total, 0) AS total, COALESCE(m.minor, 0) AS minor,
       COALESCE(m.major, 0) AS major, COALESCE(m.points, 0) AS points
FROM spine LEFT JOIN m ON m.month = spine.month""")
def q_monthly_trend_filled(spark, sf_dir):
    st = _m1(spark, sf_dir)
    # 2001 has facts only through August: the spine fills the rest with zeros.
    return agg.monthly_trend(st.fact, st.catalog, year=2001, fill_gaps=True)
