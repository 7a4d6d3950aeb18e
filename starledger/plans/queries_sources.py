"""Registered source/sink queries: sample star, catalog dimension, append."""

from __future__ import annotations

from pyspark.sql import functions as F

from starledger.operators import aggregates as agg
from starledger.plans import fixtures as fx
from starledger.plans.queries_intake import SUBJECT_FLOW, _subject_import
from starledger.plans.queries_reports import summary_cte
from starledger.plans.registry import register
from starledger.sources import synth
from starledger.sources.catalog import OFFICIAL_CATALOG
from starledger.sources.sinks import append_rows
from starledger.sources.tables import read_table

Y = fx.REPORT_YEAR
q = fx._sql_str
OFFICIAL_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"(CAST({i + 1} AS BIGINT), {q(c)}, {q(n)}, {q(cat)}, CAST({p} AS INTEGER), {q(a)}, TRUE)"
    for i, (c, n, cat, p, a) in enumerate(sorted(OFFICIAL_CATALOG))
) + ") AS t(id, code, name, category, severity_points, recommended_action, active)"
ADV = "CASE " + " ".join(f"WHEN g = {q(k)} THEN {q(v)}" for k, v in synth.ADVISERS.items()) + " END"
SYNTH_SUBJ_SQL = f"""SELECT id, student_no, first_name, last_name, g AS grade, section, {ADV} AS adviser, 'Active' AS status FROM (
  SELECT CAST(c_custkey + 1 AS BIGINT) AS id, printf('RTS-%05d', c_custkey + 1) AS student_no,
         {fx._sql_list(fx.FIRST_NAMES)}[(c_custkey % 50) + 1] AS first_name,
         {fx._sql_list(fx.LAST_NAMES)}[(((c_custkey + 1) * 3 - 1) % 50) + 1] AS last_name,
         {fx._sql_list(synth.GRADES)}[((c_custkey // 20) % 6) + 1] AS g,
         {fx._sql_list(synth.SECTIONS)}[((c_custkey // 5) % 4) + 1] AS section FROM customer) x"""
SYNTH_FACT_SQL = f"""SELECT CAST(o_orderkey + 1 AS BIGINT) AS id, printf('INC-%05d', o_orderkey + 1) AS incident_no,
       make_date({Y}, 1, 8) + CAST((o_orderkey * 37) % 196 AS INTEGER) AS incident_date,
       CAST(((o_orderkey * 11 + (o_orderkey * 7) % 13) % (SELECT COUNT(*) FROM customer)) + 1 AS BIGINT) AS student_id,
       CAST(o_orderkey % 43 + 1 AS BIGINT) AS offense_id, oc.recommended_action AS action_taken,
       {fx._sql_list(synth.FACT_STATUSES)}[((o_orderkey * 3) % 4) + 1] AS status,
       {fx._sql_list(fx.REPORTERS)}[(o_orderkey % 4) + 1] AS reported_by, {q(synth.SEED_NOTE)} AS notes
FROM orders LEFT JOIN oc ON oc.id = o_orderkey % 43 + 1"""
SYNTH_CTE = f"WITH oc AS ({OFFICIAL_SQL}), subj AS ({SYNTH_SUBJ_SQL}), cat AS (SELECT * FROM oc), fact AS ({SYNTH_FACT_SQL})"


def _synth(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    o = read_table(spark, sf_dir, "orders")
    return synth.synth_star(spark, c, "c_custkey", o, "o_orderkey", Y)


@register("synth_subjects", f"{SYNTH_CTE} SELECT * FROM subj")
def q_synth_subjects(spark, sf_dir):
    return _synth(spark, sf_dir).subject


@register("synth_facts", f"{SYNTH_CTE} SELECT * FROM fact")
def q_synth_facts(spark, sf_dir):
    return _synth(spark, sf_dir).fact


@register("synth_summary", f"{SYNTH_CTE}, {summary_cte(Y)} SELECT * FROM sm")
def q_synth_summary(spark, sf_dir):
    st = _synth(spark, sf_dir)
    return agg.subject_summary(st.subject, st.fact, st.catalog, year=Y)


@register("catalog_frame", f"""{SYNTH_CTE}
SELECT c.id, c.code, c.name, c.category, c.severity_points, COUNT(f.id) AS incident_count
FROM cat c LEFT JOIN fact f ON f.offense_id = c.id GROUP BY c.id, c.code, c.name, c.category, c.severity_points""")
def q_catalog_frame(spark, sf_dir):
    st = _synth(spark, sf_dir)
    per = st.fact.groupBy(F.col("offense_id").alias("_cid")).agg(F.count(F.lit(1)).alias("n"))
    j = st.catalog.join(per, st.catalog["id"] == per["_cid"], "left")
    return j.select("id", "code", "name", "category", "severity_points",
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("incident_count"))


@register("append_rows", f"""{SUBJECT_FLOW}
SELECT id, student_no, first_name, last_name, grade, section, adviser, status FROM stored
UNION ALL
SELECT CAST((SELECT COALESCE(MAX(id), 0) FROM stored) + ROW_NUMBER() OVER (ORDER BY row_number) AS BIGINT),
       student_no, first_name, last_name, grade, section, adviser, status
FROM o WHERE outcome = 'imported'""")
def q_append_rows(spark, sf_dir):
    res = _subject_import(spark, sf_dir)
    return append_rows(fx.customer_subjects(spark, sf_dir), res.accepted)
