"""The dashboard in one pass; the kept roll-up through random writes."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL, rows
from starledger.operators import aggregates as agg
from starledger.operators.rollup import KeptRollup, build_rollup, report_rollup
from starledger.plans import fixtures as fx
from starledger.plans import reports
from test_plans import plan_text

SCHEMA = "id bigint, incident_date date, student_id bigint, offense_id bigint, status string"


def cells(df):
    return sorted((tuple(r) for r in df.select("_sid", "_cid", "_month", "n", "open", "last_date").collect()), key=repr)


def test_dashboard_parts_equal_the_single_reports(spark):
    for star in (fx.orders_star, fx.lineitem_star):
        st = star(spark, SF_MID)
        got = reports.dashboard(st.subject, st.fact, st.catalog, year=1998)
        assert rows(got["totals"]) == rows(reports.dashboard_totals(st.subject, st.fact, st.catalog, year=1998))
        assert rows(got["monthly"]) == rows(agg.monthly_trend(st.fact, st.catalog, year=1998))
        assert got["top_subjects"].collect() == agg.top_subjects(st.fact, st.subject, st.catalog, year=1998).collect()
        assert got["top_catalog"].collect() == agg.top_catalog(st.fact, st.catalog, year=1998).collect()


def test_dashboard_reads_the_facts_once(spark):
    st = fx.lineitem_star(spark, SF_SMALL)
    p = plan_text(report_rollup(agg.year_facts(st.fact, year=1998), st.catalog))
    assert p.split("== Initial Plan")[0].count("lineitem.parquet") == 1 and "Expand" in p
    assert "GreaterThanOrEqual(l_shipdate" in p
    parts = reports.dashboard(st.subject, st.fact, st.catalog, year=1998)
    bundle = reports.dashboard_bundle(parts, 1998)
    assert "lineitem.parquet" not in plan_text(bundle)
    assert bundle.count() == 1


def test_facts_without_a_catalog_row(spark):
    """Counted by the summary, not by the dashboard, as the single reports do."""
    st = fx.lineitem_star(spark, SF_SMALL)
    fact = st.fact.withColumn("offense_id", F.when(F.col("id") % 3 == 0, F.lit(10_000_000)).otherwise(F.col("offense_id")))
    got = reports.dashboard(st.subject, fact, st.catalog, year=1998)
    assert rows(got["totals"]) == rows(reports.dashboard_totals(st.subject, fact, st.catalog, year=1998))
    assert rows(got["monthly"]) == rows(agg.monthly_trend(fact, st.catalog, year=1998))
    assert got["top_subjects"].collect() == agg.top_subjects(fact, st.subject, st.catalog, year=1998).collect()
    kept = reports.kept_summary(build_rollup(fact), st.subject, st.catalog, 1998)
    assert rows(kept) == rows(agg.subject_summary(st.subject, fact, st.catalog, year=1998))


def test_empty_year(spark):
    st = fx.orders_star(spark, SF_SMALL)
    got = reports.dashboard(st.subject, st.fact, st.catalog, year=2050)
    assert got["totals"].first()["total_incidents"] == 0 and got["monthly"].count() == 0
    flat = reports.flat_bundle(reports.dashboard_bundle(got, 2050)).collect()
    assert {r["part"] for r in flat} == {"totals"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_writes_keep_the_rollup(spark, seed):
    rng = random.Random(seed)

    def row(i):
        day = rng.choice([None, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(70))])
        return (i, day, rng.choice([None, 1, 2]), rng.choice([1, 2]), rng.choice(["Open", "Resolved", None]))
    facts = {i: row(i) for i in range(40)}
    kept = build_rollup(spark.createDataFrame(list(facts.values()), SCHEMA))
    for step in range(2):
        gone = rng.sample(sorted(facts), 8)
        moved = [i for i in rng.sample(sorted(facts), 10) if i not in gone]
        removed = [facts[i] for i in gone + moved]
        new = {i: row(i) for i in range(1000 * (step + 1), 1000 * (step + 1) + 6)} | {i: row(i) for i in moved}
        for i in gone:
            del facts[i]
        facts |= new
        after = spark.createDataFrame(list(facts.values()), SCHEMA)
        kept = kept.changed(spark.createDataFrame(removed, SCHEMA), spark.createDataFrame(list(new.values()), SCHEMA), after)
        kept = KeptRollup(spark.createDataFrame(kept.cells.collect(), kept.cells.schema))
        assert cells(kept.cells) == cells(build_rollup(after).cells)


def test_inserts_alone_and_nothing(spark):
    st = fx.lineitem_star(spark, SF_SMALL)
    old, new = st.fact.filter("id % 4 != 0"), st.fact.filter("id % 4 = 0")
    kept = build_rollup(old).changed(None, new, st.fact)
    assert cells(kept.cells) == cells(build_rollup(st.fact).cells)
    assert kept.changed(None, None, st.fact) is kept
    assert cells(kept.changed(st.fact, None, st.fact.limit(0)).cells) == []
