"""Physical-plan checks: pushdown, pruning, broadcast of bounded sides, top-k."""
from conftest import SF_SMALL
from starledger.operators import aggregates as agg
from starledger.plans import fixtures as fx
from starledger.plans.listings import incident_listing


import contextlib
import io


def plan_text(df):
    """``explain("formatted")`` output, scan metadata untruncated."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_year_range_pushed_to_scan(spark):
    st = fx.orders_star(spark, SF_SMALL)
    p = plan_text(agg.subject_summary(st.subject, st.fact, st.catalog, year=1998))
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01" in p and "LessThan(o_orderdate,1999-01-01" in p


def test_column_pruning(spark):
    st = fx.orders_star(spark, SF_SMALL)
    p = plan_text(agg.monthly_trend(st.fact, st.catalog, year=1998))
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz,o_orderpriority:string>" in p


def test_constant_catalog_is_broadcast_and_aggregate_is_partial(spark):
    st = fx.orders_star(spark, SF_SMALL)
    df = agg.subject_summary(st.subject, st.fact, st.catalog, year=1998)
    df.collect()
    p = plan_text(df)
    assert "BroadcastHashJoin" in p
    assert "partial_sum" in p or "partial_count" in p


def test_topk_is_take_ordered(spark):
    st = fx.orders_star(spark, SF_SMALL)
    p = plan_text(agg.top_subjects(st.fact, st.subject, st.catalog, year=1998))
    assert "TakeOrderedAndProject" in p


def test_listing_limits_before_detail_join(spark):
    st = fx.orders_star(spark, SF_SMALL)
    df = incident_listing(st.fact, st.subject, st.catalog, category="Major", status="Open", limit=50)
    assert df.count() == 50
    p = plan_text(df)
    assert "TakeOrderedAndProject" in p or "CollectLimit" in p or "GlobalLimit" in p


def test_intake_numbering_window_is_partitioned(spark):
    from starledger.operators import intake
    from starledger.sources.sheets import stage_rows
    st = fx.orders_star(spark, SF_SMALL)
    res = intake.import_facts(stage_rows(fx.staged_fact_sheet(spark, SF_SMALL)), st.subject, st.catalog, st.fact)
    p = plan_text(res.accepted)
    # numbers come from written ranges: no window ranks rows, the one window
    # sums one count for each range
    assert "row_number()" not in p
    windows = [x for x in p.splitlines() if "windowspecdefinition(" in x]
    assert windows and all("windowspecdefinition(_range" in x for x in windows)


def test_band_counts_sum_to_subjects(spark):
    st = fx.orders_star(spark, SF_SMALL)
    s = agg.subject_summary(st.subject, st.fact, st.catalog, year=1998)
    bands = agg.risk_band_counts(s)
    assert bands.agg({"subjects": "sum"}).first()[0] == st.subject.count()
