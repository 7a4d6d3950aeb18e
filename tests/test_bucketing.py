"""Bucketed star tables: the subject summary runs without any shuffle."""
import contextlib
import io

from conftest import SF_SMALL, rows
from starledger.operators import aggregates as agg
from starledger.plans import fixtures as fx
from starledger.sources.sinks import save_bucketed


def test_bucketed_summary_has_no_shuffle(spark, tmp_path):
    st = fx.orders_star(spark, SF_SMALL)
    save_bucketed(st.subject, "b_subject", "id", 8, path=str(tmp_path / "subject"))
    save_bucketed(st.fact, "b_fact", "student_id", 8, path=str(tmp_path / "fact"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the big-table join shape
    try:
        subj, fact = spark.table("b_subject"), spark.table("b_fact")
        out = agg.subject_summary(subj, fact, st.catalog, year=1998)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            out.explain()
        plan = buf.getvalue()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan, plan
        assert rows(out) == rows(agg.subject_summary(st.subject, st.fact, st.catalog, year=1998))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS b_subject")
        spark.sql("DROP TABLE IF EXISTS b_fact")


def test_year_partitioned_facts_prune_directories(spark, tmp_path):
    from starledger.operators.aggregates import with_year_partition
    from starledger.sources.sinks import write_snapshot
    st = fx.orders_star(spark, SF_SMALL)
    p = str(tmp_path / "facts")
    write_snapshot(with_year_partition(st.fact), p, partition_by=["incident_year"])
    facts = spark.read.parquet(p)
    out = agg.subject_summary(st.subject, facts, st.catalog, year=1998)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    assert "PartitionFilters: [isnotnull(incident_year" in buf.getvalue() and "= 1998)" in buf.getvalue()
    assert rows(out) == rows(agg.subject_summary(st.subject, st.fact, st.catalog, year=1998))
