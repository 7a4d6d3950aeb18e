"""Sources and sinks: snapshots, appends, report document, sample star, sheets."""
import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from starledger.plans import fixtures as fx
from starledger.plans import reports
from starledger.sources import sinks, synth
from starledger.sources.sheets import read_sheet
from starledger.sources.tables import read_table


def test_snapshot_append_and_report(spark, tmp_path):
    subj = fx.customer_subjects(spark, SF_SMALL)
    p = str(tmp_path / "subjects_v1")
    sinks.write_snapshot(subj, p)
    back = spark.read.parquet(p)
    assert rows(back) == rows(subj)
    sinks.append_to(subj.limit(3), p)
    assert spark.read.parquet(p).count() == subj.count() + 3
    st = fx.orders_star(spark, SF_SMALL)
    doc = reports.dashboard_bundle(reports.dashboard(st.subject, st.fact, st.catalog, year=1998), 1998)
    rp = str(tmp_path / "report")
    sinks.write_report(doc, rp)
    files = [f for f in os.listdir(rp) if f.endswith(".json")]
    obj = json.loads(open(os.path.join(rp, files[0])).read().splitlines()[0])
    assert obj["year"] == 1998 and set(obj["totals"]) >= {"total_incidents", "active_students"}


def test_synth_star_layout(spark):
    c = read_table(spark, SF_SMALL, "customer")
    o = read_table(spark, SF_SMALL, "orders")
    st = synth.synth_star(spark, c, "c_custkey", o, "o_orderkey", 2026)
    first = st.subject.orderBy("id").limit(21).collect()
    assert [(r.student_no, r.grade, r.section) for r in first[:6]] == [
        ("RTS-00001", "7", "A"), ("RTS-00002", "7", "A"), ("RTS-00003", "7", "A"),
        ("RTS-00004", "7", "A"), ("RTS-00005", "7", "A"), ("RTS-00006", "7", "B")]
    assert first[20].grade == "8" and first[0].adviser == "Ms. Reyes"
    f = st.fact
    assert f.filter(~F.col("incident_date").between("2026-01-08", "2026-07-22")).count() == 0
    assert f.join(st.subject, f.student_id == st.subject.id, "left_anti").count() == 0
    assert st.catalog.count() == 43


def test_read_sheet_parquet(spark, tmp_path):
    p = str(tmp_path / "sheet")
    spark.createDataFrame([(2, "S-1", "A"), (3, " ", ""), (4, "S-2", "B")],
                          "row_number long, `Student Number` string, `Class Section` string").write.parquet(p)
    df = read_sheet(spark, p, fmt="parquet")
    assert df.columns == ["row_number", "student_no", "section"]
    assert rows(df) == [(2, "S-1", "A"), (4, "S-2", "B")]
