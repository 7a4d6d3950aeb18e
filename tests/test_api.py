"""Ledger facade over the Map 1 star: the request surface end to end."""
import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from starledger.api import Ledger
from starledger.plans import fixtures as fx
from starledger.sources.catalog import catalog_frame, OFFICIAL_CATALOG


def ledger(spark):
    st = fx.orders_star(spark, SF_SMALL)
    return Ledger(st.subject, st.catalog, st.fact)


def test_listings_and_reports(spark):
    lg = ledger(spark)
    subs = lg.list_subjects(search="cruz", limit=5).collect()
    assert 0 < len(subs) <= 5 and all("cruz" in (r.first_name + r.last_name + r.student_no).lower() for r in subs)
    assert lg.list_facts(category="Major", limit=7).count() == 7
    assert lg.list_catalog(active_only=True).count() == 5
    assert lg.next_fact_no().first().next_no == 1500
    summ = lg.subject_summary(1998).collect()
    assert [r.severity_points for r in summ] == sorted((r.severity_points for r in summ), reverse=True)
    doc = lg.dashboard_document(1998).first()
    assert doc.totals.total_incidents == sum(m.total for m in doc.monthly)


def test_subject_record(spark):
    lg = ledger(spark)
    rec = lg.subject_record("CUSTOMER#000000001")
    tot = rec["totals"].first()
    hist = rec["history"].collect()
    assert tot.total_incidents == len(hist) > 0
    dates = [(h.incident_date, h.id) for h in hist]
    assert dates == sorted(dates, reverse=True)
    assert lg.subject_record("nobody")["subject"].count() == 0
    assert lg.subject_record(key=1)["totals"].first().total_incidents == tot.total_incidents


def test_update_facts_checks_and_defaults(spark):
    lg = ledger(spark)
    f = lg.fact.filter(F.col("id").isin(1, 2, 3)).select("id", "incident_date", "student_id", "offense_id",
                                                          "action_taken", "status", "reported_by", "notes")
    upd = f.withColumn("action_taken", F.lit("")) \
        .withColumn("incident_date", F.when(F.col("id") == 1, F.lit(None).cast("date")).otherwise(F.col("incident_date"))) \
        .withColumn("offense_id", F.when(F.col("id") == 3, F.lit(99)).otherwise(F.col("offense_id"))) \
        .unionByName(f.filter("id = 1").withColumn("id", F.lit(99999).cast("long")))
    res = lg.update_facts(upd, "2001-12-31")
    assert sorted((r.id, r.reason) for r in res.rejected.collect()) == [(3, "Offense not found"), (99999, "not found")]
    row1 = res.snapshot.filter("id = 1").first()
    assert row1.incident_date == dt.date(2001, 12, 31) and row1.action_taken != ""


def test_sync_catalog_and_guarded_delete(spark):
    lg = ledger(spark)
    old = catalog_frame(spark, [("MAJ-004", "Old", "Major", 5, ""), ("MAJ-002", "Old2", "Major", 5, "")])
    f = spark.createDataFrame([(1, "INC-1", dt.date(2026, 1, 1), 1, 1, "", "Open", "", "")], lg.fact.schema)
    lg2 = Ledger(lg.subject, old, f).sync_catalog()
    cat = {r.code: r for r in lg2.catalog.collect()}
    # every official code exists once, no LEGACY- rows remain, ids of kept rows survive
    assert set(cat) == {c for c, *_ in OFFICIAL_CATALOG}
    moved = lg2.fact.first().offense_id
    assert cat["MAJ-002"].id == moved  # the fact on old MAJ-004 moved to MAJ-002 (not on to MAJ-011)
    assert cat["MAJ-002"].id not in (1, 2) and cat["MAJ-004"].id not in (1, 2)
    keys = spark.createDataFrame([(1,)], "id long")
    res = lg.delete_subjects(keys)
    assert res.snapshot.count() == lg.subject.count()  # subject 1 has facts -> rejected


def test_sync_is_idempotent_after_the_one_time_remap(spark):
    from conftest import rows
    lg = ledger(spark)
    old = catalog_frame(spark, [("MAJ-004", "Old", "Major", 5, "")])
    f = spark.createDataFrame([(1, "INC-1", dt.date(2026, 1, 1), 1, 1, "", "Open", "", "")], lg.fact.schema)
    once = Ledger(lg.subject, old, f).sync_catalog()
    again = once.sync_catalog(remap_legacy=False)
    assert rows(again.catalog) == rows(once.catalog)
    assert rows(again.fact) == rows(once.fact)


def test_import_subjects_from_csv(spark, tmp_path):
    import pytest
    lg = ledger(spark)
    p = tmp_path / "people.csv"
    p.write_text("LRN,First Name,Last Name,Grade Level,Class Section,Status\n"
                 "NEW-1,Ana,Cruz,7,A,\n"
                 "customer#000000001,Ben,Lim,8,B,Active\n"
                 "NEW-2,,Tan,9,C,Bogus\n")
    res = lg.import_subjects(str(p))
    s = res.summary().first()
    assert (s.imported, s.skipped, s.error_count, s.total_rows) == (1, 1, 1, 3)
    assert res.accepted.first().id == 150  # continues after the stored maximum (ids 0..149)
    bad = tmp_path / "bad.csv"
    bad.write_text("LRN,First Name\nX,Y\n")
    with pytest.raises(ValueError, match="Missing required Excel columns: Grade, Last Name, Section"):
        lg.import_subjects(str(bad))


def test_writes_keep_domain_rules(spark):
    lg = ledger(spark)
    row = lg.subject.limit(1).drop("id")
    batch = (row.withColumn("student_no", F.lit("N-1")).withColumn("ord", F.lit(1))
             .unionByName(row.withColumn("student_no", F.lit("")).withColumn("ord", F.lit(2)))
             .unionByName(row.withColumn("student_no", F.lit("N-3")).withColumn("status", F.lit("Bogus")).withColumn("ord", F.lit(3)))
             .unionByName(row.withColumn("student_no", F.lit("N-3")).withColumn("ord", F.lit(4))))
    res = lg.create_subjects(batch, "ord")
    assert sorted((r.ord, r.reason) for r in res.rejected.collect()) == [(2, "student_no_required"), (3, "status_domain")]
    assert sorted(r.student_no for r in res.inserted.collect()) == ["N-1", "N-3"]
    bad = lg.subject.filter("id = 1").withColumn("status", F.lit("Bogus"))
    assert [r.reason for r in lg.update_subjects(bad).rejected.collect()] == ["status_domain"]
    item = lg.catalog.filter("id = 1")
    bad = item.withColumn("severity_points", F.lit(11))
    assert [r.reason for r in lg.update_catalog_items(bad).rejected.collect()] == ["points_range"]
    facts = lg.fact.filter("id IN (1, 2)").withColumn("ord", F.col("id"))
    facts = facts.withColumn("status", F.when(F.col("id") == 1, "NOT-A-STATUS"))
    res = lg.create_facts(facts, "ord", "2001-12-31")
    assert [(r.ord, r.reason) for r in res.rejected.collect()] == [(1, "status_domain")]
    assert [r.status for r in res.inserted.collect()] == ["Open"]
