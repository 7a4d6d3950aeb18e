"""Copy-on-write snapshots: only touched buckets are written."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from starledger.operators import versions
from starledger.operators.intake import fact_rules
from starledger.plans import fixtures as fx
from starledger.plans import reports

BORN, NOW = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    return versions.create(versions.with_stamps(fx.order_facts(spark, SF_SMALL), BORN), "id", 24)


def state(v):
    return {r["id"]: (r["status"], r["created_at"], r["updated_at"]) for r in v.rows().collect()}


def test_snapshot_equals_the_table(spark, table):
    plain = versions.with_stamps(fx.order_facts(spark, SF_SMALL), BORN)
    assert table.rows().exceptAll(plain).count() == 0 and table.rows().count() == plain.count()
    assert 1 < len(table.paths) <= 24


def test_update_rewrites_only_its_buckets(spark, table):
    before = state(table)
    ids = sorted(before)[:10]
    keys = spark.createDataFrame([(i, "Resolved") for i in ids] + [(-5, "Open")], "id bigint, status string")
    after, rejected = table.update(keys, ["status"], NOW)
    hit = set(table.touched(keys, "id"))
    assert {b for b in table.paths if table.paths[b] != after.paths[b]} == hit & set(table.paths) and len(hit) <= 11
    got = state(after)
    for i, old in before.items():
        assert got[i] == (("Resolved", BORN, NOW) if i in ids else old)
    assert [(r["id"], r["reason"]) for r in rejected.collect()] == [(-5, "not found")]
    assert state(table) == before  # the earlier snapshot still reads


def test_rules_and_empty_requests(spark, table):
    bad = spark.createDataFrame([(sorted(state(table))[0], "Bogus")], "id bigint, status string")
    after, rejected = table.update(bad, ["status"], NOW, rules=fact_rules())
    assert state(after) == state(table) and rejected.first()["reason"] == "status_domain"
    none, rejected = table.update(bad.limit(0), ["status"], NOW)
    assert none.paths == table.paths and rejected.count() == 0


def test_delete_is_all_or_nothing_and_empties_buckets(spark, table):
    ids = sorted(state(table))
    some = spark.createDataFrame([(i,) for i in ids[:5] + [-1, ids[0]]], "id bigint")
    same, missing = table.delete(some)
    assert same is table and [r["id"] for r in missing.collect()] == [-1]
    after, missing = table.delete(some, on_missing="ignore")
    assert set(state(after)) == set(ids[5:]) and missing.count() == 1
    one = min(table.paths)
    gone, _ = table.delete(table.rows_of([one]).select("id"))
    assert one not in gone.paths and gone.rows().count() == table.rows().count() - table.rows_of([one]).count()
    nothing, _ = table.delete(table.rows().select("id"))
    assert nothing.paths == {} and nothing.rows().count() == 0


def test_upsert_numbers_after_the_whole_table(spark):
    cat = versions.create(versions.with_stamps(fx.part_catalog(spark, SF_SMALL), BORN), "code", 8)
    top = cat.rows().agg(F.max("id")).first()[0]
    old = cat.rows().orderBy("code").first()
    upd = spark.createDataFrame([(old["code"], "renamed", 1), ("Z-1", "one", 2), ("Z-2", "two", 3), ("Z-1", "last", 4)], "code string, name string, ord int")
    after = cat.upsert(upd, ["name"], "ord", "id", NOW, on_update={"active": F.lit(True)})
    got = {r["code"]: r for r in after.rows().collect()}
    assert (got[old["code"]]["name"], got[old["code"]]["created_at"], got[old["code"]]["updated_at"]) == ("renamed", BORN, NOW)
    assert {(r["name"], r["id"]) for c, r in got.items() if c.startswith("Z-")} == {("two", top + 1), ("last", top + 2)}
    assert got["Z-1"]["created_at"] == NOW and got["Z-1"]["active"]


def test_one_record_reads_one_bucket(spark):
    st = fx.orders_star(spark, SF_SMALL)
    facts = versions.create(st.fact, "student_id", 16)
    who = st.subject.filter("status = 'Active'").orderBy("id").first()
    rec = reports.record_by_no(st.subject, facts, st.catalog, who["student_no"].upper())
    want = st.fact.filter(F.col("student_id") == who["id"])
    assert rec["subject"].first()["id"] == who["id"]
    assert rec["history"].count() == want.count() == rec["totals"].first()["total_incidents"]
    files = facts.lookup(who["id"]).inputFiles()
    assert files and len({f.rsplit("/", 2)[1] for f in files}) == 1
    assert reports.record_by_no(st.subject, facts, st.catalog, "nobody")["history"].count() == 0
    inactive = st.subject.filter("status = 'Inactive'").first()
    assert reports.record_by_no(st.subject, facts, st.catalog, inactive["student_no"])["subject"].count() == 0


def test_empty_table(spark):
    v = versions.create(spark.createDataFrame([], "id bigint, status string"), "id", 4)
    assert v.rows().count() == 0 and v.lookup(1).count() == 0
