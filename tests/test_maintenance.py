"""Maintenance operators (G1-G9) on micro-fixtures."""
import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from starledger.operators import maintenance as mt
from starledger.sources.catalog import LEGACY_CODE_MAP, OFFICIAL_CATALOG, catalog_frame, code_map_frame
from starledger.spec import FACT_SCHEMA, SUBJECT_SCHEMA


def test_upsert_last_wins_and_idempotent(spark):
    base = catalog_frame(spark, [("A", "a", "Minor", 1, ""), ("B", "b", "Minor", 1, "")], active=False)
    upd = spark.createDataFrame([("B", "b1", "Major", 5, "x", 1), ("B", "b2", "Major", 6, "y", 2),
                                 ("C", "c", "Minor", 2, "z", 3)],
                                "code string, name string, category string, severity_points int, recommended_action string, ord long")
    cols = ["name", "category", "severity_points", "recommended_action"]
    once = mt.upsert(base, upd, "code", cols, "ord", on_update={"active": F.lit(True)})
    assert rows(once, "id", "code", "name", "severity_points", "active") == [
        (1, "A", "a", 1, False), (2, "B", "b2", 6, True), (3, "C", "c", 2, True)]
    twice = mt.upsert(once, upd, "code", cols, "ord", on_update={"active": F.lit(True)})
    assert rows(twice) == rows(once)


def test_remap_is_simultaneous_and_skips_missing(spark):
    cat = catalog_frame(spark, sorted(OFFICIAL_CATALOG))
    ids = {r.code: r.id for r in cat.collect()}
    facts = spark.createDataFrame(
        [(i, f"INC-{i}", dt.date(2026, 1, 1), 1, ids[c], "", "Open", "", "")
         for i, c in enumerate(["MAJ-004", "MAJ-002", "MIN-003", "MAJ-001"], start=1)], FACT_SCHEMA)
    res = mt.remap_keys(facts, cat, code_map_frame(spark, LEGACY_CODE_MAP))
    moved = {r.id: r.offense_id for r in res.fact.collect()}
    # MAJ-004 -> MAJ-002 (not on to MAJ-011); MAJ-002 -> MAJ-011; MIN-003 -> MIN-011
    assert moved == {1: ids["MAJ-002"], 2: ids["MAJ-011"], 3: ids["MIN-011"], 4: ids["MAJ-001"]}
    kept = {r.code for r in res.catalog.collect()}
    assert not kept & set(LEGACY_CODE_MAP)
    # a pair whose target is missing is skipped, its source row stays
    part = cat.filter(F.col("code") != "MIN-011")
    res2 = mt.remap_keys(facts, part, code_map_frame(spark, LEGACY_CODE_MAP))
    assert {r.id: r.offense_id for r in res2.fact.collect()}[3] == ids["MIN-003"]
    assert "MIN-003" in {r.code for r in res2.catalog.collect()}


def _people(spark):
    return spark.createDataFrame([(i, f"S{i}", f"F{i}", f"L{i}", "7", "A", "", "Active") for i in range(1, 6)],
                                 SUBJECT_SCHEMA)


def _facts(spark, subjects):
    return spark.createDataFrame([(k, f"INC-{k}", dt.date(2026, 1, 1), s, 1, "", "Open", "", "")
                                  for k, s in enumerate(subjects, start=1)], FACT_SCHEMA)


def test_guarded_delete_all_or_nothing(spark):
    people, facts = _people(spark), _facts(spark, [1, 1, 2])
    keys = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    ok = mt.guarded_delete(people, facts, keys([4, 5, 5]), "id", "student_id", ["student_no"])
    assert rows(ok.snapshot, "id") == [(1,), (2,), (3,)]
    prot = mt.guarded_delete(people, facts, keys([1, 4]), "id", "student_id", ["student_no"])
    assert rows(prot.snapshot, "id") == [(i,) for i in range(1, 6)]
    assert rows(prot.protected, "id", "incident_count") == [(1, 2)]
    miss = mt.guarded_delete(people, facts, keys([4, 99]), "id", "student_id", ["student_no"])
    assert rows(miss.snapshot, "id") == [(i,) for i in range(1, 6)]
    assert rows(miss.missing, "id") == [(99,)]
    lenient = mt.guarded_delete(people, facts, keys([4, 99]), "id", "student_id", ["student_no"], on_missing="ignore")
    assert rows(lenient.snapshot, "id") == [(1,), (2,), (3,), (5,)]


def test_protected_preview_text(spark):
    people, facts = _people(spark), _facts(spark, [1, 2, 3, 4, 4])
    keys = spark.createDataFrame([(x,) for x in [1, 2, 3, 4]], "id long")
    res = mt.guarded_delete(people, facts, keys, "id", "student_id", ["student_no", "first_name", "last_name"])
    label = F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"), F.lit(" ("), F.col("student_no"), F.lit(")"))
    msg = mt.protected_preview(res.protected, label, [F.col("last_name"), F.col("first_name"), F.col("id")], "student").first()
    assert msg.message == ("4 selected students have incident records and cannot be deleted: "
                           "F1 L1 (S1), F2 L2 (S2), F3 L3 (S3), and 1 more. No students were deleted")
    one = mt.guarded_delete(people, facts, spark.createDataFrame([(2,)], "id long"), "id", "student_id",
                            ["student_no", "first_name", "last_name"])
    m1 = mt.protected_preview(one.protected, label, [F.col("last_name")], "student").first().message
    assert m1.startswith("1 selected student has incident records")


def test_delete_keys_leaf(spark):
    facts = _facts(spark, [1, 2, 3])
    keys = spark.createDataFrame([(2,), (7,)], "id long")
    assert rows(mt.delete_keys(facts, keys).snapshot, "id") == [(1,), (2,), (3,)]
    assert rows(mt.delete_keys(facts, keys, on_missing="ignore").snapshot, "id") == [(1,), (3,)]


def test_insert_new_and_update_rows(spark):
    people = _people(spark)
    batch = spark.createDataFrame([("S9", "N", "M", "7", "A", "", "Active", 1), ("S1", "X", "Y", "7", "A", "", "Active", 2),
                                   ("S9", "Dup", "M", "7", "A", "", "Active", 3)],
                                  "student_no string, first_name string, last_name string, grade string, section string, adviser string, status string, ord long")
    res = mt.insert_new(people, batch, "student_no", "ord")
    assert rows(res.rejected, "ord", "reason") == [(2, "conflict"), (3, "duplicate in batch")]
    assert rows(res.inserted, "id", "student_no", "first_name") == [(6, "S9", "N")]
    upd = spark.createDataFrame([(2, "S2", "F2", "NEW", "7", "A", "", "Inactive"),
                                 (3, "S4", "F3", "L3", "7", "A", "", "Active"),
                                 (42, "S42", "F", "L", "7", "A", "", "Active")], SUBJECT_SCHEMA)
    cols = ["student_no", "first_name", "last_name", "grade", "section", "adviser", "status"]
    u = mt.update_rows(people, upd, cols, unique_key="student_no")
    assert rows(u.rejected, "id", "reason") == [(3, "conflict"), (42, "not found")]
    assert rows(u.snapshot.filter("id = 2"), "last_name", "status") == [("NEW", "Inactive")]


def test_insert_facts_parent_checks_and_defaults(spark):
    people = _people(spark)
    cat = catalog_frame(spark, [("A", "a", "Minor", 1, "Warn")])
    existing = _facts(spark, [1])
    batch = spark.createDataFrame([(1, 1, 1, None, "", "Open", "", ""), (2, 77, 1, None, "", "Open", "", ""),
                                   (3, 2, 9, None, "", "Open", "", ""), (4, 2, 1, dt.date(2026, 2, 2), "Done", None, None, None)],
                                  "ord long, student_id long, offense_id long, incident_date date, action_taken string, status string, reported_by string, notes string")
    res = mt.insert_facts(existing, people, cat, batch, "ord", "2026-12-31")
    assert rows(res.rejected, "ord", "reason") == [(2, "Student not found"), (3, "Offense not found")]
    assert rows(res.inserted, "id", "incident_no", "incident_date", "action_taken", "status") == [
        (2, "INC-00002", dt.date(2026, 12, 31), "Warn", "Open"), (3, "INC-00003", dt.date(2026, 2, 2), "Done", "Open")]


def test_ensure_column(spark):
    people = _people(spark)
    assert "notes" in mt.ensure_column(people, "notes", "").columns
    assert mt.ensure_column(people, "status", "X").first().status == "Active"
