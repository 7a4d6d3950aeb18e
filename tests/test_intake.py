"""Intake (A2-A4, H3-H6, W1, W2) on hand-built sheets; expectations follow
the row-at-a-time rules: first failing rule wins, invalid rows reserve no
key, stored keys skip, numbers are dense in file order."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from starledger.operators import intake
from starledger.operators.windows import dense_sequence, first_per_key, number_rows
from starledger.sources.catalog import catalog_frame
from starledger.sources.sheets import normalize_headers, require_columns, stage_rows
from starledger.spec import SUBJECT_SCHEMA, FACT_SCHEMA

SUBJ_COLS = "row_number long, student_no string, first_name string, last_name string, grade string, " \
            "section string, adviser string, status string"


def stored_subjects(spark):
    return spark.createDataFrame([
        (1, "S-001", "Ana", "Cruz", "7", "A", "", "Active"),
        (2, "S-002", "Ben", "Reyes", "8", "B", "", "Active"),
    ], SUBJECT_SCHEMA)


def subject_sheet(spark):
    return spark.createDataFrame([
        (2, "S-100", "Cara", "Lim", "7", "A", "", ""),            # default status -> imported
        (3, "", "", "", "", "", "", ""),                           # blank row: dropped, numbering kept
        (4, "S-101", "", "Tan", "", "B", "", "Active"),            # two labels missing
        (5, "S-102", "Dan", "Uy", "9", "C", "", "   "),            # spaces-only status -> error
        (6, "S-103", "Eve", "Yu", "9", "C", "", "ACTIVE"),         # canonicalised
        (7, "s-100", "Cara", "Lim", "7", "A", "", "Active"),       # same number other case -> skipped
        (8, "S-104", "", "Go", "8", "D", "", "Active"),            # invalid: reserves no key
        (9, "S-104", "Fay", "Go", "8", "D", "", "inactive"),       # valid after invalid -> imported
        (10, "s-002", "Ben", "Reyes", "8", "B", "", "Active"),     # stored (case-insensitive) -> skipped
        (11, "S-105", "Gil", "Sy", "10", "A", "", "Bogus"),        # bad status
    ], SUBJ_COLS)


def test_stage_rows_drops_blank_keeps_numbers(spark):
    staged = stage_rows(subject_sheet(spark))
    nums = sorted(r.row_number for r in staged.collect())
    assert nums == [2, 4, 5, 6, 7, 8, 9, 10, 11]


def test_subject_import_outcomes(spark):
    res = intake.import_subjects(stage_rows(subject_sheet(spark)), stored_subjects(spark))
    out = {r.row_number: (r.outcome, r.message) for r in res.outcomes.collect()}
    assert out[2] == ("imported", None)
    assert out[4] == ("error", "Missing First Name, Grade")
    assert out[5] == ("error", "Status must be Active or Inactive")
    assert out[6] == ("imported", None)
    assert out[7] == ("skipped", None)
    assert out[8] == ("error", "Missing First Name")
    assert out[9] == ("imported", None)
    assert out[10] == ("skipped", None)
    assert out[11] == ("error", "Status must be Active or Inactive")
    s = res.summary().first()
    assert (s.imported, s.skipped, s.error_count, s.total_rows) == (3, 2, 4, 9)
    assert s.imported + s.skipped + s.error_count == s.total_rows
    acc = sorted((r.id, r.student_no, r.status) for r in res.accepted.collect())
    assert acc == [(3, "S-100", "Active"), (4, "S-103", "Active"), (5, "S-104", "Inactive")]


def test_error_list_first_ten_in_file_order(spark):
    rows = [(n + 2, f"X-{n}", "", "L", "7", "A", "", "") for n in range(12)]
    res = intake.import_subjects(stage_rows(spark.createDataFrame(rows, SUBJ_COLS)), stored_subjects(spark))
    assert res.summary().first().error_count == 12
    errs = res.errors().collect()
    assert [e.row for e in errs] == list(range(2, 12))


FACT_COLS = "row_number long, incident_date string, student_no string, offense_code string, " \
            "action_taken string, status string, reported_by string, notes string"


def fact_world(spark):
    cat = catalog_frame(spark, [("MAJ-001", "Bullying", "Major", 5, "Refer"), ("MIN-001", "Late", "Minor", 1, "Warn")])
    existing = spark.createDataFrame([
        (1, "INC-00041", dt.date(2026, 1, 3), 1, 1, "", "Open", "", ""),
        (2, "misc-9", dt.date(2026, 1, 4), 1, 2, "", "Open", "", ""),
    ], FACT_SCHEMA)
    return stored_subjects(spark), cat, existing


def fact_sheet(spark):
    return spark.createDataFrame([
        (2, "03/04/2026", "s-001", "maj-001", "", "", "", ""),          # Mar 4, default action + status
        (3, "13/02/2026", "S-002", "MIN-001", "Called parent", "resolved", "T", "n"),
        (4, "soon", "S-404", "MIN-001", "", "", "", ""),                # unknown subject wins over bad date
        (5, "2026-02-13", "", "MIN-001", "", "", "", ""),               # number blank
        (6, "2026-02-13", "S-001", "", "", "", "", ""),                 # code blank
        (7, "2026-02-13", "S-001", "ZZ-9", "", "", "", ""),             # unknown code
        (8, "2026-02-13", "S-001", "MIN-001", "", "Pending", "", ""),   # bad status
        (9, "", "S-001", "MIN-001", "", "", "", ""),                    # date required
        (10, "46037", "S-001", "MIN-001", "", "open", "", ""),          # serial -> 2026-01-15
        (11, "garbage", "S-001", "MIN-001", "", "", "", ""),            # bad date
    ], FACT_COLS)


def test_fact_import_rules_and_numbers(spark):
    subj, cat, existing = fact_world(spark)
    res = intake.import_facts(stage_rows(fact_sheet(spark)), subj, cat, existing)
    out = {r.row_number: (r.outcome, r.message) for r in res.outcomes.collect()}
    assert out[4] == ("error", "Student S-404 was not found")
    assert out[5] == ("error", "Student No. is required")
    assert out[6] == ("error", "Offense Code is required")
    assert out[7] == ("error", "Offense code ZZ-9 was not found")
    assert out[8] == ("error", "Status must be Open, Parent Notified, Under Review, or Resolved")
    assert out[9] == ("error", "Incident Date is required")
    assert out[11] == ("error", "Incident Date must use YYYY-MM-DD or a recognized Excel date")
    acc = sorted((r.row_number, r.id, r.incident_no, r.incident_date, r.student_id, r.offense_id,
                  r.action_taken, r.status) for r in res.accepted.collect())
    assert acc == [
        (2, 3, "INC-00042", dt.date(2026, 3, 4), 1, 1, "Refer", "Open"),
        (3, 4, "INC-00043", dt.date(2026, 2, 13), 2, 2, "Called parent", "Resolved"),
        (10, 5, "INC-00044", dt.date(2026, 1, 15), 1, 2, "Warn", "Open"),
    ]
    s = res.summary().first()
    assert (s.imported, s.skipped, s.error_count, s.total_rows) == (3, 0, 7, 10)


def test_headers_normalised_and_required(spark):
    raw = spark.createDataFrame([("1", "A", "x")], ["LRN", "Grade Level", "  "])
    df = normalize_headers(raw)
    assert df.columns == ["student_no", "grade"]
    with pytest.raises(ValueError, match="Missing required Excel columns: First Name, Last Name, Section"):
        require_columns(df, ["student_no", "first_name", "last_name", "grade", "section"])
    dup = normalize_headers(spark.createDataFrame([("a", "b")], ["Code", "Offense"]))
    assert dup.columns == ["offense_code"] and dup.first()[0] == "b"  # later header wins


def test_dense_sequence_is_gapless_in_order(spark):
    df = spark.range(0, 300000, 3).withColumnRenamed("id", "r")
    seq = dense_sequence(df, "r", "n", start=10, ranges=6)
    got = [(r.r, r.n) for r in seq.orderBy("r").collect()]
    assert [n for _, n in got] == list(range(10, 10 + len(got)))


def test_dense_sequence_of_hashed_keys(spark):
    # 64-bit hashes, the sparsest keys there are: one offset row for each range
    from starledger.operators.ranged import PART, write_ranged
    df = spark.range(0, 20000).select(F.xxhash64("id").alias("r"))
    t = write_ranged(df, [F.col("r")], "test", ranges=6)
    assert t.ranges.count() <= 6 and t.ranges.agg(F.sum("rows")).first()[0] == 20000
    got = [(r.r, r.n) for r in t.numbered("n", 1).orderBy("r").collect()]
    assert [n for _, n in got] == list(range(1, 20001))
    assert t.all_rows().select(PART).distinct().count() == t.ranges.count()
    assert dense_sequence(df.limit(0), "r", "n").count() == 0


def test_number_rows_follows_scan_order(spark, tmp_path):
    p = str(tmp_path / "sheet")
    spark.range(0, 5000, 1, 7).select((F.col("id") * 2).alias("v")).write.parquet(p)
    df = number_rows(spark.read.parquet(p), "idx", start=2)
    got = [(r.v, r.idx) for r in df.collect()]
    assert sorted(i for _, i in got) == list(range(2, 5002))
    assert len({v for v, _ in got}) == 5000


def test_first_per_key_with_hot_key(spark):
    # one key holds a third of all rows
    df = spark.range(0, 30000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                                      (F.col("id") + 2).alias("row_number"))
    firsts = first_per_key(df, F.lower("k"), "row_number")
    assert firsts.filter(F.col("k") == "hot").first().row_number == 2
    assert firsts.count() == 20001


def test_read_sheet_csv_counts_blank_lines(spark, tmp_path):
    from starledger.sources.sheets import read_sheet
    p = tmp_path / "students.csv"
    p.write_text("LRN,First Name,Last Name,Grade Level,Section,Status,Code\n"
                 "S-1,Ana,Cruz,7,A,,x\n"
                 "\n"
                 ",,,,,,\n"
                 "S-2,\"Lim, Jr\",Tan,8,B,ACTIVE\n"
                 "S-3,Bo,Go,9,C,Active,y,extra\n")
    df = read_sheet(spark, str(p))
    got = sorted((r.row_number, r.student_no, r.first_name, r.status) for r in df.collect())
    assert got == [(2, "S-1", "Ana", None), (5, "S-2", "Lim, Jr", "ACTIVE"), (6, "S-3", "Bo", "Active")]
    assert df.columns == ["row_number", "student_no", "first_name", "last_name", "grade", "section", "status",
                          "offense_code"]
