"""File-drop intake stream: two drops, dense numbers across batches,
idempotent per-batch output; monthly roll-up over the written facts."""
import datetime as dt
import os

from pyspark.sql import functions as F

from starledger.sources.catalog import catalog_frame
from starledger.spec import FACT_SCHEMA, SUBJECT_SCHEMA
from starledger.streaming.intake_stream import FACT_SHEET_SCHEMA, start_fact_intake, start_monthly_rollup


def test_fact_intake_stream(spark, tmp_path):
    src, out = str(tmp_path / "drop"), str(tmp_path / "out")
    subj = spark.createDataFrame([(1, "S-1", "A", "B", "7", "A", "", "Active")], SUBJECT_SCHEMA)
    cat = catalog_frame(spark, [("MIN-001", "Late", "Minor", 1, "Warn"), ("MAJ-001", "Fight", "Major", 5, "Refer")])
    base = spark.createDataFrame([(1, "INC-00005", dt.date(2026, 1, 2), 1, 1, "", "Open", "", "")], FACT_SCHEMA)
    sheet1 = spark.createDataFrame([(2, "2026-01-10", "s-1", "min-001", "", "", "", ""),
                                    (3, "soon", "S-1", "MIN-001", "", "", "", "")], FACT_SHEET_SCHEMA)
    sheet1.write.parquet(os.path.join(src, "a"))
    q = start_fact_intake(spark, src + "/*", subj, cat, base, out,
                          checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    sheet2 = spark.createDataFrame([(2, "2026-02-01", "S-1", "MAJ-001", "Talked", "resolved", "", "")], FACT_SHEET_SCHEMA)
    sheet2.write.parquet(os.path.join(src, "b"))
    q = start_fact_intake(spark, src + "/*", subj, cat, base, out,
                          checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    facts = spark.read.parquet(os.path.join(out, "facts"))
    got = sorted((r.incident_no, r.action_taken, r.status) for r in facts.collect())
    assert got == [("INC-00006", "Warn", "Open"), ("INC-00007", "Talked", "Resolved")]
    outcomes = spark.read.parquet(os.path.join(out, "outcomes"))
    assert outcomes.filter(F.col("outcome") == "error").count() == 1

    roll = str(tmp_path / "monthly")
    q2 = start_monthly_rollup(spark, os.path.join(out, "facts"), cat, roll, year=2026,
                              checkpoint_location=str(tmp_path / "ckpt2"))
    q2.awaitTermination(120)
    m = sorted((r.month, r.total, r.points) for r in spark.read.parquet(roll).collect())
    assert m == [("2026-01", 1, 1), ("2026-02", 1, 5)]


def test_files_of_one_batch_keep_their_own_row_numbers(spark, tmp_path):
    src, out = str(tmp_path / "drop"), str(tmp_path / "out")
    subj = spark.createDataFrame([(1, "S-1", "A", "B", "7", "A", "", "Active")], SUBJECT_SCHEMA)
    cat = catalog_frame(spark, [("MIN-001", "Late", "Minor", 1, "Warn")])
    for name, rows in (("a", [(2, "2026-01-10"), (3, "soon")]), ("b", [(2, "later"), (3, "2026-01-12")])):
        sheet = [(n, d, "S-1", "MIN-001", name, "", "", "") for n, d in rows]
        spark.createDataFrame(sheet, FACT_SHEET_SCHEMA).coalesce(1).write.parquet(os.path.join(src, name))
    start_fact_intake(spark, src + "/*", subj, cat, spark.createDataFrame([], FACT_SCHEMA), out,
                      checkpoint_location=str(tmp_path / "ckpt")).awaitTermination(120)
    folder = lambda path: os.path.basename(os.path.dirname(path))
    outcomes = spark.read.parquet(os.path.join(out, "outcomes")).collect()
    assert sorted((folder(r.source_file), r.row_number, r.outcome) for r in outcomes) == [
        ("a", 2, "imported"), ("a", 3, "error"), ("b", 2, "error"), ("b", 3, "imported")]
    facts = spark.read.parquet(os.path.join(out, "facts")).collect()
    assert sorted((r.incident_no, folder(r.source_file), r.row_number) for r in facts) == [
        ("INC-00001", "a", 2), ("INC-00002", "b", 3)]
