"""Sheets from real text: quoted line ends, blank lines, several files, small splits."""
import csv
import io
import random

import duckdb
import pytest

from starledger.sources.sheets import read_sheet, sheet_records


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def sheet(rng, n, header=("Student No.", "First Name", "Notes")):
    rows = [list(header)]
    for i in range(n):
        notes = rng.choice(["plain", "two\nlines", 'a "quoted" word', "x,y", "\n\n", "", 'end"', "last\n", "many\n" * 30, "é\U0001F600\nü"])
        rows.append([f"S-{i:04d}", rng.choice(["Ann", "Ben, Jr", "C\nD"]), notes] if rng.random() > 0.1 else [])
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    for r in rows:
        w.writerow(r)
    return rows, out.getvalue()


@pytest.mark.parametrize("seed", [1, 2])
def test_quoted_line_ends_in_any_split(spark, tmp_path, small_splits, seed):
    rows, text = sheet(random.Random(seed), 200)
    path = tmp_path / "s.csv"
    path.write_bytes(text.encode())
    records = sheet_records(spark, str(path))
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
    assert {r["record"]: bool(r["text"]) for r in records.collect()} == {i + 1: bool(r) for i, r in enumerate(rows)}
    got = {r["row_number"]: (r["student_no"], r["first_name"], r["notes"] or "") for r in read_sheet(spark, str(path)).collect()}
    assert got == {i + 1: tuple(r) for i, r in enumerate(rows) if r and i}
    ref = duckdb.execute("SELECT * FROM read_csv(?, header = true, all_varchar = true, null_padding = false)", [str(path)]).fetchall()
    assert sorted(got.values()) == sorted((a, b, c or "") for a, b, c in ref if a)


def test_several_files_each_with_its_header(spark, tmp_path, small_splits):
    d = tmp_path / "sheets"
    d.mkdir()
    one, text1 = sheet(random.Random(5), 40)
    two, text2 = sheet(random.Random(6), 30, ("First Name", "LRN", "Remarks"))
    (d / "a.csv").write_bytes(text1.encode())
    (d / "b.csv").write_bytes(text2.encode())
    got = {r["row_number"]: r for r in read_sheet(spark, str(d)).collect()}
    want = [i + 1 for i, r in enumerate(one) if r and i] + [len(one) + i + 1 for i, r in enumerate(two) if r and i]
    assert sorted(got) == want
    assert got[want[0]]["student_no"].startswith("S-") and got[want[0]]["remarks"] is None
    last = got[want[-1]]
    assert last["first_name"].startswith("S-") and last["student_no"] in ("Ann", "Ben, Jr", "C\nD") and last["remarks"] is not None


def test_plain_sheet_windows_line_ends_and_empty_file(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes(b'Student Number,Date\r\n\r\nS-1,"2020\r\n-01"\r\nS-2\r\n')
    got = [(r["row_number"], r["student_no"], r["incident_date"]) for r in read_sheet(spark, str(path)).orderBy("row_number").collect()]
    assert got == [(3, "S-1", "2020\n-01"), (4, "S-2", None)]
    (tmp_path / "e.csv").write_bytes(b"")
    with pytest.raises(ValueError):
        read_sheet(spark, str(tmp_path / "e.csv"))
