"""The trigram index finds what the scan finds, and reads less."""
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from starledger.operators import ranged
from starledger.operators.filters import search_any
from starledger.operators.trigrams import build_trigram_index, grams
from starledger.plans import fixtures as fx

CELLS = ["Cruz", "Dela Cruz", "cr", "z", "", None, "ÀÉÎ ß", "éa", "\U0001F600\U0001F601x", "aaaaaa", "aab", "100%_x", "a\u0000b", "INC-00012"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i * 7 + j, CELLS[i], CELLS[(i * 3 + j) % len(CELLS)], i) for i in range(len(CELLS)) for j in range(7)]
    return spark.createDataFrame(rows, "id bigint, a string, b string, n int").repartition(3)


@pytest.fixture(scope="module")
def index(table):
    return build_trigram_index(table, "id", ["a", "b", "n"], ranges=5)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("needle", ["Cruz", "cru", "uz", "Z", "a", "aa", "aaa", "aaab", "ruz d", "É", "ß", "\U0001F600\U0001F601", "\U0001F601", "%_", "b",
                                    "a\u0000", "1", "inc-00012", "nowhere", "00013", "cruzz", " ", "a cr"])
def test_search_equals_the_scan(table, index, needle):
    assert ids(index.search(needle)) == ids(search_any(table, needle, ["a", "b", F.col("n").cast("string")]))


def test_blank_needle_keeps_all(table, index):
    assert ids(index.search("")) == ids(table)
    assert sorted(index.search("").columns) == sorted(table.columns)


def test_random_needles(table, index):
    rng = random.Random(3)
    text = " ".join(c or "" for c in CELLS)
    for _ in range(12):
        at, n = rng.randrange(len(text)), rng.randrange(1, 6)
        needle = text[at:at + n]
        if needle:
            assert ids(index.search(needle)) == ids(search_any(table, needle, ["a", "b", F.col("n").cast("string")])), needle


def test_grams_start_at_every_character(spark):
    got = spark.createDataFrame([("abcab",), ("",), (None,)], "t string").select(grams(F.col("t")).alias("g")).collect()
    assert sorted(got[0]["g"]) == sorted({"abc", "bca", "cab", "ab\0", "b\0\0"})
    assert got[1]["g"] is None and got[2]["g"] is None


def test_a_rare_needle_reads_few_files(spark):
    facts = fx.order_facts(spark, SF_SMALL)
    index = build_trigram_index(facts, "id", ["incident_no"], ranges=9)
    some = facts.orderBy("id").first()
    found = index.search(some["incident_no"])
    assert some["id"] in ids(found)
    assert len(found.inputFiles()) < index.rows.ranges.count() + 2
    assert len(index.rows.rows_of([0]).inputFiles()) == 1
    # a gram that every number holds is cut into several files, none of them huge
    sizes = [r["rows"] for r in index.postings.ranges.collect()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)


def test_ranges_follow_the_rows(spark, table, monkeypatch):
    """More rows than the shuffle's partitions hold give more ranges, not larger ones."""
    monkeypatch.setattr(ranged, "RANGE_ROWS", 16)
    index = build_trigram_index(table, "id", ["a", "b", "n"])
    for stored in (index.rows, index.postings):
        if (total := sum(r["rows"] for r in stored.ranges.collect())) > 16 * int(spark.conf.get("spark.sql.shuffle.partitions")):
            assert stored.ranges.count() > total / 32 and max(r["rows"] for r in stored.ranges.collect()) <= 3 * 16
    assert index.postings.ranges.count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = index.postings.all_rows().groupBy(ranged.PART).agg(F.min("gram").alias("low"), F.max("gram").alias("high"))
    assert {tuple(r) for r in held.collect()} == {tuple(r) for r in index.postings.ranges.select(ranged.PART, "low", "high").collect()}
    assert ids(index.search("cru")) == ids(search_any(table, "cru", ["a", "b", F.col("n").cast("string")]))


def test_empty_table(spark):
    index = build_trigram_index(spark.createDataFrame([], "id bigint, a string"), "id", ["a"])
    assert index.search("abc").count() == 0 and index.search("a").count() == 0 and index.search("").count() == 0
