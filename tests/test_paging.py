"""The order index: pages equal a plain sort, seeks read few files."""
import re

from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from starledger.operators.ordering import recent_keys
from starledger.operators.paging import build_page_index, ranked
from starledger.operators.ranged import PART, write_ranged
from starledger.plans import fixtures as fx
from starledger.plans.listings import indexed_page, listing_index


def plain(df):
    return [(r["incident_date"], r["id"]) for r in df.orderBy(F.desc("incident_date"), F.desc("id")).select("incident_date", "id").collect()]


def test_every_page_depth_equals_a_sort(spark):
    facts = fx.order_facts(spark, SF_SMALL)
    want = plain(facts)
    index = build_page_index(facts, recent_keys(), size=40, ranges=7)
    assert index.table.ranges.count() > 3
    last = index.last_page()
    assert last == (len(want) - 1) // 40
    for p in (0, 1, last // 2, last - 1, last):
        got = [(r["incident_date"], r["id"]) for r in index.page(p).collect()]
        assert got == want[p * 40:p * 40 + 40]
    assert index.page(last + 1).count() == 0
    info = index.info(last).first()
    assert (info["total_rows"], info["page_count"], info["last_row"]) == (len(want), last + 1, len(want))


def test_a_page_reads_at_most_two_files(spark):
    st = fx.orders_star(spark, SF_MID)
    index = listing_index(st.fact, st.subject, st.catalog, n=10, ranges=16)
    assert index.table.all_rows().select(F.input_file_name()).distinct().count() == index.table.ranges.count()
    for p in (0, 7, index.last_page() // 2, index.last_page()):
        files = index.page(p).inputFiles()
        assert 1 <= len(files) <= 2, files
        rows = indexed_page(index, st.subject, st.catalog, p).collect()
        assert [r["rank"] for r in rows] == sorted(r["rank"] for r in rows) and rows[0]["rank"] == p * 10


def test_hot_leading_value_is_split(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    t = write_ranged(df, [F.col("k"), F.col("id")], "test", ranges=6, split=True, leading="k")
    sizes = [r["rows"] for r in t.ranges.collect()]
    assert max(sizes) < 3 * 9000 / 6
    parts = t.holding("hot", "hot")
    assert t.rows_of(parts).filter("k = 'hot'").count() == 6000
    assert t.holding_each(["hot", "zzz"]) == {"hot": parts, "zzz": []} and t.holding_each([]) == {}
    assert t.rows_of(t.holding("zzz", "zzzz")).count() == 0


def test_empty_and_clashing_tables(spark):
    empty = spark.createDataFrame([], "incident_date date, id bigint")
    index = build_page_index(empty, recent_keys())
    assert index.page(0).count() == 0 and index.last_page() == 0
    assert index.info(0).first()["page_count"] == 1
    assert ranked(empty, recent_keys()).count() == 0
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("2020-01-01", 3)], "d string, id bigint")
    got = {r["id"]: r["rank_no"] for r in ranked(nulls, [F.desc("d"), F.desc("id")]).collect()}
    assert got == {3: 1, 2: 2, 1: 3}


def test_numbers_survive_a_second_read(spark):
    t = write_ranged(spark.range(1000).select(F.xxhash64("id").alias("h")), [F.col("h")], "test", ranges=5)
    a, b = t.numbered("n").collect(), t.numbered("n").collect()
    assert sorted(a) == sorted(b) and re.search(r"_range", PART)
