"""Bitmaps of keys: against the joins and plain sets."""
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL, rows
from starledger.operators import joins, keysets
from starledger.plans import fixtures as fx
from test_plans import plan_text

EDGES = [0, 1, -1, 32767, 32768, 32769, -32767, -32768, -32769, 65536, 65537, -65536]


def frame(spark, values, kind="bigint"):
    return spark.createDataFrame([(v,) for v in values], f"id {kind}").repartition(3)


def test_edges_of_buckets_come_back(spark):
    none = keysets.key_bits(frame(spark, []), "id")
    bits = keysets.key_bits(frame(spark, [*EDGES, *EDGES, None]), "id")
    assert sorted(r["key"] for r in keysets.keys_without(bits, none).collect()) == sorted(EDGES)
    assert keysets.count_keys(bits).first()["n_keys"] == len(EDGES) and keysets.count_keys(none).first()["n_keys"] == 0
    assert keysets.keys_without(bits, bits).count() == 0


@pytest.mark.parametrize("top", [1 << 15, (1 << 63) - 1])
def test_keys_at_the_ends_of_the_range(spark, top):
    for own in (list(range(top - 40, top)) + [top], list(range(-top - 1, -top + 40))):
        got = keysets.missing_keys(frame(spark, own), frame(spark, own[::3]))
        assert sorted(r["id"] for r in got.collect()) == sorted(set(own) - set(own[::3]))


@pytest.mark.parametrize("width,most", [(300, 1024), (200_000, 1024), (200_000, 3), (1 << 40, 1024)])
def test_missing_keys_equal_the_join_and_plain_sets(spark, width, most):
    r = random.Random(width + most)
    asked = [r.randrange(-width, width) for _ in range(3000)] + [None, None]
    held = [r.randrange(-2 * width, width) for _ in range(2000)] + asked[:900] + [None]
    keys, table = frame(spark, asked), frame(spark, held).withColumn("other", F.lit(1))
    got = [x["id"] for x in keysets.missing_keys(keys, table, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == set(asked) - (set(held) - {None})
    assert set(got) == {x["id"] for x in joins.missing_keys(keys, table).collect()}


def test_empty_tables_and_other_types(spark):
    some, none = frame(spark, [3, 4], "int"), frame(spark, [], "int")
    assert keysets.missing_keys(none, some).count() == 0
    assert sorted(x["id"] for x in keysets.missing_keys(some, none).collect()) == [3, 4]
    assert keysets.missing_keys(some, frame(spark, [3])).schema["id"].dataType.simpleString() == "int"
    text = frame(spark, ["a", "b"], "string")
    assert [x["id"] for x in keysets.missing_keys(text, frame(spark, ["a"], "string")).collect()] == ["b"]


@pytest.mark.parametrize("star,col", [(fx.orders_star, "student_id"), (fx.lineitem_star, "offense_id")])
def test_audit_equals_the_joins(spark, star, col):
    st = star(spark, SF_MID)
    spoilt = st.fact.withColumn(col, F.when(F.col("id") % 7 == 0, -F.col(col)).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col(col)))
    want = rows(joins.fk_audit(spoilt, st.subject, st.catalog).withColumn(col, F.coalesce(col, F.lit(0))))
    assert want and rows(keysets.fk_audit(spoilt, st.subject, st.catalog).withColumn(col, F.coalesce(col, F.lit(0)))) == want
    assert keysets.fk_audit(st.fact, st.subject, st.catalog).count() == 0


def test_audit_shuffles_no_fact_rows(spark):
    st = fx.lineitem_star(spark, SF_SMALL)
    bits = plan_text(keysets.key_bits(st.fact, "offense_id"))
    moved = [line for line in bits.splitlines() if "hashpartitioning" in line]
    assert moved and all("hashpartitioning(_groupingexpression" in line for line in moved) and "partial_bitmap_construct_agg" in bits
    spoilt = st.fact.withColumn("offense_id", F.when(F.col("id") % 13 == 0, -F.col("offense_id") - 1).otherwise(F.col("offense_id")))
    audit = keysets.fk_audit(spoilt, st.subject, st.catalog)
    p = plan_text(audit)
    assert "hashpartitioning" not in p and p.count("BroadcastHashJoin") >= 2
    assert audit.count() > 0
