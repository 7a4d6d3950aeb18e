"""Key audits by exact bitmaps (C6, C7, H2 on integer keys).

The keys of a column are kept as bitmaps, one of 32,768 bits for each bucket
of the key range.  Every task sets the bits of its own rows, so that only
bitmaps are shuffled and never fact rows: a key that a third of all facts
hold is one bit.  A bucket's missing keys are the child's bits that the
parent does not have; only they are turned back into keys.

A task's bitmaps take one bit for each key between the smallest and the
largest key of the child.  Where that is more than ``MOST_BUCKETS`` bitmaps
(sparse, hashed or very many keys), or keys are not integers, the joins of
``operators.joins`` do the work.  Both ways are exact.  The choice reads the
child's smallest and largest key, in one aggregate, when it is called; an
audit then writes the missing keys, so that the planner knows their size
before it decides how facts meet them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from starledger.operators import joins
from starledger.operators.ranged import materialize
from starledger.spec import DEFAULT_SPEC, StarSpec

BITS = 1 << 15  # of a bitmap, as the built-in functions cut them
MOST_BUCKETS = 1024  # 4 MB of bitmaps a task; keys within about 33 million of each other


def key_bits(df: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): the distinct non-null values of ``key``."""
    k = F.col("k")
    return (df.select(F.col(key).cast("bigint").alias("k")).filter(k.isNotNull())
            .groupBy(F.bitmap_bucket_number(k).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits")))


def count_keys(bits: DataFrame) -> DataFrame:
    """One row, ``n_keys``: how many keys the bitmaps hold."""
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n_keys"))


def keys_without(bits: DataFrame, others: DataFrame, out: str = "key") -> DataFrame:
    """The keys in ``bits`` that are not in ``others``, each once."""
    both = bits.join(others.select("bucket", F.col("bits").alias("has")), "bucket", "left")
    byte = lambda c: F.substring(c, F.col("at") + 1, F.lit(1))
    number = lambda c: F.coalesce(F.conv(F.hex(byte(c)), 16, 10).cast("int"), F.lit(0))
    both = both.select("bucket", "bits", "has", F.explode(F.sequence(F.lit(0), F.lit(BITS // 8 - 1))).alias("at"))
    left = both.filter(~byte("bits").eqNullSafe(byte("has")) & (byte("bits") != F.lit(b"\x00"))) \
        .select("bucket", "at", number("bits").bitwiseAND(F.bitwise_not(number("has"))).alias("x"))
    each = left.select("bucket", "at", "x", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).filter("getbit(x, i) = 1")
    place = F.col("at") * 8 + F.col("i")
    return each.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BITS + 1 + place)
                       .otherwise(F.col("bucket") * BITS - place).alias(out))


def _ranges(df: DataFrame, keys: list[str], most: int) -> list[tuple[int, int] | None] | None:
    """(smallest, largest) of each key, None for a key without a value; None
    in all where the bitmaps would be too many."""
    if not all(isinstance(df.schema[k].dataType, IntegralType) for k in keys):
        return None
    row = df.agg(*[f(F.col(k)).alias(f"{f.__name__}{i}") for i, k in enumerate(keys) for f in (F.min, F.max)]).first()
    got = [(row[2 * i], row[2 * i + 1]) for i in range(len(keys))]
    if any(lo is not None and (hi - lo) // BITS + 2 > most for lo, hi in got):
        return None
    return [None if lo is None else (lo, hi) for lo, hi in got]


def _missing(child: DataFrame, key: str, parent: DataFrame, parent_key: str, within: tuple[int, int] | None, out: str) -> DataFrame:
    # Parents beyond the child's keys don't matter; the range reaches their scan.
    lo, hi = within or (0, -1)
    near = parent.filter(F.col(parent_key).between(lo, hi))
    return keys_without(key_bits(child, key), key_bits(near, parent_key), out)


def missing_keys(keys: DataFrame, table: DataFrame, key: str = "id", table_key: str = "id", most: int = MOST_BUCKETS) -> DataFrame:
    """Requested keys that are not in ``table``, each once; a null key is
    one of them.  Equal to ``joins.missing_keys``."""
    ranges = _ranges(keys, [key], most)
    if ranges is None or not isinstance(table.schema[table_key].dataType, IntegralType):
        return joins.missing_keys(keys, table, key, table_key)
    kind = keys.schema[key].dataType
    found = _missing(keys, key, table, table_key, ranges[0], key).select(F.col(key).cast(kind).alias(key))
    return found.unionByName(keys.select(key).filter(F.col(key).isNull()).limit(1))


def fk_audit(fact: DataFrame, subject: DataFrame, catalog: DataFrame, spec: StarSpec = DEFAULT_SPEC, most: int = MOST_BUCKETS) -> DataFrame:
    """Facts whose subject or catalog parent is missing, with which of
    them; a null key has no parent.  Equal to ``joins.fk_audit``, but facts
    meet the missing keys only."""
    fks, parents = (spec.fact_subject, spec.fact_catalog), ((subject, spec.subject_key), (catalog, spec.catalog_key))
    ranges = _ranges(fact, list(fks), most)
    if ranges is None or not all(isinstance(p.schema[k].dataType, IntegralType) for p, k in parents):
        return joins.fk_audit(fact, subject, catalog, spec)
    out = fact.select(F.col(spec.fact_key).alias("id"), *fks)
    gone = []
    for i, (fk, (parent, key), within) in enumerate(zip(fks, parents, ranges)):
        lost = materialize(_missing(fact, fk, parent, key, within, f"_key{i}").withColumn(f"_lost{i}", F.lit(True)), name="missing-keys")
        out = out.join(lost, out[fk] == lost[f"_key{i}"], "left")
        gone.append(F.coalesce(F.col(f"_lost{i}"), F.col(fk).isNull()))
    out = out.select("id", *fks, gone[0].alias("missing_subject"), gone[1].alias("missing_catalog"))
    return out.filter(F.col("missing_subject") | F.col("missing_catalog"))
