"""Tables written in range partitions: an order-statistics index.

``write_ranged`` partitions rows by sampled ranges of a total order, sorts
inside each range and writes them, with the range's number and each row's
position in its range.  Written once, both are facts of the files and not of
a task attempt, so a recomputed task can't change them.  One row for each
range (its count, and the running count before it) then answers:

* the rank of every row, without a window over rows: ``before + position``;
* which ranges hold the ranks ``a .. b``: a seek by position;
* which ranges hold values ``x .. y`` of the leading column: a seek by key.

Seeks read the files of the ranges they need and list no other directory.
Ranges are cut by the sampled order itself, so dense, sparse and hashed keys
give evenly filled ranges alike; a value that holds a third of all rows is cut
too, as long as the order ends in a unique column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starledger.session import scratch_path

PART, POS = "_range", "_position"
ROW_BITS = (1 << 33) - 1  # the row part of monotonically_increasing_id
RANGE_ROWS = 1 << 21  # about so many rows a range holds, beyond what the shuffle's partitions hold so


def materialize(df: DataFrame, enabled: bool = True, name: str = "materialized") -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table in the shared
    checkpoint folder (``spark.checkpoint.dir``) and reading it back, so the
    later passes read the written rows instead of recomputing an expensive
    plan, and a lost executor re-reads instead of redoing the work.  (Parquet
    is columnar and compact; an RDD checkpoint would Java-serialize rows.)"""
    if not enabled:
        return df
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_before(counts: DataFrame, part: str, rows: str, out: str = "before") -> DataFrame:
    """``counts`` with the sum of ``rows`` over all smaller ``part`` values.
    The window has no partition: ``counts`` has one row for each partition of
    a table."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(rows).over(w), F.lit(0)).cast("bigint"))


@dataclass(frozen=True)
class RangedTable:
    """A table written by ``write_ranged``.

    ``ranges`` has one row for each non-empty range: its number, ``rows``,
    ``before`` (rows of all earlier ranges) and, where a leading column was
    named, its ``low`` and ``high``.
    """

    path: str
    schema: T.StructType  # of the rows, without PART (a directory level)
    ranges: DataFrame
    split: bool           # one directory for each range

    @property
    def spark(self) -> SparkSession:
        return self.ranges.sparkSession

    @property
    def columns(self) -> list[str]:
        return [c for c in self.schema.names if c not in (PART, POS)]

    def all_rows(self) -> DataFrame:
        """Every row, with PART and POS."""
        schema = self.schema if PART in self.schema.names else T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def rows_of(self, parts: Sequence[int]) -> DataFrame:
        """The rows of some ranges, with POS; no other directory is listed."""
        if not self.split:
            raise ValueError("seeks need a table written with split=True")
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{PART}={p}" for p in parts])

    def total(self) -> DataFrame:
        """One row, ``total_rows``, from the counts of the ranges."""
        return self.ranges.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("total_rows"))

    def numbered(self, out: str, start: int | Column = 0) -> DataFrame:
        """Every row with its rank, counted from ``start``.  The broadcast side
        has one row for each partition of the written table."""
        s = start if isinstance(start, Column) else F.lit(start)
        offs = F.broadcast(self.ranges.select(F.col(PART).alias("_part"), "before"))
        rows = self.all_rows()
        j = rows.join(offs, rows[PART] == offs["_part"])
        return j.select(*self.columns, (F.col("before") + F.col(POS) + s).cast("bigint").alias(out))

    def slice(self, first: int, n: int) -> DataFrame:
        """The rows of ranks ``first .. first + n - 1`` (from 0), with ``rank``.

        Driver work: at most ``n + 1`` ranges overlap a slice of ``n`` rows, so
        at most that many counts are collected to name their directories.
        """
        hit = self.ranges.filter((F.col("before") < first + n) & (F.col("before") + F.col("rows") > first)) \
            .orderBy(PART).limit(n + 1).collect()
        out = self.rows_of([]).withColumn("rank", F.lit(0).cast("bigint"))
        for i, h in enumerate(hit):
            rows = self.rows_of([h[PART]]).withColumn("rank", F.lit(h["before"]) + F.col(POS))
            out = rows if i == 0 else out.unionByName(rows)
        return out.filter((F.col("rank") >= first) & (F.col("rank") < first + n)).select(*self.columns, "rank")

    def holding(self, low, high) -> list[int]:
        """Ranges whose leading column meets ``low .. high``.  The caller asks
        for narrow intervals; one small number for each range met is collected."""
        hit = self.ranges.filter((F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low)))
        return [r[PART] for r in hit.select(PART).orderBy(PART).collect()]

    def holding_each(self, values: Sequence) -> dict:
        """For each value the ranges whose leading column may hold it, in one
        pass over the ranges."""
        if not values:
            return {}
        met = F.filter(F.array(*[F.lit(v) for v in values]), lambda v: (F.col("low") <= v) & (F.col("high") >= v))
        hit = self.ranges.select(PART, met.alias("met")).filter(F.size("met") > 0).orderBy(PART).collect()
        return {v: [h[PART] for h in hit if v in h["met"]] for v in values}


def write_ranged(df: DataFrame, order: Sequence[Column], name: str, ranges: int | None = None,
                 split: bool = False, leading: str | None = None, rows: int | None = None) -> RangedTable:
    """Write ``df`` in range partitions of ``order`` (see the module).

    Without ``ranges`` their number follows from the volume: the shuffle's
    partitions, merged by AQE to its advisory size, or as many as hold
    ``RANGE_ROWS`` rows each where that is more, so the rows that a task sorts
    stay the same as the table grows.  ``rows`` is a bound of its rows, where one is
    cheaper than a count.  ``split`` gives each range its own directory, for
    seeks; ``leading`` names the first column of ``order``, which is not null and whose
    least and greatest value each range keeps.
    """
    spark = df.sparkSession
    if not ranges:
        needed = -(-(df.count() if rows is None else rows) // RANGE_ROWS)
        ranges = needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None
    by = [ranges, *order] if ranges else list(order)
    cut = df.repartitionByRange(*by).withColumn(PART, F.spark_partition_id())
    placed = cut.sortWithinPartitions(PART, *order) \
        .withColumn(POS, F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)))
    path = scratch_path(spark, name)
    writer = placed.write.mode("errorifexists")
    (writer.partitionBy(PART) if split else writer).parquet(path)
    schema = T.StructType([f for f in placed.schema.fields if not (split and f.name == PART)])
    full = spark.read.schema(placed.schema).parquet(path)
    counts = full.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"))
    if leading:  # of each range's first and last row: least and greatest of a text would sort all rows
        ends = full.join(F.broadcast(counts), PART).filter((F.col(POS) == 0) | (F.col(POS) == F.col("rows") - 1))
        counts = ends.groupBy(PART, "rows").agg(F.min(leading).alias("low"), F.max(leading).alias("high"))
    counts = running_before(counts, PART, "rows")
    if split:  # a standing index: its directory of ranges is written too
        counts = materialize(counts, name=f"{name}-ranges")
    return RangedTable(path, schema, counts, split)
