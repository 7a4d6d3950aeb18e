"""Copy-on-write snapshots (G1, G4, G7) and pruned point reads.

A ``Versioned`` table lies in hash buckets of its key, each a directory; a
snapshot is the list of its buckets' directories.  A write reads only the
buckets that its request's keys fall into, applies the maintenance operator
to them, writes them anew and refers to all others where they lie: its cost follows
the request and not the table.  Earlier snapshots stay readable, and a
failed or repeated write leaves them as they were.

The driver holds one path for each bucket; rows are never collected.  A
bucket's rows are spread over tasks by their volume (``rebalance``), so a
hot bucket is written as several files.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starledger.operators import maintenance as mt
from starledger.operators.ranged import materialize
from starledger.session import scratch_path

BUCKET = "_bucket"
CREATED, UPDATED = "created_at", "updated_at"


def stamps(at: dt.datetime) -> tuple[dict[str, Column], dict[str, Column]]:
    """(columns on insert, columns on update) for a write at ``at``."""
    now = F.lit(at).cast("timestamp_ntz")
    return {CREATED: now, UPDATED: now}, {UPDATED: now}


def with_stamps(df: DataFrame, at: dt.datetime) -> DataFrame:
    """``df`` as rows created at ``at`` (columns that exist are kept)."""
    new = {c: v for c, v in stamps(at)[0].items() if c not in df.columns}
    return df.withColumns(new) if new else df


@dataclass(frozen=True)
class Versioned:
    spark: SparkSession
    schema: T.StructType
    key: str
    buckets: int
    paths: Mapping[int, str]  # of the non-empty buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """The snapshot."""
        return self.rows_of(self.paths)

    def rows_of(self, buckets: Sequence[int]) -> DataFrame:
        at = [self.paths[b] for b in sorted(buckets) if b in self.paths]
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*at)

    def touched(self, keys: DataFrame, col: str) -> list[int]:
        """Buckets of some keys: at most ``buckets`` numbers."""
        found = keys.filter(F.col(col).isNotNull()).select(self._bucket(F.col(col)).alias("b")).distinct()
        return sorted(r["b"] for r in found.collect())

    def replaced(self, buckets: Sequence[int], rows: DataFrame) -> "Versioned":
        """The snapshot with the rows of ``buckets`` replaced by ``rows``."""
        path = scratch_path(self.spark, "version")
        out = rows.select(*self.schema.names).withColumn(BUCKET, self._bucket(F.col(self.key)))
        out.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(path)
        full = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
        left = [r[BUCKET] for r in full.select(BUCKET).distinct().collect()]
        kept = {b: p for b, p in self.paths.items() if b not in set(buckets)}
        return replace(self, paths=kept | {b: f"{path}/{BUCKET}={b}" for b in left})

    # ------------------------------------------------------------- reads
    def lookup(self, value) -> DataFrame:
        """Rows of one key: the files of one bucket."""
        one = self.spark.range(1).select(self._bucket(F.lit(value)).alias("b")).first()["b"]
        return self.rows_of([one]).filter(F.col(self.key) == F.lit(value))

    # ------------------------------------------------------------- writes
    def update(self, updates: DataFrame, cols: Sequence[str], at: dt.datetime | None = None,
               rules: dict[str, Column] | None = None) -> tuple["Versioned", DataFrame]:
        """G7 by key: (snapshot, rejected).  ``updated_at`` is set where a row
        changes, ``created_at`` is kept."""
        batch = materialize(updates, name="request")
        hit = self.touched(batch, self.key)
        res = mt.update_rows(self.rows_of(hit), batch, cols, self.key, on_update=self._on_update(at), rules=rules)
        return self.replaced(hit, res.snapshot), res.rejected

    def delete(self, keys: DataFrame, on_missing: str = "reject") -> tuple["Versioned", DataFrame]:
        """(snapshot, missing keys); all or nothing unless absent keys
        are ignored.  A rejected request writes nothing."""
        batch = materialize(keys.select("id").distinct(), name="request")
        hit = self.touched(batch, "id")
        res = mt.delete_keys(self.rows_of(hit), batch, self.key, on_missing)
        missing = materialize(res.missing, name="missing")
        if on_missing == "reject" and not missing.isEmpty():
            return self, missing
        return self.replaced(hit, res.snapshot), missing

    def upsert(self, updates: DataFrame, cols: Sequence[str], order_col: str, id_col: str, at: dt.datetime | None = None,
               on_update: dict[str, Column] | None = None) -> "Versioned":
        """G1 by the table's key; new ids follow the greatest of the whole
        table, of which one column is read."""
        batch = materialize(updates, name="request")
        hit = self.touched(batch, self.key)
        on_insert = {c: v for c, v in (stamps(at)[0] if at else {}).items() if c in self.schema.names}
        both = dict(on_update or {}) | self._on_update(at)
        snap = mt.upsert(self.rows_of(hit), batch, self.key, cols, order_col, both, id_col,
                         on_insert=on_insert, first_id=mt.next_id(self.rows(), id_col))
        return self.replaced(hit, snap)

    def _on_update(self, at: dt.datetime | None) -> dict[str, Column]:
        return {c: v for c, v in (stamps(at)[1] if at else {}).items() if c in self.schema.names}


def create(df: DataFrame, key: str, buckets: int) -> Versioned:
    """Write ``df`` as the first snapshot, in ``buckets`` buckets of ``key``
    (any column: a unique id for writes, a foreign key for point reads)."""
    empty = Versioned(df.sparkSession, df.schema, key, buckets, {})
    return empty.replaced(range(buckets), df)
