"""Sinks (A5, A8): snapshots and report documents written as new paths.

Plain Parquet has no transactions; a maintenance step writes the new
snapshot to a *new* directory and readers switch to it, so a failed or
retried job never leaves a half-written table behind.  Writes go to shared
storage (the cluster's checkpoint or warehouse folder), never to a
machine-local temporary folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_rows(existing: DataFrame, accepted: DataFrame) -> DataFrame:
    """A5 as a snapshot: stored rows plus accepted rows (by column name)."""
    return existing.unionByName(accepted.select(*existing.columns))


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None,
                   mode: str = "errorifexists") -> None:
    """Write ``df`` as a Parquet snapshot at a new ``path``."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_to(df: DataFrame, path: str) -> None:
    """A5 in place: Parquet append (each task writes new files only)."""
    df.write.mode("append").parquet(path)


def write_report(doc: DataFrame, path: str) -> None:
    """Write the one-row nested report document as JSON."""
    doc.coalesce(1).write.mode("errorifexists").json(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None,
                  mode: str = "errorifexists") -> None:
    """Save ``df`` as a catalog table bucketed (and sorted) by ``key``.

    Write the subject table bucketed by its id and the fact table by its
    subject key with the same bucket count: the per-subject roll-up then
    aggregates inside each bucket and the join back to subjects is a
    bucket-to-bucket merge -- no shuffle of the fact table.  ``path`` makes
    it an external table at shared storage.
    """
    w = df.write.mode(mode).bucketBy(buckets, key).sortBy(key)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
