"""Window-style operators (W1-W3) and dense distributed numbering.

No operator here uses a window without ``partitionBy`` over unbounded data:
such a window plans ``SinglePartition`` and moves every row into one task.
Global positions are built from the counts of written range partitions
(``operators.ranged``) or of scan partitions: a running sum over one row for
each partition gives its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger.operators.ranged import RangedTable, running_before, write_ranged


def first_per_key(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """Keep the first row (smallest ``order_col``) of each ``key``.

    A grouped ``min`` (partial aggregation absorbs a hot key) followed by a
    semi join on ``(key, order)``; ``order_col`` must be unique per key.
    """
    d = df.withColumn("_fk", key)
    firsts = d.groupBy(F.col("_fk").alias("_k")).agg(F.min(order_col).alias("_first"))
    out = d.join(firsts, (d["_fk"] == firsts["_k"]) & (d[order_col] == firsts["_first"]), "left_semi")
    return out.drop("_fk")


def dense_sequence(df: DataFrame, order_col: str, out: str = "seq", start: int | Column = 1,
                   ranges: int | None = None) -> DataFrame:
    """Number rows ``start, start+1, ...`` in ``order_col`` order, no gaps.

    ``order_col`` must be unique.  The rows are written in range partitions of
    it; a row's number is the count of all earlier ranges plus its position in
    its own, so that one row for each range meets in a window, however the
    keys are spread (dense row numbers, timestamps, 64-bit hashes)."""
    return write_ranged(df, [F.col(order_col)], "numbered", ranges).numbered(out, start)


def number_accepted(df: DataFrame, rejected: Column, order_col: str) -> RangedTable:
    """Write a classified batch once, accepted rows first, each part in
    ``order_col`` order: the accepted rows' ranks (``numbered``) are gapless
    from 0, and the rejected rows are read from the same files."""
    return write_ranged(df, [rejected.asc(), F.col(order_col)], "classified")


def number_rows(df: DataFrame, out: str = "row_index", start: int = 1) -> DataFrame:
    """Dense 1-based row index in scan order (``zipWithIndex`` as DataFrame ops).

    Apply directly on a file scan: the scan's partitioning is deterministic,
    so both passes (per-partition counts and rows) see the same ids even when
    a lost task is recomputed.  Offsets come from the per-partition counts.
    """
    d = df.withColumn("_mid", F.monotonically_increasing_id())
    d = d.withColumn("_p", F.shiftright("_mid", 33)).withColumn("_i", F.col("_mid").bitwiseAND((1 << 33) - 1))
    counts = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offs = running_before(counts, "_p", "_n", "_off").select("_p", "_off")
    j = d.join(offs, "_p")
    return j.withColumn(out, (F.col("_off") + F.col("_i") + F.lit(start)).cast("bigint")) \
        .drop("_mid", "_p", "_i", "_off")


def rank_share(top: DataFrame, k: int = 5, count_col: str = "incident_count",
               order: tuple = (("incident_count", False), ("name", True), ("id", True)),
               floor_pct: int = 8) -> DataFrame:
    """Rank number and bar width for the first ``k`` rows of a top list:
    ``max(floor_pct, round(100 * count / max(max count, 1)))``.

    ``top`` is already limited (a top-N frame), so the un-partitioned window
    runs over at most ``k`` rows.
    """
    keys = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]
    head = top.orderBy(*keys).limit(k)
    w = Window.orderBy(*keys)
    mx = F.max(count_col).over(Window.partitionBy())
    return head.select(
        F.row_number().over(w).cast("bigint").alias("rank_no"), "id", "code", "name", count_col,
        F.greatest(F.lit(floor_pct).cast("double"),
                   F.round(F.lit(100.0) * F.col(count_col) / F.greatest(mx, F.lit(1)))).cast("bigint").alias("share_pct"),
    )
