"""Multi-level and kept roll-ups.

``report_rollup`` aggregates facts once, by ``GROUPING SETS``, for every level
a dashboard shows: one scan and one exchange instead of one for each part.

``KeptRollup`` holds partial aggregates of facts by (subject, item, month).
They are additive, so a write changes them by signed deltas: added facts
count +1, removed ones -1, an update is both.  A greatest date can't be
subtracted; the groups that lost a fact as late as their kept date read it anew
from the facts.  Reports by year, month, subject or item come from the
roll-up, whose size is bounded by distinct triples and not by facts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions.scalars import count_when, month_text
from starledger.operators.joins import bounded_broadcast, catalog_cols
from starledger.spec import DEFAULT_SPEC, StarSpec

SUBJECT, ITEM, MONTH = "_sid", "_cid", "_month"
LEVELS = {"subject": (SUBJECT, ITEM), "month": (MONTH, ITEM)}


def _measures(spec: StarSpec) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), count_when(F.col(spec.fact_status) == spec.open_status).alias("open"),
            F.max(spec.fact_date).alias("last_date")]


def _keyed(fact: DataFrame, spec: StarSpec) -> DataFrame:
    return fact.select(F.col(spec.fact_subject).alias(SUBJECT), F.col(spec.fact_catalog).alias(ITEM),
                       month_text(spec.fact_date).alias(MONTH), spec.fact_status, spec.fact_date)


# --------------------------------------------------------------------------- one pass, several levels

def report_rollup(fact: DataFrame, catalog: DataFrame, spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """One row for each subject, month and item of the facts (``level`` says
    which): ``key_id`` or ``key_text``, ``total, minor, major, points, open,
    last_date, known`` (facts whose catalog row exists).

    Facts are reduced by the grouping sets (subject, item) and (month, item)
    in one exchange; the catalog joins the reduced rows.
    """
    f = _keyed(fact, spec)
    sets = f.groupingSets([[F.col(SUBJECT), F.col(ITEM)], [F.col(MONTH), F.col(ITEM)]], SUBJECT, MONTH, ITEM) \
        .agg(*_measures(spec), F.grouping(MONTH).alias("_by_subject"))
    return _levels(sets, catalog, spec)


def _levels(sets: DataFrame, catalog: DataFrame, spec: StarSpec) -> DataFrame:
    """From (subject, item) and (month, item) rows to one row for each
    subject, month and item."""
    cat = bounded_broadcast(catalog_cols(catalog, spec, (spec.category, spec.points)), within=catalog)
    j = sets.join(cat, sets[ITEM] == cat["_cat_id"], "left")
    by_subject = F.col("_by_subject") == 1
    # A (month, item) row also counts for its item: months partition the facts.
    at = F.when(by_subject, F.array(F.lit("subject"))).otherwise(F.array(F.lit("month"), F.lit("item")))
    j = j.withColumn("level", F.explode(at))
    level = F.col("level")
    key_id = F.when(level == "subject", F.col(SUBJECT)).when(level == "item", F.col(ITEM)).alias("key_id")
    known, n = F.col("_cat_id").isNotNull(), F.col("n")
    return j.groupBy("level", key_id, F.when(level == "month", F.col(MONTH)).alias("key_text")).agg(
        F.sum(n).cast("bigint").alias("total"),
        F.sum(F.when(known, n).otherwise(0)).cast("bigint").alias("known"),
        F.sum(F.when(F.col(spec.category) == spec.minor, n).otherwise(0)).cast("bigint").alias("minor"),
        F.sum(F.when(F.col(spec.category) == spec.major, n).otherwise(0)).cast("bigint").alias("major"),
        F.coalesce(F.sum(n * F.col(spec.points)), F.lit(0)).cast("bigint").alias("points"),
        F.sum(F.when(known, F.col("open")).otherwise(0)).cast("bigint").alias("open"),
        F.max("last_date").alias("last_date"),
    )


# --------------------------------------------------------------------------- kept roll-up

@dataclass(frozen=True)
class KeptRollup:
    """(subject, item, month, n, open, last_date) of one snapshot of facts."""

    cells: DataFrame
    spec: StarSpec = DEFAULT_SPEC

    def year(self, year: int | None) -> DataFrame:
        if year is None:
            return self.cells
        return self.cells.filter((F.col(MONTH) >= f"{year:04d}-01") & (F.col(MONTH) <= f"{year:04d}-12"))

    def report_rollup(self, catalog: DataFrame, year: int | None = None) -> DataFrame:
        """The levels of a dashboard, as from the facts."""
        c = self.year(year)
        both = F.array(F.lit(1), F.lit(0))
        sets = c.withColumn("_by_subject", F.explode(both)).groupBy(
            F.when(F.col("_by_subject") == 1, F.col(SUBJECT)).alias(SUBJECT),
            F.when(F.col("_by_subject") == 0, F.col(MONTH)).alias(MONTH), ITEM, "_by_subject",
        ).agg(F.sum("n").alias("n"), F.sum("open").alias("open"), F.max("last_date").alias("last_date"))
        return _levels(sets, catalog, self.spec)

    def changed(self, removed: DataFrame | None, added: DataFrame | None, after: DataFrame) -> "KeptRollup":
        """The roll-up after a write: ``removed`` and ``added`` are the facts'
        old and new rows (an update is in both), ``after`` the facts afterwards.

        Only the write's cells are touched; facts are read for those cells
        alone that lost a fact as late as their kept date.  The result is lazy;
        a caller that keeps it writes it as the next snapshot.
        """
        parts = [_signed(rows, sign, self.spec) for rows, sign in ((removed, -1), (added, 1)) if rows is not None]
        if not parts:
            return self
        deltas = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        d = deltas.groupBy(SUBJECT, ITEM, MONTH).agg(
            F.sum("dn").alias("dn"), F.sum("do").alias("do"), F.max("lost").alias("lost"), F.max("won").alias("won"))
        keys = [SUBJECT, ITEM, MONTH]
        old = self.cells.select(*[F.col(k).alias(f"o{k}") for k in keys], F.col("n").alias("on"), F.col("open").alias("oo"),
                                F.col("last_date").alias("od"))
        same = [d[k].eqNullSafe(old[f"o{k}"]) for k in keys]
        j = d.join(old, same[0] & same[1] & same[2], "left")
        n = F.coalesce("on", F.lit(0)) + F.col("dn")
        stale = F.col("lost") >= F.coalesce(F.greatest("od", "won"), F.col("lost"))
        touched = j.select(*[d[k] for k in keys], n.cast("bigint").alias("n"),
                           (F.coalesce("oo", F.lit(0)) + F.col("do")).cast("bigint").alias("open"),
                           F.greatest("od", "won").alias("last_date"), F.coalesce(stale, F.lit(False)).alias("_stale"))
        touched = touched.filter(F.col("n") != 0)
        again = _dates_again(after, touched.filter("_stale"), self.spec)
        same = [touched[k].eqNullSafe(again[f"a{k}"]) for k in keys]
        fresh = touched.join(again, same[0] & same[1] & same[2], "left").select(
            *[touched[k] for k in keys], "n", "open",
            F.when(F.col("_stale"), F.col("again")).otherwise(F.col("last_date")).alias("last_date"))
        mark = d.select(*[F.col(k).alias(f"t{k}") for k in keys])
        same = [self.cells[k].eqNullSafe(mark[f"t{k}"]) for k in keys]
        kept = self.cells.join(mark, same[0] & same[1] & same[2], "left_anti")
        return KeptRollup(kept.unionByName(fresh), self.spec)


def _signed(rows: DataFrame, sign: int, spec: StarSpec) -> DataFrame:
    k = _keyed(rows, spec)
    none, day = F.lit(None).cast("date"), F.col(spec.fact_date)
    is_open = F.when(F.col(spec.fact_status) == spec.open_status, sign).otherwise(0)
    return k.select(SUBJECT, ITEM, MONTH, F.lit(sign).alias("dn"), is_open.alias("do"),
                    (day if sign < 0 else none).alias("lost"), (day if sign > 0 else none).alias("won"))


def _dates_again(after: DataFrame, cells: DataFrame, spec: StarSpec) -> DataFrame:
    """Greatest dates of some cells, from the facts."""
    f = _keyed(after, spec)
    c = cells.select(*[F.col(k).alias(f"a{k}") for k in (SUBJECT, ITEM, MONTH)])
    same = [f[k].eqNullSafe(c[f"a{k}"]) for k in (SUBJECT, ITEM, MONTH)]
    hit = f.join(c, same[0] & same[1] & same[2], "left_semi")
    return hit.groupBy(*[F.col(k).alias(f"a{k}") for k in (SUBJECT, ITEM, MONTH)]).agg(F.max(spec.fact_date).alias("again"))


def build_rollup(fact: DataFrame, spec: StarSpec = DEFAULT_SPEC) -> KeptRollup:
    return KeptRollup(_keyed(fact, spec).groupBy(SUBJECT, ITEM, MONTH).agg(*_measures(spec)), spec)
