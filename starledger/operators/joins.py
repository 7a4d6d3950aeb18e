"""Joins (C1-C8).

Broadcast policy: a side is hinted for broadcast only when it is a constant
frame, or derived from one by filters and projections.  Otherwise the planner
decides by the sizes in bytes that it knows (a small file), and AQE by the
sizes that a shuffle stage has *measured*.  No join here runs a job while the
plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.spec import DEFAULT_SPEC, StarSpec


def is_constant(df: DataFrame, within: DataFrame | None = None) -> bool:
    """``df``, or ``within`` of which ``df`` is a filter, projection or
    distinct, is a constant frame (its rows are part of the plan)."""
    from starledger.sources.constants import KNOWN_ROWS
    return df in KNOWN_ROWS or (within is not None and within in KNOWN_ROWS)


def bounded_broadcast(df: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Broadcast hint on constant frames; unchanged frame otherwise."""
    return F.broadcast(df) if is_constant(df, within) else df


def catalog_cols(catalog: DataFrame, spec: StarSpec = DEFAULT_SPEC,
                 cols: Sequence[str] = ("category", "severity_points")) -> DataFrame:
    """Catalog narrowed to its key (renamed ``_cat_id``) and ``cols``."""
    return catalog.select(F.col(spec.catalog_key).alias("_cat_id"), *cols)


def with_catalog(fact: DataFrame, catalog: DataFrame, spec: StarSpec = DEFAULT_SPEC,
                 cols: Sequence[str] = ("category", "severity_points"), how: str = "inner") -> DataFrame:
    """Fact JOIN catalog on the catalog key, adding ``cols`` (``how`` is
    ``inner``, or ``left`` to keep facts whose catalog row is missing)."""
    cat = bounded_broadcast(catalog_cols(catalog, spec, cols), within=catalog)
    return fact.join(cat, fact[spec.fact_catalog] == cat["_cat_id"], how).drop("_cat_id")


def enrich(fact: DataFrame, subject: DataFrame, catalog: DataFrame,
           spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """Fact ⋈ subject ⋈ catalog; all fact columns plus subject number,
    names, grade, section and catalog code, name, category, points."""
    s = subject.select(F.col(spec.subject_key).alias("_subj_id"),
                       *[F.col(getattr(spec, a)).alias(a if a != "subject_no" else "student_no")
                         for a in ("subject_no", "first_name", "last_name", "grade", "section")])
    c = catalog.select(F.col(spec.catalog_key).alias("_cat_id"),
                       F.col(spec.code).alias("offense_code"),
                       F.col(spec.catalog_name).alias("offense_name"),
                       F.col(spec.category).alias("category"),
                       F.col(spec.points).alias("severity_points"))
    c = bounded_broadcast(c, within=catalog)
    out = fact.join(s, fact[spec.fact_subject] == s["_subj_id"], "inner")
    out = out.join(c, out[spec.fact_catalog] == c["_cat_id"], "inner")
    return out.drop("_subj_id", "_cat_id")


def lookup_ci(df: DataFrame, key_col: str, dim: DataFrame, dim_key: str,
              take: Sequence[str], prefix: str) -> DataFrame:
    """C4: case-insensitive lookup, at most one match per row.

    The dimension is reduced to one row per ``lower(key)`` (the lowest
    ``take[0]`` wins) before a LEFT join, so a row never fans out.  Output columns are
    ``<prefix><c>`` for ``c`` in ``take``; NULL when there is no match.
    """
    from starledger.operators.intake import lookup_first
    first = lookup_first(dim, dim_key, take[0], tuple(take[1:]))
    first = first.select("_lk", *[F.col(f"_m.{c}" if c != take[0] else "_m.id").alias(f"{prefix}{c}") for c in take])
    out = df.join(first, F.lower(df[key_col]) == first["_lk"], "left")
    return out.drop("_lk")


def not_stored(df: DataFrame, key_col: str, stored: DataFrame, stored_key: str) -> DataFrame:
    """Rows whose ``lower(key)`` is not already stored (anti join)."""
    keys = stored.select(F.lower(F.col(stored_key)).alias("_sk"))
    return df.join(keys, F.lower(df[key_col]) == keys["_sk"], "left_anti")


def fk_audit(fact: DataFrame, subject: DataFrame, catalog: DataFrame,
             spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """Fact rows whose subject or catalog parent is missing.

    Returns ``(id, missing_subject, missing_catalog)`` for orphan rows only.
    Both parent checks are left joins on key-only projections, so only key
    columns cross the shuffle.
    """
    subj = subject.select(F.col(spec.subject_key).alias("_sid"), F.lit(True).alias("_has_s"))
    cat = catalog.select(F.col(spec.catalog_key).alias("_cid"), F.lit(True).alias("_has_c"))
    f = fact.select(F.col(spec.fact_key).alias("id"),
                    F.col(spec.fact_subject).alias("_fs"), F.col(spec.fact_catalog).alias("_fc"))
    j = f.join(subj, f["_fs"] == subj["_sid"], "left").join(cat, f["_fc"] == cat["_cid"], "left")
    j = j.select("id",
                 F.col("_fs").alias(spec.fact_subject),
                 F.col("_fc").alias(spec.fact_catalog),
                 F.col("_has_s").isNull().alias("missing_subject"),
                 F.col("_has_c").isNull().alias("missing_catalog"))
    return j.filter(F.col("missing_subject") | F.col("missing_catalog"))


def valid_children(fact: DataFrame, subject: DataFrame, catalog: DataFrame,
                   spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """Fact rows whose two parents both exist (two semi joins)."""
    s = subject.select(F.col(spec.subject_key).alias("_sid"))
    c = catalog.select(F.col(spec.catalog_key).alias("_cid"))
    out = fact.join(s, fact[spec.fact_subject] == s["_sid"], "left_semi")
    return out.join(c, out[spec.fact_catalog] == c["_cid"], "left_semi")


def dedupe_keys(keys: DataFrame, key: str = "id") -> DataFrame:
    """Input key list deduplicated (order carries no meaning in a frame)."""
    return keys.select(key).dropDuplicates([key])


def missing_keys(keys: DataFrame, table: DataFrame, key: str = "id",
                 table_key: str = "id") -> DataFrame:
    """Requested keys that are not in ``table``.

    The table is semi-joined against the request first: where the planner
    knows or AQE measures a small request, the table is only filtered in its
    scan stage, and the anti join runs between two small frames.
    """
    k = dedupe_keys(keys, key)
    t = table.select(F.col(table_key).alias("_tk"))
    present = t.join(k.withColumnRenamed(key, "_rk"), t["_tk"] == F.col("_rk"), "left_semi")
    return k.join(present, k[key] == present["_tk"], "left_anti")


def by_keys(df: DataFrame, keys: DataFrame, key: str = "id", df_key: str = "id") -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (semi join, no list cap)."""
    k = dedupe_keys(keys, key).withColumnRenamed(key, "_k")
    return df.join(k, df[df_key] == k["_k"], "left_semi")


def protected_parents(parent: DataFrame, child: DataFrame, keys: DataFrame,
                      parent_key: str, child_fk: str, cols: Sequence[str],
                      count_name: str = "incident_count") -> DataFrame:
    """Requested parents that still have children, with child counts.

    Children are first reduced to the requested parents (a semi join against
    the broadcast keys when the request is provably small, so the child
    table is only filtered in its scan stage), then counted per foreign key
    with partial aggregation (a hot parent collapses map-side), then joined
    to the requested parents.
    """
    k = bounded_broadcast(dedupe_keys(keys, "id").withColumnRenamed("id", "_k"))
    c = child.join(k, child[child_fk] == k["_k"], "left_semi")
    counts = c.groupBy(F.col(child_fk).alias("_fk")).agg(F.count(F.lit(1)).alias(count_name))
    p = parent.join(k, parent[parent_key] == k["_k"], "left_semi")
    out = p.join(counts, p[parent_key] == counts["_fk"], "inner")
    return out.select(F.col(parent_key).alias("id"), *cols, count_name)
