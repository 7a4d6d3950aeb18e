"""Table maintenance (G1-G9) as snapshot-to-snapshot transforms.

Plain Parquet has no in-place ``MERGE``; every operator returns the *new
snapshot* as a lazy DataFrame (plus audit frames) to be written to a new
path.  All-or-nothing rules (a delete that must be rejected when any key is
missing or protected) are one lazy plan: the audit becomes an uncorrelated
scalar subquery (``DataFrame.scalar()``), evaluated once, and the snapshot
keeps every row when it is set -- no driver round trip, no cross join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions.scalars import backfill_blank, default_date, plural_has, seq_format, seq_suffix
from starledger.operators.joins import bounded_broadcast, dedupe_keys, missing_keys, protected_parents
from starledger.operators.ranged import materialize
from starledger.operators.windows import dense_sequence, number_accepted
from starledger.spec import (
    DEFAULT_SPEC, MSG_PARENT_CATALOG, MSG_PARENT_SUBJECT, MSG_PROTECTED, MSG_PROTECTED_MORE,
    REASON_CONFLICT, REASON_DUPLICATE_BATCH, REASON_DUPLICATE_ID, REASON_NOT_FOUND, StarSpec,
)


def any_rows(df: DataFrame) -> Column:
    """Scalar-subquery Column: true when ``df`` has at least one row."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("_any")).scalar()


def last_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """Keep the row with the largest ``order_col`` per ``key`` (last wins);
    grouped max + semi join, so a hot key is collapsed map-side."""
    last = df.groupBy(F.col(key).alias("_k")).agg(F.max(order_col).alias("_last"))
    return df.join(last, (df[key] == last["_k"]) & (df[order_col] == last["_last"]), "left_semi")


def present_keys(table: DataFrame, table_key: str, probe: DataFrame, probe_key: str) -> DataFrame:
    """Rows of ``table`` whose ``table_key`` occurs among ``probe[probe_key]``.

    A request batch is usually far smaller than the stored table: when the
    distinct probe keys are provably small they are broadcast, and the table
    is only filtered in its scan stage (no shuffle of the table).
    """
    k = bounded_broadcast(probe.select(F.col(probe_key).alias("_pk")).distinct())
    return table.join(k, table[table_key] == k["_pk"], "left_semi")


def next_id(base: DataFrame, id_col: str = "id") -> Column:
    """Scalar subquery: 1 + the largest id (1 when empty)."""
    return base.agg((F.coalesce(F.max(id_col), F.lit(0)) + 1).cast("bigint").alias("_n")).scalar()


# --------------------------------------------------------------------------- G1

def upsert(base: DataFrame, updates: DataFrame, key: str, cols: Sequence[str], order_col: str,
           on_update: dict[str, Column] | None = None, id_col: str = "id",
           on_insert: dict[str, Column] | None = None, first_id: Column | None = None) -> DataFrame:
    """G1: keyed upsert.  Matching keys overwrite ``cols`` (plus ``on_update``
    constant columns, e.g. ``active = true``); new keys are inserted with ids
    after the current maximum (or from ``first_id``) in ``order_col`` order,
    with the constants of ``on_update`` and ``on_insert``; ids of existing rows
    are kept.  Duplicate keys in ``updates``: the last by ``order_col`` wins."""
    on_update = on_update or {}
    fresh = on_update | (on_insert or {})
    # The batch is read once, its last row for each key is written once.
    last = updates.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*updates.columns), order_col).alias("_row"))
    u = materialize(last.select("_row.*"))
    ur = u.select(F.col(key).alias("_uk"), *[F.col(c).alias(f"_u_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = base.join(ur, base[key] == ur["_uk"], "left")
    hit = F.col("_hit").isNotNull()
    kept = j.select(*[
        F.when(hit, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in cols
        else F.when(hit, on_update[c]).otherwise(F.col(c)).alias(c) if c in on_update
        else F.col(c)
        for c in base.columns])
    new = u.join(base.select(F.col(key).alias("_bk")), u[key] == F.col("_bk"), "left_anti")
    new = dense_sequence(new, order_col, "_new_id", start=next_id(base, id_col) if first_id is None else first_id)
    inserted = new.select(*[
        F.col("_new_id").cast(base.schema[c].dataType).alias(c) if c == id_col
        else F.col(c).cast(base.schema[c].dataType).alias(c) if c in cols or c == key
        else fresh[c].cast(base.schema[c].dataType).alias(c) if c in fresh
        else F.lit(None).cast(base.schema[c].dataType).alias(c)
        for c in base.columns])
    return kept.unionByName(inserted)


# --------------------------------------------------------------------------- G2

@dataclass
class Remap:
    fact: DataFrame      # facts with remapped catalog ids
    catalog: DataFrame   # catalog without the retired rows
    pairs: DataFrame     # (old_id, new_id) applied


def remap_keys(fact: DataFrame, catalog: DataFrame, mapping: DataFrame,
               spec: StarSpec = DEFAULT_SPEC) -> Remap:
    """Move facts from retired catalog codes to replacement codes, then
    drop the retired rows.  ``mapping`` is ``(old_code, new_code)``; a pair is
    applied only when both codes exist.  One lookup pass = simultaneous
    rule: A->B and B->C move A's facts to B, never on to C."""
    cat = catalog.select(F.col(spec.catalog_key).alias("_id"), F.col(spec.code).alias("_code"))
    old = cat.select(F.col("_id").alias("old_id"), F.col("_code").alias("old_code"))
    new = cat.select(F.col("_id").alias("new_id"), F.col("_code").alias("new_code"))
    pairs = mapping.join(old, "old_code").join(new, "new_code").select("old_id", "new_id")
    p = bounded_broadcast(pairs)
    f = fact.join(p, fact[spec.fact_catalog] == p["old_id"], "left")
    f = f.withColumn(spec.fact_catalog, F.coalesce(F.col("new_id"), F.col(spec.fact_catalog))) \
        .drop("old_id", "new_id")
    kept = catalog.join(p, catalog[spec.catalog_key] == p["old_id"], "left_anti")
    return Remap(f.select(*fact.columns), kept, pairs)


# --------------------------------------------------------------------------- G3-G5

@dataclass
class DeleteResult:
    snapshot: DataFrame    # table after the operation (unchanged when rejected)
    missing: DataFrame     # requested keys not present
    protected: DataFrame   # requested parents that still have children (empty for leaf tables)
    rejected: Column       # scalar Column: true when nothing was deleted


def _apply_delete(table: DataFrame, keys: DataFrame, key: str, blocked: Column) -> DataFrame:
    # A provably small request is broadcast: the table is filtered in its scan stage.
    k = bounded_broadcast(dedupe_keys(keys, "id").select(F.col("id").alias("_dk"), F.lit(True).alias("_del")))
    j = table.join(k, table[key] == k["_dk"], "left")
    return j.filter(F.col("_del").isNull() | blocked).select(*table.columns)


def guarded_delete(parent: DataFrame, child: DataFrame, keys: DataFrame, parent_key: str, child_fk: str,
                   preview_cols: Sequence[str], on_missing: str = "reject") -> DeleteResult:
    """Delete parents, all or nothing.  Any requested key missing
    (``on_missing="reject"``) or any requested parent with children rejects
    the whole request; the snapshot is then the unchanged table."""
    miss = missing_keys(keys, parent, "id", parent_key)
    prot = protected_parents(parent, child, keys, parent_key, child_fk, preview_cols)
    blocked = any_rows(prot)
    if on_missing == "reject":
        blocked = blocked | any_rows(miss)
    return DeleteResult(_apply_delete(parent, keys, parent_key, blocked), miss, prot, blocked)


def delete_keys(table: DataFrame, keys: DataFrame, key: str = "id", on_missing: str = "reject") -> DeleteResult:
    """Delete rows of a leaf table; all-or-nothing on missing keys
    unless ``on_missing="ignore"`` (absent keys are then a silent no-op)."""
    miss = missing_keys(keys, table, "id", key)
    blocked = any_rows(miss) if on_missing == "reject" else F.lit(False)
    empty = table.limit(0).select(F.col(key).alias("id"))
    return DeleteResult(_apply_delete(table, keys, key, blocked), miss, empty, blocked)


def protected_preview(protected: DataFrame, label: Column, order: Sequence[Column], noun: str,
                      plural_noun: str | None = None, k: int = 3) -> DataFrame:
    """One message row when parents are protected (none otherwise):
    '<n> selected <noun>s have incident records and cannot be deleted:
    <first k labels>, and <n-k> more. No <noun>s were deleted'.  Only ``k``
    rows are collected."""
    plural_noun = plural_noun or f"{noun}s"
    head = protected.select(label.alias("_label"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    head = head.orderBy(*[f"_o{i}" for i in range(len(order))]).limit(k)
    heads = head.agg(F.array_sort(F.collect_list(F.struct(*[f"_o{i}" for i in range(len(order))], "_label")))
                     .alias("_h"))
    n = protected.agg(F.count(F.lit(1)).alias("_n"))
    from starledger.operators.aggregates import merge_single_rows
    m = merge_single_rows(heads, n)
    text = F.concat_ws(", ", F.transform("_h", lambda x: x["_label"]))
    more = F.when(F.col("_n") > k, F.format_string(MSG_PROTECTED_MORE, F.col("_n") - k)).otherwise("")
    msg = F.format_string(MSG_PROTECTED, plural_has("_n", noun), text, more, F.lit(plural_noun))
    return m.filter(F.col("_n") > 0).select(F.col("_n").alias("protected_count"), msg.alias("message"))


# --------------------------------------------------------------------------- G6-G9

@dataclass
class WriteResult:
    snapshot: DataFrame               # table after the operation
    rejected: DataFrame               # batch rows not applied, with a ``reason``
    inserted: DataFrame | None = None  # the new rows alone, when rows are added


def first_broken(rules: dict[str, Column] | None) -> Column:
    """Name of the first rule that a row breaks, NULL when it keeps them all.
    A rule that gives NULL counts as broken, as in ``domain_audit``."""
    if not rules:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()])


def insert_new(base: DataFrame, batch: DataFrame, key: str, order_col: str, id_col: str = "id",
               rules: dict[str, Column] | None = None, on_insert: dict[str, Column] | None = None) -> WriteResult:
    """Insert rows whose unique ``key`` is new (exact match); conflicts
    with stored rows, and later duplicates inside the batch, are rejected.
    New ids follow the stored maximum in ``order_col`` order.  A row that
    breaks one of the ``rules`` (name -> Column, true when broken) is rejected
    with the rule's name and reserves no key.  ``on_insert`` sets constant
    columns of the new rows (timestamps)."""
    const = on_insert or {}
    checked = batch.withColumn("_broken", first_broken(rules))
    stored = present_keys(base, key, batch, key).select(F.col(key).alias("_bk"), F.lit(True).alias("_stored"))
    b = checked.join(stored, checked[key] == stored["_bk"], "left").drop("_bk")
    firsts = checked.filter(F.col("_broken").isNull()).groupBy(F.col(key).alias("_fk")) \
        .agg(F.min(order_col).alias("_first"))
    b = b.join(firsts, (b[key] == firsts["_fk"]) & (b[order_col] == firsts["_first"]), "left")
    reason = F.when(F.col("_broken").isNotNull(), F.col("_broken")) \
        .when(F.col("_stored").isNotNull(), REASON_CONFLICT) \
        .when(F.col("_first").isNull(), REASON_DUPLICATE_BATCH)
    b = b.withColumn("reason", reason).drop("_fk", "_first", "_stored", "_broken")
    done = number_accepted(b, F.col("reason").isNotNull(), order_col)
    ok = done.numbered("_new_id", next_id(base, id_col)).filter(F.col("reason").isNull())
    ins = ok.select(*[F.col("_new_id").cast(base.schema[c].dataType).alias(c) if c == id_col
                      else const.get(c, F.col(c) if c in batch.columns else F.lit(None)).cast(base.schema[c].dataType).alias(c)
                      for c in base.columns])
    rej = done.all_rows().filter(F.col("reason").isNotNull()).select(order_col, key, "reason")
    return WriteResult(base.unionByName(ins), rej, ins)


def update_rows(base: DataFrame, updates: DataFrame, cols: Sequence[str], id_col: str = "id",
                unique_key: str | None = None, on_update: dict[str, Column] | None = None,
                rules: dict[str, Column] | None = None) -> WriteResult:
    """Full-row update by id.  Absent ids are rejected; with
    ``unique_key``, an update whose key is held by another stored row, or
    that two updates set at once, is rejected (not applied).  An update that
    breaks one of the ``rules`` (over the update's columns) is rejected with
    the rule's name and stands in no other update's way."""
    on_update = on_update or {}
    u = updates.select(F.col(id_col).alias("_uid"), *[F.col(c).alias(f"_u_{c}") for c in cols],
                       first_broken(rules).alias("_broken"))
    u = materialize(u)
    ids = present_keys(base, id_col, u, "_uid").select(F.col(id_col).alias("_bid"))
    kept = u.filter(F.col("_broken").isNull())
    per_id = kept.groupBy(F.col("_uid").alias("_cid")).agg(F.count(F.lit(1)).alias("_cn"))
    u = u.join(ids, u["_uid"] == ids["_bid"], "left")
    u = u.join(per_id, u["_uid"] == per_id["_cid"], "left")
    reason = F.when(F.col("_broken").isNotNull(), F.col("_broken")) \
        .when(F.col("_bid").isNull(), F.lit(REASON_NOT_FOUND)).when(F.col("_cn") > 1, F.lit(REASON_DUPLICATE_ID))
    if unique_key is not None:
        owners = present_keys(base, unique_key, u, f"_u_{unique_key}") \
            .select(F.col(unique_key).alias("_ok"), F.col(id_col).alias("_owner"))
        u = u.join(owners, u[f"_u_{unique_key}"] == owners["_ok"], "left")
        dup = kept.groupBy(F.col(f"_u_{unique_key}").alias("_dk")).agg(F.count(F.lit(1)).alias("_dn"))
        u = u.join(dup, u[f"_u_{unique_key}"] == dup["_dk"], "left")
        reason = reason.when(F.col("_owner").isNotNull() & (F.col("_owner") != F.col("_uid")), REASON_CONFLICT) \
            .when(F.col("_dn") > 1, REASON_CONFLICT)
    u = materialize(u.withColumn("reason", reason))
    good = u.filter(F.col("reason").isNull()).select("_uid", *[f"_u_{c}" for c in cols], F.lit(True).alias("_hit"))
    j = base.join(bounded_broadcast(good), base[id_col] == good["_uid"], "left")
    hit = F.col("_hit").isNotNull()
    snap = j.select(*[
        F.when(hit, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in cols
        else F.when(hit, on_update[c]).otherwise(F.col(c)).alias(c) if c in on_update
        else F.col(c) for c in base.columns])
    rej = u.filter(F.col("reason").isNotNull()).select(F.col("_uid").alias(id_col), "reason")
    return WriteResult(snap, rej)


def insert_facts(fact: DataFrame, subject: DataFrame, catalog: DataFrame, batch: DataFrame,
                 order_col: str, as_of: str, spec: StarSpec = DEFAULT_SPEC,
                 rules: dict[str, Column] | None = None) -> WriteResult:
    """Insert facts after parent checks (subject first, then catalog);
    a missing date becomes ``as_of``; a blank action takes the catalog's
    recommended action; numbers continue the stored sequence in
    ``order_col`` order.  A row that breaks one of the ``rules`` is rejected
    with the rule's name, before the parent checks."""
    s = subject.select(F.col(spec.subject_key).alias("_sid"), F.lit(True).alias("_has_s"))
    c = bounded_broadcast(catalog.select(F.col(spec.catalog_key).alias("_cid"),
                                         F.col(spec.recommended_action).alias("_default_action")), within=catalog)
    batch = batch.withColumn("_broken", first_broken(rules))
    b = batch.join(s, batch[spec.fact_subject] == s["_sid"], "left") \
        .join(c, batch[spec.fact_catalog] == c["_cid"], "left")
    reason = F.when(F.col("_broken").isNotNull(), F.col("_broken")) \
        .when(F.col("_has_s").isNull(), MSG_PARENT_SUBJECT).when(F.col("_cid").isNull(), MSG_PARENT_CATALOG)
    done = number_accepted(b.withColumn("reason", reason), F.col("reason").isNotNull(), order_col)
    ok = done.numbered("_seq").filter(F.col("reason").isNull())
    base_no = fact.agg(F.coalesce(F.max(seq_suffix(spec.fact_no, spec.fact_prefix)), F.lit(0)).alias("_m")).scalar()
    first = next_id(fact, spec.fact_key)
    ins = ok.select(
        (first + F.col("_seq")).cast("bigint").alias(spec.fact_key),
        seq_format(base_no + F.col("_seq") + 1, spec.fact_no_format).alias(spec.fact_no),
        default_date(spec.fact_date, as_of).alias(spec.fact_date),
        F.col(spec.fact_subject).cast("bigint").alias(spec.fact_subject),
        F.col(spec.fact_catalog).cast("bigint").alias(spec.fact_catalog),
        backfill_blank(spec.action, F.col("_default_action")).alias(spec.action),
        F.coalesce(F.col(spec.fact_status), F.lit(spec.open_status)).alias(spec.fact_status),
        F.coalesce(F.col(spec.reporter), F.lit("")).alias(spec.reporter),
        F.coalesce(F.col(spec.notes), F.lit("")).alias(spec.notes),
    )
    rej = done.all_rows().filter(F.col("reason").isNotNull()).select(order_col, "reason")
    return WriteResult(fact.select(*ins.columns).unionByName(ins), rej, ins)


def update_facts(fact: DataFrame, subject: DataFrame, catalog: DataFrame, updates: DataFrame, as_of: str,
                 spec: StarSpec = DEFAULT_SPEC, rules: dict[str, Column] | None = None,
                 on_update: dict[str, Column] | None = None) -> WriteResult:
    """G7 for facts: full-row update by id.  Checks in order: the domain
    rules, the fact exists, its new subject exists, its new catalog item
    exists; a blank action takes the item's recommended action and a missing
    date becomes ``as_of``."""
    u = materialize(updates.withColumn("_broken", first_broken(rules)), name="request")
    ids = present_keys(fact, spec.fact_key, u, spec.fact_key).select(F.col(spec.fact_key).alias("_fid"))
    subj = present_keys(subject, spec.subject_key, u, spec.fact_subject).select(F.col(spec.subject_key).alias("_sid"))
    cat = bounded_broadcast(catalog.select(F.col(spec.catalog_key).alias("_cid"),
                                           F.col(spec.recommended_action).alias("_dflt")), within=catalog)
    j = u.join(ids, u[spec.fact_key] == ids["_fid"], "left")
    j = j.join(subj, j[spec.fact_subject] == subj["_sid"], "left")
    j = j.join(cat, j[spec.fact_catalog] == cat["_cid"], "left")
    reason = F.when(F.col("_broken").isNotNull(), F.col("_broken")) \
        .when(F.col("_fid").isNull(), REASON_NOT_FOUND) \
        .when(F.col("_sid").isNull(), MSG_PARENT_SUBJECT).when(F.col("_cid").isNull(), MSG_PARENT_CATALOG)
    j = materialize(j.withColumn("reason", reason), name="request")
    good = j.filter(F.col("reason").isNull()) \
        .withColumn(spec.action, backfill_blank(spec.action, F.col("_dflt"))) \
        .withColumn(spec.fact_date, default_date(spec.fact_date, as_of))
    cols = [spec.fact_date, spec.fact_subject, spec.fact_catalog, spec.action, spec.fact_status, spec.reporter, spec.notes]
    res = update_rows(fact, good.select(spec.fact_key, *cols), cols, spec.fact_key, on_update=on_update)
    rej = j.filter(F.col("reason").isNotNull()).select(spec.fact_key, "reason").unionByName(res.rejected)
    return WriteResult(res.snapshot, rej)


def ensure_column(df: DataFrame, name: str, default, dtype: str = "string") -> DataFrame:
    """Add ``name`` with ``default`` when absent; unchanged otherwise."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(dtype))
