"""Validated bulk intake (H1-H6) as set-based plans.

The row-at-a-time loop of a classic importer becomes: clean every cell
(F1), canonicalise domains (F3), compute one first-failing-rule error text
per row with a ``coalesce`` chain in the rule order, resolve keys with
case-insensitive lookup joins (C4), drop already-stored keys (C5), keep the
first row per key in file order (W1), and number accepted rows densely in
file order (W2).  Outcomes are one column, so counts come from one
aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions.scalars import (
    DATE_INVALID_MSG, DATE_REQUIRED_MSG, backfill_blank, canonical, clean_text, missing_labels, parse_date,
    seq_format, seq_suffix,
)
from starledger.operators.joins import bounded_broadcast
from starledger.operators.ordering import first_errors
from starledger.operators.ranged import materialize
from starledger.operators.windows import dense_sequence, number_accepted
from starledger.spec import (
    CATEGORIES, DEFAULT_SPEC, ERRORS_LISTED, FACT_STATUS_DEFAULT, FACT_STATUSES, MSG_CODE_NOT_FOUND,
    MSG_CODE_REQUIRED, MSG_FACT_STATUS, MSG_NUMBER_REQUIRED, MSG_SUBJECT_NOT_FOUND, MSG_SUBJECT_STATUS,
    POINTS_MAX, POINTS_MIN, SUBJECT_LABELS, SUBJECT_STATUS_DEFAULT, SUBJECT_STATUSES, StarSpec,
)

ROW = "row_number"
SUBJECT_STATUS_MSG = MSG_SUBJECT_STATUS
FACT_STATUS_MSG = MSG_FACT_STATUS


@dataclass
class IntakeResult:
    """Outcome of one intake: every staged row with its outcome, the rows to
    append, and helpers for the summary and the first errors."""

    outcomes: DataFrame   # row_number, outcome ('imported'|'skipped'|'error'), message
    accepted: DataFrame   # new table rows, in the target schema

    def summary(self) -> DataFrame:
        return import_summary(self.outcomes)

    def errors(self, n: int | None = ERRORS_LISTED) -> DataFrame:
        e = self.outcomes.filter(F.col("outcome") == "error").select(F.col(ROW).alias("row"), "message")
        return e if n is None else first_errors(e, n)


def _cell(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def import_summary(outcomes: DataFrame) -> DataFrame:
    """Imported, skipped, error_count, total_rows in one aggregation."""
    o = F.col("outcome")
    return outcomes.agg(
        F.sum(F.when(o == "imported", 1).otherwise(0)).cast("bigint").alias("imported"),
        F.sum(F.when(o == "skipped", 1).otherwise(0)).cast("bigint").alias("skipped"),
        F.sum(F.when(o == "error", 1).otherwise(0)).cast("bigint").alias("error_count"),
        F.count(F.lit(1)).alias("total_rows"),
    ).select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
               for c in ("imported", "skipped", "error_count", "total_rows")])


# --------------------------------------------------------------------------- subjects

def validate_subjects(staged: DataFrame) -> DataFrame:
    """H3: cleaned cells plus ``error`` (NULL when valid).  First failing
    rule wins: missing required values (all labels listed), then status."""
    cleaned = staged.select(
        F.col(ROW),
        *[clean_text(_cell(staged, c)).alias(c) for c in
          ("student_no", "first_name", "last_name", "grade", "section", "adviser")],
        canonical(_cell(staged, "status"), SUBJECT_STATUSES, SUBJECT_STATUS_DEFAULT).alias("status"),
    )
    missing = missing_labels([(F.col(c), lbl) for c, lbl in SUBJECT_LABELS])
    error = F.coalesce(missing, F.when(F.col("status").isNull(), F.lit(SUBJECT_STATUS_MSG)))
    return cleaned.withColumn("error", error)


def import_subjects(staged: DataFrame, stored: DataFrame, spec: StarSpec = DEFAULT_SPEC,
                    first_id: Column | int | None = None, checkpoint: bool = True) -> IntakeResult:
    """H4: validate -> skip keys already stored -> first row per key wins ->
    append.  Invalid rows never reserve a key; a stored key skips every
    staged row that carries it.  New ids continue after the stored maximum
    in file order."""
    v = materialize(validate_subjects(staged).withColumn("_key", F.lower(F.col("student_no"))), checkpoint)
    good, bad = v.filter(F.col("error").isNull()), v.filter(F.col("error").isNotNull())
    # One row for each number of the sheet: its first row, and whether it is
    # stored.  Only stored numbers that occur in the sheet are read back.
    keys = good.groupBy(F.col("_key").alias("_fk")).agg(F.min(ROW).alias("_first"))
    lower = F.lower(F.col(spec.subject_no))
    stored_keys = stored.select(lower.alias("_sk")).join(keys.select(F.col("_fk").alias("_pk")), F.col("_sk") == F.col("_pk"), "left_semi").distinct()
    keys = keys.join(stored_keys, keys["_fk"] == stored_keys["_sk"], "left_anti")
    good = good.join(keys, (good["_key"] == keys["_fk"]) & (good[ROW] == keys["_first"]), "left") \
        .withColumn("_is_first", F.col("_first").isNotNull()).drop("_fk", "_first")
    v = good.unionByName(bad.withColumn("_is_first", F.lit(False)))
    outcome = (F.when(F.col("error").isNotNull(), "error")
               .when(F.col("_is_first"), "imported")
               .otherwise("skipped"))
    done = number_accepted(v.withColumn("outcome", outcome), F.col("outcome") != "imported", ROW)
    outcomes = done.all_rows().select(ROW, "student_no", "outcome", F.col("error").alias("message"))
    if first_id is None:
        first_id = stored.agg((F.coalesce(F.max(spec.subject_key), F.lit(0)) + 1).alias("m")).scalar()
    acc = done.numbered("id", first_id).filter(F.col("outcome") == "imported")
    accepted = acc.select(F.col("id").cast("bigint").alias("id"), "student_no", "first_name", "last_name",
                          "grade", "section", "adviser", "status", ROW)
    return IntakeResult(outcomes, accepted)


# --------------------------------------------------------------------------- facts

def lookup_first(dim: DataFrame, key_col: str, id_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``lower(key)``: the lowest id wins (as a point query's first row).

    Output ``_lk`` and a struct ``_m`` of ``id`` and ``extra``.  The grouping
    is a fixed-width ``min(id)`` (hash aggregation with map-side combine);
    extra columns are joined back on the unique id.
    """
    firsts = dim.groupBy(F.lower(F.col(key_col)).alias("_lk")).agg(F.min(id_col).alias("_fid"))
    if not extra:
        return firsts.select("_lk", F.struct(F.col("_fid").alias("id")).alias("_m"))
    cols = dim.select(F.col(id_col).alias("_did"), *[F.col(c) for c in extra])
    j = firsts.join(cols, firsts["_fid"] == cols["_did"], "inner")
    return j.select("_lk", F.struct(F.col("_fid").alias("id"), *[F.col(c) for c in extra]).alias("_m"))


def validate_facts(staged: DataFrame, subject: DataFrame, catalog: DataFrame,
                   spec: StarSpec = DEFAULT_SPEC, checkpoint: bool = True) -> DataFrame:
    """H5: lookups (C4) then the rule order: number blank, code blank,
    subject unknown, code unknown, bad status, date missing or unparsable."""
    s = staged.select(
        F.col(ROW),
        clean_text(_cell(staged, "student_no")).alias("student_no"),
        clean_text(_cell(staged, "offense_code")).alias("offense_code"),
        canonical(_cell(staged, "status"), FACT_STATUSES, FACT_STATUS_DEFAULT).alias("status"),
        clean_text(_cell(staged, "incident_date")).alias("_date_text"),
        clean_text(_cell(staged, "action_taken")).alias("_action"),
        clean_text(_cell(staged, "reported_by")).alias("reported_by"),
        clean_text(_cell(staged, "notes")).alias("notes"),
    )
    # The cleaned sheet is written once; probe, lookups and rules read it.
    s = materialize(s.withColumn("incident_date", parse_date("_date_text", cleaned=True)), checkpoint)
    # Rows with a blank number or code are errors already and enter no join.
    named = (F.col("student_no") != "") & (F.col("offense_code") != "")
    rows, blank = s.filter(named), s.filter(~named)
    # Resolve only the subject numbers the sheet names.
    sheet_keys = rows.select(F.lower(F.col("student_no")).alias("_pk")).distinct()
    meant = subject.join(sheet_keys, F.lower(subject[spec.subject_no]) == sheet_keys["_pk"], "left_semi")
    subj = lookup_first(meant, spec.subject_no, spec.subject_key) \
        .select(F.col("_lk").alias("_sk"), F.col("_m.id").alias("student_id"))
    cat = lookup_first(catalog, spec.code, spec.catalog_key, (spec.recommended_action,)) \
        .select(F.col("_lk").alias("_ck"), F.col("_m.id").alias("offense_id"),
                F.col(f"_m.{spec.recommended_action}").alias("_default_action"))
    cat = bounded_broadcast(cat, within=catalog)
    j = rows.join(subj, F.lower(rows["student_no"]) == subj["_sk"], "left").drop("_sk")
    j = j.join(cat, F.lower(j["offense_code"]) == cat["_ck"], "left").drop("_ck")
    j = j.unionByName(blank, allowMissingColumns=True)
    error = F.coalesce(
        F.when(F.col("student_no") == "", F.lit(MSG_NUMBER_REQUIRED)),
        F.when(F.col("offense_code") == "", F.lit(MSG_CODE_REQUIRED)),
        F.when(F.col("student_id").isNull(),
               F.format_string(MSG_SUBJECT_NOT_FOUND, F.col("student_no"))),
        F.when(F.col("offense_id").isNull(),
               F.format_string(MSG_CODE_NOT_FOUND, F.col("offense_code"))),
        F.when(F.col("status").isNull(), F.lit(FACT_STATUS_MSG)),
        F.when(F.col("_date_text") == "", F.lit(DATE_REQUIRED_MSG)),
        F.when(F.col("incident_date").isNull(), F.lit(DATE_INVALID_MSG)),
    )
    return j.withColumn("error", error)


def import_facts(staged: DataFrame, subject: DataFrame, catalog: DataFrame, existing: DataFrame | None,
                 spec: StarSpec = DEFAULT_SPEC, checkpoint: bool = True,
                 base_no: Column | int | None = None, base_id: Column | int | None = None) -> IntakeResult:
    """H6: validate -> default action from the catalog -> sequential numbers
    in file order after the largest stored number -> append.  Nothing is
    skipped by this intake.  The validated rows are written once, in file
    order: outcome counts, errors and numbers all read them."""
    v = validate_facts(staged, subject, catalog, spec, checkpoint)
    v = v.withColumn("outcome", F.when(F.col("error").isNull(), "imported").otherwise("error"))
    done = number_accepted(v, F.col("outcome") != "imported", ROW)
    outcomes = done.all_rows().select(ROW, "student_no", "outcome", F.col("error").alias("message"))
    # Largest stored number and id: given by the caller (e.g. a stream's
    # high-water mark) or read from the stored facts.
    if base_no is None:
        base_no = existing.agg(F.coalesce(F.max(seq_suffix(spec.fact_no, spec.fact_prefix)), F.lit(0))
                               .alias("m")).scalar()
    if base_id is None:
        base_id = existing.agg(F.coalesce(F.max(spec.fact_key), F.lit(0)).alias("m")).scalar()
    base_no = base_no if isinstance(base_no, Column) else F.lit(base_no)
    base_id = base_id if isinstance(base_id, Column) else F.lit(base_id)
    acc = done.numbered("_seq", 1).filter(F.col("outcome") == "imported")
    accepted = acc.select(
        (base_id + F.col("_seq")).cast("bigint").alias("id"),
        seq_format(base_no + F.col("_seq"), spec.fact_no_format).alias("incident_no"),
        "incident_date",
        F.col("student_id").cast("bigint").alias("student_id"),
        F.col("offense_id").cast("bigint").alias("offense_id"),
        backfill_blank("_action", F.col("_default_action")).alias("action_taken"),
        "status", "reported_by", "notes", ROW,
    )
    return IntakeResult(outcomes, accepted)


def allocate_seq(df: DataFrame, order_col: str, base: Column | int, fmt: str = "INC-%05d",
                 out: str = "incident_no") -> DataFrame:
    """W2 + F11: formatted numbers ``base, base+1, ...`` in ``order_col`` order."""
    d = dense_sequence(df, order_col, "_seq", start=0)
    return d.withColumn(out, seq_format(F.col("_seq") + base, fmt)).drop("_seq")


# --------------------------------------------------------------------------- H1 / H2

def domain_audit(df: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """H1: one row per (key, rule) violation.  ``rules`` maps a rule name to a
    Column that is true when the row *breaks* the rule."""
    arr = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()]))
    return df.select(F.col(key), F.explode(arr).alias("rule"))


def catalog_rules(spec: StarSpec = DEFAULT_SPEC) -> dict[str, Column]:
    """Domain rules of a catalog row (min length, value set, 1..10 range)."""
    return {
        "code_required": F.length(F.col(spec.code)) < 1,
        "name_required": F.length(F.col(spec.catalog_name)) < 1,
        "category_domain": ~F.col(spec.category).isin(*CATEGORIES),
        "points_range": ~F.col(spec.points).between(POINTS_MIN, POINTS_MAX),
    }


def fact_rules(spec: StarSpec = DEFAULT_SPEC) -> dict[str, Column]:
    """Domain rule of a fact row; a missing status counts as the default."""
    status = F.coalesce(F.col(spec.fact_status), F.lit(spec.open_status))
    return {"status_domain": ~status.isin(*FACT_STATUSES.values())}


def subject_rules(spec: StarSpec = DEFAULT_SPEC) -> dict[str, Column]:
    rules = {f"{c}_required": F.length(F.col(c)) < 1 for c in
             (spec.subject_no, spec.first_name, spec.last_name, spec.grade, spec.section)}
    rules["status_domain"] = ~F.col(spec.subject_status).isin(*SUBJECT_STATUSES.values())
    return rules


def unique_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """H2: key values held by more than one row, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def null_audit(df: DataFrame, cols: list[str], key: str = "id") -> DataFrame:
    """H2: rows with NULL in a NOT NULL column."""
    return domain_audit(df, {f"{c}_not_null": F.col(c).isNull() for c in cols}, key)
