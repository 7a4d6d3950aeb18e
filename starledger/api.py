"""One object per star with the operations a record-keeping service offers.

``Ledger`` bundles a subject, catalog and fact frame (and a ``StarSpec``)
and exposes the request surface -- listings, reports, imports, creates,
updates, deletes, catalog sync -- as methods returning lazy DataFrames or
result objects whose frames are snapshots to write.  Nothing here collects
rows; the methods only compose the operators.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.functions.predicates import any_contains
from starledger.operators import aggregates as agg
from starledger.operators import intake, maintenance as mt
from starledger.operators.filters import project_public, subject_by_id, subject_by_no
from starledger.operators.intake import catalog_rules, fact_rules, subject_rules
from starledger.operators.ordering import catalog_order, list_subjects
from starledger.plans import reports
from starledger.plans.listings import incident_listing
from starledger.sources.catalog import LEGACY_CODE_MAP, OFFICIAL_CATALOG, code_map_frame
from starledger.sources.sheets import read_sheet, require_columns, stage_rows
from starledger.spec import DEFAULT_SPEC, FACT_REQUIRED, LIST_LIMIT_DEFAULT, SUBJECT_REQUIRED, StarSpec


# Fixed value: prefix given to rows under a retired code during a catalog sync.
LEGACY_PREFIX = "LEGACY-"


@dataclass(frozen=True)
class Ledger:
    subject: DataFrame
    catalog: DataFrame
    fact: DataFrame
    spec: StarSpec = DEFAULT_SPEC

    def with_tables(self, **tables: DataFrame) -> "Ledger":
        """A new ledger over updated snapshots (e.g. after an import)."""
        return replace(self, **tables)

    # ----------------------------------------------------------- subjects
    def list_subjects(self, search: str = "", grade: str = "", section: str = "", status: str = "",
                      limit: int | None = LIST_LIMIT_DEFAULT) -> DataFrame:
        s, df = self.spec, self.subject
        if search:
            df = df.filter(any_contains([s.subject_no, s.first_name, s.last_name], search))
        for col, val in ((s.grade, grade), (s.section, section), (s.subject_status, status)):
            if val:
                df = df.filter(F.col(col) == val)
        return list_subjects(project_public(df), s, limit)

    def create_subjects(self, batch: DataFrame, order_col: str) -> mt.WriteResult:
        """Domain rules first, then the unique number; see ``insert_new``."""
        s = self.spec
        return mt.insert_new(self.subject, batch, s.subject_no, order_col, s.subject_key, rules=subject_rules(s))

    def update_subjects(self, updates: DataFrame) -> mt.WriteResult:
        s = self.spec
        cols = [s.subject_no, s.first_name, s.last_name, s.grade, s.section, s.adviser, s.subject_status]
        return mt.update_rows(self.subject, updates, cols, s.subject_key, unique_key=s.subject_no,
                              rules=subject_rules(s))

    def delete_subjects(self, keys: DataFrame, on_missing: str = "reject") -> mt.DeleteResult:
        s = self.spec
        return mt.guarded_delete(self.subject, self.fact, keys, s.subject_key, s.fact_subject,
                                 [s.subject_no, s.first_name, s.last_name], on_missing)

    def import_subjects(self, sheet: DataFrame | str, fmt: str = "csv") -> intake.IntakeResult:
        staged = read_sheet(self.subject.sparkSession, sheet, fmt) if isinstance(sheet, str) else stage_rows(sheet)
        require_columns(staged, SUBJECT_REQUIRED)
        return intake.import_subjects(staged, self.subject, self.spec)

    def subject_record(self, subject_no: str | None = None, key: int | None = None) -> dict[str, DataFrame]:
        """Profile, all-time totals and history of one Active subject, by
        number (ignoring case) or by id (empty frames when the subject is
        unknown or inactive)."""
        s = self.spec
        one = subject_by_id(self.subject, key, s) if key is not None else subject_by_no(self.subject, subject_no, s)
        prof = one.filter(F.col(s.subject_status) == s.active_status)
        keys = prof.select(F.col(s.subject_key).alias("_k"))
        facts = self.fact.join(keys, self.fact[s.fact_subject] == keys["_k"], "left_semi")
        return {
            "subject": project_public(prof),
            "totals": agg.subject_totals(prof, facts, self.catalog, s),
            "history": reports.history_order(reports.record_history(prof, facts, self.catalog, s)),
        }

    # ----------------------------------------------------------- catalog
    def list_catalog(self, category: str = "", active_only: bool = False) -> DataFrame:
        s, df = self.spec, self.catalog
        if category:
            df = df.filter(F.col(s.category) == category)
        if active_only:
            df = df.filter(F.col(s.active))
        return catalog_order(df, s)

    def create_catalog_items(self, batch: DataFrame, order_col: str) -> mt.WriteResult:
        s = self.spec
        return mt.insert_new(self.catalog, batch, s.code, order_col, s.catalog_key, rules=catalog_rules(s))

    def update_catalog_items(self, updates: DataFrame) -> mt.WriteResult:
        s = self.spec
        cols = [s.code, s.catalog_name, s.category, s.points, s.recommended_action, s.active]
        return mt.update_rows(self.catalog, updates, cols, s.catalog_key, unique_key=s.code, rules=catalog_rules(s))

    def delete_catalog_items(self, keys: DataFrame, on_missing: str = "reject") -> mt.DeleteResult:
        s = self.spec
        return mt.guarded_delete(self.catalog, self.fact, keys, s.catalog_key, s.fact_catalog,
                                 [s.code, s.catalog_name], on_missing)

    def sync_catalog(self, rows=OFFICIAL_CATALOG, legacy: dict[str, str] = LEGACY_CODE_MAP,
                     remap_legacy: bool = True) -> "Ledger":
        """Catalog sync in three steps: rows under a retired code are renamed
        ``LEGACY-<code>`` (a retired code may also be a current official
        code); the official rows are upserted (active, texts overwritten,
        missing codes inserted); facts on each ``LEGACY-`` row move to its
        replacement in one simultaneous remap and the ``LEGACY-`` rows are
        dropped.  Pairs with a side missing are skipped.

        The legacy move is a one-time migration (``remap_legacy=True`` once);
        later syncs pass ``remap_legacy=False`` and are idempotent -- otherwise
        facts recorded on a retired code that is also an official code would
        move again on every sync.
        """
        s, spark = self.spec, self.catalog.sparkSession
        retired = list(legacy) if remap_legacy else []
        renamed = self.catalog.withColumn(
            s.code, F.when(F.col(s.code).isin(retired), F.concat(F.lit(LEGACY_PREFIX), F.col(s.code)))
            .otherwise(F.col(s.code)))
        data = [(code, name, cat, int(pts), act, i) for i, (code, name, cat, pts, act) in enumerate(rows)]
        upd = spark.createDataFrame(data, f"{s.code} string, {s.catalog_name} string, {s.category} string, "
                                          f"{s.points} int, {s.recommended_action} string, _ord long")
        cat = mt.upsert(renamed, upd, s.code, [s.catalog_name, s.category, s.points, s.recommended_action],
                        "_ord", on_update={s.active: F.lit(True)}, id_col=s.catalog_key)
        if not remap_legacy:
            return self.with_tables(catalog=cat)
        mapping = code_map_frame(spark, {LEGACY_PREFIX + k: v for k, v in legacy.items()})
        rm = mt.remap_keys(self.fact, cat, mapping, s)
        return self.with_tables(catalog=rm.catalog, fact=rm.fact)

    # ----------------------------------------------------------- facts
    def list_facts(self, search: str = "", month: str = "", category: str = "", status: str = "",
                   limit: int | None = LIST_LIMIT_DEFAULT) -> DataFrame:
        return incident_listing(self.fact, self.subject, self.catalog, self.spec, search, month, category,
                                status, limit)

    def next_fact_no(self) -> DataFrame:
        return agg.next_seq(self.fact, self.spec.fact_no, self.spec.fact_prefix)

    def create_facts(self, batch: DataFrame, order_col: str, as_of: str) -> mt.WriteResult:
        return mt.insert_facts(self.fact, self.subject, self.catalog, batch, order_col, as_of, self.spec,
                               rules=fact_rules(self.spec))

    def update_facts(self, updates: DataFrame, as_of: str) -> mt.WriteResult:
        """Full-row update by id; see ``maintenance.update_facts``."""
        return mt.update_facts(self.fact, self.subject, self.catalog, updates, as_of, self.spec, fact_rules(self.spec))

    def delete_facts(self, keys: DataFrame, on_missing: str = "reject") -> mt.DeleteResult:
        return mt.delete_keys(self.fact, keys, self.spec.fact_key, on_missing)

    def import_facts(self, sheet: DataFrame | str, fmt: str = "csv") -> intake.IntakeResult:
        staged = read_sheet(self.fact.sparkSession, sheet, fmt) if isinstance(sheet, str) else stage_rows(sheet)
        require_columns(staged, FACT_REQUIRED)
        return intake.import_facts(staged, self.subject, self.catalog, self.fact, self.spec)

    # ----------------------------------------------------------- reports
    def dashboard(self, year: int) -> dict[str, DataFrame]:
        return reports.dashboard(self.subject, self.fact, self.catalog, self.spec, year)

    def dashboard_document(self, year: int) -> DataFrame:
        return reports.dashboard_bundle(self.dashboard(year), year)

    def subject_summary(self, year: int, ordered: bool = True) -> DataFrame:
        out = agg.subject_summary(self.subject, self.fact, self.catalog, self.spec, year)
        return agg.summary_order(out) if ordered else out
