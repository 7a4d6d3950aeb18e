"""Registered intake queries: staging, cleaning, validation, imports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from starledger.functions import scalars as sc
from starledger.operators import intake
from starledger.operators.joins import lookup_ci
from starledger.plans import fixtures as fx
from starledger.plans.registry import register
from starledger.sources.sheets import stage_rows
from starledger.sources.tables import read_table
from starledger.spec import SUBJECT_STATUSES

M1 = fx.orders_star_cte()


def CLEAN(x: str) -> str:
    return f"COALESCE(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"


SUBJECT_CELLS = ("student_no", "first_name", "last_name", "grade", "section", "adviser", "status")
FACT_CELLS = ("incident_date", "student_no", "offense_code", "action_taken", "status", "reported_by", "notes")


def _non_blank(cells) -> str:
    return "GREATEST(" + ", ".join(f"length({CLEAN(c)})" for c in cells) + ") > 0"


SUBJECT_STATUS_SQL = ("CASE lower(" + CLEAN("CASE WHEN status IS NULL OR status = '' THEN 'Active' ELSE status END")
                      + ") WHEN 'active' THEN 'Active' WHEN 'inactive' THEN 'Inactive' END")
FACT_STATUS_SQL = ("CASE lower(" + CLEAN("CASE WHEN status IS NULL OR status = '' THEN 'Open' ELSE status END")
                   + ") WHEN 'open' THEN 'Open' WHEN 'parent notified' THEN 'Parent Notified' "
                   "WHEN 'under review' THEN 'Under Review' WHEN 'resolved' THEN 'Resolved' END")


def PARSE(t: str) -> str:
    guards = [
        ("(1[0-2]|0?[1-9])/(3[01]|[12]\\d|0?[1-9])/\\d{4}", "%m/%d/%Y"),
        ("(3[01]|[12]\\d|0?[1-9])/(1[0-2]|0?[1-9])/\\d{4}", "%d/%m/%Y"),
        ("(1[0-2]|0?[1-9])-(3[01]|[12]\\d|0?[1-9])-\\d{4}", "%m-%d-%Y"),
        ("(3[01]|[12]\\d|0?[1-9])-(1[0-2]|0?[1-9])-\\d{4}", "%d-%m-%Y"),
    ]
    v = f"TRY_CAST({t} AS DOUBLE)"
    parts = [
        f"CASE WHEN regexp_full_match({t}, '\\d+(\\.\\d+)?') AND NOT regexp_full_match({t}, '\\d{{8}}') "
        f"THEN DATE '1899-12-30' + CAST(floor({v}) AS INTEGER) + CASE WHEN {v} > 0 AND {v} < 60 THEN 1 ELSE 0 END END",
        f"CASE WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(try_strptime({t}, '%Y-%m-%d') AS DATE) END",
        f"CASE WHEN regexp_full_match({t}, '\\d{{8}}') THEN CAST(try_strptime({t}, '%Y%m%d') AS DATE) END",
    ] + [f"CASE WHEN regexp_full_match({t}, '{g}') THEN CAST(try_strptime({t}, '{p}') AS DATE) END" for g, p in guards]
    return "COALESCE(" + ", ".join(parts) + ")"


SUBJECT_FLOW = f"""{M1},
stored AS (SELECT * FROM subj),
st AS ({fx.STAGED_SUBJECTS_SQL}),
nb AS (SELECT * FROM st WHERE {_non_blank(SUBJECT_CELLS)}),
cl AS (SELECT row_number, {", ".join(f"{CLEAN(c)} AS {c}" for c in SUBJECT_CELLS[:-1])},
              {SUBJECT_STATUS_SQL} AS status FROM nb),
v AS (SELECT *, CASE WHEN miss <> '' THEN 'Missing ' || miss
                     WHEN status IS NULL THEN 'Status must be Active or Inactive' END AS error
      FROM (SELECT *, concat_ws(', ', CASE WHEN student_no = '' THEN 'Student No.' END,
                 CASE WHEN first_name = '' THEN 'First Name' END, CASE WHEN last_name = '' THEN 'Last Name' END,
                 CASE WHEN grade = '' THEN 'Grade' END, CASE WHEN section = '' THEN 'Section' END) AS miss FROM cl) x),
k AS (SELECT v.*, lower(student_no) AS key,
             lower(student_no) IN (SELECT lower(student_no) FROM stored) AS is_stored FROM v),
f AS (SELECT key, MIN(row_number) AS first_row FROM k WHERE error IS NULL AND NOT is_stored GROUP BY key),
o AS (SELECT k.*, CASE WHEN k.error IS NOT NULL THEN 'error' WHEN f.first_row IS NOT NULL THEN 'imported'
                       ELSE 'skipped' END AS outcome
      FROM k LEFT JOIN f ON f.key = k.key AND f.first_row = k.row_number)"""

FACT_FLOW = f"""{M1},
st AS ({fx.STAGED_FACTS_SQL}),
nb AS (SELECT * FROM st WHERE {_non_blank(FACT_CELLS)}),
cl AS (SELECT row_number, {CLEAN("student_no")} AS student_no, {CLEAN("offense_code")} AS offense_code,
              {FACT_STATUS_SQL} AS status, {CLEAN("incident_date")} AS dt, {CLEAN("action_taken")} AS act,
              {CLEAN("reported_by")} AS reported_by, {CLEAN("notes")} AS notes FROM nb),
sk AS (SELECT lower(student_no) AS k, MIN(id) AS student_id FROM subj GROUP BY 1),
ck AS (SELECT lower(code) AS k, MIN(id) AS offense_id, arg_min(recommended_action, id) AS default_action
       FROM cat GROUP BY 1),
p AS (SELECT cl.*, sk.student_id, ck.offense_id, ck.default_action, {PARSE("cl.dt")} AS incident_date
      FROM cl LEFT JOIN sk ON sk.k = lower(cl.student_no) LEFT JOIN ck ON ck.k = lower(cl.offense_code)),
v AS (SELECT *, CASE WHEN student_no = '' THEN 'Student No. is required'
                     WHEN offense_code = '' THEN 'Offense Code is required'
                     WHEN student_id IS NULL THEN 'Student ' || student_no || ' was not found'
                     WHEN offense_id IS NULL THEN 'Offense code ' || offense_code || ' was not found'
                     WHEN status IS NULL THEN 'Status must be Open, Parent Notified, Under Review, or Resolved'
                     WHEN dt = '' THEN 'Incident Date is required'
                     WHEN incident_date IS NULL THEN 'Incident Date must use YYYY-MM-DD or a recognized Excel date'
                END AS error FROM p)"""

NEXT_NO_SQL = ("(SELECT COALESCE(MAX(CASE WHEN upper(substr(incident_no, 1, 4)) = 'INC-' THEN "
               "COALESCE(TRY_CAST(regexp_extract(substr(incident_no, 5), '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) END), 0) FROM fact)")

SUMMARY_COLS = """CAST(COALESCE(SUM(CASE WHEN outcome = 'imported' THEN 1 ELSE 0 END), 0) AS BIGINT) AS imported,
       CAST(COALESCE(SUM(CASE WHEN outcome = 'skipped' THEN 1 ELSE 0 END), 0) AS BIGINT) AS skipped,
       CAST(COALESCE(SUM(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END), 0) AS BIGINT) AS error_count,
       COUNT(*) AS total_rows"""


def _subject_import(spark, sf_dir):
    staged = stage_rows(fx.staged_subject_sheet(spark, sf_dir))
    return intake.import_subjects(staged, fx.customer_subjects(spark, sf_dir))


def _fact_import(spark, sf_dir):
    st = fx.orders_star(spark, sf_dir)
    staged = stage_rows(fx.staged_fact_sheet(spark, sf_dir))
    return intake.import_facts(staged, st.subject, st.catalog, st.fact)


@register("stage_rows", f"""{M1}, st AS ({fx.STAGED_SUBJECTS_SQL})
SELECT * FROM st WHERE {_non_blank(SUBJECT_CELLS)}""")
def q_stage_rows(spark, sf_dir):
    return stage_rows(fx.staged_subject_sheet(spark, sf_dir))


@register("import_subjects", f"""{SUBJECT_FLOW}
SELECT CAST((SELECT COALESCE(MAX(id), 0) FROM stored) + ROW_NUMBER() OVER (ORDER BY row_number) AS BIGINT) AS id,
       student_no, first_name, last_name, grade, section, adviser, status, row_number
FROM o WHERE outcome = 'imported'""")
def q_import_subjects(spark, sf_dir):
    return _subject_import(spark, sf_dir).accepted


@register("import_summary", f"{SUBJECT_FLOW} SELECT {SUMMARY_COLS} FROM o")
def q_import_summary(spark, sf_dir):
    return _subject_import(spark, sf_dir).summary()


@register("import_errors", f"""{SUBJECT_FLOW}
SELECT row_number AS "row", error AS message FROM o WHERE outcome = 'error' ORDER BY row_number LIMIT 10""")
def q_import_errors(spark, sf_dir):
    return _subject_import(spark, sf_dir).errors()


@register("import_outcomes", f"""{SUBJECT_FLOW}
SELECT row_number, student_no, outcome, error AS message FROM o""")
def q_import_outcomes(spark, sf_dir):
    return _subject_import(spark, sf_dir).outcomes


@register("import_facts", f"""{FACT_FLOW},
acc AS (SELECT *, ROW_NUMBER() OVER (ORDER BY row_number) AS seq FROM v WHERE error IS NULL)
SELECT CAST((SELECT COALESCE(MAX(id), 0) FROM fact) + seq AS BIGINT) AS id,
       printf('INC-%05d', {NEXT_NO_SQL} + seq) AS incident_no, incident_date,
       CAST(student_id AS BIGINT) AS student_id, CAST(offense_id AS BIGINT) AS offense_id,
       CASE WHEN act IS NULL OR act = '' THEN default_action ELSE act END AS action_taken,
       status, reported_by, notes, row_number
FROM acc""")
def q_import_facts(spark, sf_dir):
    return _fact_import(spark, sf_dir).accepted


@register("import_fact_errors", f"""{FACT_FLOW}
SELECT row_number AS "row", error AS message FROM v WHERE error IS NOT NULL""")
def q_import_fact_errors(spark, sf_dir):
    return _fact_import(spark, sf_dir).errors(n=None)


@register("import_fact_summary", f"""{FACT_FLOW}, o AS (SELECT CASE WHEN error IS NULL THEN 'imported' ELSE 'error' END AS outcome FROM v)
SELECT {SUMMARY_COLS} FROM o""")
def q_import_fact_summary(spark, sf_dir):
    return _fact_import(spark, sf_dir).summary()


@register("allocate_seq", f"""{FACT_FLOW}
SELECT row_number, printf('INC-%05d', {NEXT_NO_SQL} + ROW_NUMBER() OVER (ORDER BY row_number)) AS incident_no
FROM v WHERE error IS NULL""")
def q_allocate_seq(spark, sf_dir):
    st = fx.orders_star(spark, sf_dir)
    v = intake.validate_facts(stage_rows(fx.staged_fact_sheet(spark, sf_dir)), st.subject, st.catalog)
    base = st.fact.agg((F.coalesce(F.max(sc.seq_suffix("incident_no")), F.lit(0)) + 1).alias("b")).scalar()
    return intake.allocate_seq(v.filter(F.col("error").isNull()).select("row_number"), "row_number", base)


@register("lookup_ci", f"""{M1}, st AS ({fx.STAGED_FACTS_SQL}),
sk AS (SELECT lower(student_no) AS k, MIN(id) AS student_id FROM subj GROUP BY 1)
SELECT st.row_number, {CLEAN("st.student_no")} AS student_no, sk.student_id
FROM st LEFT JOIN sk ON sk.k = lower({CLEAN("st.student_no")})""")
def q_lookup_ci(spark, sf_dir):
    st = fx.staged_fact_sheet(spark, sf_dir).select("row_number", sc.clean_text("student_no").alias("student_no"))
    subj = fx.customer_subjects(spark, sf_dir)
    return lookup_ci(st, "student_no", subj, "student_no", ["id"], "_") \
        .select("row_number", "student_no", F.col("_id").alias("student_id"))


@register("canonical_status", f"""{M1}, st AS ({fx.STAGED_SUBJECTS_SQL})
SELECT row_number, status AS status_raw, {SUBJECT_STATUS_SQL} AS status_value FROM st""")
def q_canonical_status(spark, sf_dir):
    st = fx.staged_subject_sheet(spark, sf_dir)
    return st.select("row_number", F.col("status").alias("status_raw"),
                     sc.canonical("status", SUBJECT_STATUSES, "Active").alias("status_value"))


@register("parse_dates", f"""{M1}, st AS ({fx.STAGED_FACTS_SQL})
SELECT row_number, incident_date AS date_text, {PARSE(CLEAN("incident_date"))} AS parsed_date,
       CASE WHEN {CLEAN("incident_date")} = '' THEN 'Incident Date is required'
            WHEN {PARSE(CLEAN("incident_date"))} IS NULL THEN 'Incident Date must use YYYY-MM-DD or a recognized Excel date'
       END AS date_error FROM st""")
def q_parse_dates(spark, sf_dir):
    st = fx.staged_fact_sheet(spark, sf_dir)
    return st.select("row_number", F.col("incident_date").alias("date_text"),
                     sc.parse_date("incident_date").alias("parsed_date"),
                     sc.date_error("incident_date").alias("date_error"))


@register("clean_text", f"""SELECT c_custkey AS id,
       {CLEAN("CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END")} AS balance_text,
       {CLEAN("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '  ' || c_name || chr(9) END")} AS name_text,
       {CLEAN("CASE WHEN CAST(c_custkey % 10 AS DOUBLE) = floor(CAST(c_custkey % 10 AS DOUBLE)) THEN CAST(c_custkey % 10 AS VARCHAR) ELSE CAST(CAST(c_custkey % 10 AS DOUBLE) AS VARCHAR) END")} AS digit_text
FROM customer""")
def q_clean_text(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    padded = F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit("\t")))
    return c.select(k.alias("id"),
                    sc.clean_text("c_acctbal", T.DoubleType()).alias("balance_text"),
                    sc.clean_text(padded).alias("name_text"),
                    sc.clean_text((k % 10).cast("double"), T.DoubleType()).alias("digit_text"))


@register("normalize_headers", """SELECT p_partkey AS id, p_name AS header_text,
       trim(regexp_replace(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') AS header
FROM part""")
def q_normalize_headers(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("header_text"),
                    sc.slug_col(F.concat_ws(" ", "p_name", "p_type")).alias("header"))


@register("num_prefix", """SELECT c_custkey AS id,
       COALESCE(TRY_CAST(regexp_extract(CAST(c_nationkey AS VARCHAR) || c_mktsegment, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS n_mixed,
       COALESCE(TRY_CAST(regexp_extract(c_mktsegment, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS n_text,
       COALESCE(TRY_CAST(regexp_extract(' -' || CAST(c_nationkey AS VARCHAR) || '.5', '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS n_signed
FROM customer""")
def q_num_prefix(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    nk = F.col("c_nationkey").cast("string")
    return c.select(F.col("c_custkey").alias("id"),
                    sc.num_prefix(F.concat(nk, F.col("c_mktsegment"))).alias("n_mixed"),
                    sc.num_prefix("c_mktsegment").alias("n_text"),
                    sc.num_prefix(F.concat(F.lit(" -"), nk, F.lit(".5"))).alias("n_signed"))


AS_OF = "2001-12-31"


@register("backfill_action", f"""{M1}
SELECT i.id, CASE WHEN i.action_taken IS NULL OR i.action_taken = '' THEN o.recommended_action ELSE i.action_taken END AS action_taken,
       COALESCE(i.incident_date, DATE '{AS_OF}') AS incident_date
FROM fact i JOIN cat o ON o.id = i.offense_id""")
def q_backfill_action(spark, sf_dir):
    from starledger.operators.joins import with_catalog
    st = fx.orders_star(spark, sf_dir)
    f = with_catalog(st.fact, st.catalog, cols=("recommended_action",))
    return f.select("id", sc.backfill_blank("action_taken", F.col("recommended_action")).alias("action_taken"),
                    sc.default_date("incident_date", AS_OF).alias("incident_date"))


@register("domain_audit", f"""{M1}, st AS ({fx.STAGED_SUBJECTS_SQL}),
cl AS (SELECT row_number, {", ".join(f"{CLEAN(c)} AS {c}" for c in SUBJECT_CELLS)} FROM st),
r AS (SELECT row_number, 'student_no_required' AS rule FROM cl WHERE length(student_no) < 1
      UNION ALL SELECT row_number, 'first_name_required' FROM cl WHERE length(first_name) < 1
      UNION ALL SELECT row_number, 'last_name_required' FROM cl WHERE length(last_name) < 1
      UNION ALL SELECT row_number, 'grade_required' FROM cl WHERE length(grade) < 1
      UNION ALL SELECT row_number, 'section_required' FROM cl WHERE length(section) < 1
      UNION ALL SELECT row_number, 'status_domain' FROM cl WHERE status NOT IN ('Active', 'Inactive'))
SELECT * FROM r""")
def q_domain_audit(spark, sf_dir):
    st = fx.staged_subject_sheet(spark, sf_dir)
    cl = st.select("row_number", *[sc.clean_text(c).alias(c) for c in SUBJECT_CELLS])
    return intake.domain_audit(cl, intake.subject_rules(), key="row_number")


@register("unique_audit", """SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def q_unique_audit(spark, sf_dir):
    return intake.unique_audit(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# A sheet as real text in several files: quoted separators, quotes and line ends, blank rows.
def _text_sheet(spark, sf_dir):
    from starledger.session import scratch_path
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cells = {"Student No.": F.format_string("O-%d", k), "First Name": F.when(k % 5 == 0, F.concat(F.lit("Clerk, "), "o_orderpriority")).otherwise(F.col("o_orderpriority")),
             "Notes": F.when(k % 3 == 0, F.format_string('line one of %d\nline "two"\n\n', k)).when(k % 3 == 1, "plain").otherwise("")}
    rows = o.select(k.alias("_k"), *[F.when(k % 7 != 0, c).alias(name) for name, c in cells.items()])
    path = scratch_path(spark, "text-sheet")
    rows.repartitionByRange(6, "_k").sortWithinPartitions("_k").drop("_k").write.option("header", True).option("quoteAll", True) \
        .option("escape", '"').option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@register("read_sheet", """SELECT ROW_NUMBER() OVER (ORDER BY o_orderkey) AS place, 'O-' || o_orderkey AS student_no,
       CASE WHEN o_orderkey % 5 = 0 THEN 'Clerk, ' ELSE '' END || o_orderpriority AS first_name,
       CASE o_orderkey % 3 WHEN 0 THEN 'line one of ' || o_orderkey || chr(10) || 'line "two"' || chr(10) || chr(10) WHEN 1 THEN 'plain' ELSE '' END AS notes
FROM orders WHERE o_orderkey % 7 <> 0""")
def q_read_sheet(spark, sf_dir):
    from starledger.operators.paging import ranked
    from starledger.sources.sheets import read_sheet
    sheet = read_sheet(spark, _text_sheet(spark, sf_dir))
    return ranked(sheet, [F.col("row_number")], "place").select("place", "student_no", "first_name", F.coalesce("notes", F.lit("")).alias("notes"))
