"""Mapping of the driver's TPC-H-like tables onto star roles.

Map 1 (``orders_star``): subject = customer, catalog = a 5-row priority
catalog, fact = orders.  Map 2 (``lineitem_star``): subject = supplier,
catalog = part, fact = lineitem.  Every mapping is a metadata-level
``select`` of expressions, so column pruning and filter pushdown still reach
the Parquet scans.  The ``*_SQL`` strings are the same mappings in DuckDB SQL
for the oracle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.sources.catalog import MAJOR_SANCTION_GUIDE, MINOR_SANCTION_GUIDE
from starledger.sources.constants import array_literal, values_frame
from starledger.sources.tables import read_table
from starledger.spec import CATALOG_SCHEMA

# --- fixed values (the sample-data name lists and reporters) -------------------
FIRST_NAMES = [
    "Alyssa", "Marco", "Janelle", "Rafael", "Bianca", "Luis", "Trisha", "Enzo",
    "Mika", "Andre", "Sofia", "Nico", "Kath", "Paolo", "Lara", "Miguel",
    "Iya", "Jerome", "Camille", "Bryan", "Dana", "Anton", "Rhea", "Josh",
    "Sam", "Elaine", "Carlo", "Mara", "Francis", "Bea", "Kyle", "Nina",
    "Gio", "Clara", "Sean", "Ella", "Ken", "Jasmine", "Leo", "Mae",
    "Jan", "Mia", "Rico", "Angel", "Cedric", "Faith", "Ivan", "Alexa",
    "Noah", "Yna",
]
LAST_NAMES = [
    "Bautista", "Cruz", "Garcia", "Lim", "Reyes", "Santos", "Torres", "Villanueva",
    "Aquino", "Castillo", "Dela Cruz", "Flores", "Gonzales", "Lopez", "Mendoza", "Navarro",
    "Ortega", "Perez", "Ramos", "Sy", "Tan", "Valdez", "Yu", "Zamora",
    "Abad", "Bravo", "Chua", "Diaz", "Evangelista", "Fernandez", "Go", "Hernandez",
    "Ilagan", "Jacinto", "Kho", "Lazaro", "Morales", "Natividad", "Ocampo", "Pascual",
    "Quiambao", "Robles", "Salazar", "Tiu", "Uy", "Velasco", "Wong", "Xavier",
    "Yap", "Zulueta",
]
REPORTERS = ["Guidance Office", "Class Adviser", "Subject Teacher", "Prefect of Discipline"]
SECTIONS = ["A", "B", "C", "D"]
# Map 1 catalog: order priority -> (id, name, category, points, action, active).
PRIORITY_CATALOG = [
    (1, "1-URGENT", "Urgent priority", "Major", 5, MAJOR_SANCTION_GUIDE, True),
    (2, "2-HIGH", "High priority", "Major", 5, MAJOR_SANCTION_GUIDE, True),
    (3, "3-MEDIUM", "Medium priority", "Minor", 1, MINOR_SANCTION_GUIDE, True),
    (4, "4-NOT SPECIFIED", "Unspecified priority", "Minor", 1, MINOR_SANCTION_GUIDE, True),
    (5, "5-LOW", "Low priority", "Minor", 1, MINOR_SANCTION_GUIDE, True),
]
# Map 1 fact status: order status letter -> fact status.
ORDER_STATUS = {"O": "Open", "P": "Under Review", "F": "Resolved"}
# Map 2 fact status: return flag -> fact status.
RETURN_STATUS = {"R": "Open", "A": "Parent Notified", "N": "Resolved"}
REPORT_YEAR = 1998
# ------------------------------------------------------------------------------


_MEMO: dict[tuple, DataFrame] = {}


def _memo(fn):
    """Reuse the (lazy, immutable) mapped frame per session and directory."""
    def wrapper(spark, *args):
        key = (fn.__name__, id(spark), *args)
        if key not in _MEMO:
            _MEMO[key] = fn(spark, *args)
        return _MEMO[key]
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


class Star(NamedTuple):
    subject: DataFrame
    catalog: DataFrame
    fact: DataFrame


def _pick(values: list[str], idx) -> F.Column:
    return F.element_at(array_literal(values), (idx % len(values)).cast("int") + 1)


def _case(col: str, mapping: dict[str, str]) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(col) == k, v) if expr is None else expr.when(F.col(col) == k, v))
    return expr


def _subject(df: DataFrame, key: str, name: str, nation: str, bal: str, section) -> DataFrame:
    k = F.col(key)
    return df.select(
        k.cast("bigint").alias("id"),
        F.col(name).alias("student_no"),
        _pick(FIRST_NAMES, k).alias("first_name"),
        _pick(LAST_NAMES, k * 3 + 2).alias("last_name"),
        F.col(nation).cast("string").alias("grade"),
        section.alias("section"),
        F.concat(F.lit("Adviser "), F.col(nation).cast("string")).alias("adviser"),
        F.when(F.col(bal) < 0, "Inactive").otherwise("Active").alias("status"),
    )


@_memo
def customer_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subject(read_table(spark, sf_dir, "customer"), "c_custkey", "c_name",
                    "c_nationkey", "c_acctbal", F.col("c_mktsegment"))


@_memo
def supplier_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subject(read_table(spark, sf_dir, "supplier"), "s_suppkey", "s_name",
                    "s_nationkey", "s_acctbal", _pick(SECTIONS, F.col("s_suppkey")))


@_memo
def priority_catalog(spark: SparkSession) -> DataFrame:
    return values_frame(spark, PRIORITY_CATALOG, CATALOG_SCHEMA)


@_memo
def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.format_string("P-%05d", F.col("p_partkey")).alias("code"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") >= 26, "Major").otherwise("Minor").alias("category"),
        (F.lit(1) + F.col("p_size") % 10).cast("int").alias("severity_points"),
        F.concat(F.lit("Inspect "), F.col("p_brand")).alias("recommended_action"),
        (F.col("p_size") % 7 != 0).alias("active"),
    )


@_memo
def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.format_string("INC-%05d", k).alias("incident_no"),
        F.col("o_orderdate").cast("date").alias("incident_date"),
        F.col("o_custkey").alias("student_id"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("offense_id"),
        F.when(F.col("o_orderstatus") == "F", "Closed").otherwise("").alias("action_taken"),
        _case("o_orderstatus", ORDER_STATUS).alias("status"),
        _pick(REPORTERS, k).alias("reported_by"),
        F.lit("").alias("notes"),
    )


@_memo
def lineitem_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select(
        k.alias("id"),
        F.format_string("LI-%d", k).alias("incident_no"),
        F.col("l_shipdate").cast("date").alias("incident_date"),
        F.col("l_suppkey").alias("student_id"),
        F.col("l_partkey").alias("offense_id"),
        F.lit("").alias("action_taken"),
        _case("l_returnflag", RETURN_STATUS).alias("status"),
        _pick(REPORTERS, k).alias("reported_by"),
        F.lit("").alias("notes"),
    )


def orders_star(spark: SparkSession, sf_dir: str) -> Star:
    return Star(customer_subjects(spark, sf_dir), priority_catalog(spark), order_facts(spark, sf_dir))


def lineitem_star(spark: SparkSession, sf_dir: str) -> Star:
    return Star(supplier_subjects(spark, sf_dir), part_catalog(spark, sf_dir), lineitem_facts(spark, sf_dir))


# ---------------------------------------------------------------------------
# The same mappings as DuckDB SQL (used by ``oracle_sql``).

def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _sql_case(col: str, mapping: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {_sql_str(k)} THEN {_sql_str(v)}" for k, v in mapping.items()) + " END"


def _subject_sql(table, key, name, nation, bal, section_sql) -> str:
    return (
        f"SELECT CAST({key} AS BIGINT) AS id, {name} AS student_no, "
        f"{_sql_list(FIRST_NAMES)}[({key} % 50) + 1] AS first_name, "
        f"{_sql_list(LAST_NAMES)}[(({key} * 3 + 2) % 50) + 1] AS last_name, "
        f"CAST({nation} AS VARCHAR) AS grade, {section_sql} AS section, "
        f"'Adviser ' || CAST({nation} AS VARCHAR) AS adviser, "
        f"CASE WHEN {bal} < 0 THEN 'Inactive' ELSE 'Active' END AS status FROM {table}"
    )


CUSTOMER_SUBJECTS_SQL = _subject_sql("customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
SUPPLIER_SUBJECTS_SQL = _subject_sql("supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal",
                                     f"{_sql_list(SECTIONS)}[(s_suppkey % 4) + 1]")

PRIORITY_CATALOG_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"(CAST({i} AS BIGINT), {_sql_str(c)}, {_sql_str(n)}, {_sql_str(cat)}, CAST({p} AS INTEGER), {_sql_str(a)}, {str(act).upper()})"
    for i, c, n, cat, p, a, act in PRIORITY_CATALOG
) + ") AS t(id, code, name, category, severity_points, recommended_action, active)"

PART_CATALOG_SQL = (
    "SELECT p_partkey AS id, printf('P-%05d', p_partkey) AS code, p_name AS name, "
    "CASE WHEN p_size >= 26 THEN 'Major' ELSE 'Minor' END AS category, "
    "CAST(1 + p_size % 10 AS INTEGER) AS severity_points, 'Inspect ' || p_brand AS recommended_action, "
    "(p_size % 7 <> 0) AS active FROM part"
)

ORDER_FACTS_SQL = (
    "SELECT o_orderkey AS id, printf('INC-%05d', o_orderkey) AS incident_no, "
    "CAST(o_orderdate AS DATE) AS incident_date, o_custkey AS student_id, "
    "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS offense_id, "
    "CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE '' END AS action_taken, "
    f"{_sql_case('o_orderstatus', ORDER_STATUS)} AS status, "
    f"{_sql_list(REPORTERS)}[(o_orderkey % 4) + 1] AS reported_by, '' AS notes FROM orders"
)

LINEITEM_FACTS_SQL = (
    "SELECT l_orderkey * 8 + l_linenumber AS id, 'LI-' || CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS incident_no, "
    "CAST(l_shipdate AS DATE) AS incident_date, l_suppkey AS student_id, l_partkey AS offense_id, "
    f"'' AS action_taken, {_sql_case('l_returnflag', RETURN_STATUS)} AS status, "
    f"{_sql_list(REPORTERS)}[((l_orderkey * 8 + l_linenumber) % 4) + 1] AS reported_by, '' AS notes FROM lineitem"
)


def orders_star_cte() -> str:
    """``WITH`` clause defining ``subj``, ``cat`` and ``fact`` for Map 1."""
    return (f"WITH subj AS ({CUSTOMER_SUBJECTS_SQL}), cat AS ({PRIORITY_CATALOG_SQL}), "
            f"fact AS ({ORDER_FACTS_SQL})")


def lineitem_star_cte() -> str:
    return (f"WITH subj AS ({SUPPLIER_SUBJECTS_SQL}), cat AS ({PART_CATALOG_SQL}), "
            f"fact AS ({LINEITEM_FACTS_SQL})")


# ---------------------------------------------------------------------------
# Staged (dirty) intake sheets derived from whole tables by modular rules.
# Every cell is text; ``row_number`` is the physical sheet row (header = 1).

def _s(c) -> F.Column:
    return c.cast("string")


@_memo
def staged_subject_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    blank = (k % 17 == 0)

    def cell(expr):
        return F.when(blank, F.lit("")).otherwise(expr)

    def numbered(n):  # every third row names a stored subject, the others new ones
        return F.when(n % 3 == 0, F.format_string("Customer#%09d", n)).otherwise(F.format_string("Pupil#%09d", n))
    number = F.when((k % 5 == 0) & (k > 0), F.upper(numbered(k - 1))).otherwise(numbered(k))
    first = F.when(k % 7 == 0, F.lit("")).when(k % 6 == 1, F.concat(F.lit(" "), _pick(FIRST_NAMES, k), F.lit(" "))) \
        .otherwise(_pick(FIRST_NAMES, k))
    grade = F.when(k % 19 == 0, F.lit("")).otherwise(_s(F.col("c_nationkey")))
    status = (F.when(k % 11 == 0, "Bogus").when(k % 13 == 0, "   ").when(k % 4 == 0, "")
              .when(k % 4 == 1, "ACTIVE").when(k % 4 == 2, " inactive ").otherwise("Active"))
    return c.select(
        (k + 2).alias("row_number"),
        cell(number).alias("student_no"),
        cell(first).alias("first_name"),
        cell(_pick(LAST_NAMES, k * 3 + 2)).alias("last_name"),
        cell(grade).alias("grade"),
        cell(F.col("c_mktsegment")).alias("section"),
        cell(F.concat(F.lit("Adviser "), _s(F.col("c_nationkey")))).alias("adviser"),
        cell(status).alias("status"),
    )


@_memo
def staged_fact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("date")
    y, m, dd = _s(F.year(d)), _s(F.month(d)), _s(F.dayofmonth(d))
    r = k % 8
    text = (F.when(r == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(r == 1, F.concat_ws("/", m, dd, y))
            .when(r == 2, F.concat_ws("-", m, dd, y))
            .when(r == 3, _s(F.datediff(d, F.lit("1899-12-30").cast("date"))))
            .when(r == 4, F.concat_ws("/", dd, m, y))
            .when(r == 5, F.date_format(d, "yyyyMMdd"))
            .when(r == 6, F.date_format(d, "MM/dd/yyyy"))
            .otherwise(F.concat_ws("-", dd, m, y)))
    date_text = F.when(k % 37 == 0, F.lit("")).when(k % 13 == 0, F.lit("soon")).otherwise(text)
    number = F.format_string("Customer#%09d", F.col("o_custkey"))
    student = (F.when(k % 29 == 0, F.lit("")).when(k % 17 == 0, F.concat(F.lit("Nobody#"), _s(k)))
               .when(k % 2 == 0, F.lower(number)).otherwise(number))
    code = (F.when(k % 19 == 0, F.lit("")).when(k % 23 == 0, F.lit("ZZ-UNKNOWN"))
            .when(k % 2 == 1, F.lower(F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority")))
    st = F.col("o_orderstatus")
    status = (F.when(k % 31 == 0, "Pending").when(k % 5 == 0, "").when(st == "O", "open")
              .when(st == "P", "Under Review").otherwise(" RESOLVED "))
    return o.select(
        (k + 2).alias("row_number"),
        date_text.alias("incident_date"),
        student.alias("student_no"),
        code.alias("offense_code"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("Counselled")).alias("action_taken"),
        status.alias("status"),
        _pick(REPORTERS, k).alias("reported_by"),
        F.concat(F.lit("Imported row "), _s(k)).alias("notes"),
    )


STAGED_SUBJECTS_SQL = (
    "SELECT c_custkey + 2 AS row_number, "
    + ", ".join(
        f"CASE WHEN c_custkey % 17 = 0 THEN '' ELSE {expr} END AS {name}" for name, expr in [
            ("student_no", "CASE WHEN c_custkey % 5 = 0 AND c_custkey > 0 "
                           "THEN upper(printf(CASE (c_custkey - 1) % 3 WHEN 0 THEN 'Customer#%09d' ELSE 'Pupil#%09d' END, c_custkey - 1)) "
                           "ELSE printf(CASE c_custkey % 3 WHEN 0 THEN 'Customer#%09d' ELSE 'Pupil#%09d' END, c_custkey) END"),
            ("first_name", f"CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 6 = 1 THEN ' ' || {_sql_list(FIRST_NAMES)}[(c_custkey % 50) + 1] || ' ' ELSE {_sql_list(FIRST_NAMES)}[(c_custkey % 50) + 1] END"),
            ("last_name", f"{_sql_list(LAST_NAMES)}[((c_custkey * 3 + 2) % 50) + 1]"),
            ("grade", "CASE WHEN c_custkey % 19 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END"),
            ("section", "c_mktsegment"),
            ("adviser", "'Adviser ' || CAST(c_nationkey AS VARCHAR)"),
            ("status", "CASE WHEN c_custkey % 11 = 0 THEN 'Bogus' WHEN c_custkey % 13 = 0 THEN '   ' WHEN c_custkey % 4 = 0 THEN '' "
                       "WHEN c_custkey % 4 = 1 THEN 'ACTIVE' WHEN c_custkey % 4 = 2 THEN ' inactive ' ELSE 'Active' END"),
        ])
    + " FROM customer"
)

STAGED_FACTS_SQL = (
    "SELECT o_orderkey + 2 AS row_number, "
    "CASE WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE CASE o_orderkey % 8 "
    "WHEN 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') "
    "WHEN 1 THEN CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR) "
    "WHEN 2 THEN CAST(month(o_orderdate) AS VARCHAR) || '-' || CAST(day(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) "
    "WHEN 3 THEN CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR) "
    "WHEN 4 THEN CAST(day(o_orderdate) AS VARCHAR) || '/' || CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR) "
    "WHEN 5 THEN strftime(CAST(o_orderdate AS DATE), '%Y%m%d') "
    "WHEN 6 THEN strftime(CAST(o_orderdate AS DATE), '%m/%d/%Y') "
    "ELSE CAST(day(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) END END AS incident_date, "
    "CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'Nobody#' || CAST(o_orderkey AS VARCHAR) "
    "WHEN o_orderkey % 2 = 0 THEN lower(printf('Customer#%09d', o_custkey)) ELSE printf('Customer#%09d', o_custkey) END AS student_no, "
    "CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN 'ZZ-UNKNOWN' WHEN o_orderkey % 2 = 1 THEN lower(o_orderpriority) "
    "ELSE o_orderpriority END AS offense_code, "
    "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Counselled' END AS action_taken, "
    "CASE WHEN o_orderkey % 31 = 0 THEN 'Pending' WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderstatus = 'O' THEN 'open' "
    "WHEN o_orderstatus = 'P' THEN 'Under Review' ELSE ' RESOLVED ' END AS status, "
    f"{_sql_list(REPORTERS)}[(o_orderkey % 4) + 1] AS reported_by, "
    "'Imported row ' || CAST(o_orderkey AS VARCHAR) AS notes FROM orders"
)
