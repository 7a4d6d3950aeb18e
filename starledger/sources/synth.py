"""Deterministic sample star derived from existing tables.

The sample layout of the original seed (people over grades 7-12, sections
A-D, five per section; facts spread over the first half of a year, the
catalog used round-robin, four statuses and four reporters) is rebuilt as
column expressions over the rows of a driving table, so the size follows the
data and every value is a pure function of the row key (no random sequence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.plans.fixtures import FIRST_NAMES, LAST_NAMES, REPORTERS, Star, _pick
from starledger.sources.catalog import OFFICIAL_CATALOG, catalog_frame

# --- fixed values (sample layout) -----------------------------------------------
GRADES = ["7", "8", "9", "10", "11", "12"]
SECTIONS = ["A", "B", "C", "D"]
ADVISERS = {"7": "Ms. Reyes", "8": "Mr. Santos", "9": "Ms. Cruz", "10": "Mr. Flores", "11": "Ms. Lim", "12": "Mr. Garcia"}
FACT_STATUSES = ["Open", "Parent Notified", "Under Review", "Resolved"]
SEED_NOTE = "Seed sample incident for testing."
PER_SECTION = 5
START_MONTH_DAY = (1, 8)
DAY_SPAN = 196
# ------------------------------------------------------------------------------


def synth_subjects(keys: DataFrame, key: str) -> DataFrame:
    """One subject per row of ``keys``; ``idx = key + 1`` drives the layout."""
    idx = F.col(key).cast("bigint") + 1
    grade = _pick(GRADES, F.floor((idx - 1) / (PER_SECTION * len(SECTIONS))))
    adv = F.create_map(*[F.lit(x) for kv in ADVISERS.items() for x in kv])
    return keys.select(
        idx.alias("id"),
        F.format_string("RTS-%05d", idx).alias("student_no"),
        _pick(FIRST_NAMES, idx - 1).alias("first_name"),
        _pick(LAST_NAMES, idx * 3 - 1).alias("last_name"),
        grade.alias("grade"),
        _pick(SECTIONS, F.floor((idx - 1) / PER_SECTION)).alias("section"),
        F.element_at(adv, grade).alias("adviser"),
        F.lit("Active").alias("status"),
    )


def synth_facts(rows: DataFrame, key: str, n_subjects, year: int, catalog: DataFrame) -> DataFrame:
    """One fact per row of ``rows`` (``i = key``).  ``n_subjects`` is an int
    or a scalar Column; catalog ids are used round-robin in code order."""
    i = F.col(key).cast("bigint")
    n_cat = len(OFFICIAL_CATALOG)
    start = F.make_date(F.lit(year), F.lit(START_MONTH_DAY[0]), F.lit(START_MONTH_DAY[1]))
    n = n_subjects if isinstance(n_subjects, F.Column) else F.lit(n_subjects)
    f = rows.select(
        (i + 1).alias("id"),
        F.format_string("INC-%05d", i + 1).alias("incident_no"),
        F.date_add(start, ((i * 37) % DAY_SPAN).cast("int")).alias("incident_date"),
        ((i * 11 + (i * 7) % 13) % n + 1).cast("bigint").alias("student_id"),
        ((i % n_cat) + 1).cast("bigint").alias("offense_id"),
        _pick(FACT_STATUSES, i * 3).alias("status"),
        _pick(REPORTERS, i).alias("reported_by"),
        F.lit(SEED_NOTE).alias("notes"),
    )
    from starledger.operators.joins import bounded_broadcast
    c = bounded_broadcast(catalog.select(F.col("id").alias("_cid"), F.col("recommended_action").alias("action_taken")))
    j = f.join(c, f["offense_id"] == c["_cid"], "left")
    return j.select("id", "incident_no", "incident_date", "student_id", "offense_id", "action_taken",
                    "status", "reported_by", "notes")


def synth_star(spark: SparkSession, subject_keys: DataFrame, subject_key: str,
               fact_rows: DataFrame, fact_key: str, year: int) -> Star:
    """A sample star sized by two driving tables.  The catalog is the
    official constant catalog (ids in code order)."""
    cat = catalog_frame(spark, sorted(OFFICIAL_CATALOG))
    subj = synth_subjects(subject_keys, subject_key)
    n = subject_keys.agg(F.count(F.lit(1)).alias("n")).scalar()
    return Star(subj, cat, synth_facts(fact_rows, fact_key, n, year, cat))
