"""Column roles of a star and the fixed value domains of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class StarSpec:
    """Names of the columns every operator relies on.

    Defaults are the canonical star columns produced by
    ``starledger.plans.fixtures``; any other tables work by passing a spec
    (or by a metadata-only ``select(alias)`` onto these names).
    """

    # subject table
    subject_key: str = "id"
    subject_no: str = "student_no"
    first_name: str = "first_name"
    last_name: str = "last_name"
    grade: str = "grade"
    section: str = "section"
    adviser: str = "adviser"
    subject_status: str = "status"
    # catalog table
    catalog_key: str = "id"
    code: str = "code"
    catalog_name: str = "name"
    category: str = "category"
    points: str = "severity_points"
    recommended_action: str = "recommended_action"
    active: str = "active"
    # fact table
    fact_key: str = "id"
    fact_no: str = "incident_no"
    fact_date: str = "incident_date"
    fact_subject: str = "student_id"
    fact_catalog: str = "offense_id"
    action: str = "action_taken"
    fact_status: str = "status"
    reporter: str = "reported_by"
    notes: str = "notes"
    # value domains
    minor: str = "Minor"
    major: str = "Major"
    open_status: str = "Open"
    active_status: str = "Active"
    fact_prefix: str = "INC-"
    fact_no_format: str = "INC-%05d"
    # risk band thresholds (points)
    high_points: int = 12
    monitor_points: int = 6
    extra: dict = field(default_factory=dict, compare=False)


DEFAULT_SPEC = StarSpec()

# --- fixed values (must equal the reference's domains) -----------------------
# Subject status domain: lower-cased input -> stored value; default "Active".
SUBJECT_STATUSES = {"active": "Active", "inactive": "Inactive"}
SUBJECT_STATUS_DEFAULT = "Active"
# Fact status domain: lower-cased input -> stored value; default "Open".
FACT_STATUSES = {
    "open": "Open",
    "parent notified": "Parent Notified",
    "under review": "Under Review",
    "resolved": "Resolved",
}
FACT_STATUS_DEFAULT = "Open"
# Catalog categories and the allowed severity range.
CATEGORIES = ("Minor", "Major")
POINTS_MIN, POINTS_MAX = 1, 10
# Report limits: top-N size, default and max listing size, errors listed.
TOP_N = 10
LIST_LIMIT_DEFAULT = 500
ERRORS_LISTED = 10
PAGE_SIZE = 10
SUGGEST_SIZE = 8
# Header aliases applied after slugging a spreadsheet header.
HEADER_ALIASES = {
    "student_number": "student_no",
    "student_id": "student_no",
    "lrn": "student_no",
    "firstname": "first_name",
    "lastname": "last_name",
    "grade_level": "grade",
    "class_section": "section",
    "advisor": "adviser",
    "date": "incident_date",
    "offense": "offense_code",
    "code": "offense_code",
    "action": "action_taken",
    "reporter": "reported_by",
}
# Required sheet columns per intake, and the labels used in error texts.
SUBJECT_REQUIRED = ("student_no", "first_name", "last_name", "grade", "section")
SUBJECT_LABELS = (
    ("student_no", "Student No."),
    ("first_name", "First Name"),
    ("last_name", "Last Name"),
    ("grade", "Grade"),
    ("section", "Section"),
)
FACT_REQUIRED = ("incident_date", "student_no", "offense_code")
# Message texts of intake rows, request rejections and delete previews.
MSG_MISSING_COLUMNS = "Missing required Excel columns: {}"
MSG_MISSING_PREFIX = "Missing "
MSG_SUBJECT_STATUS = "Status must be Active or Inactive"
MSG_FACT_STATUS = "Status must be Open, Parent Notified, Under Review, or Resolved"
MSG_NUMBER_REQUIRED = "Student No. is required"
MSG_CODE_REQUIRED = "Offense Code is required"
MSG_SUBJECT_NOT_FOUND = "Student %s was not found"
MSG_CODE_NOT_FOUND = "Offense code %s was not found"
MSG_DATE_REQUIRED = "Incident Date is required"
MSG_DATE_INVALID = "Incident Date must use YYYY-MM-DD or a recognized Excel date"
MSG_PARENT_SUBJECT = "Student not found"
MSG_PARENT_CATALOG = "Offense not found"
MSG_PROTECTED = "%s incident records and cannot be deleted: %s%s. No %s were deleted"
MSG_PROTECTED_MORE = ", and %d more"
# Reasons of this engine's batch rejections (no reference text exists).
REASON_NOT_FOUND = "not found"
REASON_CONFLICT = "conflict"
REASON_DUPLICATE_BATCH = "duplicate in batch"
REASON_DUPLICATE_ID = "duplicate id"
# ------------------------------------------------------------------------------

SUBJECT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("student_no", T.StringType(), False),
    T.StructField("first_name", T.StringType(), True),
    T.StructField("last_name", T.StringType(), True),
    T.StructField("grade", T.StringType(), True),
    T.StructField("section", T.StringType(), True),
    T.StructField("adviser", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
])

CATALOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("severity_points", T.IntegerType(), True),
    T.StructField("recommended_action", T.StringType(), True),
    T.StructField("active", T.BooleanType(), True),
])

FACT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("incident_no", T.StringType(), False),
    T.StructField("incident_date", T.DateType(), True),
    T.StructField("student_id", T.LongType(), True),
    T.StructField("offense_id", T.LongType(), True),
    T.StructField("action_taken", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("reported_by", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
])
