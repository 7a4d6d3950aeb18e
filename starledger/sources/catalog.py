"""Constant catalogs as dimension frames.

A constant catalog becomes a ``LocalRelation``: its row count is known at
plan time, so broadcasting it is safe at any fact size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from starledger.sources.constants import values_frame
from starledger.spec import CATALOG_SCHEMA

# --- fixed values (must equal the reference's catalog texts) -------------------
MINOR_SANCTION_GUIDE = (
    "1st offense: Class Adviser oral reprimand/counselling; "
    "2nd offense: refer to School Discipline Officer for oral and written reprimand; "
    "3rd offense: refer to Guidance Counselor for school/home therapy; "
    "4th offense: three-day suspension with counselling; "
    "5th offense: refer to the Principal."
)
MAJOR_SANCTION_GUIDE = (
    "Refer to the School Discipline Officer, Guidance Counselor, and Principal "
    "for investigation and appropriate disciplinary action."
)
# Official catalog: (code, name, category, severity points, recommended action).
OFFICIAL_CATALOG = [
    ("MAJ-001", "Bullying (Physical, Emotional, Mental, Cyber Bullying)", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-002", "Cheating / Dishonesty", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-003", "Stealing / Theft / Robbery", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-004", "Assaulting a teacher, fellow learner, or school authority", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-005", "Smoking inside the school campus or within 100 meters of the school perimeter", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-006", "Vandalism or destruction of school property", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-007", "Gambling of any sort", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-008", "Drinking intoxicants/liquor, entering under the influence, or bringing alcoholic beverages", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-009", "Carrying or concealing deadly weapons or instruments", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-010", "Extortion or asking money or in-kind items from others", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-011", "Fighting or causing injury", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-012", "Hazing whether outside or inside the school campus", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-013", "Sexual abuse, immorality, or illicit relationships", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-014", "Instigating, leading, or participating in activities leading to stoppage of classes", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-015", "Preventing or threatening learners, faculty, or school authorities from discharging duties", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-016", "Forging or tampering with school records or transfer forms", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-017", "Truancy (Jumping over the fence)", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-018", "Joining fraternities, sororities, or gangs", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MAJ-019", "Watching or keeping pornographic materials", "Major", 5, MAJOR_SANCTION_GUIDE),
    ("MIN-001", "Absenteeism, cutting of classes, and tardiness", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-002", "Failure to wear prescribed uniform", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-003", "Wearing caps inside the school campus, especially inside the classroom", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-004", "Wearing civilian clothes on uniform days", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-005", "Wearing earrings for boys or multiple earrings for girls", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-006", "Outlandish attires, over-accessories, or body piercing", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-007", "Use of profane language or swearing", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-008", "Littering inside the school campus", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-009", "Using cellphones and other gadgets during class hours", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-010", "PDA (Public Display of Affection)", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-011", "Unruly behavior during assemblies, school activities, religious services, or flag ceremony", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-012", "Going to restricted places", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-013", "Refusal to wear or display school ID", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-014", "Placing stickers and other objects on school ID", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-015", "Wearing another student's ID", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-016", "Spending for personal use funds entrusted to him or her", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-017", "Refusing to obey student leaders discharging duty or representing authority", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-018", "Destroying another learner's belongings or blocking another person's path", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-019", "Disrespect to the Philippine Flag or singing of the National Anthem", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-020", "Spitting everywhere", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-021", "Putting on make-up and lipstick", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-022", "Urinating elsewhere or in inappropriate places", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-023", "Loitering or staying inside/outside the school campus during class hours", "Minor", 1, MINOR_SANCTION_GUIDE),
    ("MIN-024", "Other analogous acts that may endanger or threaten learners or school personnel", "Minor", 1, MINOR_SANCTION_GUIDE),
]
# Retired code -> replacement code; applied simultaneously, never chained.
LEGACY_CODE_MAP = {
    "MIN-003": "MIN-011",
    "MIN-004": "MIN-024",
    "MIN-005": "MIN-009",
    "MIN-006": "MIN-023",
    "MAJ-002": "MAJ-011",
    "MAJ-003": "MAJ-006",
    "MAJ-004": "MAJ-002",
    "MAJ-005": "MAJ-017",
    "MAJ-006": "MAJ-009",
}
# ------------------------------------------------------------------------------


def catalog_frame(spark: SparkSession, rows: Sequence[tuple] = OFFICIAL_CATALOG,
                  first_id: int = 1, active: bool = True) -> DataFrame:
    """A catalog dimension from constant ``(code, name, category, points,
    action)`` rows; ids are assigned in the given order."""
    data = [(first_id + i, code, name, cat, int(pts), act, active)
            for i, (code, name, cat, pts, act) in enumerate(rows)]
    return values_frame(spark, data, CATALOG_SCHEMA)


def code_map_frame(spark: SparkSession, mapping: dict[str, str] = LEGACY_CODE_MAP) -> DataFrame:
    """Key-remap table (old_code, new_code) as a bounded constant frame."""
    schema = T.StructType([T.StructField("old_code", T.StringType()), T.StructField("new_code", T.StringType())])
    return values_frame(spark, sorted(mapping.items()), schema)

