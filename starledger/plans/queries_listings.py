"""Registered listing, filter and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from starledger.operators import filters as flt
from starledger.operators import ordering as od
from starledger.operators.joins import by_keys
from starledger.operators.paging import ranked
from starledger.operators.trigrams import build_trigram_index
from starledger.plans import fixtures as fx
from starledger.plans import listings
from starledger.plans.registry import register

M1 = fx.orders_star_cte()
M2 = fx.lineitem_star_cte()
PUBLIC = ", ".join(flt.SUBJECT_PUBLIC)
ENRICHED = """i.id, i.incident_no, i.incident_date, i.student_id, i.offense_id, i.action_taken, i.status,
       i.reported_by, i.notes, s.student_no, s.first_name, s.last_name, s.grade, s.section,
       o.code AS offense_code, o.name AS offense_name, o.category, o.severity_points"""
ENRICH_FROM = "fact i JOIN subj s ON s.id = i.student_id JOIN cat o ON o.id = i.offense_id"
NUM_GRADE = "COALESCE(TRY_CAST(regexp_extract(grade, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0)"


def _m1(spark, sf_dir):
    return fx.orders_star(spark, sf_dir)


@register("project_public", f"{M1} SELECT {PUBLIC} FROM subj")
def q_project_public(spark, sf_dir):
    return flt.project_public(_m1(spark, sf_dir).subject)


@register("filter_eq", f"{M1} SELECT {PUBLIC} FROM subj WHERE grade = '7' AND section = 'BUILDING' AND status = 'Active'")
def q_filter_eq(spark, sf_dir):
    return flt.filter_eq(_m1(spark, sf_dir).subject, grade="7", section="BUILDING", status="Active")


@register("search_subjects", f"""{M1} SELECT {PUBLIC} FROM subj
WHERE contains(lower(student_no), 'cruz') OR contains(lower(first_name), 'cruz') OR contains(lower(last_name), 'cruz')""")
def q_search_subjects(spark, sf_dir):
    return flt.search_any(_m1(spark, sf_dir).subject, "Cruz", ["student_no", "first_name", "last_name"])


@register("list_subjects", f"{M1} SELECT {PUBLIC} FROM subj ORDER BY {NUM_GRADE}, section, last_name, first_name, id LIMIT 500")
def q_list_subjects(spark, sf_dir):
    return od.list_subjects(_m1(spark, sf_dir).subject, limit=500)


@register("search_incidents", f"""{M1} SELECT {ENRICHED} FROM {ENRICH_FROM}
WHERE contains(lower(i.incident_no), 'cruz') OR contains(lower(s.student_no), 'cruz')
   OR contains(lower(s.first_name), 'cruz') OR contains(lower(s.last_name), 'cruz') OR contains(lower(o.name), 'cruz')""")
def q_search_incidents(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return listings.incident_listing(st.fact, st.subject, st.catalog, search="Cruz", limit=None)


@register("incident_listing", f"""{M1} SELECT {ENRICHED} FROM {ENRICH_FROM}
WHERE o.category = 'Major' AND i.status = 'Open' ORDER BY i.incident_date DESC, i.id DESC LIMIT 500""")
def q_incident_listing(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return listings.incident_listing(st.fact, st.subject, st.catalog, category="Major", status="Open", limit=500)


@register("filter_month", f"""{M1} SELECT {ENRICHED} FROM {ENRICH_FROM}
WHERE i.incident_date >= DATE '1998-03-01' AND i.incident_date < DATE '1998-04-01'""")
def q_filter_month(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return listings.incident_listing(st.fact, st.subject, st.catalog, month="1998-03", limit=None)


@register("active_catalog", f"{M2} SELECT * FROM cat WHERE active AND category = 'Major'")
def q_active_catalog(spark, sf_dir):
    cat = fx.part_catalog(spark, sf_dir)
    return od.catalog_order(flt.active_only(flt.filter_eq(cat, category="Major")))


@register("by_keys", f"""{M1} SELECT * FROM fact
WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)""")
def q_by_keys(spark, sf_dir):
    from starledger.sources.tables import read_table
    keys = read_table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 45) \
        .select(F.col("l_orderkey").alias("id"))
    return by_keys(_m1(spark, sf_dir).fact, keys)


@register("search_table", f"""{M1} SELECT {PUBLIC} FROM subj WHERE
    contains(lower(CAST(id AS VARCHAR)), '12') OR contains(lower(student_no), '12') OR contains(lower(first_name), '12')
 OR contains(lower(last_name), '12') OR contains(lower(grade), '12') OR contains(lower(section), '12')
 OR contains(lower(adviser), '12') OR contains(lower(status), '12')""")
def q_search_table(spark, sf_dir):
    return flt.search_table(flt.project_public(_m1(spark, sf_dir).subject), "12")


@register("suggest_subjects", f"""{M1} SELECT {PUBLIC} FROM subj
WHERE contains(lower(concat_ws(' ', student_no, first_name, last_name, grade || '-' || section, adviser)), 'alyssa')
ORDER BY {NUM_GRADE}, section, last_name, first_name, id LIMIT 8""")
def q_suggest_subjects(spark, sf_dir):
    return flt.suggest(flt.project_public(_m1(spark, sf_dir).subject), "  ALYSSA ")


# What a user might have typed for every subject: its label in other case, with
# blanks around it, and for some subjects a label that is nobody's.
@register("lookup_label", f"""{M1}, t AS (SELECT id AS typed_id, CASE WHEN id % 7 = 0 THEN 'nobody' ELSE '  ' || upper(
       student_no || ' - ' || first_name || ' ' || last_name || ' (' || grade || '-' || section || ')') || ' ' END AS typed FROM subj)
SELECT t.typed_id, s.id FROM t LEFT JOIN subj s
  ON lower(s.student_no || ' - ' || s.first_name || ' ' || s.last_name || ' (' || s.grade || '-' || s.section || ')') = lower(trim(t.typed))""")
def q_lookup_label(spark, sf_dir):
    subj = flt.project_public(_m1(spark, sf_dir).subject)
    typed = F.when(F.col("id") % 7 == 0, "nobody").otherwise(F.concat(F.lit("  "), F.upper(flt.option_label()), F.lit(" ")))
    asked = subj.select(F.col("id").alias("typed_id"), typed.alias("typed"))
    return flt.lookup_labels(subj, asked, "typed").select("typed_id", "id")


@register("with_labels", f"""{M1} SELECT id, first_name || ' ' || last_name AS full_name,
       grade || '-' || section AS grade_section,
       student_no || ' - ' || first_name || ' ' || last_name || ' (' || grade || '-' || section || ')' AS option_label,
       CASE WHEN adviser IS NULL OR adviser = '' THEN '—' ELSE adviser END AS adviser_display
FROM subj""")
def q_with_labels(spark, sf_dir):
    return flt.with_labels(_m1(spark, sf_dir).subject)


PAGE_P = 3


@register("page_incidents", f"""{M1} SELECT {ENRICHED} FROM {ENRICH_FROM}
ORDER BY i.incident_date DESC, i.id DESC LIMIT 10 OFFSET {PAGE_P * 10}""")
def q_page_incidents(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return listings.listing_page(st.fact, st.subject, st.catalog, PAGE_P)


@register("page_info", f"""{M1}, t AS (SELECT COUNT(*) AS total_rows FROM {ENRICH_FROM})
SELECT total_rows, CAST(GREATEST(CEIL(total_rows / 10.0), 1) AS BIGINT) AS page_count,
       CAST(CASE WHEN total_rows > 0 THEN {PAGE_P * 10 + 1} ELSE 0 END AS BIGINT) AS first_row,
       CAST(LEAST({(PAGE_P + 1) * 10}, total_rows) AS BIGINT) AS last_row FROM t""")
def q_page_info(spark, sf_dir):
    st = _m1(spark, sf_dir)
    from starledger.operators.joins import valid_children
    return od.page_info(valid_children(st.fact, st.subject, st.catalog), PAGE_P)


# First, middle and last page of all facts: pages are numbered from both ends.
def _pages_sql(cte: str) -> str:
    return f"""{cte}, t AS (SELECT {ENRICHED}, ROW_NUMBER() OVER (ORDER BY i.incident_date DESC, i.id DESC) - 1 AS rank FROM {ENRICH_FROM}),
n AS (SELECT GREATEST((COUNT(*) - 1) // 10, 0) AS last FROM t)
SELECT t.* FROM t, n WHERE t.rank // 10 IN (0, n.last // 2, n.last)"""


def _three_pages(st, ranges):
    index = listings.listing_index(st.fact, st.subject, st.catalog, ranges=ranges)
    last = index.last_page()
    first, *others = [listings.indexed_page(index, st.subject, st.catalog, p) for p in sorted({0, last // 2, last})]
    for page in others:
        first = first.unionByName(page)
    return first


@register("page_seek", _pages_sql(M1))
def q_page_seek(spark, sf_dir):
    return _three_pages(_m1(spark, sf_dir), 12)


@register("page_seek_lineitem", _pages_sql(M2))
def q_page_seek_lineitem(spark, sf_dir):
    return _three_pages(fx.lineitem_star(spark, sf_dir), None)


@register("page_seek_info", f"""{M1}, t AS (SELECT COUNT(*) AS total_rows FROM {ENRICH_FROM})
SELECT total_rows, CAST(GREATEST(CEIL(total_rows / 10.0), 1) AS BIGINT) AS page_count,
       CAST(CASE WHEN total_rows > 0 THEN {PAGE_P * 10 + 1} ELSE 0 END AS BIGINT) AS first_row,
       CAST(LEAST({(PAGE_P + 1) * 10}, total_rows) AS BIGINT) AS last_row FROM t""")
def q_page_seek_info(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return listings.listing_index(st.fact, st.subject, st.catalog).info(PAGE_P)


# The same searches through the trigram index.
def _subject_index(spark, sf_dir, cols):
    return build_trigram_index(flt.project_public(_m1(spark, sf_dir).subject), "id", cols)


@register("search_indexed_subjects", f"""{M1} SELECT {PUBLIC} FROM subj
WHERE contains(lower(student_no), 'cruz') OR contains(lower(first_name), 'cruz') OR contains(lower(last_name), 'cruz')""")
def q_search_indexed_subjects(spark, sf_dir):
    return _subject_index(spark, sf_dir, ["student_no", "first_name", "last_name"]).search("Cruz")


@register("search_indexed_table", f"""{M1} SELECT {PUBLIC} FROM subj WHERE """
          + " OR ".join(f"contains(lower(CAST({c} AS VARCHAR)), '12')" for c in flt.SUBJECT_PUBLIC))
def q_search_indexed_table(spark, sf_dir):
    return _subject_index(spark, sf_dir, flt.SUBJECT_PUBLIC).search("12")


def _indexed_listing(st, search):
    return listings.indexed_search(listings.listing_search_indexes(st.fact, st.subject, st.catalog), st.subject, st.catalog, search)


def _listing_search_sql(cte, needle):
    cells = ("i.incident_no", "s.student_no", "s.first_name", "s.last_name", "o.name")
    return f"{cte} SELECT {ENRICHED} FROM {ENRICH_FROM} WHERE " + " OR ".join(f"contains(lower({c}), '{needle}')" for c in cells)


@register("search_indexed_incidents", _listing_search_sql(M1, "cruz"))
def q_search_indexed_incidents(spark, sf_dir):
    return _indexed_listing(_m1(spark, sf_dir), "Cruz")


# An item name, a number, and a text that is nowhere, on the large catalog.
@register("search_indexed_items", _listing_search_sql(M2, "old rod"))
def q_search_indexed_items(spark, sf_dir):
    return _indexed_listing(fx.lineitem_star(spark, sf_dir), "Old Rod")


@register("search_indexed_number", _listing_search_sql(M1, "inc-0012"))
def q_search_indexed_number(spark, sf_dir):
    return _indexed_listing(_m1(spark, sf_dir), "INC-0012")


@register("search_indexed_nothing", _listing_search_sql(M1, "cruzzz"))
def q_search_indexed_nothing(spark, sf_dir):
    return _indexed_listing(_m1(spark, sf_dir), "cruzzz")


# Orders as a column: the place of every row.
@register("list_subjects_ranked", f"""{M1} SELECT {PUBLIC}, ROW_NUMBER() OVER (ORDER BY {NUM_GRADE}, section, last_name, first_name, id) AS rank_no
FROM subj""")
def q_list_subjects_ranked(spark, sf_dir):
    return ranked(flt.project_public(_m1(spark, sf_dir).subject), od.subject_list_keys())


@register("recent_ranked", f"{M2} SELECT id, incident_date, ROW_NUMBER() OVER (ORDER BY incident_date DESC, id DESC) AS rank_no FROM fact")
def q_recent_ranked(spark, sf_dir):
    return ranked(fx.lineitem_facts(spark, sf_dir).select("id", "incident_date"), od.recent_keys())


@register("catalog_ranked", f"{M2} SELECT id, code, category, ROW_NUMBER() OVER (ORDER BY category DESC, code) AS rank_no FROM cat")
def q_catalog_ranked(spark, sf_dir):
    return ranked(fx.part_catalog(spark, sf_dir).select("id", "code", "category"), od.catalog_keys())


@register("list_subjects_filtered", f"""{M1} SELECT {PUBLIC} FROM subj
WHERE (contains(lower(student_no), 'a') OR contains(lower(first_name), 'a') OR contains(lower(last_name), 'a'))
  AND grade = '3' AND status = 'Active'
ORDER BY {NUM_GRADE}, section, last_name, first_name, id LIMIT 500""")
def q_list_subjects_filtered(spark, sf_dir):
    from starledger.api import Ledger
    st = _m1(spark, sf_dir)
    return Ledger(st.subject, st.catalog, st.fact).list_subjects(search="A", grade="3", status="Active")


@register("incident_listing_search", f"""{M1} SELECT {ENRICHED} FROM {ENRICH_FROM}
WHERE (contains(lower(i.incident_no), 'cruz') OR contains(lower(s.student_no), 'cruz')
   OR contains(lower(s.first_name), 'cruz') OR contains(lower(s.last_name), 'cruz') OR contains(lower(o.name), 'cruz'))
  AND o.category = 'Minor'
ORDER BY i.incident_date DESC, i.id DESC LIMIT 50""")
def q_incident_listing_search(spark, sf_dir):
    st = _m1(spark, sf_dir)
    return listings.incident_listing(st.fact, st.subject, st.catalog, search="cruz", category="Minor", limit=50)
