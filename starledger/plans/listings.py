"""Filtered listings over one table or the enriched 3-way join."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.functions.predicates import any_contains, in_month
from starledger.operators.joins import bounded_broadcast, enrich, valid_children
from starledger.operators.ordering import limited, recent_keys
from starledger.operators.paging import PageIndex, build_page_index
from starledger.operators.trigrams import TrigramIndex, build_trigram_index, search_facts_indexed
from starledger.spec import DEFAULT_SPEC, LIST_LIMIT_DEFAULT, PAGE_SIZE, StarSpec

INCIDENT_SEARCH_COLS = ("incident_no", "student_no", "first_name", "last_name", "offense_name")


def incident_filter(fact: DataFrame, spec: StarSpec = DEFAULT_SPEC, month: str = "",
                    status: str = "") -> DataFrame:
    f = fact
    if month:
        f = f.filter(in_month(spec.fact_date, month))
    if status:
        f = f.filter(F.col(spec.fact_status) == status)
    return f


def incident_listing(fact: DataFrame, subject: DataFrame, catalog: DataFrame,
                     spec: StarSpec = DEFAULT_SPEC, search: str = "", month: str = "",
                     category: str = "", status: str = "",
                     limit: int | None = LIST_LIMIT_DEFAULT) -> DataFrame:
    """C1 + B2/B3/B5 + E2: enriched facts, filtered, most recent first.

    Without a text search no predicate needs subject columns, so the plan
    first keeps facts whose subject exists (a semi join on key columns only),
    takes the top ``limit`` rows, and only then joins the at most ``limit``
    rows to subject and catalog details (the planner knows the limit).
    """
    f = incident_filter(fact, spec, month, status)
    cat = catalog
    if category:
        cat = catalog.filter(F.col(spec.category) == category)
    if search:
        f = search_facts(f, subject, cat, search, spec)
    if search or limit is None:
        out = enrich(f, subject, cat, spec)
        out = out.orderBy(F.col(spec.fact_date).desc(), F.col(spec.fact_key).desc())
        return limited(out, limit)
    keys = bounded_broadcast(cat.select(F.col(spec.catalog_key).alias("_cid")), within=catalog)
    f = f.join(keys, f[spec.fact_catalog] == keys["_cid"], "left_semi")
    s_keys = subject.select(F.col(spec.subject_key).alias("_sid"))
    f = f.join(s_keys, f[spec.fact_subject] == s_keys["_sid"], "left_semi")
    top = limited(f.orderBy(F.col(spec.fact_date).desc(), F.col(spec.fact_key).desc()), limit)
    out = enrich(top, subject, cat, spec)
    return out.orderBy(F.col(spec.fact_date).desc(), F.col(spec.fact_key).desc())


def search_facts(fact: DataFrame, subject: DataFrame, catalog: DataFrame, search: str,
                 spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """B3 over the 3-way join without joining every fact first.

    A fact matches when its number, its subject's number or names, or its
    catalog item's name contains ``search`` (case-insensitive).  The matching
    subjects and catalog items are computed on the dimension tables and
    attached to facts as flags through key joins; when those key sets are
    provably small they are broadcast, so the fact table is filtered in its
    scan stage with no shuffle, and only matching facts reach the detail join.
    """
    s_hit = subject.filter(any_contains([spec.subject_no, spec.first_name, spec.last_name], search)) \
        .select(F.col(spec.subject_key).alias("_s_hit")).distinct()
    c_hit = catalog.filter(any_contains([spec.catalog_name], search)) \
        .select(F.col(spec.catalog_key).alias("_c_hit")).distinct()
    s_hit, c_hit = bounded_broadcast(s_hit, within=subject), bounded_broadcast(c_hit, within=catalog)
    f = fact.join(s_hit, fact[spec.fact_subject] == s_hit["_s_hit"], "left")
    f = f.join(c_hit, f[spec.fact_catalog] == c_hit["_c_hit"], "left")
    hit = any_contains([spec.fact_no], search) | F.col("_s_hit").isNotNull() | F.col("_c_hit").isNotNull()
    return f.filter(hit).drop("_s_hit", "_c_hit")


class SearchIndexes(NamedTuple):
    """The three indexes that a listing search needs, of one snapshot."""
    numbers: TrigramIndex
    subjects: TrigramIndex
    items: TrigramIndex


def listing_search_indexes(fact: DataFrame, subject: DataFrame, catalog: DataFrame, spec: StarSpec = DEFAULT_SPEC,
                           ranges: int | None = None) -> SearchIndexes:
    return SearchIndexes(
        build_trigram_index(fact, spec.fact_key, [spec.fact_no], ranges),
        build_trigram_index(subject, spec.subject_key, [spec.subject_no, spec.first_name, spec.last_name], ranges),
        build_trigram_index(catalog, spec.catalog_key, [spec.catalog_name], ranges))


def indexed_search(indexes: SearchIndexes, subject: DataFrame, catalog: DataFrame, search: str,
                   spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """B3 over the enriched listing through the indexes."""
    return enrich(search_facts_indexed(*indexes, search, spec), subject, catalog, spec)


def listing_page(fact: DataFrame, subject: DataFrame, catalog: DataFrame, p: int,
                 spec: StarSpec = DEFAULT_SPEC, n: int = 10) -> DataFrame:
    """E8 on the enriched listing: page ``p`` (0-based) of ``n`` rows, most
    recent first.  Paging runs on key columns (semi joins for the inner-join
    semantics); details are joined to the ``n`` page rows only."""
    c_keys = bounded_broadcast(catalog.select(F.col(spec.catalog_key).alias("_cid")), within=catalog)
    f = fact.join(c_keys, fact[spec.fact_catalog] == c_keys["_cid"], "left_semi")
    s_keys = subject.select(F.col(spec.subject_key).alias("_sid"))
    f = f.join(s_keys, f[spec.fact_subject] == s_keys["_sid"], "left_semi")
    rows = f.orderBy(F.col(spec.fact_date).desc(), F.col(spec.fact_key).desc()).offset(p * n).limit(n)
    return enrich(rows, subject, catalog, spec)


def listing_index(fact: DataFrame, subject: DataFrame, catalog: DataFrame, spec: StarSpec = DEFAULT_SPEC,
                  n: int = PAGE_SIZE, ranges: int | None = None) -> PageIndex:
    """The facts of one snapshot whose parents exist, most recent first,
    sorted once so that any page is a seek."""
    return build_page_index(valid_children(fact, subject, catalog, spec), recent_keys(spec.fact_date, spec.fact_key),
                            n, ranges, "listing-index")


def indexed_page(index: PageIndex, subject: DataFrame, catalog: DataFrame, p: int,
                 spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """Page ``p`` of the index with subject and catalog details, which only
    the page's rows are joined to."""
    return enrich(index.page(p).limit(index.size), subject, catalog, spec).orderBy("rank")
