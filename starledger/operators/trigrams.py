"""Substring search through an inverted index of trigrams.

``contains`` reads every cell of a table for each search.  A ``TrigramIndex``
writes, once for a snapshot, one posting ``(gram, key)`` for every distinct
gram of a row's searchable cells, range-partitioned by ``(gram, key)``
(``operators.ranged``): the postings of one gram lie in few neighbouring
files, and a gram that every row holds is cut into several.  A search

1. splits the folded needle into trigrams and looks their frequencies up;
2. reads the files that hold the postings of its rarest grams, and
   intersects the key sets;
3. reads the files that hold the candidates' rows (a posting names the file
   of its row) and verifies them with the scan's own predicate, so that
   results equal the scan's exactly.

Cells end in two blanks of their own (``END``), so that every character of a
cell starts a gram: a needle of one or two characters is a prefix of grams,
an interval of the same order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions.predicates import any_contains
from starledger.functions.scalars import col_
from starledger.operators.ranged import PART, RangedTable, materialize, write_ranged
from starledger.spec import DEFAULT_SPEC, StarSpec

GRAM = 3
END = "\u0000"
TOP = "\U0010FFFF"
RAREST = 4  # grams that are intersected; the rest is left to the verification


def grams(text: Column) -> Column:
    """Distinct grams that start at each character of a folded cell."""
    padded = F.concat(text, F.lit(END * (GRAM - 1)))
    starts = F.sequence(F.lit(1), F.length(text))
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(GRAM)))))


@dataclass(frozen=True)
class TrigramIndex:
    rows: RangedTable          # the snapshot that is searched, ordered by key
    key: str                   # its unique column
    cols: tuple[str, ...]      # searchable columns, as text
    postings: RangedTable      # (gram, key, home: the row's range), ordered by gram and key
    frequencies: RangedTable   # (gram, n), ordered by gram

    def keep(self, rows: DataFrame, needle: str) -> DataFrame:
        """The scan's own predicate."""
        return rows.filter(any_contains([F.col(c).cast("string") for c in self.cols], needle))

    def wanted(self, needle: str) -> list[str] | None:
        """The rarest grams of a long needle, rarest first; None if one of
        them is in no cell.  The driver reads one count for each gram of the needle."""
        want = sorted({needle[i:i + GRAM] for i in range(len(needle) - GRAM + 1)})
        parts = sorted({p for held in self.frequencies.holding_each(want).values() for p in held})
        found = self.frequencies.rows_of(parts).filter(F.col("gram").isin(want)).select("gram", "n").collect()
        if len(found) < len(want):
            return None
        return [r["gram"] for r in sorted(found, key=lambda r: (r["n"], r["gram"]))][:RAREST]

    def candidates(self, needle: str) -> DataFrame:
        """(key, home) of the rows that may contain the folded needle."""
        if len(needle) < GRAM:
            parts = self.postings.holding(needle, needle + TOP * GRAM)
            hit = self.postings.rows_of(parts).filter(F.col("gram").startswith(needle))
            return hit.select("key", "home").distinct()
        want = self.wanted(needle)
        if want is None:
            return self.postings.rows_of([]).select("key", "home")
        parts = self.postings.holding_each(want)
        lists = [self.postings.rows_of(parts[g]).filter(F.col("gram") == g).select("key", "home") for g in want]
        # a key is at most once in a gram's postings; the rarest list leads
        return reduce(lambda a, b: a.join(b.select("key"), "key", "left_semi"), lists)

    def search(self, needle: str) -> DataFrame:
        """The rows that ``any_contains`` keeps; a blank needle keeps all.

        Only the files that hold candidates are read; the driver collects
        their numbers, one for each file met."""
        if not needle:
            return self.rows.all_rows().select(*self.rows.columns)
        found = materialize(self.candidates(needle.lower()), name="search-candidates")
        homes = sorted(r["home"] for r in found.select("home").distinct().collect())
        near = self.rows.rows_of(homes)
        near = near.join(found.select(F.col("key").alias("_candidate")), F.col(self.key) == F.col("_candidate"), "left_semi")
        return self.keep(near, needle).select(*self.rows.columns)

    def matching_keys(self, needle: str, out: str) -> DataFrame:
        return self.search(needle).select(F.col(self.key).alias(out))


def build_trigram_index(rows: DataFrame, key: str, cols: Sequence[str], ranges: int | None = None) -> TrigramIndex:
    """Index the cells of ``cols`` (null cells hold nothing).  ``key`` must be
    unique and not null.  A row's grams are made distinct inside the row, so
    no gram has more postings than there are rows, and hot grams are cut."""
    stored = write_ranged(rows, [F.col(key)], "search-rows", ranges, split=True)
    cells = F.array_distinct(F.flatten(F.array_compact(F.array(*[grams(F.lower(col_(c).cast("string"))) for c in cols]))))
    posted = stored.all_rows().select(F.col(key).alias("key"), F.col(PART).alias("home"), F.explode(cells).alias("gram"))
    # At most one gram starts at each character: a bound that no gram is cut for.
    chars = sum((F.coalesce(F.length(col_(c).cast("string")), F.lit(0)).cast("bigint") for c in cols), F.lit(0).cast("bigint"))
    most = stored.all_rows().agg(F.sum(chars)).first()[0] or 0
    postings = write_ranged(posted.select("gram", "key", "home"), [F.col("gram"), F.col("key")], "search-postings", ranges,
                            split=True, leading="gram", rows=most)
    counts = postings.all_rows().groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    frequencies = write_ranged(counts, [F.col("gram")], "search-frequencies", split=True, leading="gram")
    return TrigramIndex(stored, key, tuple(cols), postings, frequencies)


def search_facts_indexed(numbers: TrigramIndex, subjects: TrigramIndex, items: TrigramIndex, needle: str,
                         spec: StarSpec = DEFAULT_SPEC) -> DataFrame:
    """B3 over the listing: the facts whose number, subject or item matches.

    ``numbers`` indexes the facts.  Where neither a subject nor an item
    matches, only the files that hold matching numbers are read; otherwise
    the facts are read once, and a row stays if one of its three keys is in
    the key set of that index."""
    s_hit = materialize(subjects.matching_keys(needle, "_s_hit"), name="search-keys")
    i_hit = materialize(items.matching_keys(needle, "_i_hit"), name="search-keys")
    if s_hit.isEmpty() and i_hit.isEmpty():
        return numbers.search(needle)
    n_hit = numbers.matching_keys(needle, "_n_hit")
    fact = numbers.rows.all_rows().select(*numbers.rows.columns)
    f = fact.join(s_hit, fact[spec.fact_subject] == s_hit["_s_hit"], "left")
    f = f.join(i_hit, f[spec.fact_catalog] == i_hit["_i_hit"], "left")
    f = f.join(n_hit, f[spec.fact_key] == n_hit["_n_hit"], "left")
    hit = F.col("_s_hit").isNotNull() | F.col("_i_hit").isNotNull() | F.col("_n_hit").isNotNull()
    return f.filter(hit).select(*numbers.rows.columns)
