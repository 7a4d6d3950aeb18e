"""Deep paging over a standing order index (E2/E8), and ranks as a column.

``order by .. offset .. limit`` sorts the top ``(p + 1) * n`` rows of the
whole table for page ``p``; the last page sorts everything.  A ``PageIndex``
sorts once, into written ranges (``operators.ranged``); a page is then a seek
by position: the running counts of the ranges name the few files that hold
it, whatever its depth.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.operators.ordering import page_numbers
from starledger.operators.ranged import RangedTable, write_ranged
from starledger.spec import PAGE_SIZE


@dataclass(frozen=True)
class PageIndex:
    """Rows of one snapshot in a total order; pages count from 0."""

    table: RangedTable
    size: int = PAGE_SIZE

    def page(self, p: int) -> DataFrame:
        """Page ``p`` with each row's ``rank`` (from 0), in order; a page beyond
        the last one is empty."""
        if p < 0:
            raise ValueError("pages count from 0")
        return self.table.slice(p * self.size, self.size).orderBy("rank")

    def last_page(self) -> int:
        """Number of the last page (0 for an empty table); one count is read."""
        total = self.table.total().first()["total_rows"]
        return max((total - 1) // self.size, 0)

    def info(self, p: int) -> DataFrame:
        """Total rows, page count, first and last row of page ``p``, from the
        counts of the ranges alone."""
        return page_numbers(self.table.total(), p, self.size)


def build_page_index(df: DataFrame, order: Sequence[Column], size: int = PAGE_SIZE, ranges: int | None = None,
                     name: str = "page-index") -> PageIndex:
    """Sort ``df`` once.  ``order`` must end in a unique column."""
    return PageIndex(write_ranged(df, order, name, ranges, split=True), size)


def ranked(df: DataFrame, order: Sequence[Column], out: str = "rank_no", ranges: int | None = None) -> DataFrame:
    """Every row with its place (from 1) in ``order``, which must be total."""
    return write_ranged(df, order, "ranked", ranges).numbered(out, 1)
