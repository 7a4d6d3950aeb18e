"""Staged spreadsheet rows (A2-A4).

A sheet arrives as delimited text (or Parquet written by an upstream tool)
with one header row.  Every cell is read as a string; the physical row number
(header = row 1, first data row = 2) is kept, blank rows are dropped but still
counted in the numbering.  Headers are slugged and aliased as metadata only.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starledger.functions.scalars import header_slug, strip_text
from starledger.operators.ranged import materialize, running_before
from starledger.operators.windows import number_rows
from starledger.spec import HEADER_ALIASES, MSG_MISSING_COLUMNS

ROW_COL = "row_number"


def normalize_headers(df: DataFrame, aliases: Mapping[str, str] = HEADER_ALIASES,
                      keep: Iterable[str] = (ROW_COL,)) -> DataFrame:
    """A3: rename columns to their slugged/aliased header; columns whose slug
    is empty are dropped; when two headers map to one name the later wins."""
    keep = set(keep)
    chosen: dict[str, str] = {}
    for c in df.columns:
        if c in keep:
            chosen[c] = c
            continue
        slug = header_slug(c, aliases)
        if slug:
            chosen[slug] = c  # later duplicate overwrites the earlier one
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in chosen.items()])


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    """A4: raise when required headers are missing (no Spark job runs)."""
    labels = {name: name.replace("_", " ").title() for name in required if name not in df.columns}
    if labels:
        raise ValueError(MSG_MISSING_COLUMNS.format(", ".join(labels[name] for name in sorted(labels))))


def stage_rows(raw: DataFrame, row_col: str | None = ROW_COL) -> DataFrame:
    """A2: keep non-blank rows with their physical row number.

    ``raw`` holds string cells.  When it has no ``row_col``, the number is
    derived from scan order (dense index + 1, since the header is row 1).
    A row is blank when every cell cleans to ''.
    """
    df = raw
    if row_col is None or row_col not in df.columns:
        df = number_rows(df, ROW_COL, start=2)
        row_col = ROW_COL
    cells = [c for c in df.columns if c != row_col]
    # A cell is blank when only whitespace remains; the OR short-circuits at
    # the first filled cell.
    filled = [F.coalesce(F.length(strip_text(F.col(c).cast("string"))) > 0, F.lit(False)) for c in cells]
    cond = filled[0]
    for f in filled[1:]:
        cond = cond | f
    return df.filter(cond)


def sheet_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of delimited text files, in parallel.

    A quoted cell may hold line ends, so whether a line begins a record
    depends on all quotes before it.  Files are read line by line in splits.
    A split's state map is small: for either state that it may begin in
    (outside or inside quotes) the state it ends in and how many records
    begin in it.  One row for each split is scanned in file order; then every line knows
    its record, and only lines that continue a record are gathered.

    A record with a quote that is never closed takes the rest of its file, as
    for any reader.  Line ends inside a cell are read as ``\\n``.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        meta.getField("file_path").alias("file"), meta.getField("file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("_quotes"))
    # The lines keep their split's order on disk, and are read several times.
    lines = materialize(lines, name="sheet-lines")
    inside = Window.partitionBy("file", "_block").orderBy("_line")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_odd", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2)
    maps = lines.groupBy("file", "_block").agg(
        F.sum("_quotes").alias("_q"), F.count_if(F.col("_odd") == 0).alias("_outside"), F.count_if(F.col("_odd") == 1).alias("_inside"))
    in_file = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumn("_enters", F.coalesce(F.sum("_q").over(in_file), F.lit(0)) % 2)
    begun = F.when(F.col("_enters") == 0, F.col("_outside")).otherwise(F.col("_inside"))
    maps = maps.withColumn("_begun", begun).withColumn("_before", F.coalesce(F.sum("_begun").over(in_file), F.lit(0)))
    at = F.broadcast(maps.select("file", "_block", "_enters", "_before"))  # one row for each split
    lines = lines.join(at, ["file", "_block"])
    starts = (F.col("_odd") + F.col("_enters")) % 2 == 0
    lines = lines.withColumn("_starts", starts)
    lines = lines.withColumn("record", (F.col("_before") + F.count_if("_starts").over(inside)).cast("bigint"))
    more = lines.filter(~F.col("_starts")).groupBy("file", "record") \
        .agg(F.array_sort(F.collect_list(F.struct("_block", "_line", "value"))).alias("_more"))
    first = lines.filter("_starts").select("file", "record", "value")
    tail = F.array_join(F.transform("_more", lambda x: x["value"]), "\n")
    return first.join(more, ["file", "record"], "left").select(
        "file", "record", F.when(F.col("_more").isNull(), F.col("value")).otherwise(F.concat("value", F.lit("\n"), tail)).alias("text"))


def read_sheet(spark: SparkSession, path: str, fmt: str = "csv",
               aliases: Mapping[str, str] = HEADER_ALIASES, sep: str = ",") -> DataFrame:
    """Read staged sheet files: in each a header row, then data rows.

    CSV: records are found by ``sheet_records`` and parsed with the built-in
    ``from_csv`` into positional string cells.  Quoted cells may hold
    separators, doubled quotes and line ends.  Blank rows count in the numbering
    (header = row 1).  Cells beyond the header width are ignored; missing
    cells are NULL.  Several files are read as sheets pasted below each other in the
    order of their paths, each under its own header; row numbers go on.
    Parquet: a table of text cells with a ``row_number`` column.
    Headers are slugged/aliased (later duplicates win); blank rows dropped.
    """
    if fmt != "csv":
        raw = spark.read.parquet(path)
        raw = raw.select(*[F.col(f"`{c}`").cast("string").alias(c) if c != ROW_COL else F.col(c)
                           for c in raw.columns])
        has_rows = ROW_COL in raw.columns
        return stage_rows(normalize_headers(raw, aliases), ROW_COL if has_rows else None)
    records = materialize(sheet_records(spark, path), name="sheet-records")
    # One row for each file: its header and how many records come before it.
    files = records.groupBy("file").agg(F.max("record").alias("_n"), F.max(F.when(F.col("record") == 1, F.col("text"))).alias("_header"))
    files = materialize(running_before(files, "file", "_n", "_rows"), name="sheet-files")
    layouts = [r["_header"] for r in files.select("_header").distinct().orderBy("_header").collect()]
    if not layouts:
        raise ValueError("The first worksheet is empty")
    out = None
    for header in layouts:  # the different headers, usually one
        headers = next(csv.reader(io.StringIO(header, newline=""), delimiter=sep), [])
        last_pos = {slug: i for i, slug in enumerate(header_slug(h, aliases) for h in headers) if slug}  # later duplicate wins
        ddl = ", ".join(f"_c{i} STRING" for i in range(max(len(headers), 1)))
        own = F.broadcast(files.filter(F.col("_header") == header).select("file", "_rows"))  # one row for each file
        rows = records.filter(F.col("record") > 1).join(own, "file")
        cells = F.from_csv(F.col("text"), ddl, {"sep": sep, "mode": "PERMISSIVE", "escape": '"'})
        parsed = rows.select((F.col("_rows") + F.col("record")).alias(ROW_COL), cells.alias("_r"))
        df = parsed.select(ROW_COL, *[F.col(f"_r._c{i}").alias(slug) for slug, i in last_pos.items()])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return stage_rows(out, ROW_COL)
