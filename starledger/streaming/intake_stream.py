"""File-drop intake and live monthly roll-up as Structured Streaming jobs.

The reference imports one uploaded sheet per request.  Here a folder of
staged sheets (Parquet or CSV of text cells with a ``row_number`` column,
as written by the staging step) is a streaming source; every micro-batch
runs the same set-based fact intake (H5/H6) against the current snapshot.

Exactly-once: each micro-batch writes its output under ``batch_id=<n>``
with ``overwrite``, so a retried batch replaces its own files and never
duplicates rows; the checkpoint location (shared storage) records progress.
Files of one batch are taken in the order of their paths; accepted rows and
outcomes name their ``source_file`` next to the row number they have in it.
Numbering continues densely across batches from a high-water mark: the
stored facts' largest number and id are read once when the stream starts,
and every batch appends one row (its largest number and id) to a tiny
``hwm`` table, so a batch never rescans the fact history.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from starledger.functions.predicates import in_year
from starledger.functions.scalars import month_text, seq_suffix
from starledger.operators.intake import import_facts
from starledger.operators.joins import with_catalog
from starledger.session import checkpoint_dir
from starledger.sources.sheets import ROW_COL, stage_rows
from starledger.spec import DEFAULT_SPEC, StarSpec

ROWS_PER_FILE = 1 << 40
FACT_SHEET_COLUMNS = ("incident_date", "student_no", "offense_code", "action_taken", "status",
                      "reported_by", "notes")
FACT_SHEET_SCHEMA = T.StructType(
    [T.StructField("row_number", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in FACT_SHEET_COLUMNS]
)


def _exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a readable Parquet table (schema only, no rows read)."""
    try:
        spark.read.parquet(path).schema  # noqa: B018 - resolves the files, reads no rows
        return True
    except AnalysisException as e:
        # any other failure must stop the batch: without the marks numbers would repeat
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def file_ranks(batch: DataFrame) -> DataFrame:
    """(source_file, rank): the files of one batch, one row each, by path."""
    return batch.select("source_file").distinct().withColumn("rank", F.row_number().over(Window.orderBy("source_file")) - 1)


def in_own_file(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a batch with their file and the row number they have in it."""
    return (rows.withColumn("rank", F.floor(F.col(ROW_COL) / ROWS_PER_FILE).cast("int")).join(files, "rank", "left").drop("rank")
            .withColumn(ROW_COL, F.col(ROW_COL) % ROWS_PER_FILE))


def start_fact_intake(spark: SparkSession, source_dir: str, subject: DataFrame, catalog: DataFrame,
                      base_facts: DataFrame, out_dir: str, spec: StarSpec = DEFAULT_SPEC,
                      fmt: str = "parquet", checkpoint_location: str | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Stream staged fact sheets from ``source_dir`` into ``out_dir``.

    Writes ``out_dir/facts/batch_id=<n>`` (accepted rows) and
    ``out_dir/outcomes/batch_id=<n>`` (row, outcome, message) per batch.
    """
    reader = spark.readStream.schema(FACT_SHEET_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    stream = reader.format(fmt).load(source_dir).select("*", F.col("_metadata.file_path").alias("source_file"))
    facts_dir = os.path.join(out_dir, "facts")
    outcomes_dir = os.path.join(out_dir, "outcomes")
    hwm_dir = os.path.join(out_dir, "hwm")
    if checkpoint_location is None:
        checkpoint_location = os.path.join(checkpoint_dir(spark), "fact-intake-" + os.path.basename(out_dir))
    # One bounded row, read once: the stored facts' largest number and id.
    base = base_facts.agg(
        F.coalesce(F.max(seq_suffix(spec.fact_no, spec.fact_prefix)), F.lit(0)).alias("no"),
        F.coalesce(F.max(spec.fact_key), F.lit(0)).alias("id")).first()

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        no, fid = F.lit(base["no"]), F.lit(base["id"])
        if _exists(spark, hwm_dir):
            # Marks of earlier batches (a retried batch ignores its own).
            prev = spark.read.parquet(hwm_dir).filter(F.col("batch_id") != batch_id) \
                .agg(F.max("no").alias("no"), F.max("id").alias("id"))
            no = F.greatest(no, F.coalesce(prev.select("no").scalar(), F.lit(0)))
            fid = F.greatest(fid, F.coalesce(prev.select("id").scalar(), F.lit(0)))
        files = file_ranks(batch)
        place = (F.col("rank") * ROWS_PER_FILE + F.col(ROW_COL)).alias(ROW_COL)
        rows = batch.join(files, "source_file").select(place, *FACT_SHEET_COLUMNS)
        res = import_facts(stage_rows(rows), subject, catalog, None, spec, base_no=no, base_id=fid)
        acc = in_own_file(res.accepted, files)
        acc.write.mode("overwrite").parquet(f"{facts_dir}/batch_id={batch_id}")
        in_own_file(res.outcomes, files).write.mode("overwrite").parquet(f"{outcomes_dir}/batch_id={batch_id}")
        written = spark.read.parquet(f"{facts_dir}/batch_id={batch_id}")
        mark = written.agg(F.max(seq_suffix(spec.fact_no, spec.fact_prefix)).alias("no"),
                           F.max(spec.fact_key).alias("id"))
        mark.select(F.coalesce("no", no).alias("no"), F.coalesce("id", fid).alias("id")) \
            .write.mode("overwrite").parquet(f"{hwm_dir}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def start_monthly_rollup(spark: SparkSession, facts_dir: str, catalog: DataFrame, out_dir: str,
                         year: int | None = None, spec: StarSpec = DEFAULT_SPEC,
                         checkpoint_location: str | None = None, available_now: bool = True) -> StreamingQuery:
    """D4 over a growing fact folder: per-month totals kept as streaming state
    (one group per month, so state is bounded by the months seen) and the
    full table rewritten to ``out_dir`` after every micro-batch."""
    schema = spark.read.parquet(facts_dir).schema
    stream = spark.readStream.schema(schema).parquet(facts_dir)
    if year is not None:
        stream = stream.filter(in_year(spec.fact_date, year))
    # The catalog is a static side: broadcast only behind the bounded check.
    f = with_catalog(stream.select(spec.fact_date, spec.fact_catalog), catalog, spec,
                     (spec.category, spec.points))
    agg = f.groupBy(month_text(spec.fact_date).alias("month")).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col(spec.category) == spec.minor, 1).otherwise(0)).cast("bigint").alias("minor"),
        F.sum(F.when(F.col(spec.category) == spec.major, 1).otherwise(0)).cast("bigint").alias("major"),
        F.coalesce(F.sum(spec.points), F.lit(0)).cast("bigint").alias("points"),
    )
    if checkpoint_location is None:
        checkpoint_location = os.path.join(checkpoint_dir(spark), "monthly-rollup-" + os.path.basename(out_dir))

    def write_table(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_dir)

    writer = agg.writeStream.outputMode("complete").foreachBatch(write_table) \
        .option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
