"""Helpers shared by the operators: input columns, written intermediates,
shipping the package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.session import scratch_path

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor costs a reread, and values drawn
    from task ids stay as they were written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables whose readers have all been written themselves."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession, batch_rows: int = 1000) -> None:
    """Make the package importable in the Python workers (once a session),
    and set how many rows a worker holds at a time: whole texts are long, so
    fewer than Spark's default of 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    base = tempfile.mkdtemp(prefix="starledger-py-")
    target = os.path.join(base, "starledger_llm_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(PACKAGE_ROOT):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE_ROOT)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n
