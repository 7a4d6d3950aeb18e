"""The corpus pipeline: language ID, near-dedup, substring dedup, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``.  ``docs`` is what the
stage before kept, written as Parquet and read back.  All but the last return
the columns of ``documents``.

Defined results: nulls, empty texts and repeated rows are handled as the
operators' docstrings say; documents without a readable language go in the
first stage; an empty table stays empty; columns that ``documents`` does not
have are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starledger.llm import langid, neardup, packing, substring
from starledger.llm.common import read, ship, written
from starledger.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that a language is predicted for; texts without a
    letter have none.  Without a labelled row to learn from all pass."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    model = langid.train(langid.training_rows(docs))
    return docs if model is None else langid.predict(docs, model).filter(F.col("lang_pred") != "und").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate class: its smallest id."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    kept = neardup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    own = docs.withColumn("key__", neardup.text_key(F.coalesce(F.col("text"), F.lit(""))))
    one = Window.partitionBy("doc_id", "key__").orderBy("source", "lang", "n_chars")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key__") == F.col("kept_key"))
    return (own.join(kept, same, "left_semi").withColumn("copy__", F.row_number().over(one))
            .filter("copy__ = 1").select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated sentence spans; documents of which nothing is
    left go."""
    ship(spark)
    done = substring.remove_repeats(docs.select(*COLUMNS))
    return (done.filter((F.col("n_removed__") == 0) | F.col("text").rlike(r"\S"))
            .withColumn("n_chars", F.when(F.col("n_removed__") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
            .select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1,024 tokens."""
    ship(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

# SQL cannot express a fitted classifier, sketches with alignment or greedy packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
