"""Registered queries of the subpackage: ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.llm import middle
from starledger.llm.common import read, ship


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starledger.llm import chat
    ship(spark)
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starledger.llm import langid
    ship(spark)
    return langid.identify(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starledger.llm import substring
    ship(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).withColumnsRenamed({"n_sentences__": "n_sentences", "n_removed__": "n_removed"})


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starledger.llm import packing
    ship(spark)
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starledger.llm import topk
    ship(spark)
    rows = topk.integer_rows(read(spark, sf_dir, "embeddings"))
    return topk.top_k(rows.filter(F.col("vec_id") % 50 == 0), rows)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starledger.llm import neardup
    ship(spark)
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).drop("key")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from starledger.llm import bpe
    ship(spark)
    return bpe.encode_digests(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starledger.llm import pitmanyor
    ship(spark, 10_000)
    return pitmanyor.score(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starledger.llm import tokencount
    ship(spark)
    return tokencount.token_counts(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starledger.llm import fingerprint
    return fingerprint.fingerprint_edits(read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(read(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starledger.llm import ruleset
    ship(spark)
    return ruleset.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starledger.llm import whitening
    ship(spark)
    return whitening.whitened_components(read(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_language_id, op3_substring_dedup, op4_packing, op5_top_k, op6_near_dedup, op7_bpe, op8_lm_score, op9_token_counts, op10_fingerprints,
    op11_fill_in_middle, op12_quality, op13_whitening)}
ORACLE = {"op5_top_k": OP5_SQL, "op11_fill_in_middle": middle.SQL}
