"""Exact top-k search by exhaustive term-at-a-time accumulation (operator 5).

A vector is a sparse row of (term, integer weight).  A block of candidate
rows is held as an inverted index: for each term, the postings of rows whose
weight is not zero.  A block of query rows is accumulated term by term: the
weighted postings of a term are scattered into the dense score array of
every query that has the term.  Each (query block, candidate block) task
keeps its k best by partition selection; the blocks of a query are merged.

Every query block meets every candidate block through a join on block
numbers, so no side is broadcast and a task holds one block of each.

Defined results: vectors that are null or hold a null or non-finite
component take no part; missing trailing components count as 0; repeated
rows with one id and equal vectors count once; of repeated ids with other
vectors each row is a candidate, and a query never returns its own id; an
empty table gives an empty frame; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "query_id bigint, query_key bigint, vec_id bigint, score bigint"


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component as a double."""
    ok = (F.col("v").isNotNull() & F.col("vec_id").isNotNull()
          & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return (vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter(F.coalesce(ok, F.lit(False)))
            .select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("q"))
            .distinct())


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max((len(r) for r in rows), default=0)
    m = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    return m


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores of all query rows against all rows of the block, term by term."""
    scores = np.zeros((len(queries), len(block)), np.int64)
    for term in range(min(queries.shape[1], block.shape[1])):
        with_term = np.flatnonzero(queries[:, term])
        posted = np.flatnonzero(block[:, term])
        if not len(with_term) or not len(posted):
            continue
        weights = block[posted, term]
        whole = len(posted) * 10 >= 9 * len(block)  # nearly every row is posted: its zeros may be added too
        if whole:
            weights = block[:, term]
        for i in with_term:
            if whole:
                scores[i] += queries[i, term] * weights
            else:
                scores[i, posted] += queries[i, term] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids: a partition
    selection, then a sort of what reaches the k-th score."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _task(k: int, chunk: int = 64):
    def run(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(block):
            ids, m = block["vec_id"].to_numpy(np.int64), _matrix(block["q"])
            qids, qkeys, q = queries["vec_id"].to_numpy(np.int64), queries["key"].to_numpy(np.int64), _matrix(queries["q"])
            for lo in range(0, len(q), chunk):
                scores = accumulate(q[lo:lo + chunk], m)
                for i in range(len(scores)):
                    others = np.flatnonzero(ids != qids[lo + i])
                    own, own_ids = scores[i][others], ids[others]
                    at = best(own, own_ids, k)
                    out += [(qids[lo + i], qkeys[lo + i], own_ids[j], own[j]) for j in at]
        return pd.DataFrame(out, columns=["query_id", "query_key", "vec_id", "score"])
    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """The k rows of highest inner product for each query row.

    Both frames hold (vec_id, q).  Two counts fix the numbers of blocks.
    """
    n_rows, n_queries = rows.count(), queries.count()
    blocks, groups = max(1, -(-n_rows // block_rows)), max(1, -(-n_queries // query_rows))
    key = F.xxhash64("vec_id", "q")
    q = (queries.withColumn("key", key).withColumn("g", F.pmod(F.col("key"), F.lit(groups)).cast("int"))
         .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    r = (rows.withColumn("b", F.pmod(F.xxhash64("vec_id", "q", F.lit(7)), F.lit(blocks)).cast("int"))
         .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    part = q.groupBy("g", "b").cogroup(r.groupBy("g", "b")).applyInPandas(_task(k), OUT)
    w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
