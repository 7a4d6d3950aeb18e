"""Bottom-k document fingerprints with built-in functions only (operator 10).

A text's fingerprint is the ascending list of the k smallest distinct hashes
of its five-word shingles.  Fingerprints merge across parts of a text
collection (the k smallest of the union) and estimate resemblance,
containment and the number of distinct shingles.

Defined results: words are what white space separates, lower-cased; a text
of one to four words has one shingle (all its words); a text without words
has an empty fingerprint, which is like another empty one (1.0) and unlike
any other (0.0); null text counts as ''.  Rows that repeat both id and text
are one document; a null id sorts last in descending order; of equal ids the
text with the smaller hash comes first.  An empty table gives an empty frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger.llm.common import text_or_empty, written

K = 64
WORDS = 5
LEAST = -(1 << 63)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<bigint>: the k smallest distinct shingle hashes, ascending."""
    ws = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashed = F.transform(ws, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        rolling = F.transform(F.slice(h, 1, F.greatest(n - words + 1, F.lit(1))),
                              lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, words)]))
        return F.when(n > 0, rolling).otherwise(F.array().cast("array<bigint>"))

    # a one-element transform names the hash array, so that it is made once
    made = F.flatten(F.transform(F.array(hashed), shingles))
    return F.slice(F.sort_array(F.array_distinct(made)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest hashes of the union that both sides hold."""
    u = merge(a, b, k)
    both = F.size(F.array_intersect(u, F.array_intersect(a, b)))
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u).cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k hashes, else (k - 1) / (k-th smallest as a share of the range)."""
    kth = (F.get(a, F.lit(k - 1)).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: |A & B| / |A|."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def merge_groups(fingerprints: DataFrame, by: list[str], col: str = "fp", k: int = K) -> DataFrame:
    """One fingerprint for each group: at most k hashes of a group and task
    are shuffled beyond what map-side distinct leaves, no text is."""
    w = Window.partitionBy(*by).orderBy("h")
    h = fingerprints.select(*by, F.explode(col).alias("h")).distinct()
    return (h.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
            .groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(col)))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.hex(x))), ",")


def successors(docs: DataFrame) -> DataFrame:
    """(id, h, n, next_id, next_h): who follows in descending id order, the
    first after the last.  Only ids, text hashes and lengths move.

    The keys are range-partitioned and written, so that the number of the
    partition is fixed.  Windows run inside a partition; one row for each
    partition, its first key, links the partitions.
    """
    keys = docs.select("id", "h", F.length("text").cast("bigint").alias("n")).distinct()
    ranged = written(keys.repartitionByRange(F.desc("id"), F.asc("h")).withColumn("part", F.spark_partition_id()), "fp-order")
    order = [F.desc("id"), F.asc("h")]
    inside = Window.partitionBy("part").orderBy(*order)
    first = (ranged.withColumn("r", F.row_number().over(inside)).filter("r = 1")
             .select("part", F.struct("id", "h").alias("k")))
    links = Window.orderBy("part")  # one row for each partition
    first = first.select("part", "k", F.lead("k").over(links).alias("after"),
                         F.first("k").over(links).alias("top"))
    linked = first.select(F.col("part").alias("p"), F.coalesce("after", "top").alias("follows"))
    out = (ranged.withColumn("next", F.lead(F.struct("id", "h")).over(inside))
           .join(linked, F.col("part") == F.col("p"))
           .withColumn("next", F.coalesce("next", "follows")))
    return out.select("id", "h", "n", F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h"))


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The edited text has the last floor(n_chars / 3) code points replaced by
    the first as many (or all) of the next document in descending id order.
    Whole texts are shuffled once, by (id, hash); both joins read that one
    exchange (nothing is computed or renamed below it, so that its plan is the same
    for both).  The next document's side then sends a prefix and a fingerprint.
    """
    base = (docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("id"),
                        text_or_empty().alias("text"))
            .withColumn("h", F.xxhash64("text")))
    order = successors(base)
    texts = base.select("id", "h", "text")
    wanted = order.select(F.col("id").alias("for_id"), F.col("h").alias("for_h"), "n", F.col("next_id").alias("id"), F.col("next_h").alias("h"))
    sent = (texts.join(wanted, ["id", "h"])
            .select(F.col("for_id").alias("id"), F.col("for_h").alias("h"), F.expr("substring(text, 1, cast(n div 3 as int))").alias("prefix"),
                    sketch(F.col("text"), k).alias("next_fp"))
            .dropDuplicates(["id", "h"]))
    both = texts.join(sent, ["id", "h"])
    n = F.length("text").cast("bigint")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(length(text) div 3 as int))"), F.col("prefix"))
    rows = both.select(F.when(F.col("id") != LEAST, F.col("id")).alias("doc_id"), n.alias("n_chars"), edited.alias("edited"), "text", "next_fp")
    rows = rows.withColumns({"fp": sketch(F.col("text"), k), "edited_fp": sketch(F.col("edited"), k)})
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"),
        distinct_shingles(F.col("fp"), k).alias("shingles_est"),
        containment(F.col("fp"), F.col("edited_fp"), k).alias("contained_in_edited"))
