"""Substring dedup by sliding sentence spans (operator 3).

A text is cut after sentence ends and line breaks, and after the word of
smallest hash in each window of ``CUT`` words.  So two cuts are at most
``CUT`` words apart, and whether a word is one depends on the ``CUT`` - 1
words on either side only: a passage is cut alike wherever it stands, but for
its first and last words.  The span that starts at a piece ("sentence" below)
covers ``RUN`` of them and goes on until it holds ``MIN_WORDS`` words; every
run of 50 words holds one whose cuts do not depend on what is around it.  Span hashes are joined over all documents; sentences
that lie in a repeated span which is not its first occurrence (smallest id,
then position) are removed.

Defined results: null text stays null; a text too short for one span, and
every text without a repeated span, comes back unchanged; a null id sorts
first; rows that repeat id and text count as one document and all get its
result; an empty table gives an empty frame; case and white space do not
matter in comparisons; other columns pass through.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import forget, written

RUN, MIN_WORDS, CUT = 3, 12, 8
LEAST = -(1 << 63)
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
WORD = re.compile(r"\S+")
B1, B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
I1, I2 = pow(B1, -1, 1 << 64), pow(B2, -1, 1 << 64)


def _cuts(words: list[str]) -> np.ndarray:
    """Whether a word is the smallest by hash, the last of equals, in a window of ``CUT``."""
    cut = np.zeros(len(words), bool)
    if len(words) >= CUT:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        windows = np.lib.stride_tricks.sliding_window_view(h[::-1], CUT)
        cut[len(h) - 1 - (np.arange(len(windows)) + windows.argmin(axis=1))] = True
    return cut


def _word_ends(text: str, start: int, end: int) -> list[int]:
    part = text[start:end]
    sizes = [len(w) for w in part.split()]
    first = end - len(part.lstrip())
    if sum(sizes) + len(sizes) - 1 == len(part.strip()):  # one character between any two words
        return [at - 1 for at in accumulate((n + 1 for n in sizes), initial=first)][1:]
    return [m.end() for m in WORD.finditer(text, start, end)]


def _pieces(text: str):
    """(end, words) of each sentence or part of one."""
    parts = [(m.start(), m.end(), text[m.start():m.end()].lower().split()) for m in SENTENCE.finditer(text)]
    cut, at = _cuts([w for _, _, words in parts for w in words]).tolist(), 0
    for start, end, words in parts:
        inner, lo = cut[at:at + max(len(words) - 1, 0)], 0
        at += len(words)
        if True in inner:  # only then the places of the words matter
            ends = _word_ends(text, start, end)
            for k, c in enumerate(inner, 1):
                if c:
                    yield ends[k - 1], words[lo:k]
                    lo = k
        yield end, words[lo:]


def sentences(text: str) -> tuple[list[int], list[int], list[int]]:
    """Ends, numbers of words and hashes of the text's sentences.  What has
    no words belongs to the sentence before; the ends cover the whole text."""
    ends, counts, hashes = [], [], []
    for end, words in _pieces(text):
        if not words and ends:
            ends[-1] = end
        elif words:
            ends.append(end)
            counts.append(len(words))
            hashes.append(xxhash.xxh3_64_intdigest(" ".join(words)))
    return ends, counts, hashes


def spans(counts: list[int], hashes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, end sentence and two hashes of every span."""
    n = len(counts)
    total = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(n)
    end = np.maximum(first + RUN, np.searchsorted(total, total[:-1] + MIN_WORDS))
    first = first[end <= n]
    end = end[end <= n]
    h = np.array(hashes, np.uint64)

    def rolled(base: int, inverse: int, x: np.ndarray) -> np.ndarray:
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base, np.uint64)))
        back = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, inverse, np.uint64)))
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[:n], dtype=np.uint64)])
        v = (s[end] - s[first]) * back[first] + (end - first).astype(np.uint64)
        v = (v ^ (v >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(29))

    return first, end, rolled(B1, I1, h).view(np.int64), (rolled(B2, I2, h ^ (h >> np.uint64(17))) >> np.uint64(33)).astype(np.int32)


def span_rows(docs: DataFrame) -> DataFrame:
    """(id, th, i, h, g): the first sentence and hashes of every span, once a
    text; a row with i = -1, whose h is the number of sentences; and for each later
    place of a span in its own text, i = -2 - place."""
    def run(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                ends, counts, hashes = sentences(text)
                i, h, g = [-1], [len(ends)], [0]
                if len(counts) >= RUN:
                    at, _, h1, h2 = spans(counts, hashes)
                    own = np.zeros(len(at), bool)
                    own[np.unique(h1 ^ (h2.astype(np.int64) << 32), return_index=True)[1]] = True
                    i, h, g = np.append(i, np.where(own, at, -2 - at)), np.append(h, np.where(own, h1, 0)), np.append(g, np.where(own, h2, 0))
                rows.append((i, h, g))
            if rows:
                sizes = [len(r[0]) for r in rows]
                i, h, g = (np.concatenate([r[k] for r in rows]) for k in range(3))
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), sizes), "th": np.repeat(b["th"].to_numpy(), sizes), "i": i, "h": h, "g": g})
    return docs.mapInPandas(run, "id bigint, th bigint, i int, h bigint, g int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with cleaned text, and n_sentences__, n_removed__ (bigint)."""
    ids = docs.select(F.col(id_col).cast("bigint").alias("id"))
    unique = ids.groupBy("id").count().filter("count > 1").isEmpty()
    # A text hash joins the key only where ids repeat.
    th = F.lit(0).cast("bigint") if unique else F.coalesce(F.xxhash64(text_col), F.lit(0))
    key = [F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST)).alias("id"), th.alias("th")]
    rows = written(span_rows(docs.filter(F.col(text_col).isNotNull()).select(*key, F.col(text_col).alias("text"))), "spans")
    # place: where a span starts; the smallest is its first occurrence
    # written, so that the join reads plain exchanges and a frequent span's rows can be split
    placed = rows.filter("i >= 0").drop("th") if unique else rows.filter("i >= 0")
    # A text has a span once among these rows: the first text is the first place.
    where = F.col("id") if unique else F.struct("id", "th")
    repeated = written(placed.groupBy("h", "g").agg(F.min(where).alias("first"), F.count("*").alias("n"))
                       .filter("n > 1").select("h", "g", "first"), "repeats")
    later = placed.join(repeated, ["h", "g"]).filter(where != F.col("first")).select("id", (F.lit(0).cast("bigint") if unique else F.col("th")).alias("th"), "i")
    cover = (later.union(rows.filter("i < -1").select("id", "th", (-2 - F.col("i")).alias("i")))
             .groupBy("id", "th").agg(F.collect_set("i").alias("cover")))
    # Written, so that the span tables go before the texts are shuffled.
    counted = written(rows.filter("i = -1").groupBy("id", "th").agg(F.max("h").alias("n")).join(cover, ["id", "th"], "left"), "cover")
    forget(rows, repeated)
    # Input columns go by number inside, so that no name of theirs can clash.
    names = [c for c in docs.columns if c.lower() not in ("n_sentences__", "n_removed__")]
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *[k.alias(f"key_{i}") for i, k in enumerate(key)])
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]
    text_at = f"c{names.index(text_col)}"
    same = (own["key_0"] == counted["id"]) & (own["key_1"] == counted["th"])
    joined = own.join(counted, same, "left").select(*[f"c{i}" for i in range(len(names))], "n", "cover")

    def run(batches):
        for b in batches:
            texts, total, gone = [], [], []
            for text, n, cover in zip(b[text_at], b["n"], b["cover"]):
                if text is None:
                    texts.append(None)
                    total.append(0)
                    gone.append(0)
                    continue
                total.append(int(n))
                if cover is None or not len(cover):
                    texts.append(text)
                    gone.append(0)
                    continue
                ends, counts, hashes = sentences(text)
                out = np.zeros(len(ends) + 1, np.int64)
                first, end, _, _ = spans(counts, hashes)
                out[first[cover]] += 1  # spans are numbered by their first sentence
                np.subtract.at(out, end[cover], 1)
                covered = np.cumsum(out)[:-1] > 0
                starts = [0, *ends[:-1]]
                texts.append("".join(text[s:e] for s, e, c in zip(starts, ends, covered) if not c))
                gone.append(int(covered.sum()))
            b = b.drop(columns=["n", "cover"])
            b[text_at] = texts
            yield b.assign(n_sentences=total, n_removed=gone)
    return joined.mapInPandas(run, ", ".join([*fields, "n_sentences bigint", "n_removed bigint"])).toDF(*names, "n_sentences__", "n_removed__")
