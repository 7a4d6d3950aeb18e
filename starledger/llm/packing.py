"""Sequence packing by lexical retrieval (operator 4).

Documents are encoded and closed by one end id.  Whole windows of a long
document are sequences of their own; what is left (less than a window) is an
item.  Items are dealt by range of their most telling term, and each task
cuts its stream into shards of ``SHARD`` items with a BM25 inverted index
each.  An unused item is the seed of the next window; the index returns its
unused neighbours by BM25 score over all terms of the seed, which fill the window greedily.  The last
one is cut where the window ends, and its rest stays unused.  Only the last
window of a shard can need padding.

Document frequencies and mean length are counted over all items; they are
one number for each vocabulary entry, however many documents there are.

Defined results: null text counts as '' (one piece, the end id); copies and
repeated rows are packed like any others; an empty table gives an empty
frame; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import forget, text_or_empty, written

WINDOW = 1024
END_ID = 0
SHARD = 2048
COMMON = 64  # items of a shard; terms in more have a dense row
K1, B = 1.2, 0.75
PIECE = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
         "sequence_id bigint, offset bigint")
ITEM = "doc_id bigint, doc_tokens bigint, crcs array<bigint>, rest binary, terms binary, tf binary"


class Encoder:
    """ids of a byte-level BPE file for ``tokenizers``.

    If the file's merges are numbered like its vocabulary, they are run by
    ``tiktoken`` (several times faster, equal ids); else by ``tokenizers``.
    """

    # Fixed value: the public pattern that byte-level files of this kind use.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ()) if t.get("special")}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pre = spec.get("pre_tokenizer") or {}
        plain = {k: v for k, v in vocab.items() if k not in self.special}
        merged = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        in_order = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
                    and pre.get("use_regex", True) and not model.get("ignore_merges")
                    and [plain.get(a + b) for a, b in merged] == list(range(len(plain) - len(merged), len(plain))))
        self.fast = None
        if in_order:
            import tiktoken
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            back = {chr(b): b for b in shown}
            back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(back[c] for c in k): v for k, v in plain.items()}
            self.fast = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        else:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(path)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def items(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_tokens, crcs, rest, terms, tf): checksums of the whole
    windows, the ids that are left, and their distinct ids with counts, as
    little-endian numbers."""
    def run(batches):
        enc = encoder(path)
        kind, count = id_type(enc.size), id_type(window)
        for b in batches:
            n, crcs, rest, terms, tfs = [], [], [], [], []
            for t in b["text"]:
                ids = np.append(enc.encode(t), np.uint32(END_ID))
                full = len(ids) // window
                n.append(len(ids))
                crcs.append([crc(ids[i * window:(i + 1) * window]) for i in range(full)])
                left = ids[full * window:].astype(kind)
                t, tf = np.unique(left, return_counts=True)
                rest.append(left.tobytes())
                terms.append(t.tobytes())
                tfs.append(tf.astype(count).tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "doc_tokens": n, "crcs": crcs, "rest": rest, "terms": terms, "tf": tfs})
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
            .mapInPandas(run, ITEM))


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def term_statistics(rows: DataFrame, size: int) -> tuple[np.ndarray, int, float]:
    """Document frequency of each term over all items, items, mean length."""
    kind = id_type(size)

    def run(batches):
        df, n, length = np.zeros(size, np.int64), 0, 0
        for b in batches:
            for r, t in zip(b["rest"], b["terms"]):
                df[np.frombuffer(t, kind)] += 1
                n += len(t) > 0
                length += len(r) // np.dtype(kind).itemsize
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": [*at, -1, -2], "n": [*df[at], n, length]})
    got = rows.select("rest", "terms").mapInPandas(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df, n, length = np.zeros(size), 0, 0  # at most size + 2 rows
    for term, x in got.itertuples(index=False):
        if term == -1:
            n = int(x)
        elif term == -2:
            length = int(x)
        else:
            df[term] = x
    return df, n, length / max(n, 1)


class Index:
    """A BM25 inverted index over the items of one shard, each given by its
    distinct ids and their counts."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float):
        self.queries = [t for t, _ in bags]
        sizes = [len(t) for t in self.queries]
        terms, tf = (np.concatenate(x) for x in zip(*bags))
        docs = np.repeat(np.arange(len(bags)), sizes)
        tf = tf.astype(np.float64)
        lengths = np.bincount(docs, weights=tf)
        weights = idf[terms] * tf * (K1 + 1) / (tf + np.repeat(K1 * (1 - B + B * lengths / max(mean, 1e-9)), sizes))
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights = docs[order], weights[order]
        self.terms, self.at = np.unique(terms[order], return_index=True)
        self.at = np.append(self.at, len(terms))
        self.n = len(bags)
        common = np.flatnonzero(np.diff(self.at) > COMMON)
        self.row = np.full(len(self.terms), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n))
        for j, k in enumerate(common):
            own = slice(self.at[k], self.at[k + 1])
            self.dense[j, self.docs[own]] = self.weights[own]

    def scores(self, seed: int) -> np.ndarray:
        at = np.searchsorted(self.terms, self.queries[seed])
        row = self.row[at]
        out = self.dense[row[row >= 0]].sum(axis=0)
        for k in at[row < 0]:
            lo, hi = self.at[k], self.at[k + 1]
            out[self.docs[lo:hi]] += self.weights[lo:hi]
        return out


def best_first(score: np.ndarray, some: int = 32):
    """Items by falling score, ties by number.  The first few are sorted
    alone, and the others only if those are used up."""
    rest = np.arange(len(score))
    if len(score) > some:
        least = np.partition(score, -some)[-some]
        few, rest = np.flatnonzero(score >= least), np.flatnonzero(score < least)
        yield from few[np.argsort(-score[few], kind="stable")]
    yield from rest[np.argsort(-score[rest], kind="stable")]


def pack_shard(lengths: list[int], index: Index, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, first id, end id)."""
    left = np.array(lengths)
    taken = np.zeros(len(left), np.int64)
    out = []
    for seed in range(len(left)):
        while left[seed]:
            own, room = [(seed, int(taken[seed]), int(taken[seed] + left[seed]))], window - int(left[seed])
            left[seed] = 0
            if room:
                free = left > 0
                score = np.where(free, index.scores(seed), -1.0)
                for d in best_first(score):
                    if not room or not left[d]:
                        break
                    n = min(room, int(left[d]))
                    own.append((int(d), int(taken[d]), int(taken[d]) + n))
                    taken[d] += n
                    left[d] -= n
                    room -= n
            out.append(own)
    return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset); every id of every document lies in exactly one."""
    size = encoder(path).size
    kind = id_type(size)
    count = id_type(window)
    rows = written(items(docs, path, window), "pack-items")
    df, n, mean = term_statistics(rows, size)
    shared = docs.sparkSession.sparkContext.broadcast(np.log(1.0 + (n - df + 0.5) / (df + 0.5)))

    def route(batches):
        idf = shared.value
        for b in batches:
            key = []
            for terms, tfs in zip(b["terms"], b["tf"]):
                t, tf = np.frombuffer(terms, kind), np.frombuffer(tfs, count)
                key.append(int(t[np.argmax(idf[t] * tf / (tf + K1))]) if len(t) else -1)
            yield b.assign(term=key, doc_id=b["doc_id"].astype("Int64"))

    def run(batches):
        idf = shared.value
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def flush():
            nonlocal number
            out = []
            ids = [np.frombuffer(r[3], kind) for r in held]
            for doc, total, crcs, *_ in held:
                for i, c in enumerate(crcs):
                    out.append((doc, i * window, window, int(c), total, number, 0))
                    number += 1
            some = [i for i, x in enumerate(ids) if len(x)]
            if some:
                own = [ids[i] for i in some]
                bags = [(np.frombuffer(held[i][4], kind), np.frombuffer(held[i][5], count)) for i in some]
                for sequence in pack_shard([len(x) for x in own], Index(bags, idf, mean), window):
                    at = 0
                    for d, lo, hi in sequence:
                        doc, total, crcs, *_ = held[some[d]]
                        out.append((doc, len(crcs) * window + lo, hi - lo, crc(own[d][lo:hi]), total, number, at))
                        at += hi - lo
                    number += 1
            held.clear()
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])
            return frame.astype({"doc_id": "Int64"})

        for b in batches:
            for r in zip(b["doc_id"].astype("Int64").astype(object).where(b["doc_id"].notna(), None), b["doc_tokens"], b["crcs"], b["rest"], b["terms"], b["tf"]):
                held.append(r)
                if len(held) >= shard:
                    yield flush()
        if held:
            yield flush()

    routed = rows.mapInPandas(route, ITEM + ", term int")
    routed = written(routed.withColumn("o", F.xxhash64("doc_id", "rest")), "pack-routed")
    forget(rows)
    parts = max(1, -(-n // (2 * shard)))
    return (routed.repartitionByRange(parts, "term", "o").sortWithinPartitions("term", "o", "doc_id")
            .select("doc_id", "doc_tokens", "crcs", "rest", "terms", "tf").mapInPandas(run, PIECE))
