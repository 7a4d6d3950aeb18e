"""Byte-level BPE by a hierarchical-bitmap rank queue (operator 7).

A pre-token is a linked list of byte spans.  Each adjacent pair whose bytes
are a token waits in the bucket of that token's rank.  A bitmap of three
levels marks the buckets that hold entries: find-first-set in the top level,
then in the word below, and so on, gives the lowest rank without a search.
Buckets give the leftmost position first.  A merge makes the entries of the
neighbouring pairs stale; they are skipped when they come up.  A pre-token of
n bytes costs O(n log n) at most, whatever its length.

Defined results: null text counts as ''; every match of the pattern is
encoded by itself; no special tokens; an empty table gives an empty frame;
repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import collections
import hashlib
import heapq

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import text_or_empty

OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


# Fixed value: the public pattern whose matches hold at most one leading space.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE_RUN = regex.compile(r" (?:\s|$)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels."""

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, at: int) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = [at]
        a = rank >> 6
        b = a >> 6
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def first(self) -> int:
        """The lowest rank that has a bucket: find-first-set, level by level."""
        x = self.top
        b = (x & -x).bit_length() - 1
        x = self.mid[b]
        a = (b << 6) + (x & -x).bit_length() - 1
        x = self.low[a]
        return (a << 6) + (x & -x).bit_length() - 1

    def close(self, rank: int) -> None:
        """Forget the empty bucket of ``rank``."""
        del self.buckets[rank]
        a = rank >> 6
        b = a >> 6
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)


class BytePairEncoder:
    """Encode and decode by merge ranks; remembers pre-tokens in two
    generations of up to ``memory`` (results do not depend on it)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 400_000):
        self.ranks, self.find, self.memory = ranks, regex.compile(pattern).findall, memory
        self.tokens = {v: k for k, v in ranks.items()}
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.young: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}
        self.spaced: dict[str, tuple[int, str, bytes]] = {}  # by word: of the word after a space
        self.by_words = pattern == WORD_PATTERN

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token.  All of them share one linked list and one
        queue; no pair reaches over a pre-token's end."""
        data = b"".join(pieces)
        n, get, queue = len(data), self.ranks.get, self.queue
        after = list(range(1, n + 3))
        before = list(range(-1, n + 1))
        pair = [-1] * (n + 1)
        token = [self.ranks[data[i:i + 1]] for i in range(n)]
        begins = bytearray(n + 2)
        begins[n] = 1
        starts, at = [], 0
        for p in pieces:
            starts.append(at)
            begins[at] = 1
            at += len(p)
        buckets, heappush, heappop = queue.buckets, heapq.heappush, heapq.heappop
        for p, at in zip(pieces, starts):
            whole = get(p)
            if whole is not None:
                token[at] = whole
                after[at] = at + len(p)
                continue
            for i in range(at, at + len(p) - 1):
                r = get(data[i:i + 2])
                if r is not None:
                    pair[i] = r
                    if r in buckets:
                        buckets[r].append(i)  # positions rise: a heap as it is
                    else:
                        queue.open(r, i)
        while queue.top:
            rank = queue.first()
            bucket, lowest = buckets[rank], rank
            while bucket and lowest >= rank:
                i = heappop(bucket)
                if pair[i] != rank:
                    continue  # stale: the pair has changed since
                j = after[i]
                k = after[j]
                after[i] = k
                before[k] = i
                token[i] = rank
                pair[j] = pair[i] = -1
                if not begins[k]:
                    r = get(data[i:after[k]])
                    if r is not None:
                        pair[i] = r
                        if r in buckets:
                            heappush(buckets[r], i)
                        else:
                            queue.open(r, i)
                        if r < lowest:
                            lowest = r
                if not begins[i]:
                    q = before[i]
                    r = get(data[q:k])
                    if r is None:
                        pair[q] = -1
                    else:
                        pair[q] = r
                        if r in buckets:
                            heappush(buckets[r], q)
                        else:
                            queue.open(r, q)
                        if r < lowest:
                            lowest = r
            if not bucket:
                queue.close(rank)
        out = []
        for p, i in zip(pieces, starts):
            end, ids = i + len(p), []
            while i < end:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out

    def remember(self, pieces) -> dict[str, tuple[int, str, bytes]]:
        """(number of ids, ids as text, decoded bytes) of each pre-token;
        those not remembered are encoded together."""
        young, old = self.young, self.old
        if len(young) > self.memory:
            self.old, self.young = young, {}
            young, old = self.young, self.old
        new, long = [], {}
        for p in pieces:
            if p not in young:
                known = old.get(p)
                if known is None:
                    new.append(p)
                else:
                    young[p] = known
        for p, ids in zip(new, self.encode_pieces([p.encode() for p in new])):
            made = len(ids), ",".join(map(str, ids)), self.decode(ids)
            if len(p) <= 64:
                young[p] = made
            else:
                long[p] = made
        return collections.ChainMap(young, long) if long else young

    def look_up(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """For each text the entries of its pre-tokens, or of words that hold
        several.

        With the usual pattern a match never runs over a space before a
        non-space, so a text without other runs of spaces is cut there first
        and each distinct word is matched once.
        """
        cut = [t.split(" ") if self.by_words and not SPACE_RUN.search(t) else None for t in texts]
        firsts = {w[0] for w in cut if w} - {""}
        words = set().union(*(w[1:] for w in cut if w))
        found = {w: self.find(w) for w in firsts}
        spaced = self.spaced if len(self.spaced) < 2 * self.memory else {}
        self.spaced = spaced
        fresh = [w for w in words if w not in spaced]
        in_fresh = [self.find(" " + w) for w in fresh]
        plain = [None if w else self.find(t) for w, t in zip(cut, texts)]
        known = self.remember(set().union(*found.values(), *in_fresh, *(f for f in plain if f)))
        long = {}
        for w, f in zip(fresh, in_fresh):
            made = known[f[0]]
            if len(f) > 1:
                ns, ids, data = zip(*[known[p] for p in f])
                made = sum(ns), ",".join(ids), b"".join(data)
            if len(w) <= 64:
                spaced[w] = made
            else:
                long[w] = made
        table = collections.ChainMap(spaced, long) if long else spaced
        out = []
        for w, f in zip(cut, plain):
            if w:
                out.append([known[p] for p in found.get(w[0], ())] + [table[x] for x in w[1:]])
            else:
                out.append([known[p] for p in f])
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for e in self.look_up([text])[0] for x in e[1].split(",")]

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, sha256 of the decimal ids, sha256 of
        the decoded bytes."""
        out = []
        for entries in self.look_up(texts):
            ns, ids, data = zip(*entries) if entries else ((), (), ())
            out.append((sum(ns), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                        hashlib.sha256(b"".join(data)).hexdigest()))
        return out


def slices(texts, chars: int = 4_000_000):
    """Consecutive lists of texts of about ``chars`` code points together
    (one text at least)."""
    own, n = [], 0
    for t in texts:
        own.append(t)
        n += len(t)
        if n >= chars:
            yield own
            own, n = [], 0
    if own:
        yield own


_encoders: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder for each vocabulary file in a worker process."""
    key = path, pattern
    if key not in _encoders:
        _encoders[key] = BytePairEncoder(load_ranks(path), pattern)
    return _encoders[key]


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every whole text."""
    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            ids = [enc.encode(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids, "decoded": [enc.decode(x) for x in ids]})
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
            .mapInPandas(run, "doc_id bigint, ids array<int>, decoded binary"))


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode, digest."""
    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            rows = [r for own in slices(b["text"]) for r in enc.digests(own)]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": [r[0] for r in rows],
                                "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
            .mapInPandas(run, OUT))
