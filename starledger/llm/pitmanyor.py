"""Language-model scoring with hierarchical Pitman-Yor processes (operator 8).

Every training token is a context restaurant, which serves the tokens that
follow it.  All of them share one parent restaurant of tokens; its base gives
``UNKNOWN`` to the one unknown token and the rest evenly to the training
tokens.  A text begins after an end token.

Chinese-restaurant seating is sampled by Gibbs: the number of tables that
serve a dish, given its customers c, the restaurant's other tables and the
parent's probability, has the conditional S_d(c, t) a^t (S_d: generalised
Stirling numbers, a: the weight of a new table), which sums over all seatings
of that dish.  That is the number of tables of a Poisson(a / d) crowd of Sibuya
sizes that add up to c; for c above ``EXACT`` it is drawn from the Poisson
law tilted to the sum c.  Predictive probabilities are averaged over the
sweeps after the burn-in, and the log of the average is the score.

Work is dealt in blocks of documents and in shards of keys:

1. a block numbers its distinct tokens and pairs (previous token, token);
2. its tokens meet those of other blocks by shard of their hash: corpus counts
   and corpus numbers, those of tokens seen twice or more first;
3. its pairs meet by shard of (number, number), so a frequent context is
   spread over all shards: corpus counts of pairs;
4. a pair seen once sits at one table.  A sweep draws the tables of the others
   where their shard counted them, and adds them up by context and by token:
   a shard of pairs sends one packed row to each group of token shards, which
   answers with their state.  A token seen once has one table everywhere;
5. draws are functions of the pair, the sweep and that state, so a block
   gets the state of its tokens and draws the tables of its pairs again.

Defined results: null text counts as '' (one end token); without training
rows every token is unknown, which is certain (score 0); a null id counts as ''
for the split; an empty table gives an empty frame; repeated rows are
repeated; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import forget, remainder, text_or_empty, written
from starledger.session import scratch_path

BLOCK_TOKENS = 1 << 21
SHARD_CHARS = 1 << 24  # the number of shards follows from the characters of all texts
GROUP_TOKENS = 1 << 17  # whose state a task holds: neighbouring shards of tokens
EXACT = 96
CHUNK = 4096  # dishes drawn at once
THETA = 1.0
UNKNOWN = 0.5  # of a new table's dish
BURN, SWEEPS = 2, 3
END = -(1 << 63)  # the end token's key

_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each key: the same in every run and retry."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t): S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most):
        stay = np.log(np.maximum(c - t * d, 1e-300)) + out[c]
        out[c + 1] = np.logaddexp(np.where(t <= c, stay, -np.inf), np.append(-np.inf, out[c, :-1]))
        out[c + 1, 0] = -np.inf
    return out


def tables(c: np.ndarray, a: np.ndarray, d: float, u: np.ndarray, stirling: np.ndarray) -> np.ndarray:
    """Tables for dishes of c customers, drawn from their conditional."""
    t = np.minimum(c, 1)
    kinds = np.minimum(c, EXACT + 1).astype(np.uint8)
    order = np.argsort(kinds, kind="stable")
    ends = np.cumsum(np.bincount(kinds, minlength=EXACT + 2))
    for k in range(2, EXACT + 1):
        at = order[ends[k - 1]:ends[k]]
        fits = (k - 1) * np.log(np.maximum(a[at], 1.0)) < 600.0  # products of steps stay finite
        for own in (at[fits][lo:lo + CHUNK] for lo in range(0, int(fits.sum()), CHUNK)):
            steps = np.exp(np.diff(stirling[k, 1:k + 1]))
            p, term = np.empty((k, len(own))), np.ones(len(own))
            p[0] = term
            for n in range(1, k):
                term = term * (a[own] * steps[n - 1])
                np.add(p[n - 1], term, out=p[n])
            t[own] = 1 + (p < u[own] * p[-1]).sum(axis=0).clip(max=k - 1)
        for own in (at[~fits][lo:lo + CHUNK] for lo in range(0, int((~fits).sum()), CHUNK)):
            logit = stirling[k, 1:k + 1][None, :] + np.log(a[own])[:, None] * np.arange(1, k + 1)
            p = np.cumsum(np.exp(logit - logit.max(axis=1, keepdims=True)), axis=1)
            t[own] = 1 + (p < u[own, None] * p[:, -1:]).sum(axis=1).clip(max=k - 1)
    at = order[ends[EXACT]:]
    if len(at):
        t[at] = np.minimum(1 + poisson(tilted(c[at], a[at] / d, d), u[at]), c[at])
    return t


def tilted(c: np.ndarray, rate: np.ndarray, d: float) -> np.ndarray:
    """The rate of tables whose Sibuya sizes, tilted by x, add up to c on average:
    rate * d * x * (1 - x)^(d - 1) = c, solved for s = log(1 - x) by Newton's steps.  The log of the
    left side is concave and falls in s, so they come down to its root from any start above it."""
    share = c / (rate * d)
    s = -0.7 * np.log1p((1.0 - d) * share) / (1.0 - d)
    for _ in range(10):
        e, x = np.exp(s), -np.expm1(s)
        s = np.minimum(s - (np.log(x) + (d - 1.0) * s - np.log(share)) / (d - 1.0 - e / x), -1e-300)
    return rate * -np.expm1(d * s)


def poisson(rate: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson draws from numbers in (0, 1): by summing the law up to u, for rates above 100 by
    its normal limit."""
    z = np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * np.modf(u * (1 << 20))[0])
    out = np.maximum(np.rint(rate + np.sqrt(rate) * z), 0).astype(np.int64)
    at = np.flatnonzero(rate <= 100)
    own, up_to, k = rate[at], u[at], 0
    term = np.exp(-own)
    below, out[at] = term, 0
    while (open_ := (up_to > below) & (k < 20 + 12 * own)).any():
        at, own, up_to, term, below = (x[open_] for x in (at, own, up_to, term, below))
        k += 1
        out[at] = k
        term = term * own / k
        below = below + term
    return out


def discount(ones: int, twos: int) -> float:
    """From the numbers of dishes with one and with two customers."""
    return min(max(ones / (ones + 2.0 * twos), 0.1), 0.95) if ones and twos else 0.5


def transitions(counts: np.ndarray) -> np.ndarray:
    """Averaged predictive probability of dish j in restaurant i, from the counts
    (i, j): the same sampling for one small table, with a uniform base."""
    k = len(counts)
    d = discount(int((counts == 1).sum()), int((counts == 2).sum()))
    stirling = log_stirling(d)
    i, j = np.nonzero(counts)
    c = counts[i, j]
    t = np.minimum(c, 1)
    t0 = np.minimum(np.bincount(j, weights=t, minlength=k).astype(np.int64), 1)
    total, out = counts.sum(axis=1), np.zeros((k, k))
    for sweep in range(BURN + SWEEPS):
        customers = np.bincount(j, weights=t, minlength=k).astype(np.int64)  # the parent's
        new = (THETA + d * t0.sum()) / k
        t0 = tables(customers, np.full(k, new), d, uniform(np.arange(k), 1000 + sweep), stirling)
        parent = (customers - d * t0 + (THETA + d * t0.sum()) / k) / (THETA + customers.sum())
        own = np.bincount(i, weights=t, minlength=k)
        t = tables(c, (THETA + d * own[i]) * parent[j], d, uniform(i * k + j, sweep), stirling)
        if sweep >= BURN:
            own = np.bincount(i, weights=t, minlength=k)
            p = (THETA + d * own)[:, None] * parent[None, :]
            p[i, j] += c - d * t
            out += p / (THETA + total)[:, None]
    return out / SWEEPS


ROWS = "kind string, block bigint, shard int, doc_id bigint, held_out boolean, n bigint, data binary, more binary"


def table(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "block", "shard", "doc_id", "held_out", "n", "data", "more"])
    return out.astype({"block": "Int64", "shard": "Int32", "doc_id": "Int64", "held_out": "boolean", "n": "Int64"})


ZSTD = pa.Codec("zstd", 1)


def packed(x: np.ndarray, kind=np.int32) -> bytes:
    """Numbers, compressed byte by byte: most upper bytes are zero.  Their size comes first."""
    x = np.ascontiguousarray(x, kind)
    return x.nbytes.to_bytes(8, "little") + ZSTD.compress(x.ravel().view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), asbytes=True)


def unpacked(data: bytes, kind=np.int32) -> np.ndarray:
    planes = np.frombuffer(ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little")), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def joined(data, kind=np.int32) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unpacked(x, kind) for x in data)])


def sharded(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys ^ (keys >> np.uint64(31))) * _MIX[0] >> np.uint64(33)).astype(np.int64) % shards


def slices(shard: np.ndarray):
    """(shard, first, behind the last) of sorted shards."""
    start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
    return [(int(shard[a]), a, b) for a, b in zip(start, [*start[1:], len(shard)])]


def pairs_of(every: np.ndarray, end: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (previous token, token) of texts, in order, and the pair of each token."""
    keys = np.append(end, every[:-1]) * words + every
    bits = len(keys).bit_length()
    if words * words >> (64 - bits):  # no room for a pair and its place in one number
        pairs, at = np.unique(keys, return_inverse=True)
        return pairs // words, pairs % words, at
    both = (keys.astype(np.uint64) << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    place = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    keys = (both >> np.uint64(bits)).astype(np.int64)
    new = np.append(True, keys[1:] != keys[:-1])
    at, pairs = np.empty(len(keys), np.int64), keys[new]
    at[place] = np.cumsum(new) - 1
    u = pairs // words
    return u, pairs - u * words, at


def split_words(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and all words: A-Z lower-cased, split at ASCII white space."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
    words = parts.flatten()
    kept = pc.binary_length(words).to_numpy() > 0  # white space at an end gives an empty word
    n = np.bincount(pc.list_parent_indices(parts).to_numpy()[kept], minlength=len(texts))
    return n, words.filter(pa.array(kept))


def blocks(docs: DataFrame, shards: int) -> DataFrame:
    """Kinds of rows for each block of documents:

    ``word``: for each shard the block's tokens (keys, training counts), which are
    numbered in this order;
    ``pair``: the block's pairs by context and token (``pairs_of``, training counts);
    ``text``: a document, by its place in the block (``shard``) and its tokens' count;
    ``tokens``: all tokens, numbered as they first came in the block, and these tokens' numbers.
    """
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        texts: list[tuple] = []
        chunks: list[pa.Array] = []
        size = 0

        def flush():
            nonlocal size, made
            block = (part << 32) + made
            coded = pa.chunked_array(chunks, pa.string()).dictionary_encode().chunks  # one dictionary for all chunks
            words = coded[-1].dictionary.to_numpy(zero_copy_only=False)
            keys = np.fromiter((END % (1 << 64), *map(xxhash.xxh3_64_intdigest, words)), np.uint64, len(words) + 1)
            shard = sharded(keys, shards)
            order = np.lexsort((keys, shard))
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys))
            lengths = np.array([n for _, _, n in texts])
            # Number 0 is the end token; no word holds white space.
            tokens = np.insert(np.concatenate([c.indices.to_numpy() for c in coded]) + 1, np.cumsum(lengths - 1), 0)
            chunks.clear()
            every = place[tokens]
            trains = np.repeat([not held for _, held, _ in texts], lengths)
            counts = np.bincount(every[trains], minlength=len(keys))
            u, w, at = pairs_of(every, place[0], len(keys))
            n = np.bincount(at[trains], minlength=len(u))
            keys = keys[order]
            out = [("pair", block, None, None, None, len(u), packed(np.append(np.diff(u, prepend=0), w)), packed(n)),
                   ("tokens", block, None, None, None, len(tokens), packed(tokens), packed(place))]
            out += [("word", block, s, None, None, b - a, packed(keys[a:b], np.uint64), packed(counts[a:b])) for s, a, b in slices(shard[order])]
            out += [("text", block, i, id_, held, int(n), None, None) for i, (id_, held, n) in enumerate(texts)]
            texts.clear()
            size, made = 0, made + 1
            for lo in range(0, len(out), 4096):
                yield table(out[lo:lo + 4096])

        for b in batches:
            part_of = (b["text"].str.len().to_numpy(np.int64) + 1).cumsum() // (1 + BLOCK_TOKENS // 8)
            for _, lo, hi in slices(part_of):
                some = b.iloc[lo:hi]
                n, words = split_words(some["text"].tolist())
                texts += [(None if null else int(id_), bool(held), k + 1) for null, id_, held, k in zip(some["doc_id"].isna(), some["doc_id"], some["held_out"], n)]
                chunks.append(words)
                size += len(words) + len(some)
                if size >= BLOCK_TOKENS:
                    yield from flush()
        if texts:
            yield from flush()

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (remainder("doc_id", 5) == 1).alias("held_out"),
                        text_or_empty().alias("text")).mapInPandas(run, ROWS))


def counted_words(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    """``known``: corpus counts of a block's tokens, and their numbers in the shard: 0, 1 .. for
    those seen twice or more, -2, -3 .. for those seen once, else -1.  ``shard``: how many of both, and all counts."""
    keys, at = np.unique(joined(b["data"], np.uint64), return_inverse=True)
    c = np.bincount(at, weights=joined(b["more"]), minlength=len(keys)).astype(np.int64)
    number = np.full(len(keys), -1, np.int32)
    number[c > 1] = np.arange((c > 1).sum())
    number[c == 1] = -2 - np.arange((c == 1).sum())
    rows, lo = [], 0
    for block, n in zip(b["block"], b["n"]):
        own, lo = at[lo:lo + n], lo + n
        rows.append(("known", block, key[0], None, None, n, packed(c[own], np.int64), packed(number[own])))
    rows.append(("shard", None, key[0], None, None, int(c.sum()), np.array([(c > 1).sum(), (c == 1).sum()], np.int64).tobytes(), None))
    return table(rows)


class Numbers:
    """Corpus numbers of tokens from those in the shards."""

    def __init__(self, twice: np.ndarray, once: np.ndarray):
        self.twice, self.once = np.append(0, np.cumsum(twice)), np.cumsum(once) - once
        self.repeated = int(self.twice[-1])

    def of_block(self, known: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(counts, corpus numbers; -1 if unknown) of a block's tokens."""
        known = known.sort_values("shard")
        shard = np.repeat(known["shard"].to_numpy(np.int64), known["n"].to_numpy(np.int64))
        number = joined(known["more"]).astype(np.int64)
        ids = np.where(number >= 0, self.twice[shard] + number, np.where(number < -1, self.repeated + self.once[shard] - 2 - number, -1))
        return joined(known["data"], np.int64), ids


def asked(u: np.ndarray, w: np.ndarray, ids: np.ndarray, shards: int):
    """Places, keys and shards of a block's pairs of known tokens, by shard and key."""
    at = np.flatnonzero((ids[u] >= 0) & (ids[w] >= 0))
    keys = (ids[u[at]].astype(np.uint64) << np.uint64(32)) | ids[w[at]].astype(np.uint64)
    order = np.argsort(keys)
    shard = sharded(keys, shards)[order]
    by = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    order = order[by]
    return at[order], keys[order], shard[by]


def split_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: the steps of their first half, and their second half."""
    u, w = split_key(keys)
    return packed(np.append(np.diff(u, prepend=0), w), np.uint32)


def unpacked_keys(data: bytes) -> np.ndarray:
    u, w = unpacked(data, np.uint32).astype(np.uint64).reshape(2, -1)
    return (np.cumsum(u, dtype=np.uint64) << np.uint64(32)) | w


def tokens_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of pairs, in order, and the places of each pair's two."""
    u, w = split_key(keys)
    ids = np.unique(np.append(u, w))
    return ids, np.searchsorted(ids, u), np.searchsorted(ids, w)


class Base:
    """The parent restaurant's law in one sweep."""

    def __init__(self, d0: float, kinds: int, tables0: float, customers0: float):
        self.d0, self.known, self.customers0 = d0, (1.0 - UNKNOWN) / max(kinds, 1), customers0
        self.unknown = UNKNOWN if kinds else 1.0
        self.new = THETA + d0 * tables0

    def __call__(self, c0, t0):
        """Of tokens with c0 customers at t0 tables; an unknown one has none."""
        return (c0 - self.d0 * t0 + self.new * np.where(c0 > 0, self.known, self.unknown)) / (THETA + self.customers0)


def of_kind(parts: DataFrame, path: str, kind: str) -> DataFrame:
    """Rows of one kind, which lie in a folder of their own."""
    out = parts.filter(F.col("kind") == kind)
    out.written_to = f"{path}/kind={kind}"
    return out


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text_or_empty()).cast("bigint"))).first()[0] or 0
    shards = 1 + chars // SHARD_CHARS
    path = scratch_path(spark, "py-blocks")
    blocks(docs, shards).write.partitionBy("kind").parquet(path)
    parts = spark.read.schema(ROWS).parquet(path)
    words, pairs = of_kind(parts, path, "word"), of_kind(parts, path, "pair")
    known = written(words.groupBy("shard").applyInPandas(counted_words, ROWS), "py-known")
    forget(words)

    # One row for each shard.
    by_shard = sorted(known.filter("kind = 'shard'").select("shard", "n", "data").collect())
    n_all = sum(r["n"] for r in by_shard)
    twice, once = np.zeros((2, shards), np.int64)
    for r in by_shard:
        twice[r["shard"]], once[r["shard"]] = np.frombuffer(r["data"], np.int64)
    numbers, hapax = Numbers(twice, once), int(once.sum())
    repeated, v = numbers.repeated, numbers.repeated + hapax
    if v >= 1 << 32:
        raise ValueError("more than 2^32 training tokens")
    known = known.filter("kind = 'known'")
    # A group of shards goes by its first shard.
    group = max(1, int(GROUP_TOKENS * shards // max(repeated, 1)))

    def ask(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        _, ids = numbers.of_block(b[b["kind"] == "known"])
        pair = b[b["kind"] == "pair"]
        u, w = joined(pair["data"]).astype(np.int64).reshape(2, -1)
        at, keys, shard = asked(np.cumsum(u), w, ids, shards)
        n = joined(pair["more"])[at]
        return table([("ask", key[0], s, None, None, hi - lo, packed_keys(keys[lo:hi]), packed(n[lo:hi])) for s, lo, hi in slices(shard)])

    def by_group(ids: np.ndarray):
        """(group of token shards, first, behind the last, packed numbers in it) of sorted corpus numbers."""
        shard = np.searchsorted(numbers.twice, ids, side="right") - 1
        return [(g, lo, hi, packed(ids[lo:hi] - numbers.twice[g])) for g, lo, hi in slices(shard - shard % group)]

    def drawn_of(shard: int, ids: np.ndarray, iu: np.ndarray, iw: np.ndarray, t: np.ndarray) -> list[tuple]:
        """``drawn``: the tables t of a shard's pairs by context and by token, for each group of token shards."""
        by = np.array([np.bincount(i, weights=t, minlength=len(ids)) for i in (iu, iw)]).astype(np.int32)
        return [("drawn", shard, s, None, None, hi - lo, packed(by[:, lo:hi]), more) for s, lo, hi, more in by_group(ids)]

    def tally(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """``count``: corpus counts of a block's pairs; ``twice``: pairs seen twice or more (keys, counts; n: seen twice), and their first
        tables (``drawn_of``); ``once``: how many pairs are seen once; ``context``, ``token``: how many of them a token has on that side."""
        keys, at = np.unique(np.concatenate([unpacked_keys(x) for x in b["data"]]), return_inverse=True)
        c = np.bincount(at, weights=joined(b["more"]), minlength=len(keys)).astype(np.int32)
        rows, lo = [], 0
        for block, n in zip(b["block"], b["n"]):
            own, lo = at[lo:lo + n], lo + n
            rows.append(("count", block, key[0], None, None, n, packed(c[own]), None))
        again = keys[c > 1]
        rows += [("twice", key[0], None, None, None, int((c == 2).sum()), packed_keys(again), packed(c[c > 1])),
                 ("once", key[0], None, None, None, int((c == 1).sum()), None, None)]
        rows += drawn_of(key[0], *tokens_of(again), np.ones(len(again)))
        for kind, ids in zip(("context", "token"), split_key(keys[c == 1])):
            ids, n = np.unique(ids[ids < repeated], return_counts=True)
            rows += [(kind, key[0], s, None, None, hi - lo, packed(n[lo:hi]), more) for s, lo, hi, more in by_group(ids)]
        return table(rows)

    asks = pairs.unionByName(known).groupBy("block").applyInPandas(ask, ROWS)
    tallied = asks.groupBy("shard").applyInPandas(tally, ROWS)
    pair_path = scratch_path(spark, "py-pairs")
    tallied.write.partitionBy("kind").parquet(pair_path)
    forget(pairs)
    tallied = spark.read.schema(ROWS).parquet(pair_path)
    counts, again, single, drawn, *ones_by = (of_kind(tallied, pair_path, kind) for kind in ("count", "twice", "once", "drawn", "context", "token"))
    of_counts = {r["kind"]: r["n"] for r in again.unionByName(single).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    d = discount(of_counts.get("once") or 0, of_counts.get("twice") or 0)

    def added_to(sums: np.ndarray, b: pd.DataFrame) -> np.ndarray:
        """Tables by context and by token of a group's tokens, with those of ``drawn`` rows."""
        for data, more in b.loc[b["kind"] == "drawn", ["data", "more"]].itertuples(index=False):
            sums[:, unpacked(more)] += unpacked(data).reshape(2, -1)
        return sums

    def count_ones(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """``ones``: tables of pairs seen once by context and by token; how many tokens have one and two customers at first."""
        sums = np.zeros((2, twice[key[0]:key[0] + group].sum()), np.int64)
        for kind, data, more in b.loc[b["kind"] != "drawn", ["kind", "data", "more"]].itertuples(index=False):
            sums[int(kind == "token"), unpacked(more)] += unpacked(data)
        ones = packed(sums)
        tw = added_to(sums, b)[1]
        return table([("ones", None, key[0], None, None, len(tw), ones, np.array([(tw == 1).sum(), (tw == 2).sum()], np.int64).tobytes())])

    ones = written(tallied.filter("kind in ('context', 'token', 'drawn')").groupBy("shard").applyInPandas(count_ones, ROWS), "py-ones")
    forget(*ones_by)

    def added(rows: DataFrame) -> np.ndarray:
        """The sum of two numbers of each group."""
        return sum((np.frombuffer(r["more"], np.int64) for r in rows.select("more").collect()), np.zeros(2, np.int64))

    # The state of a sweep: tables of the context (tu); customers and tables in the parent (tw, t0).
    kinds0 = added(ones)
    d0 = discount(hapax + int(kinds0[0]), int(kinds0[1]))
    states, bases, tables0 = [], [], float(v)
    for sweep in range(BURN + SWEEPS):
        if sweep:
            base = bases[-1]

            def seat(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
                told = b[b["kind"] == "told"].sort_values("shard")
                if told.empty:
                    return table([])
                tu, tw, t0 = np.concatenate([unpacked(x).reshape(3, -1) for x in told["data"]], axis=1).astype(np.int64)
                pair = b[b["kind"] == "twice"].iloc[0]
                keys = unpacked_keys(pair["data"])
                ids, iu, iw = tokens_of(keys)
                a = (THETA + d * tu[iu]) * base(tw, t0)[iw]
                t = tables(unpacked(pair["more"]).astype(np.int64), a, d, uniform(keys.view(np.int64), sweep), log_stirling(d))
                return table(drawn_of(key[0], ids, iu, iw, t))

            told = of_kind(states[-1], states[-1].written_to, "told")
            drawn = again.unionByName(told).groupBy("block").applyInPandas(seat, ROWS)

        def parent(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            """``state`` of a group's tokens, with the sums of t0 and tw; ``told``: that of the tokens of each shard of pairs."""
            tu, tw = added_to(unpacked(b.loc[b["kind"] == "ones", "data"].iloc[0]).reshape(2, -1).astype(np.int64), b)
            new = (THETA + d0 * tables0) * (1.0 - UNKNOWN) / max(v, 1)
            t0 = tables(tw, np.full(len(tw), new), d0, uniform(numbers.twice[key[0]] + np.arange(len(tw)), 1000 + sweep), log_stirling(d0))
            state = np.array([tu, tw, t0], np.int32)
            rows = [("state", sweep, key[0], None, None, len(tw), packed(state), np.array([t0.sum(), tw.sum()], np.int64).tobytes())]
            if sweep < BURN + SWEEPS - 1:
                asking = b[b["kind"] == "drawn"]
                rows += [("told", s, key[0], None, None, n, packed(state[:, unpacked(more)]), more) for s, n, more in zip(asking["block"], asking["n"], asking["more"])]
            return table(rows)

        state_path = scratch_path(spark, f"py-state-{sweep}")
        ones.unionByName(drawn).groupBy("shard").applyInPandas(parent, ROWS).write.partitionBy("kind").parquet(state_path)
        forget(told if sweep else drawn)
        state = spark.read.schema(ROWS).parquet(state_path)
        state.written_to = state_path
        all0 = added(state.filter("kind = 'state'"))
        tables0 = float(all0[0] + hapax)
        bases.append(Base(d0, v, tables0, float(all0[1] + hapax)))
        states.append(state)
    kept = range(BURN - 1, BURN + SWEEPS)

    forget(*states[:BURN - 1], again, ones)
    long = functools.reduce(DataFrame.unionByName, [states[s].filter("kind = 'state'") for s in kept])

    def state_of(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """``state`` of a block's tokens seen twice or more."""
        state = b[b["kind"] == "state"].sort_values("block")
        values = np.array([unpacked(x).reshape(3, -1) for x in state["data"]]).reshape(len(kept), 3, -1)
        asking, rows = b[b["kind"] == "known"].sort_values("shard"), []
        for block, own in asking.groupby("block"):
            number = [(shard, unpacked(more)) for shard, more in zip(own["shard"], own["more"])]
            at = np.concatenate([numbers.twice[shard] + x[x >= 0] for shard, x in number]) - numbers.twice[key[0]]
            of = values[:, :, at]
            rows.append(("state", block, key[0], None, None, of.shape[2], packed(np.diff(of, axis=0, prepend=0)), None))
        return table(rows)

    sent = known.unionByName(long).groupBy(F.col("shard") - F.col("shard") % group).applyInPandas(state_of, ROWS)

    def read(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        of = {k: x for k, x in b.groupby("kind")}
        texts = of["text"].sort_values("shard")
        c, ids = numbers.of_block(of["known"])
        place = joined(of["tokens"]["more"])
        u, w, every = pairs_of(place[joined(of["tokens"]["data"])].astype(np.int64), place[0], len(place))
        at, keys, _ = asked(u, w, ids, shards)
        cp = np.zeros(len(u), np.int64)
        if "count" in of:
            cp[at] = joined(of["count"].sort_values("shard")["data"])
        state = np.tile(np.minimum(c, 1), (len(kept), 3, 1))
        own = [unpacked(x).reshape(len(kept), 3, n) for n, x in of["state"].sort_values("shard")[["n", "data"]].itertuples(index=False)] if "state" in of else []
        if own:
            state[:, :, (ids >= 0) & (ids < repeated)] = np.cumsum(np.concatenate(own, axis=2), axis=0)
        more = at[cp[at] > 1]
        spots, stirling, p = keys[cp[at] > 1].view(np.int64), log_stirling(d), np.zeros(len(u))
        for i, sweep in enumerate(kept):
            tu, p0 = state[i, 0], bases[sweep](state[i, 1], state[i, 2])
            if i:
                t = np.minimum(cp, 1)
                t[more] = tables(cp[more], weight, d, uniform(spots, sweep), stirling)  # noqa: F821
                p += (cp - d * t + (THETA + d * tu[u]) * p0[w]) / (THETA + c[u])
            weight = (THETA + d * tu[u[more]]) * p0[w[more]]  # noqa: F841
        p, base = np.log10(p / SWEEPS), np.log10((c + 0.5) / (n_all + 0.5 * (v + 1)))
        lengths, word = texts["n"].to_numpy(np.int64), w[every]
        added = functools.partial(np.add.reduceat, indices=np.cumsum(lengths) - lengths)
        out = pd.DataFrame({"n_tokens": lengths, "n_known": added((c[word] > 0).astype(np.int64)), "train_tokens": n_all,
                            "base_score": added(base[word]), "score": added(p[every])})
        return pd.concat([texts[["doc_id", "held_out"]].astype({"doc_id": "Int64"}).reset_index(drop=True), out], axis=1)

    every = functools.reduce(DataFrame.unionByName, [parts.filter("kind in ('text', 'tokens')"), known, counts, sent])
    return every.groupBy("block").applyInPandas(read, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                                      "base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, tokens, perplexity) from scored documents."""
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"),
                                          F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
