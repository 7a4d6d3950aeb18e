"""Near-duplicate detection by Order MinHash (operator 6).

* Exact copies become one node first (the 128-bit hash of the whole text).
* The k-mers of a text are its two-word shingles, labelled by their
  occurrence number.  For each of ``SKETCHES`` hash functions the ``KEPT``
  k-mers of smallest labelled hash are kept *in text order*; their sequence
  is one sketch value.  Equal values at one position put texts in a bucket.
  An edit breaks two shingles at most, so texts at the threshold still share
  many, however the edits lie.  Texts of up to ``SHORT`` words, where a few
  edits leave few shingles, have ``SHORT_SKETCHES`` more values whose k-mers
  are single words.
* A bucket is not paired out.  Its smallest member leads and the others are
  aligned with it; those that fail form the bucket of the next round.
* A member that failed, and that verified links of other buckets have not put into its
  leader's class by then, is compared with every member of its buckets that is
  of another class, in blocks of members: by length and by bags of words first,
  which leaves few members; then these by alignment, the closest pairs first,
  as long as their classes differ.  A pair that shares buckets is aligned in one of
  them.  Tasks return the links that joined two classes, fewer than the rows
  they were given.  So every near pair that shares a bucket ends in one class,
  however many rounds were made.
* A candidate is verified by banded alignment of the words: of the band of
  diagonals that the threshold allows, the furthest cell reached with 0, 1,
  2 .. edits.  Bags of words and of neighbouring words bound it first.
  similarity = 1 - edit distance / words of the longer text, at least 0.8.
* Verified links join into classes by propagating the smallest label.

Defined results: null text counts as '' and texts without words are near
copies of each other; a class's id is the smallest non-null id of its rows
(null if it has none); an empty table gives an empty frame; repeated rows
belong to one class; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import forget, text_or_empty, written

SHINGLE = 2
SKETCHES = 32
KEPT = 2
SHORT = 30
SHORT_SKETCHES = 12
THRESHOLD = 0.8
ROUNDS = 2
BLOCK = 512  # rows a side that a task compares at a time
FINE = 1024  # bins of those comparisons; a multiple of BINS
BINS = 128


class _Hashes(dict):
    """Hash of each word, made when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of all words if there are fewer."""
    size = max(1, min(size, len(h)))
    if not len(h):
        return np.zeros(1, np.uint64)
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return out


def order_sketch(kmers: np.ndarray, sketches: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """One value per hash function: the kept k-mers' sequence, hashed."""
    n = len(kmers)
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    labelled = mix(kmers + occurrence * np.uint64(0xD6E8FEB86659FD93))
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    kept = min(kept, n)
    out = np.zeros(sketches, np.uint64)
    step = max(1, (1 << 16) // n)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for lo in range(0, sketches, step):
        v = mix(labelled[None, :] ^ seeds[lo:lo + step, None])
        at = np.empty((len(v), kept), np.int64)
        for j in range(kept):
            at[:, j] = v.argmin(axis=1)
            v[np.arange(len(v)), at[:, j]] = top
        at.sort(axis=1)
        for j in range(kept):
            out[lo:lo + step] = mix(out[lo:lo + step] * np.uint64(0x9E3779B97F4A7C15) + kmers[at[:, j]])
    return out.view(np.int64)


def text_sketch(h: np.ndarray) -> np.ndarray:
    """All sketch values of a text of these word hashes."""
    own = order_sketch(shingle_hashes(h))
    return np.append(own, order_sketch(shingle_hashes(h, 1), SHORT_SKETCHES)) if len(h) <= SHORT else own


MOST = (1 << 15) - 1  # words counted in a bin; bounds by bags stay bounds


def bag(h: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Numbers of words by hash bin."""
    return np.bincount((h >> np.uint64(7)).astype(np.int64) & (bins - 1), minlength=bins)


def sketch_texts(docs: DataFrame) -> DataFrame:
    """(id, key, n_words, bag, sketch) of every row."""
    def run(batches):
        for b in batches:
            n, sketches, bags = [], [], []
            for t in b["text"]:
                h = word_hashes(t.lower().split())
                n.append(len(h))
                bags.append(np.minimum(bag(h), MOST).astype(np.int16))
                sketches.append(text_sketch(h))
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "key": b["key"], "n_words": n, "bag": bags, "sketch": sketches})
    text = text_or_empty()
    src = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_key(text).alias("key"), text.alias("text"))
    return src.mapInPandas(run, "id bigint, key binary, n_words int, bag array<smallint>, sketch array<bigint>")


def text_key(text):
    return F.unhex(F.md5(text))


def allowed(n: int, m: int, threshold: float) -> int:
    """Edits that leave the similarity at the threshold or above."""
    return int((1.0 - threshold) * max(n, m) + 1e-9)


def wavefront(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Edit distances of up to ``most[i]`` of the pairs, all pairs at once, by
    the furthest cell that each diagonal of the band reaches with 0, 1, 2 ..
    edits; a distance above ``most[i]`` is given as far.  The cost follows
    the edits and not the length of what two copies share."""
    far, p, block = 1 << 28, len(pairs), 16
    n, m = (np.array([len(q[i]) for q in pairs]) for i in (0, 1))
    band = int(most.max())
    xs, ys = np.full((p, int(n.max()) + block + 1), -1, np.int64), np.full((p, int(m.max()) + block + 1), -2, np.int64)
    for i, (x, y) in enumerate(pairs):
        xs[i, :len(x)], ys[i, :len(y)] = x, y
    ks = np.arange(-band - 1, band + 2)
    reach_ = np.full((p, len(ks)), -far, np.int64)  # words of x, by diagonal k = words of y less words of x
    out, ahead = np.full(p, far), np.arange(block)
    open_ = np.arange(p)
    for e in range(band + 1):
        lo, hi = band + 1 - e, band + 2 + e
        f = reach_[open_, lo - 1:hi + 1] if e else None
        if e:
            got = np.maximum(np.maximum(f[:, 1:-1] + 1, f[:, :-2]), f[:, 2:] + 1)
        else:
            got = np.zeros((len(open_), 1), np.int64)
        k = ks[lo:hi][None, :]
        got = np.minimum(got, np.minimum(n[open_, None], m[open_, None] - k))
        # a cell counts that lies inside both texts and can still come to the end
        live = (got >= 0) & (got + k >= 0) & (np.abs(k - (m - n)[open_, None]) <= (most[open_, None] - e))
        got[~live] = -far
        r, c = np.nonzero(live)
        i = got[r, c]
        j, q, act = i + ks[lo + c], open_[r], np.arange(len(r))
        same = xs[q, i] == ys[q, j]
        act = act[same]
        while len(act):
            hit = xs[q[act, None], i[act, None] + ahead] == ys[q[act, None], j[act, None] + ahead]
            run = np.where(hit.all(axis=1), block, hit.argmin(axis=1))
            i[act] += run
            j[act] += run
            act = act[run == block]
        got[r, c] = i
        reach_[open_, lo:hi] = got
        end = (m - n)[open_] + band + 1
        there = (end >= lo) & (end < hi)
        done = np.zeros(len(open_), bool)
        done[there] = reach_[open_[there], end[there]] >= n[open_[there]]
        out[open_[done]] = e
        open_ = open_[~done & (most[open_] > e)]
        if not len(open_):
            break
    return out


def lower_bound(x: np.ndarray, y: np.ndarray, kinds: int) -> int:
    """Edits at least: an edit changes one word and two pairs of neighbours,
    so neither bag can differ by more."""
    def apart(a: np.ndarray, b: np.ndarray) -> int:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        over = np.bincount(at[:len(a)], minlength=len(ids)) - np.bincount(at[len(a):], minlength=len(ids))
        return int(max(over[over > 0].sum(), -over[over < 0].sum()))
    words = np.bincount(x, minlength=kinds) - np.bincount(y, minlength=kinds)
    least = int(max(words[words > 0].sum(), -words[words < 0].sum()))
    pairs = apart(x[:-1] * kinds + x[1:], y[:-1] * kinds + y[1:])
    return max(least, -(-pairs // 2))


FEW = 32       # edits that many pairs are first followed to together
CELLS = 1 << 16  # pairs * diagonals of one call


def numbered_words(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """The words of both texts as numbers, and how many there are."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    return (np.fromiter(map(ids.__getitem__, a), np.int64, len(a)), np.fromiter(map(ids.__getitem__, b), np.int64, len(b)), len(ids))


def verify_pairs(pairs: list[tuple[list[str], list[str]]], threshold: float = THRESHOLD) -> list[tuple[bool, int]]:
    """(near, distance) of each pair: the edit distance in words where the
    threshold allows it, else a lower bound of it.

    The band of diagonals is first narrow, for all pairs; what is not aligned within
    it gets the band that its threshold allows."""
    out: list[tuple[bool, int]] = [(False, 0)] * len(pairs)
    open_: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for at, (a, b) in enumerate(pairs):
        limit = allowed(len(a), len(b), threshold)
        apart = abs(len(a) - len(b))
        if apart > limit:
            out[at] = (False, apart)
            continue
        x, y, kinds = numbered_words(a, b)
        short = min(len(x), len(y))
        other = np.flatnonzero(x[:short] != y[:short])
        lo = int(other[0]) if len(other) else short
        x, y = x[lo:], y[lo:]
        short -= lo
        other = np.flatnonzero(x[::-1][:short] != y[::-1][:short])
        end = int(other[0]) if len(other) else short
        x, y = x[:len(x) - end], y[:len(y) - end]
        if not len(x) or not len(y):
            out[at] = (True, max(len(x), len(y)))
            continue
        least = lower_bound(x, y, kinds)
        out[at] = (False, max(least, limit + 1))
        if least <= limit:
            open_.append((at, limit, x, y))
    for few in (FEW, 1 << 28):
        open_.sort(key=lambda o: (min(o[1], few), len(o[2])))
        left, lo = [], 0
        while lo < len(open_):
            hi = lo + 1  # as many pairs as the widest band leaves room for
            while hi < min(len(open_), lo + 128) and (hi - lo + 1) * (2 * min(open_[hi][1], few) + 1) <= CELLS:
                hi += 1
            own, lo = open_[lo:hi], hi
            for o, d in zip(own, wavefront([(x, y) for _, _, x, y in own], np.array([min(o[1], few) for o in own]))):
                if d <= o[1]:
                    out[o[0]] = (True, int(d))
                elif o[1] > few:
                    left.append(o)
        open_ = left
    return out


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, bags, near, d) of the pairs (a, b, bags); texts: (key, text)."""
    def run(batches):
        for batch in batches:
            got = []
            for lo in range(0, len(batch), 1024):
                own = batch.iloc[lo:lo + 1024]
                split: dict[str, list[str]] = {}
                words = lambda t: split[t] if t in split else split.setdefault(t, t.lower().split())  # noqa: B023, E731
                got += verify_pairs([(words(x), words(y)) for x, y in zip(own["ta"], own["tb"])], threshold)
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "bags": batch["bags"],
                                "near": [g[0] for g in got], "d": [g[1] for g in got]})
    t = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    t = t.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    return t.select("a", "b", "bags", "ta", "tb").mapInPandas(run, "a binary, b binary, bags int, near boolean, d int")


def bag_distance():
    """The larger of the words, by bins, that one text has above the other.
    It is a metric and a lower bound of the edit distance."""
    more = F.aggregate(F.zip_with("bag_a", "bag_b", lambda x, y: F.greatest(x - y, F.lit(0))), F.lit(0), lambda s, x: s + x)
    less = F.aggregate(F.zip_with("bag_a", "bag_b", lambda x, y: F.greatest(y - x, F.lit(0))), F.lit(0), lambda s, x: s + x)
    return F.greatest(more, less)


def links(sketches: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """Verified links (a, b) between keys of different texts."""
    nodes = sketches.groupBy("key").agg(F.first("n_words").alias("n_words"), F.first("bag").alias("bag"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "omh-nodes")
    buckets = F.array_distinct(F.transform("sketch", lambda h, j: F.xxhash64(j, h)))  # a text once a bucket, so counting finds the shared ones
    spots = nodes.select("key", "n_words", F.explode(buckets).alias("bucket"))
    # Both sides of the joins below are written tables or plain exchanges, so
    # that a hot bucket or leader can be split.
    shared = written(spots.groupBy("bucket").count().filter("count > 1").select("bucket"), "omh-shared")
    members = written(spots.join(shared, "bucket"), "omh-buckets")
    forget(shared)
    used = members.select("key").distinct()
    facts = written(nodes.select("key", "n_words", "bag").join(used, "key", "left_semi"), "omh-bags")
    forget(nodes)
    text = text_or_empty()
    texts = written(docs.select(text_key(text).alias("key"), text.alias("text")).join(used, "key", "left_semi")
                    .groupBy("key").agg(F.first("text").alias("text")), "omh-texts")

    def judged(pairs: DataFrame, name: str, least: float = threshold) -> DataFrame:
        """(a, b, bags, near, d) of the pairs, whatever comes of them."""
        side = lambda x: facts.select(F.col("key").alias(x), F.col("n_words").alias(f"n_{x}"), F.col("bag").alias(f"bag_{x}"))
        met = written(pairs.distinct().join(side("b"), "b").join(side("a"), "a")
                      .select("a", "b", bag_distance().alias("bags"), reach("n_a", "n_b", least).alias("most")), f"{name}-met")
        far = met.filter("bags > most").select("a", "b", "bags", F.lit(False).alias("near"), F.col("bags").alias("d"))
        out = written(verified(met.filter("bags <= most"), texts, least).unionByName(far), name)
        forget(met)
        return out

    stars, rest = [], members
    for _ in range(rounds):
        lead = written(rest.groupBy("bucket").agg(F.min("key").alias("a")), "omh-lead")
        star = written(rest.join(lead, "bucket").filter(F.col("key") != F.col("a")).withColumnRenamed("key", "b"), "omh-star")
        verdicts = judged(star.select("a", "b"), "omh-judged")
        stars.append(written(star.join(verdicts, ["a", "b"]), "omh-rays"))
        forget(lead, star, verdicts)
        rest = stars[-1].filter("not near").select("bucket", F.col("b").alias("key"), "n_words")
        if rest.isEmpty():
            break
    pairs = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    found = written(pairs([s.filter("near").select("a", "b") for s in stars]).distinct(), "omh-found")
    if rest.isEmpty() and len(stars) == 1:
        forget(members, facts, texts, *stars)
        return found
    root = components(found)

    # What failed and is not in its leader's class may be near to any other member
    # of the bucket.  Two members of different classes are not both in the
    # leader's, so one of them asks.
    of = lambda x: root.select(F.col("key").alias(x), F.col("root").alias(f"root_{x}"))
    failed = pairs([s.filter("not near").select("bucket", "a", "b") for s in stars]).join(of("b"), "b", "left").join(of("a"), "a", "left")
    failed = failed.filter(F.coalesce("root_b", "b") != F.coalesce("root_a", "a"))
    failed = written(failed.select("bucket", F.col("b").alias("key")).distinct(), "omh-failed")
    # A bucket of two texts is settled by its leader; one of three by two leaders, if both others failed the first.
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n_j"))
    near = pairs(stars[:max(1, len(stars) - 1)]).filter("near").select("bucket").distinct().withColumn("mixed", F.lit(True))
    open_ = sizes.join(near, "bucket", "left").filter(F.col("n_j") > F.when(F.col("mixed"), 2).otherwise(1 + len(stars))).select("bucket", "n_j")
    failed = written(failed.join(open_, "bucket"), "omh-unsettled")
    forget(*stars)
    new = joining_links(members, failed, texts, root, threshold)
    forget(members, facts, texts)
    return pairs([found, new])


def joining_links(members: DataFrame, failed: DataFrame, texts: DataFrame, root: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the classes of failed texts (bucket, key, n_j: members of the bucket) and near
    members of their buckets.

    A bucket is cut into blocks of asking texts and blocks of members; one
    group of rows is a block of each, so a task holds ``BLOCK`` rows a side,
    whatever the bucket."""
    asks = failed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_i"), F.ceil(F.max("n_j") / BLOCK).cast("int").alias("n_j"))
    own = members.join(asks, "bucket").join(failed.select("bucket", "key", F.lit(True).alias("asks")), ["bucket", "key"], "left")
    own = written(own.withColumn("asks", F.coalesce("asks", F.lit(False))), "omh-opened")

    def fine(batches):
        for b in batches:
            bags = [np.minimum(bag(word_hashes(t.lower().split()), FINE), 255).astype(np.uint8).tobytes() for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "bag": bags})

    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = ["bucket", "i", "j"]

    def dealt(rows: DataFrame, *columns: str) -> DataFrame:
        """Rows by blocks: of asking texts (side 0) and of all (side 1)."""
        first = rows.filter("asks").select("bucket", block("n_i").alias("i"), every("n_j").alias("j"), F.lit(0).alias("side"), *columns)
        second = rows.select("bucket", every("n_i").alias("i"), block("n_j").alias("j"), F.lit(1).alias("side"), *columns)
        return first.union(second).repartition(*group).sortWithinPartitions(*group)

    def groups(batches):
        """The groups, as arrays by column, that lie in order in the batches."""
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            of = {c: b[c].to_numpy() for c in b.columns}
            new = np.append(True, np.any([of[c][1:] != of[c][:-1] for c in group], axis=0))
            start = np.flatnonzero(new)
            for lo, hi in zip(start[:-1], start[1:]):
                yield {c: x[lo:hi] for c, x in of.items()}
            held = b.iloc[start[-1]:] if len(start) else None
        if held is not None and len(held):
            yield {c: held[c].to_numpy() for c in held.columns}

    def candidates(g: dict):
        """(i, those j that lengths and bags do not rule out, bags' distances) of each asking row i."""
        x, y = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
        key, root, n, asks = g["key"], g["root"], g["n_words"], g["asks"].astype(bool)
        if not len(x) or not len(y):
            return
        bags = coarse = None
        most = lambda i, j: ((1.0 - threshold) * np.maximum(n[j], n[i]) + 1e-9).astype(np.int64)
        for i in x:
            j = y[np.abs(n[y] - n[i]) <= most(i, y)]
            j = j[(root[j] != root[i]) & (~asks[j] | (key[j] > key[i]))]
            if not len(j):
                continue
            if bags is None:
                bags = np.frombuffer(b"".join(g["bag"]), np.uint8).reshape(-1, FINE).astype(np.int32)
                coarse = bags.reshape(len(bags), FINE // BINS, BINS).sum(axis=1)
            for own in (coarse, bags):
                apart = (np.abs(own[j] - own[i]).sum(axis=1) + np.abs(own[j].sum(axis=1) - own[i].sum())) // 2
                j, apart = j[apart <= most(i, j)], apart[apart <= most(i, j)]
            if len(j):
                yield i, j, apart

    def meeting(batches):
        """The rows that have a candidate."""
        for part in packs(groups(batches), 4096):
            out = []
            for g in part:
                met = {k for i, j, _ in candidates(g) for k in (i, *j)}
                out += [(g["bucket"][k], g["key"][k]) for k in met]
            yield pd.DataFrame(out, columns=["bucket", "key"])

    def joining(batches):
        """Near pairs of candidates, the closest first, whose classes no link of the group has joined yet."""
        for g in groups(batches):
            pairs = [(d, i, k) for i, j, apart in candidates(g) for d, k in zip(apart.tolist(), j.tolist()) if first_shared(g, i, k)]
            pairs.sort(key=lambda p: p[0])
            into: dict = {}

            def top(x):
                while x in into:  # noqa: B023
                    x = into[x]  # noqa: B023
                return x
            out, words, ahead = [], functools.cache(lambda k: g["text"][k].lower().split()), 1  # noqa: B023
            while pairs:
                own, pairs = pairs[:ahead], pairs[ahead:]
                open_ = [p for p in own if top(g["root"][p[1]]) != top(g["root"][p[2]])]
                for (_, i, k), (near, _) in zip(open_, verify_pairs([(words(i), words(k)) for _, i, k in open_], threshold)):
                    a, b = top(g["root"][i]), top(g["root"][k])
                    if near and a != b:
                        into[a] = b
                        out.append((min(g["key"][i], g["key"][k]), max(g["key"][i], g["key"][k])))
                ahead = min(2 * ahead, 256)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    def first_shared(g: dict, i: int, k: int) -> bool:
        """Whether no smaller bucket holds both texts, one of them asking."""
        at, to = g["buckets"][i], g["buckets"][k]
        own = np.concatenate([np.intersect1d(g["asked"][i], to), np.intersect1d(at, g["asked"][k])])
        return own.min() == g["bucket"][i]

    bags = texts.join(own.select("key").distinct(), "key", "left_semi").mapInPandas(fine, "key binary, bag binary")
    facts = own.join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = facts.join(bags, "key")
    met = dealt(rows, "key", "n_words", "bag", "root", "asks").mapInPandas(meeting, "bucket bigint, key binary").distinct()
    met = written(met, "omh-meeting")
    held = own.join(met.select("key").distinct(), "key", "left_semi").groupBy("key").agg(
        F.collect_list("bucket").alias("buckets"), F.collect_list(F.when(F.col("asks"), F.col("bucket"))).alias("asked"))
    few = rows.join(met, ["bucket", "key"], "left_semi").join(held, "key").join(texts.select("key", "text"), "key")
    out = dealt(few, "key", "n_words", "bag", "root", "asks", "buckets", "asked", "text").mapInPandas(joining, "a binary, b binary")
    out = written(out.distinct(), "omh-joining")
    forget(own, met)
    return out


def packs(items, size: int):
    """Lists of up to ``size`` items."""
    items = iter(items)
    while part := list(itertools.islice(items, size)):
        yield part


def reach(n: str, m: str, threshold: float):
    """Edits that leave the similarity at the threshold or above."""
    return F.floor((1.0 - threshold) * F.greatest(n, m) + 1e-9).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """(key, root): the smallest key of the component.  Each key goes to its
    smallest neighbour's smallest neighbour; edges between what is left are
    kept once, so a group of many links shrinks to one key in a few turns."""
    left = written(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u != v").distinct(), "cc-edges")
    labels = None
    while labels is None or not left.isEmpty():
        both = left.union(left.select("v", "u"))
        to = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "cc-to")
        jump = to.join(to.select(F.col("u").alias("to"), F.col("to").alias("further")), "to", "left")
        jump = written(jump.select("u", F.coalesce("further", "to").alias("to")), "cc-jump")
        ends = left.join(jump, "u").select(F.col("to").alias("x"), F.col("v").alias("u")).join(jump, "u").select("x", F.col("to").alias("y")).filter("x != y")
        rest = written(ends.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "cc-edges")
        if labels is None:
            new = jump.select(F.col("u").alias("key"), F.col("to").alias("root"))
        else:
            new = labels.join(jump.select(F.col("u").alias("root"), "to"), "root", "left").select("key", F.coalesce("to", "root").alias("root"))
        new = written(new, "cc")
        forget(left, to, jump, *([labels] if labels is not None else []))
        left, labels = rest, new
    forget(left)
    return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, class_id, n_copies, n_links, kept) of every row.

    class_id: the smallest id of the class; n_copies: rows with this very
    text; n_links: verified links of the text to other texts found on the
    way (a leader's star, not all pairs); kept: the row stands for its class,
    by id and text (rows that repeat both are all marked).
    """
    sketches = written(sketch_texts(docs), "omh")
    edges = written(links(sketches, docs, threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "omh-links")
    rows = written(sketches.select("id", "key"), "omh-rows")
    forget(sketches)
    roots = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    texts = rows.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies"))
    texts = written(texts.join(roots, "key", "left").join(degree, "key", "left")
                    .select("key", F.coalesce("root", "key").alias("root"), "first_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "omh-texts-classes")
    first = F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("first")
    classes = written(texts.groupBy("root").agg(first).select("root", F.col("first.first_id").alias("class_id"), F.col("first.key").alias("stands")), "omh-classes")
    by_text = texts.join(classes, "root").select("key", "class_id", "n_copies", "n_links", (F.col("key") == F.col("stands")).alias("stands"))
    return (rows.select(F.col("id").alias("doc_id"), "key").join(by_text, "key")
            .withColumn("kept", F.col("stands") & F.col("doc_id").eqNullSafe(F.col("class_id")))
            .select("doc_id", "key", "class_id", "n_copies", "n_links", "kept"))
