"""Quality classifier as a sparse rule ensemble (operator 12).

* Statistics of a text (shares of letters, capitals, symbols, repeated words
  and so on) are built-in column expressions; they are computed once for each text and
  written, about a hundred bytes a row.
* A bounded sample of labelled rows trains boosted trees of depth ``DEPTH``.
  Every node of a tree is a conjunctive rule: the comparisons on its path.
* A logistic regression with a lasso penalty weighs the rules; the penalty is
  the one of least loss on a fifth of the sample.  Most weights are zero.
* The rules that are left compile into one Spark column over the statistics,
  so that scoring is a projection; no row passes a Python worker.

``PER_LABEL`` bounds the sample: about so many rows of each label, drawn by a
hash; their weights restore the labels' shares.  Only the fit, in one task, sees them; statistics and scores cover all rows.

Defined results: null text counts as ''; empty texts have statistics of 0
and get a score like any other; labels other than 0 and 1 are not learned
from; repeated labelled rows count once; a document with both labels is
learned from with both; without labels, or with one label only, every text
gets the smoothed share of label 1, (n1 + 1) / (n + 2); an empty table gives
an empty frame.  Ids and other columns are never read by a score.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import remainder, text_or_empty, written

PER_LABEL = 10_000
TREES, DEPTH, CUTS, RATE, LEAST_ROWS = 30, 3, 31, 0.3, 10
PENALTIES = (0.1, 0.03, 0.01, 0.003, 0.001)  # shares of the least penalty that leaves no rule
THRESHOLD = 0.3
STATS = ("words", "word_chars", "letters", "capitals", "digits", "symbols", "marks", "odd_ends", "bare_marks",
         "distinct_words", "echoes", "distinct_lines", "line_words")


def statistics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """name -> double; every share of nothing is 0."""
    chars = F.length(text)
    n = F.size(words)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole.cast("double")).otherwise(0.0)

    def of_class(cls: str) -> Column:
        return share(F.length(F.regexp_replace(text, f"[^{cls}]+", "")), chars)
    return {
        "words": F.log1p(n.cast("double")),
        "word_chars": share(F.length(F.regexp_replace(text, r"\s+", "")), n),
        "letters": of_class(r"\p{L}"),
        "capitals": of_class(r"\p{Lu}"),
        "digits": of_class(r"\p{Nd}"),
        "symbols": of_class(r"\p{S}#%&*@\\/_"),
        "marks": of_class(r".,;:!?"),
        "odd_ends": share(F.size(F.filter(words, lambda w: w.rlike(r"[^\p{L}\p{Nd}.,;:?]\z"))), n),
        "bare_marks": share(F.size(F.filter(words, lambda w: ~w.rlike(r"[\p{L}\p{Nd}]"))), n),
        "distinct_words": share(F.size(F.array_distinct(words)), n),
        "echoes": share(F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))), n),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": share(n, F.size(lines)),
    }


def with_statistics(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` and the statistics of every whole text, as columns ``stat_<name>``."""
    words = F.filter(F.split("text__", r"\s+"), lambda w: w != "")
    lines = F.filter(F.split("text__", r"\n"), lambda w: w != "")
    d = docs.select(*keep, text_or_empty(text_col).alias("text__"))
    d = d.withColumns({"words__": words, "lines__": lines})
    stats = statistics(F.col("text__"), F.col("words__"), F.col("lines__"))
    return d.select(*d.columns[:len(keep)], *[stats[s].cast("double").alias(f"stat_{s}") for s in STATS])


class Condition(NamedTuple):
    stat: int
    above: bool  # value > bound, else value <= bound
    bound: float


class Rules(NamedTuple):
    base: float
    weights: list[float]
    rules: list[tuple[Condition, ...]]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def cut_points(x: np.ndarray) -> np.ndarray:
    """At most CUTS bounds between neighbouring distinct values of a statistic."""
    values = np.unique(x)
    if len(values) < 2:
        return np.empty(0)
    at = np.unique(np.quantile(np.arange(len(values) - 1), np.linspace(0, 1, CUTS)).astype(int))
    spread = np.unique(np.quantile(x, np.linspace(0, 1, CUTS + 2)[1:-1]))
    near = np.clip(np.searchsorted(values, spread), 0, len(values) - 2)
    at = np.union1d(at, near)
    return (values[at] + values[at + 1]) / 2


def grow(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray,
         path: tuple[Condition, ...], out: list, depth: int) -> np.ndarray:
    """A regression tree on gradients: adds the path of each node to ``out``
    and returns the steps of all rows of ``x``."""
    total_g, total_h = grad[rows].sum(), hess[rows].sum()
    if path:
        out.append(path)
    step = np.full(len(x), total_g / (total_h + 1.0))
    best = (1e-9, None, None)
    if depth and len(rows) >= 2 * LEAST_ROWS:
        for s, at in enumerate(cuts):
            if not len(at):
                continue
            b = bins[rows, s]
            size = len(at) + 1
            g, h, n = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], None))
            gain = g * g / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0) - total_g ** 2 / (total_h + 1.0)
            gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = -1.0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], s, k)
    if best[1] is None:
        return step
    _, s, k = best
    bound, low = float(cuts[s][k]), bins[rows, s] <= k
    left = grow(x, cuts, bins, grad, hess, rows[low], path + (Condition(s, False, bound),), out, depth - 1)
    right = grow(x, cuts, bins, grad, hess, rows[~low], path + (Condition(s, True, bound),), out, depth - 1)
    return np.where(bins[:, s] <= k, left, right)


def simplified(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The tightest comparison for each statistic and side, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for c in path:
        old = tight.get((c.stat, c.above))
        tight[c.stat, c.above] = c.bound if old is None else (max if c.above else min)(old, c.bound)
    return tuple(Condition(s, above, b) for (s, above), b in sorted(tight.items()))


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, above, bound in rule:
        out &= (x[:, s] > bound) == above
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[tuple[Condition, ...]]:
    """Distinct rules of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(12)
    cuts = [cut_points(x[:, s]) for s in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, s], side="left") for s, c in enumerate(cuts)], axis=1)
    share = (weight @ y) / weight.sum()
    z = np.full(len(x), np.log(share / (1.0 - share)))
    paths: list[tuple[Condition, ...]] = []
    for _ in range(TREES):
        p = logistic(z)
        rows = np.flatnonzero(rng.random(len(x)) < 0.5)
        if len(rows):
            z += RATE * grow(x, cuts, bins, weight * (y - p), weight * p * (1.0 - p), rows, (), paths, DEPTH)
    return list(dict.fromkeys(simplified(p) for p in paths))


def lasso(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: tuple[float, np.ndarray],
          rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the weighted logistic loss with an
    absolute penalty on each weight (not on the base)."""
    w8 = weight / weight.sum()
    step = 4.0 / (np.linalg.norm(r * np.sqrt(w8)[:, None], 2) ** 2 + 1.0)
    base, w = start
    ahead_b, ahead_w, t = base, w, 1.0
    for _ in range(rounds):
        err = w8 * (logistic(ahead_b + r @ ahead_w) - y)
        new_b, moved = ahead_b - step * err.sum(), ahead_w - step * (r.T @ err)
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0.0)
        t2 = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        ahead_b, ahead_w = new_b + (t - 1.0) / t2 * (new_b - base), new_w + (t - 1.0) / t2 * (new_w - w)
        change = np.abs(new_w - w).max(initial=abs(new_b - base))
        base, w, t = new_b, new_w, t2
        if change < 1e-7:
            break
    return base, w


def fit_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Rules:
    """Trees, their rules, and the lasso over them."""
    rules = tree_rules(x, y, weight)
    r = np.array([holds(c, x) for c in rules], np.float64).T.reshape(len(x), -1)
    spread = np.sqrt(np.maximum(r.mean(axis=0) * (1 - r.mean(axis=0)), 1e-12))
    some = (r.mean(axis=0) * len(x) >= LEAST_ROWS) & ((1 - r.mean(axis=0)) * len(x) >= LEAST_ROWS)
    _, first = np.unique(r, axis=1, return_index=True)  # of rules that hold for the same rows the first
    some &= np.isin(np.arange(r.shape[1]), first)
    rules = [c for c, ok in zip(rules, some) if ok]
    r, spread = r[:, some], spread[some]
    std = r / spread
    share = (weight @ y) / weight.sum()
    null = (float(np.log(share / (1 - share))), np.zeros(len(rules)))
    if not rules:
        return Rules(null[0], [], [])
    held = np.arange(len(x)) % 5 == 0
    top = np.abs(std.T @ (weight / weight.sum() * (share - y))).max()

    def loss(model):
        p = np.clip(logistic(model[0] + std[held] @ model[1]), 1e-9, 1 - 1e-9)
        return -(weight[held] @ (y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)))
    model, tried = null, []
    for share_of_top in PENALTIES:
        model = lasso(std[~held], y[~held], weight[~held], share_of_top * top, model)
        tried.append((loss(model), share_of_top))
    base, w = lasso(std, y, weight, min(tried)[1] * top, model)
    left = np.flatnonzero(w)
    return Rules(float(base), [float(w[k] / spread[k]) for k in left], [rules[k] for k in left])


def train(labelled: DataFrame, per_label: int = PER_LABEL) -> Rules:
    """Fit on rows of (statistics, quality, key), one task on the bounded sample."""
    counts = {r["quality"]: r["n"] for r in labelled.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    if not ones or not zeros:
        p = (ones + 1) / (ones + zeros + 2)
        return Rules(float(np.log(p / (1 - p))), [], [])
    rates = {1: min(1.0, per_label / ones), 0: min(1.0, per_label / zeros)}
    u = F.pmod(F.xxhash64("key", F.lit(21)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(u < F.when(F.col("quality") == 1, rates[1]).otherwise(rates[0]))
    cols = [f"stat_{s}" for s in STATS]

    def run(batches):
        data = pd.concat([b for b in batches], ignore_index=True).sort_values(["key", "quality"])
        y = data["quality"].to_numpy(np.float64)
        if not 0 < y.sum() < len(y):
            yield pd.DataFrame({"rule": [-1], "stat": [0], "above": [False], "bound": [0.0], "weight": [np.log((y.sum() + 1) / (len(y) - y.sum() + 1))]})
            return
        m = fit_rules(data[cols].to_numpy(np.float64), y, np.where(y > 0, 1 / rates[1], 1 / rates[0]))
        rows = [(-1, 0, False, 0.0, m.base)]
        rows += [(i, *c, w) for i, (w, rule) in enumerate(zip(m.weights, m.rules)) for c in rule]
        yield pd.DataFrame(rows, columns=["rule", "stat", "above", "bound", "weight"])

    # at most TREES * 2^(DEPTH + 1) rules of DEPTH comparisons come back
    got = (sample.select("key", "quality", *cols).repartition(1)
           .mapInPandas(run, "rule int, stat int, above boolean, bound double, weight double").collect())
    by: dict[int, list] = {}
    for g in got:
        by.setdefault(g["rule"], []).append(g)
    base = by.pop(-1)[0]["weight"]
    return Rules(base, [v[0]["weight"] for v in by.values()],
                 [tuple(Condition(c["stat"], c["above"], c["bound"]) for c in v) for v in by.values()])


def compiled(model: Rules) -> Column:
    """The score as one expression over the ``stat_`` columns."""
    z = F.lit(model.base)
    for weight, rule in zip(model.weights, model.rules):
        cond = None
        for c in rule:
            stat = F.col(f"stat_{STATS[c.stat]}")
            one = stat > c.bound if c.above else stat <= c.bound
            cond = one if cond is None else cond & one
        z = z + F.when(cond, weight).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))))


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics with labels of documents whose crc32 of the id modulo 5 is
    not 0; equal rows count once."""
    known = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0))
             .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct())
    cols = [f"stat_{s}" for s in STATS]
    rows = stats.select("doc_id", *cols).join(known, "doc_id").distinct()
    return rows.select(F.xxhash64("doc_id", *cols).alias("key"), "quality", *cols)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text."""
    keep = [F.col("doc_id").cast("bigint").alias("doc_id"), (remainder("doc_id", 5) == 0).alias("held_out")]
    stats = written(with_statistics(docs, keep), "quality-statistics")
    scored = stats.select("doc_id", "held_out", compiled(train(training_rows(stats, labels))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
