"""Language identification (operator 2): sparse multinomial logistic
regression on TF-IDF character n-grams, trained with follow-the-regularised-
leader (FTRL-proximal) under an elastic-net penalty, then calibrated by one
temperature.

* Features: character 2- and 3-grams of the lower-cased text, hashed into
  ``DIM`` columns; weight = count / all n-grams of the text * idf.
* Document frequencies are counted over all training documents.
* The weights are fitted on a bounded sample: about ``PER_LANG`` training
  documents of each language, drawn by a hash of the id.  A fifth of the
  sample is kept from the fit and sets the temperature.
* The model is at most DIM x languages numbers, most of them zero; it is the
  only thing that is broadcast.

Defined results: a null text, or one without a letter, gets ``und`` and
score 0.0; rows with null ``lang`` are predicted and not learned from; with
no labelled row at all every text gets ``und``; an empty table gives an
empty frame; repeated rows are repeated; very long texts are read in
windows.  ``lang``, ``source`` and ids are never read by a prediction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import remainder

DIM = 1 << 16
PER_LANG = 1500
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-5, 1e-5
SCALE = 100.0  # a text's features sum to about SCALE * mean idf
WINDOW = 1 << 20


def grams(text: str) -> np.ndarray:
    """Columns of the 2- and 3-grams of a text, in windows that overlap."""
    text = " " + " ".join(text.lower().split()) + " "
    out = []
    for lo in range(0, max(len(text) - 2, 1), WINDOW):
        c = np.frombuffer(text[lo:lo + WINDOW + 2].encode("utf-32-le"), np.uint32).astype(np.uint64)
        two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] * np.uint64(0x165667B19E3779F9) + c[2:] * np.uint64(0x27D4EB2F165667C5)
        if lo + WINDOW + 2 < len(text):
            two = two[:-1]  # the next window begins with it
        out += [two, three]
    h = np.concatenate(out)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int64)


def has_letter(col: str = "text") -> Column:
    return F.coalesce(F.col(col).rlike(r"\p{L}"), F.lit(False))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each column, and how many texts there are."""
    def run(batches):
        df, n, seen = np.zeros(DIM, np.int64), 0, np.zeros(DIM, np.int64)
        for b in batches:
            for t in b["text"]:
                seen[:] = 0
                seen[grams(t)] = 1
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"col": np.append(at, -1), "n": np.append(df[at], n)})
    counted = docs.select("text").mapInPandas(run, "col int, n bigint").groupBy("col").agg(F.sum("n").alias("n"))
    df, total = np.zeros(DIM), 0
    for col, n in counted.toPandas().itertuples(index=False):  # at most DIM + 1 rows
        if col < 0:
            total = int(n)
        else:
            df[col] = n
    return df, total


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Per-coordinate FTRL-proximal for multinomial logistic regression."""

    def __init__(self, dim: int, classes: int):
        self.z, self.n = np.zeros((dim, classes)), np.zeros((dim, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = softmax(x @ w)
        g[label] -= 1.0
        g = x[:, None] * g[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = np.unique(grams(text), return_counts=True)
    return at.astype(np.int32), (counts * (SCALE / counts.sum()) * idf[at]).astype(np.float32)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section
    over its logarithm.  Targets are smoothed as in Platt scaling, (n + 1) /
    (n + 2) for the label, so that a sample without errors doesn't ask for
    certainty."""
    n, k = logits.shape
    target = np.full((n, k), 1.0 / (n + 2) / max(k - 1, 1))
    target[np.arange(n), labels] = (n + 1) / (n + 2)

    def loss(log_t):
        return -(target * np.log(np.maximum(softmax(logits / np.exp(log_t)), 1e-300))).sum(axis=1).mean()
    lo, hi, r = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, temp: float):
        self.langs, self.weights, self.temp = langs, weights, temp  # weights: idf already in

    def predict(self, text: str) -> tuple[str, float]:
        at = grams(text)
        p = softmax(self.weights[at].sum(axis=0, dtype=np.float64) * (SCALE / len(at)) / self.temp)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def train(labelled: DataFrame, id_col: str = "doc_id", per_lang: int = PER_LANG) -> Model | None:
    """Fit on (id, text, lang) rows; None if no row is labelled.

    The fit runs in one task on the bounded sample and returns its weights
    as rows, at most DIM x languages of them.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & has_letter())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    df, total = document_frequencies(rows)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]))]), F.col("lang"))
    order = F.xxhash64(F.col(id_col), F.lit(12))
    sample = rows.filter(u < rate).select("lang", "text", order.alias("o"))

    def fit(batches):
        data = []
        for b in batches:
            data += [(int(o), langs.index(lang), *features(t, idf)) for lang, t, o in zip(b["lang"], b["text"], b["o"])]
        data.sort(key=lambda d: d[0])
        held = [d for d in data if d[0] % 5 == 0] or data
        own = [d for d in data if d[0] % 5 != 0] or data
        model = Ftrl(DIM, len(langs))
        for _ in range(EPOCHS):
            for _, label, at, x in own:
                model.learn(at, x, label)
        w = model.weights()
        logits = np.array([x @ w[at] for _, _, at, x in held])
        temp = temperature(logits, np.array([d[1] for d in held]))
        col, k = np.nonzero(w)
        yield pd.DataFrame({"col": np.append(col, -1), "k": np.append(k, 0), "w": np.append(w[col, k], temp)})

    # the bounded sample is drawn by all tasks and then moves to one
    got = sample.repartition(1).mapInPandas(fit, "col int, k int, w double").toPandas()
    w, temp = np.zeros((DIM, len(langs)), np.float32), 1.0
    for col, k, x in got.itertuples(index=False):
        if col < 0:
            temp = x
        else:
            w[col, k] = x * idf[col]
    return Model(langs, w, temp)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` that the names do not clash with, and
    ``lang_pred``, ``score``."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "text", "readable__")]
    spark = docs.sparkSession
    if model is None:
        return docs.select(*keep, "text", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast((model.langs, model.weights, model.temp))

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            got = [m.predict(t) if ok else ("und", 0.0) for t, ok in zip(b["text"], b["readable__"])]
            b = b.drop(columns="readable__")
            yield b.assign(lang_pred=[g[0] for g in got], score=[g[1] for g in got])

    src = docs.select(*keep, "text", has_letter().alias("readable__"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("readable__").schema.fields]
    return src.mapInPandas(run, ", ".join([*fields, "lang_pred string", "score double"]))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: labelled, and crc32 of the id modulo 4 is not 2."""
    return docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (remainder("doc_id", 4) != 2))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every text."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    return predict(d, train(training_rows(docs))).select("doc_id", "held_out", "lang_pred", "score")
