"""Embedding whitening by QDWH spectral divide and conquer (operator 13).

* The fit list (each distinct vector once) is written; its sums are exact
  integers, its covariance is summed from centred blocks, one d x d matrix a
  task.  What reaches the driver is bounded by the dimension: d sums and
  d * (d + 1) / 2 products.
* The d x d covariance V is decomposed there.  The polar factor U of the
  shifted matrix V - s I, by the QR-based dynamically weighted Halley (QDWH)
  iteration, gives the spectral projector (U + I) / 2 on the eigenvalues
  above s.  An orthonormal basis of its range and of the complement splits V
  into two blocks; each is split again until blocks are scalar (or multiples
  of the identity).  Blocks below the components asked for are not split.
* Mean, components and eigenvalues (d x k numbers) go to all tasks, which
  project their rows.

Defined results: null vectors and vectors with null, NaN or infinite entries
take no part; nor do vectors whose length is not the usual one (the most
frequent length; of equally frequent ones the greatest), nor empty vectors.  A component
whose eigenvalue is not above ``FLAT`` times the trace has no variance that
doubles can tell from rounding and is not returned; so one distinct vector,
or none, gives an empty frame.  Repeated rows are whitened each, fitted
once; equal eigenvalues take any orthonormal basis of their space; a null
id passes.  A deviation beyond the range of a long is null, and entries
beyond it are held at its ends.  Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import written

KEEP = 4
FLAT = 1e-11
EPS = float(np.finfo(np.float64).eps)
LONG = 1 << 63


def polar(a: np.ndarray, most: int = 40) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH.

    The singular values of a / |a| lie above the bound ``low``, which starts
    at rounding level and tells each step's weights; QR of a stacked matrix
    keeps a step stable however ill-conditioned ``a`` is.
    """
    d, size = len(a), np.linalg.norm(a)
    x, low = a / size if size else np.eye(d), EPS / d
    for _ in range(most):
        q = low * low
        root = np.cbrt(4.0 * (1.0 - q) / (q * q)) if low < 1.0 else 0.0
        w = np.sqrt(1.0 + root)
        wa = w + 0.5 * np.sqrt(max(8.0 - 4.0 * root + 8.0 * (2.0 - q) / (q * w), 0.0))
        wb = 0.25 * (wa - 1.0) ** 2
        wc = wa + wb - 1.0
        both = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(d)]))[0]
        after = (wb / wc) * x + ((wa - wb / wc) / np.sqrt(wc)) * (both[:d] @ both[d:].T)
        after = 0.5 * (after + after.T)
        moved, x = np.linalg.norm(after - x), after
        low = min(low * (wa + wb * q) / (1.0 + wc * q), 1.0)
        if low > 1.0 - 8 * EPS and moved < EPS ** (1 / 3):
            break
    return x


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces of the greater and of the smaller
    eigenvalues; None if all are equal, as far as rounding tells."""
    d = len(a)
    mean = np.trace(a) / d
    if np.linalg.norm(a - mean * np.eye(d)) <= 4 * d * EPS * scale:
        return None
    diagonal, rng = np.sort(np.diag(a)), np.random.default_rng(d)
    best, left = None, np.inf
    # the mean parts unequal eigenvalues always; the median parts them evenly
    shifts = [np.median(diagonal), mean, *np.quantile(diagonal, [0.25, 0.75]), *rng.uniform(diagonal[0], diagonal[-1], 4)]
    for s in shifts:
        projector = 0.5 * (polar(a - s * np.eye(d)) + np.eye(d))
        r = int(round(np.trace(projector)))
        if not 0 < r < d:
            continue
        q = np.linalg.qr(projector @ rng.standard_normal((d, r)), mode="complete")[0]
        for _ in range(2):  # one more application of the projector cleans the basis
            q = np.linalg.qr(projector @ q[:, :r], mode="complete")[0]
            coupling = np.linalg.norm(q[:, r:].T @ a @ q[:, :r])
            if coupling < left:
                best, left = (q[:, :r], q[:, r:]), coupling
        if left <= 8 * d * EPS * scale:
            break
    if best is None:
        raise ArithmeticError("no shift parts the spectrum")
    return best


def components(v: np.ndarray, keep: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric
    matrix; with ``keep`` only that many of the greatest."""
    d = len(v)
    scale = np.linalg.norm(v)
    keep = d if keep is None else min(keep, d)
    found: list[tuple[float, np.ndarray]] = []
    todo = [(np.eye(d), v)]  # the block of the greatest eigenvalues is last
    while todo and len(found) < keep:
        basis, block = todo.pop()
        parts = None if len(block) == 1 else split(block, scale)
        if parts is None:
            found += [(block[i, i], basis[:, i]) for i in range(len(block))]
            continue
        for q in reversed(parts):
            inner = q.T @ block @ q
            todo.append((basis @ q, 0.5 * (inner + inner.T)))
    vectors = np.array([x / np.linalg.norm(x) for _, x in found]).T.reshape(d, -1)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])] < 0, -1.0, 1.0)
    values = np.einsum("ij,ik,kj->j", vectors, v, vectors)
    order = np.argsort(-values, kind="stable")[:keep]
    return values[order], vectors[:, order]


class Fit(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray   # k eigenvalues, falling
    vectors: np.ndarray  # d x k
    trace: float


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<bigint>): floor(256 * entry) of the rows that take part."""
    c = F.col(vector_col).cast("array<double>")
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = rows.filter(F.col(vector_col).isNotNull()).filter(~bad & (F.size(vector_col) > 0))
    x = F.transform(c, lambda e: F.floor(F.lit(256.0) * e))
    return ok.select(F.col(id_col).alias("vec_id"), x.alias("x"))


def usual_length(vectors: DataFrame) -> int:
    """The most frequent length, of equally frequent ones the greatest; 0 without rows."""
    first = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return first["d"] if first else 0


def sums_of(fit_list: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors, and their exact sums by dimension."""
    row = fit_list.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(d)]).first()
    return row["n"], [int(row[f"s{j}"]) for j in range(d)]


def matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["x"].to_numpy())


def covariance(fit_list: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Sum of products of centred rows over n; a task gives its upper
    triangle once, products of all tasks are added by place."""
    d = len(sums)
    mean = np.array([s / n for s in sums])
    at_i, at_j = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            if len(b):
                c = matrix(b) - mean
                total += c.T @ c
        yield pd.DataFrame({"i": at_i, "j": at_j, "p": total[at_i, at_j]})
    got = fit_list.select("x").mapInPandas(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).toPandas()
    v = np.zeros((d, d))
    v[got["i"], got["j"]] = got["p"] / n
    return v + np.triu(v, 1).T


def fit(fit_list: DataFrame, d: int, keep: int | None = KEEP) -> Fit | None:
    """Decompose the covariance of the fit list; None if nothing varies."""
    if d == 0:
        return None
    n, sums = sums_of(fit_list, d)
    v = covariance(fit_list, n, sums)
    trace = float(np.trace(v))
    if n < 2 or not trace > 0:
        return None
    values, vectors = components(v, keep)
    some = values > FLAT * trace
    return Fit(n, sums, values[some], vectors[:, some], trace)


def whiten(vectors: DataFrame, model: Fit) -> DataFrame:
    """(vec_id, deviation, w array<double>) of every row."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        mean = np.array([s / m.n for s in m.sums])
        onto = m.vectors / np.sqrt(m.values)
        wrapped = np.array([(s + LONG) % (2 * LONG) - LONG for s in m.sums], np.int64)
        for b in batches:
            if not len(b):
                continue
            x = matrix(b)
            about = ((x - mean) ** 2).sum(axis=1) * float(m.n) ** 2
            # arithmetic modulo 2^64 is exact for every sum that a long holds
            far = pd.Series(((m.n * x - wrapped) ** 2).sum(axis=1), dtype="Int64")
            far[about > 1.01 * LONG] = None
            for i in np.flatnonzero((about > 0.99 * LONG) & (about <= 1.01 * LONG)):
                exact = sum((m.n * int(e) - s) ** 2 for e, s in zip(x[i], m.sums))
                far[i] = exact if exact < LONG else None
            yield pd.DataFrame({"vec_id": b["vec_id"], "deviation": far, "w": list((x - mean) @ onto)})
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInPandas(run, f"vec_id {kind}, deviation bigint, w array<double>")


def identity_error(fit_list: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)
    if k == 0:
        return 0.0
    w = whiten(fit_list.select(F.lit(0).cast("bigint").alias("vec_id"), "x"), model)
    w = w.select(*[F.get("w", F.lit(j)).alias(f"w{j}") for j in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened_components(rows: DataFrame, keep: int = KEEP) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)
    of every row that takes part and every component up to ``keep``."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows)
    d = usual_length(vectors)
    vectors = vectors.filter(F.size("x") == d)
    fit_list = written(vectors.select("x").distinct(), "whitening-fit")
    model = fit(fit_list, d, keep)
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n bigint, "
                                         "deviation bigint, whitened double, explained double, identity_error double")
    error = identity_error(fit_list, model)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return (whiten(vectors, model).select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened"))
            .select("vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
                    "whitened", F.get(explained, F.col("c")).alias("explained"), F.lit(error).alias("identity_error")))
