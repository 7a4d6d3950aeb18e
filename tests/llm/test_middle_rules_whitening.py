"""Fill-in-middle, quality rules and whitening: brute force, held-out
accuracy, odd rows."""
import hashlib
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from starledger.llm import middle, queries, ruleset, whitening
from starledger.llm.common import ship

ODD = ["", None, "a", "é\U0001F600x\n y", "has <P> inside", "<S><M>", "<", "tail <P", "\r\n ", "\U0001F600" * 3000, "long text. " * 20_000]


def plain_fim(doc_id, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_odd_rows(spark):
    rows = [(i * 31 + j, t, "x", 5) for i in range(12) for j, t in enumerate(ODD)] + [(None, "a text without a name", "x", 5), (31, "a", "x", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, OUTPUT string, h int").repartition(3)
    got = middle.transform(docs).select("*", middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["h"] == 5
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert middle.digests(docs.limit(0)).count() == 0


def test_fill_in_middle_counts_blocks(spark):
    for n in (0, 1, 1023, 1024, 1025, 5000):
        t = ("ab\n\U0001F600" * n)[:n]
        assert spark.createDataFrame([(t,)], "t string").select(middle.units(F.col("t"))).first()[0] == n


def test_fill_in_middle_query(spark):
    got = {r["doc_id"]: r for r in queries.op11_fill_in_middle(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n, form, a, m, out = plain_fim(d["doc_id"], d["text"])
        g = got[d["doc_id"]]
        assert (g["n"], g["form"], g["prefix_chars"], g["middle_chars"]) == (n, form, a, m)
        assert g["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert g["restored_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def plain_statistics(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    lines = [x for x in text.split("\n") if x]
    n = len(words)
    return {"words": math.log1p(n), "distinct_words": len(set(words)) / n if n else 0.0,
            "echoes": sum(a == b for a, b in zip(words, words[1:])) / n if n else 0.0,
            "letters": sum(c.isalpha() for c in text) / len(text) if text else 0.0,
            "capitals": sum(c.isupper() for c in text) / len(text) if text else 0.0,
            "distinct_lines": len(set(lines)) / len(lines) if lines else 0.0, "line_words": n / len(lines) if lines else 0.0}


def test_statistics_equal_plain_python(spark):
    texts = ["", "a a b", "One two.\nOne two.\n\nthree", "ÀÉ fin 12 %%", " \n ", "x" * 30_000]
    docs = spark.createDataFrame([(t, "clash") for t in texts], "text string, words__ string")
    for r in ruleset.with_statistics(docs, [F.col("text").alias("t")]).collect():
        for k, v in plain_statistics(r["t"]).items():
            assert r[f"stat_{k}"] == pytest.approx(v), (k, r["t"][:20])


def test_compiled_rules_equal_the_rules(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, len(ruleset.STATS)))
    y = ((x[:, 2] > 0.5) & (x[:, 9] <= 0.7) | (rng.random(400) < 0.05)).astype(float)
    model = ruleset.fit_rules(x, y, np.ones(400))
    assert model.rules and all(c for c in model.rules)
    z = model.base + sum(w * ruleset.holds(r, x) for w, r in zip(model.weights, model.rules))
    frame = spark.createDataFrame(pd.DataFrame(x, columns=[f"stat_{s}" for s in ruleset.STATS]).assign(i=range(400)))
    got = {r["i"]: r["p"] for r in frame.select("i", ruleset.compiled(model).alias("p")).collect()}
    assert np.allclose([got[i] for i in range(400)], ruleset.logistic(z))
    assert (((ruleset.logistic(z) > 0.5) == y).mean()) > 0.9


def test_quality_held_out(spark):
    got = queries.op12_quality(spark, SF_MID)
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    held = got.join(labels, "doc_id").filter("held_out").selectExpr("avg(cast(predicted = quality as int))", "min(score)", "max(score)").first()
    assert held[0] > 0.95 and 0 <= held[1] <= held[2] <= 1
    again = queries.op12_quality(spark, SF_MID)
    assert got.exceptAll(again).count() == 0


def test_quality_odd_rows(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a text"), (2, None), (3, ""), (None, "no id"), (1, "a text"), (4, "w " * 50_000)], "doc_id bigint, text string") \
        .withColumn("score", F.lit("clash")).withColumn("key", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, 0), (None, 0, 0), (9, 5, 0)], "doc_id bigint, quality int, toxic int")
    got = ruleset.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = ruleset.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    one = ruleset.classify(docs, labels.filter("quality = 1")).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["score"] > 0.5
    assert ruleset.classify(docs.limit(0), labels).count() == 0


def test_spectral_division_against_eigh():
    rng = np.random.default_rng(1)
    for d in (1, 2, 7, 40):
        a = rng.standard_normal((d, d))
        for v in (a @ a.T, a @ np.diag([*[3.0] * (d // 2), *[1.0] * (d - d // 2)]) @ a.T, np.eye(d), np.ones((d, d)), np.diag(np.logspace(0, -9, d))):
            e, q = whitening.components(v)
            assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * np.linalg.norm(v))
            assert np.allclose(q.T @ q, np.eye(d), atol=1e-12) and np.allclose(v @ q, q * e, atol=1e-12 * np.linalg.norm(v))
            assert np.allclose(whitening.components(v, 4)[0], e[:4])
    u = whitening.polar(np.diag([2.0, -1e-9, 5.0, -3.0]))
    assert np.allclose(u, np.diag([1.0, -1.0, 1.0, -1.0]))


def brute(rows, keep=4):
    rows = [(i, [math.floor(256 * float(c)) for c in e]) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    x = np.array(sorted({tuple(e) for _, e in rows}), np.float64)
    n, s = len(x), [sum(int(r[j]) for r in x) for j in range(x.shape[1])]
    c = x - x.mean(axis=0)
    e, q = np.linalg.eigh(c.T @ c / n)
    return rows, n, s, e[::-1][:keep], q[:, ::-1][:, :keep], np.trace(c.T @ c / n)


def test_whitening_query_against_eigh(spark):
    got = pd.DataFrame([r.asDict() for r in queries.op13_whitening(spark, SF_SMALL).collect()])
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    rows, n, s, e, q, trace = brute(table)
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n} and got["identity_error"].max() <= 1e-8 and got["identity_error"].nunique() == 1
    by = {(r.vec_id, r.component): r for r in got.itertuples()}
    mean = np.array(s) / n
    for j in range(4):
        want = np.array([(np.array(x) - mean) @ q[:, j] / math.sqrt(e[j]) for _, x in rows])
        have = np.array([by[i, j + 1].whitened for i, _ in rows])
        assert np.allclose(have, want * np.sign(want @ have), atol=1e-6)
        assert all(abs(by[i, j + 1].explained / (e[j] / trace) - 1) < 1e-9 for i, _ in rows)
    assert all(by[i, 1].deviation == sum((n * a - b) ** 2 for a, b in zip(x, s)) for i, x in rows)


def test_whitening_odd_rows(spark):
    ship(spark)
    schema = "vec_id bigint, embedding array<float>, x string, n int"
    rows = [(1, [0.5, 0.25, 1.0]), (2, [0.1, -0.25, 0.0]), (3, None), (4, [None, 0.0, 1.0]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0]),
            (7, [0.5, 0.25, 1.0]), (None, [0.0, 3.0, 0.5]), (8, [1.0]), (9, []), (7, [0.5, 0.25, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)
    got = whitening.whitened_components(df).collect()
    kept, n, s, e, q, _ = brute([r for r in rows if r[1] is not None and len(r[1]) == 3])
    assert len(got) == 2 * len(kept) and {r["n"] for r in got} == {3}  # three points span two components
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in kept for _ in range(2))
    dev = {i: sum((n * a - b) ** 2 for a, b in zip(x, s)) for i, x in kept}
    assert all(r["deviation"] == dev[r["vec_id"]] for r in got)
    assert whitening.whitened_components(df.filter("vec_id in (1, 7)")).count() == 0
    empty = whitening.whitened_components(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_far_entries(spark):
    ship(spark)
    rows = [(i, [float(v), 1.0 * i]) for i, v in enumerate((2e7, -2e7, 1e30, 0.0))]
    got = whitening.whitened_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert got and all(r["deviation"] is None for r in got if r["vec_id"] == 2)
    near = whitening.whitened_components(spark.createDataFrame([(i, [v * 1e6, 0.5]) for i, v in enumerate((1.0, -1.0, 3.0, 0.0, 0.1))], "vec_id bigint, embedding array<double>"))
    _, n, s, *_ = kept = brute([(i, [v * 1e6, 0.5]) for i, v in enumerate((1.0, -1.0, 3.0, 0.0, 0.1))])
    want = {i: sum((n * a - b) ** 2 for a, b in zip(x, s)) for i, x in kept[0]}
    assert {r["vec_id"]: r["deviation"] for r in near.collect()} == {i: v if v < 1 << 63 else None for i, v in want.items()}
