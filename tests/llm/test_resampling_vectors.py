"""Resampling, one-bit neighbours and whitening: brute force in Python, edge cases, sizes of blocks."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sablewright.llm import neighbours, resampling, vectors, whitening
from sablewright.llm.common import settled

# --- op11


def brute_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_features(t, longest):
    w = brute_words(t)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute_scores(docs, target, buckets, longest):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in brute_features(x, longest)) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in docs:
        f = brute_features(x, longest)
        weight = sum(gain(bucket(y)) for y in f)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(brute_words(x)), len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


DOCS = [(1, "Alpha beta GAMMA delta"), (2, None), (3, ""), (4, "Éa É a-b_c 12x\tÜBER straße 日本 word"), (5, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (None, "no id but words"), (7, "  .,;  "), (8, "x"), (9, "beta " * 30000), (10, "a퟿b 🙂🙂 c")]
TARGET = ["alpha alpha beta", None, "", "Über 日本 x"]


def odd(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, "0", 1, "f", 2.5) for i, t in rows], "doc_id long, text string, score string, rank int, weight string, place double")


@pytest.mark.parametrize("longest", [1, 3])
def test_scores_by_hand(spark, longest):
    docs, target = odd(spark), spark.createDataFrame([(t,) for t in TARGET], "text string")
    gain = resampling.fitted(docs, target, buckets=50, longest=longest)
    got = [tuple(r) for r in resampling.scored(docs, gain, longest=longest).collect()]
    assert sorted(got, key=repr) == sorted(brute_scores(DOCS, TARGET, 50, longest), key=repr)


@pytest.mark.parametrize("percent", [0, 1, 30, 100])
def test_ranks_by_hand(spark, percent):
    r = np.random.default_rng(percent)
    rows = [(int(i) if i else None, int(w), int(s)) for i, w, s in zip(r.integers(0, 900, 3000), r.integers(0, 4, 3000), r.integers(-40, 40, 3000), strict=True)]
    df = settled(spark.createDataFrame([(i, w, None if i is None else s) for i, w, s in rows], "doc_id long, n_words long, score long").repartition(7))
    able = sorted((-s, i) for i, w, s in rows if i is not None and w >= 2)
    got = resampling.ranked(df, percent=percent, least_words=2).collect()
    assert len(got) == len(rows)
    assert [(-x.score, x.doc_id) for x in sorted((x for x in got if x.rank), key=lambda x: x.rank)] == able[: percent * len(able) // 100]
    assert sorted(x.rank for x in got if x.rank) == list(range(1, percent * len(able) // 100 + 1))


def test_draw_keeps_columns_and_empty_tables(spark):
    docs, target = odd(spark, [(i, "alpha " * (i % 30) + f"w{i}") for i in range(200)]), spark.createDataFrame([("alpha",)], "text string")
    got = resampling.drawn(docs, target, buckets=100)
    want = resampling.ranked(settled(resampling.scored(docs, resampling.fitted(docs, target, buckets=100)))).where("rank is not null")
    assert got.columns == docs.columns and sorted(x.doc_id for x in got.collect()) == sorted(x.doc_id for x in want.collect())
    nothing = docs.limit(0)
    assert resampling.drawn(nothing, target).count() == 0 and resampling.drawn(docs, target.limit(0), percent=50).count() > 0
    assert resampling.ranked(settled(resampling.scored(nothing, resampling.fitted(nothing, target)))).count() == 0


def test_scoring_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = resampling.scored(docs, [1] * 10000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Python" not in plan


# --- op12


def brute_nearest(rows, k, every):
    """rows: (id, vector) that can be used."""
    rows = list({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in rows], float)
    out = set()
    for n, (i, v) in enumerate(rows):
        if i % every == 0:
            s = (x * np.array(v)).sum(1)
            order = sorted((m for m in range(len(rows)) if m != n), key=lambda m: (-round(s[m], 9), rows[m][0]))[:k]
            out |= {(i, place + 1, rows[m][0], round(s[m], 6)) for place, m in enumerate(order)}
    return out


def vector_rows(n, d, seed=0):
    r = np.random.default_rng(seed)
    x = r.integers(-8, 9, (n, d)).astype(float)
    x[n // 3 : n // 2] = x[0]  # copies
    x[n // 2 : 2 * n // 3] = x[1] + r.integers(0, 2, (2 * n // 3 - n // 2, d)) / 4  # near copies
    x[(x == 0).all(1)] = 1
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_neighbours_by_hand(spark):
    rows = vector_rows(240, 12) + [(3, [1.0] * 12), (3, [2.0] * 12), (20, [0.5] * 12), (5, vector_rows(240, 12)[5][1])]
    bad = [(1000, None), (1020, [0.0] * 12), (1040, [1.0] * 11), (1060, []), (1080, [float("nan")] * 12), (1100, [float("inf")] + [0.0] * 11), (1120, [None] + [1.0] * 11), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v, "c", 1, "s") for i, v in rows + bad], "vec_id long, embedding array<double>, cell string, rank int, score string").repartition(5)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=7, sigmas=1e6, block=4, stripe=40, stripes=3)
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in got.collect()} == brute_nearest(rows, 7, 20)


def test_neighbours_of_small_tables(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(0, i, i, 1.0) for i in range(1, 5)]
    assert neighbours.nearest(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(df, F.lit(None).cast("boolean")).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]


def test_neighbour_recall_and_pruning():
    """At four sigmas nearly nothing is lost, and far from all pairs are compared."""
    r = np.random.default_rng(5)
    x = r.normal(size=(20000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    mean, turn = x.mean(0), neighbours.rotation(64, 256, 12)
    assert np.allclose(turn.T @ turn, np.eye(64), atol=1e-5)
    code, *scalars = neighbours.encode(x, mean, turn)
    s = neighbours.Search(np.arange(200), x[:200], 21, mean, turn, 4.0)
    for i in range(0, len(x), 1024):
        j = slice(i, i + 1024)
        s.look(np.stack([np.arange(len(x))] * 2, 1)[j], x[j], code[j], np.stack(scalars, 1)[j])
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :21]
    hit = np.mean([len(set(a) & set(b)) / 21 for a, b in zip(s.found[:, :, 0], true, strict=True)])
    assert hit > 0.999 and s.compared < 0.25 * 200 * len(x)


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(6)
    x, q = r.normal(size=(4000, 32)), r.normal(size=32)
    turn = neighbours.rotation(32, 128, 1)
    code, factor, off, _ = neighbours.encode(x, np.zeros(32), turn)
    estimate = ((np.unpackbits(code, axis=1) * 2.0 - 1) @ (turn @ q)) * factor
    error = (estimate - x @ q) / (off * np.linalg.norm(q))
    assert abs(error.mean()) < 0.1 and 0.8 < error.std() < 1.2 and np.abs(error).max() < 5


# --- op13


def brute_whitening(rows, k=16):
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in rows], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, s = len(fit), fit.sum(0)
    c = ((n * fit - s).astype(float)) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return n, [int(((n * y - s) ** 2).sum()) for y in x], ((n * x - s).astype(float) / n) @ u[:, :k] / np.sqrt(e[:k]), e / e.sum()


def test_whitening_by_hand(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(r.normal(size=(300, 20)) * np.arange(1, 21))]
    rows += rows[:40] + [(900, rows[0][1])] * 100  # repeated rows and copies count once in the fit
    bad = [(1000, None), (1001, []), (1002, [1.0] * 19), (1003, [None] + [1.0] * 19), (1004, [float("nan")] * 20), (1005, [float("-inf")] * 20)]
    df = spark.createDataFrame([(i, v, "x", 1.5, "d") for i, v in rows + bad], "vec_id long, embedding array<double>, x string, whitened double, deviation string").repartition(6)
    got, w, error = whitening.whitened(df.select("vec_id", "embedding", "x"))
    assert got.columns == ["vec_id", "embedding", "x", "deviation", "whitened"]
    n, dev, want, share = brute_whitening(rows)
    got = sorted(got.collect(), key=lambda z: z.vec_id)
    order = sorted(range(len(rows)), key=lambda j: rows[j][0])
    assert w.n == n == 300 and error < 1e-9 and [g.deviation for g in got] == [dev[j] for j in order]
    sign = np.sign((np.array([g.whitened for g in got]) * want[order]).sum(0))
    assert np.allclose(np.array([g.whitened for g in got]) * sign, want[order], atol=1e-9)
    assert np.allclose(w.values / w.trace, share, atol=1e-12)


def test_whitening_edges(spark):
    one = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out, w, error = whitening.whitened(one([(1, [0.5, 2.0]), (2, [0.5, 2.0])]))  # a single distinct vector
    assert [(r.deviation, r.whitened) for r in out.collect()] == [(0, [None, None])] * 2 and w.n == 1 and error is None
    out, w, error = whitening.whitened(one([(1, [0.0, 3.0]), (2, [1.0, 3.0])]))  # a constant dimension
    got = {r.vec_id: r for r in out.collect()}
    assert got[1].whitened[1] is None and abs(abs(got[1].whitened[0]) - 1) < 1e-12 and got[1].deviation == 64 * 64 and error < 1e-12
    for rows in ([], [(1, None)]):
        out, w, error = whitening.whitened(one(rows))
        assert out.count() == 0 and w is None and error is None
    far = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])]
    assert [r.deviation for r in whitening.whitened(one(far))[0].collect()] == [None] * 3  # beyond long
    wide = [(i, [float(i * 2**20), 0.0, float(i % 2)]) for i in range(64)]  # the exact sum passes long for some rows only
    n, dev, _, _ = brute_whitening(wide, 1)
    assert [r.deviation for r in whitening.whitened(one(wide))[0].orderBy("vec_id").collect()] == [d if d < 2**63 else None for d in dev] and any(d >= 2**63 for d in dev) and any(d < 2**63 for d in dev)


def test_whitening_plans_stay_small(spark, monkeypatch):
    """An expression for every pair of dimensions, or of dimension and component, took hundreds of MB of the driver to compile."""
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, r.normal(size=64).tolist()) for i in range(80)], "vec_id long, embedding array<double>")
    plan = whitening.whitened(df)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" * ") < 64
    monkeypatch.setattr(whitening, "SUMS", 2)
    for d in (1, 2, 5, 8):
        a = r.normal(size=(30, d))
        c = spark.createDataFrame([(v.tolist(),) for v in a], "c array<double>")
        assert np.allclose(whitening.products(c, d), a.T @ a, atol=1e-12)


def test_whitening_query(spark, sf):
    rows = whitening.op13_embedding_whitening(spark, sf)
    table = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    n, dev, want, share = brute_whitening(table)
    got = sorted(rows.collect(), key=lambda r: (r.vec_id, r.component))
    assert len(got) == 16 * len(table) and {r.n for r in got} == {n} and [r.deviation for r in got[::16]] == dev
    y = np.array([r.whitened for r in got]).reshape(len(table), 16)
    assert np.allclose(np.abs(y), np.abs(want), atol=1e-8) and {r.identity_error < 1e-4 for r in got} == {True}
    assert np.allclose([r.explained for r in got[:16]], share[:16], rtol=1e-6)


def test_usable_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [2.0]), (4, [3.0, 4.0])], "i long, v array<double>")
    assert vectors.dimension(df, "v") == 2 and vectors.dimension(df.limit(0), "v") == 0  # the larger of two equally frequent lengths
