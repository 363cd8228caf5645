"""Phrases in texts and nearest vectors: brute force, edge cases, groups and blocks of any size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sablewright.operators import matching, nearest


@pytest.mark.parametrize("automaton", [True, False])
def test_holding(spark, monkeypatch, automaton):
    if not automaton:
        monkeypatch.setattr(matching, "ahocorasick", None)
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ab é日🙂") for _ in range(n))
    texts = [(i, word(r.randint(0, 40)), i % 3) for i in range(200)] + [(200, None, 1), (200, None, 1), (None, "ab ab", 0)]
    phrases = [word(r.randint(1, 4)) for _ in range(60)] + ["ab", "ab", "", None, "🙂"]
    df = spark.createDataFrame(texts, "id long, text string, hit int").repartition(3)
    for block in (20_000, 7):
        got = matching.holding(df, "text", spark.createDataFrame([(p,) for p in phrases], "p string"), "p", block)
        assert got.columns == ["id", "text", "hit", "phrase"]
        want = [(i, t, h, p) for i, t, h in texts if t for p in set(phrases) if p and p in t]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert matching.holding(df, "text", spark.createDataFrame([], "phrase string")).count() == 0
    assert matching.holding(df.limit(0), "text", spark.createDataFrame([("a",)], "phrase string")).count() == 0


def test_holding_reads_texts_once(spark):
    texts = spark.createDataFrame([(1, "a b")], "id long, text string")
    plan = matching.holding(texts, "text", spark.createDataFrame([("a",)], "phrase string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Exchange" not in plan


def unit(v):
    return np.array(v) / np.linalg.norm(v)


@pytest.mark.parametrize(("block", "stripe"), [(5_000, 200_000), (3, 11)])
def test_nearest_by_hand(spark, block, stripe):
    r = np.random.default_rng(8)
    rows = [(f"r{i:03}", "hot" if i % 3 else f"g{i % 4}", [float(c) for c in r.integers(-3, 4, 6)]) for i in range(150)]
    rows += [(f"z{i}", "hot", rows[1][2]) for i in range(20)]  # copies: ties go to smaller ids
    rows += [("n1", "hot", None), ("n2", "hot", []), ("n3", "hot", [0.0] * 6), ("n4", "hot", [None] + [1.0] * 5), ("n5", "hot", [float("nan")] * 6), ("n6", None, [1.0] * 6), (None, "hot", [1.0] * 6), ("n7", "hot", [1.0] * 5), ("n8", "alone", [1.0] * 6)]
    queries = [(i, g, v) for i, (_, g, v) in enumerate(rows) if i % 4 == 0 or i > 165]
    df = spark.createDataFrame(rows, "id string, kind string, embedding array<double>")
    got = nearest.nearest(spark.createDataFrame(queries, "q int, kind string, embedding array<double>"), df, "q", "id", "kind", 4, block=block, stripe=stripe).collect()
    good = lambda v: bool(v) and None not in v and not any(np.isnan(v)) and any(v)
    for q, g, v in queries:
        near = [(-round(float(unit(v) @ unit(w)), 9), i) for i, h, w in rows if good(v) and good(w) and i and g and g == h and len(v) == len(w)]
        mine = sorted((-round(x.similarity, 9), x.right_id) for x in got if x.left_id == q)
        assert mine == sorted(near)[:4], (q, g)


def test_nearest_has_no_driver_loop(spark):
    """Queries are not collected: the plan is one shuffle into cells, whatever their number."""
    df = spark.range(100).select("id", F.lit("g").alias("kind"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    plan = nearest.nearest(df, df, "id", "id", "kind", block=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan
    assert nearest.nearest(df.limit(0), df, "id", "id", "kind").count() == 0 and nearest.nearest(df, df.limit(0), "id", "id", "kind").count() == 0


def test_first_rows_of_a_phrase(spark, monkeypatch):
    """A task gives no more rows of a phrase than are asked for, the first ones, nulls as Spark places them."""
    monkeypatch.setattr(matching, "HELD_HITS", 7)
    rows = [(None if i % 7 == 0 else i % 5, None if i % 11 == 0 else f"e{i:03}", "a b" if i % 2 else "b c") for i in range(200)]
    df = spark.createDataFrame(rows, "at int, id string, text string").coalesce(1)
    got = matching.holding(df, "text", spark.createDataFrame([("a",), ("b",), ("c",)], "phrase string"), first=(3, (("at", "descending"), ("id", "ascending")))).collect()
    want = []
    for p in "abc":
        of = sorted((r[:2] for r in rows if p in r[2]), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
        want += [(*r, p) for r in of[:3]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
