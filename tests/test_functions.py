"""Scalar functions against literals and plain Python definitions."""

import math
import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sablewright.functions import names, schema, scores, text
from sablewright.sources.changes import within_bytes


def values(spark, rows, ddl, *cols):
    return [r[0] if len(cols) == 1 else tuple(r) for r in spark.createDataFrame(rows, ddl).select(*cols).collect()]


def one(spark, col, *args):
    names_ = [f"x{i}" for i in range(len(args))]
    return spark.createDataFrame([args], ", ".join(f"{n} string" for n in names_)).select(col(*map(F.col, names_))).first()[0]


def py_name(value):
    def single(t):
        if t.endswith(("ics", "ss", "us", "is")):
            return t
        for n, end, cut, add in ((4, "ies", 3, "y"), (4, "ses", 2, ""), (3, "s", 1, "")):
            if len(t) > n and t.endswith(end):
                return t[:-cut] + add
        return t

    x = unicodedata.normalize("NFKC", value or "").casefold()
    x = re.sub("[‐‑‒–—−_/]+", " ", x)
    return " ".join(map(single, re.sub(r"[^\w\s]", " ", x).split()))


def test_names(spark):
    cases = ["Physics-Informed Neural Networks", "Ｆｕｌｌ width", "analyses", "Classes", "series", "GPUs", "Straße_name/x", "", None, "bus", "axis", "Data Sets", "ﬁne‐tuning  models!"]
    got = values(spark, [(c,) for c in cases], "x string", names.normal_name(F.col("x")))
    assert got == [py_name(c) for c in cases]
    keys = values(spark, [("neural network",), ("",), ("bert",)], "x string", names.blocking_keys_of(F.col("x")))
    assert keys[0] == ["acro:nn", "first:neural", "name:neural network", "prefix:neural n"]
    assert keys[1] == []
    assert keys[2] == ["acro:bert", "first:bert", "name:bert", "prefix:bert"]


def test_entity_score(spark):
    df = spark.createDataFrame([("bert", "bert"), ("cnn", "convolutional neural network"), ("graph model", "graph modeling")], "a string, b string")
    none = F.array().cast("array<string>")
    got = [r[0] for r in df.select(names.entity_score(F.lit(True), F.col("a"), F.col("b"), none, none, none, F.lit(0.0))).collect()]
    assert got[:2] == [1.0, 0.95]
    assert got[2] == pytest.approx(0.55 * SequenceMatcher(None, "graph model", "graph modeling").ratio(), abs=1e-6)


def test_fact_score(spark):
    df = spark.createDataFrame([(True, True, True), (True, True, False), (False, True, True)], "s boolean, p boolean, o boolean")
    got = [r[0] for r in df.select(names.fact_score(F.col("s"), F.col("p"), F.col("o"), F.lit(1.0))).collect()]
    assert got == [1.0, 0.5, 0.8]


def test_schema(spark):
    p = lambda x: one(spark, schema.predicate, x)
    assert [p("uses-dataset"), p("Compared With"), p("measures_with"), p("invents"), p(None)] == ["USES_DATASET", "COMPARES_WITH", "EVALUATED_BY", "UNKNOWN", "UNKNOWN"]
    assert one(spark, schema.entity_type, "Data-Set") == "dataset" and one(spark, schema.entity_type, "person") is None
    assert one(spark, schema.predicate_of_relation, "uses", "Model") == "USES_MODEL"
    assert one(spark, schema.relation_of_predicate, "OUTPERFORMS") == "compares_with"


def test_evidence(spark):
    answer = "As **[Deep Nets]** and [Graph Models] show, [Deep Nets] work."
    assert one(spark, text.citations, answer) == ["Deep Nets", "Graph Models"]
    df = spark.createDataFrame([(answer, ["deep nets", "Graph models"]), (answer, ["deep nets"]), ("证据不足", []), ("x", []), ("no citation", ["a"])], "a string, t array<string>")
    got = [(r[0].status, r[0].reason) for r in df.select(text.evidence_verdict(F.col("a"), F.col("t"))).collect()]
    assert got == [("pass", "all_citations_retrieved"), ("retry", "citation_not_retrieved"), ("pass", "no_evidence_abstention"), ("retry", "no_chunks_without_abstention"), ("retry", "answer_has_no_citations")]


def test_requests(spark):
    ask = lambda q, f=None: tuple(one(spark, text.search_request, q, f))
    assert ask("see arXiv:2301.01234v2 please") == ("arxiv_id", "2301.01234")
    assert ask('search "Attention  is all"') == ("title", "Attention is all")
    assert ask("find papers about graph neural-networks and transformers")[1].startswith("graph neural-networks transformers")
    assert ask("搜索类似论文", "Old Title") == ("keywords", "Old Title")
    assert one(spark, text.doi, "doi 10.1000/abc.DEF, yes") == "10.1000/abc.DEF"
    assert one(spark, text.section_intent, "这篇论文的实验结果") == ["results", "experiment", "evaluation"]
    assert one(spark, text.requested_fields, "Goal:\n- Method：\nplain") == ["Goal", "Method"]
    assert one(spark, text.requested_fields, "Goal:\nplain") == []
    assert [one(spark, text.error_kind, x) for x in ("insufficient_quota", "429001 x", "boom")] == ["quota", "rate_limit", "other"]


def test_intent(spark):
    df = spark.createDataFrame([("search for x papers", False), ("a versus b", False), ("Hello", False), ("anything", True), ("是什么", False), ("mm", False)], "q string, p boolean")
    assert [r[0] for r in df.select(text.intent(F.col("q"), F.col("p"))).collect()] == ["search", "compare", "general", "analyze", "rag", None]


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(scores.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0 and got[2] is None
    c = spark.createDataFrame([("0.7",), ("7",), ("x",), (None,)], "x string").select(scores.confidence(F.col("x"))).collect()
    assert [r[0] for r in c] == [0.7, 1.0, 0.5, 0.5]
    d = spark.sql("SELECT timestamp'2024-01-03' AS now, timestamp'2024-01-01' AS last").select(scores.decayed(F.lit(2.0), F.col("last"), F.col("now"))).first()[0]
    assert d == round(2 * 0.95**2, 3)
    import hashlib

    waits = spark.createDataFrame([(1, "e"), (3, "e"), (30, "e")], "n int, e string").select(scores.back_off(F.col("n"), F.col("e"), 300, 3600)).collect()
    for (w,), n in zip(waits, (1, 3, 30), strict=True):
        base = min(3600, 300 * 2 ** min(n - 1, 16))
        assert w == min(3600, base + int(base * 0.1 * hashlib.sha256(f"e|{n}".encode()).digest()[0] / 255))


def test_within_bytes(spark):
    r = random.Random(4)
    rows = [("".join(r.choice("aé日😀 ") for _ in range(r.randint(0, 12))),) for _ in range(60)] + [(None,)]
    got = values(spark, rows, "x string", within_bytes(F.col("x"), 9))
    for (x,), g in zip(rows, got, strict=True):
        assert g == (None if x is None else x.encode()[:9].decode(errors="ignore"))


def test_sql_functions(spark):
    from sablewright.operators.retrieval import register

    register(spark)
    row = spark.sql("SELECT ws_tokens(' A b  c') AS t, token_jaccard('a b', 'b c') AS j, vec_dot(array(1f, 2f), array(3f, 4f)) AS d").first()
    assert row.t == ["a", "b", "c"] and row.j == pytest.approx(1 / 3) and row.d == 11.0
    assert not math.isnan(row.d)
