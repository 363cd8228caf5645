"""Operators against plain Python definitions and small worked cases."""

import datetime
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from sablewright.operators import chunking, evaluation, evidence, graph, memory, queues, retrieval, sessions
from sablewright.sources import changes, tables
from sablewright.streaming import jobs as streaming

T = lambda day, h=0: datetime.datetime(2024, 1, day, h)


def py_pack(text, most, overlap):
    def tail(c):
        out = ""
        for s in reversed([x for x in re.split(r"(?<=[.!?])\s+", c) if x]):
            if len(out) + len(s) > overlap:
                break
            out = s + out
        return out

    if len(text) <= most:
        return [text] if text.strip() else []
    done, now = [], ""
    for s in [x for x in re.split(r"(?<=[.!?;:])\s+", text) if x]:
        if len(now) + len(s) > most and now.strip():
            done.append(now)
            now = (tail(now) if overlap else "") + s
        else:
            now += s
    return done + [now] if now.strip() else done


@pytest.mark.parametrize("most,overlap", [(2000, 300), (60, 20), (60, 0)])
def test_packing(spark, sf, most, overlap):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    got = docs.select("text", chunking.packed_sentences(F.col("text"), most, overlap)).collect()
    for text, chunks in got:
        assert chunks == py_pack(text or "", most, overlap)


def test_sections(spark):
    md = "intro\n# One\na\nb\n## Appendix A\n\n\n# Two\nc"
    got = chunking.sections(spark.createDataFrame([("p", md)], "paper_id string, markdown string")).collect()
    assert [(r.section_index, r.heading, r.level, r.content, r.is_appendix) for r in got] == [(0, None, 0, "intro", None), (1, "One", 1, "a\nb", False), (2, "Two", 1, "c", False)]
    assert spark.createDataFrame([("---\n\n# T x\n",), ("\nplain\n# T",), ("",)], "t string").select(chunking.title_of(F.col("t"), F.lit("stem"))).collect() == [("T x",), ("plain",), ("stem",)]


def test_merge_and_batches(spark):
    df = spark.createDataFrame([(["a" * 10, "b" * 30, "c" * 5, "d" * 100],)], "p array<string>")
    got = df.select(chunking.merged_short(F.col("p"), 20, 50)).first()[0]
    assert [(len(x.content), x.merged) for x in got] == [(41, True), (5 + 100 + 0, False)] or [(len(x.content), x.merged) for x in got] == [(41, True), (5, False), (100, False)]
    lengths = spark.createDataFrame([([5, 5, 5, 20, 1],)], "n array<int>")
    assert lengths.select(chunking.batches(F.col("n"), 10)).first()[0] == [0, 0, 1, 2, 3]


def test_segments(spark):
    text = "x" * 30 + "\n" + "y" * 25 + ". " + "z" * 50
    parts = spark.createDataFrame([(text,), ("",)], "t string").select(chunking.segments(F.col("t"), 40)).collect()
    assert "".join(parts[0][0]) == text and all(len(p) <= 40 for p in parts[0][0]) and parts[0][0][0].endswith("\n")


def test_chunks_and_rebuild(spark):
    parts = spark.createDataFrame([("p", 0, "short."), ("p", 1, "Also short."), ("q", 0, "z")], "paper_id string, section_index int, content string")
    got = {(r.paper_id, r.chunk_index): (r.content, r.merged) for r in chunking.chunks(parts).collect()}
    assert got == {("p", 0): ("short.\nAlso short.", True), ("q", 0): ("z", False)}
    again = chunking.rebuilt(spark.createDataFrame([("p", 1, None, "b"), ("p", 0, "S", "a")], "paper_id string, chunk_index int, section string, content string"))
    assert again.first().markdown == "# S\na\n# Abstract\nb"


def test_hybrid_parts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, None), (4, "d")], "doc_id int, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25(docs, "a a zz").collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 0
    once = {r.doc_id: r.score for r in retrieval.bm25(docs, "a").collect()}
    assert got[1] == pytest.approx(2 * once[1])
    assert retrieval.variants("这篇论文的主要贡献")[0] == "这篇论文的主要贡献" and len(retrieval.variants("x")) == 1
    hits = spark.createDataFrame([(i, s) for i, s in enumerate(["method", "results", None, "intro", "method b"])], "doc_id int, section string")
    assert {r.doc_id for r in retrieval.section_filtered(hits, ["method"]).collect()} == {0, 2, 4}
    assert retrieval.section_filtered(hits.limit(3), ["method"]).count() == 3


def canonical(spark):
    raw = [("p1", 0, "PINN", "method", "uses dataset", "Burgers Data", "dataset", "support", "PINN uses the Burgers data here", "0.9"), ("p2", 0, "pinns", "method", "uses dataset", "burgers data", "dataset", "contradict", "pinns fail on burgers data set", "x")]
    cols = "paper_id string, chunk_index int, subject string, subject_type string, predicate string, object string, object_type string, stance string, evidence string, confidence string"
    chunks = [("p1", 0, "We say PINN uses  the burgers DATA here."), ("p2", 0, "But pinns fail on burgers data set.")]
    return spark.createDataFrame(raw, cols), spark.createDataFrame(chunks, "paper_id string, chunk_index int, content string")


EMPTY = "entity_id string, type string, canonical_name string, canonical_normalized string, aliases array<string>, blocking_keys array<string>, context string, resolution_status string, updated_at timestamp"


def test_canonical_pipeline(spark):
    """Two papers, one shared fact, one for and one against."""
    raw, chunks = canonical(spark)
    # each round is checkpointed, as a long-running resolution would do it
    claims = evidence.checked(evidence.claims_of(raw), chunks).checkpoint()
    assert claims.where("valid").count() == 2
    m = evidence.mentions(claims).checkpoint()
    assert {(r.type, r.normal) for r in m.collect()} == {("method", "pinn"), ("dataset", "burger data")}
    entities = spark.createDataFrame([], EMPTY)
    got = evidence.resolved_entities(m, entities).checkpoint()
    assert {r.route for r in got.collect()} == {"new"}
    entities = evidence.grown_entities(entities, got, F.lit(T(1)).cast("timestamp")).checkpoint()
    assert entities.count() == 2
    again = evidence.resolved_entities(m, entities).checkpoint()
    assert {r.route for r in again.collect()} == {"exact"}
    ids = again.select("type", "normal", "entity_id")
    from sablewright.functions.names import normal_name

    full = claims.withColumn("sn", normal_name(F.col("subject"))).withColumn("on", normal_name(F.col("object")))
    full = full.join(ids.select(F.col("type").alias("subject_type"), F.col("normal").alias("sn"), F.col("entity_id").alias("subject_id")), ["subject_type", "sn"])
    full = full.join(ids.select(F.col("type").alias("object_type"), F.col("normal").alias("on"), F.col("entity_id").alias("object_id")), ["object_type", "on"]).checkpoint()
    facts = evidence.resolved_facts(full, spark.createDataFrame([], "fact_id string, signature string, subject_id string, predicate string, object_id string")).checkpoint()
    assert facts.count() == 1
    rows = evidence.claim_rows(full.join(facts.select("subject_id", "predicate", "object_id", "fact_id"), ["subject_id", "predicate", "object_id"])).withColumn("review_status", F.lit("auto_verified")).checkpoint()
    c = evidence.fact_counts(rows).first()
    assert (c.support_count, c.contradict_count, c.needs_review_count) == (1, 1, 0)
    edges = evidence.edges_of(rows)
    assert edges.count() == 2 and {r.relation for r in edges.collect()} == {"uses"}
    e2, c2 = evidence.reviewed(edges, rows, [edges.first().edge_id], "rejected")
    assert e2.where("review_status = 'rejected'").count() == 1 and c2.where("review_status = 'rejected'").count() == 1
    with pytest.raises(ValueError):
        evidence.reviewed(edges, rows, [], "auto_verified")
    new = rows.where("paper_id = 'p1'")
    old = rows.withColumn("review_status", F.lit("confirmed"))
    assert {r.review_status for r in evidence.replaced_claims(old, new, new.select("paper_id")).collect()} == {"confirmed"}
    zero = spark.createDataFrame([(c.fact_id, 9, 9, 9), ("other", 5, 5, 5)], "fact_id string, support_count bigint, contradict_count bigint, needs_review_count bigint")
    again = {r.fact_id: (r.support_count, r.contradict_count, r.needs_review_count) for r in evidence.recounted(zero, rows, facts).collect()}
    assert again == {c.fact_id: (1, 1, 0), "other": (5, 5, 5)}


def test_invalid_claims(spark):
    raw, chunks = canonical(spark)
    bad = raw.withColumn("evidence", F.lit("this stands nowhere at all"))
    assert {r.reason for r in evidence.checked(evidence.claims_of(bad), chunks).collect()} == {"evidence_not_in_chunk"}
    assert {r.reason for r in evidence.checked(evidence.claims_of(raw.withColumn("chunk_index", F.lit(7))), chunks).collect()} == {"unknown_chunk"}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "uses"), ("b", "c", "uses"), ("a", "c", "x"), ("c", "d", "uses"), ("d", "a", "uses")], "src string, dst string, relation string")
    got = {r.node: (r.depth, r.path) for r in graph.shortest_paths(e, "a", None, 3).collect()}
    assert got == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "c": (1, ["a", "c"]), "d": (2, ["a", "c", "d"])}
    assert graph.shortest_paths(e, "a", "zz", 3).count() == 0
    rows = [("1", "p", "BERT", "about BERT", "uses", "auto_verified", T(2)), ("2", "p", "x", "bert too", "uses", "rejected", T(3)), ("3", "q", "y", "bert", "improves", "confirmed", T(1))]
    ed = spark.createDataFrame(rows, "edge_id string, source_paper_id string, target_name string, evidence string, relation string, review_status string, updated_at timestamp")
    found = lambda **k: [r.edge_id for r in graph.searched(ed, "BERT", relations=("uses", "improves"), **k).collect()]
    assert found() == ["1", "3"] and found(status="rejected") == ["2"] and found(status="odd") == ["2", "1", "3"] and found(relation="uses") == ["1"] and found(relation="odd") == ["1", "3"]
    assert {r.paper_id for r in graph.related_papers(ed, "bert").collect()} == {"p", "q"}


def test_queues(spark):
    ddl = "job_id string, paper_id string, run_number bigint, status string, priority bigint, attempt_count bigint, max_attempts bigint, next_attempt_at timestamp, created_at timestamp, lease_expires_at timestamp, worker_id string, version int"
    jobs = spark.createDataFrame([("j1", "p1", 1, "pending", 20, 0, 2, T(1), T(1), None, None, 1), ("j2", "p2", 1, "pending", 30, 0, 2, T(2), T(1), None, None, 1), ("j3", "p3", 1, "extracting", 10, 1, 2, T(1), T(1), T(1), "w", 1), ("j4", "p4", 1, "extracting", 10, 2, 2, T(1), T(1), T(1), "w", 1)], ddl)
    now = F.lit(T(3)).cast("timestamp")
    got = queues.claimed(jobs, now)
    assert [r.job_id for r in got.collect()] == ["j2"]
    after = {r.job_id: r for r in queues.leased(jobs, got, "me", now, 150).collect()}
    assert after["j2"].status == "extracting" and after["j2"].attempt_count == 1 and after["j2"].lease_expires_at == T(3) + datetime.timedelta(seconds=150) and after["j1"].status == "pending"
    assert {r.job_id: r.status for r in queues.recovered(jobs, now).collect()} == {"j1": "pending", "j2": "pending", "j3": "retry_wait", "j4": "failed"}
    wanted = spark.createDataFrame([("p1", "manual", True, 1), ("p9", "backfill", False, 1), ("p2", "new", False, 1)], "paper_id string, origin string, force boolean, version int")
    q = {r.paper_id: (r.run_number, r.status, r.priority) for r in queues.enqueued(jobs, wanted, now).collect()}
    assert q["p1"] == (2, "pending", 30) and q["p9"] == (1, "pending", 10) and q["p2"] == (1, "pending", 30) and q["p3"] == (1, "extracting", 10)
    out = spark.createDataFrame([("j3", False, True, 60, True), ("j4", False, True, 60, False)], "job_id string, ok boolean, retryable boolean, delay_seconds int, refund boolean")
    f = {r.job_id: (r.status, r.attempt_count) for r in queues.finished(jobs, out, now).collect()}
    assert f["j3"] == ("retry_wait", 0) and f["j4"] == ("failed", 2)
    assert {r.status for r in queues.requeued(jobs).collect()} == {"pending"}
    res = spark.createDataFrame([("j1", 1, 0), ("j1", 1, 0), ("j1", 0, 5)], "job_id string, run_number bigint, batch int")
    assert queues.checkpoints_done(jobs, res).first().completed_batches == [0]


def test_memory(spark):
    m = spark.createDataFrame([("a", "u", "interest", "deep graph nets now", 2.0), ("b", "u", "interest", "deep graph nets now", 1.0), ("c", "u", "focus", "deep graph nets now", 1.0), ("d", "u", "interest", "else", 0.05)], "memory_id string, user_id string, type string, content string, weight double")
    got = {r.memory_id: r.weight for r in memory.remembered(memory.merged(m)).collect()}
    assert got == {"a": 2.5, "c": 1.0}
    none = spark.createDataFrame([], "user_id string, type string, content string, weight double, last_accessed timestamp, access_count long")
    seen = spark.createDataFrame([("u", "interest", "x", 5.0), ("u", "interest", "x", 60.0)], "user_id string, type string, content string, importance double")
    row = memory.lifecycle(none, seen, F.lit(T(1)).cast("timestamp")).first()
    assert row.weight == 10.0 and row.access_count == 2


def test_sessions(spark):
    t = spark.createDataFrame([(1, "tell me", None, None), (2, "arXiv 2301.00001", None, None), (3, "about Deep Graph Nets", None, None), (4, "换一篇", "f", None), (5, "more", "f", None), (6, "x", None, "t")], "turn_id int, query string, focus string, target string")
    p = spark.createDataFrame([("2301.00001", "Another", None), ("p2", "Deep Graph Nets", "10.1/x")], "paper_id string, title string, doi string")
    got = {r.turn_id: (r.paper_id, r.source) for r in sessions.identified(t, p).collect()}
    assert got == {1: (None, "none"), 2: ("2301.00001", "arxiv_id"), 3: ("p2", "title_match"), 4: (None, "none"), 5: ("f", "session_focus"), 6: ("t", "explicit_target")}
    turns = spark.createDataFrame([("s", 1, "a", "resolved", None), ("s", 2, "b", "resolved", "boom"), ("s", 3, "c", "switch", None), ("s", 4, None, "unresolved", None)], "session_id string, turn int, paper_id string, status string, error string")
    assert [r.focus for r in sessions.focus(turns).orderBy("turn").collect()] == ["a", "a", "c", "c"]
    ev = spark.createDataFrame([("r", "x", 1, "running", None), ("r", "x", 2, "done", "m"), ("r", "x", 3, None, "n")], "run_id string, agent string, seq int, status string, message string").withColumn("finished_at", F.lit(None).cast("timestamp"))
    assert {r.agent: (r.status, r.message) for r in sessions.agent_states(ev, ("x", "y")).collect()} == {"x": ("done", "n"), "y": ("skipped", None)}
    old, new = (spark.createDataFrame([("u", v, ["k"])], "user_id string, topics array<string>, goals array<string>") for v in (["a"], ["a", "b"]))
    assert [(r.field, r.after) for r in sessions.changed_profiles(old, new, ("topics", "goals")).collect()] == [("topics", ["a", "b"])]


def test_identity_by_history_switch_and_comparison(spark):
    past = "array<struct<primary:string,paper_ids:array<string>,status:string>>"
    rows = [
        (1, "总结实验结果", None, None, [("P001", ["P001"], "resolved"), (None, [], "unresolved")]), (2, "分析新论文", "P001", "P002", []), (3, "把当前论文和 Paper Bee 对比一下", "P001", None, []),
        (4, "帮我找 PINN 相关论文", "P001", None, []), (5, "帮我找几篇类似论文", "P001", None, []), (6, "分析 Graph Retrieval for Science Extended", None, None, []), (7, "see 2401.01234v2", "P001", None, []),
    ]
    t = spark.createDataFrame(rows, f"turn_id int, query string, focus string, target string, history {past}")
    p = spark.createDataFrame([("P002", "Paper Bee", None), ("P003", "Graph Retrieval for Science", None), ("P004", "Graph Retrieval for Science Extended", None), ("2401.01234", "New", None)], "paper_id string, title string, doi string")
    got = {r.turn_id: (r.paper_id, r.paper_ids, r.source, r.status, r.inherited, r.switched_from) for r in sessions.identified(t, p).collect()}
    assert got == {
        1: ("P001", ["P001"], "history_resolution", "resolved", True, None),
        2: ("P002", ["P002"], "explicit_target", "switch", False, "P001"),
        3: ("P001", ["P001", "P002"], "title_match", "resolved", True, None),
        4: (None, [], "none", "unresolved", False, None),
        5: ("P001", ["P001"], "session_focus", "resolved", True, None),
        6: (None, ["P003", "P004"], "title_match", "ambiguous", False, None),
        7: ("2401.01234", ["2401.01234"], "arxiv_id", "switch", False, "P001"),
    }


def entities_and_mentions(spark):
    from sablewright.functions.names import blocking_keys_of

    e = spark.createDataFrame([("E1", "method", "graph neural network", "", [1.0, 0.0, 0.0], T(1)), ("E2", "method", "quite another thing", "", [0.0, 1.0, 0.0], T(2)), ("E3", "model", "graph neural network", "", [1.0, 0.0, 0.0], T(3))], "entity_id string, type string, canonical_normalized string, context string, embedding array<double>, updated_at timestamp")
    e = e.withColumn("aliases", F.array("canonical_normalized")).withColumn("blocking_keys", blocking_keys_of(F.col("canonical_normalized")))
    m = spark.createDataFrame([("method", "graph neural networkx", "Graph neural networkx", "", [0.99, 0.1, 0.0]), ("method", "zzz", "zzz", "", [0.0, 0.0, 1.0]), ("method", "graph neural network", "GNN", "", [0.0, 0.0, 0.0])], "type string, normal string, name string, context string, embedding array<double>")
    return m, e


def test_resolution_with_vectors(spark):
    """Near names merge with the help of their vectors; without vectors they can't; decisions settle what is ambiguous."""
    m, e = entities_and_mentions(spark)
    near = {(r.mention_id, r.entity_id): r.similarity for r in evidence.candidates(m, e).collect()}
    assert near["method:graph neural networkx", "E1"] == pytest.approx(0.99 / (0.99**2 + 0.1**2) ** 0.5) and near["method:zzz", "E2"] == 0.0
    assert not any(r == "E3" for _, r in near)
    got = {r.normal: (r.entity_id, r.route) for r in evidence.resolved_entities(m.withColumn("context", F.lit("a b")), e.withColumn("context", F.lit("a b"))).collect()}
    assert got["graph neural networkx"] == ("E1", "rule_merge") and got["graph neural network"] == ("E1", "exact") and got["zzz"][1] == "new"
    plain = {r.normal: r.route for r in evidence.resolved_entities(m.drop("embedding"), e).collect()}
    assert plain["graph neural networkx"] == "new" or plain["graph neural networkx"] == "ambiguous_unresolved"
    d = spark.createDataFrame([("method:graph neural networkx", "merge", "E1"), ("method:zzz", "merge", "E1")], "mention_id string, decision string, entity_id string")
    decided = {r.normal: (r.entity_id, r.route) for r in evidence.resolved_entities(m, e, d).collect()}
    assert decided["graph neural networkx"] == ("E1", "decided_merge") and decided["zzz"][1] == "new"
    wrong = d.withColumn("entity_id", F.lit("E3"))
    assert {r.normal: r.route for r in evidence.resolved_entities(m, e, wrong).collect()}["graph neural networkx"] == "ambiguous_unresolved"


def test_nearest_equals_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(k, int(k % 3), [float(x) for x in r.integers(-2, 3, 4)]) for k in range(120)] + [(500, 0, None), (501, 0, []), (502, None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, g int, embedding array<double>")
    got = {}
    for x in evidence.nearest(df.where("id % 5 = 0"), df, "id", "id", "g", 4, block=7).collect():
        got.setdefault(x.left_id, []).append((-round(x.similarity, 9), x.right_id))
    unit = {k: np.array(v) / n for k, g, v in rows if v and (n := np.linalg.norm(v))}
    for q, g, _ in rows:
        if q % 5 == 0 and q in unit and g is not None:
            want = sorted((-round(float(unit[q] @ unit[k]), 9), k) for k, h, _ in rows if h == g and k in unit)[:4]
            assert [a for a, _ in sorted(got[q])] == pytest.approx([a for a, _ in want])
    assert 500 not in got and 502 not in got


def test_facts_with_vectors(spark):
    """Facts of no near vector fall back to those that share subject or object; the newest eight count."""
    known = spark.createDataFrame([(f"F{k}", f"a|SOLVES|o{k}", "a", "SOLVES", f"o{k}", [1.0, 0.0], T(k + 1)) for k in range(12)], "fact_id string, signature string, subject_id string, predicate string, object_id string, embedding array<double>, updated_at timestamp")
    new = spark.createDataFrame([("a", "IMPROVES", "x", [1.0, 0.0]), ("b", "SOLVES", "o3", [1.0, 0.1]), ("a", "SOLVES", "o1", [0.0, 1.0])], "subject_id string, predicate string, object_id string, embedding array<double>")
    f = new.withColumn("signature", F.concat_ws("|", "subject_id", "predicate", "object_id"))
    c = evidence.fact_candidates(f, known).collect()
    assert {x.fact_id for x in c if x.signature == "a|IMPROVES|x"} == {f"F{k}" for k in range(4, 12)}  # no fact of its predicate
    assert len([x for x in c if x.signature == "b|SOLVES|o3"]) == 8 and all(x.similarity > 0.99 for x in c if x.signature == "b|SOLVES|o3")
    got = {x.signature: (x.route, x.fact_id) for x in evidence.resolved_facts(new, known).collect()}
    assert got["a|SOLVES|o1"] == ("exact", "F1") and got["a|IMPROVES|x"][0] == "new"


def test_links_of_frequent_targets(spark):
    r = random.Random(2)
    e = [(r.randrange(30), r.choice([0, 0, 0, 1, 2])) for _ in range(300)]
    df = spark.createDataFrame(e, "s int, t int")
    got = [{(x.left_id, x.right_id): (x.n_shared, x.reasons) for x in graph.links(df, "s", "t", F.col("t"), block=b).collect()} for b in (4, 1000)]
    own = {}
    for s_, t_ in e:
        own.setdefault(s_, set()).add(t_)
    want = {(a, b): (len(own[a] & own[b]), sorted(own[a] & own[b])) for a in own for b in own if a < b and own[a] & own[b]}
    assert got[0] == want and got[1] == want


def test_links_shuffle_no_pairs(spark):
    """Arrays of partners are shuffled to their source, where pairs are counted; a source of very many links is dealt to several tasks."""
    df = spark.createDataFrame([(s, t) for t in range(6) for s in range(t, 40)], "s int, t int")
    got = [graph.links(df, "s", "t", F.col("t"), block=7, task=k) for k in (50, 10**6)]
    want = sorted((a, b, min(a, 5) + 1, list(range(min(a, 5) + 1))) for a in range(40) for b in range(a + 1, 40))
    for x in got:
        assert sorted((r.left_id, r.right_id, r.n_shared, r.reasons) for r in x.collect()) == want
    # nothing is shuffled once pairs are made
    plan = got[1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")].split("Aggregate", 1)[1]


def test_link_reasons_are_sorted_in_compiled_code(spark, sf):
    """No lambda, which is not compiled, is called for each link once links are made, and rows come source by source."""
    from sablewright.plans import graph as plans

    plan = plans.paper_links(spark, sf)._jdf.queryExecution().executedPlan().toString()
    made = plan.index("Generate explode(__all")
    assert "lambdafunction" not in plan[:made] and "Sort [left_id" in plan[made : plan.index("Exchange")]
    rows = [(s_, t_, why) for t_, why in ((1, "b"), (2, None), (3, "a"), (4, "a")) for s_ in ("x", "z", "y", None)]
    got = graph.links(spark.createDataFrame(rows, "s string, t int, why string"), "s", "t", F.col("why")).collect()
    assert sorted(map(tuple, got)) == [(a, b, 4, ["a", "a", "b"]) for a, b in ("xy", "xz", "yz")]


@pytest.mark.parametrize("block", [3, 1000])
def test_blocked_pairs_of_frequent_keys(spark, block):
    """Every pair once, whatever it shares, with nulls, repeated ids and a key that most have."""
    r = random.Random(4)
    one, two = ([(r.choice([None, *range(12)]), r.choice(["t", "t", "u", None]), r.choice([None, [], ["a"], ["a", "b"], ["b", "a", "c"], ["a", None], ["c"]]), r.choice(["x", "y", None])) for _ in range(n)] for n in (60, 40))
    a, b = (spark.createDataFrame(rows, "id int, type string, blocking_keys array<string>, name string") for rows in (one, two))

    def own(rows):
        keys, names = {}, {}
        for i, t, k, n in rows:
            for x in k or []:
                if i is not None and t is not None and x is not None:
                    keys.setdefault(i, set()).add((t, x))
                    names.setdefault(i, []).append(n)
        return keys, {i: min(n, key=lambda x: (x is not None, x or "")) for i, n in names.items()}

    (ka, na), (kb, nb) = own(one), own(two)
    want = sorted((i, j, na[i], nb[j]) for i in ka for j in kb if ka[i] & kb[j])
    got = evidence.blocked(a, b, "id", "id", carry=("name",), block=block).select("left_id", "right_id", "left.name", F.col("right.name").alias("other")).collect()
    assert want and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, evidence.blocked(a, b, "id", "id", block=block).collect())) == sorted(x[:2] for x in want)
    assert evidence.blocked(a.limit(0), b, "id", "id", block=block).count() == 0


def test_blocks_grow_with_pairs(spark):
    """An id is sent once for each block of the other side: what is sent grows with the ids of a key, not with their square."""

    def sent(n, m):
        counts = spark.createDataFrame([(f"k{i}", n, m, "a" if i else "k0", f"k{i}") for i in range(6)], "__k string, __n long, __m long, __from string, __to string")
        return sorted((x["__k"], n * x["__m_blocks"] + m * x["__n_blocks"], x["__n_blocks"] * x["__m_blocks"]) for x in evidence.blocks_of_keys(counts, 12).collect())

    assert [x[1:] for x in sent(2000, 2000)] == [(4000, 1)] * 6
    few, many = sent(200_000, 100_000), sent(20_000_000, 10_000_000)
    assert all(y[1] <= 101 * x[1] and y[2] <= x[2] + 1 for x, y in zip(few, many, strict=True))
    # enough cells for all tasks, and those of a key are not more
    assert 12 * evidence.TASK_CELLS <= sum(x[2] for x in many) <= 24 * evidence.TASK_CELLS


def test_keys_within_a_lesser_key_are_left_out(spark):
    """Ids that share a key and all the same lesser one meet at the lesser one only; the other key is not sent."""
    counts = [("a", 2, 2, "a", "a"), ("b", 2, 2, "a", "a"), ("c", 2, 2, "a", "c"), ("d", 2, 0, "d", "d")]
    df = spark.createDataFrame(counts, "__k string, __n long, __m long, __from string, __to string")
    assert sorted(x["__k"] for x in evidence.blocks_of_keys(df, 4).collect()) == ["a", "c"]
    keys = [["a", "b"], ["a", "b"], ["a"], ["b", "c"], ["c"], ["a", "c", "d"], ["d"]]
    one = spark.createDataFrame([(i, "t", k) for i, k in enumerate(keys)], "id int, type string, blocking_keys array<string>")
    want = sorted((i, j) for i, x in enumerate(keys) for j, y in enumerate(keys) if set(x) & set(y))
    assert sorted(map(tuple, evidence.blocked(one, one, "id", "id", block=1).collect())) == want


def test_scores_are_those_of_their_pair_in_any_block(spark):
    """A key in several blocks, with parts of kinds in each: every pair comes once, scored from its own left and right side."""
    names = ["a b", "a c", "b", "a"]
    df = spark.createDataFrame([(i, "t", ["all", f"n{i % 4}"], names[i % 4]) for i in range(60)], "id long, type string, blocking_keys array<string>, name string")
    for block in (2, 7, 1000):
        got = evidence.blocked(df, df, "id", "id", carry=("name",), block=block, made=lambda a, b: F.concat_ws("|", a["name"], b["name"])).collect()
        assert sorted(map(tuple, got)) == sorted((i, j, f"{names[i % 4]}|{names[j % 4]}") for i in range(60) for j in range(60))


def test_copies_are_scored_once(spark):
    """Ids with the same keys and columns are one kind, of which a score is asked once, whatever the number of pairs."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def score(a, b):
        asked.add(1)
        return len(a + b)

    df = spark.createDataFrame([(i, "t", ["k", "l"], "x" * (i % 2 + 1)) for i in range(400)], "id long, type string, blocking_keys array<string>, name string")
    pairs = evidence.blocked(df, df, "id", "id", carry=("name",), made=lambda a, b: score(a["name"], b["name"])).where("left_id < right_id")
    got = pairs.agg(F.count("*").alias("n"), F.sum("made").alias("s")).first()
    assert (got.n, got.s) == (400 * 399 // 2, 2 * 199 * 100 + 3 * 200 * 200 + 4 * 199 * 100)
    assert asked.value == 4


def test_blocked_rows_are_kinds(spark, sf):
    """Before ids become pairs, parts of equal type and name meet as one row, not each by itself."""
    from sablewright.plans import graph as plans

    plan = plans.blocking_candidates(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(__left_ids") == 1 and plan.index("explode(__right_ids") < plan.index("Join Inner")


def test_blocked_loops_hold_one_id(spark, sf):
    """A compiled loop holds what it makes of a row: a step that is not compiled parts the loops over left and right ids, or all pairs of two kinds are held."""
    from sablewright.plans import graph as plans

    plan = plans.blocking_candidates(spark, sf)._jdf.queryExecution().executedPlan().toString()
    between = plan[plan.index("Generate explode(__right_ids") : plan.index("Generate explode(__left_ids")]
    assert "lambdafunction" in between


def test_question_papers(spark):
    rows = [("1", "p", "Deep Graph Nets", "", "auto_verified", T(1)), ("2", "q", "graph", "", "confirmed", T(2)), ("3", "r", "Deep Graph Nets", "", "rejected", T(3))]
    e = spark.createDataFrame(rows, "edge_id string, source_paper_id string, target_name string, evidence string, review_status string, updated_at timestamp")
    q = spark.createDataFrame([(1, "哪些论文使用 deep graph nets 和 graph"), (2, "什么是 deep graph nets"), (3, "compare graph"), (4, "使用 nothing known")], "question_id int, question string")
    assert sorted((r.question_id, r.phrase, r.paper_id) for r in graph.question_papers(q, e).collect()) == [(1, "deep graph nets", "p")]
    assert sorted((r.question_id, r.phrase) for r in graph.question_papers(q.withColumn("question", F.replace("question", F.lit("compare graph"), F.lit("共同 graph"))), e).collect()) == [(1, "deep graph nets"), (3, "graph"), (3, "graph")]


def test_similar_memories_of_large_kinds(spark):
    """Copies travel as arrays of a bounded size; every pair comes once, with the heavier one kept."""
    r = random.Random(3)
    texts = [" ".join(f"w{k}" for k in range(10)), " ".join(f"w{k}" for k in range(1, 11)), "W3 w3 w4", "w4 w3", "", None]
    rows = [(i, r.choice(["u", "v", None]), "t", r.choice(texts), r.choice([1.0, 2.0, 2.0, None])) for i in range(90)]
    m = spark.createDataFrame(rows, "memory_id long, user_id string, type string, content string, weight double")
    want = []
    for i, u, _, c, w in rows:
        for j, v, _, d, x in rows:
            a, b = set((c or "").lower().split()), set((d or "").lower().split())
            if i < j and u is not None and u == v and a and b and len(a & b) / len(a | b) >= 0.8:
                left = w is not None and x is not None and w >= x
                want.append((i if left else j, j if left else i, round(len(a & b) / len(a | b), 9)))
    got = [(x.keep, x.gone, round(x.similarity, 9)) for x in memory.similar_pairs(m, block=4).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_memory_pairs_are_made_one_memory_at_a_time(spark):
    """The loops over two arrays of memories are parted by a step that is not compiled, and the inner one begins behind the memory itself in its own array."""
    m = spark.createDataFrame([(i, "u", "t", "w1 w2", 1.0) for i in range(40)] + [(7, "u", "t", "w1 w2", 2.0)], "memory_id long, user_id string, type string, content string, weight double")
    for block in (4, 2000):
        pairs = memory.similar_pairs(m, block=block)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        between = plan[plan.index("Generate explode(at") : plan.index("Generate posexplode(lids")]
        assert "lambdafunction" in between
        # the memory that comes twice meets all others twice
        got = sorted((min(x.keep, x.gone), max(x.keep, x.gone)) for x in pairs.collect())
        assert got == sorted([(a, b) for a in range(40) for b in range(a + 1, 40)] + [(min(7, b), max(7, b)) for b in range(40) if b != 7])


def test_titles_in_long_texts(spark):
    """Places are cut by one pass, without counting to each anew; texts do not go with their places; rows that share or lack an id count too."""
    long = "word " * 60_000
    turns = spark.createDataFrame([(1, long + "Deep Graph-Nets!"), (1, "deep graph"), (None, "a deepGRAPH nets b"), (2, None), (3, "short"), (4, "图神经网络研究")], "turn_id long, query string")
    papers = spark.createDataFrame([("p", "Deep graph nets"), ("q", "deep graph"), ("r", "nets"), ("s", None), ("t", "图神经网络研究"), ("u", "deep graph nets at scale")], "paper_id string, title string")
    hits = sessions.title_hits(turns, papers)
    assert sorted(map(tuple, hits.collect()), key=repr) == sorted([(1, "p"), (1, "q"), (None, "p"), (None, "q"), (4, "t")], key=repr)
    assert "sequence(" not in hits._jdf.queryExecution().executedPlan().toString()


def test_memories_merge_along_chains(spark):
    """What goes into a memory that goes itself counts for the one that stays."""
    w = [f"w{k}" for k in range(12)]
    rows = [("a", " ".join(w[:10]), 5.0), ("b", " ".join(w[1:11]), 4.0), ("c", " ".join(w[2:12]), 3.0), ("d", "else", 1.0)]
    m = spark.createDataFrame([(i, "u", "t", c, x) for i, c, x in rows], "memory_id string, user_id string, type string, content string, weight double")
    assert {r.memory_id: r.weight for r in memory.merged(m).collect()} == {"a": 6.0, "d": 1.0}


def test_mentions_are_bounded(spark):
    rows = [("x", "task", f"evidence {k:05d}", "y", "task") for k in range(700)] + [("x", "task", "", "y", "task")]
    c = spark.createDataFrame(rows, "subject string, subject_type string, evidence string, object string, object_type string")
    got = {r.name: r for r in evidence.mentions(c).collect()}
    assert got["x"].n == 701 and got["x"].context == " ".join(f"evidence {k:05d}" for k in range(100))[:1000]


def test_model_calls(spark):
    """Exceptions and empty answers are tried again; the fallback stands in the end; null prompts are not asked."""
    from sablewright.operators import models

    def flaky(prompt, seen={}):  # noqa: B006  (kept between calls on purpose)
        seen[prompt] = seen.get(prompt, 0) + 1
        if prompt == "bad" or (prompt == "once" and seen[prompt] == 1):
            raise ValueError("no")
        return " " if prompt == "blank" else f" {prompt}! "

    df = spark.createDataFrame([(1, "ok"), (2, "once"), (3, "bad"), (4, "blank"), (5, None)], "id int, q string").coalesce(1)
    got = {r.id: (r.answer, r.error, r.n_tries) for r in models.asked(df, "id", "q", flaky, tries=2, wait=0.0, fallback="f").collect()}
    assert got == {1: ("ok!", None, 1), 2: ("once!", None, 2), 3: ("f", "ValueError: no", 2), 4: ("f", "empty_response", 2), 5: ("f", "no_prompt", 0)}
    assert models.asked(df.limit(0), "id", "q", flaky).count() == 0
    a = spark.createDataFrame([("m", '{"decision": "merge", "entity_id": "E1"}'), ("n", '[{"decision": "new"}]'), ("o", "no JSON")], "mention_id string, answer string")
    assert [tuple(r) for r in models.decided(a).collect()] == [("m", "merge", "E1")]


def test_packed_by_group(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), k, r.choice([0, 0, 3, 7, 40])) for k in range(400)]
    got = sorted(((x.g or "", x.k, x.total) for x in retrieval.packed_by(spark.createDataFrame(rows, "g string, k int, n int").repartition(5), 100, "g", "k", F.col("n")).collect()))
    want, held, shut = [], {}, set()
    for g, k, n in rows:
        held[g] = held.get(g, 0) + n
        if held[g] > 100:
            shut.add(g)
        if g not in shut:
            want.append((g or "", k, held[g]))
    assert got == sorted(want)


def test_papers_are_forgotten(spark):
    c = spark.createDataFrame([("x", ["p", "q"]), ("y", ["p"])], "name string, source_papers array<string>")
    s = spark.createDataFrame([("p", 1), ("q", 2)], "paper_id string, section_index int")
    out = memory.papers_forgotten({"concepts": c, "sections": s}, s.where("paper_id = 'p'"))
    assert [tuple(r) for r in out["concepts"].collect()] == [("x", ["q"])] and [tuple(r) for r in out["sections"].collect()] == [("q", 2)]
    refl = spark.createDataFrame([("p", T(1)), ("p", T(3)), ("q", T(2))], "paper_id string, created_at timestamp")
    assert [r.created_at for r in memory.recent_reflections(refl, 2).collect()] == [T(3), T(2)] and memory.recent_reflections(refl, 5, "q").count() == 1


def test_old_sessions_load(spark):
    df = spark.createDataFrame([("s", ["p", "q"], None), ("t", None, None), ("u", ["p"], ("f", ["f"], "explicit_target", 1.0))], "session_id string, active_paper_ids array<string>, paper_focus struct<primary_paper_id:string,active_paper_ids:array<string>,source:string,confidence:double>")
    got = {r.session_id: (r.paper_focus.primary_paper_id, r.paper_focus.source, r.user_id) for r in sessions.loaded(df).collect()}
    assert got == {"s": ("p", "session_focus", "local-user"), "t": (None, None, "local-user"), "u": ("f", "explicit_target", "local-user")}


def test_newest_edge_counts(spark):
    c = spark.createDataFrame([("p", "task", "o", "SOLVES", "support", "C1", s, "e", T(k)) for k, s in ((1, "auto_verified"), (3, "rejected"), (2, "confirmed"))], "paper_id string, object_type string, object string, predicate string, stance string, claim_id string, review_status string, evidence string, updated_at timestamp")
    assert [r.review_status for r in evidence.edges_of(c).collect()] == ["rejected"]


def test_evaluation(spark):
    runs = spark.createDataFrame([(["a", "b"], ["a", "a", "c"], True, False, False, 120.0), ([], ["x"], False, True, True, 80.0)], "expected array<string>, ranked array<string>, citations_ok boolean, should_abstain boolean, abstained boolean, latency_ms double")
    r = evaluation.summary(runs).first()
    assert (r.n_cases, r.recall, r.citation_pass_rate, r.abstention_accuracy, r.p50_latency_ms) == (2, 0.75, 0.5, 1.0, 100.0)
    d = spark.createDataFrame([("e1", "e1", True), ("e1", "e2", True), ("e1", None, True)], "entity_id string, expected_id string, merged boolean")
    q = evaluation.resolution_quality(d).first()
    assert (q.accuracy, q.incorrect_merge_rate) == (0.5, 0.5)
    assert evaluation.resolution_quality(d.where("expected_id is null")).first().accuracy is None
    assert evaluation.duplicate_rate(spark.createDataFrame([], "k string"), F.col("k")).first().duplicate_rate == 0.0


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("deep/er/full.md", "wrong")
        z.writestr("x/full.md", "﻿# Right")
    (tmp_path / "b.zip").write_bytes(b"no zip")
    got = {r.path[-5:]: (r.markdown, r.error is None) for r in tables.markdown_from_archives(spark, str(tmp_path)).collect()}
    assert got == {"a.zip": ("# Right", True), "b.zip": (None, False)}
    case = tmp_path / "cases.json"
    case.write_text('[{"id": "1", "question": "q", "expected_papers": ["p"]}]')
    assert tables.evaluation_cases(spark, str(case)).count() == 1
    case.write_text('[{"id": "", "question": "q"}]')
    with pytest.raises(Exception, match="lacks an id"):
        tables.evaluation_cases(spark, str(case)).collect()
    with pytest.raises(ValueError, match="missing"):
        tables.conforms(spark.range(1), tables.COLLECTIONS["nodes"])


def test_upsert_and_admission(spark):
    old = spark.createDataFrame([("a", "x", T(1)), ("b", "y", T(1))], "k string, v string, created_at timestamp")
    new = spark.createDataFrame([("a", "new", T(5)), ("c", None, T(5))], "k string, v string, created_at timestamp")
    got = {r.k: (r.v, r.created_at) for r in changes.upsert(old, new, ["k"], [F.desc("created_at")], ("created_at",), {"v": F.lit("pending")}).collect()}
    assert got == {"a": ("new", T(1)), "b": ("y", T(1)), "c": ("pending", T(5))}
    up = spark.createDataFrame([("b", 1, "x.PDF", 10), ("b", 2, "y.txt", 10), ("b", 3, "z.pdf", 10_000), ("b", 4, "w.pdf", 10)], "batch_id string, sequence int, file_name string, n_bytes bigint")
    seen = changes.admitted(up, up.limit(0).select(F.lit("q").alias("arxiv_id")), 0, 100, 50, 3)
    assert [r.verdict for r in seen.orderBy("sequence").collect()] == ["accepted", "rejected_type", "rejected_size", "rejected_batch"]
    known = seen.where("sequence = 1").select("arxiv_id")
    assert changes.admitted(up, known, 0, 100, 50, 20).where("sequence = 1").first().verdict == "skipped"


def test_capacity_and_breaker(spark):
    import pandas as pd

    frame = pd.DataFrame({"seq": [1, 2, 3], "at": [0.0, 1.0, 100.0], "tokens": [800, 400, 80]})
    out, slot = streaming.reserve(frame, 0.0, 8000.0)
    assert list(out.ready_at) == [0.0, 6.0, 100.0] and slot == pytest.approx(100.6)
    r = random.Random(4)
    many = pd.DataFrame({"seq": range(200), "at": [r.choice([1.0, 2.5]) * k * r.random() for k in range(200)], "tokens": [r.randint(0, 900) for _ in range(200)]})
    for f in (frame, many):
        want, _ = streaming.reserve(f, 0.0, 8000.0)
        got = streaming.reserved(spark.createDataFrame(f.assign(scheduler="s")), 8000.0).orderBy("seq").collect()
        assert [x.ready_at for x in got] == pytest.approx(list(want.sort_values("seq").ready_at))
    rates = spark.createDataFrame([(["rate_limit"] + ["success"] * 20,)], "o array<string>").select(streaming.rates(F.col("o"), 8000)).first()[0]
    assert rates == [4000] * 20 + [4400]
    calls = spark.createDataFrame([("s", k, float(k), ok) for k, ok in enumerate([False, False, False, True, False])], "scheduler string, seq int, at double, ok boolean")
    assert [(x.failures, x.open, x.until) for x in streaming.breaker(calls).orderBy("seq").collect()] == [(1, False, None), (2, False, None), (3, True, 302.0), (0, False, None), (1, False, None)]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    s = streaming.stream(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " "))
    for name, f in (("tumble", lambda e, late: streaming.tumbling(e, "1 hour", late)), ("slide", lambda e, late: streaming.sliding(e, "1 hour", "30 minutes", late)), ("sess", lambda e, late: streaming.sessions(e, "10 minutes", late))):
        q = f(s, "10 days").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(map(tuple, spark.table(name).collect()))
        assert got == sorted(map(tuple, f(df, None).collect())), name


def test_capacity_stream(spark, tmp_path):
    rows = [("s", i, float(i), 800) for i in range(6)]
    df = spark.createDataFrame(rows, "scheduler string, seq long, at double, tokens long")
    df.orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streaming.stream(spark, str(tmp_path / "in"), "scheduler string, seq long, at double, tokens long")
    q = streaming.reserved_stream(s, 8000.0).writeStream.format("memory").queryName("slots").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, streaming.reserved(df, 8000.0).collect()))
    assert sorted(map(tuple, spark.table("slots").collect())) == want and len(want) == 6


def test_worker_runs_once(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "job_id string").coalesce(1).write.parquet(str(tmp_path / "jobs"))
    seen = []
    for _ in range(2):
        q = streaming.worker(streaming.stream(spark, str(tmp_path / "jobs"), "job_id string"), str(tmp_path / "ck"), lambda df, i: seen.extend(r.job_id for r in df.collect()))
        q.awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_bm25_batch_shuffles_no_hits(spark, monkeypatch):
    """Scores of a chunk are summed where its tokens are, for one block of questions after the other; hits were shuffled before."""
    chunks = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 6))) for i in range(60)], "doc_id long, text string")
    questions = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} the") for i in range(12)], "question_id long, question string")
    whole = retrieval.bm25_batch(chunks, questions, 4)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(question_id#\w+, doc_id#", plan)
    monkeypatch.setattr(retrieval, "ASKED", 5)
    assert sorted(map(tuple, retrieval.bm25_batch(chunks, questions, 4).collect())) == sorted(map(tuple, whole.collect())) != []


def test_bm25_batch_equals_bm25(spark):
    import random

    from sablewright.operators import retrieval

    r = random.Random(11)
    text = lambda n: " ".join(r.choice(["a", "B", "c", "dd", "é", "x1", "the"]) for _ in range(n))
    rows = [(i, text(r.randint(0, 30))) for i in range(60)] + [(60, None), (61, ""), (62, "rare the"), (63, "rare the")]
    chunks = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    questions = [(1, "a the the"), (2, "RARE"), (3, "nowhere"), (4, ""), (5, None), (6, "rare a dd é")]
    got = retrieval.bm25_batch(chunks, spark.createDataFrame(questions, "question_id long, question string"), 5).collect()
    for k, q in questions:
        want = sorted((-round(x.score, 9), x.doc_id) for x in retrieval.bm25(chunks, q or "").collect())[:5]
        assert [(-x.score, x.doc_id) for x in sorted((x for x in got if x.question_id == k), key=lambda x: x["rank"])] == want, q
    assert retrieval.bm25_batch(chunks.limit(0), spark.createDataFrame(questions, "question_id long, question string"), 5).count() == 0


def test_facts_against_brute_force(spark):
    """Routes, ids and scores of facts as plain loops give them: nulls, ties in age, repeated facts, a hot subject."""
    import hashlib
    import random

    rng = random.Random(5)
    ids = lambda p: rng.choice([None, *[f"{p}{min(rng.randrange(9), rng.randrange(9))}" for _ in range(6)]])
    facts = [(ids("s"), rng.choice(["SOLVES", "IMPROVES"]), ids("o")) for _ in range(150)]
    known = [(f"F{k:03}", ids("s"), "SOLVES", ids("o"), rng.choice([None, 100, 200, 300])) for k in range(60)]
    signature = lambda s, p, o: f"{s or ''}|{p}|{o or ''}"
    k = spark.createDataFrame(known, "fact_id string, subject_id string, predicate string, object_id string, at long")
    k = k.withColumn("updated_at", F.timestamp_seconds("at")).withColumn("signature", evidence.fact_signature(F.col("subject_id"), F.col("predicate"), F.col("object_id"))).drop("at")
    f = spark.createDataFrame(facts, "subject_id string, predicate string, object_id string")

    want = {}
    for s, p, o in set(facts):
        same = [x[0] for x in known if signature(*x[1:4]) == signature(s, p, o)]
        if same:
            want[s, p, o] = ("exact", min(same), 1.0)
            continue
        sharing = [x for x in known if (s is not None and x[1] == s) or (o is not None and x[3] == o)]
        sharing.sort(key=lambda x: (-x[4] if x[4] is not None else float("inf"), x[0]))
        scored = sorted((-round(0.2 * (x[1] == s) + 0.25 * (x[2] == p) + 0.5 * (x[3] == o), 6), x[0]) for x in sharing[:8])
        score, best = (-scored[0][0], scored[0][1]) if scored else (0.0, None)
        own = "F" + hashlib.sha256(signature(s, p, o).encode()).hexdigest()[:24]
        want[s, p, o] = ("rule_merge", best, score) if score >= 0.9 else ("new" if score < 0.6 else "ambiguous_unresolved", own, score)
    got = {(r.subject_id, r.predicate, r.object_id): (r.route, r.fact_id, round(r.score, 6)) for r in evidence.resolved_facts(f, k).collect()}
    assert got == want and {r for r, _, _ in want.values()} >= {"exact", "new", "ambiguous_unresolved"}
    assert evidence.resolved_facts(f, k.limit(0)).where("route <> 'new'").count() == 0 and evidence.resolved_facts(f.limit(0), k).count() == 0


def test_shared_facts_are_scored_by_literals(spark):
    """Candidates neither carry the part that is shared nor are compared as structs or rounded one by one; one that shares both parts counts once."""
    rows = [(f"F{k:02}", "SOLVES" if k % 3 else "USES", "a" if k % 2 else "b", "x" if k % 5 else "y") for k in range(20)] + [("G1", "USES", None, "x"), ("G2", "USES", "a", None)]
    k = spark.createDataFrame([(*r, "|".join(x or "" for x in (r[2], r[1], r[3]))) for r in rows], "fact_id string, predicate string, subject_id string, object_id string, signature string")
    f = spark.createDataFrame([(s, p, o) for s in ("a", "b", "c", None) for p in ("IMPROVES", "USES") for o in ("x", "y", "z", None)], "subject_id string, predicate string, object_id string")
    want = {}
    for r in f.collect():
        exact = [i for i, p, s, o in rows if (s or "", p, o or "") == (r.subject_id or "", r.predicate, r.object_id or "")]
        if exact:
            want[tuple(r)] = ("exact", 1.0, min(exact))
            continue
        near = sorted({x for part, at in ((r.subject_id, 2), (r.object_id, 3)) if part for x in sorted(x for x in rows if x[at] == part)[:8]}, key=lambda x: x[0])[:8]
        best = min(((-round(0.2 * (s == r.subject_id) + 0.25 * (p == r.predicate) + 0.5 * (o == r.object_id), 6), i) for i, p, s, o in near), default=(0.0, None))
        want[tuple(r)] = ("rule_merge" if -best[0] >= 0.9 else "ambiguous_unresolved" if -best[0] >= 0.6 else "new", -best[0], best[1] if -best[0] >= 0.9 else None)
    got = evidence.resolved_facts(f, k)
    for r in got.collect():
        route, score, fact = want.pop((r.subject_id, r.predicate, r.object_id))
        assert (r.route, r.score) == (route, pytest.approx(score)) and (fact is None or r.fact_id == fact), r
    assert not want
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in text and "array_union" not in text and "transform(candidates" in text


def test_bm25_of_few_queries_at_once(spark):
    """Several queries in one pass score as each alone; null texts count as chunks of no length."""
    docs = spark.createDataFrame([(1, "a b b c"), (2, "A\u00a0a zz"), (3, None), (4, ""), (5, "d"), (6, "b\u3000zz")], "doc_id long, text string")
    many = {(r.query, r.doc_id): r.score for r in retrieval.bm25_many(docs, ["a b", "zz zz", "", "none"]).collect()}
    alone = {(k, r.doc_id): r.score for k, q in enumerate(["a b", "zz zz"]) for r in retrieval.bm25(docs, q).collect()}
    assert many == pytest.approx(alone) and set(many) == {(0, 1), (0, 2), (0, 6), (1, 2), (1, 6)}
    assert retrieval.bm25(docs.limit(0), "a").count() == 0
