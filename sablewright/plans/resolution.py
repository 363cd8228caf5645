"""Queries of entity and fact resolution, claims, paper identity, sessions, and service state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewright.functions.schema import hashed_id
from sablewright.operators import chunking, evaluation, evidence, graph, memory, models, protocol, queues, retrieval, search, sessions
from sablewright.plans.registry import query
from sablewright.shared import settled
from sablewright.sources.changes import appended, without
from sablewright.sources.tables import table, timed
from sablewright.streaming import jobs as streaming

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
#: Vectors whose id is divisible by 100 are the queries.
_NEAREST = f"near AS (SELECT a.vec_id AS l, b.vec_id AS r, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) <= 8)"


@query(f"WITH {_NEAREST} SELECT l AS left_id, r AS right_id, round(s, 6) AS similarity FROM near")
def nearest_entities(spark: SparkSession, d: str) -> DataFrame:
    """The eight nearest vectors of one label, of every vector whose id is divisible by 100, among all vectors."""
    v = table(spark, d, "embeddings")
    out = evidence.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "vec_id", "label")
    return out.select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


_NAMED = "e AS (SELECT vec_id, label, embedding, 'name ' || (vec_id // 7) || ' of ' || (vec_id % 5) AS name FROM embeddings)"
_KEYS = "k AS (SELECT vec_id, label, unnest(list_distinct(['name:' || name, 'acro:n' || substr((vec_id // 7)::VARCHAR, 1, 1) || 'o' || (vec_id % 5), 'first:name', 'prefix:' || substr(name, 1, 8)])) AS key FROM e)"


def _entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as entities and, where the id is divisible by 100, as mentions of other names."""
    from sablewright.functions.names import blocking_keys_of

    v = table(spark, d, "embeddings").withColumn("name", F.concat(F.lit("name "), F.floor(F.col("vec_id") / 7).cast("string"), F.lit(" of "), (F.col("vec_id") % 5).cast("string")))
    e = v.select(F.format_string("E%06d", "vec_id").alias("entity_id"), F.col("label").cast("string").alias("type"), F.col("name").alias("canonical_normalized"), F.array().cast("array<string>").alias("aliases"), blocking_keys_of(F.col("name")).alias("blocking_keys"), F.lit("").alias("context"), "embedding", F.timestamp_seconds("vec_id").alias("updated_at"))
    m = v.where("vec_id % 100 = 0").select(F.col("label").cast("string").alias("type"), F.concat("name", F.lit(" too")).alias("normal"), F.col("name").alias("name"), F.lit("").alias("context"), "embedding")
    return m, e


@query(f"""WITH {_NEAREST}, {_NAMED},
m AS (SELECT vec_id, label, name || ' too' AS normal FROM e WHERE vec_id % 100 = 0), km AS (SELECT vec_id, label, unnest(list_distinct(['name:' || normal, 'acro:n' || substr((vec_id // 7)::VARCHAR, 1, 1) || 'o' || (vec_id % 5) || 't', 'first:name', 'prefix:' || substr(normal, 1, 8)])) AS key FROM m), {_KEYS},
b AS (SELECT DISTINCT km.vec_id AS l, k.vec_id AS r FROM km JOIN k USING (label, key)), n AS (SELECT l, r FROM b QUALIFY row_number() OVER (PARTITION BY l ORDER BY r DESC) <= 8),
u AS (SELECT l, r, round(s, 6) AS s FROM near UNION ALL SELECT l, r, 0 FROM n), g AS (SELECT l, r, arg_max(s, abs(s)) AS similarity FROM u GROUP BY l, r)
SELECT label || ':' || normal AS mention_id, 'E' || lpad(r::VARCHAR, 6, '0') AS entity_id, similarity FROM g JOIN m ON m.vec_id = l""")
def resolution_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The nearest entities and the newest that share a blocking key, for every mention."""
    m, e = _entities(spark, d)
    return evidence.candidates(m, e).withColumn("similarity", F.round("similarity", 6))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 100) / 100e0 END AS score FROM part)
SELECT p_partkey, CASE WHEN score >= 0.88 THEN 'rule_merge' WHEN coalesce(score, 0) < 0.55 THEN 'new' ELSE 'ambiguous_unresolved' END AS entity_route, CASE WHEN score >= 0.90 THEN 'rule_merge' WHEN coalesce(score, 0) < 0.60 THEN 'new' ELSE 'ambiguous_unresolved' END AS fact_route FROM s""")
def score_routes(spark: SparkSession, d: str) -> DataFrame:
    """What best scores lead to, for entities and for facts; a missing one is of a mention without candidates."""
    score = F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") % 100) / F.lit(100.0))
    return table(spark, d, "part").select("p_partkey", evidence.route(score).alias("entity_route"), evidence.route(score, evidence.FACT_MERGE, evidence.FACT_NEW).alias("fact_route"))


_FACTS = """f AS (SELECT DISTINCT 's' || l_suppkey AS subject_id, CASE WHEN l_returnflag = 'R' THEN 'IMPROVES' ELSE 'SOLVES' END AS predicate, 'o' || l_partkey AS object_id FROM lineitem WHERE l_linenumber % 2 = 1),
k AS (SELECT DISTINCT 's' || l_suppkey AS ks, 'SOLVES' AS kp, 'o' || l_partkey AS ko, 'F' || l_suppkey || '.' || l_partkey AS fact_id FROM lineitem WHERE l_linenumber % 2 = 0)"""


@query(f"""WITH {_FACTS}, x AS (SELECT f.*, k.fact_id FROM f LEFT JOIN k ON subject_id = ks AND predicate = kp AND object_id = ko),
a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY ks ORDER BY fact_id) <= 8), o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY ko ORDER BY fact_id) <= 8),
u AS (SELECT x.subject_id, x.predicate, x.object_id, a.* FROM x JOIN a ON subject_id = ks WHERE x.fact_id IS NULL UNION SELECT x.subject_id, x.predicate, x.object_id, o.* FROM x JOIN o ON object_id = ko WHERE x.fact_id IS NULL),
p AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY subject_id, predicate, object_id ORDER BY fact_id) <= 8),
s AS (SELECT *, round(0.2e0 * (subject_id = ks)::INT + 0.25e0 * (predicate = kp)::INT + 0.5e0 * (object_id = ko)::INT, 6) AS score FROM p),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY subject_id, predicate, object_id ORDER BY score DESC, fact_id) = 1),
j AS (SELECT x.subject_id, x.predicate, x.object_id, x.fact_id AS exact, b.fact_id AS best, score FROM x LEFT JOIN b USING (subject_id, predicate, object_id))
SELECT subject_id, predicate, object_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN score >= 0.9 THEN 'rule_merge' WHEN coalesce(score, 0) < 0.6 THEN 'new' ELSE 'ambiguous_unresolved' END AS route,
 CASE WHEN exact IS NOT NULL THEN exact WHEN score >= 0.9 THEN best ELSE 'F' || substr(sha256(subject_id || '|' || predicate || '|' || object_id), 1, 24) END AS fact_id, CASE WHEN exact IS NOT NULL THEN 1e0 ELSE coalesce(score, 0e0) END AS score FROM j""")
def fact_routes(spark: SparkSession, d: str) -> DataFrame:
    """Odd lines as facts, even lines as known facts: the same signature, one that shares subject or object, or new."""
    li = table(spark, d, "lineitem")
    s, o = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("o"), "l_partkey")
    f = li.where("l_linenumber % 2 = 1").select(s.alias("subject_id"), F.when(F.col("l_returnflag") == "R", "IMPROVES").otherwise("SOLVES").alias("predicate"), o.alias("object_id"))
    k = li.where("l_linenumber % 2 = 0").select(s.alias("subject_id"), F.lit("SOLVES").alias("predicate"), o.alias("object_id"), F.concat(F.lit("F"), "l_suppkey", F.lit("."), "l_partkey").alias("fact_id")).distinct()
    # written once: resolution reads known facts three times
    k = settled(k.withColumn("signature", F.concat_ws("|", "subject_id", "predicate", "object_id")))
    return evidence.resolved_facts(f, k).select("subject_id", "predicate", "object_id", "route", "fact_id", "score")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Line items as claims of suppliers about parts."""
    stance = F.when(F.col("l_returnflag") == "A", "contradict").otherwise("support")
    status = F.when(F.col("l_linestatus") == "O", "needs_review").when(F.col("l_returnflag") == "R", "confirmed").otherwise("auto_verified")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("P"), "l_suppkey").alias("paper_id"), F.col("l_linenumber").cast("long").alias("chunk_index"), F.concat(F.lit("F"), "l_partkey").alias("fact_id"),
        F.lit("SOLVES").alias("predicate"), F.lit("task").alias("object_type"), F.concat(F.lit("part "), "l_partkey").alias("object"), stance.alias("stance"), status.alias("review_status"),
        F.concat(F.lit("  Line "), "l_orderkey", F.lit("\tsays  SO ")).alias("evidence"), F.timestamp_seconds("l_orderkey").alias("updated_at"),
    )


_CLAIM = """c AS (SELECT 'P' || l_suppkey AS paper_id, l_linenumber AS chunk_index, 'F' || l_partkey AS fact_id, l_partkey, l_orderkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'contradict' ELSE 'support' END AS stance,
CASE WHEN l_linestatus = 'O' THEN 'needs_review' WHEN l_returnflag = 'R' THEN 'confirmed' ELSE 'auto_verified' END AS review_status, sha256('line ' || l_orderkey || ' says so') AS evidence_hash FROM lineitem),
i AS (SELECT *, 'C' || substr(sha256(paper_id || '|' || chunk_index || '|' || fact_id || '|' || evidence_hash || '|{}|' || stance), 1, 24) AS claim_id FROM c)"""


@query(f"WITH {_CLAIM} SELECT claim_id, evidence_hash, paper_id FROM i")
def claim_ids(spark: SparkSession, d: str) -> DataFrame:
    return evidence.claim_rows(_claims(spark, d)).select("claim_id", "evidence_hash", "paper_id")


@query(f"""WITH {_CLAIM}, o AS (SELECT claim_id, paper_id, l_suppkey, l_orderkey, review_status FROM i WHERE chunk_index <= 4),
n AS (SELECT i.claim_id, i.paper_id, coalesce(h.review_status, 'auto_verified') AS review_status FROM i LEFT JOIN (SELECT claim_id, review_status FROM o WHERE review_status IN ('confirmed', 'rejected')) h USING (claim_id) WHERE chunk_index >= 4 AND l_suppkey % 3 = 0)
SELECT claim_id, paper_id, review_status FROM o WHERE l_suppkey % 3 <> 0 UNION ALL SELECT * FROM n
UNION ALL SELECT claim_id, paper_id, review_status FROM o WHERE l_suppkey % 3 = 0 AND review_status = 'confirmed' AND claim_id NOT IN (SELECT claim_id FROM n)""")
def claims_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Papers read anew: their claims are replaced, those that people confirmed stay and keep their status."""
    c = evidence.claim_rows(_claims(spark, d))
    old = c.where("chunk_index <= 4").select("claim_id", "paper_id", "review_status")
    mine = F.substring("paper_id", 2, 20).cast("int") % 3 == 0
    new = c.where((F.col("chunk_index") >= 4) & mine).select("claim_id", "paper_id", F.lit("auto_verified").alias("review_status"))
    return evidence.replaced_claims(old, new, old.where(mine).select("paper_id"))


@query(f"""WITH {_CLAIM}, e AS (SELECT claim_id, paper_id, 'N' || substr(sha256('task|part ' || l_partkey), 1, 20) AS target_node_id, stance, review_status, l_orderkey FROM i)
SELECT sha256(paper_id || '|' || target_node_id || '|SOLVES|' || stance || '|' || claim_id) AS edge_id, any_value(claim_id) AS claim_id, any_value(target_node_id) AS target_node_id, 'studies' AS relation, arg_max(review_status, l_orderkey) AS review_status FROM e GROUP BY 1""")
def edge_projection(spark: SparkSession, d: str) -> DataFrame:
    """Claims as edges of the older graph, one for each edge id."""
    return evidence.edges_of(evidence.claim_rows(_claims(spark, d))).select("edge_id", "claim_id", "target_node_id", "relation", "review_status")


@query(f"WITH {_CLAIM}, e AS (SELECT *, l_orderkey % 11 = 0 AS hit FROM i) SELECT claim_id, CASE WHEN bool_or(hit) OVER (PARTITION BY claim_id) THEN 'rejected' ELSE review_status END AS review_status FROM e")
def review_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Edges of some orders are rejected by a review; the claims that they show follow."""
    c = evidence.claim_rows(_claims(spark, d)).withColumn("edge_id", F.concat(F.lit("x"), (F.unix_seconds("updated_at") % 11).cast("string"), "claim_id"))
    ids = c.where(F.unix_seconds("updated_at") % 11 == 0).select("edge_id").distinct()
    _, claims = evidence.reviewed(c.select("edge_id", "claim_id", "review_status"), c.select("claim_id", "review_status"), ids, "rejected")
    return claims


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN least(1, doc_id % 20) WHEN doc_id % 3 = 1 THEN 0.25 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'method' END AS subject_type, CASE WHEN lower(lang) IN ('support', 'contradict') THEN lower(lang) ELSE 'support' END AS stance FROM documents")
def claims_adapted(spark: SparkSession, d: str) -> DataFrame:
    """Raw candidates of a model as claims in the closed vocabularies."""
    raw = table(spark, d, "documents").select(
        F.col("doc_id").alias("paper_id"), F.lit(0).alias("chunk_index"), F.lit(" a ").alias("subject"), F.when(F.col("doc_id") % 2 == 0, "Technique").otherwise("riddle").alias("subject_type"), F.lit("uses").alias("predicate"), F.lit("b").alias("object"), F.lit("pde").alias("object_type"),
        F.col("lang").alias("stance"), F.lit(None).cast("string").alias("evidence"), F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 20).cast("string")).when(F.col("doc_id") % 3 == 1, "0.25").otherwise("high").alias("confidence"),
    )
    return evidence.claims_of(raw).select(F.col("paper_id").alias("doc_id"), "confidence", "subject_type", "stance")


_CHECKS = """v AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'unknown_chunk' WHEN doc_id % 10 = 1 THEN 'short_name' WHEN doc_id % 10 = 2 THEN 'short_evidence' WHEN doc_id % 10 = 3 THEN 'outside_schema' WHEN doc_id % 10 = 4 THEN 'evidence_not_in_chunk' END AS reason FROM documents WHERE text IS NOT NULL AND len(trim(regexp_replace(substr(text, 1, 40), '\\s+', ' ', 'g'))) >= 12)"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").withColumn("e", F.substring("text", 1, 40))
    docs = docs.where(F.length(F.trim(F.regexp_replace("e", r"\s+", " "))) >= 12)
    k = F.col("doc_id") % 10
    claims = docs.select(
        F.when(k == 0, -1).otherwise(F.col("doc_id")).alias("paper_id"), F.lit(0).alias("chunk_index"), "doc_id", F.when(k == 1, "x").otherwise("xx").alias("subject"), F.lit("yy").alias("object"), F.when(k != 3, "task").alias("subject_type"), F.lit("task").alias("object_type"), F.lit("SOLVES").alias("predicate"),
        F.when(k == 2, "short").when(k == 4, F.concat("e", F.lit(" and not this"), "doc_id")).otherwise(F.concat(F.lit(" "), F.lower("e"))).alias("evidence"),
    )
    chunks = docs.select(F.col("doc_id").alias("paper_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    return evidence.checked(claims, chunks)


@query(f"WITH {_CHECKS} SELECT doc_id, reason, reason IS NULL AS valid FROM v")
def claim_checks(spark: SparkSession, d: str) -> DataFrame:
    """Why claims fail: the beginning of each text as evidence, some of them spoilt."""
    return _checked(spark, d).select("doc_id", "reason", "valid")


@query(f"WITH {_CHECKS} SELECT count(*) FILTER (WHERE reason IS NULL) AS n_auto_verified, count(*) FILTER (WHERE reason = 'outside_schema') AS n_needs_review, count(*) FILTER (WHERE reason = 'evidence_not_in_chunk') AS n_evidence_rejected, count(*) AS n_total FROM v")
def completion_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    c = _checked(spark, d).withColumn("status", F.when(F.col("valid"), "auto_verified").when(F.col("reason") == "outside_schema", "needs_review").when(F.col("reason") == "evidence_not_in_chunk", "evidence_rejected"))
    return queues.status_counts(c, ("auto_verified", "needs_review", "evidence_rejected"))


@query("""WITH c AS (SELECT doc_id, 'task' AS type, split_part(coalesce(source, 'x'), '.', 1) AS name, substr(coalesce(text, ''), 1, 30) AS evidence FROM documents),
e AS (SELECT DISTINCT name, evidence FROM c WHERE evidence <> ''), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY name ORDER BY evidence) <= 500)
SELECT c.name, count(DISTINCT doc_id) * 2 AS n, coalesce(any_value(t.context), '') AS context FROM c LEFT JOIN (SELECT name, substr(string_agg(evidence, ' ' ORDER BY evidence), 1, 1000) AS context FROM f GROUP BY name) t USING (name) GROUP BY c.name""")
def mention_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sources as names that each document mentions twice, with the beginnings of their texts as contexts."""
    name = F.split(F.coalesce("source", F.lit("x")), r"\.")[0]
    c = table(spark, d, "documents").select(F.lit("task").alias("subject_type"), name.alias("subject"), F.lit("task").alias("object_type"), name.alias("object"), F.substring(F.coalesce("text", F.lit("")), 1, 30).alias("evidence"))
    return evidence.mentions(c).select("name", "n", "context")


@query("SELECT route, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 'exact' WHEN l_returnflag = 'N' THEN 'new' ELSE 'rule_merge' END AS route FROM lineitem) GROUP BY route")
def route_counts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.coverage(table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "new").otherwise("rule_merge").alias("route")))


@query("SELECT round(avg((l_suppkey % 4 = l_partkey % 4)::INT), 6) AS accuracy, round(avg((l_returnflag = 'R' AND l_suppkey % 4 <> l_partkey % 4)::INT), 6) AS incorrect_merge_rate FROM lineitem WHERE l_linestatus = 'F'")
def resolution_quality(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("entity_id"), F.when(F.col("l_linestatus") == "F", F.col("l_partkey") % 4).alias("expected_id"), (F.col("l_returnflag") == "R").alias("merged"))
    out = evaluation.resolution_quality(li)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("""WITH e AS (SELECT p_partkey, p_type, lower(p_name) AS n FROM part WHERE p_partkey % 2 = 0), r AS (SELECT DISTINCT p_type, lower(p_name) AS n FROM part WHERE p_partkey % 2 = 1),
t AS (SELECT p_type, n, min(p_partkey) AS p_partkey FROM e GROUP BY p_type, n), taken AS (SELECT p_type, n FROM e),
a AS (SELECT t.p_partkey, count(*) AS extra FROM t JOIN r ON r.p_type = t.p_type AND r.n || ' x' NOT IN (SELECT n FROM taken) WHERE r.n = t.n GROUP BY t.p_partkey)
SELECT p_partkey, 1 + coalesce(extra, 0) AS n_aliases FROM e LEFT JOIN a USING (p_partkey)""")
def entity_growth(spark: SparkSession, d: str) -> DataFrame:
    """Even parts as entities; odd ones merge into the first of their type and name under another spelling, which becomes an alias."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("type"), F.lower("p_name").alias("n"))
    e = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("entity_id"), "type", F.col("n").alias("canonical_normalized"), F.array("n").alias("aliases"))
    first = p.where("p_partkey % 2 = 0").groupBy("type", "n").agg(F.min("p_partkey").cast("string").alias("entity_id"))
    r = p.where("p_partkey % 2 = 1").select("type", "n").distinct().join(first, ["type", "n"]).select("entity_id", "type", F.concat("n", F.lit(" x")).alias("normal"), F.col("n").alias("name"), F.lit("rule_merge").alias("route"))
    return evidence.grown_entities(e, r, F.timestamp_seconds(F.lit(0))).select(F.col("entity_id").cast("long").alias("p_partkey"), F.size("aliases").cast("long").alias("n_aliases"))


# --- graph search


@query("""SELECT l_orderkey || '-' || l_linenumber AS edge_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND contains(lower('part ' || l_partkey || chr(10) || 'Line ' || l_orderkey), 'part 1') ORDER BY l_orderkey DESC, edge_id LIMIT 100""")
def edge_search(spark: SparkSession, d: str) -> DataFrame:
    """The newest usable edges of a relation that hold a phrase."""
    return graph.searched(_edges(spark, d), "PART 1", "improves", ("improves", "uses")).select("edge_id")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("edge_id"), F.concat(F.lit("P"), "l_suppkey").alias("source_paper_id"), F.concat(F.lit("part "), "l_partkey").alias("target_name"), F.concat(F.lit("Line "), "l_orderkey").alias("evidence"),
        F.when(F.col("l_returnflag") == "R", "improves").otherwise("uses").alias("relation"), F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("needs_review").alias("review_status"), F.timestamp_seconds("l_orderkey").alias("updated_at"),
    )


@query("""WITH q AS (SELECT conv_id, 'part ' || (turn * 3 + conv_id) AS p FROM conversations WHERE turn % 2 = 0), e AS (SELECT l_orderkey || '-' || l_linenumber AS edge_id, 'P' || l_suppkey AS paper_id, l_orderkey, lower('part ' || l_partkey || chr(10) || 'Line ' || l_orderkey) AS t FROM lineitem WHERE l_linestatus = 'F'),
w AS (SELECT DISTINCT p FROM q), h AS (SELECT p, paper_id FROM w JOIN e ON contains(t, p) QUALIFY row_number() OVER (PARTITION BY p ORDER BY l_orderkey DESC, edge_id) <= 12)
SELECT DISTINCT conv_id, p AS phrase, paper_id FROM (SELECT DISTINCT conv_id, p FROM q) JOIN h USING (p)""")
def graph_questions(spark: SparkSession, d: str) -> DataFrame:
    """Papers that the graph proposes for questions that ask for relations; the longest phrase that an edge holds counts."""
    name = F.concat(F.lit("part "), (F.col("turn") * 3 + F.col("conv_id")).cast("string"))
    # digits are no phrase, so the number is spelled as a word of the edge's text
    t = table(spark, d, "conversations").where("turn % 2 = 0").select("conv_id", F.concat(F.translate(name, "0123456789 ", "abcdefghij_"), F.lit(" 使用 no_such_thing_anywhere_at_all")).alias("question")).distinct()
    e = _edges(spark, d).withColumn("target_name", F.translate("target_name", "0123456789 ", "abcdefghij_")).withColumn("evidence", F.translate("evidence", "0123456789 ", "abcdefghij_"))
    # each question names one part, so it is its own key
    out = graph.question_papers(t.withColumn("question_id", F.struct("conv_id", "question")), e)
    return out.select("question_id.conv_id", F.translate("phrase", "abcdefghij_", "0123456789 ").alias("phrase"), "paper_id").withColumn("phrase", F.regexp_replace("phrase", "^p0rt", "part")).distinct()


# --- paper identity, sessions


@query("""WITH t AS (SELECT conv_id * 100 + turn AS turn_id, conv_id, turn, (conv_id + turn) % 9 AS k, CASE WHEN turn % 2 = 1 THEN 'C7' END AS focus FROM conversations)
SELECT turn_id, CASE k WHEN 0 THEN 'C1' WHEN 1 THEN '2401.00002' WHEN 2 THEN 'C3' WHEN 3 THEN 'C5' WHEN 4 THEN focus WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN coalesce(focus, 'H2') ELSE coalesce(focus, 'H2') END AS paper_id,
CASE k WHEN 0 THEN 'explicit_target' WHEN 1 THEN 'arxiv_id' WHEN 2 THEN 'doi' WHEN 3 THEN 'title_match' WHEN 4 THEN 'title_match' WHEN 5 THEN 'none' WHEN 6 THEN 'none' ELSE CASE WHEN focus IS NULL THEN 'history_resolution' ELSE 'session_focus' END END AS source,
CASE WHEN k < 4 THEN CASE WHEN focus IS NULL THEN 'resolved' ELSE 'switch' END WHEN k = 4 THEN CASE WHEN focus IS NULL THEN 'ambiguous' ELSE 'resolved' END WHEN k IN (5, 6) THEN 'unresolved' ELSE 'resolved' END AS status,
CASE WHEN k < 4 THEN focus END AS switched_from, CASE k WHEN 0 THEN 'C1' WHEN 1 THEN '2401.00002' WHEN 2 THEN 'C3' WHEN 3 THEN 'C5' WHEN 4 THEN CASE WHEN focus IS NULL THEN 'C5,C6' ELSE 'C7,C5,C6' END WHEN 5 THEN '' WHEN 6 THEN '' ELSE CASE WHEN focus IS NULL THEN 'H2,H9' ELSE 'C7,A1' END END AS paper_ids FROM t""")
def identified_papers(spark: SparkSession, d: str) -> DataFrame:
    """Turns that name a paper in each of the ways, or none; every other one has a paper in focus, all have a history."""
    k = (F.col("conv_id") + F.col("turn")) % 9
    asked = (
        F.when(k == 1, "see arXiv:2401.00002v1").when(k == 2, "see doi 10.1234/ABC.3.").when(k == 3, "what does Graph Networks at Scale say").when(k == 4, "compare with Graph Networks at Scale, Extended")
        .when(k == 5, "换一篇").when(k == 6, "search for something else").when(k == 7, "搜索类似论文").otherwise("go on")
    )
    past = F.array(*(F.struct(F.lit(p).alias("primary"), F.array(F.lit(p), F.lit("H9")).alias("paper_ids"), F.lit(s).alias("status")) for p, s in (("H1", "resolved"), ("H2", "switch"), ("H3", "ambiguous"))))
    t = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), asked.alias("query"), F.when(k == 0, "C1").alias("target"), F.when(F.col("turn") % 2 == 1, "C7").alias("focus"), F.array(F.lit("A1")).alias("active"), past.alias("history"))
    papers = spark.createDataFrame([("2401.00002", "By its id", None), ("C3", "By its DOI", "10.1234/abc.3"), ("C5", "Graph Networks at Scale", None), ("C6", "Graph networks at scale: extended", None), ("C8", "short", None)], "paper_id string, title string, doi string")
    return sessions.identified(t, papers).select("turn_id", "paper_id", "source", "status", "switched_from", F.array_join("paper_ids", ",").alias("paper_ids"))


@query("SELECT b.item_id AS paper_id, d.doc_id AS turn_id FROM documents d JOIN benchmark b ON contains(regexp_replace(lower(coalesce(d.text, '')), '[^a-z0-9一-鿿]+', '', 'g'), regexp_replace(lower(b.text), '[^a-z0-9一-鿿]+', '', 'g')) WHERE len(regexp_replace(lower(b.text), '[^a-z0-9一-鿿]+', '', 'g')) >= 6")
def title_matches(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as titles that stand in documents, whatever their punctuation."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("turn_id"), F.col("text").alias("query"))
    return sessions.title_hits(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("paper_id"), F.col("text").alias("title")))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND turn % 4 <> 3 THEN 'p' || turn END AS own FROM conversations)
SELECT conv_id, turn, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS focus FROM t""")
def focus_history(spark: SparkSession, d: str) -> DataFrame:
    """The paper in focus after each turn; turns that fail or resolve nothing keep it."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "resolved").otherwise("unresolved").alias("status"), F.when(F.col("turn") % 4 == 3, "x").alias("error"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("paper_id"))
    return sessions.focus(t, "conv_id").select("conv_id", "turn", "focus")


@query("SELECT c_custkey AS user_id, 'interests' AS field, 'a' AS before, 'a,' || c_mktsegment AS after FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'methods', '', 'm' FROM customer WHERE c_custkey % 3 = 0")
def profile_audit(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows of the profile lists that changed."""
    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("user_id"), F.array(F.lit("a")).alias("interests"), F.lit(None).cast("array<string>").alias("methods"))
    more = F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    new = c.select(F.col("c_custkey").alias("user_id"), sessions.with_unique(F.array(F.lit("a")), more).alias("interests"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("m"))).alias("methods"))
    out = sessions.changed_profiles(old, new, ("interests", "methods"))
    return out.select("user_id", "field", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query("SELECT c_custkey::VARCHAR AS session_id, CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey END AS primary_paper, CASE WHEN c_custkey % 3 = 0 THEN 0.9e0 END AS confidence, 'local-user' AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS n_active, 0 AS summarised FROM customer")
def sessions_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the old form, some with active papers and none with a focus."""
    p = F.concat(F.lit("p"), F.col("c_custkey").cast("string"))
    old = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 == 0, F.array(p, F.lit("q"))).alias("active_paper_ids"))
    out = sessions.loaded(old)
    return out.select("session_id", F.col("paper_focus.primary_paper_id").alias("primary_paper"), F.col("paper_focus.confidence").alias("confidence"), "user_id", F.size("active_paper_ids").alias("n_active"), F.col("summary_through_message_count").cast("int").alias("summarised"))


@query("""WITH g AS (SELECT user_id, event_type, min(event_id) AS f, arg_max(value > 5, event_id) AS done, count(*) AS n, sum(value) FILTER (WHERE value > 5) AS ms FROM events GROUP BY user_id, event_type)
SELECT user_id AS run_id, event_type AS agent, CASE WHEN done THEN 'completed' ELSE 'running' END AS status, n AS n_reports, round(ms, 6) AS duration_ms, row_number() OVER (PARTITION BY user_id ORDER BY f, event_type) AS position FROM g""")
def run_timelines(spark: SparkSession, d: str) -> DataFrame:
    """Users as runs, their event types as agents that report."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("agent"), F.col("event_id").alias("seq"), F.when(F.col("value") > 5, "completed").otherwise("running").alias("status"), F.lit("").alias("detail"), F.col("value").alias("duration_ms"))
    return sessions.timeline(e).select("run_id", "agent", "status", "n_reports", F.round("duration_ms", 6).alias("duration_ms"), "position")


# --- scans, appends, vectors


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 25")
def jobs_by_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(25)


@query("SELECT turn AS chunk_index, md5(text) AS digest FROM conversations WHERE conv_id = 5 ORDER BY turn")
def chunks_of_paper(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("conv_id = 5").select(F.col("turn").alias("chunk_index"), F.md5(F.col("text").cast("binary")).alias("digest")).orderBy("chunk_index")


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 500")
def bounded_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy("doc_id").limit(500)


@query("SELECT user_id AS session_id, max(ts) AS updated_at, count(*) AS n_messages FROM events GROUP BY user_id ORDER BY updated_at DESC, user_id LIMIT 20")
def newest_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("updated_at"), F.count("*").alias("n_messages"))
    return s.orderBy(F.desc("updated_at"), "session_id").limit(20).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("SELECT conv_id, turn, role, len(text) AS n FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'user', 2 FROM conversations GROUP BY conv_id")
def appended_messages(spark: SparkSession, d: str) -> DataFrame:
    """A message more in each conversation; its columns come in another order, one is missing and one unknown."""
    c = table(spark, d, "conversations").withColumn("note", F.lit("x"))
    new = c.groupBy("conv_id").agg(F.lit("hm").alias("text"), F.lit("user").alias("role"), (F.max("turn") + 1).alias("turn")).withColumn("unknown", F.lit(1))
    return appended(c, new).select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("SELECT vec_id, label, round(list_dot_product(embedding, embedding), 4) AS norm, CASE WHEN strlen(text) <= 60 THEN text ELSE coalesce(try(decode(unhex(substr(hex(encode(text)), 1, 120)))), try(decode(unhex(substr(hex(encode(text)), 1, 118)))), try(decode(unhex(substr(hex(encode(text)), 1, 116)))), try(decode(unhex(substr(hex(encode(text)), 1, 114))))) END AS content FROM embeddings JOIN documents ON doc_id = vec_id WHERE text IS NOT NULL")
def vector_hits_with_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with the chunks that they stand for, as an index stores them: contents cut to 60 bytes between characters."""
    from sablewright.sources.changes import within_bytes

    chunks = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("vec_id"), within_bytes(F.col("text"), 60).alias("content"))
    hits = table(spark, d, "embeddings").join(chunks, "vec_id")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return hits.select("vec_id", "label", F.round(norm, 4).alias("norm"), "content")


@query("SELECT p_partkey FROM part WHERE len(list_intersect(string_split(lower(p_name), ' '), ['red', 'ring'])) > 0")
def any_of_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.arrays_overlap(F.split(F.lower("p_name"), " "), F.array(F.lit("red"), F.lit("ring")))).select("p_partkey")


@query("SELECT conv_id AS paper_id, turn AS chunk_index, row_number() OVER (ORDER BY CASE conv_id WHEN 4 THEN 1 WHEN 2 THEN 2 ELSE 3 END, turn) AS n FROM conversations WHERE conv_id IN (4, 2, 9) ORDER BY n LIMIT 8")
def paper_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The leading chunks of three papers in the order in which they are named."""
    from pyspark.sql import Window

    c = table(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("chunk_index"))
    out = search.comparison(c, [4, 2, 9], 8)
    place = F.array_position(F.array(F.lit(4), F.lit(2), F.lit(9)), F.col("paper_id").cast("int"))
    return out.withColumn("n", F.row_number().over(Window.orderBy(place, "chunk_index")).cast("long"))


@query("SELECT conv_id AS batch_id, turn AS chunk_index FROM conversations WHERE conv_id % 3 <> 0 OR turn % 2 = 1")
def validation_context(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that candidates cite in every third batch; whole batches where they cite none of it."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("chunk_index"))
    cited = c.where("batch_id % 3 = 0 and chunk_index % 2 = 1").union(c.where("batch_id % 3 = 1").select("batch_id", F.col("chunk_index") + 1000))
    return chunking.cited_or_all(c, cited)


@query("SELECT doc_id, doc_id % 2 = 0 AS found FROM documents WHERE text IS NOT NULL AND len(text) > 30")
def claim_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence that stands in the chunk that a claim names, in lower case and other spacing, or not."""
    docs = table(spark, d, "documents").where("length(text) > 30")
    items = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.lower(F.substring("text", 5, 20)), r"\s", "  ")).otherwise(F.concat(F.substring("text", 5, 20), F.lit("#?!"), F.col("doc_id"))).alias("evidence"))
    return evidence.evidence_hits(items, docs.select("doc_id", F.col("text").alias("content")), ["doc_id"]).select("doc_id", "found")


@query("SELECT p_partkey AS paper_id, 'reference' AS kind, 'r' || p_partkey || '.' || i AS other_id FROM part, range(least(p_size, 20)) t(i) UNION ALL SELECT p_partkey, 'citation', 'c' || p_partkey FROM part WHERE p_size % 2 = 0")
def citation_graph(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty references and citations of each paper."""
    p, k = table(spark, d, "part"), F.col("p_partkey").cast("string")
    one = lambda ident: F.struct(F.lit("t").alias("title"), ident.alias("paperId"))
    refs = F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: one(F.concat(F.lit("r"), k, F.lit("."), i.cast("string"))))
    p = p.select(F.col("p_partkey").alias("paper_id"), F.when(F.col("p_size") > 0, refs).alias("references"), F.when(F.col("p_size") % 2 == 0, F.array(one(F.concat(F.lit("c"), k)))).alias("citations"))
    return search.citation_edges(p).select("paper_id", "kind", "other_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 5 <> 0")
def paper_removed(spark: SparkSession, d: str) -> DataFrame:
    """What stays when papers and all that hangs on them are deleted."""
    gone = table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return without(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), gone, ["l_suppkey"]).select("l_orderkey", "l_linenumber")


# --- jobs and calls


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'failed' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'retry_wait' WHEN o_orderstatus = 'P' THEN 'retry_wait' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS status,
CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN greatest(0, 3 - greatest(1, o_custkey % 3)) ELSE 3 END AS attempt_count FROM orders""")
def job_migrations(spark: SparkSession, d: str) -> DataFrame:
    """Waiting jobs whose quota is spent have failed; jobs that rate limits used up run again with their attempts given back."""
    status = F.when(F.col("o_orderstatus") == "P", "retry_wait").when(F.col("o_orderstatus") == "F", "failed").otherwise("completed")
    spent = F.struct(F.lit(1).alias("run_number"), F.lit("llm_rate_limited").alias("error_kind"), F.lit(False).alias("attempt_refunded"))
    jobs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), F.lit(3).alias("attempt_count"), F.lit(1).alias("run_number"), F.lit(None).cast("timestamp").alias("next_attempt_at"), F.lit(None).cast("int").alias("recovery_version"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), "llm_rate_limited").alias("error_kind"), F.slice(F.array_repeat(spent, 3), F.lit(1), (F.col("o_custkey") % 3).cast("int")).alias("attempt_history"),
    )
    kind = F.when(F.col("job_id") % 2 == 0, "quota").otherwise("other")
    out = protocol.rate_limit_revived(protocol.quota_finalised(jobs, F.when(F.col("status") == "retry_wait", kind).otherwise("other")), F.lit("other"), F.timestamp_seconds(F.lit(0)), 2)
    return out.select("job_id", "status", "attempt_count")


@query("SELECT o_orderkey AS job_id, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS batches FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber % 2 = o_orderkey % 2 GROUP BY o_orderkey")
def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """The saved batches of the present run of each job; a batch that is saved twice counts once."""
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 2).cast("int").alias("run_number"))
    saved = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") % 2).cast("int").alias("run_number"), F.col("l_linenumber").alias("batch"))
    out = queues.checkpoints_done(jobs, saved.union(saved))
    return out.select("job_id", F.array_join(F.transform("completed_batches", lambda x: x.cast("string")), ",").alias("batches"))


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus IN ('P', 'O') THEN 'pending' ELSE 'completed' END AS status FROM orders")
def requeued_jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "O", "extracting").otherwise("completed")
    return queues.requeued(table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status")))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    e = timed(table(spark, d, "events"), "ts")
    return e.select(F.col("user_id").cast("string").alias("scheduler"), F.col("event_id").alias("seq"), (F.unix_micros("ts") / F.lit(1e6)).alias("at"), (F.greatest(F.lit(1), F.coalesce("value", F.lit(0.0))) * 1000).cast("long").alias("tokens"), (F.col("value") <= 8).alias("ok"), "event_type")


@query("""WITH c AS (SELECT user_id::VARCHAR AS scheduler, event_id AS seq, epoch_us(ts) / 1e6 AS t, greatest(0.05, greatest(1, trunc(greatest(1, value) * 1000)) / 8000e0 * 60) AS used FROM events),
s AS (SELECT *, sum(used) OVER w AS total FROM c WINDOW w AS (PARTITION BY scheduler ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, max(t - (total - used)) OVER (PARTITION BY scheduler ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS lead_in FROM s)
SELECT scheduler, seq, round(greatest(t, total + lead_in - used) - t, 3) AS wait_seconds FROM m""")
def capacity_slots(spark: SparkSession, d: str) -> DataFrame:
    """Waits of token-limited calls: each user's events as calls whose tokens follow the value."""
    return streaming.reserved(_calls(spark, d), 8000.0).select("scheduler", "seq", F.round("wait_seconds", 3).alias("wait_seconds"))


@query("""WITH c AS (SELECT user_id::VARCHAR AS scheduler, event_id AS seq, epoch_us(ts) / 1e6 AS t, value <= 8 AS ok FROM events),
r AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY scheduler ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM c),
f AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY scheduler, run ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT scheduler, seq, CASE WHEN ok THEN 0 ELSE n END AS failures, NOT ok AND n >= 3 AS open FROM f""")
def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    """Failures in a row of each user's calls, and whether the breaker is open after them."""
    return streaming.breaker(_calls(spark, d)).select("scheduler", "seq", "failures", "open")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type = 'error' AS bad FROM events),
r(user_id, i, event_id, rate, streak) AS (SELECT user_id, 0::BIGINT, -1::BIGINT, 8000::BIGINT, 0 FROM (SELECT DISTINCT user_id FROM events) UNION ALL
SELECT o.user_id, o.i, o.event_id, CASE WHEN bad THEN greatest(1000, least(8000, greatest(1, rate // 2))) WHEN streak + 1 >= 3 AND rate < 8000 THEN least(8000, greatest(rate + 1, (rate * 11 + 9) // 10)) ELSE rate END, CASE WHEN bad OR (streak + 1 >= 3 AND rate < 8000) THEN 0 ELSE streak + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, i AS step, rate FROM r WHERE i > 0""")
def admitted_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate after each of a user's calls; errors are rate limits."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("event_type") == "error", "rate_limit").otherwise("success").alias("o")))).alias("e"))
    out = e.select("user_id", F.posexplode(streaming.rates(F.transform("e", lambda x: x.o), 8000, 1000, 3)).alias("step", "rate"))
    return out.select("user_id", (F.col("step") + 1).cast("long").alias("step"), "rate")


@query("""WITH q AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')[1:3] AS t FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT item_id, doc_id, len(list_filter(w, lambda x: list_contains(t, x))) AS n FROM q, d WHERE len(list_intersect(w, t)) = len(list_distinct(t))),
r AS (SELECT item_id, doc_id FROM h QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) <= 5)
SELECT q.item_id AS case_id, count(r.doc_id) AS n_found FROM q LEFT JOIN r USING (item_id) GROUP BY q.item_id""")
def evaluation_runs(spark: SparkSession, d: str) -> DataFrame:
    """Cases run against the corpus: the documents that hold all of a question's first three words, the five with most of them."""
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text")
    found = retrieval.cases_run(cases, table(spark, d, "documents"), words=3, n=5)
    return cases.join(found, "case_id", "left").groupBy("case_id").agg(F.count("doc_id").alias("n_found"))


@query("SELECT DISTINCT 'N' || substr(sha256('task|' || p_type), 1, 20) AS node_id FROM part")
def legacy_node_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(hashed_id("N", F.lit("task"), F.col("p_type"), size=20).alias("node_id")).distinct()


# --- model calls, paper memories


def _stub(prompt: str) -> str:
    """Stands for a model: fails for some prompts, is silent for others."""
    if prompt.endswith("3"):
        raise TimeoutError("late")
    return "" if prompt.endswith("7") else f'{{"decision": "merge", "entity_id": "{prompt}"}}' if prompt.endswith("1") else prompt.upper()


@query("""SELECT o_orderkey, CASE WHEN right('p' || o_orderkey, 1) IN ('3', '7') THEN 'none' WHEN right('p' || o_orderkey, 1) = '1' THEN '{"decision": "merge", "entity_id": "p' || o_orderkey || '"}' ELSE 'P' || o_orderkey END AS answer,
CASE WHEN right('p' || o_orderkey, 1) = '3' THEN 'TimeoutError: late' WHEN right('p' || o_orderkey, 1) = '7' THEN 'empty_response' END AS error, CASE WHEN right('p' || o_orderkey, 1) IN ('3', '7') THEN 2 ELSE 1 END AS n_tries FROM orders""")
def model_calls(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model that sometimes fails, with tries and a fallback."""
    p = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("prompt"))
    return models.asked(p, "o_orderkey", "prompt", _stub, tries=2, wait=0.0, fallback="none")


@query("SELECT o_orderkey, 'merge' AS decision, 'p' || o_orderkey AS entity_id FROM orders WHERE right(o_orderkey::VARCHAR, 1) = '1'")
def model_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on ambiguous mentions, from answers of which some are no decisions."""
    return models.decided(model_calls(spark, d), "o_orderkey")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'asked ' || turn || '|again ' || turn ELSE 'asked ' || turn || '|by rule' END AS variants, CASE WHEN turn % 3 = 1 THEN 'new ' || turn ELSE 'asked ' || turn END AS rewritten, turn % 2 = 0 AS has_prompt FROM conversations")
def question_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants and rewritings of questions from a model's answers, with the rules and the question where it gives none."""
    t = F.col("turn").cast("string")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("asked "), t).alias("question")).withColumn("question_id", F.col("conv_id") * 1000 + F.col("turn"))
    a = c.select("question_id", F.when(F.col("turn") % 3 == 0, F.concat(F.lit('Sure: ["asked '), t, F.lit('", "again '), t, F.lit('"]'))).otherwise("no list").alias("answer"))
    line = F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" new "), t)).when(F.col("turn") % 3 == 2, "two\nlines")
    v = models.variants_of(c, a, lambda q: [q, "by rule"]).join(c.select("question_id", "conv_id", "turn", "question"), "question_id")
    prompt = models.rewriting_prompt(F.col("question"), F.when(F.col("turn") % 2 == 0, "user: hm"), F.array().cast("array<string>"))
    return v.select("conv_id", "turn", F.array_join("variants", "|").alias("variants"), models.rewritten(F.col("question"), line).alias("rewritten"), prompt.isNotNull().alias("has_prompt"))


@query("""WITH m AS (SELECT doc_id, source, lang, (doc_id % 10) / 10e0 AS importance FROM documents WHERE source IS NOT NULL),
k AS (SELECT * FROM m WHERE importance >= 0.3 AND doc_id % 4 <> 0)
SELECT source AS name, count(*) AS n_papers, arg_max('d' || doc_id, (importance, doc_id::VARCHAR)) FILTER (WHERE true) AS definition FROM k GROUP BY source""")
def concept_memories(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of the papers that stay, after every fourth paper is forgotten; those of little importance are not kept."""
    docs = table(spark, d, "documents").where("source is not null").withColumn("id", F.col("doc_id").cast("string"))
    c = docs.select(F.col("source").alias("name"), F.concat(F.lit("d"), "id").alias("definition"), F.array("lang").alias("aliases"), F.col("id").alias("paper_id"), (F.col("doc_id") % 10 / F.lit(10.0)).alias("importance"))
    gone = docs.where("doc_id % 4 = 0").select(F.col("id").alias("paper_id"))
    kept = memory.papers_forgotten({"raw": c, "concepts": memory.concepts_stored(c)}, gone)
    again = memory.concepts_stored(kept["raw"])
    return kept["concepts"].select("name", F.size("source_papers").cast("long").alias("n_papers")).join(again.select("name", "definition"), "name")


@query("SELECT doc_id::VARCHAR AS paper_id, coalesce(source, '') AS title, 0 AS n_keywords, 1 AS n_datasets, 'parsed' AS status FROM documents")
def paper_memories(spark: SparkSession, d: str) -> DataFrame:
    """Memories of new papers."""
    p = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.col("source").alias("title"), F.col("text").alias("abstract"), F.array("lang").alias("datasets"))
    out = memory.paper_memories(p, F.timestamp_seconds(F.lit(0)))
    return out.select("paper_id", "title", F.size("keywords").alias("n_keywords"), F.size("datasets").alias("n_datasets"), "status")
