"""Evidence-graph queries over the relational tables: suppliers as papers, parts as entities, line items as claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewright.functions.names import acronym_of, blocking_keys_of, entity_score, normal_name, token_jaccard
from sablewright.functions.schema import fact_signature, hashed_id
from sablewright.functions.text import evidence_form, tokens
from sablewright.operators import evaluation, evidence, graph
from sablewright.operators.matching import holding
from sablewright.plans.registry import query
from sablewright.sources.tables import table


@query("SELECT l_partkey AS fact_id, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') AS support_count, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'A') AS contradict_count, count(*) FILTER (WHERE l_linestatus = 'O') AS needs_review_count FROM lineitem GROUP BY l_partkey")
def fact_counts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.fact_counts(table(spark, d, "lineitem").withColumnRenamed("l_partkey", "fact_id"), stance="l_returnflag", status="l_linestatus", usable=("F",), waiting="O", support="R", contradict="A")


@query("WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT a.l_suppkey AS left_id, b.l_suppkey AS right_id, count(*) AS n_shared, string_agg(a.l_partkey::VARCHAR, ',' ORDER BY a.l_partkey) AS reasons FROM e a JOIN e b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def paper_links(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    out = graph.links(edges, "l_suppkey", "l_partkey", F.col("l_partkey"))
    return out.withColumn("reasons", F.array_join(F.col("reasons").cast("array<string>"), ","))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """region - nation - customer and supplier, both ways, as a property graph."""
    n, c, s = (table(spark, d, t) for t in ("nation", "customer", "supplier"))
    one = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit("has_nation").alias("relation"))
    two = c.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("has_customer").alias("relation"))
    three = s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.lit("has_supplier").alias("relation"))
    return one.unionByName(two).unionByName(three)


_EDGES = "g AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'has_nation' AS relation FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'has_customer' FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'has_supplier' FROM supplier)"


@query(f"WITH {_EDGES} SELECT DISTINCT src AS node, dst AS neighbour, relation FROM g WHERE src IN ('n3', 'n7') AND relation = 'has_supplier'")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), spark.createDataFrame([("n3",), ("n7",)], "node string"), "has_supplier")


@query(f"WITH RECURSIVE {_EDGES}, p(node, depth, path) AS (SELECT 'r1'::VARCHAR, 0, 'r1'::VARCHAR UNION ALL SELECT dst, depth + 1, path || '>' || dst FROM p JOIN g ON g.src = p.node WHERE depth < 3) SELECT node, min(depth) AS depth, min(path) AS path FROM p GROUP BY node")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_paths(_edges(spark, d), "r1", None, 3).withColumn("path", F.array_join("path", ">"))


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM (SELECT src AS x FROM g UNION SELECT dst FROM g)) AS n_nodes, (SELECT count(*) FROM g) AS n_edges")
def node_stats(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.node_stats(e.select("src").union(e.select("dst")).distinct(), e)


@query("SELECT p_partkey, 'E' || substr(sha256(p_type || '|' || p_name), 1, 24) AS entity_id FROM part")
def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", hashed_id("E", F.col("p_type"), F.col("p_name")).alias("entity_id"))


@query("SELECT DISTINCT l_suppkey || '|USES_DATASET|' || l_partkey AS signature, 'F' || substr(sha256(l_suppkey || '|USES_DATASET|' || l_partkey), 1, 24) AS fact_id FROM lineitem")
def fact_signatures(spark: SparkSession, d: str) -> DataFrame:
    s = fact_signature(F.col("l_suppkey").cast("string"), F.lit("USES_DATASET"), F.col("l_partkey").cast("string"))
    return table(spark, d, "lineitem").select(s.alias("signature")).distinct().withColumn("fact_id", hashed_id("F", F.col("signature")))


@query("SELECT doc_id, sha256(text) AS content_sha256, md5(text) AS content_md5 FROM documents WHERE text IS NOT NULL")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(raw, 256).alias("content_sha256"), F.md5(raw).alias("content_md5"))


_KEYS = "k AS (SELECT p_partkey, p_type, lower(p_name) AS n, unnest(['name:' || lower(p_name), 'first:' || split_part(lower(p_name), ' ', 1), 'prefix:' || substr(lower(p_name), 1, 8)]) AS key FROM part)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("p_name")
    keys = F.array(F.concat(F.lit("name:"), low), F.concat(F.lit("first:"), F.split(low, " ")[0]), F.concat(F.lit("prefix:"), F.substring(low, 1, 8)))
    return table(spark, d, "part").select("p_partkey", F.col("p_type").alias("type"), low.alias("normal"), keys.alias("blocking_keys"))


@query(f"WITH {_KEYS} SELECT DISTINCT a.p_partkey AS left_id, b.p_partkey AS right_id FROM k a JOIN k b ON a.p_type = b.p_type AND a.key = b.key AND a.p_partkey < b.p_partkey")
def blocking_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d)
    return evidence.blocked(p, p, "p_partkey", "p_partkey").where("left_id < right_id")


@query(f"WITH {_KEYS}, c AS (SELECT DISTINCT a.p_partkey AS left_id, b.p_partkey AS right_id, string_split(a.n, ' ') AS x, string_split(b.n, ' ') AS y FROM k a JOIN k b ON a.p_type = b.p_type AND a.key = b.key AND a.p_partkey < b.p_partkey) SELECT left_id, right_id, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM c")
def token_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d).withColumn("words", F.split("normal", " "))
    pairs = evidence.blocked(p, p, "p_partkey", "p_partkey", carry=("words",), made=lambda a, b: F.round(token_jaccard(a["words"], b["words"]), 6))
    return pairs.where("left_id < right_id").withColumnRenamed("made", "jaccard")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g'))) WHERE len(b.text) >= 12")
def evidence_match(spark: SparkSession, d: str) -> DataFrame:
    """Which benchmark items stand in which documents: one pass over the documents, which are not shuffled."""
    items = table(spark, d, "benchmark").where("length(text) >= 12").select("item_id", evidence_form(F.col("text")).alias("phrase"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", evidence_form(F.col("text")).alias("content"))
    return holding(docs, "content", items).select("doc_id", "phrase").join(items, "phrase").select("item_id", "doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def stale_rows(spark: SparkSession, d: str) -> DataFrame:
    from sablewright.sources.changes import without

    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return without(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("SELECT count(text) AS n_rows, round(1 - count(DISTINCT text)::DOUBLE / count(text), 6) AS duplicate_rate FROM documents")
def duplicate_rate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.duplicate_rate(table(spark, d, "documents"), F.col("text")).withColumn("duplicate_rate", F.round("duplicate_rate", 6))


@query("SELECT count(*) AS n_rows, round(avg((coalesce(trim(text), '') <> '' AND coalesce(trim(lang), '') <> '' AND quality IS NOT NULL)::INT), 6) AS completeness FROM documents LEFT JOIN labels USING (doc_id)")
def provenance_completeness(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return evaluation.completeness(df, ["text", "lang", "quality"]).withColumn("completeness", F.round("completeness", 6))


@query("WITH r AS (SELECT lang, list(doc_id ORDER BY n_chars DESC, doc_id)[1:5] AS first, list(doc_id) FILTER (WHERE quality = 1) AS want FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, round(CASE WHEN want IS NULL THEN 1 ELSE len(list_intersect(first, want))::DOUBLE / len(want) END, 6) AS recall FROM r")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("n"), "doc_id"))), lambda x: x.doc_id)
    g = df.groupBy("lang").agg(ranked.alias("ranked"), F.collect_list(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("want"))
    return g.select("lang", F.round(evaluation.recall_at(F.col("want"), F.col("ranked"), 5), 6).alias("recall"))


@query("SELECT count(*) AS n_cases, round(avg(quality), 6) AS citation_pass_rate, round(avg((quality = toxic)::INT), 6) AS abstention_accuracy, round(median(n_chars), 6) AS p50_latency_ms FROM documents JOIN labels USING (doc_id)")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    runs = df.select(F.array().cast("array<string>").alias("expected"), F.array().cast("array<string>").alias("ranked"), (F.col("quality") == 1).alias("citations_ok"), (F.col("quality") == 1).alias("should_abstain"), (F.col("toxic") == 1).alias("abstained"), F.col("n_chars").cast("double").alias("latency_ms"))
    out = evaluation.summary(runs).drop("recall")
    return out.select("n_cases", *(F.round(c, 6).alias(c) for c in out.columns if c != "n_cases"))


_SINGULAR = "CASE WHEN x LIKE '%ics' OR x LIKE '%ss' OR x LIKE '%us' OR x LIKE '%is' THEN x WHEN len(x) > 4 AND x LIKE '%ies' THEN x[:-4] || 'y' WHEN len(x) > 4 AND x LIKE '%ses' THEN x[:-3] WHEN len(x) > 3 AND x LIKE '%s' THEN x[:-2] ELSE x END"
_NAMES = f"n AS (SELECT p_partkey, list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(p_name), '[-_/]+', ' ', 'g'), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> ''), lambda x: {_SINGULAR}) AS w FROM part), m AS (SELECT p_partkey, w, array_to_string(w, ' ') AS normal FROM n), a AS (SELECT *, CASE WHEN len(w) = 1 AND len(normal) <= 12 THEN normal ELSE array_to_string(list_transform(w, lambda x: x[1]), '') END AS acronym FROM m)"


@query(f"WITH {_NAMES} SELECT p_partkey, normal, acronym, array_to_string(list_sort(list_distinct(['name:' || normal, 'acro:' || acronym, 'first:' || w[1], 'prefix:' || substr(normal, 1, 8)])), ',') AS keys FROM a")
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    n = normal_name(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", n.alias("normal")).select("p_partkey", "normal", acronym_of(F.col("normal")).alias("acronym"), F.array_join(blocking_keys_of(F.col("normal")), ",").alias("keys"))


@query()
def entity_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rule scores of the blocked pairs of parts; the brand stands for the context."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("type"), normal_name(F.col("p_name")).alias("normal"), tokens(F.col("p_brand")).alias("context"))
    keyed = p.withColumn("blocking_keys", blocking_keys_of(F.col("normal")))
    score = lambda a, b: entity_score(F.lit(True), a["normal"], b["normal"], F.array().cast("array<string>"), a["context"], b["context"], F.lit(0.0))
    pairs = evidence.blocked(keyed, keyed, "p_partkey", "p_partkey", carry=("normal", "context"), made=score)
    return pairs.where("left_id < right_id").withColumnRenamed("made", "score")
