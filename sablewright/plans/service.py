"""Queries of the service side: admission, search strategies, model decisions, agents' states, evidence verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewright.functions.text import citations, evidence_verdict
from sablewright.operators import protocol, search, sessions
from sablewright.plans.registry import query
from sablewright.sources.changes import admitted
from sablewright.sources.tables import table


@query(
    """WITH f AS (SELECT o_custkey AS batch_id, o_orderkey AS sequence, 'f' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.PDF' END AS file_name, o_totalprice::BIGINT AS n_bytes FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY sequence, file_name) AS n FROM f)
SELECT sequence, CASE WHEN lower(file_name) NOT LIKE '%.pdf' THEN 'rejected_type' WHEN n_bytes > 250000 THEN 'rejected_size' WHEN n > 8 THEN 'rejected_batch' WHEN sequence % 10 = 3 THEN 'skipped' WHEN n + 3 > 10 THEN 'rejected_queue' ELSE 'accepted' END AS verdict FROM p"""
)
def upload_admission(spark: SparkSession, d: str) -> DataFrame:
    """Orders as uploaded files, customers as batches; files whose number ends in 3 are known already."""
    name = F.concat(F.lit("f"), "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, ".txt").otherwise(".PDF"))
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("sequence"), name.alias("file_name"), F.round("o_totalprice", 0).cast("bigint").alias("n_bytes"))
    stem = F.regexp_replace("file_name", r"(?i)\.pdf$", "")
    known = files.where("sequence % 10 = 3").select(F.concat(stem, F.lit("_"), F.substring(F.md5(F.col("file_name").cast("binary")), 1, 8)).alias("arxiv_id"))
    return admitted(files, known, 3, 250_000, 10, 8).select("sequence", "verdict")


@query(
    """WITH b AS (SELECT l_orderkey, min(l_linenumber % 2) AS s FROM lineitem GROUP BY l_orderkey),
k AS (SELECT l.l_orderkey, l_partkey, min(l_linenumber) AS position FROM lineitem l JOIN b ON b.l_orderkey = l.l_orderkey AND l_linenumber % 2 = s GROUP BY l.l_orderkey, l_partkey)
SELECT l_orderkey AS query_id, l_partkey AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY position, l_partkey) AS rank FROM k QUALIFY rank <= 3"""
)
def search_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Line items as search results of their order; even lines are the trusted strategy."""
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("paper_id"), (F.col("l_linenumber") % 2).alias("strategy"), F.col("l_linenumber").alias("position"))
    return search.by_strategy(r, 3).select("query_id", "paper_id", "rank")


@query(
    """WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber <= 4),
r AS (SELECT l_orderkey, least(l_linenumber, 5) AS idx, CASE WHEN l_returnflag = 'N' THEN 'new' ELSE 'merge' END AS decision, l_partkey - (l_linestatus = 'O')::INT AS target FROM lineitem WHERE l_linenumber <> 2),
g AS (SELECT l_orderkey, idx, count(*) AS n, max((decision, target)) AS d FROM r GROUP BY l_orderkey, idx),
j AS (SELECT coalesce(i.l_orderkey, g.l_orderkey) AS request_id, l_linenumber IS NOT NULL AS known, coalesce(n, 0) AS n, struct_extract_at(d, 1) = 'new' OR (struct_extract_at(d, 1) = 'merge' AND struct_extract_at(d, 2) = l_partkey) AS ok FROM i FULL JOIN g ON g.l_orderkey = i.l_orderkey AND g.idx = i.l_linenumber)
SELECT request_id, count(*) FILTER (WHERE known AND n = 0) AS missing, coalesce(sum(n - 1) FILTER (WHERE known AND n > 1), 0)::BIGINT AS repeated, coalesce(sum(n) FILTER (WHERE NOT known), 0)::BIGINT AS "unknown", count(*) FILTER (WHERE known AND n > 0 AND NOT coalesce(ok, false)) AS not_allowed FROM j GROUP BY request_id"""
)
def decision_check(spark: SparkSession, d: str) -> DataFrame:
    """Line items as requested decisions, each with its part as the only candidate, and as what came back."""
    li = table(spark, d, "lineitem")
    items = li.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("item_index"), F.array("l_partkey").alias("candidates"))
    back = li.where("l_linenumber <> 2").select(F.col("l_orderkey").alias("request_id"), F.least("l_linenumber", F.lit(5)).alias("item_index"), F.when(F.col("l_returnflag") == "N", "new").otherwise("merge").alias("decision"), (F.col("l_partkey") - (F.col("l_linestatus") == "O").cast("int")).alias("target_id"))
    return protocol.decisions(items, back).select("request_id", "missing", "repeated", "unknown", "not_allowed")


@query(
    """WITH k AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events),
l AS (SELECT user_id, event_type, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type)
SELECT u.user_id AS run_id, a AS agent, CASE WHEN l.seq IS NULL THEN 'skipped' WHEN l.value > 5 THEN 'done' ELSE 'running' END AS status FROM u, (VALUES ('click'), ('view'), ('purchase'), ('none')) v(a) LEFT JOIN l ON l.user_id = u.user_id AND l.event_type = a"""
)
def agent_status(spark: SparkSession, d: str) -> DataFrame:
    """Users as runs and event types as agents; the last event tells the status."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("agent"), F.col("event_id").alias("seq"), F.when(F.col("value") > 5, "done").otherwise("running").alias("status"), F.lit(None).cast("string").alias("message"), F.col("ts").alias("finished_at"))
    return sessions.agent_states(e, ("click", "view", "purchase", "none")).select("run_id", "agent", "status")


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role || ',c' || conv_id WHEN turn % 3 = 1 THEN role ELSE '' END AS cited,
CASE WHEN turn % 3 = 0 THEN 'citation_not_retrieved' WHEN turn % 3 = 1 THEN 'all_citations_retrieved' ELSE 'answer_has_no_citations' END AS reason FROM conversations"""
)
def citation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Answers made from the turns: some cite a retrieved title and an unknown one, some only the retrieved, some nothing."""
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("see **["), "role", F.lit("]** and [c"), "conv_id", F.lit("]"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("as ["), "role", F.lit("] says"))).otherwise(F.lit("none"))
    c = table(spark, d, "conversations").select("conv_id", "turn", answer.alias("answer"), F.array("role").alias("titles"))
    return c.select("conv_id", "turn", F.array_join(citations(F.col("answer")), ",").alias("cited"), evidence_verdict(F.col("answer"), F.col("titles"))["reason"].alias("reason"))
