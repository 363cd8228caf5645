"""Queue, memory, session and event queries. Orders stand for jobs, events for observations, customers for papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablewright.functions.scores import importance
from sablewright.operators import memory, queues, sessions
from sablewright.plans.registry import query
from sablewright.sources.changes import changed, latest, upsert
from sablewright.sources.tables import table, timed
from sablewright.streaming import jobs as streaming

NOW = "1998-06-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, count(*) FILTER (WHERE o_orderstatus = 'X') AS n_x, count(*) AS n_total FROM orders")
def status_counts_pivot(spark: SparkSession, d: str) -> DataFrame:
    return queues.status_counts(table(spark, d, "orders"), ("F", "O", "P", "X"), col="o_orderstatus")


@query("SELECT c_mktsegment, count(*) AS n_papers, count(o) AS n_completed, count(*) - count(o) AS n_empty FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey GROUP BY c_mktsegment")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("o")).distinct()
    return table(spark, d, "customer").join(done, F.col("o") == F.col("c_custkey"), "left").groupBy("c_mktsegment").agg(F.count("*").alias("n_papers"), F.count("o").alias("n_completed"), (F.count("*") - F.count("o")).alias("n_empty"))


@query("WITH v AS (SELECT o_custkey, max(year(o_orderdate)) AS v FROM orders GROUP BY o_custkey) SELECT c_custkey, CASE WHEN v IS NULL THEN 'create' WHEN v < 1998 THEN 'upgrade' ELSE 'unchanged' END AS action FROM customer LEFT JOIN v ON o_custkey = c_custkey")
def reconcile_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), F.year("o_orderdate").alias("version"))
    papers = table(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"))
    return queues.reconciled(papers, jobs, 1998).select(F.col("paper_id").alias("c_custkey"), "action")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("paper_id"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "extracting").otherwise("completed").alias("status"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.col("o_orderdate").cast("timestamp").alias("next_attempt_at"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderkey") % 3).alias("attempt_count"), F.lit(2).alias("max_attempts"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 150 SECONDS")).alias("lease_expires_at"), F.col("o_totalprice"),
    )


@query(f"SELECT job_id, slot FROM (SELECT o_orderkey AS job_id, o_custkey % 16 AS slot, row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY 6 - substr(o_orderpriority, 1, 1)::INT DESC, o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '{NOW}') WHERE n = 1")
def claim_next_job(spark: SparkSession, d: str) -> DataFrame:
    slot = F.col("paper_id") % 16
    return queues.claimed(_jobs(spark, d), _now(), slot).select("job_id", slot.alias("slot"))


@query(f"SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '{NOW}' ORDER BY o_orderdate, o_orderkey LIMIT 5")
def fifo_claim(spark: SparkSession, d: str) -> DataFrame:
    return queues.claimed(_jobs(spark, d), _now(), order=[F.asc("created_at"), F.asc("job_id")], n=5).select("job_id")


@query(f"SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus <> 'P' THEN 'completed' WHEN o_orderdate + INTERVAL 150 SECONDS > TIMESTAMP '{NOW}' THEN 'extracting' WHEN o_orderkey % 3 < 2 THEN 'retry_wait' ELSE 'failed' END AS status FROM orders")
def lease_recovery(spark: SparkSession, d: str) -> DataFrame:
    return queues.recovered(_jobs(spark, d), _now()).select("job_id", "status")


@query("WITH b AS (SELECT o_custkey AS batch_id, count(*) AS total_count, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS jobs, max(o_orderdate) AS newest FROM orders GROUP BY o_custkey) SELECT batch_id, total_count, jobs FROM b WHERE newest >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAYS ORDER BY newest DESC, batch_id LIMIT 20")
def recent_batches(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    jobs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x.o_orderkey.cast("string")), ",")
    b = o.groupBy(F.col("o_custkey").alias("batch_id")).agg(F.count("*").alias("total_count"), jobs.alias("jobs"), F.max("o_orderdate").alias("newest"))
    last = o.agg(F.max("o_orderdate").cast("string")).first()[0]
    return queues.recent(b, "newest", F.lit(last).cast("timestamp_ntz"), 7, 20, "batch_id").select("batch_id", "total_count", "jobs")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-01')")
def retention(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("pending").alias("status"))
    return queues.retained(j, F.lit("1995-01-31").cast("timestamp_ntz"), 30, "o_orderdate").select("o_orderkey", "o_orderdate")


_MEM = "m AS (SELECT user_id, event_type AS type, round(sum(value), 6) AS weight, count(*) AS access_count, max(ts) AS last FROM events GROUP BY user_id, event_type)"


def _memories(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.col("event_type").alias("type")).agg(F.round(F.sum("value"), 6).alias("weight"), F.count("*").alias("access_count"), F.max("ts").alias("last_accessed")).withColumn("content", F.col("type"))


@query(f"WITH {_MEM} SELECT user_id, type, weight, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, type) AS rank FROM m QUALIFY rank <= 2")
def top_interests(spark: SparkSession, d: str) -> DataFrame:
    return memory.top_memories(_memories(spark, d), None, 2, "type").select("user_id", "type", "weight", "rank")


@query(f"WITH {_MEM} SELECT user_id, count(*) AS total_memories, round(sum(weight), 2) AS total_weight, round(avg(weight), 2) AS avg_weight FROM m GROUP BY user_id")
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    return memory.stats(_memories(spark, d))


@query(f"WITH {_MEM}, t AS (SELECT max(ts) AS now FROM events) SELECT user_id, type, round(weight * pow(0.95e0, epoch_us(now::TIMESTAMP) / 86400e6 - epoch_us(last::TIMESTAMP) / 86400e6), 3) AS weight FROM m, t")
def memory_decay(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "events").agg(F.max("ts").cast("string")).first()[0]
    return memory.faded(_memories(spark, d), F.lit(now).cast("timestamp_ntz")).select("user_id", "type", "weight")


_PAIRS = "p AS (SELECT p_partkey AS id, p_type AS type, p_retailprice AS weight, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part)"


@query(f"WITH {_PAIRS}, s AS (SELECT a.id AS l, b.id AS r, a.weight AS lw, b.weight AS rw, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) AS j FROM p a JOIN p b ON a.type = b.type AND a.id < b.id) SELECT CASE WHEN lw >= rw THEN l ELSE r END AS keep, CASE WHEN lw >= rw THEN r ELSE l END AS gone, round(j, 6) AS similarity FROM s WHERE j >= 0.8e0")
def memory_merge(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").select(F.col("p_partkey").alias("memory_id"), F.lit(1).alias("user_id"), F.col("p_type").alias("type"), F.col("p_name").alias("content"), F.col("p_retailprice").alias("weight"))
    return memory.similar_pairs(m).withColumn("similarity", F.round("similarity", 6))


@query("WITH g AS (SELECT user_id, event_type AS type, least(sum(greatest(value, 0) / 5), 10e0) AS w FROM events GROUP BY 1, 2) SELECT user_id, type, round(w, 6) AS weight FROM g")
def memory_reinforce(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("type"), F.col("event_type").alias("content"), F.greatest(F.lit(0.0), "value").alias("importance"))
    none = spark.createDataFrame([], "user_id long, type string, content string, weight double, last_accessed timestamp, access_count long")
    return memory.reinforced(none, e, _now()).select("user_id", "type", F.round("weight", 6).alias("weight"))


@query(f"SELECT o_orderkey, round(least(0.4e0 * least((o_orderkey % 13) / 10e0, 1e0) + 0.3e0 * CASE WHEN o_custkey % 150 > 0 THEN least((o_custkey % 150) / 100e0, 1e0) ELSE 0.1e0 END + 0.2e0 * least((o_orderkey % 23) / 20e0, 1e0) + 0.1e0 * greatest(0e0, 1 - floor(epoch(TIMESTAMP '{NOW}' - o_orderdate) / 86400) / 365e0), 1e0), 3) AS importance FROM orders")
def concept_importance(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", importance(F.col("o_orderkey") % 13, F.col("o_custkey") % 150, F.col("o_orderkey") % 23, F.col("o_orderdate"), _now()).alias("importance"))


@query("WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, string_agg(role || ': ' || substr(t, 1, 500), chr(10) ORDER BY turn) AS context, count(*) AS n_messages FROM m WHERE n <= 10 GROUP BY conv_id")
def conversation_tail(spark: SparkSession, d: str) -> DataFrame:
    return sessions.tail(table(spark, d, "conversations"), 10, "conv_id", "turn")


@query("SELECT conv_id, count(*) AS n_messages, count(*) - conv_id % 4 AS open_messages FROM conversations GROUP BY conv_id HAVING count(*) - conv_id % 4 >= 5")
def summary_due(spark: SparkSession, d: str) -> DataFrame:
    return sessions.summary_due(table(spark, d, "conversations"), F.col("conv_id") % 4, "conv_id", 5)


@query("SELECT conv_id, arg_max(text, turn) AS value, max(turn) AS at FROM conversations WHERE role = 'user' GROUP BY conv_id")
def latest_context(spark: SparkSession, d: str) -> DataFrame:
    return sessions.latest_of(table(spark, d, "conversations"), "conv_id", "turn", F.col("text"), F.col("role") == "user")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AND json_valid(props) AS ok FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.expr("try_parse_json(props)").isNotNull(), F.lit(False)).alias("ok"))


@query("SELECT text_md5, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT md5(text) AS text_md5, doc_id FROM documents WHERE text IS NOT NULL) GROUP BY text_md5")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("WITH e AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM e GROUP BY user_id")
def append_unique(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x.event_type), ",").alias("kinds"))


@query("WITH n AS (SELECT l_partkey AS p_partkey, max(l_extendedprice) AS price FROM lineitem GROUP BY l_partkey) SELECT coalesce(p.p_partkey, n.p_partkey) AS p_partkey, p_brand, coalesce(price, p_retailprice) AS p_retailprice FROM part p FULL JOIN n ON p.p_partkey = n.p_partkey")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_extendedprice").alias("p_retailprice"))
    return upsert(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), new, ["p_partkey"], [F.desc("p_retailprice")]).select("p_partkey", "p_brand", "p_retailprice")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'indexed' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def status_transition(spark: SparkSession, d: str) -> DataFrame:
    return changed(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_totalprice") > 100000, o_orderstatus=F.lit("indexed")).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3")
def event_windows_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.tumbling(table(spark, d, "events"), "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 6).alias("total"))


@query("WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES * k AS start FROM events, (VALUES (0), (1)) v(k)) SELECT start, start + INTERVAL 1 HOUR AS \"end\", count(*) AS n FROM w GROUP BY 1, 2")
def event_windows_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.sliding(table(spark, d, "events"), "1 hour", "30 minutes")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("WITH g AS (SELECT user_id, ts, ts >= lag(ts) OVER w + INTERVAL 30 MINUTES AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(coalesce(gap, true)::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def event_windows_session(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.sessions(table(spark, d, "events"), "30 minutes")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("WITH last AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id) SELECT user_id, event_type, value FROM events JOIN last USING (user_id, event_id)")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max_by("value", "event_id").alias("value"))


@query("WITH r AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS n_users, round(sum(v), 6) AS total FROM r GROUP BY event_type")
def diagnostics_merge(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return r.groupBy("event_type").agg(F.count("*").alias("n_users"), F.round(F.sum("v"), 6).alias("total"))


@query("WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user') SELECT conv_id, turn FROM c WHERE before IS NULL OR before <> text")
def changed_turns(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").where("role = 'user'").withColumn("before", F.lag("text").over(w))
    return c.where(F.col("before").isNull() | (F.col("before") != F.col("text"))).select("conv_id", "turn")
