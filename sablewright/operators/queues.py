"""Job queues as transforms over a job table at a given time: enqueue, claim, lease recovery, transitions, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses and priorities of stored jobs.
RUNNABLE = ("pending", "retry_wait")
PRIORITY = {"manual": 30, "new": 20, "backfill": 10}
TERMINAL = ("completed", "failed", "skipped")


def reconciled(papers: DataFrame, jobs: DataFrame, version: int | str, key: str = "paper_id", version_col: str = "version") -> DataFrame:
    """For each indexed paper: create (no job), upgrade (an older version) or unchanged."""
    newest = jobs.groupBy(key).agg(F.max(version_col).alias("__v"))
    action = F.when(F.col("__v").isNull(), "create").when(F.col("__v") < version, "upgrade").otherwise("unchanged")
    return papers.join(newest, key, "left").withColumn("action", action).drop("__v")


def enqueued(jobs: DataFrame, wanted: DataFrame, now: Column, most_attempts: int = 2) -> DataFrame:
    """The job table after requests (paper_id, origin, force, version): new jobs, reruns of old versions, forced reruns."""
    w = wanted.select("paper_id", F.coalesce(*(F.when(F.col("origin") == k, v) for k, v in PRIORITY.items()), F.lit(PRIORITY["new"])).cast("long").alias("__p"), F.coalesce("force", F.lit(False)).alias("__f"), F.col("version").alias("__v"))
    j = jobs.join(w, "paper_id", "full")
    fresh = F.col("job_id").isNull()
    again = ~fresh & F.col("__p").isNotNull() & (F.col("__f") | (F.col("version") < F.col("__v")) | F.col("status").isin("failed"))
    start = fresh | again
    return j.select(
        "paper_id",
        F.coalesce("job_id", F.concat(F.lit("J"), F.substring(F.sha2(F.col("paper_id").cast("string").cast("binary"), 256), 1, 24))).alias("job_id"),
        F.when(fresh, 1).when(again, F.col("run_number") + 1).otherwise(F.col("run_number")).cast("long").alias("run_number"),
        F.when(start, "pending").otherwise(F.col("status")).alias("status"),
        F.when(start, F.col("__p")).otherwise(F.greatest("priority", F.coalesce("__p", "priority"))).alias("priority"),
        F.when(start, 0).otherwise(F.col("attempt_count")).cast("long").alias("attempt_count"),
        F.coalesce("max_attempts", F.lit(most_attempts)).cast("long").alias("max_attempts"),
        F.when(start, now).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(start, F.lit(None)).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"),
        F.coalesce("__v", "version").alias("version"),
    )


def claimed(jobs: DataFrame, now: Column, slots: Column | None = None, order: list[Column] | None = None, n: int = 1) -> DataFrame:
    """The runnable jobs that are claimed now: the ``n`` first of each slot by priority, due time and age."""
    order = order or [F.desc("priority"), F.asc("next_attempt_at"), F.asc("created_at"), F.asc("job_id")]
    due = jobs.where(F.col("status").isin(*RUNNABLE) & (F.col("next_attempt_at") <= now))
    if slots is None:
        return due.orderBy(*order).limit(n)
    w = Window.partitionBy(slots).orderBy(*order)
    return due.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def leased(jobs: DataFrame, claims: DataFrame, worker: str, now: Column, seconds: int) -> DataFrame:
    """The job table after claims: leased to the worker, an attempt more."""
    hit = claims.select("job_id").withColumn("__hit", F.lit(True))
    j = jobs.join(hit, "job_id", "left")
    got = F.coalesce("__hit", F.lit(False))
    return j.withColumns({"status": F.when(got, "extracting").otherwise(F.col("status")), "worker_id": F.when(got, worker).otherwise(F.col("worker_id")), "lease_expires_at": F.when(got, now + F.make_dt_interval(secs=F.lit(seconds))).otherwise(F.col("lease_expires_at")), "attempt_count": F.col("attempt_count") + got.cast("long")}).drop("__hit")


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose lease ran out wait for a retry while attempts are left, else they have failed."""
    lost = (F.col("status") == "extracting") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now))
    again = lost & (F.col("attempt_count") < F.col("max_attempts"))
    return jobs.withColumns({
        "status": F.when(again, "retry_wait").when(lost, "failed").otherwise(F.col("status")),
        "next_attempt_at": F.when(again, now).when(lost, F.lit(None)).otherwise(F.col("next_attempt_at")),
        "error_kind": F.when(lost, "lease_expired"),
        "lease_expires_at": F.when(lost, F.lit(None)).otherwise(F.col("lease_expires_at")),
    })


def finished(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The job table after outcomes (job_id, ok, retryable, delay_seconds, refund): done, waiting or failed.

    A refund gives the attempt back, as for quota errors that say nothing about the job.
    """
    j = jobs.join(outcomes, "job_id", "left")
    has, left = F.col("ok").isNotNull(), F.col("attempt_count") - F.coalesce("refund", F.lit(False)).cast("long")
    again = has & ~F.col("ok") & F.coalesce("retryable", F.lit(False)) & (left < F.col("max_attempts"))
    status = F.when(has & F.col("ok"), "completed").when(again, "retry_wait").when(has, "failed").otherwise(F.col("status"))
    return j.withColumns({"status": status, "attempt_count": F.when(has, left).otherwise(F.col("attempt_count")), "next_attempt_at": F.when(again, now + F.make_dt_interval(secs=F.coalesce("delay_seconds", F.lit(0)))).otherwise(F.col("next_attempt_at")), "lease_expires_at": F.when(has, F.lit(None)).otherwise(F.col("lease_expires_at"))}).drop("ok", "retryable", "delay_seconds", "refund")


def requeued(jobs: DataFrame) -> DataFrame:
    """After a restart what was running is pending again."""
    return jobs.withColumn("status", F.when(F.col("status").isin("processing", "extracting"), "pending").otherwise(F.col("status")))


def nested(batches: DataFrame, jobs: DataFrame, key: str = "batch_id", fields: tuple[str, ...] = ("sequence", "job_id", "status")) -> DataFrame:
    """Batches with their jobs as a list in order."""
    lists = jobs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("jobs"))
    return batches.join(lists, key, "left").withColumn("total_count", F.when(F.col("jobs").isNull(), 0).otherwise(F.size("jobs")))


def recent(df: DataFrame, time: str, now: Column, days: int, n: int, tie: str) -> DataFrame:
    """The newest rows of the last days; 1 to 7 days and 1 to 20 rows."""
    days, n = max(1, min(7, days)), max(1, min(20, n))
    return df.where(F.col(time) >= now - F.make_dt_interval(days=F.lit(days))).orderBy(F.desc(time), F.asc(tie)).limit(n)


def retained(jobs: DataFrame, now: Column, days: int, time: str = "finished_at") -> DataFrame:
    """Without finished jobs older than some days."""
    old = F.col("status").isin(*TERMINAL) & (F.col(time) < now - F.make_dt_interval(days=F.lit(days)))
    return jobs.where(~F.coalesce(old, F.lit(False)))


def status_counts(df: DataFrame, statuses: tuple[str, ...], by: list[str] | None = None, col: str = "status") -> DataFrame:
    """One column for each status of a fixed list, zeros kept, and the total; one pass."""
    aggs = [F.count_if(F.col(col) == s).alias(f"n_{s.lower()}") for s in statuses]
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(*aggs, F.count("*").alias("n_total"))


def checkpoints_done(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """The batches of each job's present run that are saved, each once."""
    cur = jobs.select("job_id", "run_number")
    return results.join(cur, ["job_id", "run_number"]).groupBy("job_id").agg(F.array_sort(F.collect_set("batch")).alias("completed_batches"))
