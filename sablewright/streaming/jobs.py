"""Streaming forms: windowed event counts, idempotent results, and token capacity kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sablewright.sources.tables import timed


def stream(spark: SparkSession, path: str, ddl: str, files: int = 1) -> DataFrame:
    """A stream of Parquet files of a known schema."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Counts and sums by event type in fixed windows; with ``late`` the stream drops what comes later than that."""
    e = timed(events, "ts")
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str | None = None) -> DataFrame:
    e = timed(events, "ts")
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Counts of each user's events in sessions that end after a gap."""
    e = timed(events, "ts")
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def results_once(results: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Saved results, each key once within the time that repeats may take."""
    return results.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def reserve(rows: pd.DataFrame, next_slot: float, limit: float) -> tuple[pd.DataFrame, float]:
    """Start times of calls (seq, at, tokens) in order: not before the one before has used up its share of the limit.

    Times are seconds. Without a limit every call starts at once.
    """
    out = []
    for r in rows.sort_values(["at", "seq"]).itertuples():
        ready = r.at if limit <= 0 else max(r.at, next_slot)
        if limit > 0:
            next_slot = ready + max(0.05, max(1, r.tokens) / limit * 60)
        out.append((r.seq, ready, ready - r.at))
    return pd.DataFrame(out, columns=["seq", "ready_at", "wait_seconds"]), next_slot


def reserved(calls: DataFrame, limit: float, key: str = "scheduler") -> DataFrame:
    """Batch form: (key, seq, ready_at, wait_seconds) of all calls of each scheduler, in order of time.

    A call's slot ends at the greatest, over it and all calls before it, of the call's time and what it and those after
    it use up. That is a running sum and a running maximum, so no frame holds a scheduler's calls.
    """
    if limit <= 0:
        return calls.select(key, "seq", F.col("at").alias("ready_at"), F.lit(0.0).alias("wait_seconds"))
    w = Window.partitionBy(key).orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.greatest(F.lit(0.05), F.greatest(F.lit(1), F.col("tokens")) / F.lit(float(limit)) * 60)
    c = calls.withColumn("__used", used).withColumn("__sum", F.sum("__used").over(w))
    c = c.withColumn("__lead", F.max(F.col("at") - (F.col("__sum") - F.col("__used"))).over(w))
    ready = F.greatest(F.col("at"), F.col("__sum") + F.col("__lead") - F.col("__used"))
    return c.select(key, "seq", ready.alias("ready_at"), (ready - F.col("at")).alias("wait_seconds"))


def reserved_stream(calls: DataFrame, limit: float, key: str = "scheduler") -> DataFrame:
    """Streaming form: the next free slot is each scheduler's state."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        out, slot = reserve(rows, state.get[0] if state.exists else 0.0, limit)
        state.update((float(slot),))
        out.insert(0, key, k[0])
        yield out

    return calls.groupBy(key).applyInPandasWithState(run, f"{key} string, seq long, ready_at double, wait_seconds double", "slot double", "append", GroupStateTimeout.NoTimeout)


def rates(outcomes: Column, configured: int, floor: int = 4000, threshold: int = 20) -> Column:
    """The admitted rate after each of an array of outcomes: halved by a rate limit, a tenth more after ``threshold`` successes."""
    least, need = min(max(1, floor), configured), max(1, threshold)
    start = F.struct(F.lit(configured).cast("long").alias("rate"), F.lit(0).alias("streak"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, o: Column) -> Column:
        halved = F.greatest(F.lit(least).cast("long"), F.least(F.lit(configured).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(s.rate / 2))))
        grows = (o == "success") & (s.streak + 1 >= need) & (s.rate < configured)
        more = F.least(F.lit(configured).cast("long"), F.greatest(s.rate + 1, F.floor((s.rate * 11 + 9) / 10)))
        rate = F.when(o == "rate_limit", halved).when(grows, more).otherwise(s.rate)
        streak = F.when((o == "rate_limit") | grows, 0).when(o == "success", s.streak + 1).otherwise(s.streak)
        return F.struct(rate.alias("rate"), streak.alias("streak"), F.concat(s.out, F.array(rate)).alias("out"))

    return F.aggregate(outcomes, start, step, lambda s: s.out)


def breaker(calls: DataFrame, threshold: int = 3, pause: float = 300.0, key: str = "scheduler") -> DataFrame:
    """After each call (key, seq, at, ok): the failures in a row, whether the breaker is open, and until when.

    A success closes it. Failures in a row are counted since the last success.
    """
    w = Window.partitionBy(key).orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = calls.withColumn("__run", F.count_if("ok").over(w))
    since = Window.partitionBy(key, "__run").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failures = F.count_if(~F.col("ok")).over(since)
    c = run.withColumn("failures", failures)
    until = F.when(~F.col("ok") & (F.col("failures") >= threshold), F.col("at") + F.lit(float(pause)))
    return c.select(key, "seq", "at", F.when(F.col("ok"), 0).otherwise(F.col("failures")).cast("long").alias("failures"), F.coalesce(until > F.col("at"), F.lit(False)).alias("open"), until.alias("until"))


def worker(jobs: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> Any:
    """Runs ``handle`` on each micro-batch of new jobs; a batch that failed is run again, so it must be idempotent."""
    return jobs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
