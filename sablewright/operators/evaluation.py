"""Offline evaluation: recall, citations, abstention, latency, resolution quality, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at(expected: Column, ranked: Column, k: int) -> Column:
    """Share of the expected items among the first ``k`` different ranked ones; 1 if none are expected."""
    first = F.slice(F.array_distinct(ranked), 1, k)
    want = F.array_distinct(expected)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, first)).cast("double") / F.size(want))


def summary(runs: DataFrame, k: int = 5) -> DataFrame:
    """Means over runs (expected, ranked, citations_ok, should_abstain, abstained, latency_ms) and the median latency."""
    return runs.agg(
        F.count("*").alias("n_cases"),
        F.avg(recall_at(F.col("expected"), F.col("ranked"), k)).alias("recall"),
        F.avg(F.col("citations_ok").cast("double")).alias("citation_pass_rate"),
        F.avg((F.col("should_abstain") == F.col("abstained")).cast("double")).alias("abstention_accuracy"),
        F.percentile("latency_ms", F.lit(0.5)).alias("p50_latency_ms"),
    )


def resolution_quality(decisions: DataFrame) -> DataFrame:
    """Accuracy and rate of wrong merges over labelled decisions; null if none are labelled."""
    labelled = F.col("expected_id").isNotNull()
    return decisions.where(labelled).agg(F.avg((F.col("entity_id") == F.col("expected_id")).cast("double")).alias("accuracy"), F.avg((F.col("merged") & (F.col("entity_id") != F.col("expected_id"))).cast("double")).alias("incorrect_merge_rate"))


def duplicate_rate(df: DataFrame, key: Column) -> DataFrame:
    """Share of rows beyond the first of their key, among rows with a key; 0 if there are none."""
    n = F.count(key)
    return df.agg(n.alias("n_rows"), F.when(n == 0, 0.0).otherwise(1 - F.count_distinct(key).cast("double") / n).alias("duplicate_rate"))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Share of rows in which none of the fields is null or blank; 1 if there are no rows."""
    full = F.lit(True)
    for f in fields:
        full = full & (F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.avg(full.cast("double")), F.lit(1.0)).alias("completeness"))
