"""Which vectors of a table take part in an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> F.Column:
    """Whether a vector has entries, all of them numbers. Never null."""
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(ok & (F.size(vector) > 0), F.lit(False))


def dimension(df: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors (the larger one of equals); 0 without vectors."""
    sizes = df.where(finite(vector)).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    top = sizes.agg(F.max(F.struct("n", "d"))).first()[0]
    return top["d"] if top else 0


def usable(df: DataFrame, vector: str, d: int) -> DataFrame:
    """The rows whose vector has ``d`` entries, all of them numbers."""
    return df.where(finite(vector) & (F.size(vector) == d))
