"""Numeric expressions: similarity, decay, importance, confidence, back-off, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is empty, null or zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def decayed(weight: Column, last: Column, now: Column, rate: float = 0.05) -> Column:
    """Weight after exponential decay by whole and part days since it was last used, to three places."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))).cast("double") / F.lit(86400e6)
    return F.round(weight * F.pow(F.lit(1 - rate), F.coalesce(days, F.lit(0.0))), 3)


def importance(frequency: Column, cited: Column, accessed: Column, created: Column, now: Column) -> Column:
    """Importance of a concept from frequency, citations, accesses and age, at most 1, to three places."""
    f = F.least(F.coalesce(frequency, F.lit(1)).cast("double") / 10, F.lit(1.0))
    c = F.when(F.coalesce(cited, F.lit(0)) > 0, F.least(cited.cast("double") / 100, F.lit(1.0))).otherwise(0.1)
    a = F.least(F.coalesce(accessed, F.lit(0)).cast("double") / 20, F.lit(1.0))
    days = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(created.cast("timestamp"))) / 86400).cast("double")
    r = F.when(created.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - days / 365))
    return F.round(F.least(F.lit(0.4) * f + F.lit(0.3) * c + F.lit(0.2) * a + F.lit(0.1) * r, F.lit(1.0)), 3)


def confidence(c: Column) -> Column:
    """A confidence within 0 and 1; .5 for what is no number."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def back_off(count: Column, error: Column, base: int, most: int) -> Column:
    """Seconds to wait after the n-th failure: doubling, with up to a tenth more by the hash of the error, capped."""
    delay = F.least(F.lit(most).cast("long"), (F.lit(base) * F.pow(F.lit(2.0), F.least(count - 1, F.lit(16)))).cast("long"))
    byte = F.conv(F.substring(F.sha2(F.concat_ws("|", error, count.cast("string")).cast("binary"), 256), 1, 2), 16, 10).cast("long")
    return F.least(F.lit(most).cast("long"), delay + F.floor(delay * F.lit(0.1) * byte / 255).cast("long"))


def token_estimate(payload: Column, most_output: int, overhead: int) -> Column:
    return (F.ceil(F.octet_length(payload) / F.lit(4)) + F.lit(most_output + overhead)).cast("long")


def bounded(c: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), c))
