"""Whitening of vectors on an integer lattice: sums of centred products for every pair of dimensions in one aggregation.

The fit list has each distinct lattice vector once. Sums are exact whole numbers; the covariance is one aggregation by dimension, each
with the products of its entry and those after it, whose few thousand totals are all that comes to the driver; LAPACK decomposes it.
Rows are projected by array functions, without Python and without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewright.llm.common import settled, table
from sablewright.llm.vectors import dimension, usable

#: Sums of products that one aggregation has for a dimension; 126 dimensions fit, more take several.
SUMS = 64
#: Lattice entries beyond this are held there.
_FAR = 1 << 62


def lattice(vector: str, scale: int, offset: int) -> F.Column:
    """``floor(scale * c) + offset`` of every entry."""
    held = lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(_FAR)), F.lit(-_FAR))
    return F.transform(vector, lambda c: held(c) + F.lit(offset).cast("long"))


def literal(values: list, kind: str) -> F.Column:
    """An array literal of numbers; the optimizer folds it into one constant."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@dataclass(frozen=True)
class Whitening:
    """What a fit knows; all of it is bounded by the dimension, not by the rows."""

    n: int
    sums: tuple[int, ...]
    lows: tuple[int, ...]
    highs: tuple[int, ...]
    #: Unit eigenvectors (rows) and eigenvalues by falling eigenvalue, and the covariance's trace.
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def middle(self) -> list[int]:
        """A whole number near each mean: differences from it are exact."""
        return [s // self.n for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """What the sums leave after ``middle``."""
        return [s - self.n * m for s, m in zip(self.sums, self.middle, strict=True)]

    def centred(self, x: str | F.Column) -> F.Column:
        """The entries of ``x`` less their means; the whole part is subtracted exactly."""
        near = F.zip_with(x, literal(self.middle, "bigint"), lambda a, m: (a - m).cast("double"))
        return F.zip_with(near, literal([r / self.n for r in self.rest], "double"), lambda a, r: a - r)

    def spread(self, value: float) -> bool:
        """Whether an eigenvalue stands out from the rounding of the largest one."""
        return value > 16 * len(self.values) * np.finfo(float).eps * max(self.values[0], 0.0)

    def projected(self, c: F.Column, components: int) -> F.Column:
        """The first whitened components from centred entries; null along directions without variance."""
        vectors = F.array(*[literal(list(map(float, v)), "double") for v in self.vectors[:components]])
        roots = F.array(*[F.lit(float(np.sqrt(e)) if self.spread(e) else None).cast("double") for e in self.values[:components]])
        return F.zip_with(vectors, roots, lambda v, r: F.aggregate(F.zip_with(c, v, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t) / r)

    def deviation(self, x: str | F.Column) -> F.Column:
        """The sum of ``(n x - sum)^2``, exact: as long where the data's range proves that it fits, else as decimal; null beyond long."""
        most = sum((self.n * max(h - m, m - lo) + self.n) ** 2 for lo, h, m in zip(self.lows, self.highs, self.middle, strict=True))
        if most >= 10**36:
            return F.lit(None).cast("long")
        # below 10^36 each of the two factors has at most 18 digits
        kind, one = ("bigint", "bigint") if most < 1 << 63 else ("decimal(38,0)", "decimal(19,0)")
        near = F.zip_with(x, literal(self.middle, "bigint"), lambda a, m: a - m)
        part = F.zip_with(near, literal(self.rest, "bigint"), lambda a, r: (F.lit(self.n).cast("bigint") * a - r).cast(one))
        return F.aggregate(part, F.lit(0).cast(kind), lambda s, t: (s + t * t).cast(kind)).try_cast("bigint")


def with_whitened(df: DataFrame, w: Whitening, x: F.Column, components: int) -> DataFrame:
    """``df`` with ``deviation`` and ``whitened`` for lattice vectors ``x``; other columns of any name stay as they are."""
    # bound as the only entry of an array, centred entries are made once and not once for each component
    both = F.transform(F.array(x), lambda x: F.struct(w.deviation(x).alias("deviation"), F.transform(F.array(w.centred(x)), lambda c: w.projected(c, components))[0].alias("whitened")))
    return df.select(*[F.col(f"`{k}`") for k in df.columns], F.inline(both))


def products(c: DataFrame, d: int) -> np.ndarray:
    """The sums of ``c[i] * c[j]`` over the rows of an array column ``c`` with ``d`` entries, for all i and j.

    Row i of an aggregation by dimension has the products of entry i with itself and the ``d // 2`` entries that follow, round the end, so
    that every pair is there and the plan has few expressions: one for each pair would cost the driver hundreds of MB to compile.
    """
    twice = c.select(F.concat("c", "c").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("i"))
    out = np.zeros((d, d))
    for start in range(0, d // 2 + 1, SUMS):
        steps = range(start, min(start + SUMS, d // 2 + 1))
        for i, sums in twice.groupBy("i").agg(F.array(*[F.sum(F.col("c")[F.col("i")] * F.col("c")[F.col("i") + k]) for k in steps])).collect():
            for k, s in zip(steps, sums, strict=True):
                out[i, (i + k) % d] = out[(i + k) % d, i] = s
    return out


def fit(x: DataFrame, d: int) -> Whitening | None:
    """Mean and eigenvectors of a written table of distinct lattice vectors ``x`` with ``d`` entries; None without rows."""
    entry = x.select(F.posexplode("x").alias("i", "e")).groupBy("i")
    totals = sorted(entry.agg(F.count("*"), F.sum(F.col("e").cast("decimal(20,0)")), F.min("e"), F.max("e")).collect())
    if not totals:
        return None
    n = totals[0][1]
    sums, lows, highs = (tuple(int(t[k]) for t in totals) for k in (2, 3, 4))
    base = Whitening(n, sums, lows, highs, np.zeros((0, d)), np.zeros(0), 0.0)
    cov = products(x.select(base.centred("x").alias("c")), d) / n
    values, vectors = np.linalg.eigh(cov)
    vectors = vectors.T[::-1]
    sign = np.sign(vectors[np.arange(d), np.abs(vectors).argmax(1)])
    return Whitening(n, sums, lows, highs, vectors * sign[:, None], values[::-1], float(np.trace(cov)))


def identity_error(x: DataFrame, w: Whitening, components: int) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, from a pass over that list."""
    keep = [k for k in range(min(components, len(w.values))) if w.spread(w.values[k])]
    if not keep:
        return None
    y = with_whitened(x, w, F.col("x"), components).select("whitened")
    mean = dict(y.select(F.posexplode("whitened").alias("i", "e")).groupBy("i").agg(F.avg("e")).collect())
    c = F.array(*[F.col("whitened")[k] - F.lit(mean[k]) for k in keep])
    return float(np.abs(products(y.select(c.alias("c")), len(keep)) / w.n - np.eye(len(keep))).max())


def whitened(df: DataFrame, vector: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> tuple[DataFrame, Whitening | None, float | None]:
    """The rows whose vector can be used, with their other columns and ``deviation`` and ``whitened`` (an array); the fit; its identity error.

    Dropped are vectors that are null, empty, hold null or non-finite entries or have not the most frequent length. Entries so
    large that their lattice value passes 2^62 count as that. Directions without variance (a single distinct vector, constant
    dimensions, fewer distinct vectors than dimensions) have null entries in ``whitened``. Rows that repeat are all returned.
    """
    d = dimension(df, vector)
    rows = usable(df, vector, d)
    x = lattice(vector, scale, offset)
    fit_list = settled(rows.select(x.alias("x")).distinct()) if d else None
    w = fit(fit_list, d) if d else None
    if w is None:
        return rows.select("*", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None, None
    error = identity_error(fit_list, w, components)
    return with_whitened(rows, w, x, components), w, error


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 16 whitened components of every usable row of ``embeddings``, a row for each; see ``whitened`` for the edge cases."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows, w, error = whitened(df)
    if w is None:
        return rows.limit(0).selectExpr("vec_id", "1 as component", "0L as n", "deviation", "0D as whitened", "0D as explained", "0D as identity_error")
    share = [float(e / w.trace) if w.trace > 0 else 0.0 for e in w.values[:16]]
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, share)), F.col("at") + 1)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
