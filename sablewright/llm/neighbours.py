"""Nearest vectors by inner product: randomly rotated one-bit codes choose the vectors that are compared exactly.

A vector less the mean, padded with zeros and turned at random, keeps the signs of its entries: one bit each. With ``o`` the
sign vector at unit length and ``a`` its inner product with the turned unit vector, ``<o, q> / a`` estimates the inner
product with a query's turned vector ``q`` without bias. What the estimate misses is the part of ``q`` off ``o`` in one random
direction, of about ``sqrt(1 - a^2) / a`` over the root of the number of bits; ``sigmas`` times that bounds it. Only vectors
whose upper bound reaches a query's worst result so far are compared on the original entries, in double precision.

Copies of a vector are searched as one. Queries and candidates meet in cells of a block of queries and a stripe of
candidates; a task streams a stripe past its block and holds ``k + 1`` results a query, so neither the size of the table nor
of a group of near copies enters its memory or the rows it returns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sablewright.llm.common import settled, small_batches, table
from sablewright.llm.vectors import dimension, usable

#: Queries of a block and candidates of a stripe, at most on average; a table has STRIPES stripes at least.
BLOCK, STRIPE, STRIPES = 4096, 1 << 20, 8
#: Tasks of the search at most; each takes its cells one after the other.
TASKS = 100_000
#: Candidates looked at together, and pairs compared exactly together.
_LOOK, _PAIRS = 1024, 1 << 15


@lru_cache(maxsize=2)
def rotation(d: int, bits: int, seed: int) -> np.ndarray:
    """``d`` orthonormal columns in ``bits`` dimensions: a random rotation of vectors padded with zeros."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, d)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).astype(np.float32))


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, and the scalars of the estimate: factor, bound for one sigma and a unit query, and ``<x, mean>``."""
    r = x - mean
    norm = np.linalg.norm(r, axis=1)
    u = r.astype(np.float32) @ turn.T
    root = np.sqrt(turn.shape[0])
    a = np.abs(u).sum(1, dtype=float) / (root * np.where(norm > 0, norm, 1.0))
    a = np.where(norm > 0, np.minimum(a, 1.0), 1.0)
    off = norm * np.sqrt(1 - a * a) / a / np.sqrt(turn.shape[0] - 1)
    return np.packbits(u > 0, axis=1), norm / (a * root), off, x @ mean


def _vectors(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _coded(d: int, bits: int, seed: int, mean: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(d, bits, seed)
        for b in batches:
            if b.num_rows:
                code, *scalars = encode(_vectors(b.column("vector"), d).astype(float), mean, turn)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits // 8), b.num_rows, [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("group"), b.column("rep"), b.column("vector"), packed, pa.array(np.stack(scalars, 1).tolist(), pa.list_(pa.float64()))], schema=schema)

    return run


class Search:
    """A block of queries with their best candidates so far."""

    def __init__(self, keys: np.ndarray, q: np.ndarray, k: int, mean: np.ndarray, turn: np.ndarray, sigmas: float):
        self.keys, self.q, self.k, self.sigmas, self.bits = keys, q, k, sigmas, turn.shape[0]
        r = q - mean
        self.turned = r.astype(np.float32) @ turn.T
        self.norm = np.linalg.norm(r, axis=1).astype(np.float32)[:, None]
        self.with_mean = (q @ mean - mean @ mean).astype(np.float32)[:, None]
        self.best = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k, 2), np.iinfo(np.int64).max)
        self.compared = 0

    def look(self, keys: np.ndarray, x: np.ndarray, code: np.ndarray, scalars: np.ndarray) -> None:
        """Candidates whose upper bound reaches the worst result of a query are compared with it exactly. Keys: least id and group."""
        factor, off, by_mean = scalars.astype(np.float32).T
        slack = np.float32(1e-5)  # many times the rounding of single precision
        signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
        # <q, x> = <q - mean, x - mean> + <x, mean> + <q, mean> - <mean, mean>
        upper = self.turned @ (signs * factor[:, None]).T
        upper += by_mean + self.with_mean
        full = self.best[:, -1] > -np.inf
        if not full.all() and len(x) > self.k:  # the likeliest first, for a worst result to begin with
            rows = np.flatnonzero(~full)
            first = np.argpartition(-upper[rows], self.k - 1, axis=1)[:, : self.k]
            self._compare(np.repeat(rows, self.k), first.ravel(), keys, x)
            upper[rows[:, None], first] = -np.inf
        upper += self.norm * (off * np.float32(self.sigmas) + slack * np.sqrt(np.float32(self.bits)) * factor) + slack * (np.abs(by_mean) + np.abs(self.with_mean))
        # an overflow of single precision rules nothing out
        at = np.flatnonzero(~(upper < np.nextafter(self.best[:, -1].astype(np.float32), np.float32(-np.inf))[:, None]))
        for k in range(0, len(at), _PAIRS):
            qi, ci = np.divmod(at[k : k + _PAIRS], len(x))
            self._compare(qi, ci, keys, x)

    def _compare(self, qi: np.ndarray, ci: np.ndarray, keys: np.ndarray, x: np.ndarray) -> None:
        for k in range(0, len(qi), _PAIRS):
            self._merge(qi[k : k + _PAIRS], np.einsum("ij,ij->i", self.q[qi[k : k + _PAIRS]], x[ci[k : k + _PAIRS]]), keys[ci[k : k + _PAIRS]])
        self.compared += len(qi)

    def _merge(self, qi: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        better = score >= self.best[qi, -1]
        qi, score, key = qi[better], score[better], key[better]
        rows = np.unique(qi)
        if not len(rows):
            return
        row = np.concatenate([np.repeat(rows, self.k), qi])
        score, key = np.concatenate([self.best[rows].ravel(), score]), np.concatenate([self.found[rows].reshape(-1, 2), key])
        order = np.lexsort((key[:, 1], key[:, 0], -score, row))
        row, score, key = row[order], score[order], key[order]
        start = np.searchsorted(row, rows)
        keep = start[:, None] + np.arange(self.k)
        self.best[rows], self.found[rows] = score[keep], key[keep]

    def results(self) -> list[pa.Array]:
        real = self.best > -np.inf
        at = np.nonzero(real)[0]
        return [pa.array(self.keys[at]), *map(pa.array, self.found[real].T), pa.array(self.best[real])]


def _searched(d: int, bits: int, seed: int, k: int, sigmas: float, mean: np.ndarray, schema: pa.Schema):
    """Streams cells: in each, queries come before candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(d, bits, seed)
        cell, waiting, search = None, [], None

        def begin():
            keys, q = (np.concatenate(part) for part in zip(*waiting, strict=True))
            waiting.clear()
            return Search(keys, q, k, mean, turn, sigmas)

        for b in batches:
            cells, kind = b.column("cell").to_numpy(), b.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if cells[lo] != cell:
                    if search is not None:
                        yield pa.RecordBatch.from_arrays(search.results(), schema=schema)
                    cell, search = cells[lo], None
                    waiting.clear()
                part = b.slice(lo, hi - lo)
                group, x = part.column("group").to_numpy(), _vectors(part.column("vector"), d).astype(float)
                if kind[lo] == 0:
                    waiting.append((group, x))
                    continue
                if search is None:
                    if not waiting:
                        continue  # a block without queries
                    search = begin()
                keys = np.stack([part.column("rep").to_numpy(), group], 1)
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(keys), -1)
                scalars = part.column("scalars").flatten().to_numpy().reshape(-1, 3)
                for i in range(0, len(keys), _LOOK):
                    j = slice(i, i + _LOOK)
                    search.look(keys[j], x[j], code[j], scalars[j])
        if search is not None:
            yield pa.RecordBatch.from_arrays(search.results(), schema=schema)

    return run


def nearest(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", bits: int | None = None, sigmas: float = 4.0, seed: int = 12, block: int = BLOCK, stripe: int = STRIPE, stripes: int = STRIPES) -> DataFrame:
    """query_id, rank, the candidate's key and score: the ``k`` largest inner products of each query row with all other rows.

    Ties go to smaller keys. ``bits`` is four a dimension unless given, in whole bytes. A candidate is missed only where
    an estimate errs by more than ``sigmas`` standard deviations (about 3 in 100000 at 4); with fewer than ``k`` other rows all come.
    Rows whose vector is null, empty, zero, holds null or non-finite entries or has not the most frequent length take no
    part, nor do rows without a key (a whole number). Rows that repeat key and vector count once; rows that share a key only are rows of their own,
    as queries too.
    """
    small_batches(df.sparkSession)
    d = dimension(df, vector)
    bits = bits or -(-4 * d // 8) * 8
    rows = usable(df, vector, d).where(F.col(key).isNotNull() & F.exists(vector, lambda c: c != 0)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), queries.alias("asked"))
    # copies are one group; the k + 1 least keys of it are all that a result can name (the one more is for the query itself)
    same = Window.partitionBy("vector").orderBy("id")
    groups = rows.select("id", "vector", F.dense_rank().over(same).alias("place")).where(F.col("place") <= k + 1)
    groups = groups.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    groups = settled(groups.select(F.monotonically_increasing_id().alias("group"), F.col("ids")[0].alias("rep"), "ids", "vector"))
    asked = settled(rows.where("asked").select("id", "vector").distinct().join(groups.select("group", "vector"), "vector").select("id", "group"))
    n, *mean = groups.agg(F.count("*"), *[F.avg(F.col("vector")[i].cast("double")) for i in range(d)]).first()
    own = asked.select("group").distinct()
    blocks, stripes = max(1, -(-own.count() // block)), max(stripes, -(-n // stripe))
    m = np.array([x or 0.0 for x in mean])
    vector_type = groups.schema["vector"].dataType
    out = pa.schema([("group", pa.int64()), ("rep", pa.int64()), ("vector", to_arrow_type(vector_type)), ("code", pa.binary()), ("scalars", pa.list_(pa.float64()))])
    part = lambda many: F.pmod(F.xxhash64("group"), F.lit(many))
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    q = groups.join(own, "group", "left_semi").select(each(stripes).alias("stripe"), "group", "rep", "vector", part(blocks).alias("block"))
    q = q.select("group", "rep", "vector", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<double>").alias("scalars"), (F.col("block") * stripes + F.col("stripe")).alias("cell"), F.lit(0).alias("kind"))
    c = groups.select("group", "rep", "vector").mapInArrow(_coded(d, bits, seed, m, out), f"group long, rep long, vector {vector_type.simpleString()}, code binary, scalars array<double>")
    c = c.select("*", each(blocks).alias("block"), part(stripes).alias("stripe")).select("group", "rep", "vector", "code", "scalars", (F.col("block") * stripes + F.col("stripe")).alias("cell"), F.lit(1).alias("kind"))
    tasks = min(blocks * stripes, TASKS)
    cells = q.unionByName(c).repartitionById(tasks, (F.col("cell") % tasks).cast("int")).sortWithinPartitions("cell", "kind")
    pairs = pa.schema([("group", pa.int64()), ("rep", pa.int64()), ("other", pa.int64()), ("score", pa.float64())])
    found = cells.mapInArrow(_searched(d, bits, seed, k + 1, sigmas, m, pairs), "group long, rep long, other long, score double")
    best = lambda *order: F.row_number().over(Window.partitionBy("group").orderBy(F.col("score").desc(), *order))
    top = found.select("*", best("rep", "other").alias("place")).where(F.col("place") <= k + 1)
    named = top.join(groups.select(F.col("group").alias("other"), "ids"), "other").select("group", "other", "score", F.explode("ids").alias("id"))
    named = named.select("*", best("id", "other").alias("place")).where(F.col("place") <= k + 1)
    lists = named.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("place", "other", "id", "score"))).alias("all"))
    rest = F.slice(F.filter("all", lambda x: (x["id"] != F.col("id")) | (x["other"] != F.col("group"))), 1, k)
    return asked.join(lists, "group").select(F.col("id").alias("query_id"), F.posexplode(rest).alias("at", "it")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("it.id").alias(key), "it.score")


def op12_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of ``embeddings`` for each row whose vec_id is divisible by 20; see ``nearest`` for the edge cases."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
