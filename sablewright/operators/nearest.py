"""Exact nearest vectors by cosine for many queries, in cells of a block of queries and a stripe of candidates.

Both sides stay distributed: queries and candidates of a group meet in cells by one shuffle. A task streams the candidates
of a cell past its queries and keeps the best of each, so memory and what leaves a task are bounded by the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries of a cell and candidates of a cell, on average; candidates looked at together.
BLOCK_VECTORS, STRIPE_VECTORS, LOOK = 5_000, 200_000, 1_024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row becomes nan and is near to nothing."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


class Best:
    """The best candidates so far of a block of queries; of equal ones those that came first."""

    def __init__(self, ids: list, q: np.ndarray, most: int):
        self.ids, self.q, self.most = ids, unit(q), most
        self.score = np.full((len(q), most), -np.inf)
        self.at = np.full((len(q), most), np.iinfo(np.int64).max)
        self.names, self.n = {}, 0

    def look(self, ids: list, x: np.ndarray) -> None:
        x = unit(x)
        near = self.q @ x.T
        if len(x) > self.most:  # what the best of this look already beat need not be looked at closely
            worst = np.maximum(self.score[:, -1], np.partition(np.nan_to_num(near, nan=-np.inf), -self.most, axis=1)[:, -self.most])
        else:
            worst = self.score[:, -1]
        qi, ci = np.nonzero(near >= (worst - 1e-9)[:, None])
        for k in range(0, len(qi), 1 << 16):
            a, b = qi[k : k + (1 << 16)], ci[k : k + (1 << 16)]
            # one order of summing for all pairs, so that copies have equal scores
            self._merge(a, np.einsum("ij,ij->i", self.q[a], x[b]), b + self.n)
        kept = set(self.at.ravel().tolist())
        self.names = {i: v for i, v in self.names.items() if i in kept} | {self.n + j: v for j, v in enumerate(ids) if self.n + j in kept}
        self.n += len(ids)

    def _merge(self, qi: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        better = score > self.score[qi, -1]
        qi, score, at = qi[better], score[better], at[better]
        rows = np.unique(qi)
        row = np.concatenate([np.repeat(rows, self.most), qi])
        score, at = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.at[rows].ravel(), at])
        order = np.lexsort((at, -score, row))
        keep = order[np.searchsorted(row[order], rows)[:, None] + np.arange(self.most)]
        self.score[rows], self.at[rows] = score[keep], at[keep]

    def rows(self) -> Iterator[dict]:
        for i, j in zip(*np.nonzero(self.score > -np.inf), strict=True):
            yield {"left_id": self.ids[i], "right_id": self.names[int(self.at[i, j])], "similarity": float(self.score[i, j])}


def _cells(most: int, schema: pa.Schema):
    """Streams cells; in each, queries come before candidates, and candidates by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, best = None, [], None

        def closed():
            rows = list(best.rows()) if best is not None else []
            return [pa.RecordBatch.from_pylist(rows, schema=schema)] if rows else []

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("g", "d", "block", "stripe", "kind")), strict=True))
            edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for lo, hi in zip(edges, [*edges[1:], len(keys)], strict=True):
                *where, kind = keys[lo]
                if where != cell:
                    yield from closed()
                    cell, waiting, best = where, [], None
                part = b.slice(lo, hi - lo)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(hi - lo, -1)
                if kind == 0:
                    waiting.append((part.column("l").to_pylist(), v))
                    continue
                if best is None and waiting:
                    best = Best([i for ids, _ in waiting for i in ids], np.concatenate([q for _, q in waiting]), most)
                    waiting = []
                ids = part.column("r").to_pylist()
                for k in range(0, len(ids), LOOK):
                    if best is not None:
                        best.look(ids[k : k + LOOK], v[k : k + LOOK])
        yield from closed()

    return run


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, group: str, most: int = 8, vector: str = "embedding", block: int = BLOCK_VECTORS, stripe: int = STRIPE_VECTORS) -> DataFrame:
    """(left_id, right_id, similarity): for each left vector its nearest right ones of the same group by cosine, exactly.

    Ids of the left side are unique. A group of any size is cut into blocks and stripes; right vectors are sent once for each block
    of queries of their group, and those of groups without queries not at all. Vectors of other lengths are never compared.
    Null, empty and zero vectors, and those with null or nan entries, have no neighbours; ties go to smaller ids.
    """
    q = left.select(F.col(left_id).alias("l"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    s = right.select(F.col(right_id).alias("r"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    whole = F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda c: c.isNotNull())
    q, s = (x.where(F.col(i).isNotNull() & F.col("g").isNotNull() & whole).withColumn("d", F.size("v")) for x, i in ((q, "l"), (s, "r")))
    cut = lambda x, name, most_rows: x.groupBy("g", "d").agg(F.ceil(F.count("*") / F.lit(most_rows)).cast("int").alias(name))
    cells = cut(q, "blocks", block).join(cut(s, "stripes", stripe), ["g", "d"])
    part = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left_kind, right_kind = q.schema["l"].dataType, s.schema["r"].dataType
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    a = q.join(cells, ["g", "d"]).select("g", "d", part("l", "blocks").alias("block"), each("stripes").alias("stripe"), F.lit(0).alias("kind"), "l", no(right_kind, "r"), "v")
    b = s.join(cells, ["g", "d"]).select("g", "d", each("blocks").alias("block"), part("r", "stripes").alias("stripe"), F.lit(1).alias("kind"), no(left_kind, "l"), "r", "v")
    where = ["g", "d", "block", "stripe"]
    schema = pa.schema([("left_id", to_arrow_type(left_kind)), ("right_id", to_arrow_type(right_kind)), ("similarity", pa.float64())])
    ddl = f"left_id {left_kind.simpleString()}, right_id {right_kind.simpleString()}, similarity double"
    out = a.unionByName(b).repartition(*where).sortWithinPartitions(*where, "kind", "r").mapInArrow(_cells(most, schema), ddl)
    place: Column = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id"))
    return out.withColumn("__n", place).where(F.col("__n") <= most).drop("__n")
