"""Benchmark decontamination by latent semantic retrieval.

1. Words become hash codes, kept in shared storage; passages' document frequencies are counted over the whole corpus.
2. A randomised SVD of the passages' TF-IDF matrix A: with a random sparse test matrix O, every task adds up its part of
   A'(A O); the left singular vectors of the sum span the leading right singular space of A, and the singular values
   whiten it. Only sums of a fixed size leave a task.
3. Every document is read in overlapping windows of the lengths of the benchmark's items; windows and items are compared
   by cosine in the latent space. A window whose TF-IDF energy in words of its length's items is less than step 4 asks of the
   lightest item of its length cannot be accepted, so it is not projected.
4. A candidate is accepted if the longest common subsequence of the item's words and the document's words there carries
   enough of the item's weight and, for items with an answer, if the answer's words stand there too.

Benchmark items are taken in blocks of bounded number, each a pass over the documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sablewright.llm.common import field_of, settled, small_batches, table
from sablewright.llm.words import hashed, words_of

#: Bits of a word's code; bits of the latent space's buckets; its rank and what the sketch has beyond it; words in a passage.
BITS, SPACE_BITS, RANK, EXTRA, PASSAGE = 16, 14, 48, 8, 64
BLOCK_ITEMS = 5_000
#: The least share of an item's weight in common, and the least cosine of a candidate.
SHARE, COSINE = 0.6, 0.5
#: Windows begin at multiples of this many words (of an eighth of their length, if that is more).
STEP = 8
_WORDS = 300_000
_ANSWER = re.compile(r"(?:^|\n|\s)(?:answer|antwort|respuesta|réponse)\s*[:=]\s*", re.I)


def code_kind(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


def codes_of(texts: list[str | None], bits: int = BITS) -> list[np.ndarray]:
    """The word codes of each text."""
    h, counts = hashed(texts)
    return np.split((h >> np.uint64(64 - bits)).astype(code_kind(bits)), np.cumsum(counts)[:-1]) if texts else []


def _coded(kind: pa.DataType, bits: int):
    schema = pa.schema([("__id", kind), ("__text", pa.string()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = [c.tobytes() for c in codes_of(b.column(1).to_pylist(), bits)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary())], schema=schema)

    return run


def _passages(batches: Iterator[pa.RecordBatch], passage: int, most: int, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrices of codes, a row for each passage, and which of them count.

    The last passage of a document is filled up with its last word; a word that repeats the one before does not count.
    """
    for b in batches:
        rows = []
        for c in b.column(0):
            ids = np.frombuffer(c.as_buffer(), kind) if c.is_valid else ()
            if len(ids):
                n = -(-len(ids) // passage)
                rows.append(np.concatenate([ids, np.full(n * passage - len(ids), ids[-1], kind)]).reshape(n, passage))
        rows = np.concatenate(rows) if rows else np.zeros((0, passage), kind)
        for at in range(0, len(rows), most):
            part = rows[at : at + most]
            first = np.ones(part.shape, bool)
            first[:, 1:] = part[:, 1:] != part[:, :-1]
            yield part, first


def _frequencies(bits: int, passage: int):
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(1 << bits, np.int64), 0
        for part, first in _passages(batches, passage, 1024, code_kind(bits)):
            n += np.bincount(part[first], minlength=1 << bits)
            total += len(part)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(n[at], total), pa.int64())], schema=schema)

    return run


def passage_idf(coded: DataFrame, bits: int = BITS, passage: int = PASSAGE) -> np.ndarray:
    """Inverse passage frequency of every word code, from the counts of all documents.

    A word that occurs n times in P passages is taken to stand in P(1 - exp(-n / P)) of them.
    """
    rows = coded.select("codes").mapInArrow(_frequencies(bits, passage), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n, total = np.zeros(1 << bits), 0
    for bucket, k in rows:
        if bucket < 0:
            total = k
        else:
            n[bucket] = k
    df = total * -np.expm1(-n / max(total, 1))
    return np.log((total + 1) / (df + 1)).astype(np.float32)


def _sketch(idf: np.ndarray, space_bits: int, width: int, passage: int):
    """This task's part of A'(A O). O has one sign in each row, so A O is a sum of words by column."""
    schema = pa.schema([("bucket", pa.int32()), ("row", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.random.default_rng(17)
        column, sign = r.integers(0, width, len(idf)), r.choice((-1.0, 1.0), len(idf))
        kind = code_kind((len(idf) - 1).bit_length())
        total, mask = np.zeros((1 << space_bits, width), np.float32), kind((1 << space_bits) - 1)
        for part, first in _passages(batches, passage, 64, kind):
            ids = part[first]
            at = np.repeat(np.arange(len(part)), first.sum(1))
            x = idf[ids]
            y = np.bincount(at * width + column[ids], x * sign[ids], len(part) * width).reshape(len(part), width).astype(np.float32)
            ids = ids & mask
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            begin = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            total[ids[begin]] += np.add.reduceat(x[order, None] * y[at[order]], begin)
        at = np.flatnonzero(total.any(1))
        for k in range(0, len(at), 4096):
            rows = at[k : k + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([r.tobytes() for r in total[rows]], pa.binary())], schema=schema)

    return run


def _summed():
    """Adds the rows of each bucket; a task holds one row for each of its buckets."""
    schema = pa.schema([("bucket", pa.int32()), ("row", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(row, np.float32)
                total[k] = total[k] + x if k in total else x.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], schema=schema)

    return run


def latent_space(coded: DataFrame, idf: np.ndarray, space_bits: int = SPACE_BITS, rank: int = RANK, extra: int = EXTRA, passage: int = PASSAGE) -> np.ndarray:
    """A bucket-by-rank matrix that spans the leading right singular space of the passages' TF-IDF matrix, whitened."""
    width = rank + extra
    parts = coded.select("codes").mapInArrow(_sketch(idf, space_bits, width, passage), "bucket int, row binary")
    b = np.zeros((1 << space_bits, width))
    for bucket, row in parts.repartition("bucket").mapInArrow(_summed(), "bucket int, row binary").collect():
        b[bucket] = np.frombuffer(row, np.float32)
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    # the sketch has squared singular values
    keep = s[:rank] > 1e-9 * max(s[0], 1e-9)
    return (u[:, :rank] * np.where(keep, 1 / np.sqrt(np.maximum(s[:rank], 1e-30)), 0) * math.sqrt(max(s[0], 1e-30))).astype(np.float32)


def answer_of(text: str) -> tuple[str, str]:
    """The question and the answer of an item; no answer if none is marked."""
    found = None
    for found in _ANSWER.finditer(text):
        pass
    return (text[: found.start()], text[found.end() :]) if found else (text, "")


def common_weight(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """The greatest weight of a common subsequence of two sequences; ``weight`` is of ``a``'s elements."""
    row = np.zeros(len(b) + 1)
    for x, w in zip(a, weight, strict=True):
        hit = b == x
        if hit.any():
            take = np.concatenate(([0.0], np.where(hit, row[:-1] + w, 0.0)))
            row = np.maximum.accumulate(np.maximum(row, take))
    return float(row[-1])


def window_size(words: int) -> int:
    """The window for a question of so many words: a multiple of the step, at most about a quarter longer than a long one."""
    size = -(-max(words, 1) // STEP) * STEP
    while size & (size - 1) and size > 64 and (low := size & -size) < size // 8:
        size += low
    return size


class Items:
    """A block of benchmark items ready for the search."""

    def __init__(self, rows: list[tuple], idf: np.ndarray, space: np.ndarray, share: float, cosine: float):
        bits = (len(idf) - 1).bit_length()
        self.kind = code_kind(bits)
        self.share, self.cosine, self.idf, self.space, self.mask = share, cosine, idf, space, code_kind(bits)(len(space) - 1)
        self.ids, self.words, self.weight, self.answer, self.reach, codes = [], [], [], [], [], []
        by_size: dict[int, list[int]] = {}
        for item, text in rows:
            question, answer = (words_of(x) for x in answer_of(text or ""))
            question, answer = (question, answer) if question else (answer, [])
            if not question:
                continue
            c = codes_of([b" ".join(question).decode("utf-8", "replace")], bits)[0]
            by_size.setdefault(window_size(len(question)), []).append(len(self.ids))
            self.ids.append(item)
            # an answer may stand before or after the question, with some words between
            self.reach.append(len(answer) + STEP if answer else 0)
            self.words.append(question)
            self.weight.append(idf[c].astype(np.float64) ** 2 + 1e-6)
            self.answer.append(set(answer))
            codes.append(c)
        self.codes = [c.tolist() for c in codes]
        self.energy = np.array([w.sum() for w in self.weight])
        self.by_size = {}
        for size, at in sorted(by_size.items()):
            #: The energy of words that an item of this size has; 0 for others.
            energy = np.zeros(len(idf))
            c = np.concatenate([codes[i] for i in at])
            energy[c] = idf[c].astype(np.float64) ** 2 + 1e-6
            self.by_size[size] = np.array(at), self._project(codes, at), energy

    def _project(self, codes: list[np.ndarray], at: list[int]) -> np.ndarray:
        z = np.array([(self.idf[codes[i], None] * self.space[codes[i] & self.mask]).sum(0) for i in at])
        return (z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-12)).astype(np.float32)

    def candidates(self, texts: list[np.ndarray], prune: bool = True) -> Iterator[tuple[int, int, float, int, int]]:
        """(place of the text, of the item, cosine, first and last word) of windows of coded texts that are near an item."""
        codes, length = np.concatenate([np.zeros(0, self.kind), *texts]), np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(length) - length
        if not len(codes):
            return
        for size, (items, vectors, energy) in self.by_size.items():
            mass = np.concatenate(([0.0], np.cumsum(energy[codes])))
            step = STEP // 2 if size == STEP else max(STEP, size // 64 * STEP)
            count = np.where(length > 0, np.maximum(1, -(-(length - size // 2) // step)), 0)
            text = np.repeat(np.arange(len(texts)), count)
            starts = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
            lo, hi = np.maximum(starts - step, 0), np.minimum(starts + size + step, length[text])
            weight = mass[begin[text] + hi] - mass[begin[text] + lo]
            if prune:
                fit = np.flatnonzero(weight >= self.share * self.energy[items].min() - 1e-3)
                text, starts, lo, hi, weight = text[fit], starts[fit], lo[fit], hi[fit], weight[fit]
            for a in range(0, len(starts), 128):
                part = slice(a, a + 128)
                at = starts[part, None] + np.arange(size)
                inside = at < length[text[part], None]
                ids = codes[np.where(inside, begin[text[part], None] + at, 0)]
                z = np.matmul(np.where(inside, self.idf[ids], 0)[:, None, :], self.space[ids & self.mask])[:, 0]
                z /= np.linalg.norm(z, axis=1, keepdims=True) + 1e-12
                cos = z @ vectors.T
                near = cos >= self.cosine
                if prune:
                    near &= weight[part, None] >= self.share * self.energy[items] - 1e-3
                for k, j in zip(*np.nonzero(near), strict=True):
                    yield int(text[a + k]), int(items[j]), float(cos[k, j]), int(lo[a + k]), int(hi[a + k])

    def search(self, texts: list[str | None], coded: list[np.ndarray]) -> list[dict[int, tuple[float, float, int]]]:
        """For each text its accepted items: place of the item, (cosine, share of its weight in common, first word)."""
        found: list[dict[int, tuple[float, float, int]]] = [{} for _ in texts]
        split: tuple[int, list[bytes]] = (-1, [])
        for t, i, cos, lo, hi in sorted(self.candidates(coded)):
            there = set(coded[t][lo:hi].tolist())
            if sum(w for c, w in zip(self.codes[i], self.weight[i], strict=True) if c in there) < self.share * self.energy[i]:
                continue
            if split[0] != t:
                split = t, words_of(texts[t] or "")
            here, own = split[1][lo:hi], self.words[i]
            if not self.answer[i] <= set(split[1][max(0, lo - self.reach[i]) : hi + self.reach[i]]):
                continue
            number = {w: k for k, w in enumerate(dict.fromkeys(own))}
            got = common_weight(np.array([number[w] for w in own]), np.array([number[w] for w in here if w in number]), self.weight[i]) / self.energy[i]
            if got >= self.share and (i not in found[t] or (got, cos) > (found[t][i][1], found[t][i][0])):
                found[t][i] = (cos, got, lo)
        return found


def _blocks(coded: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, share: float, cosine: float, block_items: int, bits: int, space_bits: int) -> Iterator:
    """Blocks of different (item, text) rows, each ready and sent to the tasks. Statistics and space come from all of ``coded``."""
    spark = coded.sparkSession
    rows = benchmark.select(F.col(item_col).alias("__item"), F.col(item_text_col).alias("__text")).where("__text is not null").distinct()
    blocks = max(1, math.ceil(rows.count() / block_items))
    idf = passage_idf(coded, bits)
    space = latent_space(coded, idf, space_bits)
    for k in range(blocks):
        # ids may repeat or be null; their texts differ
        block = rows.where(F.pmod(F.xxhash64("__item", "__text"), F.lit(blocks)) == k).collect()
        yield spark.sparkContext.broadcast(Items(sorted((tuple(r) for r in block), key=str), idf, space, share, cosine))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, cosine: float = COSINE, block_items: int = BLOCK_ITEMS, bits: int = BITS, space_bits: int = SPACE_BITS) -> DataFrame:
    """One row for each document and benchmark item found in it: both ids, ``cosine``, ``common_share``, ``first_word``.

    Whole documents are searched; null texts count as empty and never match, items without words match nothing. Repeated
    rows of ``docs`` give repeated results, those of ``benchmark`` count once. Other columns are not carried. Empty tables
    give an empty result. Statistics and the latent space come from all of ``docs``. A large vocabulary wants more bits of
    word codes and of buckets of the space; tasks and driver hold some hundred bytes for each bucket.
    """
    small_batches(docs.sparkSession)
    (own, own_ddl), (item, item_ddl) = field_of(docs, id_col, "__id"), field_of(benchmark, item_col, "__item")
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    coded = settled(source.mapInArrow(_coded(own.type, bits), f"{own_ddl}, __text string, codes binary"))
    schema = pa.schema([own, item, ("cosine", pa.float64()), ("common_share", pa.float64()), ("first_word", pa.int64())])
    ddl = f"{own_ddl}, {item_ddl}, cosine double, common_share double, first_word bigint"
    out = None
    for sent in _blocks(coded, benchmark, item_col, item_text_col, share, cosine, block_items, bits, space_bits):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for b in batches:
                found = items.search(b.column(1).to_pylist(), [np.frombuffer(c.as_buffer(), items.kind) for c in b.column(2)])
                hits = [(key, items.ids[i], *hit) for key, own in zip(b.column(0).to_pylist(), found, strict=True) for i, hit in own.items()]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*hits, strict=True), schema, strict=True)], schema=schema)

        part = coded.mapInArrow(run, ddl)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("__id").alias(id_col), F.col("__item").alias(item_col), "cosine", "common_share", "first_word")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", share: float = SHARE, cosine: float = COSINE, block_items: int = BLOCK_ITEMS, bits: int = BITS, space_bits: int = SPACE_BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item of ``benchmark`` is found; each row by its own text.

    Null and empty texts stay. Nothing is joined or shuffled but the statistics. Columns whose names begin with ``__`` are
    not carried.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*(c for c in docs.columns if not c.startswith("__")))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = [c.tobytes() for c in codes_of(b.column(b.schema.get_field_index(text_col)).to_pylist(), bits)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary())], names=[*b.schema.names, "__codes"])

    coded = settled(docs.mapInArrow(code, StructType([*docs.schema.fields, StructField("__codes", BinaryType())])))
    out, n = coded, len(docs.columns)
    for sent in _blocks(coded.select(F.col("__codes").alias("codes")), benchmark.withColumn("__none", F.lit(0)), "__none", item_text_col, share, cosine, block_items, bits, space_bits):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for b in batches:
                found = items.search(b.column(b.schema.get_field_index(text_col)).to_pylist(), [np.frombuffer(c.as_buffer(), items.kind) for c in b.column(n)])
                yield b.filter(pa.array([not x for x in found], pa.bool_()))

        out = out.mapInArrow(run, coded.schema)
    return out.select(*docs.columns)


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
