"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the words, their beginnings (compounds keep their head), pairs of neighbours and pairs with one
or two words between, all hashed into one table; each counts once a text. Learning rates are per coordinate, and the L1
term leaves few weights that are not zero: these alone are sent to the tasks.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from sablewright.llm.common import by_batch, field_of, held, small_batches, table

#: Hash bits; labelled rows that the fit uses at most.
BITS, FIT_ROWS = 20, 6_000
HEADS = (4, 5, 6, 7, 8)
CACHE_WORDS = 100_000
_WORDS = re.compile(r"\w+").findall


class Features:
    """Hashed features of a text, with a bounded memory of the hashes of words."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint32(2**bits - 1)
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.hashes = np.zeros((1024, 1 + len(HEADS)), np.uint32)

    def _learn(self, word: str) -> int:
        i = len(self.index)
        if i == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        h = zlib.crc32(word.encode("utf-8", "replace"))
        # a word that is no longer than a head repeats its own hash, which counts once
        self.hashes[i] = [h, *(zlib.crc32(f"{word[:k]}*".encode("utf-8", "replace")) if len(word) > k else h for k in HEADS)]
        self.index[word] = i
        return i

    def __call__(self, text: str) -> np.ndarray:
        """Table positions of all features, repeats included."""
        words = _WORDS(text.lower())
        if len(self.index) > CACHE_WORDS:
            self._empty()
        get, learn = self.index.get, self._learn
        ids = np.fromiter((i if (i := get(w)) is not None else learn(w) for w in words), np.int64, len(words))
        own = self.hashes[ids]
        h = own[:, 0]
        with np.errstate(over="ignore"):
            pairs = [
                ((h[:-k] * np.uint32(0x9E3779B1) + np.uint32(k)) ^ (h[k:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D) >> np.uint32(3) for k in (1, 2, 3) if len(h) > k
            ]
        return (np.concatenate([own.ravel(), *pairs]) & self.mask).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates: z and n are kept, weights follow from them."""

    def __init__(self, bits: int = BITS, alpha: float = 0.6, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**bits), np.zeros(2**bits)
        self.bias, self.bias_n = 0.0, 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, y: float, weight: float = 1.0) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -35, 35)))
        g = weight * (p - y)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g
        self.bias_n += g * g
        self.bias -= self.alpha * g / (self.beta + np.sqrt(self.bias_n))
        return p

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Positions and values of the weights that are not zero, and the bias."""
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at].astype(np.float32), float(self.bias)


#: The least share of toxic rows among those at or above the raw score that counts as the border.
LEAST_PRECISION = 0.5


def best_shift(z: np.ndarray, y: np.ndarray) -> float | None:
    """The raw score that separates two classes with the best F1; of equally good ones the middle of the widest gap.

    None if a class is missing or no border has the least precision: the scores tell nothing then.
    """
    if not y.any() or y.all():
        return None
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    cut = np.append(z[:-1] != z[1:], True) & (hits >= LEAST_PRECISION * np.arange(1, len(y) + 1)) & (np.arange(1, len(y) + 1) < len(y))
    if not cut.any():
        return None
    after = np.append(z[1:], z[-1] - 2)
    best = np.flatnonzero(cut & (f1 >= f1[cut].max() - 1e-12))
    k = max(best, key=lambda i: z[i] - after[i])
    return float((z[k] + after[k]) / 2)


def fit_features(found: list[tuple[np.ndarray, int]], epochs: int = 3, seed: int = 11, folds: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from (sorted table positions, label) rows; the order of the rows does not matter, they are sorted and then shuffled.

    As few texts are toxic, the raw score that separates the classes best lies below 0. It is found on scores that models
    trained without a fold of the rows give to that fold; the bias is shifted so that a probability of 0.5 stands there.
    Rows of one class alone, too few rows, or none, teach nothing: all texts then score the same, below 0.5, so that nothing
    is rejected.
    """
    found = sorted(found, key=lambda x: (x[0].tobytes(), x[1]))
    y = np.array([y > 0 for _, y in found], int)
    r = np.random.default_rng(seed)
    order = r.permutation(len(found))
    prior = min((y.sum() + 1) / (len(y) + 4), 0.25)
    nothing = np.zeros(0, np.int32), np.zeros(0, np.float32), math.log(prior / (1 - prior))
    if not 0 < y.sum() < len(y):
        return nothing

    def learnt(rows: np.ndarray) -> Ftrl:
        model = Ftrl()
        for _ in range(epochs):
            for i in r.permutation(rows):
                model.learn(found[i][0], y[i])
        return model

    z = np.zeros(len(found))
    for k in range(folds):
        model = learnt(order[np.arange(len(order)) % folds != k])
        for i in order[k::folds]:
            z[i] = model.bias + model.weights(found[i][0]).sum()
    shift = best_shift(z, y)
    if shift is None:
        return nothing
    at, w, bias = learnt(order).compact()
    return at, w, bias - shift


def fit(rows: list[tuple[str, int]], epochs: int = 3, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from (text, label) rows."""
    f = Features()
    return fit_features([(positions(f, t), int(y)) for t, y in rows], epochs, seed)


def positions(features: Features, text: str | None) -> np.ndarray:
    """The different table positions of a text's features, in order."""
    return np.unique(features(text or "")).astype(np.int32)


class Scorer:
    def __init__(self, compact: tuple[np.ndarray, np.ndarray, float], bits: int = BITS):
        at, w, self.bias = compact
        self.w = np.zeros(2**bits, np.float32)
        self.w[at] = w
        self.features = Features(bits)

    def score(self, text: str) -> float:
        at = self.features(text)
        z = self.bias + float(self.w[np.unique(at[self.w[at] != 0])].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _scorer(compact):
    """The scoring function of the worker's model; made once in each Python process."""
    key = compact[0].tobytes() + compact[1].tobytes() + np.float64(compact[2]).tobytes()
    return held(("toxicity", key), lambda: Scorer(compact)).score


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = FIT_ROWS):
    """Fit on at most ``max_rows`` labelled documents, chosen by a hash of the id; rows with a null label or id are not used.

    Whole texts of any length take part: their features leave the tasks, at most as many as the table has places, so what
    the driver gathers has a bound. The chosen ids are bounded, so their broadcast is. A document id with several labels
    takes its highest; rows that share an id or repeat count towards the bound each for itself.
    """
    small_batches(docs.sparkSession)
    crc = lambda c: F.crc32(c.cast("string").cast("binary"))
    usable = labels.select(F.col(id_col).cast("string").alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isNotNull() & (crc(F.col("__id")) % 5 != 0))
    keep = max_rows / max(usable.count(), 1)
    chance = F.xxhash64("__id").bitwiseAND(F.lit((1 << 63) - 1))
    if keep < 1:
        usable = usable.where(chance < int(keep * (1 << 63)))
    usable = usable.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(chance, "__id").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text"))
    rows = texts.join(F.broadcast(usable), "__id").select("__id", "__text", "__y")
    rows = rows.orderBy(F.xxhash64("__id", "__text"), "__id").limit(max_rows)
    schema = pa.schema([("at", pa.binary()), ("y", pa.int64())])

    def make():
        f = Features()
        return lambda cols: {"at": [zlib.compress(np.diff(positions(f, t), prepend=np.int32(0)).tobytes(), 1) for t in cols["__text"]], "y": cols["__y"]}

    found = rows.mapInArrow(by_batch(make, schema), "at binary, y long").collect()
    return fit_features([(np.cumsum(np.frombuffer(zlib.decompress(x.at), np.int32), dtype=np.int32), int(x.y > 0)) for x in found])


def score_texts(docs: DataFrame, compact, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out``, ``score`` and ``predicted``.

    A null text counts as empty; empty texts get the score of the bias. Whole texts are scored. Repeated rows give
    repeated results; other columns are not carried. One narrow pass; no shuffle.
    """
    small_batches(docs.sparkSession)
    own, ddl = field_of(docs, id_col, "__id")
    schema = pa.schema([own, pa.field("score", pa.float64())])

    def make():
        score = _scorer(compact)
        return lambda cols: {"__id": cols["__id"], "score": [score(t or "") for t in cols["__text"]]}

    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(by_batch(make, schema), f"{ddl}, score double")
    kept_out = F.coalesce(F.crc32(F.col("__id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(F.col("__id").alias(id_col), kept_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def rejected_rows(docs: DataFrame, compact, text_col: str = "text", flag: str = "rejected") -> DataFrame:
    """``docs`` with all its columns and ``flag``: whether the text scores 0.5 or more. A column of that name is replaced.

    Rows keep their own decision even if ids repeat or are null; no shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(flag)

    def run(batches):
        score = _scorer(compact)
        for b in batches:
            out = [score(t or "") >= 0.5 for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*b.schema.names, flag])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(flag, BooleanType())]))


def accepted_rows(docs: DataFrame, compact, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below 0.5. No shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        score = _scorer(compact)
        for b in batches:
            yield b.filter(pa.array([score(t or "") < 0.5 for t in b.column(b.schema.get_field_index(text_col)).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
