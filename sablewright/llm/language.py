"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's subwords are its byte n-grams with word borders, hashed into a table of small vectors; a text is the mean of
the vectors of all its words' subwords, and a linear softmax over it gives the languages. Both are trained by
stochastic gradient descent in numpy. As the model is linear, each word adds a fixed vector of class scores, so a text
of any length costs one look-up a word. A temperature, fitted on rows kept out of training, calibrates the
probabilities, and a threshold from the same rows marks predictions to reject.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewright.llm.common import by_batch, field_of, held, small_batches, table

BITS, DIM, GRAMS = 17, 16, (2, 3, 4)
#: Labelled rows that the fit uses at most; spans of words that a row trains as, and words of a span, at most.
FIT_ROWS, SPANS, SPAN_WORDS = 4_000, 4, 40
CACHE_WORDS = 200_000
_WORDS = re.compile(r"[^\W\d_]+").findall
UNDETERMINED = "und"


def subwords(word: str, bits: int = BITS) -> list[int]:
    """Table positions of the word itself and of its n-grams of UTF-8 bytes, borders included."""
    w = f"<{word}>".encode("utf-8", "replace")
    crc, mask = zlib.crc32, (1 << bits) - 1
    out = [crc(w) & mask]
    for k in GRAMS:
        out += [crc(w[i : i + k]) & mask for i in range(len(w) - k + 1)]
    return out


class LanguageModel:
    def __init__(self, labels: list[str], embed: np.ndarray, out: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float):
        self.labels, self.bias, self.temperature, self.reject_below = labels, bias, temperature, reject_below
        #: Class scores of each subword; the product of both layers.
        self.table = (embed @ out).astype(np.float32)
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.labels) + 1))

    def _learn(self, word: str) -> int:
        i = len(self.index)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        at = subwords(word)
        self.rows[i, :-1] = self.table[at].sum(0, dtype=np.float64)
        self.rows[i, -1] = len(at)
        self.index[word] = i
        return i

    def logits(self, text: str) -> np.ndarray | None:
        """Class scores of the mean embedding; None for a text without a letter."""
        count = Counter(_WORDS(text.lower()))
        if not any(c.isalpha() for w in count for c in w):
            return None
        if len(self.index) > CACHE_WORDS:
            self._empty()
        get, learn = self.index.get, self._learn
        ids = np.fromiter((i if (i := get(w)) is not None else learn(w) for w in count), np.int64, len(count))
        total = np.fromiter(count.values(), np.float64, len(count)) @ self.rows[ids]
        return total[:-1] / total[-1] + self.bias

    def predict(self, text: str) -> tuple[str, float, bool]:
        """The label, its calibrated probability and whether it should be rejected."""
        z = self.logits(text) if self.labels else None
        if z is None:
            return UNDETERMINED, 0.0, True
        p = softmax(z / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k]), bool(p[k] < self.reject_below)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def spans_of(text: str | None, seed: int = 5) -> list[str]:
    """Up to ``SPANS`` spans of a text's words, drawn from the whole text, so that short texts are learnt as well as long ones."""
    words = _WORDS((text or "").lower())
    if len(words) < 8:
        return [" ".join(words)] if words else []
    r = np.random.default_rng([seed, zlib.crc32(text.encode("utf-8", "replace"))])
    return [" ".join(words[a : a + int(r.integers(3, SPAN_WORDS))]) for a in r.integers(0, len(words) - 2, SPANS)]


def fit(rows: list[tuple[str, str]], **how) -> LanguageModel:
    """The model from (text, label) rows."""
    return fit_spans([(spans_of(t), y) for t, y in rows], **how)


def fit_spans(rows: list[tuple[list[str], str]], epochs: int = 6, rate: float = 0.5, seed: int = 5, precision: float = 0.99) -> LanguageModel:
    """The model from (spans, label) rows; a tenth is kept out of training for calibration and rejection."""
    rows = sorted(rows)
    labels = sorted({y for _, y in rows})
    if not labels:
        return LanguageModel([], np.zeros((1, DIM)), np.zeros((DIM, 0)), np.zeros(0), 1.0, 0.0)
    r = np.random.default_rng(seed)
    cache: dict[str, list[int]] = {}
    bags, ys, held = [], [], []
    for i, (spans, y) in enumerate(rows):
        for s in spans:
            at = np.array([h for w in s.split(" ") for h in (cache.get(w) or cache.setdefault(w, subwords(w)))], np.int32)
            bags.append(at)
            ys.append(labels.index(y))
            held.append(i % 10 == 0)
    embed = r.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    train = [i for i, h in enumerate(held) if not h]
    total, step = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in r.permutation(train):
            at, lr = bags[i], rate * (1 - step / total)
            x = embed[at].mean(0)
            g = softmax(x @ out + bias)
            g[ys[i]] -= 1
            back = (out @ g) * (lr / len(at))
            out -= lr * np.outer(x, g)
            bias -= lr * 0.1 * g
            # a subword that occurs several times is moved as often
            np.subtract.at(embed, at, np.broadcast_to(back * 8, (len(at), DIM)))
            step += 1
    z = np.array([embed[bags[i]].mean(0) @ out + bias for i, h in enumerate(held) if h]).reshape(-1, len(labels))
    y = np.array([ys[i] for i, h in enumerate(held) if h], int)
    temperature, reject = calibrate(z, y, precision)
    return LanguageModel(labels, embed, out, bias.astype(np.float64), temperature, reject)


def calibrate(z: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float]:
    """The temperature of least log loss, and the lowest probability from which on predictions are right often enough."""
    if not len(y):
        return 1.0, 0.0
    grid = np.geomspace(0.2, 5, 33)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(z / t)
    top, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-top, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= precision)
    return t, float(top[order][good[-1]]) if len(good) else 1.0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on at most ``max_rows`` rows with a label and text whose id's crc32 modulo 3 is not 1, chosen by a hash of id and text.

    Texts of any length take part; only the spans that they train as leave the tasks, so what the driver gathers has a bound.
    """
    small_batches(docs.sparkSession)
    crc = F.crc32(F.col("__id").cast("binary"))
    usable = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
    usable = usable.where(F.col("__lang").isNotNull() & F.col("__id").isNotNull() & (crc % 3 != 1))
    keep = max_rows / max(usable.count(), 1)
    usable = usable.where(F.col("__text").isNotNull())
    if keep < 1:
        # many rows may share an id, so the text counts too
        usable = usable.where(F.xxhash64("__id", "__text").bitwiseAND(F.lit((1 << 63) - 1)) < int(keep * (1 << 63)))
    schema = pa.schema([("h", pa.int64()), ("spans", pa.list_(pa.string())), ("lang", pa.string())])

    def make():
        return lambda cols: {"h": cols["h"], "spans": [spans_of(t) for t in cols["__text"]], "lang": cols["__lang"]}

    rows = usable.select(F.xxhash64("__id", "__text").alias("h"), "__text", "__lang").mapInArrow(by_batch(make, schema), "h long, spans array<string>, lang string")
    # repeats of one row share its hash, and may be more than the bound
    return fit_spans([(r.spans, r.lang) for r in rows.orderBy("h").limit(max_rows).collect()])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out``, ``lang_pred``, ``score`` and ``rejected``.

    A null text, or one without a letter, is ``und`` with score 0. The whole text counts. Repeated rows give repeated
    results; other columns are not carried. One narrow pass; no shuffle. The model's table has a fixed size.
    """
    small_batches(docs.sparkSession)
    own, ddl = field_of(docs, id_col, "__id")
    schema = pa.schema([own, pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("rejected", pa.bool_())])
    model._empty()
    key = zlib.crc32(model.table.tobytes() + model.bias.tobytes())
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = held(("language", key), lambda: sent.value).predict

        def run(cols):
            rows = [predict(t or "") for t in cols["__text"]]
            return {"__id": cols["__id"]} | {n: [r[i] for r in rows] for i, n in enumerate(("lang_pred", "score", "rejected"))}

        return run

    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(by_batch(make, schema), f"{ddl}, lang_pred string, score double, rejected boolean")
    kept_out = F.coalesce(F.crc32(F.col("__id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select(F.col("__id").alias(id_col), kept_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
