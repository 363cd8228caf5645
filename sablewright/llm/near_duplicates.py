"""N-gram Jaccard join by MinHash banding.

Texts become sets of hashed word n-grams; equal sets collapse into one representative. Signatures are cut into bands; the
numbers of bands and of rows follow from the wanted recall at the threshold. Representatives that share a band hash are
candidates and are compared on their full n-gram sets:

* The members of a bucket of up to ``FEW`` representatives make pairs, which sizes prune. Every representative meets its
  partners one after another, so that the work is linear in the number of candidate pairs.
* Larger buckets hold dense groups. Their members are tied to the least one, and the components of these ties are compared
  in blocks of bounded size, so that no task holds a whole group and no row is made for each pair.

Both return the number of links of each representative and enough links to connect it; both are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from sablewright.llm.common import settled, small_batches, table
from sablewright.llm.components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999999
#: Hash functions of a signature at most.
HASHES = 448
#: Representatives in a bucket up to which they make pairs; n-grams and sets in a block of a larger group, about; a task holds two blocks.
FEW, BLOCK_GRAMS, BLOCK_SETS = 8, 250_000, 500
CACHE_WORDS = 300_000


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of ``rows`` rows at which a pair at the threshold collides with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """The most rows, and the bands that they need for the recall, that so many hash functions allow.

    More rows tell unlike texts apart better; they need more bands to find the alike ones.
    """
    rows = 1
    while rows < 64 and bands_for(threshold, recall, rows + 1) * (rows + 1) <= hashes:
        rows += 1
    return bands_for(threshold, recall, rows), rows


class Shingler:
    """Texts to sorted sets of 64-bit n-gram hashes, with a bounded memory of the hashes of words."""

    def __init__(self, n: int = WORDS):
        self.n, self.known = n, {}
        self.factor = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) ** 3 & (2**64 - 1) | 1) for k in range(n)]

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        h = mixed(h)
        # a text with fewer words than an n-gram is one n-gram of all its words
        n = min(self.n, len(h))
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * self.factor[k]
        total = mixed(total ^ np.uint64(n))
        total.sort()
        return total[np.concatenate(([True], total[1:] != total[:-1]))]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 3):
        r = np.random.default_rng(seed)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.xor = r.integers(0, 2**32, (k, 1), np.uint32)
        self.factor = r.integers(0, 2**31, (k, 1), np.uint32) * np.uint32(2) + np.uint32(1)
        self.band = r.integers(1, 2**62, rows, np.int64).astype(np.uint64) | np.uint64(1)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band, different between bands."""
        x = (grams >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.xor), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 512):  # within the processor's cache
            part = (x[at : at + 512] ^ self.xor) * self.factor
            np.minimum(low, part.min(1), out=low)
        low = low.reshape(self.bands, self.rows).astype(np.uint64)
        return mixed((mixed(low + np.uint64(1)) * self.band).sum(1, dtype=np.uint64) + mixed(np.arange(self.bands, dtype=np.uint64))).astype(np.int64)


def _signatures(bands: int, rows: int, n: int):
    schema = pa.schema([("__id", pa.int64()), ("grams_key", pa.binary()), ("n_grams", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(n), MinHash(bands, rows)
        with np.errstate(over="ignore"):
            for b in batches:
                ids, keys, sizes, hashes = b.column(0), [], [], []
                for t in b.column(1):
                    g = shingle(t.as_py() or "")
                    sizes.append(len(g))
                    keys.append(hashlib.md5(g.tobytes()).digest() if len(g) else None)
                    hashes.append(sign(g) if len(g) else [])
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], schema=schema)

    return run


def _linked(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets of ``a`` and ``b`` (``a`` itself if None) have at least this Jaccard similarity, as a matrix."""
    other = a if b is None else b
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in other])
    if len(a) * len(other) <= 4:
        common = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in other] for x in a])
    else:
        sets = a if b is None else a + b
        # only n-grams that several sets have matter; their columns are taken in slices
        all_grams = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
        order = np.argsort(all_grams, kind="stable")
        all_grams, owner = all_grams[order], owner[order]
        new = np.concatenate(([True], all_grams[1:] != all_grams[:-1]))
        column = np.cumsum(new) - 1
        often = np.bincount(column)[column] > 1
        owner, column = owner[often], np.cumsum(new[often]) - 1 if often.any() else column[:0]
        common = np.zeros((len(a), len(other)), np.float32)
        width = max(64, 4_000_000 // len(sets))
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, (at, at + width))
            has = np.zeros((len(sets), min(width, int(column[-1]) + 1 - at)), np.float32)
            has[owner[lo:hi], column[lo:hi] - at] = 1
            common += has[: len(a)] @ (has.T if b is None else has[len(a) :].T)
    # common / union >= threshold, without a division; counts are exact in single precision, products are not
    return common.astype(np.float64) * (1 + threshold) >= threshold * (na[:, None] + nb[None, :]) - 1e-6


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect the same nodes as a symmetric matrix of links; fewer than nodes."""
    n, out = len(links), []
    left = np.ones(n, bool)
    for s in range(n):
        if left[s]:
            left[s] = False
            front = [s]
            while front:
                i = front.pop()
                for j in np.flatnonzero(links[i] & left):
                    left[j] = False
                    out.append((i, int(j)))
                    front.append(int(j))
    return out


def _compare(threshold: float):
    """Rows arrive sorted by block pair; each pair of blocks is compared when its rows are complete."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def flush(rows: dict[int, tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
        """(a, b, 0) for links that connect, and (a, null, count) for numbers of linked rows."""
        ids = sorted(rows)
        left = [i for i in ids if rows[i][0] == 0]
        right = [i for i in ids if rows[i][0] == 1]
        if not left or (len(left) < 2 and not right):
            return []
        sets = lambda x: [rows[i][2] for i in x]
        weight = lambda x: np.array([rows[i][1] for i in x], np.int64)
        out = []
        if right:
            m = _linked(sets(left), sets(right), threshold)
            square = np.zeros((len(ids),) * 2, bool)
            square[: len(left), len(left) :] = m
            square |= square.T
            counts = zip(left + right, np.concatenate([m @ weight(right), m.T @ weight(left)]), strict=True)
            names = left + right
        else:
            m = _linked(sets(left), None, threshold)
            np.fill_diagonal(m, False)
            square, counts, names = m, zip(left, m @ weight(left), strict=True), left
        out += [(i, None, int(c)) for i, c in counts if c]
        out += [(names[i], names[j], 0) for i, j in _forest(square)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for b in batches:
            out = []
            for this, ident, side, copies, grams in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if this != key:
                    out += flush(rows)
                    key, rows = this, {}
                rows.setdefault(ident, (side, copies, np.frombuffer(grams, np.uint64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
        if out := flush(rows):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    return run


def _meeting(threshold: float):
    """Rows arrive sorted by key, the key's own set first; each set after it is compared with that one alone."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out = []
            for side, node, copies, grams in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                g = np.frombuffer(grams, np.uint64)
                if side == 0:
                    own = node, copies, g
                    continue
                a, n, x = own
                common = int((x[np.minimum(np.searchsorted(x, g), len(x) - 1)] == g).sum())
                if common * (1 + threshold) >= threshold * (len(x) + len(g)) - 1e-6:
                    out += [(a, node, 0), (a, None, copies), (node, None, n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    return run


def _gram_bytes(n: int):
    schema = pa.schema([("__id", pa.int64()), ("grams_key", pa.binary()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        with np.errstate(over="ignore"):
            for b in batches:
                grams = [shingle(t.as_py() or "").tobytes() for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.md5(g).digest() for g in grams], pa.binary()), pa.array(grams, pa.binary())], schema=schema)

    return run


def _signed(source: DataFrame, n: int, threshold: float, recall: float, hashes: int) -> DataFrame:
    bands, rows = bands_and_rows(threshold, recall, hashes)
    return settled(source.mapInArrow(_signatures(bands, rows, n), "__id long, grams_key binary, n_grams int, bands array<long>"))


def _classes(source: DataFrame, signed: DataFrame, n: int, threshold: float, few: int, block_grams: int, block_sets: int) -> DataFrame:
    """For each set: ``grams_key``, ``class_id``, ``n_links``, and whether it is the one that stands for its class (``lead``)."""
    sets = signed.where("grams_key is not null and __id is not null").groupBy("grams_key").agg(F.min("__id").alias("rep"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"))
    # several sets may have the same least id, so sets get numbers of their own; written, they stay
    sets = settled(sets.withColumn("node", F.monotonically_increasing_id()))

    # buckets: representatives that share the hash of a band
    reps = signed.select("grams_key", "bands", F.col("__id").alias("rep")).join(sets.select("grams_key", "rep", "node", "n_grams"), ["grams_key", "rep"]).dropDuplicates(["grams_key"])
    spread = settled(reps.select("node", "n_grams", F.explode("bands").alias("bucket")))
    buckets = spread.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("members")).where("members > 1")
    shared = settled(spread.join(buckets, "bucket"))
    tied = shared.where(F.col("members") > few).select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    groups = settled(components(tied))
    # pairs of small buckets; sets whose sizes differ too much can't be alike
    small = shared.where(F.col("members") <= few).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "n_grams"))).alias("m"))
    small = small.select(F.posexplode("m").alias("k", "x"), "m").select("x", F.explode(F.expr("slice(m, k + 2, size(m))")).alias("y"))
    alike = F.least("x.n_grams", "y.n_grams") >= F.greatest("x.n_grams", "y.n_grams") * threshold - 1e-6
    close = small.where(alike).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    # pairs within one group are compared there
    close = close.join(groups.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(groups.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    close = settled(close.where("ra is null or rb is null or ra <> rb").select("a", "b"))

    # the n-gram sets of candidates, made once
    needed = groups.select("node").union(close.select("a")).union(close.select("b")).distinct()
    needed = settled(sets.join(needed, "node", "left_semi"))
    grams = source.join(needed.select(F.col("rep").alias("__id")).distinct(), "__id", "left_semi").mapInArrow(_gram_bytes(n), "__id long, grams_key binary, grams binary")
    grams = grams.join(needed, "grams_key").where("__id = rep").dropDuplicates(["grams_key"])
    grams = settled(grams.select("node", "copies", "n_grams", "grams"))

    cut = groups.join(needed.select("node", "n_grams"), "node").groupBy("root").agg(F.ceil(F.greatest(F.sum("n_grams") / F.lit(block_grams), F.count("*") / F.lit(block_sets))).cast("int").alias("blocks"))
    member = groups.join(cut, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(grams, "node")
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    pairs = member.select(F.concat_ws("/", "root", lo, hi).alias("key"), "node", (F.col("block") > lo).cast("int").alias("side"), "copies", "grams")
    found = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(threshold), "a long, b long, links long")

    own = close.select(F.col("a").alias("key"), F.lit(0).alias("side"), F.col("a").alias("node")).distinct()
    meet = own.unionByName(close.select(F.col("a").alias("key"), F.lit(1).alias("side"), F.col("b").alias("node"))).join(grams, "node")
    meet = meet.select("key", "side", "node", "copies", "grams").repartition("key").sortWithinPartitions("key", "side", "node")
    found = settled(found.unionByName(meet.mapInArrow(_meeting(threshold), "a long, b long, links long")))

    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    roots = settled(components(found.where("b is not null").select("a", "b")).join(sets.select("node", "rep"), "node"))
    leads = roots.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("first"))
    roots = roots.join(leads, "root").select("node", F.col("first.rep").alias("class_id"), (F.col("first.node") == F.col("node")).alias("lead"))
    classes = sets.join(roots, "node", "left").join(counts, "node", "left")
    n_links = (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    return classes.select("grams_key", F.coalesce("class_id", "rep").alias("class_id"), n_links, F.coalesce("lead", F.lit(True)).alias("lead"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, few: int = FEW, block_grams: int = BLOCK_GRAMS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per row of ``docs``: the id, ``class_id`` (least id of its class), ``n_links`` and ``n_grams``.

    ``n_links`` counts the other rows whose n-gram sets have at least the threshold's similarity, copies included; links
    join rows into classes. A text without words (null, empty) links to nothing and is its own class; a text of fewer
    than ``n`` words is one n-gram. Rows are told apart by id and set, so rows that share an id link each for itself; rows
    that repeat both count as copies. A null id forms no link and has a null class. Other columns are not carried. An
    empty table gives an empty result. n-grams are compared by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    signed = _signed(source, n, threshold, recall, hashes)
    classes = _classes(source, signed, n, threshold, few, block_grams, block_sets)
    out = signed.select("__id", "grams_key", "n_grams").join(classes, "grams_key", "left")
    null_id = F.col("__id").isNull()
    return out.select(
        F.col("__id").alias(id_col),
        F.when(~null_id, F.coalesce("class_id", "__id")).alias("class_id"),
        F.when(null_id, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.col("n_grams").cast("long").alias("n_grams"),
    )


def _keyed(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """``docs`` with ``__key``: the hash of the row's set, or of its text if that has no word; and ``__words``: whether it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        with np.errstate(over="ignore"):
            for b in batches:
                texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                grams = [shingle(t).tobytes() for t in texts]
                keys = [hashlib.md5(g or t.encode("utf-8", "replace")).digest() for g, t in zip(grams, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary()), pa.array(list(map(bool, grams)), pa.bool_())], names=[*b.schema.names, "__key", "__words"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__key", BinaryType()), StructField("__words", BooleanType())]))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which each class of near duplicates keeps the one with the least id.

    Rows that share an id are judged each by its own text; of rows that repeat id and set (for texts without words: id and
    text) one stays. Rows with a null id, which belong to no class, all stay. The ids are whole numbers.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    signed = _signed(source, n, threshold, recall, HASHES)
    classes = _classes(source, signed, n, threshold, FEW, BLOCK_GRAMS, BLOCK_SETS)
    stays = F.col("grams_key").isNull() | (F.col("lead") & (F.col("__id") == F.col("class_id")))
    rows = settled(signed.where("__id is not null").select("__id", "grams_key").join(classes, "grams_key", "left").select("__id", "grams_key", stays.alias("stays")))
    ids = rows.groupBy("__id").agg(F.count("*").alias("n"), F.max("stays").alias("stays")).where("n > 1 or not stays")
    ids = settled(ids.select(F.col("__id").alias(id_col), (F.col("n") > 1).alias("several")))
    kept = docs.join(ids, id_col, "left_anti")
    again = ids.where("several").select(id_col)
    if again.isEmpty():
        return kept.select(*docs.columns)
    # rows that share an id: by their own sets
    again = _keyed(docs.join(again, id_col, "left_semi").select(*docs.columns), text_col, n)
    good = rows.where("stays and grams_key is not null").select(F.col("__id").alias(id_col), F.col("grams_key").alias("__key"), F.lit(True).alias("__good")).distinct()
    again = again.join(good, [id_col, "__key"], "left").where("__good or not __words").dropDuplicates([id_col, "__key"])
    return kept.select(*docs.columns).unionByName(again.select(*docs.columns))


def op10_minhash_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
