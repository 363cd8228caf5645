"""Exact removal of repeated byte strings across documents, by locally selected anchors and deep-shallow suffix sorting.

A byte is removed if it lies in a string of ``length`` bytes that also starts earlier. Sorting all suffixes of a corpus
is not needed for that: of each such window one anchor is selected, its least q-gram by hash, which depends on the
window alone. Equal windows have equal anchors at equal offsets, so only suffixes around anchors that repeat are
sorted.

1. Rows are sorted by id, those of one id (or none) by text, and numbered in that order; so every row is a document of its
   own, and earlier means a lesser number.
2. Every document gives one row for each anchor: the anchor's hash, a hash of the context (the bytes of all windows it
   was selected for) and the place. Copies within a task are settled there. Rows meet by anchor, sorted: a context that
   stood earlier is removed as a whole, and the first places of different contexts of one anchor go on. Contexts are taken
   for equal if 104 bits of hashes are (40 of the anchor, 64 of the context): among 10**13 contexts two unlike ones agree
   with a chance of about 10**-6.
3. These contexts meet by anchor as bytes. What is left of the anchor (reversed) and what follows it are sorted by
   multikey quicksort and blind tries; the prefixes that neighbours share tell, for each offset, which windows are equal.
   No hash decides here.
4. The ranges of each document are joined with its text.

Anchors with very many different contexts are split by content, so that no task gets them whole: in step 2 they are dealt
out by context; in step 3 the windows' offsets are halved, and each half meets by the longer string that all its windows
share, again and again while a group is too large. It is sorted as any other then. At the end of that stands one offset,
and a group is one window, of which all but the first place are later.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewright.llm.common import field_of, settled, small_batches, table
from sablewright.llm.suffixes import deep_shallow_sort
from sablewright.llm.words import _BYTE, _powers

LENGTH, GRAM = 100, 24
#: Different contexts of an anchor in one task from which on it is dealt out by context; contexts of a group that are sorted together at most.
HOT_IN_TASK, HOT = 256, 20_000
#: Rows of a batch of thin rows; rows that a task of step 1 holds for settling copies.
THIN_ROWS, HELD = 50_000, 400_000
_LOW = (1 << 24) - 1
_SETTLED, _DEALT, _MARK = 1 << 23, 1 << 22, 1 << 21


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of a document: its hash (40 bits), context hash, place, and first and last window that chose it."""
    n = len(data)
    none = np.zeros(0, np.uint64)
    if n < length:
        return none, none, none.astype(np.int64), none.astype(np.int64), none.astype(np.int64)
    b = np.frombuffer(data, np.uint8)
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[b] * power, out=total[1:])
    g = _mixed((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    windows = length - gram + 1
    # the leftmost least hash of each window; places count modulo a power of two, so documents of any length do
    out_lo, out_p = [], []
    piece = 1 << 20
    for at in range(0, n - length + 1, piece):
        end = min(at + piece, n - length + 1)
        v = (g[at : end + windows - 1] & np.uint64(2**64 - 1 - 0x3FFFFF)) | np.arange(end + windows - 1 - at, dtype=np.uint64)
        m, k = v, 1
        while k * 2 <= windows:
            m = np.minimum(m[:-k], m[k:])
            k *= 2
        if k < windows:
            m = np.minimum(m[: len(m) - (windows - k)], m[windows - k :])
        lo = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        out_lo.append(lo + at)
        out_p.append((m[lo] & np.uint64(0x3FFFFF)).astype(np.int64) + at)
    lo, p = np.concatenate(out_lo), np.concatenate(out_p)
    new = np.concatenate(([True], p[1:] != p[:-1]))
    lo, p = lo[new], p[new]
    hi = np.append(lo[1:], n - length + 1) - 1
    context = _mixed((total[hi + length] - total[lo]) * inverse[lo]) ^ _mixed(((p - lo) * 4096 + hi - lo).astype(np.uint64))
    return _mixed(g[p]) >> np.uint64(24), context, p, lo, hi


_PLACES = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("lo", pa.int64())])
_PLACES_DDL = "a long, c long, doc long, lo long"


def _places(length: int, gram: int, hot_in_task: int):
    """Rows (anchor and offsets, context, document, first window). The low bits of ``a`` hold offsets and marks."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        a, c, doc, lo = np.concatenate(held, axis=1)
        order = np.lexsort((lo, doc, c, a))
        a, c, doc, lo = (x[order] for x in (a, c, doc, lo))
        same = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
        first = np.concatenate(([True], ~same))
        at = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = (doc != doc[at]) | (lo != lo[at])
        anchor = a >> 24
        new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        group = np.cumsum(new) - 1
        dealt = np.bincount(group, first)[group] > hot_in_task
        mark = new & dealt
        out = np.where(later, a | _SETTLED, np.where(dealt, a | _DEALT, a))
        if mark.any():
            out, c, doc, lo = (np.concatenate(x) for x in ((out, (anchor[mark] << 24) | _MARK), (c, c[mark]), (doc, doc[mark]), (lo, lo[mark])))
        for k in range(0, len(out), THIN_ROWS):
            part = slice(k, k + THIN_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(x[part], pa.int64()) for x in (out, c, doc, lo)], schema=_PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        unpack = zstandard.ZstdDecompressor().decompress
        with np.errstate(over="ignore"):
            for b in batches:
                for key, z in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    a, c, p, lo, hi = anchors(unpack(z.as_py()), length, gram)
                    if len(a):
                        low = (a.astype(np.int64) << 24) | ((p - lo) << 8) | (hi - lo)
                        held.append(np.stack([low, c.view(np.int64), np.full(len(a), key, np.int64), lo]))
                        size += len(a)
                if size > HELD:
                    yield from flush(held)
                    held, size = [], 0
            yield from flush(held)

    return run


_RANGES = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("place", pa.int64()), ("anchor", pa.int64())])
_RANGES_DDL = "doc long, start long, end long, place long, anchor long"


def _meet(length: int):
    """From rows sorted by anchor, context, document and place: ranges to remove (no anchor), and first places to compare."""

    def settle(a, c, doc, lo) -> pa.RecordBatch:
        mark = (a & _MARK) != 0
        anchor = a >> 24
        new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        group = np.cumsum(new) - 1
        key = a & ~np.int64(_DEALT)
        first = new | np.concatenate(([True], (key[1:] != key[:-1]) | (c[1:] != c[:-1])))
        at = np.flatnonzero(first)[np.cumsum(first) - 1]
        known = (a & _SETTLED) != 0
        later = (known | (doc != doc[at]) | (lo != lo[at])) & ~mark
        several = (np.bincount(group, first & ~known) > 1) | (np.bincount(group, (a & (_DEALT | _MARK)) != 0) > 0)
        compare = first & several[group] & ~mark & ~known
        hi = lo + (a & 0xFF)
        take = later | compare
        place = lo + ((a >> 8) & 0xFF)
        out = doc, lo, np.where(later, hi + length, hi), place, anchor
        arrays = [pa.array(x[take], pa.int64()) for x in out[:3]]
        arrays += [pa.array(x[take], pa.int64(), mask=later[take]) for x in out[3:]]
        return pa.RecordBatch.from_arrays(arrays, schema=_RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            rows = np.stack([x.to_numpy() for x in b.columns])
            rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            # settled rows stand alone; the last anchor's rows wait for the next batch
            anchor = rows[0] >> 24
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            rest = rows[:, cut:]
            if cut:
                yield settle(*rows[:, :cut])
        if rest is not None and rest.shape[1]:
            yield settle(*rest)

    return run


#: A context in a group: the group, whose windows have anchors at offsets from ``lo`` to ``hi``, and the bytes from ``start`` to the end of the window at ``end``.
_CONTEXT = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("doc", pa.int64()), ("start", pa.int64()), ("place", pa.int64()), ("end", pa.int64()), ("bytes", pa.binary())])
_CONTEXT_DDL = "key long, lo int, hi int, doc long, start long, place long, end long, bytes binary"


def _rows(out: list[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(out), most):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[k : k + most], strict=True), schema, strict=True)], schema=schema)


def _contexts(length: int, gram: int):
    """The bytes of the contexts to compare, cut from their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for doc, z, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = unpack(z.as_py())
                out += [(x["anchor"], 0, length - gram, doc, x["start"], x["place"], x["end"], data[x["start"] : x["end"] + length]) for x in places]
            yield from _rows(out, _CONTEXT)

    return run


def _halved(length: int):
    """Contexts in two groups of half the offsets each, where they have windows there; a group shares what all its windows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, lo, hi, doc, start, place, end, context in zip(*(x.to_pylist() for x in b.columns), strict=True):
                middle = (lo + hi) // 2
                for x, y in ((lo, middle), (middle + 1, hi)):
                    if place - end <= y and place - start >= x:
                        core = context[place - x - start : place + length - y - start]
                        out.append((xxhash.xxh64_intdigest(core, x << 16 | y) - (1 << 63), x, y, doc, start, place, end, context))
            yield from _rows(out, _CONTEXT)

    return run


def _sorted_windows(length: int):
    """From contexts sorted by group, document and place: the ranges of windows that stand earlier."""
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, lo, hi, doc, start, place, end, context = zip(*rows, strict=True)
        n = len(rows)
        cls = {}
        for side in ("left", "right"):
            order, shared, k = [], [], 0
            while k < n:
                j = k
                while j < n and key[j] == key[k]:
                    j += 1
                cut = [context[i][: place[i] - start[i]][::-1] if side == "left" else context[i][place[i] - start[i] :] for i in range(k, j)]
                o, s = deep_shallow_sort(cut)
                order += [k + i for i in o]
                shared += [-1, *s[1:]]  # the first of a group shares nothing with the one before
                k = j
            cls[side] = np.array(order), np.array(shared)
        lo, hi, doc, start, place, end = (np.array(x, np.int64) for x in (lo, hi, doc, start, place, end))
        dup = np.zeros((n, length), bool)
        for offset in range(int(lo.min()), int(hi.max()) + 1):
            here = np.flatnonzero((place - offset >= start) & (place - offset <= end) & (lo <= offset) & (offset <= hi))
            if len(here) < 2:
                continue
            same = np.zeros(n, np.int64)
            for side, need in (("left", offset), ("right", length - offset)):
                order, shared = cls[side]
                of = np.empty(n, np.int64)
                of[order] = np.cumsum(shared < need)
                same = same * (n + 1) + of
            _, first, back = np.unique(same[here], return_index=True, return_inverse=True)
            lead = here[first][back]
            dup[here, offset] = (doc[here] != doc[lead]) | (place[here] != place[lead])
        if not dup.any():
            return
        # runs of neighbouring offsets are one range
        padded = np.zeros((n, length + 2), np.int8)
        padded[:, 1:-1] = dup
        edge = np.diff(padded, axis=1)
        i, a = np.nonzero(edge == 1)
        _, z = np.nonzero(edge == -1)
        yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(place[i] - z + 1), pa.array(place[i] - a + length)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if len(rows) >= 20_000 and row[0] != rows[-1][0]:
                    yield from compare(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from compare(rows)

    return run


def equal_windows(contexts: DataFrame, length: int, hot: int) -> DataFrame:
    """(``doc``, ``start``, ``end``) of the windows in ``contexts`` that stand earlier in their group.

    Groups of more than ``hot`` contexts are halved by offset first; each round doubles their rows at most, and there are as
    many rounds as the offsets can be halved.
    """
    found = None
    while True:
        large = settled(contexts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"))
        last = large.isEmpty()
        few = contexts if last else contexts.join(large, "key", "left_anti").select(*contexts.columns)
        part = few.repartition("key").sortWithinPartitions("key", "doc", "start").mapInArrow(_sorted_windows(length), "doc long, start long, end long")
        found = settled(part if found is None else found.unionByName(part))
        if last:
            return found
        many = contexts.join(large, "key", "left_semi").select(*contexts.columns)
        # one offset: the members of a group are places of one window
        whole = many.where("lo = hi").select(F.expr(f"substring(bytes, cast(place - lo - start as int) + 1, {length})").alias("window"), "doc", (F.col("place") - F.col("lo")).alias("start"))
        first = whole.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"))
        later = whole.join(first, "window").where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
        found = found.unionByName(later.select("doc", "start", (F.col("start") + length).alias("end")))
        contexts = settled(many.where("lo < hi").mapInArrow(_halved(length), _CONTEXT_DDL))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges as maximal runs, in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _packed(schema: pa.Schema):
    """Rows whose last column is the text, with the text packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            z = pa.array([pack((t.as_py() or "").encode("utf-8", "replace")) for t in b.columns[-1]], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], z], schema=schema)

    return run


def _numbered(schema: pa.Schema):
    """Rows in order get ascending numbers: the partition's and their own in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + b.num_rows), pa.int64()), *b.columns], schema=schema)
            at += b.num_rows

    return run


def _kept(own: pa.Field, with_text: bool):
    fields = [own, ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for key, z, ranges in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = unpack(z.as_py())
                runs = merged([(r["start"], r["end"]) for r in ranges or ()])
                parts, at = [], 0
                for a, e in runs:
                    parts.append(data[at:a])
                    at = e
                kept = b"".join([*parts, data[at:]])
                row = (key, len(data), sum(e - a for a, e in runs), len(runs), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_text else row)
            yield from _rows(out, schema, 100_000)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot_in_task: int = HOT_IN_TASK, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and ``kept`` bytes if asked.

    A null text counts as empty; texts shorter than ``length`` lose nothing. Earlier means a smaller id (null first), or
    the same row and an earlier start. Rows that share an id, or have none, are documents of their own: they follow each
    other by a hash of their texts, so of rows that repeat the first keeps what the others lose. Ids may be of any plain
    type. Other columns are not carried. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own, own_ddl = field_of(docs, id_col, "__id")
    # rows that repeat are told apart by their places in the input, so that many of them don't meet in one task
    source = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"), F.monotonically_increasing_id().alias("__n"), F.col(text_col).alias("__text"))
    packed = source.mapInArrow(_packed(pa.schema([own, ("__h", pa.int64()), ("__n", pa.int64()), ("z", pa.binary())])), f"{own_ddl}, __h long, __n long, z binary")
    order = [F.col("__id").asc_nulls_first(), F.col("__h"), F.col("__n")]
    packed = packed.repartitionByRange(*order).sortWithinPartitions(*order).select("__id", "z")
    packed = settled(packed.mapInArrow(_numbered(pa.schema([("doc", pa.int64()), own, ("z", pa.binary())])), f"doc long, {own_ddl}, z binary"))

    places = packed.select("doc", "z").mapInArrow(_places(length, gram, hot_in_task), _PLACES_DDL)
    low = F.col("a").bitwiseAND(F.lit(_SETTLED | _DEALT))
    dealt = places.withColumn("k", F.when(low == 0, F.shiftright("a", 24)).otherwise(F.xxhash64("a", "c", "doc"))).repartition("k").drop("k")
    met = settled(dealt.sortWithinPartitions(F.shiftright("a", 24), F.col("a").bitwiseAND(F.lit(~_DEALT)), "c", "doc", "lo").mapInArrow(_meet(length), _RANGES_DDL))

    known = met.where("anchor is null").select("doc", "start", "end")
    # what a document gathers here is bounded by its own length
    contexts = met.where("anchor is not null").groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "place", "end")).alias("places"))
    cut = packed.join(contexts, "doc").select("doc", "z", "places")
    cut = settled(cut.mapInArrow(_contexts(length, gram), _CONTEXT_DDL))
    found = equal_windows(cut, length, hot)

    ranges = known.unionByName(found).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    joined = packed.join(ranges, "doc", "left").select("__id", "z", "ranges")
    out = joined.mapInArrow(_kept(own, with_text), f"{own_ddl}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    return out.withColumnRenamed("__id", id_col)


def op2_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
