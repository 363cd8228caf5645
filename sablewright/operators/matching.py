"""Which of many phrases stand in which texts, in one pass over the texts for each block of phrases."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sablewright.shared import settled

try:
    import ahocorasick
except ImportError:  # texts are then compared with each phrase of a block, to the same result
    ahocorasick = None

#: Phrases of one automaton, on average.
BLOCK_PHRASES = 20_000


#: Hits that a task holds before it leaves out those that are not among the first of their phrase.
HELD_HITS = 200_000


def _first(hits: pa.Table, order: Sequence[tuple[str, str]], most: int) -> pa.Table:
    """The first ``most`` rows of each phrase. Nulls stand where Spark has them: first if ascending, last if descending."""
    keys, by = hits, [("phrase", "ascending")]
    for i, (c, way) in enumerate(order):
        keys = keys.append_column(f"__none{i}", hits[c].is_null().cast(pa.int8()))
        by += [(f"__none{i}", "descending" if way == "ascending" else "ascending"), (c, way)]
    hits = hits.take(pc.sort_indices(keys, sort_keys=by))
    phrase = hits["phrase"].combine_chunks().dictionary_encode().indices.to_numpy()
    start = np.flatnonzero(np.r_[True, phrase[1:] != phrase[:-1]])
    place = np.arange(len(phrase)) - np.repeat(start, np.diff(np.r_[start, len(phrase)]))
    return hits.filter(pa.array(place < most))


def _scan_first(phrases: list[str], text: str, order: Sequence[tuple[str, str]], most: int):
    """As ``_scan`` without the text, but of each phrase only the first ``most`` rows of a task leave it."""
    scan = _scan(phrases, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, least = [], 0, HELD_HITS
        for b in scan(batches):
            held.append(pa.Table.from_batches([b]).drop_columns([text]))
            n += b.num_rows
            if n >= least:
                held = [_first(pa.concat_tables(held), order, most)]
                n = held[0].num_rows
                least = max(HELD_HITS, 2 * n)
        if held:
            yield from _first(pa.concat_tables(held), order, most).to_batches(max_chunksize=10_000)

    return run


def _scan(phrases: list[str], text: str):
    """A ``mapInArrow`` function: every row once for each different phrase that its text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not phrases:
            return
        found = ahocorasick.Automaton()
        for p in phrases:
            found.add_word(p, p)
        found.make_automaton()
        for b in batches:
            rows, hits = [], []
            for i, t in enumerate(b.column(b.schema.get_field_index(text)).to_pylist()):
                here = {p for _, p in found.iter(t)} if t else ()
                rows += [i] * len(here)
                hits += here
            if rows:
                out = b.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(hits, pa.string())], names=[*out.schema.names, "phrase"])

    return run


def holding(texts: DataFrame, text: str, phrases: DataFrame, phrase: str = "phrase", block: int = BLOCK_PHRASES, first: tuple[int, Sequence[tuple[str, str]]] | None = None) -> DataFrame:
    """The rows of ``texts`` with each different phrase (a new column ``phrase``) that stands in their text, to the letter.

    An automaton of all phrases of a block reads a text once, however many phrases there are, and texts are never shuffled;
    phrases are a set of queries. Where they make several blocks, each block's hits are written before the next one comes, so
    that the driver never holds more than one. Null texts hold nothing, null and empty
    phrases stand in none. Where the automaton's package is missing, a join on ``contains`` gives the same rows.
    ``first`` (number, columns with ``ascending`` or ``descending``) is for callers that want so many rows of each phrase only: a task then
    gives no more of any phrase, and the text is dropped. The caller still takes the first ones of all tasks.
    """
    wanted = phrases.select(F.col(phrase).alias("phrase")).where("phrase <> ''").distinct()
    blocks = max(1, -(-wanted.count() // block))
    parts = []
    for k in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k)
        if ahocorasick is None:
            hits = texts.join(F.broadcast(part), F.contains(F.col(text), F.col("phrase")))
            parts.append(hits.drop(text) if first else hits)
        elif first:
            most, order = first
            kept = StructType([*(f for f in texts.schema.fields if f.name != text), StructField("phrase", StringType())])
            hits = texts.mapInArrow(_scan_first([r.phrase for r in part.collect()], text, order, most), kept)
            parts.append(hits if blocks == 1 else settled(hits))
        else:
            hits = texts.mapInArrow(_scan([r.phrase for r in part.collect()], text), StructType([*texts.schema.fields, StructField("phrase", StringType())]))
            parts.append(hits if blocks == 1 else settled(hits))
    return reduce(DataFrame.unionByName, parts)
