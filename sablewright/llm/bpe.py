"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of bytes exactly one token can be the last token of that prefix's BPE encoding. Storing
that token for each prefix gives the encoding (walk back from the end), allows exact appends (the table only grows)
and re-encoding near edits (the table before the edit still holds). A token ``t`` may follow the last token ``p``
of the prefix before it if BPE, run on the bytes of ``p`` and ``t`` together, would leave their border alone.

Texts are first split by the tokenizer's pattern; each match is encoded separately.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewright.llm.common import by_batch, field_of, held, small_batches

#: Pieces whose ids, and pairs of tokens whose borders, a worker keeps; beyond it the memory is emptied, which changes no result.
CACHE_PIECES, CACHE_PAIRS = 400_000, 200_000
_WHITE = r"\t-\r \x85\xa0"
_LATIN_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_LATIN_N = "0-9²³¹¼½¾"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixTable:
    """The last token of every prefix of one piece; grows by ``append`` and is cut by ``edit``."""

    __slots__ = ("bpe", "data", "last")

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Extend the piece; the entries of the earlier prefixes stay as they are."""
        begin = len(self.data)
        self.data += more
        self.bpe._fill(self.data, self.last, begin)
        return self

    def edit(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Replace ``data[start:end]``. Entries up to ``start`` are kept; later ones are computed until they agree with the old ones.

        An entry follows from as many bytes and entries before it as the longest token has, so that after an agreement of that
        length all the rest would agree, and is taken over.
        """
        tail, old, reach = self.data[end:], self.last[end:], self.bpe.longest
        self.data = self.data[:start]
        del self.last[start:]
        self.append(new)
        begin = len(self.data)
        self.data += tail
        for at in range(0, len(tail), reach):
            if at and self.last[-reach:] == old[at - reach : at] and len(self.last) >= reach:
                self.last += old[at:]
                break
            self.bpe._fill(self.data, self.last, begin + at, begin + min(at + reach, len(tail)))
        return self

    def ids(self) -> list[int]:
        out, end, size = [], len(self.data), self.bpe.size
        while end:
            t = self.last[end - 1]
            out.append(t)
            end -= size[t]
        out.reverse()
        return out


class PrefixBpe:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.size = [len(t) for t in self.token]
        self.longest = max(self.size)
        #: Each end of a token: its rank where it is a token itself, else -1.
        self.ends = dict.fromkeys((t[i:] for t in ranks for i in range(len(t))), -1) | ranks
        self.split = [(r, r) for r in range(len(self.token))]
        self.pair: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        for r, t in enumerate(self.token):  # by rank, so the splits of lower tokens are known
            if len(t) > 1:
                self._learn(r, t)
        self._fits.clear()  # answers given while pairs were still unknown may be too generous

    def _learn(self, r: int, t: bytes) -> None:
        for k in range(1, len(t)):
            a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
            if a is not None and b is not None and a < r and b < r and self._border(a, b):
                self.split[r] = (a, b)
                self.pair[(a, b)] = r
                return

    def _border(self, a: int, b: int) -> bool:
        """Whether BPE over the bytes of ``a`` and ``b`` leaves the border between them alone.

        The merges that made ``a`` and ``b`` are undone from the last on; at each time the two tokens that then
        touch the border must not be a pair that BPE would have merged before the merge just undone.
        """
        pair, split, limit = self.pair, self.split, 1 << 60
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if a > b:
                undone, (_, inner) = a, split[a]
                if inner != undone:
                    limit, a = undone, inner
                    continue
                limit, (outer, _) = b + 1, split[b]
                if outer == b:
                    return True
                b = outer
            else:
                undone, (outer, _) = b, split[b]
                if outer != undone:
                    limit, b = undone + 1, outer
                    continue
                limit, (_, inner) = a, split[a]
                if inner == a:
                    return True
                a = inner

    def _fill(self, data: bytes, last: list[int], begin: int, stop: int | None = None) -> None:
        ends, fits, size, split = self.ends.get, self._fits, self.size, self.split
        known = fits.get
        for end in range(begin + 1, (len(data) if stop is None else stop) + 1):
            start = end - 1
            while True:
                t = ends(data[start:end])
                if t is None:
                    raise ValueError(f"the ranks can't encode byte {end - 1} of a piece")
                if t >= 0:
                    if not start:
                        # a token that is the whole prefix is valid if it is its own encoding
                        if split[t][0] != t or size[t] == 1:
                            last.append(t)
                            break
                    else:
                        key = (last[start - 1], t)
                        ok = known(key)
                        if ok is None:
                            if len(fits) > CACHE_PAIRS:
                                fits.clear()
                            ok = fits[key] = self._border(*key)
                        if ok:
                            last.append(t)
                            break
                if not start:
                    raise ValueError(f"the ranks can't encode byte {end - 1} of a piece")
                start -= 1

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else PrefixTable(self, data).ids()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class TextCodec:
    """Texts to ids and back, with the splits of the tokenizer's pattern and a bounded memory of pieces."""

    def __init__(self, bpe: PrefixBpe, pattern: str):
        import re

        self.bpe = bpe
        white = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.any = regex.compile(white)
        latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_WHITE}{_LATIN_L}{_LATIN_N}]").replace(r"\p{L}", f"[{_LATIN_L}]").replace(r"\p{N}", f"[{_LATIN_N}]")
        latin = latin.replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")
        #: A pattern with other classes than the usual ones has no short cut for Latin-1 texts.
        self.latin = re.compile(latin) if r"\p" not in latin else None
        self.known: dict[str, tuple[int, ...]] = {}

    def _pattern(self, text: str):
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return self.latin
            except UnicodeEncodeError:
                pass
        return self.any

    def split(self, text: str) -> list[str]:
        return self._pattern(text).findall(text)

    def split_from(self, text: str, at: int):
        """The pieces from a place on, one after another."""
        return (m[0] for m in self._pattern(text).finditer(text, at))

    def encode(self, text: str) -> list[int]:
        pieces, known = self.split(text), self.known
        try:
            return list(chain.from_iterable(map(known.__getitem__, pieces)))
        except KeyError:
            new = [p for p in dict.fromkeys(pieces) if p not in known]
        if len(known) + len(new) > CACHE_PIECES:
            known.clear()
            new = list(dict.fromkeys(pieces))
        for p in new:
            known[p] = tuple(self.bpe.piece(p.encode("utf-8", "replace")))
        out = list(chain.from_iterable(map(known.__getitem__, pieces)))
        if len(known) > CACHE_PIECES:  # a single text with more
            known.clear()
        return out

    def decode(self, ids) -> bytes:
        return self.bpe.decode(ids)


class GrowingText:
    """A text that is appended to or edited, with its ids kept exact.

    Only pieces that the change can reach are split and encoded again. Before it, a match of the pattern depends on the
    characters up to one after its end, or three after its start for contractions. After it, matches depend on nothing
    before them (the pattern must not look back): from the first border that old and new pieces share on, the old ones hold.
    """

    REACH = 3

    def __init__(self, codec: TextCodec, text: str = ""):
        self.codec, self.text, self.pieces, self.encoded = codec, "", [], []
        self.edit(0, 0, text)

    def append(self, more: str) -> GrowingText:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> GrowingText:
        """Replace ``text[start:end]``."""
        ends = list(accumulate(map(len, self.pieces)))
        keep = bisect_left(ends, start)  # pieces that end before the change
        while keep and (ends[keep - 1] + 1 > start or ends[keep - 1] - len(self.pieces[keep - 1]) + self.REACH > start):
            keep -= 1
        at = ends[keep - 1] if keep else 0
        self.text = self.text[:start] + new + self.text[end:]
        grown = len(new) - (end - start)
        again, after = [], len(self.pieces)
        for p in self.codec.split_from(self.text, at):
            again.append(p)
            at += len(p)
            if at - grown >= end and at >= start + len(new):
                k = bisect_left(ends, at - grown, keep)
                if k < len(ends) and ends[k] == at - grown:
                    after = k + 1
                    break
        self.pieces[keep:after] = again
        self.encoded[keep:after] = [tuple(self.codec.bpe.piece(p.encode("utf-8", "replace"))) for p in again]
        return self

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.encoded))


def codec(path: str, pattern: str) -> TextCodec:
    """The worker's codec for a rank file; made once in each Python process."""
    return held(("bpe", path, pattern), lambda: TextCodec(PrefixBpe(load_ranks(path)), pattern))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id column, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and ``ids`` if asked.

    A null text counts as empty; empty texts have no tokens and the hashes of no bytes. Repeated rows give repeated
    results, an empty table an empty one. Other columns of the input, whatever their names, are not carried. The
    whole text is encoded, in memory proportional to the longest text. One narrow pass; no shuffle.
    """
    small_batches(docs.sparkSession)
    own, id_ddl = field_of(docs, id_col, "__id")
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
    schema = pa.schema([own, *fields])

    def make():
        c = codec(path, pattern)
        name = list(map(str, range(len(c.bpe.token)))).__getitem__

        def run(cols):
            out = {k: [] for k in schema.names}
            for key, text in zip(cols["__id"], cols["__text"], strict=True):
                got = c.encode(text or "")
                out["__id"].append(key)
                out["n_tokens"].append(len(got))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(name, got)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(c.decode(got)).hexdigest())
                if with_ids:
                    out["ids"].append(got)
            return out

        return run

    ddl = f"{id_ddl}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(by_batch(make, schema), ddl)
    return out.withColumnRenamed("__id", id_col)


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
