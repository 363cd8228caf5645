"""Hashes of the words of many texts at once, in numpy.

Words are maximal runs of ASCII letters and digits or of bytes of other characters, in lower case. A word's hash is
the difference of two prefix sums of its bytes times powers of an odd number, divided by the power at its start; it
depends on the word alone. No loop runs over words.
"""

from __future__ import annotations

import re

import numpy as np

_ODD = 0x9E3779B97F4A7C15 | 1
_RUNS = re.compile(rb"[a-z0-9\x80-\xff]+")
_KIND = np.zeros(256, bool)
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: A number for each byte value, so that short words differ in many bits.
_BYTE = np.random.default_rng(23).integers(1, 2**63, 256, np.int64).astype(np.uint64)
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_ODD, pow(_ODD, -1, 2**64))):
                x = np.full(size, np.uint64(base))
                x[0] = 1
                _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def words_of(text: str) -> list[bytes]:
    """The words of a text in order; the same runs that ``hashed`` takes."""
    return _RUNS.findall(text.lower().encode("utf-8", "replace"))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words in a piece of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _KIND[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power, out=total[1:])
        h = (total[end] - total[start]) * inverse[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h ^= h >> np.uint64(27)
    return start, h


def hashed(texts: list[str | None], piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and how many each text has. Null texts have none.

    Texts are joined and cut into pieces of about ``piece`` bytes at texts' ends; a longer text is one piece.
    """
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    found, counts, k = [], np.zeros(len(raw), np.int64), 0
    while k < len(raw):
        first, size = k, 0
        while k < len(raw) and (k == first or size + len(raw[k]) < piece):
            size += len(raw[k]) + 1
            k += 1
        begin = np.cumsum([0, *(len(r) + 1 for r in raw[first:k])])
        start, h = _hashed(np.frombuffer(b"\n".join(raw[first:k]), np.uint8))
        found.append(h)
        counts[first:k] = np.diff(np.searchsorted(start, begin))
    return np.concatenate([np.zeros(0, np.uint64), *found]), counts
