"""Words and hashes of whole Arrow batches of texts, in numpy.

A batch of texts is laid out as one byte buffer with a line feed after each
text.  Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` (all of them
ASCII, so UTF-8 sequences are never cut).  The hash of any byte span comes from
prefix sums of a polynomial modulo 2**64, so hashing costs a few operations a
byte, however many spans there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time (a single longer text is worked on alone).
CHUNK_BYTES = 1 << 19

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 65536), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have)
    return have[:n]


class Texts:
    """Some texts in one buffer; text i is ``buf[start[i]:end[i]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        rel = offsets.astype(np.int64) - int(offsets[0])
        self.start = rel[:-1] + np.arange(n)
        self.end = rel[1:] + np.arange(n)
        self.buf = np.full(int(rel[-1]) + n, 10, np.uint8)
        inside = np.ones(len(self.buf), bool)
        inside[self.end] = False
        self.buf[inside] = data
        self.rows = n

    def prefix(self, fold: bool) -> np.ndarray:
        """Prefix sums for :meth:`span_hash`; ``fold`` takes A-Z as a-z."""
        out = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTES)[self.buf] * _powers(_P, len(self.buf)), out=out[1:])
        return out

    @staticmethod
    def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * _powers(_P_INV, len(prefix))[start])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and the index of each text's first word (one more at the end)."""
        inside = ~SPACE[self.buf]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return start, end, np.searchsorted(start, np.append(self.start, len(self.buf)))


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, Texts) of an Arrow string array; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("") if len(texts) else texts
    if not len(texts):
        return
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, hi, Texts(data[at[lo]:at[hi]], at[lo:hi + 1])
        lo = hi


def combined(h: list[np.ndarray]) -> np.ndarray:
    """One hash of several equally long hash arrays, in order."""
    x = np.full(len(h[0]), len(h), np.uint64)
    for y in h:
        x = (x ^ y) * np.uint64(0xD6E8FEB86659FD93) + (y >> np.uint64(32))
    return mix(x)


def shingle_sets(texts: Texts, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles (A-Z folded).

    A text of fewer words has its whole sequence as one; without words: empty.
    """
    start, end, first = texts.words()
    h = texts.span_hash(texts.prefix(True), start, end)
    grams = combined([h[i:len(h) - width + 1 + i] for i in range(width)]) if len(h) >= width else h[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a:b - width + 1]))
        elif b > a:
            out.append(combined([h[i:i + 1] for i in range(a, b)]))
        else:
            out.append(grams[:0])
    return out
