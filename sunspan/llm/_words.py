"""Words of many texts at once, as arrays over their UTF-8 bytes.

Words are runs of bytes other than space and 0x09 to 0x0D, or other than the gaps that a caller names. Hashes are
polynomials modulo 2**64, mixed; equal words have equal hashes, and whoever needs more compares bytes or asks for codes.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
R = U(0x9E3779B97F4A7C15)
R_INVERSE = U(pow(int(R), -1, 1 << 64))
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(9, 14)]] = True
#: Gaps between words of digits, lower-case letters and all that is not ASCII.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return mix(np.arange(1, 65, dtype=np.uint64) * U(0xA24BAED4963EE407)) | U(1)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for r in (R, R_INVERSE):
        p = np.full(size, r, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word data[start:end]; starts ascend and words do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, lo + CHUNK, side="right")))
        hi = int(ends[stop - 1])
        size = 1 << max(10, int(hi - lo + 1).bit_length())
        power, inverse = _powers(size)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + U(1)) * power[: hi - lo], out=total[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = (total[e] - total[s]) * inverse[s]
        at = stop
    return mix(out)


class Words:
    """The words of documents, with single spaces between them.

    data: bytes in which each word is followed by a space; starts and ends of words in it; doc: each word's document;
    first: for each document its first word, and at last the number of words.
    """

    def __init__(self, documents: list[bytes], lower: bool = False, gaps: np.ndarray = SEPARATOR):
        raw = np.frombuffer(b" ".join(documents) + b" ", dtype=np.uint8)
        if lower:
            raw = LOWER[raw]
        gap = gaps[raw]
        word = ~gap
        begins = word.copy()
        begins[1:] &= gap[:-1]
        closes = gap.copy()
        closes[1:] &= word[:-1]
        closes[0] = False
        begin = np.flatnonzero(begins)
        lengths = np.flatnonzero(closes) - begin
        self.data = np.where(gap, np.uint8(32), raw)[word | closes]
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        bounds = np.cumsum([0, *(len(d) + 1 for d in documents)])
        self.first = np.searchsorted(begin, bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(documents)), self.counts)

    @cached_property
    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """The number of each word in the array of different words, by their bytes, and that array."""
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        body = np.delete(self.data, self.ends)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary


def sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    c = _multipliers()
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * c[j]
    return mix(total)


def sliding_min(values: np.ndarray, k: int) -> np.ndarray:
    """The minimum of each k consecutive values."""
    width = 1
    while 2 * width <= k:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = k - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values
