"""Vectorised words and hashes over Arrow string buffers: no Python object for each word.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. A hash is a polynomial over random byte
values modulo 2**64, taken from prefix sums, and then mixed.
"""

import numpy as np
import pyarrow as pa

from planframe.llm.common import spread

#: Bytes of text handled at once; a longer document is a piece by itself.
CHUNK = 1 << 17

SEP = np.zeros(256, bool)
SEP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_random = np.random.default_rng(20_240_229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) | 1 for x in _random.integers(1 << 40, 2**63, 2, dtype=np.uint64)]
_MIX = _random.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_AGAIN = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES += [int(x) | 1 for x in _random.integers(1 << 40, 2**63, 2, dtype=np.uint64)]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as every chunk needs them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, CHUNK + 65_536), base, np.uint64)
        x[0] = 1
        have = np.cumprod(x, dtype=np.uint64)
        if n <= CHUNK + 65_536:
            _powers[base] = have
    return have[:n]


class Spans:
    """Hashes of spans of a sequence of 64-bit values, whichever their place."""

    def __init__(self, values: np.ndarray, which: int):
        base, n = _BASES[which], len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return spread((self.sums[ends] - self.sums[starts]) * self.back[starts])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each text starts and ends; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(texts: pa.Array, size: int = CHUNK):
    """Slices (first row, bytes, offsets) of a string array with about ``size`` bytes each."""
    data, at = text_buffer(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """The words of a chunk: hashes, byte starts and ends, and ``first``: the first word of each text, with the total at the end."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        data = LOWER[data] if lower else data
        n = len(data)
        word = ~SEP[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inside = at[(at > 0) & (at < n)]
        before[inside] = False
        after[inside - 1] = False
        self.data, self.starts, self.ends = data, np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, at)
        self.hashes = Spans(_BYTE[data], 0)(self.starts, self.ends) if n else np.zeros(0, np.uint64)

    def again(self) -> np.ndarray:
        """Second hashes of the words, by other values of the bytes and another base."""
        return Spans(_BYTE_AGAIN[self.data], 2)(self.starts, self.ends) if len(self.data) else np.zeros(0, np.uint64)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of k words, and where each text's begin; a text of 1 to k-1 words has one, of all its words."""
        count = np.diff(self.first)
        made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
        first = np.zeros(len(made) + 1, np.int64)
        np.cumsum(made, out=first[1:])
        at = np.arange(first[-1]) - np.repeat(first[:-1] - self.first[:-1], made)
        length = np.repeat(np.minimum(count, k), made)
        spans = Spans(self.hashes, 1)
        return spread(spans(at, at + length) + length.astype(np.uint64) * _MIX[0]), first
