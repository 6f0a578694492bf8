"""Vectorised text kernels shared by the Arrow-side operators.

Everything works on slices of an Arrow string column small enough for the CPU
cache, never on single rows: words, word hashes, and 64-bit hashes of any run of
words or bytes in constant time each (prefix polynomials modulo 2**64 over
random byte codes, followed by a mixing step).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE = 1 << 20
_SEED = np.random.default_rng(20240229)
CODES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER_CODES = CODES.copy()
LOWER_CODES[65:91] = CODES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept up to 4 million."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(1, U)
        step = base
        while len(out) < n:
            out = np.concatenate([out, out * U(step)])
            step = step * step % (1 << 64)
        if len(out) > 1 << 22:
            return out[:n]
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Prefix:
    """Hashes of runs [i, j) of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(codes * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def hash(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix((self.sums[j] - self.sums[i]) * self.inverse[i] + (j - i).astype(U))


class Words:
    """The words of a slice of texts: byte ranges, hashes, and first word of each text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(buf)
        solid = np.zeros(n + 1, bool)
        solid[:n] = ~SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = solid[:-1]
        self.starts = np.flatnonzero(solid & (edge | ~before))
        after = np.flatnonzero(before & (edge | ~solid))
        self.ends = after
        self.first = np.searchsorted(self.starts, offsets)  # one more than texts
        self.counts = np.diff(self.first)
        codes = (LOWER_CODES if lower else CODES)[buf]
        self.hashes = Prefix(codes).hash(self.starts, self.ends)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, text, hash) of each run of k words inside one text."""
        per = np.maximum(self.counts - k + 1, 0)
        doc = np.repeat(np.arange(len(per)), per)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + self.first[:-1][doc]
        return at, doc, Prefix(self.hashes).hash(at, at + k)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of each text in them); nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if texts.null_count:  # a null may still span bytes
        sizes = np.where(np.asarray(texts.is_null()), 0, np.diff(offsets))
        buf = np.concatenate([buf[offsets[i] : offsets[i] + s] for i, s in enumerate(sizes)] or [buf[:0]])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
