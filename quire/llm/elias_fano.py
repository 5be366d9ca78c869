"""Monotone sequences in about 2 + log2(range / length) bits each, read in place from their bytes."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """``length`` ascending values below 2^64: low bits side by side, high bits in unary.

    The bytes may lie in a file's mapping or in a message; nothing is copied but one count
    per 64 bits of the unary part.
    """

    def __init__(self, data: np.ndarray):
        head = data[:32].view(np.int64)
        self.length, self.low, low_bytes, high_words = (int(x) for x in head)
        self.lows = data[32:32 + low_bytes]
        self.highs = data[32 + low_bytes:32 + low_bytes + 8 * high_words].view(np.uint64)
        self.size = 32 + low_bytes + 8 * high_words
        ones = np.bitwise_count(self.highs).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def encode(values: np.ndarray, below: int) -> bytes:
        n = len(values)
        low = max(0, min(56, (below // max(1, n)).bit_length() - 1))
        values = values.astype(np.uint64)
        shifts = np.arange(low, dtype=np.uint64)
        packed = [np.packbits(((values[i:i + 8192, None] >> shifts) & _ONE).astype(np.uint8).ravel(), bitorder="little").tobytes() for i in range(0, n if low else 0, 8192)]
        lows = b"".join(packed) + bytes(8)
        lows += bytes(-len(lows) % 8)
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        words = (((below - 1 if below else 0) >> low) + n) // 64 + 2
        unary = np.zeros(words * 64, np.uint8)
        unary[high] = 1
        return np.array([n, low, len(lows), words], np.int64).tobytes() + lows + np.packbits(unary, bitorder="little").tobytes()

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero with ``flip``."""
        word = np.searchsorted(counts, k, "right") - 1
        bits = self.highs[word]
        bits = ~bits if flip else bits
        left = (k - counts[word]).astype(np.int64)
        place = np.zeros(len(k), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            w = np.uint64(width)
            inside = np.bitwise_count((bits >> place) & ((_ONE << w) - _ONE)).astype(np.int64)
            over = left >= inside
            left -= np.where(over, inside, 0)
            place += np.where(over, w, np.uint64(0))
        return word * 64 + place.astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i * self.low
        window = np.ndarray((max(0, len(self.lows) - 7),), "<u8", self.lows, strides=(1,))
        return (window[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, self.ones, False) - i
        return (high.astype(np.uint64) << np.uint64(self.low)) | self._lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1: the bucket of its high bits, then successor search among its low bits."""
        values = values.astype(np.uint64)
        out = np.full(len(values), -1, np.int64)
        if not self.length or not len(values):
            return out
        high = (values >> np.uint64(self.low)).astype(np.int64)
        fits = np.flatnonzero(high < int(self.zeros[-1]))
        high, want = high[fits], values[fits] & np.uint64((1 << self.low) - 1)
        since = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) - np.maximum(high - 1, 0), 0)
        until = self._select(high, self.zeros, True) - high
        lo, hi = since.copy(), until.copy()
        go = np.flatnonzero(lo < hi)
        while len(go):
            mid = (lo[go] + hi[go]) >> 1
            less = self._lows(mid) < want[go]
            lo[go] = np.where(less, mid + 1, lo[go])
            hi[go] = np.where(less, hi[go], mid)
            go = go[lo[go] < hi[go]]
        some = np.flatnonzero(lo < until)
        some = some[self._lows(lo[some]) == want[some]]
        out[fits[some]] = lo[some]
        return out
