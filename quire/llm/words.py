"""Words and lines of Arrow text columns as 64-bit hashes, for whole batches at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Base of the polynomial that hashes a word's bytes, odd so that it has an inverse.
_BASE = 0x2545F4914F6CDD1D
_MASK = (1 << 64) - 1
#: Bytes hashed at a time, so that the helper arrays stay small however long a text is.
_SLICE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    if base not in _POWERS:
        steps = np.full(_SLICE + 1, base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base]


def scramble(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes and the n + 1 offsets between them; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for ascending spans that do not overlap."""
    powers, inverse = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = int(np.searchsorted(ends, at + _SLICE, "right"))
        if j <= i:  # one span longer than a slice
            total = 0
            for k in range(int(at), int(ends[i]), _SLICE):
                part = data[k:min(k + _SLICE, ends[i])].astype(np.uint64) + np.uint64(1)
                total = (total + int((part * powers[:len(part)]).sum(dtype=np.uint64)) * pow(_BASE, k - int(at), 1 << 64)) & _MASK
            out[i] = total
            i += 1
            continue
        part = data[at:ends[j - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= powers[:len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        out[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * inverse[starts[i:j] - at]
        i = j
    return scramble(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Words:
    """Words of a batch: texts[i] has words[at[i]:at[i + 1]]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    hashes: np.ndarray


def words_of(column: pa.Array, fold: bool) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of each text, with A-Z lower-cased if ``fold``."""
    data, offsets = text_bytes(column)
    if fold:
        data = _FOLD[data]
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hash_spans(data, starts, ends))


_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """A hash of every n (up to 5) consecutive words; empty with fewer words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    last = len(hashes) - n + 1
    total = np.full(last, n, np.uint64)
    for k in range(n):
        total += hashes[k:k + last] * _MIX[k]
    return scramble(total)


def shingle_set(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """A text's set: distinct n-word shingles, or its whole sequence as one if it has fewer words."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    found = np.sort(shingles(hashes, min(n, len(hashes))))
    first = np.empty(len(found), bool)
    first[0] = True
    np.not_equal(found[1:], found[:-1], out=first[1:])
    return found[first]


def sliced(batches, text: int, size: int = 1 << 21):
    """The batches in slices of whole rows with about ``size`` bytes in column ``text``, so that helper arrays stay small."""
    for batch in batches:
        column = batch.column(text)
        _, offsets = text_bytes(column)
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = to
