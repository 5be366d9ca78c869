"""Runs of letters of Arrow texts, some of them damaged, counted per slice of a batch."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from quire.llm.words import hash_spans, sliced, text_bytes

#: Bytes of text looked at together.
SLICE = 1 << 22

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True
#: UTF-8's first byte of U+00C0 to U+00FF, and of no other code point of the two-byte kind.
_LEAD = 0xC3
_TABLE = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32)
_TABLE = _TABLE ^ _TABLE[0]  # what a byte adds: the table of the polynomial


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and code points of the maximal runs of A-Z, a-z and U+00C0 to U+00FF; none crosses an offset."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    behind = np.zeros(len(data), bool)
    behind[1:] = data[:-1] == _LEAD
    letter = _ASCII[data] | (data == _LEAD) | behind
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, stops = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:-1]
    stops[:-1] &= ~letter[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    second = np.zeros(len(data) + 1, np.int32)
    np.cumsum(behind, out=second[1:])
    return starts, ends, ends - starts - (second[ends] - second[starts])


def crc_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span's bytes, going on from the crc32 ``before`` it."""
    order = np.argsort(starts - ends, kind="stable")  # long ones first, so that those not yet at their end stand together
    at, size = starts[order], (ends - starts)[order]
    crc = ~before[order].astype(np.uint32)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))
        crc[:n] = _TABLE[(crc[:n] ^ data[at[:n] + k]) & 0xFF] ^ (crc[:n] >> 8)
    out = np.empty(len(crc), np.uint32)
    out[order] = ~crc
    return out


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings."""
    size = ends - starts
    to = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    taken = data[np.repeat(starts - to[:-1], size) + np.arange(to[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(to), pa.py_buffer(taken.tobytes())).cast(pa.string())


def count_runs(least: int, damage: int):
    """Of batches (id, text): each distinct run of ``least`` code points or more of a slice, with its occurrences.

    A run loses the code point at h % its length where ``damage`` divides h, the crc32 of the text's id, a colon and the run.
    """
    def run(batches):
        for batch in sliced(batches, 1, SLICE):
            data, offsets = text_bytes(batch.column(1))
            data = _FOLD[data]
            starts, ends, size = runs_of(data, offsets)
            long = size >= least
            starts, ends, size = starts[long], ends[long], size[long]
            if not len(starts):
                continue
            ids = np.array([zlib.crc32(f"{x}:".encode()) for x in batch.column(0).to_pylist()], np.uint32)
            h = crc_of(data, starts, ends, ids[np.searchsorted(offsets, starts, "right") - 1])
            hit = h % damage == 0
            short = []
            for i in np.flatnonzero(hit):
                text = data[starts[i]:ends[i]].tobytes().decode()
                at = int(h[i]) % len(text)
                short.append(text[:at] + text[at + 1:])
            starts, ends = starts[~hit], ends[~hit]
            _, first, n = np.unique(hash_spans(data, starts, ends), return_index=True, return_counts=True)
            words = pa.concat_arrays([spans(data, starts[first], ends[first]), pa.array([w for w in short if len(w) >= least], pa.string())])
            n = np.concatenate([n, np.ones(len(words) - len(n), np.int64)])
            yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"])

    return run
