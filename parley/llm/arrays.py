"""Vectorised helpers over the bytes of an Arrow text column (used inside Spark tasks).

Texts are handled as one byte array plus document offsets; nothing loops over
characters.  ``slices`` bounds what one step works on, so memory follows
``max_bytes`` (or the longest single text), not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Powers are products of one within a block of so many bytes and one of the block.
_BLOCK = 1 << 12
#: Returns freed memory to the system, where the C library has it (glibc).
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` into runs of rows whose ``column`` holds about ``max_bytes`` at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // max_bytes
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Return to the system what Arrow's pool and the C library keep of freed memory: a worker lives on through later stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at the end of a task its worker gives back the freed memory."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def doc_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of n+1 entries); a null is an empty text."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset: filled.offset + len(filled) + 1]
    raw = filled.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def byte_mask(*, drop: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans, false within the given inclusive ranges."""
    mask = np.ones(256, bool)
    for lo, hi in drop:
        mask[lo: hi + 1] = False
    return mask


#: Words between blanks: every byte but space and \t \n \v \f \r.
BLANK_SPLIT = byte_mask(drop=[(0x20, 0x20), (0x09, 0x0D)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document with n+1 entries); words never cross documents."""
    inside = mask[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edge[:-1]] = False
        after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_BASE_INV, _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hasher(data: np.ndarray):
    """A function (starts, ends) -> 64-bit hash of each byte span.

    Polynomial prefix sums are made once, in place, without tables as long as the data;
    each hash is a difference of two, mixed with the span's length.
    """
    n = len(data)
    whole = n // _BLOCK * _BLOCK
    up, down = (_powers(np.uint64(pow(int(base), _BLOCK, 1 << 64)), n // _BLOCK + 1) for base in (_BASE, _BASE_INV))
    sums = np.zeros(n + 1, np.uint64)
    body = sums[1:]
    np.add(data, np.uint64(1), out=body)
    blocks = body[:whole].reshape(-1, _BLOCK)
    blocks *= _UP
    blocks *= up[:-1, None]
    body[whole:] *= _UP[: n - whole] * up[-1]
    np.cumsum(body, out=body)

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (sums[ends] - sums[starts]) * (_DOWN[starts % _BLOCK] * down[starts // _BLOCK])
        return mix(value ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    return hashes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hasher(data)(starts, ends)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each position (the last n-1 positions are left out)."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        total = mix(total + words[i: i + len(total)] * np.uint64(2 * i + 3))
    return total


def owner(offsets: np.ndarray) -> np.ndarray:
    """Document of each entry, given the n+1 offsets of the documents' entries."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's entries."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
