"""Vectorised tokenising and hashing over Arrow string columns (numpy on the raw UTF-8 bytes)."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes handled at a time; a longer text is handled alone, whole.
CHUNK = 1 << 20


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, giving its memory back at the end of a task: workers live on between tasks beside a full JVM heap."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _POWERS.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def _space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


SPACE = _space_table()


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, offsets) for runs of rows of about `limit` bytes; null is empty."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and document number of each word; a word never spans two documents."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    is_sep = sep[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = is_sep[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = is_sep[1:]
    start = np.flatnonzero(~is_sep & (before | cut[:-1]))
    end = np.flatnonzero(~is_sep & (after | cut[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return start, end, doc


_POWERS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per-byte weights and the powers of an odd base and of its inverse, mod 2**64; `size` powers at least."""
    known = _POWERS.get(seed)
    if known is not None and len(known[1]) >= size:
        return known
    size = 1 << max(14, int(size - 1).bit_length())
    rng = np.random.default_rng(seed)
    weights = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = (int(rng.integers(1 << 60, 1 << 62)) * 8 + 5) % (1 << 64)
    inv = pow(base, -1, 1 << 64)

    def ladder(b: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        done, step = 1, b
        while done < size:
            k = min(done, size - done)
            out[done : done + k] = out[:k] * np.uint64(step)
            done, step = done + k, step * step % (1 << 64)
        return out

    _POWERS[seed] = weights, ladder(base), ladder(inv)
    return _POWERS[seed]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by prefix sums of a polynomial; the same in every batch."""
    if not len(start):
        return np.zeros(0, np.uint64)
    weights, up, down = _powers(seed, len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(weights[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    """Hash of each run of k words; entry i covers words i to i+k-1 (runs may span documents; the caller masks)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    _, up, down = _powers(seed, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:m])
