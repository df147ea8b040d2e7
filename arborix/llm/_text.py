"""Vectorised text kernels over Arrow string buffers (NumPy only, no Spark import).

Words are maximal runs of bytes other than ``0x20`` and ``0x09``-``0x0D``; UTF-8 keeps those bytes for
themselves, so working on bytes equals working on characters. Texts are taken whole; a batch is cut
only between documents, to bound memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

NULL_ID = np.iinfo(np.int64).min
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_P = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place where possible."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def trim() -> None:
    """Give freed memory back to the system: a worker stays beside the JVM and the other workers of its executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and (n + 1) offsets of a string array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(arr: pa.Array, limit: int = 1 << 20, rows: int = 50_000) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` documents and ``limit`` bytes together (one document at least); freed memory goes back at the end."""
    _, off = buffers(arr)
    lo, n = 0, len(arr)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, lo + rows)
        yield lo, hi
        lo = hi
    trim()


@dataclass
class Words:
    data: np.ndarray  # bytes, padded by 8
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray  # word offsets, n + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    def strings(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


def words(arr: pa.Array, lower: bool = False) -> Words:
    data, off = buffers(arr)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    space = _SPACE[data]
    full = off[:-1] < off[1:]
    before = np.empty(len(data), bool)
    before[1:] = space[:-1]
    before[off[:-1][full]] = True
    starts = np.flatnonzero(before & ~space)
    after = np.empty(len(data), bool)
    after[:-1] = space[1:]
    after[off[1:][full] - 1] = True
    ends = np.flatnonzero(after & ~space) + 1
    return Words(padded, starts, ends, np.searchsorted(starts, off))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte ranges of ``data`` (padded by 8), eight bytes at a step."""
    view = np.ndarray((max(len(data) - 7, 0),), "<u8", data.tobytes(), strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) + _U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    at, rows = starts, None
    while True:
        piece = view[at] & _MASK[np.minimum(left, 8)]
        if rows is None:
            h = mix((h ^ piece) * _P)
        else:
            h[rows] = mix((h[rows] ^ piece) * _P)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8


def hash_words(w: Words, seed: int = 1) -> np.ndarray:
    return span_hash(w.data, w.starts, w.ends, seed) if len(w.starts) else np.zeros(0, np.uint64)


def rolling(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """For each position the hash of ``n`` values from there on; the last n - 1 are void (zero padded)."""
    p = int(_P) + 2 * salt
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    out, done, power, at = None, 0, padded, 1  # power: hash of `at` values
    left = n
    while left:
        if left & 1:
            shifted = power[done : done + len(h)] if done else power[: len(h)]
            shifted = np.pad(shifted, (0, len(h) - len(shifted)))
            term = shifted * _U(pow(p, done, 1 << 64))
            out = term if out is None else out + term
            done += at
        left >>= 1
        if left:
            power = power[:-at] + power[at:] * _U(pow(p, at, 1 << 64)) if len(power) > at else power
            at *= 2
    return mix(out)


def windows(w: Words, h: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one document; their document's row; their start word there."""
    doc = np.repeat(np.arange(len(w.docs) - 1), w.counts)
    at = np.arange(len(h))
    keep = at + n <= w.docs[1:][doc]
    doc, at = doc[keep], at[keep]
    return rolling(h, n, salt)[keep], doc, at - w.docs[:-1][doc]


def shingles(w: Words, h: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their document rows; a document of 1 to n - 1 words has its whole sequence as one."""
    grams, doc, _ = windows(w, h, n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = w.counts[short] > k
            extra[has] = mix(extra[has] * _P + h[w.docs[:-1][short[has]] + k])
        extra = mix(extra ^ w.counts[short].astype(np.uint64))
        grams, doc = np.concatenate([grams, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        grams, doc = grams[order], doc[order]
    return grams, doc


def stretch_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each stretch of ``values`` between (n + 1) offsets; a stretch's sum does not depend on the others."""
    out, full = np.zeros(len(off) - 1), off[:-1] < off[1:]
    if full.any():
        out[full] = np.add.reduceat(values, off[:-1][full])
    return out


def ids_of(col: pa.Array) -> np.ndarray:
    """Integer ids; null becomes NULL_ID, the smallest."""
    return col.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)
