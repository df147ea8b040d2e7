"""Range asymmetric numeral system over token ids (NumPy only, no Spark import).

Static frequencies, scaled to 2 ** 18, serve all blocks of a segment. A block holds up to
``BLOCK`` ids dealt out round-robin to interleaved lanes, each with a 64-bit state that emits and
takes 32-bit words; lanes advance together, one vector step at a time. The emitted words lie in the
order the decoder needs them. Each block carries its lanes' states, one checkpoint half way (states
and word offset), from which a second reader may start, and the crc32 of its ids.
"""

from __future__ import annotations

import zlib

import numpy as np

SCALE_BITS, LOW = 18, np.uint64(1 << 31)
BLOCK, LANES = 1 << 20, 4096
_U = np.uint64


def table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct symbols and their scaled frequencies, which sum to 2 ** SCALE_BITS, each 1 at least."""
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    if len(symbols) > 1 << (SCALE_BITS - 1):
        raise ValueError("too many distinct ids for the frequency scale")
    c = count[symbols].astype(np.float64)
    room = (1 << SCALE_BITS) - len(symbols)
    freq = 1 + np.floor(c / c.sum() * room).astype(np.int64)
    freq[np.argmax(freq)] += (1 << SCALE_BITS) - freq.sum()
    return symbols.astype(np.uint32), freq.astype(np.uint32)


class Coder:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.int64), freq.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(freq, dtype=np.int64)])[:-1].astype(np.uint64)
        self._rank = None
        self._slot = None

    def encode(self, ids: np.ndarray) -> dict:
        """One block: lanes, states, words, checkpoint (step, word offset, states), crc."""
        if self._rank is None:
            self._rank = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 1, np.int64)
            self._rank[self.symbols] = np.arange(len(self.symbols))
        n = len(ids)
        lanes = int(min(LANES, max(1, n // 64)))
        steps = -(-n // lanes)
        rank = self._rank[ids]
        freq, base = self.freq[rank], self.base[rank]
        x = np.full(lanes, LOW, _U)
        out, half = [], steps // 2
        point = (0, 0, b"")
        late = 0
        for t in range(steps - 1, -1, -1):
            f, b = freq[t * lanes : (t + 1) * lanes], base[t * lanes : (t + 1) * lanes]
            y = x[: len(f)]
            full = y >= (f << _U(63 - SCALE_BITS))
            out.append((y[full] & _U(0xFFFFFFFF)).astype(np.uint32))
            y = np.where(full, y >> _U(32), y)
            q = y // f
            x[: len(f)] = (q << _U(SCALE_BITS)) + (y - q * f) + b
            if t == half:
                late = sum(map(len, out))
                point = (half, 0, x.astype("<u8").tobytes())
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        return {
            "n": n,
            "lanes": lanes,
            "states": x.astype("<u8").tobytes(),
            "words": words.astype("<u4").tobytes(),
            "check_step": point[0],
            "check_word": len(words) - late,
            "check_states": point[2],
            "crc": zlib.crc32(ids.astype("<u4")),
        }

    def decode(self, block: dict, part: int | None = None) -> np.ndarray:
        """The ids of a block, or of the half before (0) or from (1) its checkpoint on."""
        if self._slot is None:
            self._slot = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))
        n, lanes = block["n"], block["lanes"]
        steps = -(-n // lanes)
        words = np.frombuffer(block["words"], "<u4").astype(_U)
        lo, hi = (0, steps) if part is None else ((0, block["check_step"]), (block["check_step"], steps))[part]
        x = np.frombuffer(block["check_states" if part == 1 and steps else "states"], "<u8").copy()
        at = block["check_word"] if part == 1 else 0
        mask, out = _U((1 << SCALE_BITS) - 1), np.empty(max(0, min(hi * lanes, n) - lo * lanes), np.int64)
        for t in range(lo, hi):
            k = min(lanes, n - t * lanes)
            y = x[:k]
            low = y & mask
            s = self._slot[low.astype(np.int64)]
            out[(t - lo) * lanes : (t - lo) * lanes + k] = s
            y = self.freq[s] * (y >> _U(SCALE_BITS)) + low - self.base[s]
            need = y < LOW
            m = int(np.count_nonzero(need))
            y[need] = (y[need] << _U(32)) | words[at : at + m]
            at += m
            x[:k] = y
        ids = self.symbols[out].astype(np.uint32)
        if part is None and zlib.crc32(ids.astype("<u4")) != block["crc"]:
            raise ValueError("checksum of a block does not match its ids")
        return ids
