"""Token ids of whole texts by the tokenizers library, each distinct chunk encoded once.

The two public vocabularies split a text into pieces before the merges run, and no piece spans from
the end of a word over white space into the next word. So a text's ids are those of its pieces, one
after the other; a worker has the library's model encode each distinct piece once and gathers the ids
with NumPy. Pieces of Latin-1 letters, digits and marks are cut with NumPy; chunks with apostrophes or
longer white space by the stated patterns; chunks with other characters, special-token strings or
unusual white space, and any tokenizer of another make, go through the library's ``encode`` as they
are. The tests hold all of it against ``encode_batch``.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa

from arborix.llm._text import _LOWER, buffers, span_hash, words

# The piece patterns of the two public vocabularies, for Latin-1 characters.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \t-\r\x85\xa0"
_TAIL = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_PIECES = re.compile(f"{_TAIL}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
BYTE_PIECES = re.compile(f"{_TAIL}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# white space other than 0x20 and 0x09-0x0D, in UTF-8
_ODD_SPACE = rb"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
CACHE, SHORT = 40 << 20, 64  # bytes a worker remembers (beyond, it starts afresh), in pieces of at most so many bytes
# 0 white space, 1 letter, 2 digit, 3 other, 4 for the library (apostrophes: contractions; '<': special tokens)
_CLASS = np.full(256, 4, np.uint8)
_CLASS[:128] = 3
_CLASS[[0x20, *range(9, 14)]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[[0x27, 0x3C]] = 4


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 256
    for b in range(256):
        table[b] = b if b in keep else extra
        extra += b not in keep
    return [chr(table[b]) for b in range(256)]


class ChunkEncoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        made = json.loads(self.tok.to_str())
        norm, pre = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
        norms = [x.get("type") for x in norm.get("normalizers", [])]
        pres = pre.get("pretokenizers", [])
        self.kind = "whole"
        if norms == ["NFC", "Replace", "Lowercase"] and len(pres) == 2 and pres[0].get("pattern", {}).get("Regex") == WORD_SPLIT:
            self.kind = "word"
        elif not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "byte"
        special = [re.escape(t.content.encode()) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = re.compile(b"|".join([_ODD_SPACE, *special]))
        chars = _byte_chars()
        self.table = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(256)}
        self._forget()

    def _forget(self) -> None:
        self.known, self.begin, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _remember(self, h: np.ndarray, ids: list[bytes]) -> None:
        order = np.argsort(h)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size + len(self.pool)
        at = np.searchsorted(self.known, h[order])
        self.known = np.insert(self.known, at, h[order])
        self.begin = np.insert(self.begin, at, begin[order])
        self.size = np.insert(self.size, at, size[order].astype(np.int32))
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), np.uint32)])

    def _library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self._library(text)
            if self.odd.search(chunk):
                return self._library(text)
        elif b"<" in chunk and self.odd.search(chunk):
            return self._library(text)
        if self.kind == "word":
            text = text.lower()
        out = []
        for piece in (WORD_PIECES if self.kind == "word" else BYTE_PIECES).findall(text):
            out.extend(t.id for t in self.model.tokenize(piece.translate(self.table)))
        return array("I", out).tobytes()

    def encode(self, arr: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text, each followed by ``end_id``, and (n + 1) offsets; null counts as empty."""
        n = len(arr)
        if self.kind == "whole":
            found = [e.ids for e in self.tok.encode_batch([t or "" for t in arr.to_pylist()], add_special_tokens=False)]
            sizes = np.array([len(f) + 1 for f in found], np.int64)
            flat = np.array([i for f in found for i in (*f, end_id)], np.uint32)
            return flat, np.concatenate([[0], np.cumsum(sizes)])
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        data, starts, ends, odd, docs = self._units(arr)
        h = span_hash(data, starts, ends, 3) if len(starts) else np.zeros(0, np.uint64)
        inverse, distinct = pd.factorize(h)
        first = np.empty(len(distinct), np.int64)
        first[inverse[::-1]] = np.arange(len(h) - 1, -1, -1)
        if 20 * len(self.known) + 4 * len(self.pool) > CACHE:
            self._forget()
        i = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        hit = self.known[i] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        miss = np.flatnonzero(~hit)
        starts, ends, odd = (x[first[miss]] for x in (starts, ends, odd))
        got, raw, model, table = [], data.tobytes(), self.model, self.table
        for a, b, hard in zip(starts.tolist(), ends.tolist(), odd.tolist(), strict=True):
            piece = raw[a:b]
            got.append(self._chunk(piece) if hard else array("I", [t.id for t in model.tokenize(piece.decode("utf-8").translate(table))]).tobytes())
        size, begin = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        size[hit], begin[hit] = self.size[i[hit]], self.begin[i[hit]]
        size[miss] = np.fromiter(map(len, got), np.int64, len(got)) // 4
        begin[miss] = np.cumsum(size[miss]) - size[miss] + len(self.pool)
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(got), np.uint32)])
        short = np.flatnonzero(ends - starts <= SHORT)
        if len(short):
            self._remember(distinct[miss[short]], [got[k] for k in short.tolist()])
        return _gathered(pool, begin, size, inverse, docs, end_id)

    def _units(self, arr: pa.Array):
        """Bytes, and the ranges to encode each on its own: pieces, or chunks and texts for ``_chunk`` (hard)."""
        raw, off = buffers(arr)
        w = words(arr)
        starts, ends, n = w.starts, w.ends, len(arr)
        data = np.zeros(len(raw) + 8, np.uint8)
        data[: len(raw)] = _LOWER[raw] if self.kind == "word" else raw
        kind = _CLASS[data]
        lead = np.flatnonzero(data == 0xC3)  # À-ÿ
        tail = data[lead + 1]
        if self.kind == "word":
            data[lead + 1] += ((tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)).astype(np.uint8) * np.uint8(32)
        kind[lead] = kind[lead + 1] = np.where((tail == 0x97) | (tail == 0xB7), 3, 1)
        mark = np.zeros(len(data), bool)
        mark[1:] = kind[1:] != kind[:-1]
        chunk_start = starts
        hard_chunks = np.zeros(len(starts), bool)
        if self.kind == "byte":
            # a chunk begins with the white space before its word
            full = w.counts > 0
            chunk_start = np.concatenate([[0], ends[:-1]]) if len(ends) else starts
            chunk_start[w.docs[:-1][full]] = off[:-1][full]
            gap = starts - chunk_start
            mark[starts[(gap == 1) & (data[chunk_start] == 0x20)]] = False
            hard_chunks |= gap > 1
        else:
            mark |= kind == 2
            mark[:-1] &= kind[:-1] != 0
        mark[chunk_start] = True
        bad = np.flatnonzero(kind == 4)
        if len(bad):
            hard_chunks[np.unique(np.searchsorted(chunk_start, bad, "right") - 1)] = True
        whole, hard_at = set(), np.flatnonzero(hard_chunks)
        text = data.tobytes()
        for k, a, b in zip(hard_at.tolist(), chunk_start[hard_at].tolist(), ends[hard_at].tolist(), strict=True):
            mark[a + 1 : b] = False
            if self.odd.search(text, a, b):
                whole.add(int(np.searchsorted(w.docs, k, "right")) - 1)
        tails = np.zeros(0, np.int64)
        if self.kind == "byte":
            last = off[:-1].copy()
            last[full] = ends[w.docs[1:][full] - 1]
            tails = np.array([d for d in np.flatnonzero(last < off[1:]).tolist() if d not in whole], np.int64)
            for d in tails.tolist():
                mark[last[d] : off[d + 1]] = False
            mark[last[tails]] = True
        for d in whole:
            mark[off[d] : off[d + 1]] = False
            mark[off[d]] = True
        mark[len(raw) :] = False
        at = np.flatnonzero(mark)
        chunk = np.searchsorted(chunk_start, at, "right") - 1
        stop = np.minimum(np.concatenate([at[1:], [len(raw)]]), ends[chunk]) if len(ends) else at.copy()
        hard = hard_chunks[chunk] if len(ends) else np.zeros(len(at), bool)
        if len(tails):
            t = np.searchsorted(at, last[tails])
            stop[t], hard[t] = off[1:][tails], True
        for d in whole:
            t = np.searchsorted(at, off[d])
            stop[t], hard[t] = off[d + 1], True
        return data, at, stop, hard, np.searchsorted(at, off)


def _gathered(pool, begin, size, inverse, docs, end_id) -> tuple[np.ndarray, np.ndarray]:
    per = size[inverse]
    upto = np.concatenate([[0], np.cumsum(per)])
    n = len(docs) - 1
    off = upto[docs] + np.arange(n + 1)
    out = np.full(int(off[-1]), end_id, np.uint32)
    if len(per):
        src = np.repeat(begin[inverse] - upto[:-1], per) + np.arange(int(upto[-1]))
        mask = np.ones(len(out), bool)
        mask[off[1:] - 1] = False
        out[mask] = pool[src]
    return out, off


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder of the vocabulary at ``path``; it outlives tasks, and so does what it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
