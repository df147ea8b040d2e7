"""Packing into windows of at most ``window`` tokens by non-negative least squares.

Each document is cut every ``window`` tokens: whole windows stand alone, and what is left is a piece of
1 to window - 1 tokens. Only the histogram of those lengths (window - 1 numbers, whatever the corpus)
reaches the driver. There, shallow combinations of one to three lengths that fill a window (or a power
of two, which needs no padding) are enumerated, their repeat counts solved by non-negative least squares
against the histogram, rounded down, and the residual lengths packed greedily, largest first, in runs of
equal sequences. The plan is a table of intervals: the pieces of one length, numbered through, from
one rank to another go to consecutive sequences at one offset. Its size is bounded by the window.

Edge cases: a null or empty text is the end id alone; null ids are kept (sorted first); repeated rows are
packed each on their own; a text of any length is cut into as many pieces as it needs; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.llm._spark import save, text_of
from arborix.llm._text import slices
from arborix.llm.tokens import crc, encoder


def combinations(hist: np.ndarray, window: int, partners: int = 12) -> list[tuple[int, ...]]:
    """Combinations of one to three lengths present in ``hist`` (index = length) that fill a window."""
    there = np.flatnonzero(hist)
    have = set(there.tolist())
    found: set[tuple[int, ...]] = set()
    size = window
    while size:
        if size < window and size in have:
            found.add((size,))
        for a in there[there < size].tolist():
            b = size - a
            if b in have:
                found.add(tuple(sorted((a, b))))
        size //= 2
    often = there[np.argsort(-hist[there], kind="stable")][: 8 * partners].tolist()
    for a in there.tolist():
        got = 0
        for b in often:
            c = window - a - b
            if c > 0 and c in have:
                found.add(tuple(sorted((a, b, c))))
                got += 1
                if got == partners:
                    break
    return sorted(found, key=lambda p: (len(p), p))


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """x >= 0 with small ||A x - target||, A's columns counting the lengths of each combination; coordinate descent."""
    x = np.zeros(len(columns))
    rest = target.astype(np.float64).copy()
    cols = []
    for p in columns:
        at, count = np.unique(p, return_counts=True)
        cols.append((at.tolist(), count.tolist(), float((count * count).sum())))
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, count, norm) in enumerate(cols):
            g = sum(c * rest[i] for i, c in zip(at, count, strict=True)) / norm
            step = max(-x[j], g)
            if step:
                x[j] += step
                for i, c in zip(at, count, strict=True):
                    rest[i] -= c * step
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return x


def plan(hist: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, last rank + 1, first sequence, offset) that place every counted piece once."""
    left = hist.astype(np.int64).copy()
    used = np.zeros(len(hist), np.int64)
    out, sequence = [], 0

    def place(parts: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length in parts:
            out.append((length, int(used[length]), int(used[length] + times), sequence, offset))
            used[length] += times
            left[length] -= times
            offset += length
        sequence += times

    columns = combinations(hist, window)
    for parts, x in zip(columns, np.floor(nnls(columns, hist) + 1e-9).astype(np.int64).tolist(), strict=True):
        times = min([x, *(int(left[p]) // parts.count(p) for p in set(parts))])
        if times > 0:
            place(list(parts), times)
    while left.any():
        parts, room, now = [], window, left.copy()
        while True:
            fit = np.flatnonzero(now[: room + 1])
            if not len(fit):
                break
            length = int(fit[-1])
            parts.append(length)
            now[length] -= 1
            room -= length
        times = min(int(left[p]) // parts.count(p) for p in set(parts))
        place(parts, times)
    return out


def pieces(docs: DataFrame, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            text, doc = b.column("text"), b.column("doc_id")
            for lo, hi in slices(text, 1 << 20):
                ids, off = enc.encode(text.slice(lo, hi - lo), end_id)
                n = np.diff(off)
                per = -(-n // window)
                row = np.repeat(np.arange(hi - lo), per)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * window
                length = np.minimum(window, n[row] - start)
                at = off[row] + start
                sums = [crc(ids[x:y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(lo, hi - lo).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(n[row])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return text_of(docs, F.col("doc_id").cast("bigint").alias("doc_id")).mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # written once: the lengths decide the plan, and the partition numbers must stay as they are
    cut = save(
        pieces(docs, vocabulary, window, end_id).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}),
        "pieces",
    )
    # rows: at most `window` lengths for each partition
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    hist = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `window` rows at most
        hist[r["length"]] = r["n"]
    whole = int(hist[window])
    hist[window] = 0
    steps = plan(hist, window)
    steps.sort()
    key = np.array([(s[0] << 44) + s[1] for s in steps], np.int64)
    base, offset = np.array([s[3] for s in steps], np.int64), np.array([s[4] for s in steps], np.int64)
    first = np.array([s[1] for s in steps], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((key, base, offset, first))

    inside = Window.partitionBy("part", "length").orderBy("at")
    ranked = cut.withColumn("nth", F.row_number().over(inside) - 1).join(counts.select("part", "length", "before"), ["part", "length"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") + F.col("before")).alias("rank"))

    def run(batches):
        key, base, offset, first = shared.value
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in ("length", "rank"))
            sequence, place = rank.astype(np.int64), np.zeros(len(rank), np.int64)
            rest = length < window
            if rest.any():
                i = np.searchsorted(key, (length[rest].astype(np.int64) << 44) + rank[rest], "right") - 1
                sequence[rest] = whole + base[i] + rank[rest] - first[i]
                place[rest] = offset[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(place)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
