"""Substring dedup with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document. Its fingerprint is the least hash among its runs of ``GRAM``
words (leftmost of equals), kept with its place; windows with equal words have equal fingerprints at equal offsets, and
about an eighth of all places carry one, so the index stays small. The index is a set of immutable runs, each sorted
by fingerprint within buckets. A new batch is fingerprinted into a run of its own, merge-joined with all live runs,
and every fingerprint seen twice is verified: the texts on both sides are read and the 96-bit hashes of
the whole windows compared, the earliest (doc_id, start) of each staying. Of equal windows within one slice of the input only the
earliest is compared with other slices, so a passage that many documents share is summed up before it is dealt out. When ``FAN``
runs of a level exist they are compacted into one of the next level.

``dedup`` feeds ``documents`` to an index in ``batches`` ranges of ids, so that later batches meet the history of earlier ones
and the last one's run completes a level, which is compacted.

Edge cases: null or empty texts have no words (their checksum is that of no bytes); documents shorter than a window lose nothing; null
ids come first and count as one id; rows that repeat an id count as the same document, and each
loses the words at the places found for that id; an empty table gives an empty result; texts of any length are read whole;
a clashing extra column is kept by ``apply`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm._spark import discard, n_buckets, save, scratch, sieve, text_of, write
from arborix.llm._text import NULL_ID, Words, hash_words, ids_of, mix, rolling, slices, words

WINDOW, GRAM, FAN = 20, 6, 4
_RUN = "bucket int, keys binary, docs binary, places binary"


def anchors(w: Words, h: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """For every window: its start (word number in the batch), its document row, its fingerprint's place and value."""
    value, n = rolling(h, gram, 5), window - gram + 1
    best, at = value, np.arange(len(value))
    span = 1

    def joined(shift: int):
        other, where = np.append(best[shift:], best[:shift]), np.append(at[shift:], at[:shift])
        left = best <= other
        return np.where(left, best, other), np.where(left, at, where)

    while span * 2 <= n:
        best, at = joined(span)
        span *= 2
    if span < n:
        best, at = joined(n - span)
    doc = np.repeat(np.arange(len(w.docs) - 1), w.counts)
    start = np.flatnonzero(np.arange(len(h)) + window <= w.docs[1:][doc]) if len(h) else np.zeros(0, np.int64)
    return start, doc[start], at[start], best[start]


def _sorted_run(group: pa.Table) -> pa.Table:
    keys, docs, places = _arrays(group)
    order = np.lexsort((places, docs, keys))
    return _run_row(group["bucket"][0].as_py(), keys[order], docs[order], places[order])


def _arrays(group: pa.Table):
    out = []
    for name, kind in (("keys", "<u8"), ("docs", "<i8"), ("places", "<u4")):
        out.append(np.concatenate([np.frombuffer(x, kind) for x in group[name].to_pylist()]))
    return out


def _run_row(bucket: int, keys, docs, places) -> pa.Table:
    cols = [pa.array([bucket], pa.int32()), *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((keys, "<u8"), (docs, "<i8"), (places, "<u4")))]
    return pa.table(cols, names=["bucket", "keys", "docs", "places"])


class FingerprintIndex:
    """Runs below ``root``, in directories run-<level>-<number>; a run is live once it is complete."""

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.buckets = spark, root, buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def runs(self) -> list[tuple[int, int]]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root))]
        return sorted(tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("run-") and fs.exists(path(f"{self.root}/{n}/_SUCCESS")))

    def delete(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)

    def read(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*[f"{self.root}/run-{a}-{b}" for a, b in runs])

    def _write(self, df: DataFrame, level: int) -> tuple[int, int]:
        run = (level, 1 + max((n for _, n in self.runs()), default=0))
        write(df, f"{self.root}/run-{run[0]}-{run[1]}")
        return run

    def add(self, docs: DataFrame) -> tuple[int, int]:
        """Fingerprint ``docs`` (kid, text) into a new run of level 0."""
        nb = self.buckets

        def run(batches):
            for b in batches:
                col, ids = b.column("text"), ids_of(b.column("kid"))
                for lo, hi in slices(col, 2 << 20):
                    w = words(col.slice(lo, hi - lo))
                    _, doc, at, key = anchors(w, hash_words(w))
                    first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
                    doc, at, key = doc[first], at[first], key[first]
                    where = (mix(key) % np.uint64(nb)).astype(np.int64)
                    order = np.argsort(where, kind="stable")
                    cut = np.searchsorted(where[order], np.arange(nb + 1))
                    key, docs_, place = key[order], ids[lo:hi][doc[order]], (at - w.docs[:-1][doc])[order]
                    full = np.flatnonzero(np.diff(cut)).tolist()
                    cols = [pa.array(full, pa.int32())]
                    cols += [pa.array([x[cut[j] : cut[j + 1]].astype(t).tobytes() for j in full], pa.binary()) for x, t in ((key, "<u8"), (docs_, "<i8"), (place, "<u4"))]
                    yield pa.RecordBatch.from_arrays(cols, ["bucket", "keys", "docs", "places"])

        return self._write(docs.mapInArrow(run, _RUN).groupBy("bucket").applyInArrow(_sorted_run, _RUN), 0)

    def compact(self) -> None:
        """Merge the runs of every level that has ``FAN`` of them into one of the next."""
        fs, path = self._fs()
        while True:
            runs = self.runs()
            level = next((k for k in sorted({r[0] for r in runs}) if sum(r[0] == k for r in runs) >= FAN), None)
            if level is None:
                return
            old = [r for r in runs if r[0] == level]
            self._write(self.read(old).groupBy("bucket").applyInArrow(_sorted_run, _RUN), level + 1)
            for a, b in old:
                fs.delete(path(f"{self.root}/run-{a}-{b}"), True)

    def seen_twice(self, new: tuple[int, int]) -> DataFrame:
        """kid, places: the places of fingerprints that the new run shares with itself or with any live run."""
        live = self.runs()
        runs = self.read([new]).withColumn("fresh", F.lit(True))
        if old := [r for r in live if r != new]:
            runs = runs.unionByName(self.read(old).withColumn("fresh", F.lit(False)))

        def merged(group: pa.Table) -> pa.Table:
            keys, docs, places = _arrays(group)
            sizes = [len(k) // 8 for k in group["keys"].to_pylist()]
            fresh = np.repeat(group["fresh"].to_numpy(zero_copy_only=False), sizes)
            order = np.argsort(keys, kind="stable")  # sorted runs: a merge
            keys = keys[order]
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(edge, len(keys)))
            hit = np.repeat((size > 1) & np.logical_or.reduceat(fresh[order], edge), size)
            docs, places = docs[order][hit], places[order][hit]
            order = np.lexsort((places, docs))
            docs, places = docs[order], places[order].astype("<u4")
            kid, first = np.unique(docs, return_index=True)
            cut = np.append(first, len(docs)).tolist()
            return pa.table([pa.array(kid, pa.int64()), pa.array([places[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["kid", "places"])

        found = runs.groupBy("bucket").applyInArrow(merged, "kid bigint, places binary")
        return found.groupBy("kid").agg(F.collect_list("places").alias("places"))


_HITS = "bucket int, key binary, check binary, kid binary, start binary"


def _windows(texts: DataFrame, nb: int) -> DataFrame:
    """Packed windows around the places to verify. ``texts``: kid, text, places.

    Of equal windows in a slice the earliest is dealt by fingerprint; the others repeat for certain and have no key.
    """

    def run(batches):
        for b in batches:
            col, ids, marks = b.column("text"), ids_of(b.column("kid")), b.column("places").to_pylist()
            for lo, hi in slices(col, 2 << 20):
                w = words(col.slice(lo, hi - lo))
                h = hash_words(w)
                start, doc, at, key = anchors(w, h)
                wanted = np.zeros(len(h) + 1, bool)
                for d in range(hi - lo):
                    p = np.frombuffer(b"".join(marks[lo + d]), "<u4").astype(np.int64) + w.docs[d]
                    wanted[p[p < w.docs[d + 1]]] = True
                use = wanted[at]
                start, doc, at, key = start[use], doc[use], at[use], key[use]
                full, check = rolling(h, WINDOW, 9)[start], (rolling(h ^ np.uint64(0x5DEECE66D), WINDOW, 21)[start] >> np.uint64(32)).astype("<u4")
                kid, begin = ids[lo:hi][doc], start - w.docs[:-1][doc]
                order = np.lexsort((begin, kid, check, full))
                lead = np.ones(len(order), bool)
                lead[1:] = (full[order][1:] != full[order][:-1]) | (check[order][1:] != check[order][:-1])
                first, rest = order[lead], order[~lead]
                where = (mix(key[first]) % np.uint64(nb)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cut = np.searchsorted(where[order], np.arange(nb + 1))
                first = first[order]
                some, n = np.flatnonzero(np.diff(cut)).tolist(), int(len(rest) > 0)
                # the certain repeats of a slice go to any bucket of their own
                cols = [pa.array([*some, *[nb + int(abs(int(ids[lo]))) % nb] * n], pa.int32())]
                for x, t in ((full, "<u8"), (check, "<u4"), (kid, "<i8"), (begin, "<u4")):
                    last = [None if x is full or x is check else x[rest].astype(t).tobytes()] * n
                    cols.append(pa.array([*(x[first[cut[j] : cut[j + 1]]].astype(t).tobytes() for j in some), *last], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "key", "check", "kid", "start"])

    return texts.mapInArrow(run, _HITS)


def _repeats(group: pa.Table) -> pa.Table:
    """kid, start, n: runs of windows whose words also start earlier."""
    kid, start = (np.concatenate([np.frombuffer(x, t) for x in group[c].to_pylist()]) for c, t in (("kid", "<i8"), ("start", "<u4")))
    start = start.astype(np.int64)
    if group["key"].null_count == 0:
        key, check = (np.concatenate([np.frombuffer(x, t) for x in group[c].to_pylist()]) for c, t in (("key", "<u8"), ("check", "<u4")))
        order = np.lexsort((start, kid, check, key))
        key, check, kid, start = key[order], check[order], kid[order], start[order]
        lead = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
        edge = np.flatnonzero(lead)
        first = np.repeat(edge, np.diff(np.append(edge, len(key))))
        later = (kid != kid[first]) | (start != start[first])
        kid, start = kid[later], start[later]
    order = np.lexsort((start, kid))
    kid, start = kid[order], start[order]
    if len(kid):
        keep = np.concatenate([[True], (kid[1:] != kid[:-1]) | (start[1:] != start[:-1])])
        kid, start = kid[keep], start[keep]
    head = np.concatenate([[True], (kid[1:] != kid[:-1]) | (start[1:] != start[:-1] + 1)]) if len(kid) else np.zeros(0, bool)
    edge = np.flatnonzero(head)
    n = np.diff(np.append(edge, len(kid)))
    return pa.table([pa.array(kid[edge], pa.int64()), pa.array(start[edge], pa.int64()), pa.array(n, pa.int64())], names=["kid", "start", "n"])


def append(index: FingerprintIndex, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Index ``batch`` (kid, text) and return its covered windows: kid, spans (array of start, n). ``history``: what was indexed before."""
    twice = save(index.seen_twice(index.add(batch)), "seen-twice")
    # only texts with a place to verify are shuffled; the same join at every size, as what is moved must not hinge on a broadcast
    few, places = sieve(twice.select("kid")), twice.hint("merge")
    texts = batch.where(few("kid")).join(places, "kid")
    if history is not None:
        texts = texts.unionByName(history.where(few("kid")).join(places, "kid"))
    found = _windows(texts, index.buckets).groupBy("bucket").applyInArrow(_repeats, "kid bigint, start bigint, n bigint")
    spans = save(found.groupBy("kid").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans")
    discard(twice)
    index.compact()
    return spans


def cover(w: Words, spans: list, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of the spans, a list of (start, n) for each document."""
    delta = np.zeros(len(w.starts) + 1, np.int64)
    for d, found in enumerate(spans):
        if found:
            base, end = w.docs[d], w.docs[d + 1]
            for s in found:
                if base + s["start"] < end:
                    delta[base + s["start"]] += 1
                    delta[min(base + s["start"] + s["n"] + window - 1, end)] -= 1
    return np.cumsum(delta[:-1]) > 0


def _kept(w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Kept words, each followed by a space; the offsets of documents there; kept words per document."""
    starts, size = w.starts[keep], (w.ends - w.starts)[keep] + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    out = w.data[np.repeat(starts - upto[:-1], size) + np.arange(int(upto[-1]))] if len(starts) else np.zeros(0, np.uint8)
    out[upto[1:] - 1] = 0x20
    count = np.concatenate([[0], np.cumsum(keep)])[w.docs]
    return out.tobytes(), upto[count], np.diff(count)


def apply(docs: DataFrame, spans: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove the covered words. Per row: doc_id, n_words, n_removed, kept_sha256; or all columns with the new text."""
    own = docs if with_text else docs.select("doc_id", "text")
    names = own.columns
    src = own.withColumns({"__kid": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)), "__text": F.coalesce(F.col("text"), F.lit(""))})
    spans = spans.select(F.col("kid").alias("__kid"), F.col("spans").alias("__spans"))
    # only texts that may lose words are shuffled
    few = sieve(spans.select("__kid"))
    rest = src.where(~few("__kid")).withColumn("__spans", F.lit(None).cast(spans.schema["__spans"].dataType))
    src = src.where(few("__kid")).join(spans.hint("merge"), "__kid", "left").unionByName(rest)
    if not with_text:
        src = src.select("doc_id", "__text", "__spans")

    def run(batches):
        for b in batches:
            col, marks = b.column("__text"), b.column("__spans").to_pylist()
            for lo, hi in slices(col):
                part = b.slice(lo, hi - lo)
                w = words(col.slice(lo, hi - lo))
                raw, off, kept = _kept(w, ~cover(w, marks[lo:hi]))
                texts = [raw[x : max(x, y - 1)] for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                if with_text:
                    removed = w.counts - kept
                    # a text that loses nothing stays as it is
                    new = [t.decode("utf-8") if r else o for t, r, o in zip(texts, removed.tolist(), part.column("text").to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else part.column(c) for c in names], names)
                else:
                    sums = [hashlib.sha256(t).hexdigest() for t in texts]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.counts), pa.array(w.counts - kept), pa.array(sums)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    if with_text:
        return src.mapInArrow(run, own.schema)
    kind = own.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def find(docs: DataFrame, batches: int = FAN, root: str | None = None) -> DataFrame:
    """kid, spans of all rows, batch after batch of ids. The index stays below ``root``, or goes where none is given."""
    spark = docs.sparkSession
    src = text_of(docs, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("kid"))
    index = FingerprintIndex(spark, root or scratch(spark, "fingerprints"), n_buckets(docs, 2, 32))
    cuts = src.agg(F.percentile_approx("kid", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else None
    out, before = [], None
    for k in range(batches):
        batch = src
        if cuts:
            batch = batch.where(F.col("kid") > cuts[k - 1]) if k else batch
            batch = batch.where(F.col("kid") <= cuts[k]) if k < len(cuts) else batch
        out.append(append(index, batch, before))
        before = src.where(F.col("kid") <= cuts[k]) if cuts and k < len(cuts) else None
    if root is None:
        index.delete()
    # a later batch may name earlier documents again: the places of one id are pooled
    return reduce(DataFrame.unionByName, out).groupBy("kid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup(docs: DataFrame, batches: int = FAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return apply(docs, find(docs, batches))


def without_repeats(docs: DataFrame, batches: int = FAN) -> DataFrame:
    """``docs`` with the repeated words taken out of the texts, all columns kept."""
    return apply(docs, find(docs, batches), with_text=True)
