"""Benchmark decontamination: a BM25 inverted index of the test items, block-max WAND, verified overlaps.

Words are folded for all letters and stripped of outer punctuation and symbols, in items and documents.
Lengths and document frequencies are those of the whole benchmark. The index holds posting lists (item and
impact, by item) and, for each list, the largest impact in every block of ``BLOCK`` items that it reaches. Each training
document is a sequence of passages of two halves of ``span`` words that overlap by one half, so an item of at most ``span`` words lies whole in
one of them; longer items have an index and longer passages of their own (``SPAN``, 4 ``SPAN``, 16 ``SPAN`` ... words).
Every passage is a query. The block maxima of its terms are summed block by block; a block is a pivot where the sum reaches
the least threshold among its items, and only there the postings are read and items scored. All pivots of
all passages of a slice are found at once. Item i is retrieved where its BM25 score reaches ``share`` of the score it gives itself.
Retrieved pairs are verified: 75 % of the item's five-word shingles must be in the document. Where the table of
items has the columns question and answer, each of the two must have 75 % of its own.

Items reach the driver one after the other and are broadcast in groups of about ``max_bytes``, one pass over the documents for each;
scores and pairs are the same for every ``max_bytes``.

Edge cases: null or empty items and those without a letter or digit match nothing; items without a question or an
answer, though the table has the columns, count as a whole; items with fewer than five words count as one shingle;
null or empty texts match nothing; documents with a null id are reported with a null id; repeated
documents and items are reported each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.llm._spark import save, text_of
from arborix.llm._text import Words, buffers, hash_words, shingles, slices, words

BLOCK, K1, B, SPAN = 2, 1.2, 0.75, 64
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(string.punctuation.encode())] = True


def folded_words(arr: pa.Array) -> Words:
    """The words of each text, folded for all letters, without outer punctuation and symbols; none of a word of these alone."""
    data, off = buffers(arr)
    wide = np.concatenate([[0], np.cumsum(data >= 128)])[off]
    wide = wide[1:] > wide[:-1]
    if wide.any():
        some = [t.casefold() for t in arr.filter(pa.array(wide)).to_pylist()]
        for c in set().union(*some):
            if c > "\x7f" and unicodedata.category(c)[0] in "PS":
                some = [t.replace(c, "'") for t in some]
        arr = pc.replace_with_mask(arr, pa.array(wide), pa.array(some, arr.type))
    w = words(arr, lower=True)
    inner = np.flatnonzero(~_PUNCTUATION[w.data[:-8]])
    starts, ends = w.starts.copy(), w.ends.copy()
    at = np.flatnonzero(_PUNCTUATION[w.data[starts]])
    first = np.searchsorted(inner, starts[at])
    starts[at] = np.minimum(np.append(inner, len(w.data))[first], ends[at])
    at = np.flatnonzero((starts < ends) & _PUNCTUATION[w.data[ends - 1]])
    ends[at] = inner[np.searchsorted(inner, ends[at]) - 1] + 1
    keep = starts < ends
    return Words(w.data, starts[keep], ends[keep], np.concatenate([[0], np.cumsum(keep)])[w.docs])


def _shingle_set(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Shingles of one word sequence, as ``shingles`` makes them."""
    w = _Seq(h)
    return np.unique(shingles(w, h, n)[0])


def _text_set(text: str) -> np.ndarray:
    return _shingle_set(hash_words(folded_words(pa.array([text], pa.string()))))


class _Seq:
    def __init__(self, h: np.ndarray):
        self.docs = np.array([0, len(h)])
        self.counts = np.array([len(h)])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Index:
    """Posting lists with block maxima for items of at most ``span`` words.

    ``rows``: (id, words, terms, counts, document frequencies, shingles, shingles of question and answer or ()) of each item;
    ``total`` and ``mean``: number and mean words of all items of the benchmark.
    """

    def __init__(self, rows: list[tuple], total: int, mean: float, span: int, share: float):
        self.items, self.span = [r[0] for r in rows], span
        self.whole, self.halves = [r[5] for r in rows], [r[6] for r in rows]
        n, size = len(rows), np.array([len(r[2]) for r in rows], np.int64)
        words_, tf, df = (np.concatenate([np.asarray(x, t) for x in c]) for c, t in ((([r[1]] for r in rows), float), ((r[3] for r in rows), float), ((r[4] for r in rows), float)))
        item = np.repeat(np.arange(n), size)
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        impact = idf * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * words_ / max(mean, 1e-9)))[item])
        self.own = np.bincount(item, impact, n)
        self.least = share * self.own
        self.terms, term = np.unique(np.concatenate([np.asarray(r[2], np.uint64) for r in rows]), return_inverse=True)
        order = np.lexsort((item, term))
        self.item, self.impact = item[order], impact[order]
        key = term[order] * np.int64(n) + self.item // BLOCK
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.edge = np.append(edge, len(key))
        self.block, self.block_most = self.item[edge] // BLOCK, np.maximum.reduceat(self.impact, edge)
        self.block_start = np.searchsorted(term[order][edge], np.arange(len(self.terms) + 1))
        self.block_least = np.minimum.reduceat(self.least, np.arange(0, n, BLOCK))
        # direct-mapped term table: slot -> maybe there, with the rest by search
        self.bits = max(12, int(np.ceil(np.log2(len(self.terms) * 16))))
        self.slots = np.zeros(1 << self.bits, bool)
        self.slots[(self.terms >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.slots[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        hit = self.terms[i] == h[maybe]
        out[maybe[hit]] = i[hit]
        return out

    def search(self, term: np.ndarray, docs: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(document, item, best score, passages) of all passages at or above an item's threshold."""
        size = np.diff(docs)
        halves = -(-size // self.span)
        doc = np.repeat(np.arange(len(size)), halves)  # of each half
        first = np.cumsum(halves) - halves
        at = np.flatnonzero(term >= 0)
        d = np.searchsorted(docs, at, "right") - 1
        half = first[d] + (at - docs[d]) // self.span
        pair = np.unique(half * np.int64(len(self.terms)) + term[at])
        half, term = pair // len(self.terms), pair % len(self.terms)
        cut = np.searchsorted(half, np.arange(len(doc) + 1))
        # a passage is a half and the next one of its document; a document of one half is one passage
        two = np.append(doc[1:] == doc[:-1], False)
        head = np.flatnonzero(two | (halves[doc] == 1))
        # terms that the next half has too count once
        again = np.flatnonzero(two[half])
        again = again[np.isin(pair[again] + len(self.terms), pair, assume_unique=True)]
        found: dict[tuple[int, int], list] = {}
        nb = len(self.block_least)
        step = max(1, (1 << 22) // nb)
        for k in range(0, len(head), step):
            x = head[k : k + step]
            lo, hi = int(x[0]), int(x[-1]) + 1 + int(two[x[-1]])

            def most(at, lo=lo, hi=hi):
                n = self.block_start[term[at] + 1] - self.block_start[term[at]]
                use = _ranges(self.block_start[term[at]], n)
                return np.bincount(np.repeat(half[at] - lo, n) * nb + self.block[use], self.block_most[use], (hi - lo) * nb).reshape(-1, nb)

            own = most(np.arange(cut[lo], cut[hi]))
            i, j = np.searchsorted(again, [cut[lo], cut[hi]])
            bound = own[x - lo] - most(again[i:j])[x - lo]
            bound[two[x]] += own[x[two[x]] - lo + 1]
            pivot = bound >= self.block_least - 1e-6
            some = np.flatnonzero(pivot.any(1))
            for m in range(0, len(some), 4096):
                self._score(found, doc, x[some[m : m + 4096]], two, pivot[some[m : m + 4096]], cut, term)
        return [(d, i, s, n) for (d, i), (s, n) in sorted(found.items())]

    def _score(self, found: dict, doc: np.ndarray, head: np.ndarray, two: np.ndarray, pivot: np.ndarray, cut: np.ndarray, term: np.ndarray) -> None:
        """Score the items of the pivot blocks of some passages."""
        size = cut[head + 1 + two[head]] - cut[head]
        key = np.unique(np.repeat(np.arange(len(head)), size) * np.int64(len(self.terms)) + term[_ranges(cut[head], size)])
        row, t = key // len(self.terms), key % len(self.terms)
        n = self.block_start[t + 1] - self.block_start[t]
        use, row = _ranges(self.block_start[t], n), np.repeat(row, n)
        keep = pivot[row, self.block[use]]
        use, row = use[keep], row[keep]
        n = self.edge[use + 1] - self.edge[use]
        use, row = _ranges(self.edge[use], n), np.repeat(row, n)
        at, back = np.unique(row * np.int64(len(self.items)) + self.item[use], return_inverse=True)
        scores = np.bincount(back, self.impact[use], len(at))
        row, item = at // len(self.items), at % len(self.items)
        good = np.flatnonzero(scores >= self.least[item] - 1e-6)
        for d, i, s in zip(doc[head[row[good]]].tolist(), item[good].tolist(), scores[good].tolist(), strict=True):
            got = found.setdefault((d, i), [0.0, 0])
            got[0], got[1] = max(got[0], s), got[1] + 1


def overlap(item: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(item, there).mean()) if len(item) else 0.0


_FOUND = "doc_id bigint, item_id bigint, score double, n_passages bigint, overlap double, question_overlap double, answer_overlap double"


def _matches(col: pa.Array, indexes: list[Index], least_overlap: float):
    """(row, item id, score, passages, overlap, question overlap, answer overlap) of the verified pairs of some texts."""
    for lo, hi in slices(col, 1 << 20):
        w = folded_words(col.slice(lo, hi - lo))
        h = hash_words(w)
        sets: dict[int, np.ndarray] = {}
        for index in indexes:
            for d, i, s, n in index.search(index.lookup(h), w.docs):
                if d not in sets:
                    sets[d] = _doc_shingles(h[w.docs[d] : w.docs[d + 1]])
                whole = overlap(index.whole[i], sets[d])
                q, a = (overlap(x, sets[d]) for x in index.halves[i]) if index.halves[i] else (None, None)
                if whole >= least_overlap if q is None else min(q, a) >= least_overlap:
                    yield lo + d, index.items[i], s, n, whole, q, a


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.6, least_overlap: float = 0.75, max_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, score, n_passages, overlap, question_overlap, answer_overlap (null without both) of every verified pair."""
    src = text_of(docs, F.col("doc_id").cast("bigint").alias("doc_id"))
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), *[pa.float64()] * 3]
    names = [f.split()[0] for f in _FOUND.split(", ")]
    parts = []
    for shared in _broadcasts(items, share, max_bytes):

        def run(batches, shared=shared):
            for b in batches:
                rows = list(_matches(b.column("text"), shared.value, least_overlap))
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                ids = b.column("doc_id").take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols[1:], types[1:], strict=True))], names)

        parts.append(src.mapInArrow(run, _FOUND))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], _FOUND)


_ITEM = "item_id bigint, text string, question string, answer string, words bigint, terms array<bigint>, counts array<bigint>"


def _broadcasts(items: DataFrame, share: float, max_bytes: int):
    """Broadcasts of indexes, one index for each class of item lengths, about ``max_bytes`` of items in each."""
    halves = [F.col(c) if {"question", "answer"} <= set(items.columns) else F.lit(None).cast("string") for c in ("question", "answer")]
    text = F.col("text") if "text" in items.columns else F.concat_ws(" ", *halves)
    good = items.select(F.col("item_id").cast("bigint").alias("item_id"), text.alias("text"), halves[0].alias("question"), halves[1].alias("answer")).where("text is not null")

    def counted(batches):
        for b in batches:
            for lo, hi in slices(b.column("text"), 1 << 20):
                part = b.slice(lo, hi - lo)
                w = folded_words(part.column("text"))
                h = hash_words(w)
                found = [np.unique(h[x:y], return_counts=True) for x, y in zip(w.docs[:-1].tolist(), w.docs[1:].tolist(), strict=True)]
                cols = [pa.array(w.counts), *(pa.array([f[k].astype(np.int64) for f in found], pa.list_(pa.int64())) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [f.split()[0] for f in _ITEM.split(", ")])

    rows = good.mapInArrow(counted, _ITEM).where("words > 0").withColumn("row", F.monotonically_increasing_id())
    rows = save(rows, "items")  # written: the row numbers must stay as they are
    stats = rows.agg(F.count("*").alias("n"), F.avg("words").alias("mean")).first()
    if not stats["n"]:
        return
    postings = rows.select("row", F.explode("terms").alias("term"))
    often = postings.groupBy("term").agg(F.count("*").alias("df"))
    often = postings.join(often, "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    rows = rows.join(often, "row").withColumn("df", F.expr("transform(terms, t -> df[t])"))
    span = F.expr(f"{SPAN} * pow(4, greatest(0, ceil(round(log(4, words / {SPAN}), 9))))").cast("bigint")
    spark, group, size = items.sparkSession, [], 0

    def broadcast():
        spans = sorted({g[0] for g in group})
        return spark.sparkContext.broadcast([Index([g[1] for g in group if g[0] == k], stats["n"], stats["mean"], k, share) for k in spans])

    for r in rows.withColumn("span", span).orderBy("span", "item_id", "row").toLocalIterator():
        parts = tuple(map(_text_set, (r["question"], r["answer"]))) if r["question"] and r["answer"] else ()
        row = (r["item_id"], r["words"], np.array(r["terms"], np.int64).view(np.uint64), r["counts"], r["df"], _text_set(r["text"]), parts if all(map(len, parts)) else ())
        group.append((r["span"], row))
        size += 200 + 64 * len(row[2]) + 8 * sum(map(len, (row[5], *row[6])))
        if size >= max_bytes:
            yield broadcast()
            group, size = [], 0
    if group:
        yield broadcast()


def _doc_shingles(h: np.ndarray) -> np.ndarray:
    """Five-word shingles of a document, and its shorter runs too, for items' parts of fewer than five words."""
    out = [_shingle_set(h)]
    for n in range(1, 5):
        if len(h) >= n:
            seq = np.stack([h[k : len(h) - n + 1 + k] for k in range(n)])
            out.append(_runs(seq, n))
    return np.concatenate(out)


def _runs(seq: np.ndarray, n: int) -> np.ndarray:
    from arborix.llm._text import _P, mix

    extra = np.zeros(seq.shape[1], np.uint64)
    for k in range(n):
        extra = mix(extra * _P + seq[k])
    return mix(extra ^ np.uint64(n))


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.6, least_overlap: float = 0.75, max_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` without any verified pair, judged row by row, all columns kept."""
    schema = docs.schema
    for shared in _broadcasts(items, share, max_bytes):

        def run(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for row, *_ in _matches(b.column(b.num_columns - 1), shared.value, least_overlap):
                    keep[row] = False
                yield pa.RecordBatch.from_arrays(b.columns[:-1], schema.names).filter(pa.array(keep))

        docs = docs.select("*", F.coalesce(F.col("text"), F.lit("")).alias("__text")).mapInArrow(run, schema)
    return docs


__all__ = ["Index", "contaminated", "drop_contaminated", "overlap"]
