"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision has a binary context tree over the preceding bytes.
A node's Krichevsky-Trofimov block probability and the product of its children's weighted probabilities
mix half and half, so all depths take part. The statistics are the counts of byte runs of depth + 1 over
every training text, and the tree keeps every context that occurs there. It is stored as byte runs in buckets of
their last two context bytes, so all contexts of two bytes and more that share a subtree are in one bucket; what
the buckets send up to the contexts of one byte and none (257 at most, whatever the input) is summed by Spark. A
unit of neighbouring texts sends its distinct byte runs to the buckets and gets their log probabilities back; a text's
score is the sum over its bytes and the end mark.

Texts are lower-cased (A-Z) first. The base model counts word tokens: per range of hashed words the counts are
summed over the corpus and applied to the documents' own tokens there; the rows travel as packed arrays.

Edge cases: a null text is empty and has the end mark alone; a null id is never held out; repeated rows are
scored each; without training texts every bit costs one half and every token is unknown; an empty table gives
an empty result; texts of any length are scored whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.llm._spark import crc_of_id, n_buckets, save, text_of
from arborix.llm._text import _LOWER, Words, buffers, hash_words, mix, slices, stretch_sums, trim, words

DEPTH, END = 5, 0xFF  # a run is a context and a byte, a node a context and a decision: seven bytes at most
_END_TOKEN = np.uint64(0x656E642D6D61726B)  # no word hash is meant to equal it
_HALF = np.log(0.5)
# bytes whose runs are made at once; bytes and distinct runs after which a unit of texts ends
_PIECE, _UNIT, _UNIT_RUNS = 1 << 20, 32 << 20, 1_000_000


def grams(arr: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end mark the run of ``depth`` bytes before and itself, packed; (n + 1) offsets."""
    return _grams(*buffers(arr), depth)


def _grams(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(off) - 1
    line = np.full(len(data) + depth * (n + 1), END, np.uint8)
    size = np.diff(off)
    shift = np.repeat((np.arange(n) + 1) * depth, size)
    at = np.arange(len(data)) + shift
    line[at] = _LOWER[data]
    packed = np.zeros(len(line), np.uint64)
    for k in range(depth, -1, -1):
        packed <<= np.uint64(8)
        packed[k:] |= line[: len(line) - k]
        packed[:k] |= np.uint64(END)
    use = np.zeros(len(line), bool)
    use[at] = True
    use[off[1:] + (np.arange(n) + 1) * depth] = True
    return packed[use].astype(np.int64), off + np.arange(n + 1)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, distinct = pd.factorize(np.concatenate(keys))
    return distinct, np.bincount(code, np.concatenate(counts), len(distinct)).astype(np.int64)


def _dealt(distinct: np.ndarray, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct runs by the bucket of their last two context bytes, then by value; the buckets' nb + 1 cuts."""
    where = (mix((distinct >> 8 & 0xFFFF).astype(np.uint64)) % np.uint64(nb)).astype(np.int64)
    order = np.lexsort((distinct, where))
    return order, np.searchsorted(where[order], np.arange(nb + 1))


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def _packed_runs(g: np.ndarray) -> bytes:
    """Sorted runs, byte by byte: neighbours share most of them."""
    return _packed(g.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : DEPTH + 1].T.tobytes())


def _unpacked_runs(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacked(raw), np.uint8).reshape(DEPTH + 1, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : DEPTH + 1] = planes.T
    return out.view("<i8").ravel().astype(np.int64)


def gram_counts(train: DataFrame, nb: int, depth: int = DEPTH) -> DataFrame:
    """bucket, grams, n: the sorted distinct runs over all of ``train`` and their counts, one row for each bucket."""

    def sent(keys, counts):
        order, cut = _dealt(keys, nb)
        keys, counts = keys[order], counts[order]
        full = np.flatnonzero(np.diff(cut))
        rows = [(int(j), keys[cut[j] : cut[j + 1]].tobytes(), counts[cut[j] : cut[j + 1]].tobytes()) for j in full]
        return _record(rows, _RUNS)

    def run(batches):
        keys, counts, held = [], [], 0
        for b in batches:
            text = b.column("text")
            for lo, hi in slices(text, _PIECE):
                g, _ = grams(text.slice(lo, hi - lo), depth)
                code, distinct = pd.factorize(g)
                keys.append(distinct)
                counts.append(np.bincount(code, minlength=len(distinct)))
                held += len(distinct)
                if held > 1_200_000:
                    merged = _merged(keys, counts)
                    keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
                    if held > 800_000:  # a bounded buffer: sent early, summed in the bucket
                        yield sent(keys[0], counts[0])
                        keys, counts, held = [], [], 0
        if keys:
            yield sent(*_merged(keys, counts))
        keys = counts = None
        trim()

    def merge(group: pa.Table) -> pa.Table:
        keys, counts = ([np.frombuffer(x.as_buffer(), np.int64) for x in group[c]] for c in ("grams", "n"))
        k, c = _merged(keys, counts)
        order = np.argsort(k)
        return pa.Table.from_batches([_record([(group["bucket"][0].as_py(), k[order].tobytes(), c[order].tobytes())], _RUNS)])

    return text_of(train).mapInArrow(run, _RUNS).groupBy("bucket").applyInArrow(merge, _RUNS)


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.918938533204672742 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - np.log(np.pi) - _lgamma(a + b + 1)


def _levels(grams: np.ndarray, n: np.ndarray, depth: int = DEPTH):
    """For each of a byte's eight decisions the nodes of orders depth to 2 that occur below one bucket's sorted runs,
    as (keys, probability of a one, share of stopping there), and what they send up: keys, zeros, ones, weighted."""
    byte, context = grams & 255, grams >> 8
    for j in range(8):
        one = byte >> 7 - j & 1
        keys, up = np.unique(context << 8 | (256 | byte) >> 8 - j, return_inverse=True)
        # a bucket without training runs has no nodes; bincount of nothing is of integers
        a, b, below = *(np.bincount(up, x, len(keys)).astype(np.float64) for x in (n * (1 - one), n * one)), None
        nodes = []
        for d in range(depth, 1, -1):
            weighted = own = block(a, b)
            stop = np.ones(len(keys))
            if d < depth:
                weighted = np.logaddexp(_HALF + own, _HALF + below)
                stop = np.exp(_HALF + own - weighted)
            nodes.append((keys, (b + 0.5) / (a + b + 1), stop))
            keys, up = np.unique(keys & (1 << 8 * d) - 1, return_inverse=True)
            a, b, below = (np.bincount(up, x, len(keys)).astype(np.float64) for x in (a, b, weighted))
        yield nodes, (keys, a, b, below)


def top(runs: DataFrame, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """(probability of a one, share of stopping) of the decisions after one byte (byte << 8 | decision) and after none."""

    def send(batches):
        for batch in batches:
            for g, n in zip(batch.column("grams"), batch.column("n"), strict=True):
                for _, up in _levels(np.frombuffer(g.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64), depth):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in up], ["node", "zeros", "ones", "below"])

    # one row at most for each byte and decision: 65,280 at any size of input
    sums = runs.mapInArrow(send, "node bigint, zeros double, ones double, below double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    a, b, below = np.zeros((3, 256 * 256))
    for r in sums.collect():
        a[r["node"]], b[r["node"]], below[r["node"]] = r["zeros"], r["ones"], r["below"]
    out = []
    for _ in range(2):
        own = block(a, b)
        weighted = np.logaddexp(_HALF + own, _HALF + below)
        out.append(((b + 0.5) / (a + b + 1), np.exp(_HALF + own - weighted)))
        a, b, below = (x.reshape(-1, 256).sum(0) for x in (a, b, weighted))
    return out


def _logs(wanted: np.ndarray, grams: np.ndarray, n: np.ndarray, above: list[tuple[np.ndarray, np.ndarray]], depth: int = DEPTH) -> np.ndarray:
    """log10 probability of the last byte of each wanted run given the others; the runs of its bucket are the model."""
    byte, context = wanted & 255, wanted >> 8
    out = np.zeros(len(wanted))
    for j, (nodes, _) in enumerate(_levels(grams, n, depth)):
        at = context << 8 | (256 | byte) >> 8 - j
        p = np.full(len(wanted), 0.5)
        for d, (keys, ones, stop) in zip(range(depth, 1, -1), nodes, strict=True):
            if len(keys):
                want = at & (1 << 8 * (d + 1)) - 1
                i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                p = np.where(keys[i] == want, stop[i] * ones[i] + (1 - stop[i]) * p, p)
        for (ones, stop), mask in zip(above, (0xFFFF, 0xFF), strict=True):
            i = at & mask
            p = stop[i] * ones[i] + (1 - stop[i]) * p
        out += np.log10(np.maximum(np.where(byte >> 7 - j & 1, p, 1 - p), 1e-300))
    return out


_RUNS = "bucket int, grams binary, n binary"
_PARTS = "bucket int, unit bigint, slice int, meta boolean, ids binary, held binary, n binary, hashes binary, seen binary, grams binary, text binary"


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The number of each token (all words, then every text's end) among the distinct ones, and these."""
    return pd.factorize(np.concatenate([hash_words(w), np.full(len(w.docs) - 1, _END_TOKEN)]))


def _token_order(distinct: np.ndarray, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct tokens by bucket; the buckets' nb + 1 cuts."""
    where = (mix(distinct) % np.uint64(nb)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(nb + 1))


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row; ``depth`` is ``DEPTH`` at most."""
    held = F.coalesce(crc_of_id() % 7 == 2, F.lit(False))
    src = text_of(docs, F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held"))
    nb = n_buckets(docs, 2, 128)
    runs = save(gram_counts(src.where("not held"), nb, depth), "byte-runs")
    shared = docs.sparkSession.sparkContext.broadcast(top(runs, depth))

    def per_slice(batches):
        from pyspark import TaskContext

        part, unit, k = TaskContext.get().partitionId(), 0, 0
        keys, size = [], 0

        def runs_of_unit():
            g = pd.unique(np.concatenate(keys))
            order, cut = _dealt(g, nb)
            g, no = g[order], [None] * 5
            full = np.flatnonzero(np.diff(cut)).tolist()
            return _record([(j, part << 32 | unit, k, False, *no, _packed_runs(g[cut[j] : cut[j + 1]]), None) for j in full], _PARTS)

        for b in batches:
            col = b.column("text")
            for lo, hi in slices(col, 4 << 20):
                text, ids = col.slice(lo, hi - lo), b.column("doc_id").slice(lo, hi - lo)
                hold = b.column("held").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                data, off = buffers(text)
                for x, y in slices(text, _PIECE):
                    keys.append(pd.unique(grams(text.slice(x, y - x), depth)[0]))
                w = words(text, lower=True)
                word, distinct = _tokens(w)
                held = np.concatenate([np.repeat(hold, w.counts), hold])
                seen = np.bincount(word[~held], minlength=len(distinct))
                order, cut = _token_order(distinct, nb)
                distinct, seen = distinct[order], seen[order].astype("<u4")
                unit_id = part << 32 | unit
                raw = ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                rows = [(unit_id % nb, unit_id, k, True, raw.tobytes(), hold.astype(np.uint8).tobytes(), np.diff(off).tobytes(), None, None, None, _packed(data.tobytes()))]
                for j in np.flatnonzero(np.diff(cut)).tolist():
                    x, y = cut[j], cut[j + 1]
                    rows.append((j, unit_id, k, False, None, None, None, distinct[x:y].tobytes(), seen[x:y].tobytes(), None, None))
                yield _record(rows, _PARTS)
                k, size = k + 1, size + len(data)
                if sum(map(len, keys)) > _UNIT_RUNS:
                    keys = [pd.unique(np.concatenate(keys))]
                if size > _UNIT or len(keys[0]) > _UNIT_RUNS // 2:
                    yield runs_of_unit()
                    unit, k, keys, size = unit + 1, 0, [], 0
                trim()
        if keys:
            yield runs_of_unit()
        keys = None
        trim()

    def per_bucket(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        out = [(r["unit"], r["slice"], True, r["ids"], r["held"], r["n"], r["text"], 0, 0) for r in rows if r["meta"]]
        tree = [r for r in rows if r["unit"] is None]
        asked = [r for r in rows if r["unit"] is not None and r["grams"] is not None]
        rows = [r for r in rows if r["hashes"] is not None]
        if asked:
            model = [np.frombuffer(tree[0][c] if tree else b"", np.int64) for c in ("grams", "n")]
            wanted = [_unpacked_runs(r["grams"]) for r in asked]
            code, distinct = pd.factorize(np.concatenate(wanted))
            logs, at = _logs(distinct, *model, shared.value, depth).astype("<f4"), 0
            for r, g in zip(asked, wanted, strict=True):
                out.append((r["unit"], -1, False, r["grams"], None, None, logs[code[at : at + len(g)]].tobytes(), 0, 0))
                at += len(g)
            del wanted, code, distinct, logs
        if rows:
            hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
            seen = [np.frombuffer(r["seen"], "<u4") for r in rows]
            code, distinct = pd.factorize(np.concatenate(hashes))
            count = np.bincount(code, np.concatenate(seen), len(distinct))
            total, kinds, at = int(count.sum()), int(np.count_nonzero(count)), 0
            here = int(group["bucket"][0].as_py()).to_bytes(4, "little")
            for r, h in zip(rows, hashes, strict=True):
                out.append((r["unit"], r["slice"], False, None, here, count[code[at : at + len(h)]].astype("<i8").tobytes(), None, total, kinds))
                at += len(h)
                total = kinds = 0
        made = _record(out, _SUMS)
        del rows, out
        trim()
        return pa.Table.from_batches([made])

    def per_doc(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        asked = [r for r in rows if r["slice"] < 0]
        g = np.concatenate([_unpacked_runs(r["a"]) for r in asked])
        order = np.argsort(g)
        g, g_logs = g[order], np.concatenate([np.frombuffer(r["d"], "<f4") for r in asked])[order].astype(np.float64)
        of_slice: dict[int, list] = {}
        for r in rows:
            of_slice.setdefault(r["slice"], []).append(r)
        made = pa.concat_tables([_of_slice(of_slice[k], g, g_logs) for k in sorted(of_slice) if k >= 0])
        del rows, asked, of_slice
        trim()
        return made

    def _of_slice(rows: list[dict], g: np.ndarray, g_logs: np.ndarray) -> pa.Table:
        meta = next(r for r in rows if r["meta"])
        ids, hold = np.frombuffer(meta["a"], np.int64), np.frombuffer(meta["b"], np.uint8).astype(bool)
        off = np.concatenate([[0], np.cumsum(np.frombuffer(meta["c"], np.int64))])
        text = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(off), pa.py_buffer(_unpacked(meta["d"]))])
        scores = []
        for lo, hi in slices(text, _PIECE):
            runs, ends = grams(text.slice(lo, hi - lo), depth)
            code, distinct = pd.factorize(runs)
            scores.append(stretch_sums(g_logs[np.searchsorted(g, distinct)][code], ends))
        # the same tokens in the same order as they were asked for, bucket by bucket
        w = words(text, lower=True)
        word, distinct = _tokens(w)
        found = sorted((r for r in rows if not r["meta"]), key=lambda r: int.from_bytes(r["b"], "little"))
        count = np.empty(len(distinct), np.int64)
        count[_token_order(distinct, nb)[0]] = np.concatenate([np.frombuffer(r["c"], "<i8") for r in found])
        known, logs = count[word] > 0, np.log10(count + 1)[word]
        n = len(w.starts)
        known, logs = (stretch_sums(x[:n].astype(float), w.docs) + x[n:] for x in (known, logs))
        n_tokens, n_bytes, known = w.counts + 1, np.diff(off) + 1, known.astype(np.int64)
        cols = [pa.array(ids, mask=ids == np.iinfo(np.int64).min), pa.array(hold), pa.array(n_tokens), pa.array(known), pa.array(logs), pa.array(np.concatenate(scores)), pa.array(n_bytes)]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes"])

    parts = src.mapInArrow(per_slice, _PARTS).unionByName(runs.withColumn("meta", F.lit(False)), allowMissingColumns=True)
    sums = save(parts.groupBy("bucket").applyInArrow(per_bucket, _SUMS), "token-sums")
    total = sums.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("t"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("k")).first()
    out = sums.groupBy("unit").applyInArrow(per_doc, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, n_bytes bigint")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(total["t"])).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total["t"] + total["k"] + 1)))).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


_SUMS = "unit bigint, slice int, meta boolean, a binary, b binary, c binary, d binary, total bigint, kinds bigint"
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}


def _record(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    cols = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields, strict=True)], [f for f, _ in fields])
