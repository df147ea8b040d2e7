"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal updates.

Tokens are the words of a text, each abstracted to a few hashed symbols (the lower-cased letters, the
letter-case pattern, its punctuation, whether it repeats the word before), so unigrams and bigrams
carry over to unseen vocabulary. A document's feature vector holds the share of each hashed n-gram
among all of them; its score is the logistic of the sparse dot product with the weights.
Weights: 2 ** ``bits`` numbers, a fixed size; they travel as one broadcast.

Training uses at most ``max_train`` labelled rows (the documented bound; those with the smallest
hash of the id), whole texts; scoring covers all rows.

Edge cases: a null or empty text has no features and scores the bias alone; rows without a label, or
whose label is null, train nothing; without any training row the score is 0.5; rows with a null id
are scored; several labels of one id: the smallest counts; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.llm._spark import crc_of_id, text_of
from arborix.llm._text import Words, mix, slices, span_hash, stretch_sums, words

_U = np.uint64
BITS, MAX_TRAIN = 18, 20_000


def _symbols(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per word the hash of its lower-cased letters and the hash of its form."""
    n = len(w.starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    data = w.data
    upper = (data >= 65) & (data <= 90)
    low = data + (upper * np.uint8(32)).astype(np.uint8)
    letter = ((low >= 97) & (low <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)

    def per_word(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return c[w.ends] - c[w.starts]

    size = w.ends - w.starts
    ups, lets, digs = per_word(upper), per_word(letter), per_word(digit)
    rest = size - lets - digs
    last, first = data[w.ends - 1].astype(np.int64), upper[w.starts]
    tail = np.where(rest > 0, np.where(letter[w.ends - 1], 1, last), 0)
    case = np.where(lets == 0, 0, np.where((ups >= 2) & (ups * 2 >= lets), 3, np.where(first, 2, 1)))
    form = case + 4 * np.minimum(rest, 3) + 16 * np.minimum(digs, 3) + 64 * tail
    return span_hash(low, w.starts, w.ends, 7), mix(form.astype(np.uint64) + _U(0x51ED27))


def features(arr: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of every text, and their (n + 1) offsets."""
    w = words(arr)
    h, form = _symbols(w)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(arr) + 1, np.int64)
    first = np.zeros(n, bool)
    first[w.docs[:-1][w.counts > 0]] = True
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & ~first[1:]
    form = mix(form + same.astype(np.uint64) * _U(0xABCD1234567))
    before, form_before = np.roll(h, 1), np.roll(form, 1)
    before[first], form_before[first] = _U(1), _U(2)
    grams = np.stack(
        [
            mix(h + _U(11)),
            mix(form + _U(13)),
            mix(before * _U(3) + h + _U(17)),
            mix(form_before * _U(5) + form + _U(19)),
        ],
        axis=1,
    ).ravel()
    return (grams >> _U(64 - bits)).astype(np.int64), w.docs * 4


class Ftrl:
    """Follow the (proximally) regularised leader, per coordinate."""

    def __init__(self, bits: int, alpha: float = 1.5, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.01):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


SCALE = 4.0  # the shares of the four kinds of n-gram sum to one each


def train(texts: pa.Array, labels: np.ndarray, bits: int = BITS, epochs: int = 3) -> np.ndarray:
    """Weights (the last one is the bias) after ``epochs`` passes in the given order."""
    model = Ftrl(bits)
    rows = []
    for lo, hi in slices(texts):
        grams, off = features(texts.slice(lo, hi - lo), bits)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            at, count = np.unique(grams[a:b], return_counts=True)
            rows.append((np.append(at, 1 << bits).astype(np.int32), np.append(count * (SCALE / max(1, b - a)), 1.0).astype(np.float32)))
    for _ in range(epochs):
        for (at, x), y in zip(rows, labels.tolist(), strict=True):
            model.update(at, x.astype(np.float64), y)
    return model.weights()


def score(texts: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    grams, off = features(texts, bits)
    dot = stretch_sums(weights[grams], off) * (SCALE / np.maximum(np.diff(off), 1)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS) -> np.ndarray:
    """Weights from the labelled rows whose ``crc32(doc_id) mod 5`` is not 0."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_of_id() % 5 != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("double").alias("y"))
    )
    # at most max_train pairs of an id and a number: a fixed bound for the broadcast
    sample = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = text_of(docs, "doc_id").join(F.broadcast(sample), "doc_id")

    def fitted(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        got = pa.Table.from_batches(parts)
        order = np.argsort(mix(got["doc_id"].to_numpy().astype(np.uint64)), kind="stable")
        got = got.take(pa.array(order))
        w = train(got["text"].combine_chunks(), got["y"].to_numpy(), bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["w"])

    # one task: its input has a fixed bound (max_train whole texts)
    found = rows.select("doc_id", "text", "y").repartition(1).mapInArrow(fitted, "w binary").collect()
    return np.frombuffer(found[0]["w"], np.float32).astype(np.float64) if found else np.zeros((1 << bits) + 1)


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str], bits: int = BITS, name: str = "score") -> DataFrame:
    """``keep`` columns and the score, called ``name``, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    schema = docs.select(*keep).schema

    def run(batches):
        w = shared.value.astype(np.float64)
        for b in batches:
            text = b.column(b.num_columns - 1)
            parts = [score(text.slice(lo, hi - lo), w, bits) for lo, hi in slices(text)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], [*keep, name])

    src = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    return src.mapInArrow(run, schema.add(name, "double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    out = scored(docs, fit(docs, labels), ["doc_id"])
    return out.select(
        "doc_id",
        F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns kept."""
    out = scored(docs, fit(docs, labels), docs.columns, name="__score")
    return out.where(F.col("__score") >= threshold).drop("__score")


__all__ = ["Ftrl", "classify", "features", "fit", "keep_good", "score", "scored", "train"]
