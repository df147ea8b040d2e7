"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe and verified pairs.

Vectors are scaled to length one; those with equal components (after scaling, bit for bit) are one class from the
start. For each of ``tables`` tables three rounds of random signs and a fast Hadamard transform rotate the
classes; the hash is the axis (and sign) of the largest coordinate of each half of the rotated vector, so a bucket is a pair of them. A
class is stored in its own bucket and probes the buckets of its next best axes too. Classes that meet in a bucket are compared
by cosine in double precision, block by block. A bucket holds any number of classes: large ones are cut into blocks, and all
pairs of blocks are compared in tasks of their own. Pairs are not written: a pair counts in the first table and bucket in which it
meets (each class carries its buckets), and a task returns for each class the number of its links that count there and one
link to a smaller class that it hangs together with, so a group of m near copies makes some m rows and not m * m.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept
as their own component; vectors of different lengths never link; a null id links like others and never names a component;
repeated ids are vectors of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.llm._spark import save
from arborix.llm.graph import components, local_forest

TABLES, PROBES, BLOCK = 12, 3, 512


def unit(rows: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers of the vectors that can link, and these vectors scaled to length one (double precision)."""
    at, out = [], []
    for i, r in enumerate(rows):
        if r is None or not len(r):
            continue
        v = np.asarray(r, dtype=np.float64)
        if not np.isfinite(v).all():
            continue
        if not v.any():
            continue
        at.append(i)
        out.append(scaled(v[None])[0])
    return np.array(at, np.int64), out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (the width is a power of two)."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def buckets(x: np.ndarray, table: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Per row its own bucket and the ``probes`` next ones of one table."""
    n, dim = x.shape
    width = 1 << max(1, int(np.ceil(np.log2(max(2, dim)))))
    v = np.zeros((n, width))
    v[:, :dim] = x
    rng = np.random.default_rng([1234, table, width])
    for _ in range(3):
        v = hadamard(v * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
    half = width // 2
    axes, gaps = [], []
    for part in (v[:, :half], v[:, half:]):
        size = np.abs(part)
        order = np.argsort(-size, axis=1, kind="stable")[:, : probes + 1]
        top = np.take_along_axis(size, order, 1)
        axes.append(order * 2 + (np.take_along_axis(part, order, 1) < 0))
        gaps.append(top[:, :1] - top)
    m = axes[0].shape[1]
    own = axes[0][:, 0] * (2 * width) + axes[1][:, 0]
    # candidates: the other axes of one half with the best of the other, by the smallest loss
    options = np.concatenate([axes[0][:, 1:] * (2 * width) + axes[1][:, :1], axes[0][:, :1] * (2 * width) + axes[1][:, 1:]], axis=1)
    loss = np.concatenate([gaps[0][:, 1:], gaps[1][:, 1:]], axis=1)
    pick = np.argsort(loss, axis=1, kind="stable")[:, : min(probes, 2 * (m - 1))]
    return own, np.take_along_axis(options, pick, 1)


def _classes(vectors: DataFrame) -> tuple[DataFrame, type]:
    """vec_id, class (null for vectors that cannot link), v (the vector as it came) of every row; the components' type."""
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64

    def run(batches):
        for b in batches:
            rows = b.column("embedding").to_pylist()
            at, vs = unit(rows)
            key: list = [None] * b.num_rows
            raw: list = [None] * b.num_rows
            for i, v in zip(at.tolist(), vs, strict=True):
                raw[i] = np.array(rows[i], kind).tobytes()
                key[i] = int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(key, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "class", "v"])

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, "vec_id bigint, class bigint, v binary"), kind


def _hashed(classes: DataFrame, kind: type, tables: int, probes: int) -> DataFrame:
    """class, v, size, cells: per table the own bucket (first) and those probed, as one array."""

    def run(batches):
        for b in batches:
            raws = b.column("v").to_pylist()
            sizes = np.array([len(r) for r in raws], np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                x = scaled(np.stack([np.frombuffer(raws[i], kind) for i in rows]))
                cells = np.concatenate([np.column_stack(buckets(x, t, probes)) for t in range(tables)], axis=1).astype(np.int32)
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), size)), pa.array(list(cells), pa.list_(pa.int32()))], ["class", "v", "copies", "size", "cells"])

    return classes.select("class", "v", "copies").mapInArrow(run, "class bigint, v binary, copies bigint, size bigint, cells array<int>")


def _first_meeting(a: np.ndarray, b: np.ndarray, tables: int) -> np.ndarray:
    """Per row of cells the first number table * width + place in ``a`` of a bucket where both are and one is at home."""
    m = a.shape[1] // tables
    out = np.full(len(a), a.shape[1], np.int64)
    for t in range(tables - 1, -1, -1):
        for k in range(m - 1, -1, -1):
            # at home in a's place 0 with b anywhere; a's probes only where b is at home
            own = a[:, t * m + k : t * m + k + 1]
            there = (own == b[:, t * m : (t + 1) * m]).any(1) if k == 0 else own[:, 0] == b[:, t * m]
            out[there] = t * m + k
    return out


def _compared(threshold: float, kind: type, tables: int):
    """For one bucket (or two blocks of it): class, links (copies linked there first), up (a smaller class it hangs together with)."""

    def run(group: pa.Table) -> pa.Table:
        side, ids, copies = (group[c].to_numpy() for c in ("side", "class", "copies"))
        table, bucket = group["table"][0].as_py(), group["bucket"][0].as_py()
        x = scaled(np.stack([np.frombuffer(v, kind) for v in group["v"].to_pylist()]))
        cells = group["cells"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        m = cells.shape[1] // tables
        mine = cells[:, table * m : (table + 1) * m] == bucket
        home, place = mine[:, 0], table * m + mine.argmax(1)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        links = np.zeros(len(ids), np.int64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(0, len(left), BLOCK):
            rows = left[k : k + BLOCK]
            for q in range(0, len(right), 4 * BLOCK):
                cols = right[q : q + 4 * BLOCK]
                i, j = np.nonzero(x[rows] @ x[cols].T >= threshold - 1e-9)
                i, j = rows[i], cols[j]
                # the smaller class first; within one block each pair is met twice
                ok = (ids[i] < ids[j]) & (home[i] | home[j]) if (side == 2).all() else (ids[i] != ids[j]) & (home[i] | home[j])
                i, j = i[ok], j[ok]
                swap = ids[i] > ids[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                for u in range(0, len(i), 20_000):
                    p, r = i[u : u + 20_000], j[u : u + 20_000]
                    # the product's rounding depends on the block; the sum of one pair does not
                    good = (x[p] * x[r]).sum(1) >= threshold
                    p, r = p[good], r[good]
                    # counted where the pair meets first, by the smaller class's cells
                    first = _first_meeting(cells[p], cells[r], tables) == place[p]
                    links += np.bincount(p[first], copies[r[first]], len(ids)).astype(np.int64) + np.bincount(r[first], copies[p[first]], len(ids)).astype(np.int64)
                    a, b = local_forest(np.concatenate([a, ids[p]]), np.concatenate([b, ids[r]]))
        up = dict(zip(a.tolist(), b.tolist(), strict=True))
        some = np.flatnonzero((links > 0) | np.isin(ids, a))
        return pa.table([pa.array(ids[some]), pa.array(links[some]), pa.array([up.get(c) for c in ids[some].tolist()], pa.int64())], names=["class", "links", "up"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tables: int = TABLES, probes: int = PROBES, tile: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows, kind = _classes(vectors)
    rows = save(rows, "vectors")
    good = rows.where("class is not null")
    classes = good.groupBy("class").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = save(classes, "vector-classes")
    hashed = save(_hashed(classes, kind, tables, probes), "vector-cells")
    width = F.expr(f"size(cells) div {tables}")
    dealt = hashed.select("class", "size", F.posexplode("cells").alias("at", "bucket"), width.alias("width"))
    dealt = dealt.select("class", "size", F.expr("at div width").cast("int").alias("table"), "bucket", (F.col("at") % F.col("width") == 0).alias("home"))
    size = dealt.groupBy("size", "table", "bucket").agg(F.count("*").alias("m"), F.count_if("home").alias("homes")).where("m > 1 and homes > 0")
    dealt = dealt.join(size.select("size", "table", "bucket", F.ceil(F.col("m") / tile).cast("int").alias("cuts")), ["size", "table", "bucket"])
    cut = F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int")
    spread = F.expr("transform(sequence(0, cuts - 1), j -> named_struct('i', least(cut, j), 'j', greatest(cut, j), 'side', if(j = cut, 2, if(cut < j, 0, 1))))")
    key = ["size", "table", "bucket"]
    dealt = dealt.withColumn("cut", cut).select("class", *key, F.explode(spread).alias("t")).select("class", *key, "t.*")
    met = dealt.join(hashed.select("class", "v", "copies", "cells"), "class")
    found = save(met.groupBy(*key, "i", "j").applyInArrow(_compared(threshold, kind, tables), "class bigint, links bigint, up bigint"), "vector-links")
    others = found.groupBy(F.col("class").alias("a")).agg(F.sum("links").alias("others"))
    linked = components(found.where("up is not null").select(F.col("class").alias("a"), F.col("up").alias("b")))
    named = classes.join(linked, classes["class"] == linked["node"], "left").select("class", "copies", "least", F.coalesce("root", "class").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(names, "root").join(others, named["class"] == others["a"], "left")
    named = named.select(F.col("class").alias("k"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component")
    out = rows.join(named, rows["class"] == named["k"], "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
