"""N-gram Jaccard self-join: documents whose sets of five-word shingles have a similarity of 0.75 or more.

Equal sets are one class from the start. Candidates: similar sets share a shingle in the first quarter of a
common order of all shingles; the order puts shingles of crowded counters last (a fixed-size count sketch over all
documents; any order gives the same links, this one gives few candidates), then goes by hash. All pairs of a posting list must pass the size ratio and
the bound by bit counts; equal lists are taken once, and lists longer than ``LONG`` only say that their documents belong together for now:
they become chains of neighbours, so no task meets such a list as a whole. A shingle whose counter holds more than ``CROWD`` documents is
posted in parts by slice of the input, with one document of each slice in a list that ties the parts. The connected candidates
are cut into size-banded tiles (a similarity of 0.75 stays within one band or two adjacent ones), each tile or pair of
tiles of at most ``TILE`` members and about ``TILE_SIZE`` shingles a side. There the bit counts of hashed bitmap
signatures bound the overlap from above: every member of x whose bit y lacks is missing from y. Pairs that may
reach the threshold and are not yet linked through others are intersected exactly as sorted arrays.

Shingles are compared by 48-bit hashes within a pair, sets by 64-bit keys.

Edge cases: texts of fewer than five words have their whole sequence as one shingle; null or empty texts have none and
link with nothing; a null id links like others and never names a component (a component of null ids alone is null);
repeated rows are a class; an empty table gives an empty result; long texts are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from arborix.llm._spark import discard, n_buckets, save, sieve, text_of
from arborix.llm._text import hash_words, mix, shingles, slices, words
from arborix.llm.graph import components, local_forest

SKETCH_BITS, LONG, CROWD, TILE, TILE_SIZE = 22, 1024, 4096, 1024, 4 << 20
_HOT, _CHAIN = np.uint64(1 << 63), np.uint64(1 << 62)  # marks of posted shingles: in size bands; always a chain
_K48 = np.uint64((1 << 48) - 1)
_BAND = np.log(4 / 3)


def sets_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit shingles of each document, one after the other, and (n + 1) offsets."""
    w = words(text, lower=True)
    g, doc = shingles(w, hash_words(w))
    packed = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (g >> np.uint64(16)))
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])] if len(packed) else packed
    off = np.searchsorted(packed >> np.uint64(48), np.arange(len(text) + 1).astype(np.uint64))
    return packed & _K48, off


def set_keys(keys: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; equal sets have equal keys."""
    c = np.concatenate([[np.uint64(0)], np.cumsum(mix(keys + np.uint64(77)), dtype=np.uint64)])
    return mix((c[off[1:]] - c[off[:-1]]) ^ mix(np.diff(off).astype(np.uint64))).astype(np.int64)


def signatures(keys: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Bitmaps of about one to two bits a shingle, a power of two of at least 64 bits, set by the hash's low bits."""
    n = np.diff(off)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(1, n))).astype(np.int64))
    out = []
    low = keys & np.uint64(0xFFFFFFFF)
    for a, b, m in zip(off[:-1].tolist(), off[1:].tolist(), bits.tolist(), strict=True):
        sig = np.zeros(m, np.uint8)
        sig[(low[a:b] & np.uint64(m - 1)).astype(np.int64)] = 1
        out.append(np.packbits(sig, bitorder="little").tobytes())
    return out


def fold(sig: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap brought down to fewer bits (both powers of two)."""
    while len(sig) * 64 > bits:
        half = len(sig) // 2
        sig = sig[:half] | sig[half:]
    return sig


def may_link(n_a: int, sig_a: bytes, n_b: int, sig_b: bytes) -> bool:
    """Whether size ratio and bit counts leave a Jaccard similarity of 0.75 possible."""
    if min(n_a, n_b) * 100 < 75 * max(n_a, n_b):
        return False
    a, b = np.frombuffer(sig_a, np.uint64), np.frombuffer(sig_b, np.uint64)
    bits = 64 * min(len(a), len(b))
    a, b = fold(a, bits), fold(b, bits)
    most = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return 100 * most >= 75 * (n_a + n_b - most)


def _sketch(src: DataFrame) -> np.ndarray:
    """The class of each of 2 ** SKETCH_BITS counters: 0, or more for those that hold a crowded shingle."""
    size, block = 1 << SKETCH_BITS, 1 << 16

    def count(batches):
        total = np.zeros(size, np.uint32)
        for b in batches:
            text = b.column("text")
            for lo, hi in slices(text):
                keys, _ = sets_of(text.slice(lo, hi - lo))
                total += np.bincount((keys >> np.uint64(48 - SKETCH_BITS)).astype(np.int64), minlength=size).astype(np.uint32)
        rows = [[], [], []]
        for k in range(size // block):
            part = total[k * block : (k + 1) * block]
            at = np.flatnonzero(part)
            if len(at):
                for col, v in zip(rows, (k, at.astype("<u2").tobytes(), part[at].astype("<u4").tobytes()), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["block", "at", "n"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(block, np.int64)
        for at, n in zip(group["at"].to_pylist(), group["n"].to_pylist(), strict=True):
            total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
        mid = float(np.median(total))
        crowded = total > mid + 6 * np.sqrt(mid) + 8
        level = np.where(crowded, 1 + np.floor(np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
        return pa.table([pa.array([group["block"][0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "level"])

    out = np.zeros(size, np.uint8)
    # 2 ** SKETCH_BITS bytes at most, whatever the input
    for r in src.mapInArrow(count, "block int, at binary, n binary").groupBy("block").applyInArrow(add, "block int, level binary").collect():
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["level"], np.uint8)
    return out


PARTS = 64  # parts of a crowded shingle's postings
_PASS = "rid bigint, doc_id bigint, n bigint, skey bigint, sig binary, bucket int, tiles binary, at binary"


def _passed(src: DataFrame, level: np.ndarray, nb: int) -> DataFrame:
    """A row per document (rid, doc_id, n, skey, sig) and rows of packed postings (bucket, rid of the slice, tiles, at)."""
    shared = src.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        level = shared.value
        for b in batches:
            col = b.column("text")
            for lo, hi in slices(col, 2 << 20):
                keys, off = sets_of(col.slice(lo, hi - lo))
                n, skey = np.diff(off), set_keys(keys, off)
                base = (part << 44) | (k << 16)
                k += 1
                first = np.zeros(hi - lo, bool)
                first[np.unique(skey, return_index=True)[1]] = True
                doc = np.repeat(np.arange(hi - lo), n)
                crowd = level[(keys >> np.uint64(48 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(doc * 64 + crowd, kind="stable")
                place = np.arange(len(keys)) - off[:-1][doc]
                use = order[(place < (n - -(-75 * n // 100) + 1)[doc]) & first[doc]]
                tile, at, hot = keys[use], doc[use], crowd[use] > 0
                band = np.floor(np.log(np.maximum(n, 1)) / _BAND).astype(np.int64)[at[hot]]
                tall = crowd[use][hot] > np.log2(CROWD)
                banded = [(mix(tile[hot] ^ mix((band + s).astype(np.uint64))) & ~_CHAIN) | _HOT for s in (1, 2)]
                heads, heads_at = [], []
                for t in banded:
                    t[tall] |= _CHAIN
                    one = np.flatnonzero(tall)[np.unique(t[tall], return_index=True)[1]]
                    heads.append(t[one])
                    heads_at.append(at[hot][one])
                    t[tall] = mix(t[tall] ^ mix(np.uint64([(base >> 16) % PARTS + 1]))) | _HOT | _CHAIN
                tile = np.concatenate([tile[~hot], *banded, *heads])
                at = np.concatenate([at[~hot], at[hot], at[hot], *heads_at])
                where = (mix(tile) % np.uint64(nb)).astype(np.int64)
                order = np.lexsort((at, where))
                tile, at = tile[order], at[order]
                cut = np.searchsorted(where[order], np.arange(nb + 1))
                full = np.flatnonzero(np.diff(cut))
                docs, m = hi - lo, len(full)
                cols = [
                    pa.array(np.concatenate([base + np.arange(docs), np.full(m, base)])),
                    pa.concat_arrays([b.column("doc_id").slice(lo, docs), pa.nulls(m, pa.int64())]),
                    pa.array(np.concatenate([n, np.zeros(m, np.int64)])),
                    pa.array(np.concatenate([skey, np.zeros(m, np.int64)])),
                    pa.array([*signatures(keys, off), *[None] * m], pa.binary()),
                    pa.array([*[None] * docs, *full.tolist()], pa.int32()),
                    pa.array([*[None] * docs, *(tile[cut[j] : cut[j + 1]].tobytes() for j in full)], pa.binary()),
                    pa.array([*[None] * docs, *(at[cut[j] : cut[j + 1]].astype("<u2").tobytes() for j in full)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _PASS.split(", ")])

    return src.mapInArrow(run, _PASS)


def _lists(group: pa.Table) -> pa.Table:
    """The distinct posting lists of one bucket as (list, rid, chain) rows; shingles with equal members share a list, a long one becomes a chain of pairs."""
    tiles = np.concatenate([np.frombuffer(t, np.uint64) for t in group["tiles"].to_pylist()])
    rid = np.concatenate([np.frombuffer(a, "<u2").astype(np.int64) + r for a, r in zip(group["at"].to_pylist(), group["rid"].to_pylist(), strict=True)])
    order = np.lexsort((rid, tiles))
    tiles, rid = tiles[order], rid[order]
    start = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]]))
    size = np.diff(np.append(start, len(tiles)))
    name = mix(np.add.reduceat(mix(rid.astype(np.uint64)), start) ^ size.astype(np.uint64))
    long = (size > LONG) | (tiles[start] & _HOT > 0) & (tiles[start] & _CHAIN > 0)
    name[long] = mix(name[long])
    _, one = np.unique(name, return_index=True)
    one = one[size[one] > 1]
    start, size, name, long = start[one], size[one], name[one], long[one]

    def members(start, size):
        return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))

    short = members(start[~long], size[~long])
    first = members(start[long], size[long] - 1)
    pair = mix(np.repeat(name[long], size[long] - 1) ^ mix(rid[first].astype(np.uint64)))
    lists = np.concatenate([np.repeat(name[~long], size[~long]), pair, pair]).view(np.int64)
    chain = np.repeat([False, True], [len(short), 2 * len(first)])
    return pa.table([pa.array(lists), pa.array(np.concatenate([rid[short], rid[first], rid[first + 1]])), pa.array(chain)], names=["list", "rid", "chain"])


def _survivors(n: np.ndarray, sigs: dict[int, np.ndarray], width: np.ndarray, row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) size ratio and bit counts leave possible. ``sigs``: per width the bitmaps; ``row``: each one's row there."""
    ok = np.flatnonzero(np.minimum(n[i], n[j]) * 100 >= 75 * np.maximum(n[i], n[j]))
    out = np.zeros(len(i), bool)
    pair = width[i[ok]] << 32 | width[j[ok]]
    for key in np.unique(pair).tolist():
        k = ok[pair == key]
        a, b = sigs[key >> 32][row[i[k]]], sigs[key & 0xFFFFFFFF][row[j[k]]]
        while a.shape[1] > b.shape[1]:
            a = a[:, : a.shape[1] // 2] | a[:, a.shape[1] // 2 :]
        while b.shape[1] > a.shape[1]:
            b = b[:, : b.shape[1] // 2] | b[:, b.shape[1] // 2 :]
        na, nb = n[i[k]], n[j[k]]
        most = np.minimum(na - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
        out[k] = 100 * most >= 75 * (na + nb - most)
    return out


def _candidates(batches):
    """Edges (a, b) between set keys that share a list and may reach the threshold; the pairs of a chain as they are."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    name, skey, n, chain = (t[c].to_numpy() for c in ("list", "skey", "n", "chain"))
    order = np.lexsort((skey, name))
    name, skey, n, chain = name[order], skey[order], n[order], chain[order]
    raw = t["sig"].to_pylist()
    raw = [raw[k] or b"" for k in order.tolist()]
    width = np.array([len(r) for r in raw])
    sigs, row = {}, np.zeros(len(raw), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        sigs[w] = np.frombuffer(b"".join(raw[k] for k in at.tolist()), np.uint64).reshape(len(at), -1)
        row[at] = np.arange(len(at))
    start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    size = np.diff(np.append(start, len(name)))
    tied = start[chain[start] & (size == 2)]
    # which sets hang together is all that counts here: each points to the smallest of its group
    a, b = local_forest(skey[tied], skey[tied + 1])
    start, size = start[~chain[start]], size[~chain[start]]
    for m in np.unique(size[size > 1]).tolist():
        at = start[size == m]
        x, y = np.triu_indices(m, 1)
        for k in range(0, len(at), max(1, 500_000 // len(x))):
            some = at[k : k + max(1, 500_000 // len(x)), None]
            i, j = (some + x).ravel(), (some + y).ravel()
            ok = _survivors(n, sigs, width, row, i, j)
            a, b = local_forest(np.concatenate([a, skey[i[ok]]]), np.concatenate([b, skey[j[ok]]]))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _verify(ids: np.ndarray, n: np.ndarray, sigs: list[bytes], arrays: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[list, list]:
    """Links (as a spanning forest) among ``left`` x ``right`` members (all pairs if they are the same)."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bits = 64 * min((len(s) // 8 for s in sigs), default=1)
    bits = max(bits, min(512, 64 * max((len(s) // 8 for s in sigs), default=1)))
    same_width = [np.frombuffer(s, np.uint64) for s in sigs]
    width = bits // 64
    # a narrower bitmap of a small set is repeated: bit i of the wide one may only come from bit i mod its size
    grid = np.stack([fold(s, bits) if len(s) >= width else np.tile(s, width // len(s)) for s in same_width])
    narrow = np.array([len(s) < width for s in same_width])
    out_a, out_b = [], []
    right_sorted = right[np.argsort(n[right], kind="stable")]
    sizes = n[right_sorted]
    same = left is right
    for x in left[np.argsort(n[left], kind="stable")].tolist():
        lo = int(np.searchsorted(sizes, -(-75 * n[x] // 100), "left"))
        hi = int(np.searchsorted(sizes, n[x], "right")) if same else int(np.searchsorted(sizes, 100 * n[x] // 75, "right"))
        c = right_sorted[lo:hi]
        if not len(c):
            continue
        miss_x = np.bitwise_count(grid[x] & ~grid[c]).sum(1, dtype=np.int64) if not narrow[x] else np.zeros(len(c), np.int64)
        miss_c = np.bitwise_count(grid[c] & ~grid[x]).sum(1, dtype=np.int64)
        miss_c[narrow[c]] = 0
        most = np.minimum(n[x] - miss_x, n[c] - miss_c)
        c = c[100 * most >= 75 * (n[x] + n[c] - most)]
        for y in c.tolist():
            if x == y or root(x) == root(y):
                continue
            both = len(np.intersect1d(arrays[x], arrays[y], assume_unique=True))
            if 100 * both >= 75 * (n[x] + n[y] - both):
                parent[root(x)] = root(y)
                out_a.append(int(ids[x]))
                out_b.append(int(ids[y]))
    return out_a, out_b


def _tile_links(group: pa.Table) -> pa.Table:
    side = group["side"].to_numpy()
    ids = group["skey"].to_numpy()
    arrays = [np.frombuffer(k, np.uint64) for k in group["keys"].to_pylist()]
    n = np.array([len(k) for k in arrays], np.int64)
    off = np.concatenate([[0], np.cumsum(n)])
    sigs = signatures(np.concatenate(arrays), off)
    left = np.flatnonzero(side != 1)
    right = left if (side == 2).all() else np.flatnonzero(side != 0)
    a, b = _verify(ids, n, sigs, arrays, left, right)
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row (doc_id, n_shingles, skey), and the links between set keys as (a, b), enough to connect what is connected; both are read from scratch files that ``discard`` deletes."""
    src = text_of(docs, F.col("doc_id").cast("bigint").alias("doc_id"))
    nb = n_buckets(docs, 2, 32)
    passed = save(_passed(src, _sketch(src), nb), "shingle-sets")
    rows = passed.where("bucket is null").select("rid", "doc_id", "n", "skey", "sig")
    met = passed.where("bucket is not null").select("bucket", "rid", "tiles", "at").groupBy("bucket").applyInArrow(_lists, "list bigint, rid bigint, chain boolean").distinct()
    full = rows.where("n > 0")
    met = met.join(full.select("rid", "skey", "n", "sig"), "rid").select("list", "skey", "n", "chain", F.when(~F.col("chain"), F.col("sig")).alias("sig"))
    edges = met.repartition(nb, "list").dropDuplicates(["list", "skey"]).mapInArrow(_candidates, "a bigint, b bigint")
    found = components(edges)
    group_of = save(found, "candidates")  # node, root
    discard(found)
    # one text for each set that has candidates
    own = full.groupBy("skey").agg(F.min(F.struct("rid", "doc_id")).alias("r"), F.first("n").alias("n"))
    wanted = group_of.join(own, group_of["node"] == own["skey"]).select("root", "skey", "n", F.coalesce(F.col("r.doc_id"), F.lit(_NO_ID)).alias("kid"))
    wanted = save(wanted, "wanted")
    discard(group_of)
    few = sieve(wanted.select("kid"))
    texts = src.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("kid"), "text").where(few("kid")).join(wanted.select("kid").distinct(), "kid", "left_semi")

    def arrays(batches):
        for b in batches:
            text = b.column("text")
            for lo, hi in slices(text):
                keys, off = sets_of(text.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_keys(keys, off)), pa.array([keys[x:y].tobytes() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())],
                    ["skey", "keys"],
                )

    sets = texts.mapInArrow(arrays, "skey bigint, keys binary").dropDuplicates(["skey"])
    # tiles: bands of sizes, cut again by hash where a band of a candidate group is large
    tiled = wanted.withColumn("band", F.floor(F.log("n") / F.lit(float(_BAND)) + 1e-9).cast("int"))
    per = F.least(F.lit(float(TILE)), F.greatest(F.lit(8.0), F.floor(F.lit(float(TILE_SIZE)) / F.exp((F.col("band") + 1) * F.lit(float(_BAND))))))
    wide = tiled.groupBy("root", "band").agg(F.ceil(F.count("*") / per).cast("int").alias("cuts"))
    tiled = tiled.join(wide, ["root", "band"]).withColumn("cut", F.pmod(F.xxhash64("skey"), F.col("cuts")).cast("int"))
    near = wide.select("root", (F.col("band") - 1).alias("band"), F.col("cuts").alias("up"))
    below = wide.select("root", (F.col("band") + 1).alias("band"), F.col("cuts").alias("down"))
    tiled = tiled.join(near, ["root", "band"], "left").join(below, ["root", "band"], "left").na.fill(0, ["up", "down"])
    inside = F.expr("transform(sequence(0, cuts - 1), j -> named_struct('band', band, 'i', least(cut, j), 'other', 0, 'j', greatest(cut, j), 'side', if(j = cut, 2, if(cut < j, 0, 1))))")
    upward = F.expr("if(up > 0, transform(sequence(0, up - 1), j -> named_struct('band', band, 'i', cut, 'other', 1, 'j', j, 'side', 0)), array())")
    downward = F.expr("if(down > 0, transform(sequence(0, down - 1), j -> named_struct('band', band - 1, 'i', j, 'other', 1, 'j', cut, 'side', 1)), array())")
    dealt = tiled.select("root", "skey", F.explode(F.concat(inside, upward, downward)).alias("t")).select("root", "skey", "t.*")
    verified = dealt.join(sets, "skey").groupBy("root", "band", "i", "other", "j").applyInArrow(_tile_links, "a bigint, b bigint")
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), "skey")
    rows._scratch, verified._scratch = passed._scratch, wanted._scratch
    return rows, verified


_NO_ID = -(1 << 63)


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row (doc_id, n_shingles, skey), and per set key (k) the root and the smallest id of its component."""
    rows, found = links(docs)
    linked = components(found)
    discard(found)
    classes = rows.where("n_shingles > 0").groupBy("skey").agg(F.min("doc_id").alias("least"))
    named = classes.join(linked, classes["skey"] == linked["node"], "left").select("skey", "least", F.coalesce("root", "skey").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min_by("skey", F.struct(F.col("least").isNull(), "least", "skey")).alias("first"))
    named = named.join(names, "root").select(F.col("skey").alias("k"), "component_id", "first")
    named._scratch = linked._scratch
    return rows, named


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, named = _named(docs)
    return (
        rows.join(named, (rows["skey"] == named["k"]) & (rows["n_shingles"] > 0), "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns kept: the one with the smallest id (any, where ids are null or repeated); rows without words stay.

    Rows are told apart by id and set key, so an unrelated text that shares an id with a dropped one stays. Only rows whose id is
    null or repeated have their keys made anew.
    """
    all_rows, named = _named(docs)
    rows = save(
        all_rows.where("n_shingles > 0")
        .join(named, all_rows["skey"] == named["k"])
        .select("doc_id", "skey", ((F.col("skey") == F.col("first")) & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept")),
        "kept-sets",
    )
    discard(all_rows, named)
    own = docs.withColumn("__id", F.col("doc_id").cast("bigint"))
    many = save(docs.groupBy(F.col("doc_id").cast("bigint").alias("__id")).count().where("count > 1 and __id is not null").select("__id"), "repeated-ids")
    once = own.where("__id is not null").join(many, "__id", "left_anti")
    dropped = rows.where("not kept").select(F.col("doc_id").alias("__id"))
    # only texts that may be dropped are shuffled
    few = sieve(dropped)
    once = once.where(~few("__id")).unionByName(once.where(few("__id")).join(dropped.distinct(), "__id", "left_anti"))
    twice = own.where("__id is null").unionByName(own.join(many, "__id", "left_semi").select(own.columns))
    names = twice.columns

    def keyed(batches):
        for b in batches:
            text = b.column(b.num_columns - 1)
            for lo, hi in slices(text):
                keys, off = sets_of(text.slice(lo, hi - lo))
                skey = pa.array(set_keys(keys, off), mask=np.diff(off) == 0)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:-1]), skey], [*names, "__skey"])

    twice = twice.withColumn("__text", F.coalesce(F.col("text"), F.lit(""))).mapInArrow(keyed, StructType([*twice.schema.fields, StructField("__skey", LongType())]))
    good = rows.where("kept").select(F.col("doc_id").alias("__k"), F.col("skey").alias("__s")).distinct()
    same = twice.join(good, twice["__id"].eqNullSafe(good["__k"]) & (twice["__skey"] == good["__s"]), "left_semi")
    # copies of one id and set: any row of them, combined before the shuffle
    same = same.groupBy("__id", "__skey").agg(F.first(F.struct(*names)).alias("__row")).select("__row.*")
    return once.select(docs.columns).unionByName(same.select(docs.columns)).unionByName(twice.where("__skey is null").select(docs.columns))


__all__ = ["join", "keep_one", "links", "may_link", "set_keys", "sets_of", "signatures"]
