"""Similarity of oriented point clouds. ``dots``: neuron_id, point_id, x, y, z, vx, vy, vz and optionally alpha.

Each neuron's points travel as one packed row. All-by-all scoring deals query and target blocks over the
grid of block pairs, so a neuron is sent once per block of partners, not once per pair; the diagonal is not computed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.kernels import clouds as k
from arborix.kernels.points import PointIndex
from arborix.operators.scores import SYMMETRIES, symmetrize
from arborix.schema import per_object

BLOCK = 64


def dotprops(points: DataFrame, n_neighbours: int = 20) -> DataFrame:
    """Tangents and alpha of each cloud (neuron_id, point_id, x, y, z)."""

    def fn(pdf):
        pdf = pdf.sort_values("point_id")
        v, alpha = k.tangents(pdf[["x", "y", "z"]].to_numpy(float), n_neighbours)
        return pdf.assign(vx=v[:, 0], vy=v[:, 1], vz=v[:, 2], alpha=alpha)[["neuron_id", "point_id", "x", "y", "z", "vx", "vy", "vz", "alpha"]]

    return per_object(points.select("neuron_id", "point_id", "x", "y", "z"), "neuron_id", fn, "neuron_id bigint, point_id bigint, " + ", ".join(f"{c} double" for c in ("x", "y", "z", "vx", "vy", "vz", "alpha")))


def _packed(dots: DataFrame, *columns: str) -> DataFrame:
    """neuron_id and its points as one array of structs in order of id."""
    have = [F.col(c).cast("double").alias(c) for c in columns if c in dots.columns]
    first = "point_id" if "point_id" in dots.columns else "cn_id"
    return dots.groupBy("neuron_id").agg(F.array_sort(F.collect_list(F.struct(first, *have))).alias("points"))


def _cloud(points: pa.StructArray) -> dict:
    """The points of one neuron as arrays, straight from the Arrow buffers."""
    names = [points.type.field(i).name for i in range(points.type.num_fields)]
    get = lambda c: points.field(c).to_numpy(zero_copy_only=False).astype(float)
    out = {"p": np.column_stack([get(c) for c in "xyz"])}
    if "vx" in names:
        out["v"] = np.column_stack([get(c) for c in ("vx", "vy", "vz")])
    out["alpha"] = get("alpha") if "alpha" in names else np.ones(len(points))
    out["type"] = get("cn_type") if "cn_type" in names else np.zeros(len(points))
    return out


def _clouds(ids: pa.ChunkedArray, points: pa.ChunkedArray) -> list[tuple[int, dict]]:
    """(neuron, cloud) of each row; ``flatten`` of a one-row slice takes only its own points."""
    points = points.combine_chunks() if isinstance(points, pa.ChunkedArray) else points
    return [(i, _cloud(points.slice(k, 1).flatten())) for k, i in enumerate(ids.to_pylist())]


def _grid(query: DataFrame, target: DataFrame, block: int) -> DataFrame:
    """Both sides dealt over the pairs of blocks, four a side at least: (qb, tb, side, neuron_id, points)."""
    nq, nt = (max(1, min(n, max(4, -(-n // block)))) for n in (df.select("neuron_id").distinct().count() for df in (query, target)))
    b = lambda n: F.pmod(F.xxhash64("neuron_id"), F.lit(n)).cast("int")
    q = query.select(b(nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nt - 1))).alias("tb"), F.lit("q").alias("side"), "neuron_id", "points")
    t = target.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), b(nt).alias("tb"), F.lit("t").alias("side"), "neuron_id", "points")
    # so many partitions whatever their size: small clouds would meet in one task
    return q.unionByName(t).repartition(int(query.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qb", "tb")


def _scored(grid: DataFrame, score, own, normalize: bool, same: bool) -> DataFrame:
    def fn(group: pa.Table) -> pa.Table:
        side = np.array(group["side"].to_pylist())
        of = {s: group.filter(pa.array(side == s)) for s in "qt"}
        clouds = {s: dict(_clouds(t["neuron_id"], t["points"])) for s, t in of.items()}
        rows = []
        for q, a in sorted(clouds["q"].items()):
            top = own(a)
            for t, b in sorted(clouds["t"].items()):
                s = top if same and q == t else score(a, b)
                rows.append((q, t, float(s / top if normalize and top else s)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["q", "t", "score"])

    return grid.groupBy("qb", "tb").applyInArrow(fn, "q bigint, t bigint, score double")


def _fold(forward: DataFrame, backward: DataFrame | None, symmetry: str | None) -> DataFrame:
    if symmetry in (None, "forward"):
        return forward
    if symmetry not in SYMMETRIES:
        raise ValueError(f"unknown symmetry: {symmetry}")
    if backward is None:
        return symmetrize(forward, symmetry)
    a, b = F.col("score"), F.col("back")
    how = {"mean": (a + b) / 2, "min": F.least(a, b), "max": F.greatest(a, b), "none": a}[symmetry]
    return forward.join(backward.select(F.col("t").alias("q"), F.col("q").alias("t"), F.col("score").alias("back")), ["q", "t"]).select("q", "t", how.alias("score"))


_DOT = ("x", "y", "z", "vx", "vy", "vz", "alpha")


def _limit(table: k.ScoreTable, limit_dist) -> float | None:
    return table.auto_limit if limit_dist == "auto" else limit_dist


def nblast_allbyall(dots: DataFrame, table: k.ScoreTable, normalize: bool = True, symmetry: str | None = None, use_alpha: bool = False, limit_dist=None, block: int = BLOCK) -> DataFrame:
    """(q, t, score) of all pairs; the diagonal is 1, or the raw self-hit."""
    clouds, limit = _packed(dots, *_DOT), _limit(table, limit_dist)
    s = _scored(_grid(clouds, clouds, block), lambda a, b: k.pair_score(a, b, table, use_alpha, limit), lambda a: k.self_score(a, table, use_alpha), normalize, True)
    return _fold(s, None, symmetry)


def nblast(query: DataFrame, target: DataFrame, table: k.ScoreTable, normalize: bool = True, symmetry: str | None = None, use_alpha: bool = False, limit_dist=None, block: int = BLOCK) -> DataFrame:
    """The same for queries against targets; other symmetries run the reverse pass too."""
    q, t, limit = _packed(query, *_DOT), _packed(target, *_DOT), _limit(table, limit_dist)
    run = lambda a, b: _scored(_grid(a, b, block), lambda x, y: k.pair_score(x, y, table, use_alpha, limit), lambda x: k.self_score(x, table, use_alpha), normalize, False)
    return _fold(run(q, t), None if symmetry in (None, "forward") else run(t, q), symmetry)


def nblast_pairs(query: DataFrame, pairs: DataFrame, table: k.ScoreTable, target: DataFrame | None = None, normalize: bool = True, use_alpha: bool = False, limit_dist=None) -> DataFrame:
    """The score of each listed pair (q, t), repeats kept."""
    q = _packed(query, *_DOT)
    t = q if target is None else _packed(target, *_DOT)
    limit, same = _limit(table, limit_dist), target is None
    met = pairs.select("q", "t").join(q.select(F.col("neuron_id").alias("q"), F.col("points").alias("qp")), "q").join(t.select(F.col("neuron_id").alias("t"), F.col("points").alias("tp")), "t").select("q", "t", "qp", "tp")

    def run(batches):
        for b in batches:
            out = []
            for (q, x), (u, y) in zip(_clouds(b.column("q"), b.column("qp")), _clouds(b.column("t"), b.column("tp")), strict=True):
                top = k.self_score(x, table, use_alpha)
                s = top if same and q == u else k.pair_score(x, y, table, use_alpha, limit)
                out.append(float(s / top if normalize and top else s))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("t"), pa.array(out, pa.float64())], ["q", "t", "score"])

    return met.mapInArrow(run, "q bigint, t bigint, score double")


def nblast_smart(dots: DataFrame, table: k.ScoreTable, t: float = 90, criterion: str = "percentile", downsample: int = 10, symmetry: str | None = None, **options) -> DataFrame:
    """(q, t, score, exact): coarse scores on every ``downsample``-th point, the best of each query scored exactly."""
    w = Window.partitionBy("neuron_id").orderBy("point_id")
    coarse = nblast_allbyall(dots.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") % downsample == 0).drop("_n"), table, **options)
    per = Window.partitionBy("q")
    if criterion == "percentile":
        pick = coarse.withColumn("cut", F.expr(f"percentile(score, {t / 100})").over(per)).where("score >= cut")
    elif criterion == "score":
        pick = coarse.where(F.col("score") >= t)
    elif criterion == "N":
        pick = coarse.withColumn("r", F.row_number().over(per.orderBy(F.desc("score"), "t"))).where(F.col("r") <= int(t))
    else:
        raise ValueError(f"unknown criterion: {criterion}")
    fine = nblast_pairs(dots, pick.select("q", "t"), table, **options).select("q", "t", F.col("score").alias("fine"))
    out = coarse.join(fine, ["q", "t"], "left").select("q", "t", F.coalesce("fine", "score").alias("score"), F.col("fine").isNotNull().alias("exact"))
    if symmetry in (None, "forward"):
        return out
    return _fold(out.select("q", "t", "score"), None, symmetry).join(out.select("q", "t", "exact"), ["q", "t"])


def nblast_knn(dots: DataFrame, table: k.ScoreTable, n: int = 20, n_candidates: int = 200, voxel: float = 20.0, symmetry: str = "mean", splat: bool = True, n_dirs: int = 3, target: DataFrame | None = None, **options) -> DataFrame:
    """(q, rank, t, score): the n best of each neuron among candidates that share cells of a coarse signature.

    Signatures (``n_dirs`` direction bins, 256 at most) are joined on their cells, candidates ranked by cosine, filled up by nearest
    centroid where fewer than n share a cell, and scored exactly. Without ``target`` neurons are compared among themselves: nobody
    is its own match and candidates count both ways. Missing ranks are padded with -1 and -infinity.
    """
    if n_dirs > 256:
        raise ValueError("at most 256 directions")
    same, other = target is None, dots if target is None else target
    both_sides = dots.select("x", "y", "z") if same else dots.select("x", "y", "z").unionByName(target.select("x", "y", "z"))
    low = both_sides.agg(*[F.min(c).alias(c) for c in "xyz"]).first()
    if low["x"] is None:
        return dots.sparkSession.createDataFrame([], "q bigint, rank int, t bigint, score double")
    origin = np.array([low[c] for c in "xyz"], float) - voxel

    def sign(pdf):
        cells = k.signature(pdf[["x", "y", "z"]].to_numpy(float), pdf[["vx", "vy", "vz"]].to_numpy(float), origin, voxel, splat, n_dirs)
        return pd.DataFrame({"neuron_id": pdf.neuron_id.iloc[0], "cell": list(cells), "w": list(cells.values())})

    cells = lambda df: per_object(df.select("neuron_id", "x", "y", "z", "vx", "vy", "vz"), "neuron_id", sign, "neuron_id bigint, cell bigint, w double")
    a, b = cells(dots).select(F.col("neuron_id").alias("q"), "cell", "w"), cells(other).select(F.col("neuron_id").alias("t"), "cell", F.col("w").alias("u"))
    met = a.join(b, "cell")
    cosine = (met.where("q <> t") if same else met).groupBy("q", "t").agg(F.sum(F.col("w") * F.col("u")).alias("cosine"))
    both = cosine.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "t"))).where(F.col("r") <= n_candidates).select("q", "t")
    if same:
        both = both.unionByName(both.select(F.col("t").alias("q"), F.col("q").alias("t"))).distinct()
    ids = dots.select(F.col("neuron_id").alias("q")).distinct()
    lacking = ids.join(both.groupBy("q").count(), "q", "left").where(F.coalesce("count", F.lit(0)) < n).select("q")
    center = lambda df: df.groupBy("neuron_id").agg(*[F.avg(c).alias(c) for c in "xyz"])
    both = both.unionByName(_fill(lacking, center(dots), center(other), n, same)).distinct()
    score = forward = nblast_pairs(dots, both, table, None if same else target, **options)
    if symmetry not in (None, "forward"):
        flip = both.select(F.col("t").alias("q"), F.col("q").alias("t"))
        score = _fold(forward, nblast_pairs(other, flip, table, None if same else dots, **options), symmetry)
    best = score.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "t"))).where(F.col("rank") <= n)
    slots = ids.select("q", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))
    return slots.join(best, ["q", "rank"], "left").select("q", "rank", F.coalesce("t", F.lit(-1)).alias("t"), F.coalesce("score", F.lit(float("-inf"))).alias("score"))


def _fill(lacking: DataFrame, queries: DataFrame, targets: DataFrame, n: int, same: bool) -> DataFrame:
    """The n nearest centroids of each lacking neuron: all targets as one index per batch of queries' partition, no pairs on the wire.

    Centroids are four numbers a neuron; they travel to every task, so they must be few enough for one (checked: ten million).
    """
    c = targets.select("neuron_id", "x", "y", "z")
    if c.count() > 10_000_000:
        raise ValueError("too many targets to fill short lists by nearest centroid; raise n_candidates or voxel")
    rows = c.toArrow().sort_by("neuron_id")
    shared = lacking.sparkSession.sparkContext.broadcast((rows["neuron_id"].to_numpy(), np.column_stack([rows[x].to_numpy() for x in "xyz"])))

    def run(batches):
        ids, xyz = shared.value
        index = PointIndex(xyz)
        for b in batches:
            if not len(ids) or not b.num_rows:
                continue
            q = b.column("q").to_numpy()
            near = index.neighbours(np.column_stack([b.column(x).to_numpy() for x in "xyz"]), min(n + same, len(ids)))
            who, t = np.repeat(q, near.shape[1]), ids[near].ravel()
            keep = who != t if same else np.ones(len(t), bool)
            place = np.cumsum(keep.reshape(near.shape), 1).ravel()
            keep &= place <= n
            yield pa.RecordBatch.from_arrays([pa.array(who[keep]), pa.array(t[keep])], ["q", "t"])

    return lacking.join(queries.withColumnRenamed("neuron_id", "q"), "q").mapInArrow(run, "q bigint, t bigint")


def synblast(connectors: DataFrame, table: k.ScoreTable, target: DataFrame | None = None, by_type: bool = True, cn_types=None, normalize: bool = True, symmetry: str | None = None, block: int = 8) -> DataFrame:
    """(q, t, score) from connectors (neuron_id, cn_id, x, y, z, cn_type); an empty choice of types is an error.

    Connectors at one place are one query, whatever their neurons, and one target of each neuron. Tasks pair a quarter of a type's
    places (one more for every 64 neurons) with about ``block`` target neurons; what finds no connector of its type is infinitely far.
    """

    def prepare(df):
        if cn_types is not None:
            df = df.where(F.col("cn_type").isin(*cn_types))
        if not df.limit(1).count():
            raise ValueError("no connectors are left")
        return df.select("neuron_id", *[F.col(c).cast("double").alias(c) for c in "xyz"], (F.col("cn_type") if by_type else F.lit(0)).cast("double").alias("cn_type"))

    q = prepare(connectors)
    t = q if target is None else prepare(target)
    run = lambda a, b: _synapses(a, b, table, normalize, target is None, block)
    return _fold(run(q, t), None if target is None or symmetry in (None, "forward") else run(t, q), symmetry)


def _synapses(query: DataFrame, target: DataFrame, table: k.ScoreTable, normalize: bool, same: bool, block: int) -> DataFrame:
    parts = int(query.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nq, nt = (df.select("neuron_id").distinct().count() for df in (query, target))
    qb, tb = max(4, -(-nq // BLOCK)), max(1, -(-nt // block))
    finite = [F.abs(F.col(c)) < float("inf") for c in ("x", "y", "z", "cn_type")]
    there = finite[0] & finite[1] & finite[2] & finite[3]
    places = lambda df: df.where(there).groupBy("cn_type", "x", "y", "z", "neuron_id").agg(F.count("*").alias("n"))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ["cn_type", "qb", "tb"]
    a = places(query).select("*", deal(qb, "x", "y", "z").alias("qb"), every(tb).alias("tb")).repartition(parts, *key)
    b = places(target).drop("n").select("*", every(qb).alias("qb"), deal(tb, "neuron_id").alias("tb")).repartition(parts, *key)

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=["q", "t", "hits", "score"])
        xyz = lambda x: np.column_stack([x[c].to_numpy() for c in "xyz"])
        (at, back), (ids, who) = np.unique(xyz(left), axis=0, return_inverse=True), np.unique(left["neuron_id"].to_numpy(), return_inverse=True)
        n, goal, points = left["n"].to_numpy(), right["neuron_id"].to_numpy(), xyz(right)
        hits, out = np.bincount(who, n).astype(np.int64), []
        for u in np.unique(goal).tolist():
            d, _ = k.nearest(at, points[goal == u])
            out.append((ids, np.full(len(ids), u), hits, np.bincount(who, n * table.values[table.row(d), table.column(1.0)][back.ravel()])))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["q", "t", "hits", "score"])

    met = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(fn, "q bigint, t bigint, hits bigint, score double")
    met = met.groupBy("q", "t").agg(F.sum("hits").alias("hits"), F.sum("score").alias("score"))
    own = query.groupBy(F.col("neuron_id").alias("q")).agg(F.count("*").alias("n"))
    top = F.col("n") * float(table.values[table.row(0.0), table.column(1.0)])
    far = float(table.values[table.row(np.inf), table.column(1.0)])
    total = F.coalesce("score", F.lit(0.0)) + (F.col("n") - F.coalesce("hits", F.lit(0))) * far
    if same:
        total = F.when(F.col("q") == F.col("t"), top).otherwise(total)
    if normalize:
        total = F.when(top == 0, total).otherwise(total / F.when(top != 0, top))
    pairs = own.crossJoin(target.select(F.col("neuron_id").alias("t")).distinct())
    return pairs.join(met, ["q", "t"], "left").select("q", "t", total.alias("score"))
