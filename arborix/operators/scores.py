"""Score-table operators. ``scores``: q, t, score; an absent or NaN cell never matches.

Ties go to the lower t. Similarities rank downwards, distances upwards; thresholds are inclusive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.schema import per_object

SYMMETRIES = ("mean", "min", "max", "none")


def _cells(scores: DataFrame, axis: int, skip_self: bool) -> DataFrame:
    """grp, other, score of usable cells; axis 1 ranks each q's targets, axis 0 each t's queries."""
    g, o = ("q", "t") if axis == 1 else ("t", "q")
    out = scores.select(F.col(g).alias("grp"), F.col(o).alias("other"), F.col("score").cast("double").alias("score"))
    out = out.where("score is not null and not isnan(score)")
    return out.where("grp <> other") if skip_self else out


def top_matches(scores: DataFrame, n: int, axis: int = 1, distances: bool = False, skip_self: bool = False) -> DataFrame:
    """(grp, rank, other, score): the n best; missing ranks are padded with -1 and NaN."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    cells = _cells(scores, axis, skip_self).where("score < double('infinity')" if distances else "score > double('-infinity')")
    best = F.col("score").asc() if distances else F.col("score").desc()
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(best, "other"))).where(F.col("rank") <= n)
    slots = scores.select(F.col("q" if axis == 1 else "t").alias("grp")).distinct().select("grp", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))
    return slots.join(ranked, ["grp", "rank"], "left").select("grp", "rank", F.coalesce("other", F.lit(-1)).alias("other"), F.coalesce("score", F.lit(float("nan"))).alias("score"))


def _above(scores, threshold, percentage, axis, distances, skip_self):
    if (threshold is None) == (percentage is None):
        raise ValueError("give a threshold or a percentage")
    cells = _cells(scores, axis, skip_self)
    if threshold is not None:
        return cells.where(F.col("score") <= threshold if distances else F.col("score") >= threshold)
    w = Window.partitionBy("grp")
    best = (F.min("score") if distances else F.max("score")).over(w)
    band = F.abs(best * F.lit(float(percentage)))
    return cells.withColumn("cut", best + band if distances else best - band).where(F.col("score") <= F.col("cut") if distances else F.col("score") >= F.col("cut")).drop("cut")


def matches_above(scores: DataFrame, threshold: float | None = None, percentage: float | None = None, axis: int = 1, distances: bool = False, skip_self: bool = False, max_matches: int | None = None) -> DataFrame:
    """(grp, rank, other, score) of all cells within the threshold, or within a share of the group's own best."""
    hits = _above(scores, threshold, percentage, axis, distances, skip_self)
    if max_matches is not None and hits.count() > max_matches:
        raise ValueError(f"more than {max_matches} matches")
    best = F.col("score").asc() if distances else F.col("score").desc()
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(best, "other"))).select("grp", "rank", "other", "score")


def count_matches(scores: DataFrame, threshold: float | None = None, percentage: float | None = None, axis: int = 1, distances: bool = False, skip_self: bool = False) -> DataFrame:
    """(grp, n) without building the matches; groups without any have 0."""
    hits = _above(scores, threshold, percentage, axis, distances, skip_self).groupBy("grp").agg(F.count("*").alias("n"))
    return scores.select(F.col("q" if axis == 1 else "t").alias("grp")).distinct().join(hits, "grp", "left").na.fill(0, ["n"])


def symmetrize(scores: DataFrame, symmetry: str = "mean") -> DataFrame:
    """Each cell combined with its mirror; ``none`` takes the upper triangle for both."""
    if symmetry not in SYMMETRIES:
        raise ValueError(f"unknown symmetry: {symmetry}")
    other = scores.select(F.col("t").alias("q"), F.col("q").alias("t"), F.col("score").alias("back"))
    a, b = F.col("score"), F.col("back")
    how = {"mean": (a + b) / 2, "min": F.least(a, b), "max": F.greatest(a, b), "none": F.when(F.col("q") <= F.col("t"), a).otherwise(b)}[symmetry]
    return scores.join(other, ["q", "t"]).select("q", "t", how.alias("score"))


def condensed_distances(scores: DataFrame, symmetry: str = "mean", transform: str = "one_minus") -> DataFrame:
    """(a, b, distance) for a < b; non-finite values are an error, the diagonal is never read."""
    if transform not in ("one_minus", "none"):
        raise ValueError(f"unknown transform: {transform}")
    upper = symmetrize(scores.where("q <> t"), symmetry).where("q < t")
    d = 1 - F.col("score") if transform == "one_minus" else F.col("score")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return upper.select(F.col("q").alias("a"), F.col("t").alias("b"), F.when(bad, F.raise_error(F.lit("scores must be finite"))).otherwise(d).alias("distance"))


def condensed_len(n: int) -> int:
    return n * (n - 1) // 2


def observations_from_condensed(m: int) -> int:
    n = int((1 + np.sqrt(1 + 8 * m)) // 2)
    if condensed_len(n) != m:
        raise ValueError(f"{m} is not a triangular number")
    return n


METHODS = ("single", "complete", "average", "weighted", "ward", "centroid", "median")


def _updated(method: str, x, y, dij: float, a: float, b: float, c: np.ndarray) -> np.ndarray:
    """Distances of the union of two clusters (sizes a and b, distances x and y, dij apart) to all others (sizes c): Lance-Williams."""
    if method == "single":
        return np.minimum(x, y)
    if method == "complete":
        return np.maximum(x, y)
    if method == "average":
        return (a * x + b * y) / (a + b)
    if method == "weighted":
        return (x + y) / 2
    if method == "ward":
        return ((a + c) * x + (b + c) * y - c * dij) / (a + b + c)
    if method == "centroid":
        return (a * x + b * y) / (a + b) - a * b * dij / (a + b) ** 2
    return (x + y) / 2 - dij / 4


def linkage_matrix(d: np.ndarray, method: str) -> np.ndarray:
    """Merges [c1, c2, distance, size] of a square distance matrix.

    Methods whose unions never come nearer follow a chain of nearest neighbours and merge where it turns back (n * n steps in all),
    and the merges are sorted; centroid and median, whose unions may, merge the closest pair each time, from kept row minima.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    n = len(d)
    squared = method in ("ward", "centroid", "median")
    d = (d**2 if squared else d).astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, live = np.ones(n), np.ones(n, bool)
    merges = np.zeros((max(n - 1, 0), 3))  # two members' slots and the distance

    def union(i: int, j: int) -> None:
        """Slot i takes over slot j."""
        new = np.where(live, _updated(method, d[i], d[j], d[i, j], size[i], size[j], size), np.inf)
        new[[i, j]] = np.inf
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        live[j] = False
        size[i] += size[j]

    if method in ("centroid", "median"):
        low = d.argmin(1) if n else np.zeros(0, np.int64)
        for step in range(n - 1):
            best = np.where(live, d[np.arange(n), low], np.inf)
            i = int(np.argmin(best))
            i, j = sorted((i, int(low[i])))
            merges[step] = i, j, d[i, j]
            union(i, j)
            stale = live & ((low == i) | (low == j) | (d[i] < d[np.arange(n), low]) | (d[i] == d[np.arange(n), low]) & (i < low))
            stale[i] = live[i]
            for k in np.flatnonzero(stale).tolist():
                low[k] = int(np.argmin(d[k]))
    else:
        chain: list[int] = []
        for step in range(n - 1):
            if not chain:
                chain = [int(np.argmax(live))]
            while True:
                x = chain[-1]
                y = int(np.argmin(d[x]))
                if len(chain) > 1 and d[x, chain[-2]] <= d[x, y]:
                    y = chain[-2]
                    break
                chain.append(y)
            del chain[-2:]
            i, j = sorted((x, y))
            merges[step] = i, j, d[i, j]
            union(i, j)
        merges = merges[np.argsort(merges[:, 2], kind="stable")]
    # slots to cluster names, in the order of the merges
    name, count, top, out = list(range(n)), [1] * n, list(range(n)), np.zeros((len(merges), 4))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for step, (i, j, h) in enumerate(merges.tolist()):
        i, j = find(int(i)), find(int(j))
        count[i] += count[j]
        out[step] = *sorted((name[i], name[j])), np.sqrt(max(h, 0)) if squared else h, count[i]
        top[j], name[i] = i, n + step
    return out


def leaf_order_of(z: np.ndarray) -> list[int]:
    """Leaves from left to right."""
    n, out, stack = len(z) + 1, [], [2 * len(z)] if len(z) else [0]
    while stack:
        c = int(stack.pop())
        if c < n:
            out.append(c)
        else:
            stack += [z[c - n, 1], z[c - n, 0]]
    return out


def _square(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.unique(np.concatenate([pdf.a, pdf.b]))
    d = np.full((len(ids), len(ids)), np.inf)
    i, j = np.searchsorted(ids, pdf.a), np.searchsorted(ids, pdf.b)
    d[i, j] = d[j, i] = pdf.distance
    return ids, d


def linkage(distances: DataFrame, method: str = "average") -> DataFrame:
    """(cluster_set, step, c1, c2, distance, size) of each set's condensed distances (cluster_set, a, b, distance).

    Observations number from 0 in order of id, merges from n on.
    """

    def fn(pdf):
        z = linkage_matrix(_square(pdf)[1], method)
        out = pd.DataFrame({"cluster_set": pdf.cluster_set.iloc[0], "step": np.arange(len(z)), "c1": z[:, 0], "c2": z[:, 1], "distance": z[:, 2], "size": z[:, 3]})
        return out.astype({"c1": "int64", "c2": "int64", "size": "int64"})

    return per_object(distances, "cluster_set", fn, "cluster_set bigint, step bigint, c1 bigint, c2 bigint, distance double, size bigint")


def leaf_order(merges: DataFrame) -> DataFrame:
    """(cluster_set, pos, leaf) of linkage rows."""

    def fn(pdf):
        leaves = leaf_order_of(pdf.sort_values("step")[["c1", "c2"]].to_numpy())
        return pd.DataFrame({"cluster_set": pdf.cluster_set.iloc[0], "pos": np.arange(len(leaves)), "leaf": leaves})

    return per_object(merges, "cluster_set", fn, "cluster_set bigint, pos bigint, leaf bigint")
