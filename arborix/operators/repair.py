"""Forest repair: bridges between fragments and rewiring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.kernels.forest import bfs_rewire, stitch
from arborix.operators.trees import NODE, _each, _with
from arborix.schema import need


def _segment_radius(f, radius: np.ndarray) -> np.ndarray:
    out = np.nan_to_num(np.asarray(radius, float))
    for seg in f.linear_segments():
        out[seg[:-1]] = np.nan_to_num(np.asarray(radius, float))[seg].mean()
    return out


def _bridges(f, p, method, max_dist, min_size, mask, use_radius):
    label = f.root()
    allowed = np.ones(f.n, bool) if method == "ALL" else np.isin(f.kinds(), (0, 1))
    if mask:
        allowed &= p[mask].to_numpy(bool)
    if min_size:
        allowed &= np.bincount(label, minlength=f.n)[label] >= min_size
    xyz = p[["x", "y", "z"]].to_numpy(float)
    if use_radius:
        xyz = np.column_stack([xyz, _segment_radius(f, p.radius) * float(use_radius)])
    return stitch(xyz, label, allowed, np.inf if max_dist is None else max_dist)


def stitch_fragments(nodes: DataFrame, mask: str | None = None, max_dist: float | None = None, use_radius: float | bool = False) -> DataFrame:
    """Bridges (a, b, length) that join a skeleton's components at minimal total length; ``max_dist`` inclusive."""
    need(nodes, "x", "y", "z")

    def fn(f, p):
        e = _bridges(f, p, "ALL", max_dist, 0, mask, use_radius)
        return pd.DataFrame({"a": f.ids[[x[0] for x in e]] if e else [], "b": f.ids[[x[1] for x in e]] if e else [], "length": [x[2] for x in e]}).astype({"a": "int64", "b": "int64", "length": float})

    return _each(nodes, fn, "skeleton_id bigint, a bigint, b bigint, length double", "x", "y", "z", "radius", *([mask] if mask else []))


def heal_skeleton(nodes: DataFrame, method: str = "ALL", max_dist: float | None = None, min_size: int = 0, mask: str | None = None, use_radius: float | bool = False) -> DataFrame:
    """(node_id, parent_id) after stitching, rewired at the first existing root."""
    if method not in ("ALL", "LEAFS"):
        raise ValueError(f"unknown method: {method}")

    def fn(f, p):
        e = [(f.ids[a], f.ids[b]) for a, b, _ in _bridges(f, p, method, max_dist, min_size, mask, use_radius)]
        roots = np.flatnonzero(f.is_root)
        return pd.DataFrame({"node_id": f.ids, "parent_id": bfs_rewire(f.ids, p.parent_id, e, f.ids[roots[0]] if len(roots) else None)})

    return _each(nodes, fn, f"{NODE}, parent_id bigint", "x", "y", "z", "radius", *([mask] if mask else []))


def reroot_rewire(nodes: DataFrame, new_edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Breadth-first forest over old and new edges (skeleton_id, a, b [, ord]) from the root, then by row.

    New edges count in the order of ``ord``; without it (and among equals) in the order of their ends.
    """
    order = F.col("ord").cast("bigint") if "ord" in new_edges.columns else F.lit(0).cast("bigint")
    edges = new_edges.select("skeleton_id", "a", "b", order.alias("ord"))
    if roots is not None:
        edges = edges.unionByName(roots.select("skeleton_id", F.col("node_id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("ord")))

    def fn(f, left, right):
        e = right.dropna(subset=["a", "b"]).sort_values(["ord", "a", "b"], kind="stable")
        want = right[right.b.isna()].a
        return pd.DataFrame({"node_id": f.ids, "parent_id": bfs_rewire(f.ids, left.parent_id, list(zip(e.a.astype(int), e.b.astype(int), strict=True)), int(want.iloc[0]) if len(want) else None)})

    return _with(nodes, edges, fn, f"{NODE}, parent_id bigint")
