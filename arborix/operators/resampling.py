"""Resampling along linear segments; roots, leaves and branch points stay where they are.

The droppers give (node_id, parent_id, weight) of the kept nodes, and where every node went (node_id, target). ``preserve``
names a boolean column of extra nodes to keep.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from arborix.kernels import segments as k
from arborix.operators.trees import NODE, _each, rewired
from arborix.schema import need


def _xyz(p: pd.DataFrame) -> np.ndarray:
    return p[["x", "y", "z"]].to_numpy(float)


def _drop(nodes: DataFrame, choose, preserve: str | None, *more: str):
    def keep(f, p):
        out = f.topology()
        if preserve:
            out |= p[preserve].to_numpy(bool)
        pick = choose(p)
        for seg in f.linear_segments():
            out[pick(seg)] = True
        return out

    return rewired(nodes, keep, *more, *([preserve] if preserve else []))


def _of(choose, xyz: np.ndarray, limit: float):
    """The choice among one skeleton's coordinates, as a function of the segment."""
    return lambda seg: choose(seg, xyz, limit)


def downsample_skeleton(nodes: DataFrame, factor: int, preserve: str | None = None):
    """Every ``factor``-th node of a segment, counted from its distal end."""
    k.every([], factor)
    return _drop(nodes, lambda p: lambda seg: k.every(seg, factor), preserve)


def simplify_rdp(nodes: DataFrame, epsilon: float, preserve: str | None = None):
    need(nodes, "x", "y", "z")
    return _drop(nodes, lambda p: _of(k.rdp, _xyz(p), epsilon), preserve, "x", "y", "z")


def simplify_vw(nodes: DataFrame, min_area: float, preserve: str | None = None):
    need(nodes, "x", "y", "z")
    return _drop(nodes, lambda p: _of(k.visvalingam, _xyz(p), min_area), preserve, "x", "y", "z")


def resample_skeleton(nodes: DataFrame, spacing: float) -> DataFrame:
    """Equal steps of about ``spacing`` along each segment: (node_id, parent_id, x, y, z, source_child, source_parent, alpha).

    Roots, leaves and branch points come first and keep their ids; new nodes number on from the largest id. ``alpha`` is the place
    between the two source nodes, from the child's end.
    """
    if not spacing > 0:
        raise ValueError("spacing must be positive")

    need(nodes, "x", "y", "z")
    return _each(nodes, lambda f, p: _resampled(f, p, spacing), f"{NODE}, parent_id bigint, x double, y double, z double, source_child bigint, source_parent bigint, alpha double", "x", "y", "z")


def resample_node_map(nodes: DataFrame, spacing: float) -> DataFrame:
    """(node_id, target): the resampled node nearest along the cable to each old node."""
    if not spacing > 0:
        raise ValueError("spacing must be positive")
    need(nodes, "x", "y", "z")
    return _each(nodes, lambda f, p: _mapped(f, p, spacing), f"{NODE}, target bigint", "x", "y", "z")


def _laid(f, p: pd.DataFrame, spacing: float):
    """All segments one after the other: rows, first positions, lengths, place along the cable; and cable, parts and first new id of each."""
    xyz = _xyz(p)
    flat, count = f.linear_rows()
    first, at = np.cumsum(count) - count, np.zeros(len(flat))
    step = np.linalg.norm(np.diff(xyz[flat], axis=0), axis=1)
    for n in np.unique(count).tolist():  # row by row, so that sums round as those of one segment
        cells = first[count == n][:, None] + np.arange(1, n)
        at[cells] = np.cumsum(step[cells - 1], axis=1)
    total = at[first + count - 1]
    if not np.isfinite(total).all():
        raise ValueError("segments need finite coordinates")
    parts = np.maximum(1, np.floor(total / spacing + 0.5)).astype(np.int64)
    return xyz, flat, first, count, at, total, parts, int(f.ids.max(initial=-1)) + 1 + np.cumsum(parts - 1) - (parts - 1)


def _mapped(f, p: pd.DataFrame, spacing: float) -> pd.DataFrame:
    _, flat, first, count, at, total, parts, new = _laid(f, p, spacing)
    g, target = np.repeat(np.arange(len(count)), count), f.ids.copy()
    inner = np.arange(len(flat)) - first[g]
    inner = np.flatnonzero((inner > 0) & (inner < count[g] - 1))
    g = g[inner]
    whole = total[g] > 0
    j = np.where(whole, np.floor(at[inner] / np.where(whole, total[g], 1.0) * parts[g] + 0.5), 0).astype(np.int64)
    ends = np.where(j == 0, f.ids[flat[first[g]]], f.ids[flat[first[g] + count[g] - 1]])
    target[flat[inner]] = np.where((j == 0) | (j == parts[g]), ends, new[g] + j - 1)
    return pd.DataFrame({"node_id": f.ids, "target": target})


def _resampled(f, p: pd.DataFrame, spacing: float) -> pd.DataFrame:
    xyz, flat, first, count, at, total, parts, new = _laid(f, p, spacing)
    ids, stays, last = f.ids, np.flatnonzero(f.topology()), f.ids[flat[first + count - 1]]
    up = np.full(f.n, -1)
    up[flat[first]] = np.where(parts > 1, new, last)
    g = np.repeat(np.arange(len(count)), parts - 1)
    j = np.arange(len(g)) - np.repeat(np.cumsum(parts - 1) - (parts - 1), parts - 1) + 1
    t = total[g] * j / parts[g]
    # complex numbers are ordered by segment, then by place
    e = np.searchsorted(np.repeat(np.arange(len(count)), count) + 1j * at, g + 1j * t, "left") - 1
    e = np.minimum(e, first[g] + count[g] - 2)
    step = at[e + 1] - at[e]
    a = np.where(step > 0, (t - at[e]) / np.where(step > 0, step, 1.0), 0.0)
    place = xyz[flat[e]] * (1 - a)[:, None] + xyz[flat[e + 1]] * a[:, None]
    joined = lambda x, y: np.concatenate([x, y])
    return pd.DataFrame(
        {"node_id": joined(ids[stays], new[g] + j - 1), "parent_id": joined(up[stays], np.where(j < parts[g] - 1, new[g] + j, last[g]))}
        | {c: joined(xyz[stays, i], place[:, i]) for i, c in enumerate("xyz")}
        | {"source_child": joined(ids[stays], ids[flat[e]]), "source_parent": joined(ids[stays], ids[flat[e + 1]]), "alpha": joined(np.zeros(len(stays)), a)}
    )


def _smooth(nodes: DataFrame, mean) -> DataFrame:
    def fn(f, p):
        xyz = _xyz(p)
        out, fixed = xyz.copy(), f.topology()
        for seg in f.linear_segments():
            new = mean(seg, xyz)
            inner = [j for j, i in enumerate(seg) if not fixed[i]]
            out[[seg[j] for j in inner]] = new[inner]
        return pd.DataFrame({"node_id": f.ids, "x": out[:, 0], "y": out[:, 1], "z": out[:, 2]})

    need(nodes, "x", "y", "z")
    return _each(nodes, fn, f"{NODE}, x double, y double, z double", "x", "y", "z")


def smooth_skeleton(nodes: DataFrame, window: int = 5) -> DataFrame:
    """Moving mean; the window shrinks evenly towards the ends of a segment; an even window is one less."""
    return _smooth(nodes, lambda seg, xyz: k.moving_mean(seg, xyz, window))


def smooth_skeleton_gaussian(nodes: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    return _smooth(nodes, lambda seg, xyz: k.gaussian_mean(seg, xyz, sigma, truncate))
