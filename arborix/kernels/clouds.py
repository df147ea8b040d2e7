"""Oriented point clouds: tangents, nearest points and pair scores."""

from __future__ import annotations

import numpy as np

from arborix.kernels.points import PointIndex


def nearest(query: np.ndarray, target: np.ndarray | PointIndex) -> tuple[np.ndarray, np.ndarray]:
    """Distance and row of each query's nearest target, ties to the lower row; infinite and -1 without targets."""
    d, row = (target if isinstance(target, PointIndex) else PointIndex(target)).nearest(query)
    return np.sqrt(d), row


def tangents(points: np.ndarray, k: int = 20, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Principal direction and (l1 - l2) / (l1 + l2 + l3) of the k nearest points, each itself included."""
    n = len(points)
    k = min(k, n)
    vect, alpha, index = np.zeros((n, 3)), np.zeros(n), PointIndex(points)
    for s in range(0, n, block):
        p = points[index.neighbours(points[s : s + block], k)]
        p = p - p.mean(1, keepdims=True)
        value, vector = np.linalg.eigh(np.einsum("nki,nkj->nij", p, p))
        v, total = vector[:, :, 2], value.sum(1)
        big = np.take_along_axis(v, np.argmax(np.abs(v), 1)[:, None], 1)
        v = v * np.where(big < 0, -1.0, 1.0)
        flat = total <= 1e-300
        v[flat] = [1.0, 0.0, 0.0]
        vect[s : s + block] = v
        alpha[s : s + block] = np.where(flat, 0.0, (value[:, 2] - value[:, 1]) / np.where(flat, 1, total))
    return vect, alpha


class ScoreTable:
    """A matrix of scores with the left edges of its distance rows and dot-product columns (left-closed bins)."""

    def __init__(self, values, distance_edges, dot_edges):
        self.values = np.asarray(values, float)
        self.distance, self.dot = np.asarray(distance_edges, float), np.asarray(dot_edges, float)

    def row(self, d) -> np.ndarray:
        return np.clip(np.searchsorted(self.distance, d, "right") - 1, 0, len(self.distance) - 1)

    def column(self, d) -> np.ndarray:
        return np.clip(np.searchsorted(self.dot, d, "right") - 1, 0, len(self.dot) - 1)

    @property
    def auto_limit(self) -> float:
        return 1.05 * float(self.distance[-1])

    def score(self, d, dot, limit: float | None = None) -> float:
        r, c = self.row(d), self.column(dot)
        if limit is not None:
            over = d > limit
            r, c = np.where(over, self.row(limit), r), np.where(over, self.column(0.0), c)
        return float(self.values[r, c].sum())


def read_scores(lines) -> ScoreTable:
    """A score table from CSV lines: a header of dot bins "(a,b]", then a distance bin and its scores a line."""
    import csv

    rows = list(csv.reader(lines))
    left = lambda x: float(x.strip("([]) ").split(",")[0])
    return ScoreTable([[float(v) for v in r[1:]] for r in rows[1:]], [left(r[0]) for r in rows[1:]], [left(c) for c in rows[0][1:]])


def _index(cloud: dict, name, points: np.ndarray) -> PointIndex:
    """The cloud's index of some of its points, made once."""
    held = cloud.setdefault("index", {})
    if name not in held:
        held[name] = PointIndex(points)
    return held[name]


def pair_score(q: dict, t: dict, table: ScoreTable, use_alpha: bool = False, limit: float | None = None) -> float:
    """Sum over the query's points of the score of its nearest target point."""
    d, j = nearest(q["p"], _index(t, "p", t["p"]))
    if not len(t["p"]):
        return table.score(d, np.zeros(len(d)), limit)
    dot = np.abs((q["v"] * t["v"][j]).sum(1))
    if use_alpha:
        dot = dot * np.sqrt(q["alpha"] * t["alpha"][j])
    return table.score(d, dot, limit)


def self_score(q: dict, table: ScoreTable, use_alpha: bool = False) -> float:
    if use_alpha:
        return float(table.values[0, table.column(q["alpha"])].sum())
    return float(table.values[0, -1] * len(q["p"]))


def directions(v: np.ndarray, n_dirs: int) -> np.ndarray:
    """The bin of each direction, whatever its sign: none, the dominant axis of three, or the nearest of ``n_dirs`` on a half sphere."""
    if n_dirs <= 1:
        return np.zeros(len(v), np.int64)
    if n_dirs == 3:
        return np.argmax(np.abs(v), 1)
    # a golden-angle spiral over the upper half
    k = np.arange(n_dirs) + 0.5
    z = 1 - k / n_dirs
    turn = np.pi * (3 - np.sqrt(5)) * k
    book = np.column_stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z])
    return np.argmax(np.abs(v @ book.T), 1)


def signature(p: np.ndarray, v: np.ndarray, origin: np.ndarray, voxel: float, splat: bool = True, n_dirs: int = 3) -> dict[int, float]:
    """Unit-length weights of (voxel, direction bin) cells: counts spread over eight voxels, damped by the square root."""
    u = (p - origin) / voxel - (0.5 if splat else 0.0)
    low = np.floor(u).astype(np.int64)
    frac = u - low
    way = directions(v, n_dirs)
    keys, weights = [], []
    for c in range(8 if splat else 1):
        bit = np.array([c & 1, c >> 1 & 1, c >> 2 & 1])
        weights.append(np.where(bit, frac, 1 - frac).prod(1) if splat else np.ones(len(p)))
        at = low + bit
        at = at + (1 << 17)
        keys.append((at[:, 0] << 44 | at[:, 1] << 26 | at[:, 2] << 8) | way)  # 18 bits a voxel, 8 a direction
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, np.concatenate(weights), len(key))
    cells = {x: y for x, y in zip(key.tolist(), total.tolist(), strict=True) if y > 0}
    norm = np.sqrt(sum(cells.values())) or 1.0
    return {k: np.sqrt(x) / norm for k, x in cells.items()}
