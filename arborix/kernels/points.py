"""Exact nearest points in NumPy: leaves of a balanced split of the points, with their boxes."""

from __future__ import annotations

import numpy as np


class PointIndex:
    """Points cut at medians of their widest axis into leaves of about the square root of their number.

    A query measures its distance to all boxes, then visits leaves from the nearest box on until no box is nearer than what it
    has. All queries of a block go together, one leaf each a round. Ties go to the lower row.
    """

    def __init__(self, points: np.ndarray, leaf: int | None = None):
        self.points = np.asarray(points, float)
        n = len(self.points)
        leaf = leaf or max(16, int(np.sqrt(n)))
        parts, done = [np.arange(n)] if n else [], []
        while parts:
            rows = parts.pop()
            if len(rows) <= leaf:
                done.append(np.sort(rows))
                continue
            p = self.points[rows]
            axis = int(np.argmax(np.ptp(p, axis=0)))
            order = np.argpartition(p[:, axis], len(rows) // 2)
            parts += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        width = max(map(len, done), default=1)
        self.rows = np.full((len(done), width), -1, np.int64)
        for k, rows in enumerate(done):
            self.rows[k, : len(rows)] = rows
        self.low = np.array([self.points[r].min(0) for r in done]).reshape(len(done), self.points.shape[1])
        self.high = np.array([self.points[r].max(0) for r in done]).reshape(len(done), self.points.shape[1])
        self.place = self.points[np.maximum(self.rows, 0)]

    def _blocks(self, queries: np.ndarray):
        step = max(1, (1 << 21) // max(1, self.rows.size // max(1, self.rows.shape[1]) + self.rows.shape[1]))
        for a in range(0, len(queries), step):
            q = queries[a : a + step]
            box = np.zeros((len(q), len(self.low)))
            for c in range(self.points.shape[1]):
                gap = np.maximum(np.maximum(self.low[:, c] - q[:, c : c + 1], q[:, c : c + 1] - self.high[:, c]), 0)
                box += gap * gap
            yield a, q, box

    def _leaf(self, q: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the points of one leaf for each query (infinite for padding), and their rows."""
        d = ((q[:, None] - self.place[leaf]) ** 2).sum(2)
        rows = self.rows[leaf]
        return np.where(rows >= 0, d, np.inf), rows

    def nearest(self, queries: np.ndarray, group: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and row of the nearest point (of another group than ``own``); infinite and -1 where there is none."""
        queries = np.asarray(queries, float)
        dist, row = np.full(len(queries), np.inf), np.full(len(queries), -1, np.int64)
        same = np.full(len(self.rows), -1)
        if group is not None and len(self.rows):
            g = np.where(self.rows >= 0, group[np.maximum(self.rows, 0)], group[self.rows[:, :1]])
            same = np.where((g == g[:, :1]).all(1), g[:, 0], -1)
        for a, q, box in self._blocks(queries):
            if group is not None:
                box = np.where(same == own[a : a + len(q), None], np.inf, box)
            best, at = np.full(len(q), np.inf), np.full(len(q), -1, np.int64)
            live = np.arange(len(q) if len(self.low) else 0)
            while len(live):
                leaf = np.argmin(box[live], 1)
                near = box[live, leaf]
                go = np.isfinite(near) & (near <= best[live])
                live, leaf = live[go], leaf[go]
                if not len(live):
                    break
                box[live, leaf] = np.inf
                d, rows = self._leaf(q[live], leaf)
                if group is not None:
                    d = np.where(group[np.maximum(rows, 0)] == own[a + live, None], np.inf, d)
                j = np.argmin(d, 1)
                d, rows = d[np.arange(len(j)), j], rows[np.arange(len(j)), j]
                better = (d < best[live]) | (d == best[live]) & np.isfinite(d) & (rows < at[live])
                best[live[better]], at[live[better]] = d[better], rows[better]
            dist[a : a + len(q)], row[a : a + len(q)] = best, at
        return dist, row

    def neighbours(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Rows of the k nearest points of each query, nearest first, ties to the lower row; k is at most the number of points."""
        queries = np.asarray(queries, float)
        out = np.empty((len(queries), k), np.int64)
        for a, q, box in self._blocks(queries):
            best, at = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
            live = np.arange(len(q))
            while len(live):
                leaf = np.argmin(box[live], 1)
                near = box[live, leaf]
                go = np.isfinite(near) & (near <= best[live, -1])
                live, leaf = live[go], leaf[go]
                if not len(live):
                    break
                box[live, leaf] = np.inf
                d, rows = self._leaf(q[live], leaf)
                d, rows = np.concatenate([best[live], d], 1), np.concatenate([at[live], np.where(rows < 0, np.iinfo(np.int64).max, rows)], 1)
                order = np.lexsort((rows, d), axis=1)[:, :k]
                best[live], at[live] = np.take_along_axis(d, order, 1), np.take_along_axis(rows, order, 1)
            out[a : a + len(q)] = at
        return out
