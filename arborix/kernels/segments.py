"""Resampling along linear segments (arrays of points from the distal end to the proximal end)."""

from __future__ import annotations

import heapq

import numpy as np


def every(seg: list[int], factor: int) -> list[int]:
    if factor < 1:
        raise ValueError("factor must be 1 or more")
    return seg[::factor]


def segment_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of points to the segment a-b (ends included)."""
    ab = b - a
    t = np.clip(((p - a) @ ab) / max(ab @ ab, 1e-300), 0, 1)
    return np.linalg.norm(p - (a + t[:, None] * ab), axis=1)


def rdp(seg: list[int], xyz: np.ndarray, epsilon: float) -> list[int]:
    """Interior points that bend the segment by more than epsilon; the first worst splits."""
    pts, keep, stack = xyz[seg], set(), [(0, len(seg) - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        d = segment_distance(pts[lo + 1 : hi], pts[lo], pts[hi])
        k = int(np.argmax(d))
        if d[k] > epsilon:
            k += lo + 1
            keep.add(k)
            stack += [(lo, k), (k, hi)]
    return [seg[k] for k in sorted(keep)]


def triangle_area(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    u, v = b - a, c - a
    return 0.5 * float(np.sqrt(max((u @ u) * (v @ v) - (u @ v) ** 2, 0.0)))


def visvalingam(seg: list[int], xyz: np.ndarray, min_area: float) -> list[int]:
    """Interior points left after the smallest triangles below min_area went; ties to the lower position."""
    n, pts = len(seg), xyz[seg]
    if n <= 2:
        return []
    before, after, version, gone = [*range(-1, n - 1)], [*range(1, n + 1)], [0] * n, [False] * n
    heap = [(triangle_area(pts[k - 1], pts[k], pts[k + 1]), k, 0) for k in range(1, n - 1)]
    heapq.heapify(heap)
    while heap:
        area, k, v = heapq.heappop(heap)
        if gone[k] or v != version[k]:
            continue
        if area >= min_area:
            break
        gone[k] = True
        a, b = before[k], after[k]
        after[a], before[b] = b, a
        for m in (a, b):
            if 0 < m < n - 1:
                version[m] += 1
                heapq.heappush(heap, (triangle_area(pts[before[m]], pts[m], pts[after[m]]), m, version[m]))
    return [seg[k] for k in range(1, n - 1) if not gone[k]]


def arc(pts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(pts, axis=0), axis=1))])


def parts_of(length: float, spacing: float) -> int:
    """Equal parts of about ``spacing``; halves round away from zero."""
    return max(1, int(np.floor(length / spacing + 0.5)))


def moving_mean(seg: list[int], xyz: np.ndarray, window: int) -> np.ndarray:
    half, pts, n = (window - (window % 2 == 0)) // 2, xyz[seg], len(seg)
    total = np.concatenate([np.zeros((1, pts.shape[1])), np.cumsum(pts, axis=0)])
    k = np.arange(n)
    h = np.minimum(half, np.minimum(k, n - 1 - k))
    return (total[k + h + 1] - total[k - h]) / (2 * h + 1)[:, None]


def gaussian_mean(seg: list[int], xyz: np.ndarray, sigma: float, truncate: float) -> np.ndarray:
    """Weighted mean over cable distance; beyond an end the points are reflected about it. Ends stay."""
    pts = xyz[seg]
    at, cut = arc(pts), truncate * sigma
    all_at = np.concatenate([-at[1:][::-1], at, 2 * at[-1] - at[:-1][::-1]])
    all_pts = np.concatenate([2 * pts[0] - pts[1:][::-1], pts, 2 * pts[-1] - pts[:-1][::-1]])
    out = pts.copy()
    for k in range(1, len(seg) - 1):
        lo, hi = np.searchsorted(all_at, at[k] - cut, "left"), np.searchsorted(all_at, at[k] + cut, "right")
        w = np.exp(-((all_at[lo:hi] - at[k]) ** 2) / (2 * sigma**2))
        out[k] = (w[:, None] * all_pts[lo:hi]).sum(0) / w.sum()
    return out
