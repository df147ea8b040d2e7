"""Spatial transforms of point arrays (n, 3): thin-plate splines, moving least squares, lattice warps."""

from __future__ import annotations

import numpy as np


def _norms(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(2))


class Tps:
    """x -> A0 + A x + sum of |x - landmark| W."""

    def __init__(self, source, target=None, w=None, a=None):
        self.source = np.asarray(source, float).reshape(-1, 3)
        self.target = None if target is None else np.asarray(target, float).reshape(-1, 3)
        if w is not None:
            self.w, self.a = np.asarray(w, float), np.asarray(a, float)
            return
        n = len(self.source)
        if n < 4:
            raise ValueError("at least four landmarks are needed")
        p = np.column_stack([np.ones(n), self.source])
        system = np.block([[_norms(self.source, self.source), p], [p.T, np.zeros((4, 4))]])
        try:
            solved = np.linalg.solve(system, np.vstack([self.target, np.zeros((4, 3))]))
        except np.linalg.LinAlgError as e:
            raise ValueError("the landmarks do not fix a transform") from e
        if not np.isfinite(solved).all() or np.linalg.matrix_rank(p) < 4:
            raise ValueError("the landmarks do not fix a transform")
        self.w, self.a = solved[:n], solved[n:]

    def __neg__(self) -> Tps:
        return Tps(self.target, self.source)

    @property
    def matrix_affine(self) -> np.ndarray:
        return np.vstack([np.column_stack([self.a[1:].T, self.a[0]]), [0, 0, 0, 1]])

    def __call__(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        out = self.a[0] + x @ self.a[1:]
        for k in range(0, len(x), block):
            out[k : k + block] += _norms(x[k : k + block], self.source) @ self.w
        return out


class Mls:
    """Each point moves by the affine map that fits the landmarks best, weighted by 1 / (squared distance + eps)."""

    def __init__(self, source, target, reverse: bool = False):
        s, t = (np.asarray(x, float).reshape(-1, 3) for x in (source, target))
        self.source, self.target = (t, s) if reverse else (s, t)

    def __neg__(self) -> Mls:
        return Mls(self.target, self.source)

    def __call__(self, x: np.ndarray, block: int = 1024) -> np.ndarray:
        out = np.empty_like(x)
        for k in range(0, len(x), block):
            p = x[k : k + block]
            w = 1 / (((p[:, None] - self.source[None]) ** 2).sum(2) + np.finfo(float).eps)
            w /= w.sum(1, keepdims=True)
            ps, qs = w @ self.source, w @ self.target
            a, b = self.source[None] - ps[:, None], self.target[None] - qs[:, None]
            left = np.einsum("nl,nli,nlj->nij", w, a, a)
            right = np.einsum("nl,nli,nlj->nij", w, a, b)
            m = np.linalg.pinv(left) @ right
            out[k : k + block] = np.einsum("ni,nij->nj", p - ps, m) + qs
        return out


def affine_matrix(linear: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return np.vstack([np.column_stack([linear, shift]), [0, 0, 0, 1.0]])


def apply_affine(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ m[:3, :3].T + m[:3, 3]


def spline_weights(t: np.ndarray) -> np.ndarray:
    """The four uniform cubic B-spline weights of fractions t."""
    return np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3], axis=-1) / 6


def lattice(u: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Cubic B-spline at grid coordinates u (n, 3); coefficients (nx, ny, nz, 3); indices beyond the grid are clamped."""
    low = np.floor(u).astype(np.int64)
    w = spline_weights(u - low)
    out = np.zeros((len(u), 3))
    size = coefficients.shape
    at = [[np.clip(low[:, d] - 1 + k, 0, size[d] - 1) for k in range(4)] for d in range(3)]
    for i in range(4):
        for j in range(4):
            for k in range(4):
                out += (w[:, 0, i] * w[:, 1, j] * w[:, 2, k])[:, None] * coefficients[at[0][i], at[1][j], at[2][k]]
    return out


def invert(forward, target: np.ndarray, start: np.ndarray, low=None, high=None, max_iter: int = 50, tolerance: float = 1e-9, accuracy: float = 1e-3) -> np.ndarray:
    """Points that ``forward`` takes to ``target``, by Levenberg-Marquardt steps of the whole batch; NaN where it misses."""
    x = np.array(start, float)
    if low is not None:
        x = np.clip(x, low, high)
    damp = np.full(len(x), 1e-6)
    rest = forward(x) - target
    cost = (rest**2).sum(1)
    live = np.isfinite(cost)
    h = 1e-4
    for _ in range(max_iter):
        rows = np.flatnonzero(live)
        if not len(rows):
            break
        p = x[rows]
        jac = np.stack([(forward(p + h * e) - forward(p - h * e)) / (2 * h) for e in np.eye(3)], axis=2)
        normal = np.einsum("nki,nkj->nij", jac, jac)
        diag = np.einsum("nii->ni", normal)
        g = np.einsum("nki,nk->ni", jac, rest[rows])
        damped = normal + np.eye(3)[None] * (damp[rows][:, None] * np.maximum(diag, 1e-12))[:, :, None]
        step = -np.linalg.solve(damped, g[:, :, None])[:, :, 0]
        new = p + step
        if low is not None:
            new = np.clip(new, low, high)
        moved = np.linalg.norm(new - p, axis=1)
        r = forward(new) - target[rows]
        c = (r**2).sum(1)
        better = c < cost[rows]
        good = rows[better]
        x[good], rest[good], cost[good] = new[better], r[better], c[better]
        damp[rows] *= np.where(better, 0.3, 10.0)
        live[rows[(moved < tolerance) | (damp[rows] > 1e12)]] = False
    ok = np.sqrt(cost) <= accuracy
    return np.where(ok[:, None], x, np.nan)
