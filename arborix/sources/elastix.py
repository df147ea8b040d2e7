"""Elastix transform files: a reader and the transform they describe.

Fixed rules of the format: one ``(Key values...)`` a line, ``//`` comments, the last of equal keys counts; the initial transform
is looked up as written, relative to the file's own folder, then by base name there; ``Compose`` or ``Add`` joins a step to its initial one.
Outside its grid a B-spline leaves the point unchanged.
"""

from __future__ import annotations

import os
import re
import shlex

import numpy as np

from arborix.kernels.warp import affine_matrix, apply_affine, invert, lattice


def parse(text: str) -> dict[str, list[str]]:
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*\((\w+)\s*(.*?)\)\s*$", line.split("//")[0])
        if m:
            out[m[1]] = shlex.split(m[2])
    return out


def _floats(keys: dict, name: str, default=None) -> np.ndarray:
    return np.array([float(x) for x in keys[name]]) if name in keys else np.array(default, float)


def _turn(axis: int, angle: float) -> np.ndarray:
    m = np.eye(3)
    i, j = (axis + 1) % 3, (axis + 2) % 3
    m[i, i] = m[j, j] = np.cos(angle)
    m[i, j], m[j, i] = -np.sin(angle), np.sin(angle)
    return m


def _quaternion(v: np.ndarray) -> np.ndarray:
    w = np.sqrt(max(0.0, 1 - v @ v))
    cross = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + 2 * (w * cross + cross @ cross)


class Step:
    def __init__(self, keys: dict[str, list[str]]):
        self.kind = keys["Transform"][0]
        self.add = keys.get("HowToCombineTransforms", ["Compose"])[0] == "Add"
        p = _floats(keys, "TransformParameters", [])
        want = {"AffineTransform": 12, "EulerTransform": 6, "SimilarityTransform": 7, "TranslationTransform": 3}.get(self.kind)
        if want and len(p) != want:
            raise ValueError(f"{self.kind} takes {want} parameters, not {len(p)}")
        self.spline = "BSpline" in self.kind
        if self.spline:
            if keys.get("BSplineTransformSplineOrder", ["3"])[0] != "3":
                raise ValueError("only cubic splines are supported")
            self.size = _floats(keys, "GridSize").astype(int)
            self.index, self.spacing, self.origin = _floats(keys, "GridIndex", [0, 0, 0]), _floats(keys, "GridSpacing"), _floats(keys, "GridOrigin")
            self.direction = _floats(keys, "GridDirection", np.eye(3).ravel()).reshape(3, 3).T
            if (self.size < 4).any() or len(p) != 3 * self.size.prod():
                raise ValueError("the parameters do not fit the grid")
            self.coefficients = p.reshape(3, *self.size[::-1]).transpose(3, 2, 1, 0)
            return
        c = _floats(keys, "CenterOfRotationPoint", [0, 0, 0])
        if self.kind == "AffineTransform":
            a, t = p[:9].reshape(3, 3), p[9:]
        elif self.kind == "EulerTransform":
            x, y, z = (_turn(k, r) for k, r in enumerate(p[:3]))
            a, t = (z @ y @ x if keys.get("ComputeZYX", ["false"])[0] == "true" else z @ x @ y), p[3:]
        elif self.kind == "SimilarityTransform":
            a, t = p[6] * _quaternion(p[:3]), p[3:6]
        elif self.kind == "TranslationTransform":
            a, t = np.eye(3), p
        else:
            raise ValueError(f"unknown transform: {self.kind}")
        self.affine = affine_matrix(a, c + t - a @ c)

    def grid(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.origin) @ np.linalg.inv(self.direction).T) / self.spacing

    def inside(self, x: np.ndarray) -> np.ndarray:
        u = self.grid(x)
        return ((u >= self.index + 1) & (u < self.index + self.size - 2)).all(1)

    def displaced(self, x: np.ndarray) -> np.ndarray:
        return x + lattice(self.grid(x) - self.index, self.coefficients)

    def __call__(self, x: np.ndarray, outside: str = "identity") -> np.ndarray:
        if not self.spline:
            return apply_affine(self.affine, x)
        out = x.copy() if outside == "identity" else np.full(x.shape, np.nan)
        ok = np.isfinite(x).all(1)
        ok[ok] = self.inside(x[ok])
        out[ok] = self.displaced(x[ok])
        return out

    def inverse(self, y: np.ndarray, seed_iter: int = 8, lattice_points: int = 16000, accuracy: float = 1e-3, **options) -> np.ndarray:
        if not self.spline:
            return apply_affine(np.linalg.inv(self.affine), y)
        lo = self.origin + (self.index + 1) * self.spacing
        hi = self.origin + (self.index + self.size - 2) * self.spacing
        seed = y.copy()
        for _ in range(seed_iter):
            seed = y - (self.displaced(np.clip(seed, lo, hi)) - np.clip(seed, lo, hi))
        best = np.full(y.shape, np.nan)
        starts = [seed, y]
        for start in starts:
            todo = np.isnan(best).any(1)
            if todo.any():
                got = invert(self.displaced, y[todo], start[todo], accuracy=accuracy, **options)
                ok = np.isfinite(got).all(1)
                ok[ok] = self.inside(got[ok])
                best[np.flatnonzero(todo)[ok]] = got[ok]
        todo = np.flatnonzero(np.isnan(best).any(1))
        if len(todo):
            side = max(2, round(lattice_points ** (1 / 3)))
            nodes = np.stack(np.meshgrid(*[np.linspace(a, b, side) for a, b in zip(lo, hi, strict=True)], indexing="ij"), -1).reshape(-1, 3)
            image = self.displaced(nodes)
            near = np.array([int(np.argmin(((image - p) ** 2).sum(1))) for p in y[todo]])
            got = invert(self.displaced, y[todo], nodes[near], accuracy=accuracy, **options)
            ok = np.isfinite(got).all(1)
            ok[ok] = self.inside(got[ok])
            best[todo[ok]] = got[ok]
        # outside its grid the transform is the identity
        todo = np.flatnonzero(np.isnan(best).any(1))
        same = todo[~self.inside(y[todo])] if len(todo) else todo
        best[same] = y[same]
        return best


class ElastixTransform:
    """Steps from the initial one to the last."""

    def __init__(self, steps: list[Step], paths: list[str] | None = None):
        self.steps, self.paths = steps, paths or []

    @property
    def kinds(self) -> list[str]:
        return [s.kind for s in self.steps]

    def _grids(self, name: str) -> list[np.ndarray]:
        return [getattr(s, name) for s in self.steps if s.spline]

    grid_size = property(lambda self: self._grids("size"))
    grid_spacing = property(lambda self: self._grids("spacing"))
    grid_origin = property(lambda self: self._grids("origin"))

    @property
    def affine(self) -> np.ndarray | None:
        """The composed matrix of a chain of linear steps; None with a spline or an Add."""
        if not self.invertible or any(s.spline for s in self.steps):
            return None
        out = np.eye(4)
        for s in self.steps:
            out = s.affine @ out
        return out

    @property
    def invertible(self) -> bool:
        return not any(s.add for s in self.steps[1:])

    def xform(self, x: np.ndarray, out_of_bounds: str = "identity") -> np.ndarray:
        x = np.asarray(x, float).reshape(-1, 3)
        out = self.steps[0](x, out_of_bounds)
        for s in self.steps[1:]:
            out = s(x, out_of_bounds) + out - x if s.add else s(out, out_of_bounds)
        return out

    def xform_inv(self, x: np.ndarray, **options) -> np.ndarray:
        if not self.invertible:
            raise ValueError("a chain with Add has no inverse")
        out = np.asarray(x, float).reshape(-1, 3)
        for s in self.steps[::-1]:
            out = s.inverse(out, **options)
        return out


def _chain(path: str) -> list[dict]:
    out, seen = [], set()
    while True:
        real = os.path.realpath(path)
        if real in seen:
            raise ValueError("the initial transforms form a circle")
        seen.add(real)
        with open(path, encoding="utf-8", errors="replace") as f:
            keys = parse(f.read())
        out.append(keys)
        first = keys.get("InitialTransformParametersFileName", keys.get("InitialTransformParameterFileName", ["NoInitialTransform"]))[0]
        if first == "NoInitialTransform":
            return out[::-1]
        here = os.path.dirname(path)
        options = [os.path.join(here, first), os.path.join(here, os.path.basename(first)), first]
        path = next((p for p in options if os.path.exists(p)), options[0])


def load_elastix_transform(paths: str | list[str]) -> ElastixTransform:
    paths = [paths] if isinstance(paths, str) else paths
    return ElastixTransform([Step(k) for p in paths for k in _chain(p)], paths)


def is_invertible(path: str) -> bool:
    """Whether no step after the initial one adds; parameters are not converted."""
    return not any(k.get("HowToCombineTransforms", ["Compose"])[0] == "Add" for k in _chain(path)[1:])
