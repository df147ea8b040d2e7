"""CMTK registrations: a typed-stream reader and the transform it describes.

Fixed rules of the format: the header line ``! TYPEDSTREAM v``; blocks ``name {`` ... ``}``; lists (``registration`` or
``registration.gz``) in directories; gzip by its magic bytes; degrees; versions before 2.4 compose scale and shear the
older way. Points outside [0, domain] fail (NaN); the affine inside a spline block is not used.
"""

from __future__ import annotations

import gzip
import os
import shlex

import numpy as np

from arborix.kernels.warp import affine_matrix, apply_affine, invert, lattice


class FormatError(ValueError):
    pass


def parse_stream(raw: bytes) -> tuple[str, dict]:
    """Version and nested blocks; values are lists of words, number lists run on over lines of numbers."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    lines = raw.decode("utf-8", "replace").splitlines()
    head = next((x for x in lines if x.strip()), "")
    if not head.startswith("! TYPEDSTREAM"):
        raise FormatError("not a typed stream")
    root: dict = {}
    stack, last = [root], None
    for line in lines[lines.index(head) + 1 :]:
        text = line.strip()
        if not text or text.startswith("!"):
            continue
        if text == "}":
            if len(stack) > 1:
                stack.pop()
            last = None
            continue
        if text.endswith("{"):
            name, block = text[:-1].strip(), {}
            if name in stack[-1]:
                raise FormatError(f"two blocks {name}")
            stack[-1][name] = block
            stack.append(block)
            last = None
            continue
        parts = shlex.split(text)
        if _numbers(parts) and last is not None:
            stack[-1][last] += parts
            continue
        if set(text) <= {"0", "1"} and last == "active":
            continue
        stack[-1].setdefault(parts[0], [])
        stack[-1][parts[0]] = parts[1:]
        last = parts[0]
    return head.split()[2] if len(head.split()) > 2 else "", root


def _numbers(parts: list[str]) -> bool:
    try:
        [float(p) for p in parts]
    except ValueError:
        return False
    return True


def _vector(block: dict, name: str, default: float) -> np.ndarray:
    return np.array([float(x) for x in block[name][:3]]) if name in block else np.full(3, default)


def affine_of(block: dict, legacy: bool = False) -> np.ndarray:
    """Rotations about z, y, x (in the format's sense), then scale and shear, about the centre."""
    (sa, ca), (sb, cb), (sg, cg) = ((np.sin(r), np.cos(r)) for r in np.radians(_vector(block, "rotate", 0)))
    about_z = np.array([[cg, sg, 0], [-sg, cg, 0], [0, 0, 1]])
    about_y = np.array([[cb, 0, sb], [0, 1, 0], [-sb, 0, cb]])
    about_x = np.array([[1, 0, 0], [0, ca, -sa], [0, sa, ca]])
    scale, shear, center = _vector(block, "scale", 1), _vector(block, "shear", 0), _vector(block, "center", 0)
    turn = about_z @ about_y @ about_x
    if legacy:
        lower = [np.eye(3) for _ in range(3)]
        for m, (r, c), s in zip(lower, ((1, 0), (2, 0), (2, 1)), shear, strict=True):
            m[r, c] = s
        linear = lower[0] @ lower[1] @ lower[2] @ turn @ np.diag(scale)
    else:
        upper = np.diag(scale)
        upper[0, 1], upper[0, 2], upper[1, 2] = shear
        linear = turn @ upper
    return affine_matrix(linear, _vector(block, "xlate", 0) + center - linear @ center)


class Registration:
    """One hop: an affine, and a cubic B-spline warp if the file has one."""

    def __init__(self, raw: bytes, path: str = ""):
        self.path = path
        self.version, root = parse_stream(raw)
        body = root.get("registration", root)
        try:
            legacy = float(self.version) < 2.4
        except ValueError:
            legacy = False
        spline = body.get("spline_warp")
        block = body.get("affine_xform") or (spline or {}).get("affine_xform")
        if block is None and spline is None:
            raise FormatError("neither an affine nor a spline warp")
        self.affine = affine_of(block, legacy) if block is not None else np.eye(4)
        self.has_spline = spline is not None
        if self.has_spline:
            self.dims = np.array([int(x) for x in spline["dims"][:3]])
            if (self.dims < 4).any():
                raise FormatError("a lattice needs four points a side")
            self.domain = _vector(spline, "domain", 0)
            self.spacing = self.domain / (self.dims - 3)
            self.origin = _vector(spline, "origin", 0) if "origin" in spline else -self.spacing
            self.absolute = spline.get("absolute", ["no"])[0] == "yes"
            c = np.array([float(x) for x in spline["coefficients"]])
            if len(c) != 3 * self.dims.prod():
                raise FormatError("the number of coefficients does not fit the lattice")
            self.coefficients = c.reshape(*self.dims[::-1], 3).transpose(2, 1, 0, 3)

    def _spline(self, x: np.ndarray) -> np.ndarray:
        s = lattice((x - self.origin) / self.spacing, self.coefficients)
        return s if self.absolute else x + s

    def forward(self, x: np.ndarray, affine_only: bool = False, extrapolate: bool = False) -> np.ndarray:
        if affine_only or not self.has_spline:
            return apply_affine(self.affine, x)
        ok = np.isfinite(x).all(1)
        if not extrapolate:
            ok &= ((x >= 0) & (x <= self.domain)).all(1)
        out = np.full(x.shape, np.nan)
        out[ok] = self._spline(x[ok])
        return out

    def backward(self, x: np.ndarray, affine_only: bool = False, guess=None, max_iter=50, tolerance=1e-9, accuracy=1e-3, clamp=True) -> np.ndarray:
        back = apply_affine(np.linalg.inv(self.affine), x)
        if affine_only or not self.has_spline:
            return back
        out = np.full(x.shape, np.nan)
        ok = np.isfinite(x).all(1)
        start = back if guess is None else np.broadcast_to(guess, x.shape)
        low, high = (np.zeros(3), self.domain) if clamp else (None, None)
        out[ok] = invert(self._spline, x[ok], start[ok], low, high, max_iter, tolerance, accuracy)
        return out


FALLBACKS = ("none", "chain", "hop")


class Chain:
    """Registrations applied one after the other, each forwards or backwards."""

    def __init__(self, hops: list[Registration]):
        self.hops = hops

    def _run(self, x, reverse, invert_flags, affine_only, extrapolate, fallback, options):
        flags = list(invert_flags) if invert_flags is not None else [False] * len(self.hops)
        steps = list(zip(self.hops, flags, strict=True))
        for hop, back in [(h, not f) for h, f in steps[::-1]] if reverse else steps:
            new = hop.backward(x, affine_only, **options) if back else hop.forward(x, affine_only, extrapolate)
            if fallback == "hop":
                bad = np.isnan(new).any(1) & ~np.isnan(x).any(1)
                if bad.any():
                    new[bad] = hop.backward(x[bad], True) if back else hop.forward(x[bad], True)
            x = new
        return x

    def xform(self, x: np.ndarray, transform: str = "warp", allow_extrapolation: bool = False, fallback_to_affine: str = "none", invert=None, reverse: bool = False, **options) -> np.ndarray:
        if transform not in ("warp", "affine") or fallback_to_affine not in FALLBACKS:
            raise ValueError("unknown transform or fallback")
        x = np.asarray(x, float).reshape(-1, 3)
        out = self._run(x, reverse, invert, transform == "affine", allow_extrapolation, fallback_to_affine, options)
        if fallback_to_affine == "chain":
            bad = np.isnan(out).any(1) & ~np.isnan(x).any(1)
            if bad.any():
                out[bad] = self._run(x[bad], reverse, invert, True, allow_extrapolation, "none", options)
        return out

    def xform_inv(self, x: np.ndarray, **options) -> np.ndarray:
        return self.xform(x, reverse=True, **options)


def _path(path: str) -> str:
    if os.path.isdir(path):
        for name in ("registration", "registration.gz"):
            if os.path.exists(os.path.join(path, name)):
                return os.path.join(path, name)
        raise FileNotFoundError(f"no registration in {path}")
    return path


def load_cmtk_registration(paths: str | list[str]) -> Chain:
    """A chain from local files or list directories; for other stores read the bytes with Spark and use ``Registration``."""
    hops = []
    for p in [paths] if isinstance(paths, str) else paths:
        with open(_path(p), "rb") as f:
            hops.append(Registration(f.read(), p))
    return Chain(hops)
