"""Queries of the spatial transforms over all embeddings as points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from arborix.catalog.inputs import table
from arborix.kernels.warp import Mls, Tps
from arborix.operators import warps
from arborix.sources.cmtk import Chain, Registration
from arborix.sources.elastix import ElastixTransform, Step, parse

# corners of a box and their images, a bent box
SOURCE = np.array([[x, y, z] for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0)] + [[0.0, 0.0, 0.0]])
TARGET = SOURCE * [1.1, 0.9, 1.2] + [[0.1 * p[1] * p[2], 0.0, 0.2 * p[0]] for p in SOURCE]
LINEAR = SOURCE * 2 + [1.0, -1.0, 0.5]

_CMTK = """! TYPEDSTREAM 2.4
registration {
    affine_xform {
        xlate 1 2 3
        rotate 10 20 30
        scale 1.1 1.2 1.3
        shear 0.01 0.02 0.03
        center 4 5 6
    }
    spline_warp {
        absolute no
        dims 5 5 5
        domain 8 8 8
        origin -4 -4 -4
        coefficients %s
    }
}
"""
_ELASTIX = """(Transform "BSplineTransform")
(HowToCombineTransforms "Compose")
(GridSize 10 10 10)
(GridIndex 0 0 0)
(GridSpacing 4 4 4)
(GridOrigin -18 -18 -18)
(TransformParameters %s)
"""
_EULER = """(Transform "EulerTransform")
(TransformParameters 0.12 -0.2 0.31 4 1.5 -2.5)
(CenterOfRotationPoint 1 2 3)
(ComputeZYX "false")
"""


def cmtk() -> Chain:
    numbers = [f"{0.1 * (i % 5):g} {0.2 * (i // 5 % 5):g} {0.3 * (i // 25):g}" for i in range(125)]
    return Chain([Registration((_CMTK % " ".join(numbers)).encode())])


def elastix() -> ElastixTransform:
    numbers = " ".join(f"{0.3 * np.sin(i):.6f}" for i in range(3000))
    return ElastixTransform([Step(parse(_EULER)), Step(parse(_ELASTIX % numbers))])


def points(spark, sf_dir, scale=1.0, shift=0.0):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), *[(F.col("embedding")[k].cast("double") * scale + shift).alias(c) for k, c in enumerate("xyz")])


def _rounded(df):
    return df.withColumns({c: F.round(c, 5) for c in "xyz"})


def _q(fn, *place):
    return lambda spark, sf_dir: _rounded(fn(points(spark, sf_dir, *place)))


QUERIES = {
    "tps_xform": _q(lambda p: warps.tps(p, SOURCE, TARGET)),
    "tps_affine": _q(lambda p: warps.tps(p, SOURCE, LINEAR)),
    "tps_inverse": _q(lambda p: warps.xform(p, -Tps(SOURCE, TARGET))),
    "mls_xform": _q(lambda p: warps.mls(p, SOURCE, TARGET)),
    "mls_affine": _q(lambda p: warps.mls(p, SOURCE, LINEAR)),
    "mls_reverse": _q(lambda p: warps.xform(p, -Mls(SOURCE, TARGET))),
    "cmtk_xform": _q(lambda p: warps.xform(p, cmtk()), 2.0, 4.0),
    "cmtk_affine": _q(lambda p: warps.xform(p, cmtk(), transform="affine"), 2.0, 4.0),
    "cmtk_round_trip": _q(lambda p: warps.xform_inv(warps.xform(p, cmtk()), cmtk()), 2.0, 4.0),
    "elastix_xform": _q(lambda p: warps.xform(p, elastix()), 4.0),
    "elastix_round_trip": _q(lambda p: warps.xform_inv(warps.xform(p, elastix()), elastix()), 4.0),
}

_AFFINE = "SELECT vec_id AS point_id, round(embedding[1]::DOUBLE * 2 + 1, 5) AS x, round(embedding[2]::DOUBLE * 2 - 1, 5) AS y, round(embedding[3]::DOUBLE * 2 + 0.5, 5) AS z FROM embeddings"
_P = "p AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def _spline(source, target) -> str:
    """The spline's formula, its weights from the defining equations: it meets all landmarks and carries no moments."""
    n = len(source)
    far = np.linalg.norm(source[:, None] - source[None], axis=2)
    flat = np.hstack([np.ones((n, 1)), source])
    k = np.linalg.lstsq(np.vstack([np.hstack([far, flat]), np.hstack([flat.T, np.zeros((4, 4))])]), np.vstack([target, np.zeros((4, 3))]), rcond=None)[0].tolist()
    term = lambda d: " + ".join(
        [f"({k[n][d]!r}) + ({k[n + 1][d]!r}) * x + ({k[n + 2][d]!r}) * y + ({k[n + 3][d]!r}) * z", *(f"({k[i][d]!r}) * sqrt((x - ({p[0]!r}))**2 + (y - ({p[1]!r}))**2 + (z - ({p[2]!r}))**2)" for i, p in enumerate(source.tolist()))]
    )
    return f"WITH {_P} SELECT point_id, " + ", ".join(f"round({term(d)}, 5) AS {c}" for d, c in enumerate("xyz")) + " FROM p"


def _least_squares(source, target) -> str:
    """Each point's own affine map by weighted normal equations and Cramer's rule."""
    marks = ", ".join("(" + ", ".join(repr(float(v)) for v in (*a, *b)) + ")" for a, b in zip(source, target, strict=True))
    det = lambda a, b, c: f"({a}1*({b}2*{c}3-{b}3*{c}2)-{a}2*({b}1*{c}3-{b}3*{c}1)+{a}3*({b}1*{c}2-{b}2*{c}1))"
    solved = lambda j: [f"{det(*[f'r{j}' if m == i else f'c{m}' for m in (1, 2, 3)])} / {det('c1', 'c2', 'c3')}" for i in (1, 2, 3)]
    # c(i)(k): sum of weight * source i * source k; r(j)(k): sum of weight * target j * source k, about the weighted means
    sums = ", ".join([f"sum(w*(a{i}-m{i})*(a{k}-m{k})) AS c{i}{k}" for i in (1, 2, 3) for k in (1, 2, 3)] + [f"sum(w*(b{j}-q{j})*(a{k}-m{k})) AS r{j}{k}" for j in (1, 2, 3) for k in (1, 2, 3)])
    means = ", ".join([f"sum(w*a{i})/sum(w) AS m{i}" for i in (1, 2, 3)] + [f"sum(w*b{i})/sum(w) AS q{i}" for i in (1, 2, 3)])
    out = ", ".join(f"round(q{j} + " + " + ".join(f"({c} - m{i}) * {s}" for i, c, s in zip((1, 2, 3), "xyz", solved(j), strict=True)) + f", 5) AS {'xyz'[j - 1]}" for j in (1, 2, 3))
    return f"""WITH {_P}, l(a1, a2, a3, b1, b2, b3) AS (VALUES {marks}),
        near AS (SELECT p.*, l.*, 1 / ((x-a1)**2 + (y-a2)**2 + (z-a3)**2 + 2.220446049250313e-16) AS w FROM p, l),
        mean AS (SELECT point_id, {means} FROM near GROUP BY point_id),
        sums AS (SELECT point_id, x, y, z, m1, m2, m3, q1, q2, q3, {sums} FROM near JOIN mean USING (point_id) GROUP BY ALL)
        SELECT point_id, {out} FROM sums"""


ORACLES = {
    "tps_xform": _spline(SOURCE, TARGET),
    "tps_inverse": _spline(TARGET, SOURCE),
    "mls_xform": _least_squares(SOURCE, TARGET),
    "mls_reverse": _least_squares(TARGET, SOURCE),
    "tps_affine": _AFFINE,
    "mls_affine": _AFFINE,
    "elastix_round_trip": "SELECT vec_id AS point_id, round(embedding[1]::DOUBLE * 4, 5) AS x, round(embedding[2]::DOUBLE * 4, 5) AS y, round(embedding[3]::DOUBLE * 4, 5) AS z FROM embeddings",
    "cmtk_round_trip": "SELECT vec_id AS point_id, round(embedding[1]::DOUBLE * 2 + 4, 5) AS x, round(embedding[2]::DOUBLE * 2 + 4, 5) AS y, round(embedding[3]::DOUBLE * 2 + 4, 5) AS z FROM embeddings",
    "cmtk_affine": """WITH p AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE * 2 + 4 AS x, embedding[2]::DOUBLE * 2 + 4 AS y, embedding[3]::DOUBLE * 2 + 4 AS z FROM embeddings),
        a AS (SELECT sin(radians(10)) AS sa, cos(radians(10)) AS ca, sin(radians(20)) AS sb, cos(radians(20)) AS cb, sin(radians(30)) AS sg, cos(radians(30)) AS cg),
        u AS (SELECT point_id, 1.1 * (x-4) + 0.01 * (y-5) + 0.02 * (z-6) AS x, 1.2 * (y-5) + 0.03 * (z-6) AS y, 1.3 * (z-6) AS z FROM p),
        v AS (SELECT point_id, x, ca * y - sa * z AS y, sa * y + ca * z AS z FROM u, a),
        w AS (SELECT point_id, cb * x + sb * z AS x, y, cb * z - sb * x AS z FROM v, a)
        SELECT point_id, round(cg * x + sg * y + 5, 5) AS x, round(cg * y - sg * x + 7, 5) AS y, round(z + 9, 5) AS z FROM w, a""",
}
