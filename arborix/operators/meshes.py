"""Triangle-mesh operators. ``faces``: mesh_id, face_id, a, b, c; ``vertices``: mesh_id, vertex_id, x, y, z.

Edges, borders and projections are relational; filters that move vertices, loops and decimation are
kernels on one mesh per group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.kernels import mesh as k
from arborix.operators import graphs
from arborix.schema import euclid, need, per_pair


def half_edges(faces: DataFrame) -> DataFrame:
    """(tail, head, pos) of every directed edge, pos = 3 * face_id + side, in the order ab, bc, ca."""
    sides = F.array(*[F.struct(F.col(x).alias("tail"), F.col(y).alias("head")) for x, y in ("ab", "bc", "ca")])
    return faces.select("mesh_id", "face_id", F.posexplode(sides).alias("side", "e")).select("mesh_id", "face_id", (F.col("face_id") * 3 + F.col("side")).alias("pos"), "e.tail", "e.head")


def unique_edges(faces: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(edge, lo, hi, first_pos [, length]); edges number by (hi, lo), a degenerate loop is kept."""
    e = half_edges(faces).groupBy("mesh_id", F.least("tail", "head").alias("lo"), F.greatest("tail", "head").alias("hi")).agg(F.min("pos").alias("first_pos"))
    e = e.withColumn("edge", F.row_number().over(Window.partitionBy("mesh_id").orderBy("hi", "lo")) - 1)
    if vertices is None:
        return e
    v = lambda end: vertices.select("mesh_id", F.col("vertex_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in "xyz"])
    met = e.join(v("lo"), ["mesh_id", "lo"]).join(v("hi"), ["mesh_id", "hi"])
    return met.select("mesh_id", "edge", "lo", "hi", "first_pos", euclid(*[tuple(F.col(f"{end}_{c}") for c in "xyz") for end in ("lo", "hi")]).alias("length"))


def edge_inverse(faces: DataFrame) -> DataFrame:
    """For every half-edge (pos) the number of its edge."""
    h = half_edges(faces).withColumns({"lo": F.least("tail", "head"), "hi": F.greatest("tail", "head")})
    return h.join(unique_edges(faces), ["mesh_id", "lo", "hi"]).select("mesh_id", "pos", "edge")


def as_graph(faces: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """The mesh's edges as graph edges, weighted by length if coordinates are given."""
    e = unique_edges(faces, vertices).where("lo <> hi")
    return e.select(F.col("mesh_id").alias("graph_id"), F.col("edge").alias("edge_id"), F.col("lo").alias("src"), F.col("hi").alias("dst"), *([F.col("length").alias("weight")] if vertices is not None else []))


def _nodes(df: DataFrame | None) -> DataFrame | None:
    return None if df is None else df.select(F.col("mesh_id").alias("graph_id"), F.col("vertex_id").alias("node_id"))


def mesh_connected_components(faces: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    return graphs.connected_components(as_graph(faces), _nodes(vertices)).withColumnsRenamed({"graph_id": "mesh_id", "node_id": "vertex_id"})


def geodesic_matrix_mesh(faces: DataFrame, vertices=None, sources=None, targets=None, limit=np.inf) -> DataFrame:
    return graphs.geodesic_matrix(as_graph(faces, vertices), _nodes(sources), _nodes(targets), _nodes(vertices), limit=limit).withColumnRenamed("graph_id", "mesh_id")


def geodesic_nearest_mesh(faces: DataFrame, sources, targets, vertices=None) -> DataFrame:
    return graphs.geodesic_extreme(as_graph(faces, vertices), _nodes(sources), _nodes(targets)).withColumnRenamed("graph_id", "mesh_id")


def geodesic_farthest_mesh(faces: DataFrame, sources, targets, vertices=None) -> DataFrame:
    return graphs.geodesic_extreme(as_graph(faces, vertices), _nodes(sources), _nodes(targets), far=True).withColumnRenamed("graph_id", "mesh_id")


def geodesic_mst_mesh(faces: DataFrame, nodes: DataFrame, vertices=None, limit=np.inf) -> DataFrame:
    return graphs.geodesic_mst(as_graph(faces, vertices), _nodes(nodes), limit).withColumnRenamed("graph_id", "mesh_id")


def boundary_halfedges(faces: DataFrame) -> DataFrame:
    """Directed edges that exactly one face has, by pos."""
    w = Window.partitionBy("mesh_id", F.least("tail", "head"), F.greatest("tail", "head"))
    return half_edges(faces).withColumn("n", F.count("*").over(w)).where("n = 1").select("mesh_id", "pos", "tail", "head")


def exposed_halfedges(faces: DataFrame, dropped: DataFrame) -> DataFrame:
    """Half-edges of surviving faces whose edge loses another face when ``dropped`` vertices (mesh_id, vertex_id) go."""
    d = dropped.select("mesh_id", F.col("vertex_id").alias("v")).distinct()
    corners = faces.select("mesh_id", "face_id", F.explode(F.array("a", "b", "c")).alias("v"))
    gone = corners.join(d, ["mesh_id", "v"], "left_semi").select("mesh_id", "face_id").distinct()
    h = half_edges(faces).withColumns({"lo": F.least("tail", "head"), "hi": F.greatest("tail", "head")})
    lost = h.join(gone, ["mesh_id", "face_id"], "left_semi").select("mesh_id", "lo", "hi").distinct()
    return h.join(gone, ["mesh_id", "face_id"], "left_anti").join(lost, ["mesh_id", "lo", "hi"], "left_semi").select("mesh_id", "pos", "tail", "head")


def trace_loops(halves: DataFrame) -> DataFrame:
    """(ring_id, pos, vertex_id) of closed rings of three vertices or more; ``halves``: mesh_id, pos, tail, head."""

    def fn(pdf):
        rings = k.loops(pdf.sort_values("pos")[["tail", "head"]].to_numpy())
        rows = [(pdf.mesh_id.iloc[0], r, p, x) for r, ring in enumerate(rings) for p, x in enumerate(ring)]
        return pd.DataFrame(rows, columns=["mesh_id", "ring_id", "pos", "vertex_id"]).astype("int64")

    return halves.groupBy("mesh_id").applyInPandas(fn, "mesh_id bigint, ring_id bigint, pos bigint, vertex_id bigint")


def triangulate_rings(rings: DataFrame, vertices: DataFrame) -> DataFrame:
    """(ring_id, a, b, c): k - 2 triangles for each ring, wound against it."""
    met = rings.join(vertices.select("mesh_id", "vertex_id", "x", "y", "z"), ["mesh_id", "vertex_id"])

    def fn(pdf):
        pdf = pdf.sort_values("pos")
        ids = pdf.vertex_id.to_numpy()
        tri = k.fill(list(range(len(ids))), pdf[["x", "y", "z"]].to_numpy(float))
        rows = [(pdf.mesh_id.iloc[0], pdf.ring_id.iloc[0], *(ids[x] for x in t)) for t in tri]
        return pd.DataFrame(rows, columns=["mesh_id", "ring_id", "a", "b", "c"]).astype("int64")

    return met.groupBy("mesh_id", "ring_id").applyInPandas(fn, "mesh_id bigint, ring_id bigint, a bigint, b bigint, c bigint")


def project_mesh_2d(faces: DataFrame, vertices: DataFrame, axes: tuple[str, str] = ("x", "y"), depth: str = "z", front: str = "+", cull: bool = True, normals: bool = False) -> DataFrame:
    """(face_id, ring, depth, ord [, nx, ny, nz]): visible faces as closed rings of four points, the farthest first, with unit normals if wanted."""
    met = faces
    for end in "abc":
        met = met.join(vertices.select("mesh_id", F.col("vertex_id").alias(end), *[F.col(c).alias(f"{end}{c}") for c in "xyz"]), ["mesh_id", end])
    u, v = axes
    p = lambda e, c: F.col(f"{e}{c}")
    det = (p("b", u) - p("a", u)) * (p("c", v) - p("a", v)) - (p("b", v) - p("a", v)) * (p("c", u) - p("a", u))
    if cull:
        met = met.where(det > 0 if front == "+" else det < 0)
    point = lambda e: F.struct(p(e, u).alias("u"), p(e, v).alias("v"))
    deep = (p("a", depth) + p("b", depth) + p("c", depth)) / 3
    more = []
    if normals:
        side = lambda i, j: (p("b", i) - p("a", i)) * (p("c", j) - p("a", j)) - (p("b", j) - p("a", j)) * (p("c", i) - p("a", i))
        cross = [side("y", "z"), side("z", "x"), side("x", "y")]
        size = F.sqrt(sum((x * x for x in cross), F.lit(0.0)))
        more = [F.when(size > 0, x / size).otherwise(F.lit(0.0)).alias(f"n{c}") for x, c in zip(cross, "xyz", strict=True)]
    out = met.select("mesh_id", "face_id", F.array(*[point(e) for e in "abca"]).alias("ring"), deep.alias("depth"), *more)
    order = F.col("depth").asc() if front == "+" else F.col("depth").desc()
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("mesh_id").orderBy(order, "face_id")) - 1)


def projection_bbox(projected: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Bounding box of each mesh's projected rings; meshes of ``objects`` (mesh_id) without any have an empty one, from infinity to -infinity."""
    p = projected.select("mesh_id", F.explode("ring").alias("p"))
    box = p.groupBy("mesh_id").agg(*[getattr(F, f)(f"p.{c}").alias(f"{f}_{c}") for f in ("min", "max") for c in "uv"])
    if objects is None:
        return box
    box = objects.select("mesh_id").distinct().join(box, "mesh_id", "left")
    return box.na.fill({f"{f}_{c}": far for f, far in (("min", float("inf")), ("max", float("-inf"))) for c in "uv"})


def _each(vertices: DataFrame, faces: DataFrame, fn, schema: str) -> DataFrame:
    need(vertices, "mesh_id", "vertex_id", "x", "y", "z")
    need(faces, "mesh_id", "face_id", "a", "b", "c")

    def kernel(v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        v = v.sort_values("vertex_id")
        ids = v.vertex_id.to_numpy()
        rows = np.searchsorted(ids, f.sort_values("face_id")[["a", "b", "c"]].to_numpy()) if len(f) else np.zeros((0, 3), np.int64)
        out = fn(ids, v, rows)
        out.insert(0, "mesh_id", v.mesh_id.iloc[0])
        return out

    keep = [c for c in ("mesh_id", "vertex_id", "x", "y", "z", "lock") if c in vertices.columns]
    return per_pair(vertices.select(*keep), faces.select("mesh_id", "face_id", "a", "b", "c"), "mesh_id", kernel, schema)


def _xyz(v: pd.DataFrame) -> np.ndarray:
    return v[["x", "y", "z"]].to_numpy(float)


def smooth_mesh(vertices: DataFrame, faces: DataFrame, method: str = "laplacian", **options) -> DataFrame:
    """New positions (vertex_id, x, y, z); ``vertices`` may have a boolean ``lock``."""

    def fn(ids, v, f):
        x = k.smooth(_xyz(v), f, method, lock=v.lock if "lock" in v else None, **options)
        return pd.DataFrame({"vertex_id": ids, "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})

    return _each(vertices, faces, fn, "mesh_id bigint, vertex_id bigint, x double, y double, z double")


def _decimated(vertices, faces, options):
    def fn(ids, v, f):
        o = dict(options)
        if "ratio" in o:
            o["target"] = max(1, int(np.floor(o.pop("ratio") * len(f) + 0.5)))
        nv, nf, moved = k.simplify(_xyz(v), f, lock=v.lock if "lock" in v else None, **o)
        parts = [
            pd.DataFrame({"kind": "vertex", "id": np.arange(len(nv)), "x": nv[:, 0], "y": nv[:, 1], "z": nv[:, 2]}),
            pd.DataFrame({"kind": "face", "id": np.arange(len(nf)), "a": nf[:, 0], "b": nf[:, 1], "c": nf[:, 2]}),
            pd.DataFrame({"kind": "map", "id": ids, "a": moved}),
        ]
        return pd.concat(parts).reindex(columns=["kind", "id", "x", "y", "z", "a", "b", "c"]).astype({c: "Int64" for c in "abc"})

    return _each(vertices, faces, fn, "mesh_id bigint, kind string, id bigint, x double, y double, z double, a bigint, b bigint, c bigint")


def simplify_mesh(vertices: DataFrame, faces: DataFrame, ratio: float | None = None, n_faces: int | None = None, aggressiveness: float = 7.0, preserve_border: bool = False) -> DataFrame:
    """Rows of kind vertex (id, x, y, z), face (id, a, b, c) and map (old vertex id, a = new row or -1)."""
    if (ratio is None) == (n_faces is None):
        raise ValueError("give ratio or n_faces")
    goal = {"ratio": ratio} if ratio is not None else {"target": n_faces}
    return _decimated(vertices, faces, {**goal, "aggressiveness": aggressiveness, "preserve_border": preserve_border})


def simplify_mesh_lossless(vertices: DataFrame, faces: DataFrame, epsilon: float = 1e-3, max_iterations: int = 9999, preserve_border: bool = False) -> DataFrame:
    return _decimated(vertices, faces, {"epsilon": epsilon, "max_iterations": max_iterations, "preserve_border": preserve_border})
