"""Queries of the mesh operators: a bumpy n by n sheet for every region, its height from all customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborix.catalog.inputs import table
from arborix.operators import meshes as m

N = 12


def sheet(spark, sf_dir):
    """Vertices (i, j) of a grid per region; z is the number of customers of the region in the cell, mod 7."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = c.groupBy(F.col("n_regionkey").cast("long").alias("mesh_id"), (F.col("c_custkey") % (N * N)).alias("vertex_id")).agg((F.count("*") % 7).alias("h"))
    grid = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("mesh_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N * N - 1).cast("long"))).alias("vertex_id"))
    v = grid.join(cells, ["mesh_id", "vertex_id"], "left").select("mesh_id", "vertex_id", F.expr(f"cast(vertex_id div {N} as double)").alias("x"), F.expr(f"cast(vertex_id % {N} as double)").alias("y"), F.coalesce(F.col("h").cast("double") / 4, F.lit(0.0)).alias("z"))
    quad = grid.where(f"vertex_id % {N} < {N - 1} and vertex_id div {N} < {N - 1}")
    v0 = F.col("vertex_id")
    tri = F.array(F.struct(v0.alias("a"), (v0 + N).alias("b"), (v0 + 1).alias("c")), F.struct((v0 + N).alias("a"), (v0 + N + 1).alias("b"), (v0 + 1).alias("c")))
    f = quad.select("mesh_id", "vertex_id", F.posexplode(tri).alias("k", "t")).select("mesh_id", (F.col("vertex_id") * 2 + F.col("k")).alias("face_id"), "t.a", "t.b", "t.c")
    return v, f


SHEET = f"""WITH RECURSIVE cells AS (
        SELECT n_regionkey::BIGINT AS mesh_id, c_custkey % {N * N} AS vertex_id, count(*) % 7 AS h FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
    ), grid AS (SELECT r_regionkey::BIGINT AS mesh_id, unnest(range({N * N})) AS vertex_id FROM region),
    vertices AS (SELECT mesh_id, vertex_id, (vertex_id // {N})::DOUBLE AS x, (vertex_id % {N})::DOUBLE AS y, coalesce(h::DOUBLE / 4, 0) AS z FROM grid LEFT JOIN cells USING (mesh_id, vertex_id)),
    quad AS (SELECT * FROM grid WHERE vertex_id % {N} < {N - 1} AND vertex_id // {N} < {N - 1}),
    faces AS (SELECT mesh_id, vertex_id * 2 AS face_id, vertex_id AS a, vertex_id + {N} AS b, vertex_id + 1 AS c FROM quad
        UNION ALL SELECT mesh_id, vertex_id * 2 + 1, vertex_id + {N}, vertex_id + {N} + 1, vertex_id + 1 FROM quad),
    half AS (SELECT mesh_id, face_id, 3 * face_id AS pos, a AS tail, b AS head FROM faces UNION ALL SELECT mesh_id, face_id, 3 * face_id + 1, b, c FROM faces UNION ALL SELECT mesh_id, face_id, 3 * face_id + 2, c, a FROM faces),
    edges AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY hi, lo) - 1 AS edge FROM (SELECT mesh_id, least(tail, head) AS lo, greatest(tail, head) AS hi, min(pos) AS first_pos FROM half GROUP BY ALL))
"""


def _q(fn):
    return lambda spark, sf_dir: fn(*sheet(spark, sf_dir))


def _marks(v, modulus, rest):
    return v.where(F.col("vertex_id") % modulus == rest).select("mesh_id", "vertex_id")


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _projected(v, f):
    """Visible faces with their rings' first corner and area, depth, place in order and normal."""
    p = m.project_mesh_2d(f, v, normals=True)
    area = F.expr("aggregate(sequence(0, 2), cast(0 as double), (s, k) -> s + ring[k].u * ring[k + 1].v - ring[k + 1].u * ring[k].v) / 2")
    return _rounded(p.select("mesh_id", "face_id", "depth", F.col("ord").cast("long").alias("ord"), F.col("ring")[0]["u"].alias("u"), F.col("ring")[3]["v"].alias("v"), area.alias("area"), "nx", "ny", "nz"), "depth", "area", "nx", "ny", "nz")


def _capped(v, f):
    """Triangles that close each sheet's border and their area seen from above, which is the border's own."""
    t = m.triangulate_rings(m.trace_loops(m.boundary_halfedges(f)), v)
    for c in "abc":
        t = t.join(v.select("mesh_id", F.col("vertex_id").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}")), ["mesh_id", c])
    area = F.expr("((xb - xa) * (yc - ya) - (yb - ya) * (xc - xa)) / 2")
    return t.groupBy("mesh_id").agg(F.count("*").alias("n"), F.round(F.sum(area), 6).alias("area"))


QUERIES = {
    # without the faces between the sixth and the seventh row of vertices
    "mesh_connected_components": _q(lambda v, f: m.mesh_connected_components(f.where(f"face_id div {2 * N} <> 5"), v)),
    "unique_edges": _q(lambda v, f: _rounded(m.unique_edges(f, v), "length")),
    "edge_inverse": _q(lambda v, f: m.edge_inverse(f)),
    "geodesic_matrix_mesh": _q(lambda v, f: m.geodesic_matrix_mesh(f, None, _marks(v, 36, 5), None, 6.0)),
    # every vertex as source and target, without a limit
    "geodesic_matrix_mesh_all": _q(lambda v, f: _rounded(m.geodesic_matrix_mesh(f, v), "dist")),
    "geodesic_nearest_mesh": _q(lambda v, f: _rounded(m.geodesic_nearest_mesh(f, _marks(v, 7, 1), _marks(v, 11, 3), v), "dist").drop("target")),
    "geodesic_nearest_mesh_hops": _q(lambda v, f: m.geodesic_nearest_mesh(f, _marks(v, 7, 1), _marks(v, 11, 3))),
    "geodesic_farthest_mesh": _q(lambda v, f: m.geodesic_farthest_mesh(f, _marks(v, 7, 1), _marks(v, 11, 3))),
    "geodesic_mst_mesh": _q(lambda v, f: m.geodesic_mst_mesh(f, _marks(v, 11, 3), v).groupBy("mesh_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total"))),
    "simplify_mesh": _q(lambda v, f: m.simplify_mesh(v, f, ratio=0.5)),
    "simplify_mesh_lossless": _q(lambda v, f: m.simplify_mesh_lossless(v, f)),
    "smooth_mesh": _q(lambda v, f: _rounded(m.smooth_mesh(v, f, "laplacian", iterations=1), "x", "y", "z")),
    "smooth_mesh_taubin_uniform": _q(lambda v, f: _rounded(m.smooth_mesh(v, f, "taubin", iterations=1), "x", "y", "z")),
    "smooth_mesh_humphrey_uniform": _q(lambda v, f: _rounded(m.smooth_mesh(v, f, "humphrey", iterations=1), "x", "y", "z")),
    "smooth_mesh_taubin": _q(lambda v, f: m.smooth_mesh(v, f, "taubin", weights="cotangent")),
    "smooth_mesh_humphrey": _q(lambda v, f: m.smooth_mesh(v, f, "humphrey", weights="inverse", preserve_border=True, volume_correction=True)),
    "boundary_halfedges": _q(lambda v, f: m.boundary_halfedges(f)),
    "exposed_halfedges": _q(lambda v, f: m.exposed_halfedges(f, _marks(v, 29, 17))),
    "trace_loops": _q(lambda v, f: m.trace_loops(m.boundary_halfedges(f))),
    "triangulate_rings": _q(lambda v, f: m.triangulate_rings(m.trace_loops(m.boundary_halfedges(f)), v)),
    "triangulated_area": _q(_capped),
    "project_mesh_2d": _q(_projected),
    # from below: nothing is visible, so the box is empty
    "projection_bbox": _q(lambda v, f: m.projection_bbox(m.project_mesh_2d(f, v)).unionByName(m.projection_bbox(m.project_mesh_2d(f, v, front="-"), f).withColumn("mesh_id", -1 - F.col("mesh_id")))),
}
_TWO = ", two AS (SELECT mesh_id, lo AS a, hi AS b, {0} AS w FROM edges e {1} UNION ALL SELECT mesh_id, hi, lo, {0} FROM edges e {1})"
_LENGTH = _TWO.format(
    "(SELECT sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) FROM vertices a, vertices b WHERE a.mesh_id = e.mesh_id AND b.mesh_id = e.mesh_id AND a.vertex_id = e.lo AND b.vertex_id = e.hi)", ""
)
_HOPS = _TWO.format("1::DOUBLE", "")
# far: distances between marked vertices, each kept at its least
_FAR = """, far(mesh_id, s, t, d) USING KEY (mesh_id, s, t) AS (
        SELECT mesh_id, vertex_id AS s, vertex_id AS t, 0::DOUBLE AS d FROM vertices WHERE {}
        UNION SELECT f.mesh_id, f.s, e.b, min(f.d + e.w) FROM far f JOIN two e ON e.mesh_id = f.mesh_id AND e.a = f.t
        LEFT JOIN recurring.far r ON r.mesh_id = f.mesh_id AND r.s = f.s AND r.t = e.b WHERE r.d IS NULL OR f.d + e.w < r.d GROUP BY ALL)"""
_BEST = " SELECT mesh_id, s AS {0}, {1}(d) AS dist, min_by(t, ({2}d, t)) AS target FROM far WHERE t % 11 = 3 AND s <> t GROUP BY ALL"
_MEAN = "SELECT v.mesh_id, v.vertex_id, avg(n.x) AS x, avg(n.y) AS y, avg(n.z) AS z FROM {0} v JOIN two t ON t.mesh_id = v.mesh_id AND t.a = v.vertex_id JOIN {0} n ON n.mesh_id = v.mesh_id AND n.vertex_id = t.b GROUP BY ALL"
_STEP = "SELECT v.mesh_id, v.vertex_id, " + ", ".join(f"v.{c} + {{1}} * (m.{c} - v.{c}) AS {c}" for c in "xyz") + " FROM {0} v JOIN (" + _MEAN + ") m USING (mesh_id, vertex_id)"
_ROUND = " SELECT mesh_id, vertex_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM "

ORACLES = {
    k: SHEET + v
    for k, v in {
        "mesh_connected_components": f""", two AS (SELECT mesh_id, tail AS a, head AS b FROM half WHERE face_id // {2 * N} <> 5 UNION SELECT mesh_id, head, tail FROM half WHERE face_id // {2 * N} <> 5),
            reach AS (SELECT mesh_id, vertex_id, vertex_id AS c FROM vertices UNION SELECT r.mesh_id, t.b, r.c FROM reach r JOIN two t ON t.mesh_id = r.mesh_id AND t.a = r.vertex_id),
            least AS (SELECT mesh_id, vertex_id, min(c) AS c FROM reach GROUP BY ALL)
            SELECT mesh_id, vertex_id, c AS component FROM least""",
        "geodesic_matrix_mesh_all": _LENGTH + _FAR.format("true") + " SELECT mesh_id, s AS source, t AS target, round(d, 6) AS dist FROM far",
        "geodesic_nearest_mesh": _LENGTH + _FAR.format("vertex_id % 7 = 1") + " SELECT mesh_id, s AS node_id, round(min(d), 6) AS dist FROM far WHERE t % 11 = 3 AND s <> t GROUP BY ALL",
        "geodesic_nearest_mesh_hops": _HOPS + _FAR.format("vertex_id % 7 = 1") + _BEST.format("node_id", "min", ""),
        "geodesic_farthest_mesh": _HOPS + _FAR.format("vertex_id % 7 = 1") + _BEST.format("node_id", "max", "-"),
        "geodesic_mst_mesh": _LENGTH + _FAR.format("vertex_id % 11 = 3") + """, near AS (SELECT mesh_id, s AS p, t AS q, (d, s, t) AS k FROM far WHERE t % 11 = 3 AND s < t),
            hops AS (SELECT mesh_id, p, q, k FROM near UNION ALL SELECT mesh_id, q, p, k FROM near),
            way AS (SELECT mesh_id, p, q, k, p AS place FROM near UNION SELECT w.mesh_id, w.p, w.q, w.k, l.q FROM way w JOIN hops l ON l.mesh_id = w.mesh_id AND l.p = w.place AND l.k < w.k)
            SELECT mesh_id, count(*) AS n, round(sum(k[1]), 6) AS total FROM near n WHERE NOT EXISTS (FROM way w WHERE w.mesh_id = n.mesh_id AND w.p = n.p AND w.q = n.q AND w.place = n.q) GROUP BY ALL""",
        "smooth_mesh_taubin_uniform": _HOPS + ", one AS (" + _STEP.format("vertices", 0.5) + "), next AS (" + _STEP.format("one", -0.53) + ")" + _ROUND + "next",
        "smooth_mesh_humphrey_uniform": _HOPS + ", p AS (" + _MEAN.format("vertices") + "), b AS (SELECT p.mesh_id, p.vertex_id, p.x - v.x AS x, p.y - v.y AS y, p.z - v.z AS z FROM p JOIN vertices v USING (mesh_id, vertex_id)), mb AS (" + _MEAN.format("b") + "), done AS (SELECT mesh_id, vertex_id, " + ", ".join(f"p.{c} - (0.5 * b.{c} + 0.5 * mb.{c}) AS {c}" for c in "xyz") + " FROM p JOIN b USING (mesh_id, vertex_id) JOIN mb USING (mesh_id, vertex_id))" + _ROUND + "done",
        # the border is one ring from the first border edge on
        "trace_loops": """, rim AS (SELECT mesh_id, pos, tail, head FROM (SELECT *, count(*) OVER (PARTITION BY mesh_id, least(tail, head), greatest(tail, head)) AS n FROM half) WHERE n = 1),
            first AS (SELECT mesh_id, min_by(tail, pos) AS tail FROM rim GROUP BY ALL),
            walk AS (SELECT mesh_id, 0 AS place, tail AS vertex_id, tail AS first FROM first UNION ALL SELECT w.mesh_id, w.place + 1, r.head, w.first FROM walk w JOIN rim r ON r.mesh_id = w.mesh_id AND r.tail = w.vertex_id WHERE r.head <> w.first)
            SELECT mesh_id, 0::BIGINT AS ring_id, place::BIGINT AS pos, vertex_id FROM walk""",
        "triangulated_area": f"SELECT r_regionkey::BIGINT AS mesh_id, {4 * (N - 1) - 2}::BIGINT AS n, -{(N - 1) ** 2}::DOUBLE AS area FROM region",
        "unique_edges": "SELECT e.mesh_id, edge, lo, hi, first_pos, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS length FROM edges e JOIN vertices a ON a.mesh_id = e.mesh_id AND a.vertex_id = lo JOIN vertices b ON b.mesh_id = e.mesh_id AND b.vertex_id = hi",
        "edge_inverse": "SELECT h.mesh_id, h.pos, e.edge FROM half h JOIN edges e ON e.mesh_id = h.mesh_id AND e.lo = least(tail, head) AND e.hi = greatest(tail, head)",
        "geodesic_matrix_mesh": """, two AS (SELECT mesh_id, lo AS a, hi AS b FROM edges UNION ALL SELECT mesh_id, hi, lo FROM edges),
            walk AS (SELECT mesh_id, vertex_id AS s, vertex_id AS t, 0 AS d FROM vertices WHERE vertex_id % 36 = 5 UNION SELECT w.mesh_id, w.s, e.b, w.d + 1 FROM walk w JOIN two e ON e.mesh_id = w.mesh_id AND e.a = w.t WHERE w.d < 6),
            near AS (SELECT mesh_id, s, t, min(d) AS d FROM walk GROUP BY ALL)
            SELECT s.mesh_id, s.vertex_id AS source, t.vertex_id AS target, coalesce(n.d, -1)::DOUBLE AS dist FROM vertices s JOIN vertices t USING (mesh_id)
            LEFT JOIN near n ON n.mesh_id = s.mesh_id AND n.s = s.vertex_id AND n.t = t.vertex_id WHERE s.vertex_id % 36 = 5""",
        "smooth_mesh": """, two AS (SELECT mesh_id, lo AS a, hi AS b FROM edges UNION ALL SELECT mesh_id, hi, lo FROM edges)
            SELECT v.mesh_id, v.vertex_id, round(any_value(v.x) + 0.5 * (avg(n.x) - any_value(v.x)), 6) AS x, round(any_value(v.y) + 0.5 * (avg(n.y) - any_value(v.y)), 6) AS y, round(any_value(v.z) + 0.5 * (avg(n.z) - any_value(v.z)), 6) AS z
            FROM vertices v JOIN two t ON t.mesh_id = v.mesh_id AND t.a = v.vertex_id JOIN vertices n ON n.mesh_id = v.mesh_id AND n.vertex_id = t.b GROUP BY v.mesh_id, v.vertex_id""",
        "boundary_halfedges": "SELECT mesh_id, pos, tail, head FROM (SELECT *, count(*) OVER (PARTITION BY mesh_id, least(tail, head), greatest(tail, head)) AS n FROM half) WHERE n = 1",
        "exposed_halfedges": ", gone AS (SELECT DISTINCT mesh_id, face_id FROM half WHERE tail % 29 = 17), lost AS (SELECT DISTINCT mesh_id, least(tail, head) AS lo, greatest(tail, head) AS hi FROM half JOIN gone USING (mesh_id, face_id)) SELECT h.mesh_id, pos, tail, head FROM half h JOIN lost l ON l.mesh_id = h.mesh_id AND l.lo = least(tail, head) AND l.hi = greatest(tail, head) WHERE NOT EXISTS (FROM gone g WHERE g.mesh_id = h.mesh_id AND g.face_id = h.face_id)",
        "project_mesh_2d": """, flat AS (SELECT f.mesh_id, f.face_id, (a.z + b.z + c.z) / 3 AS depth, a.x AS u, a.y AS v, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS nz, (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS ny
                FROM faces f JOIN vertices a ON a.mesh_id = f.mesh_id AND a.vertex_id = f.a JOIN vertices b ON b.mesh_id = f.mesh_id AND b.vertex_id = f.b JOIN vertices c ON c.mesh_id = f.mesh_id AND c.vertex_id = f.c)
            SELECT mesh_id, face_id, round(depth, 6) AS depth, row_number() OVER (PARTITION BY mesh_id ORDER BY depth, face_id) - 1 AS ord, u, v, round(nz / 2, 6) AS area,
                round(nx / sqrt(nx*nx+ny*ny+nz*nz), 6) AS nx, round(ny / sqrt(nx*nx+ny*ny+nz*nz), 6) AS ny, round(nz / sqrt(nx*nx+ny*ny+nz*nz), 6) AS nz FROM flat WHERE nz > 0""",
        "projection_bbox": f"SELECT r_regionkey::BIGINT AS mesh_id, 0::DOUBLE AS min_u, 0::DOUBLE AS min_v, {N - 1}::DOUBLE AS max_u, {N - 1}::DOUBLE AS max_v FROM region UNION ALL SELECT -1 - r_regionkey::BIGINT, 'inf'::DOUBLE, 'inf'::DOUBLE, '-inf'::DOUBLE, '-inf'::DOUBLE FROM region",
    }.items()
}
