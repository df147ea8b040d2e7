"""Queries of the general-graph operators: graphs of parts and suppliers that meet in line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborix.catalog.inputs import table
from arborix.operators import graphs as g
from arborix.plans import closure as plans


def trade(spark, sf_dir):
    """All line items dealt over 97 graphs by their order; groups of parts link to groups of suppliers, weight a small integer."""
    li = table(spark, sf_dir, "lineitem")
    e = li.groupBy((F.col("l_orderkey") % 97).alias("graph_id"), (F.col("l_partkey") % 211).alias("src"), (F.col("l_suppkey") % 89 + 1000).alias("dst")).agg(F.max((1 + F.col("l_quantity") % 9).cast("long")).cast("double").alias("weight"))
    return e.withColumn("edge_id", F.col("src") * 10000 + F.col("dst"))


TRADE = """
    edges AS (
        SELECT l_orderkey % 97 AS graph_id, l_partkey % 211 AS src, l_suppkey % 89 + 1000 AS dst, max((1 + l_quantity % 9)::BIGINT)::DOUBLE AS weight
        FROM lineitem GROUP BY ALL
    ), both_ways AS (
        SELECT graph_id, src AS a, dst AS b, weight FROM edges UNION ALL SELECT graph_id, dst, src, weight FROM edges
    ), nodes AS (SELECT DISTINCT graph_id, a AS node_id FROM both_ways)
"""
# reach: nodes linked within at most 60 steps, by set union
_COMP = ", reach AS (SELECT graph_id, node_id, node_id AS c FROM nodes UNION SELECT r.graph_id, e.b, r.c FROM reach r JOIN both_ways e ON e.graph_id = r.graph_id AND e.a = r.node_id), comp AS (SELECT graph_id, node_id, min(c) AS component FROM reach GROUP BY ALL)"


def _nodes(e, rest, modulus):
    n = e.select("graph_id", F.col("src").alias("node_id")).unionByName(e.select("graph_id", F.col("dst").alias("node_id"))).distinct()
    return n.where(F.col("node_id") % modulus == rest)


def _q(fn):
    return lambda spark, sf_dir: fn(trade(spark, sf_dir))


def _prepared(e, items=False):
    return g.GeodesicGraph(e, None, _nodes(e, 0, 2).withColumn("item_id", F.col("node_id") * 10) if items else None)


def _with_weights(e, df, a, b, out):
    """``df`` with the weight of the edge between its columns a and b (null where there is none)."""
    both = e.select("graph_id", F.col("src").alias(a), F.col("dst").alias(b), F.col("weight").alias(out)).unionByName(e.select("graph_id", F.col("dst").alias(a), F.col("src").alias(b), F.col("weight").alias(out)))
    return df.join(both, ["graph_id", a, b], "left")


def _parent_dist(e):
    """How far each node lies from its root along the parents found, and whether it settled after its parent."""
    p = g.parents_from_edges(e)
    order = p.select("graph_id", F.col("node_id").alias("parent_id"), F.col("ord").alias("before"))
    p = _with_weights(e, p, "node_id", "parent_id", "weight").join(order, ["graph_id", "parent_id"], "left")
    far = plans.to_root(p.withColumnRenamed("graph_id", "skeleton_id")).withColumnRenamed("skeleton_id", "graph_id")
    late = p.select("graph_id", "node_id", (F.coalesce("before", F.lit(-1)) < F.col("ord")).alias("after_parent"))
    return far.join(late, ["graph_id", "node_id"]).select("graph_id", "node_id", "root", "dist", "after_parent")


def _predecessors(e, find=g.geodesic_predecessors):
    """Distances, and whether each predecessor is one step nearer by the weight of their edge."""
    found = find(e, sources=_nodes(e, 3, 31))
    near = found.select("graph_id", "source", F.col("target").alias("pred"), F.col("dist").alias("near"))
    found = _with_weights(e, found, "pred", "target", "step").join(near, ["graph_id", "source", "pred"], "left")
    fits = F.when(F.col("pred") >= 0, F.col("near") + F.col("step") == F.col("dist")).otherwise((F.col("dist") == -1) | (F.col("source") == F.col("target")))
    return found.select("graph_id", "source", "target", "dist", F.coalesce(fits, F.lit(False)).alias("fits"))


def _path_length(e, find=g.geodesic_path):
    """Each path's summed weights; a step that is no edge makes it null."""
    found = find(e, _nodes(e, 3, 31).withColumn("target", F.col("node_id") + 31))
    step = found.select("graph_id", "source", "target", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("to"))
    met = _with_weights(e, found.join(step, ["graph_id", "source", "target", "pos"]), "node_id", "to", "step")
    return met.groupBy("graph_id", "source", "target").agg(F.when(F.count("step") == F.count("*"), F.sum("step")).alias("length"))


QUERIES = {
    "connected_components_graph": _q(g.connected_components),
    "connected_components_at_scale": _q(g.components_at_scale),
    "level_set_components": _q(lambda e: g.level_set_components(e, _nodes(e, 0, 1).withColumn("label", F.expr("if(node_id % 7 = 0, -1, node_id % 2)")))),
    "contract_vertices": _q(lambda e: g.contract_vertices(e, _nodes(e, 0, 1).withColumn("target", F.col("node_id") % 40))),
    "minimum_spanning_tree": _q(g.minimum_spanning_tree),
    "spanning_forest_at_scale": _q(g.spanning_forest_at_scale),
    "bridges": _q(g.bridges),
    "parents_from_edges": _q(_parent_dist),
    "parents_from_edges_order": _q(g.parents_from_edges),
    "geodesic_matrix_graph": _q(lambda e: g.geodesic_matrix(e, _nodes(e, 3, 31), _nodes(e, 5, 37), limit=12.0)),
    "geodesic_predecessors": _q(_predecessors),
    "geodesic_path": _q(_path_length),
    # every node as source (and target); beyond SQL, held against brute force in the tests
    "geodesic_matrix_graph_all": _q(lambda e: g.geodesic_matrix(e)),
    "geodesic_predecessors_all": _q(lambda e: g.geodesic_predecessors(e)),
    "geodesic_path_all": _q(lambda e: g.geodesic_path(e, _nodes(e, 0, 1).withColumn("target", F.col("node_id") + 31))),
    "csgraph_dijkstra_all": _q(lambda e: g.csgraph_dijkstra(e.select("graph_id", F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value")))),
    "geodesic_clusters": _q(lambda e: g.geodesic_clusters(e, 6.0)),
    "geodesic_mst_graph": _q(lambda e: g.geodesic_mst(e, _nodes(e, 3, 31)).groupBy("graph_id").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))),
    "csgraph_dijkstra": _q(lambda e: g.csgraph_dijkstra(e.select("graph_id", F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value")), _nodes(e, 3, 31), directed=False).withColumn("dist", F.when(F.col("dist") < 1e300, F.col("dist")).otherwise(-1.0))),
    "csgraph_components": _q(lambda e: g.csgraph_components(e.select("graph_id", F.col("src").alias("row"), F.col("dst").alias("col")), checks=False)),
    "prepared_distances": _q(lambda e: _prepared(e).distances(sources=_nodes(e, 3, 31), targets=_nodes(e, 5, 37))),
    "prepared_predecessors": _q(lambda e: _predecessors(e, lambda x, **o: _prepared(x).predecessors(**o))),
    "prepared_path": _q(lambda e: _path_length(e, lambda x, pairs: _prepared(x).path(pairs))),
    "prepared_clusters": _q(lambda e: _prepared(e).clusters(6.0)),
    "prepared_nearest": _q(lambda e: _prepared(e).nearest(_nodes(e, 3, 31), _nodes(e, 5, 37))),
    "prepared_farthest": _q(lambda e: _prepared(e).farthest(_nodes(e, 3, 31), _nodes(e, 5, 37))),
    "prepared_ball": _q(lambda e: _prepared(e).ball(_nodes(e, 3, 31), 8.0).select("graph_id", "node_id", "dist", "ord")),
    "prepared_components": _q(lambda e: _prepared(e, True).item_components()),
    "prepared_set_weights": _q(lambda e: _prepared(e).set_weights(e.where("src % 5 = 0").select("graph_id", "dst", "src", (F.col("weight") + 1).alias("weight"))).edges.select("graph_id", "src", "dst", "weight")),
    "prepared_subset": _q(lambda e: _prepared(e, True).subset(_nodes(e, 0, 2).withColumn("ord", -F.col("node_id"))).edges.select("graph_id", "src", "dst", "weight")),
    "prepared_grow": _q(lambda e: _prepared(e, True).grow(_nodes(e, 0, 2).groupBy("graph_id").agg((F.min("node_id") * 10).alias("item_id"), F.lit(0).alias("forbidden")), 12)),
    "prepared_farthest_points": _q(lambda e: _prepared(e, True).farthest_points(6)),
    "prepared_farthest_seed": _q(lambda e: _prepared(e, True).farthest_seed(_nodes(e, 0, 2).groupBy("graph_id").agg((F.min("node_id") * 10).alias("item_id")))),
}

# exact distances by steps of at most 14 edges (weights are 1 at least, so a limit of 12 needs no more)
_NEAR = ", walk AS (SELECT graph_id, node_id AS s, node_id AS t, 0::DOUBLE AS d FROM nodes WHERE node_id % 31 = 3 UNION SELECT w.graph_id, w.s, e.b, w.d + e.weight FROM walk w JOIN both_ways e ON e.graph_id = w.graph_id AND e.a = w.t WHERE w.d + e.weight <= 12), near AS (SELECT graph_id, s, t, min(d) AS d FROM walk GROUP BY ALL)"

# far: exact distances from the nodes of a condition, each kept at its least
_FAR = """, far AS (
        SELECT graph_id, node_id AS s, node_id AS t, 0::DOUBLE AS d FROM nodes WHERE {}
        UNION SELECT f.graph_id, f.s, e.b, min(f.d + e.weight) FROM far f JOIN both_ways e ON e.graph_id = f.graph_id AND e.a = f.t
        LEFT JOIN recurring.far r ON r.graph_id = f.graph_id AND r.s = f.s AND r.t = e.b WHERE r.d IS NULL OR f.d + e.weight < r.d GROUP BY ALL)"""
_FAR = _FAR.replace("far AS (", "far(graph_id, s, t, d) USING KEY (graph_id, s, t) AS (", 1)
# way: nodes reached over lighter edges; an edge is in the forest unless they reach its other end
_TREE = """, ranked AS (SELECT *, (weight, src * 10000 + dst) AS k FROM edges),
    links AS (SELECT graph_id, src AS a, dst AS b, k FROM ranked UNION ALL SELECT graph_id, dst, src, k FROM ranked),
    way AS (SELECT graph_id, k, dst, src AS at FROM ranked UNION SELECT w.graph_id, w.k, w.dst, l.b FROM way w JOIN links l ON l.graph_id = w.graph_id AND l.a = w.at AND l.k < w.k),
    tree AS (SELECT graph_id, src, dst, weight, k, k[2] AS edge_id FROM ranked r WHERE NOT EXISTS (FROM way w WHERE w.graph_id = r.graph_id AND w.k = r.k AND w.at = r.dst))"""
_EXTREME = """ SELECT s.graph_id, s.node_id, coalesce({0}(f.d), -1) AS dist, coalesce(min_by(f.t, ({1}f.d, f.t)), -1) AS target FROM nodes s
    LEFT JOIN far f ON f.graph_id = s.graph_id AND f.s = s.node_id AND f.t % 37 = 5 AND f.t <> f.s WHERE s.node_id % 31 = 3 GROUP BY s.graph_id, s.node_id"""
_SEED = ", seed AS (SELECT graph_id, min(node_id) AS node_id FROM nodes WHERE node_id % 2 = 0 GROUP BY graph_id)"

ORACLES = {
    k: "WITH RECURSIVE " + TRADE + v
    for k, v in {
        "connected_components_graph": _COMP + " SELECT * FROM comp",
        "connected_components_at_scale": _COMP + " SELECT * FROM comp",
        "level_set_components": """, lab AS (SELECT *, CASE WHEN node_id % 7 = 0 THEN -1 ELSE node_id % 2 END AS label FROM nodes),
            inner_edges AS (SELECT e.* FROM both_ways e JOIN lab a ON a.graph_id = e.graph_id AND a.node_id = e.a JOIN lab b ON b.graph_id = e.graph_id AND b.node_id = e.b WHERE a.label = b.label AND a.label >= 0),
            reach AS (SELECT graph_id, node_id, node_id AS c FROM lab WHERE label >= 0 UNION SELECT r.graph_id, e.b, r.c FROM reach r JOIN inner_edges e ON e.graph_id = r.graph_id AND e.a = r.node_id),
            comp AS (SELECT graph_id, node_id, min(c) AS c FROM reach GROUP BY ALL)
            SELECT graph_id, node_id, dense_rank() OVER (PARTITION BY graph_id ORDER BY c) - 1 AS component FROM comp UNION ALL SELECT graph_id, node_id, -1 FROM lab WHERE label < 0""",
        "contract_vertices": ", m AS (SELECT DISTINCT graph_id, least(src % 40, dst % 40) AS src, greatest(src % 40, dst % 40) AS dst FROM edges) SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY dst, src) - 1 AS ord FROM m WHERE src <> dst",
        "geodesic_matrix_graph": _NEAR + " SELECT s.graph_id, s.node_id AS source, t.node_id AS target, coalesce(n.d, -1) AS dist FROM nodes s JOIN nodes t ON t.graph_id = s.graph_id AND t.node_id % 37 = 5 LEFT JOIN near n ON n.graph_id = s.graph_id AND n.s = s.node_id AND n.t = t.node_id WHERE s.node_id % 31 = 3",
        "csgraph_dijkstra": _FAR.format("node_id % 31 = 3") + " SELECT s.graph_id, s.node_id AS source, t.node_id AS target, coalesce(f.d, -1) AS dist FROM nodes s JOIN nodes t USING (graph_id) LEFT JOIN far f ON f.graph_id = s.graph_id AND f.s = s.node_id AND f.t = t.node_id WHERE s.node_id % 31 = 3",
        "minimum_spanning_tree": _TREE + " SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY k) - 1 AS ord, edge_id FROM tree",
        "spanning_forest_at_scale": _TREE + " SELECT graph_id, edge_id FROM tree",
        # a tree edge is a bridge unless the tree path between the ends of another edge runs over it
        "bridges": _TREE + """, ends AS (SELECT graph_id, src AS a, dst AS b, edge_id FROM tree UNION ALL SELECT graph_id, dst, src, edge_id FROM tree),
            rest AS (SELECT r.graph_id, r.src, r.dst, r.k[2] AS edge_id FROM ranked r ANTI JOIN tree t USING (graph_id, k)),
            run AS (SELECT graph_id, edge_id, dst, src AS at, 0 AS via, []::BIGINT[] AS line FROM rest UNION ALL SELECT u.graph_id, u.edge_id, u.dst, e.b, e.edge_id, list_append(u.line, e.edge_id) FROM run u JOIN ends e ON e.graph_id = u.graph_id AND e.a = u.at AND e.edge_id <> u.via WHERE u.at <> u.dst),
            over AS (SELECT DISTINCT u.graph_id, unnest(u.line) AS edge_id FROM run u WHERE u.at = u.dst)
            SELECT t.graph_id, t.edge_id, o.edge_id IS NULL AS bridge FROM tree t LEFT JOIN over o USING (graph_id, edge_id) UNION ALL SELECT graph_id, edge_id, false FROM rest""",
        "parents_from_edges": _COMP + _FAR.format("(graph_id, node_id) IN (SELECT graph_id, component FROM comp)") + " SELECT graph_id, t AS node_id, s AS root, d AS dist, true AS after_parent FROM far",
        "geodesic_predecessors": _FAR.format("node_id % 31 = 3") + " SELECT s.graph_id, s.node_id AS source, t.node_id AS target, coalesce(f.d, -1) AS dist, true AS fits FROM nodes s JOIN nodes t USING (graph_id) LEFT JOIN far f ON f.graph_id = s.graph_id AND f.s = s.node_id AND f.t = t.node_id WHERE s.node_id % 31 = 3",
        "geodesic_path": _FAR.format("node_id % 31 = 3") + " SELECT graph_id, s AS source, t AS target, d AS length FROM far WHERE t = s + 31",
        "geodesic_mst_graph": _FAR.format("node_id % 31 = 3") + """, near AS (SELECT graph_id, s AS p, t AS q, (d, s, t) AS k FROM far WHERE t % 31 = 3 AND s < t),
            hops AS (SELECT graph_id, p, q, k FROM near UNION ALL SELECT graph_id, q, p, k FROM near),
            way AS (SELECT graph_id, p, q, k, p AS at FROM near UNION SELECT w.graph_id, w.p, w.q, w.k, l.q FROM way w JOIN hops l ON l.graph_id = w.graph_id AND l.p = w.at AND l.k < w.k)
            SELECT graph_id, count(*) AS n, sum(k[1]) AS total FROM near n WHERE NOT EXISTS (FROM way w WHERE w.graph_id = n.graph_id AND w.p = n.p AND w.q = n.q AND w.at = n.q) GROUP BY ALL""",
        "prepared_nearest": _FAR.format("node_id % 31 = 3") + _EXTREME.format("min", ""),
        "prepared_farthest": _FAR.format("node_id % 31 = 3") + _EXTREME.format("max", "-"),
        "prepared_grow": _SEED + _FAR.format("(graph_id, node_id) IN (FROM seed)") + " SELECT * FROM (SELECT graph_id, t * 10 AS item_id, d AS dist, row_number() OVER (PARTITION BY graph_id ORDER BY d, t) - 1 AS ord FROM far WHERE t % 2 = 0) WHERE ord < 12",
        "prepared_farthest_seed": _SEED + _FAR.format("(graph_id, node_id) IN (FROM seed)") + " SELECT graph_id, min_by(t, (-d, t)) * 10 AS item_id FROM far WHERE t % 2 = 0 AND s <> t GROUP BY ALL",
        "csgraph_components": _COMP + " SELECT graph_id, node_id, (SELECT count(DISTINCT component) FROM comp x WHERE x.graph_id = comp.graph_id)::INT AS n_components, (dense_rank() OVER (PARTITION BY graph_id ORDER BY component) - 1)::INT AS label FROM comp",
        "prepared_ball": _NEAR + " SELECT graph_id, node_id, dist, row_number() OVER (PARTITION BY graph_id ORDER BY dist, node_id) - 1 AS ord FROM (SELECT graph_id, t AS node_id, min(d) AS dist FROM near WHERE d <= 8 GROUP BY ALL)",
        "prepared_components": _COMP + " SELECT graph_id, node_id * 10 AS item_id, component FROM comp WHERE node_id % 2 = 0",
        "prepared_set_weights": " SELECT graph_id, src, dst, CASE WHEN src % 5 = 0 THEN weight + 1 ELSE weight END AS weight FROM edges",
        "prepared_subset": ", k AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY -node_id) - 1 AS n FROM nodes WHERE node_id % 2 = 0) SELECT e.graph_id, a.n AS src, b.n AS dst, e.weight FROM edges e JOIN k a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN k b ON b.graph_id = e.graph_id AND b.node_id = e.dst",
    }.items()
}

ORACLES["prepared_distances"] = "WITH RECURSIVE " + TRADE + _FAR.format("node_id % 31 = 3") + " SELECT s.graph_id, s.node_id AS source, t.node_id AS target, coalesce(f.d, -1) AS dist FROM nodes s JOIN nodes t ON t.graph_id = s.graph_id AND t.node_id % 37 = 5 LEFT JOIN far f ON f.graph_id = s.graph_id AND f.s = s.node_id AND f.t = t.node_id WHERE s.node_id % 31 = 3"
ORACLES |= {f"prepared_{k}": ORACLES[f"geodesic_{k}"] for k in ("predecessors", "path")}
