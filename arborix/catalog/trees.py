"""Queries of the rooted-forest and repair operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborix.catalog.inputs import forest, marked, table, with_forest
from arborix.operators import repair, trees
from arborix.plans import closure as plans


def region_distance(spark, sf_dir):
    """Distance from every order, customer, nation and region to its region's root, in one forest of four levels."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    one = lambda df, i, p, w: df.select(F.lit(0).cast("long").alias("skeleton_id"), i.cast("long").alias("node_id"), p.cast("long").alias("parent_id"), w.cast("double").alias("weight"))
    nodes = (
        one(r, F.col("r_regionkey"), F.lit(-1), F.lit(0))
        .unionByName(one(n, F.col("n_nationkey") + 1000, F.col("n_regionkey"), 1 + F.col("n_nationkey") % 7))
        .unionByName(one(c, F.col("c_custkey") + 100000, F.col("c_nationkey") + 1000, 1 + F.col("c_custkey") % 7))
        .unionByName(one(o, F.col("o_orderkey") + 1000000000, F.col("o_custkey") + 100000, 1 + F.col("o_orderkey") % 7))
    )
    out = plans.to_root(nodes)
    return out.select("node_id", F.col("root").alias("root_id"), "dist", "hops")


REGION_DISTANCE = """
    SELECT r_regionkey::BIGINT AS node_id, r_regionkey::BIGINT AS root_id, 0::DOUBLE AS dist, 0::BIGINT AS hops FROM region
    UNION ALL SELECT n_nationkey + 1000, n_regionkey, (1 + n_nationkey % 7)::DOUBLE, 1 FROM nation
    UNION ALL SELECT c_custkey + 100000, n_regionkey, (2 + c_custkey % 7 + n_nationkey % 7)::DOUBLE, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT o_orderkey + 1000000000, n_regionkey, (3 + o_orderkey % 7 + c_custkey % 7 + n_nationkey % 7)::DOUBLE, 3
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
"""


def _q(fn):
    return lambda spark, sf_dir: fn(forest(spark, sf_dir))


def _mapping(n):
    return n.select("skeleton_id", "node_id", F.expr("node_id - node_id % 3").alias("target"))


def _simple(n):
    kept, moved = trees.simplify_skeleton(n)
    return moved.join(kept.select("skeleton_id", F.col("node_id").alias("target"), F.col("parent_id").alias("target_parent"), F.col("weight").alias("target_weight")), ["skeleton_id", "target"])


def _circled(n):
    """In every third skeleton node 17 hangs below its own child 35."""
    return n.withColumn("parent_id", F.expr("if(skeleton_id % 3 = 0 and node_id = 17, 35L, parent_id)"))


QUERIES = {
    "region_distance": region_distance,
    "node_indices": _q(lambda n: trees.node_indices(n, n.select("skeleton_id", (F.col("node_id") * 2).alias("node_id")))),
    "classify_nodes": _q(trees.classify_nodes),
    "has_cycles": _q(lambda n: trees.has_cycles(_circled(n))),
    "connected_components": _q(trees.connected_components),
    "parent_dist": _q(lambda n: trees.parent_dist(n, 0.0).select("skeleton_id", "node_id", F.round("dist", 6).alias("dist"))),
    "dist_to_root": _q(trees.dist_to_root),
    "dist_to_root_by_doubling": _q(lambda n: plans.to_root(n).select("skeleton_id", "node_id", F.col("root").alias("root_id"), "dist", "hops")),
    "ancestor_closure": _q(plans.closure),
    "dist_to_root_hops": _q(lambda n: trees.dist_to_root(n, weighted=False)),
    "subtree_height": _q(trees.subtree_height),
    "descendants": _q(lambda n: trees.descendants(n, n.select("skeleton_id", "node_id"))),
    "paths_to_root": _q(lambda n: trees.paths_to_root(n, n.select("skeleton_id", "node_id"))),
    "descendant_counts": _q(trees.descendant_counts),
    "betweenness_directed": _q(trees.betweenness),
    "betweenness_undirected": _q(lambda n: trees.betweenness(n, directed=False)),
    "geodesic_matrix": _q(lambda n: trees.geodesic_matrix(n, marked(n, 23, 3), marked(n, 29, 4))),
    "geodesic_matrix_directed": _q(lambda n: trees.geodesic_matrix(n, marked(n, 23, 3), marked(n, 3, 0), directed=True)),
    # all nodes by all nodes
    "geodesic_matrix_all": _q(trees.geodesic_matrix),
    "geodesic_matrix_directed_all": _q(lambda n: trees.geodesic_matrix(n, directed=True)),
    "geodesic_pairs": _q(lambda n: trees.geodesic_pairs(n, n.select("skeleton_id", F.col("node_id").alias("source"), F.expr("node_id div 3").alias("target")))),
    "geodesic_nearest": _q(lambda n: trees.geodesic_nearest(n, n.select("skeleton_id", "node_id"), marked(n, 11, 4))),
    "geodesic_farthest": _q(lambda n: trees.geodesic_farthest(n, n.select("skeleton_id", "node_id"), marked(n, 11, 4))),
    "generate_segments": _q(trees.generate_segments),
    "break_segments": _q(trees.break_segments),
    "segment_coords": _q(trees.segment_coords),
    "strahler_index": _q(trees.strahler_index),
    "strahler_greedy": _q(lambda n: trees.strahler_index(n, "greedy", min_twig_size=3)),
    "prune_twigs": _q(lambda n: trees.prune_twigs(n, 4.0)),
    "synapse_flow_centrality": _q(trees.synapse_flow_centrality),
    "reroot": _q(lambda n: trees.reroot(n, marked(n, 41, 40))),
    "contract_nodes": _q(lambda n: trees.contract_nodes(n, _mapping(n))),
    "simplify_skeleton": _q(_simple),
    "adjacency": _q(lambda n: trees.adjacency(n, directed=False)),
    "adjacency_positions": _q(lambda n: trees.adjacency(n.where("node_id % 5 <> 3"), positions=True)),
    "longest_path": _q(trees.longest_path),
    "longest_paths": _q(lambda n: trees.longest_paths(n, 5, 2.0)),
    "stitch_fragments": _q(lambda n: repair.stitch_fragments(n).select("skeleton_id", "a", "b", F.round("length", 6).alias("length"))),
    "heal_skeleton": _q(lambda n: repair.heal_skeleton(n, "LEAFS", max_dist=60.0)),
    "reroot_rewire": _q(lambda n: repair.reroot_rewire(n, marked(n, 17, 0).select("skeleton_id", F.col("node_id").alias("a"), F.lit(1).cast("long").alias("b")))),
}

# leafs: nodes without children; own: the leaf whose longest path each node is on; seg: each leaf's path with the node it ends at
_PEEL = """, leafs AS (SELECT skeleton_id, node_id FROM par p WHERE NOT EXISTS (FROM par k WHERE k.skeleton_id = p.skeleton_id AND k.parent = p.node_id)),
    own AS (SELECT c.skeleton_id, c.anc AS node_id, min_by(c.node, (-t.dist, c.node)) AS leaf FROM clo c JOIN leafs l ON l.skeleton_id = c.skeleton_id AND l.node_id = c.node
        JOIN top t ON t.skeleton_id = c.skeleton_id AND t.node = c.node GROUP BY ALL),
    body AS (SELECT c.skeleton_id, c.node AS leaf, c.anc AS node_id, c.hops AS pos, c.dist AS d FROM clo c JOIN own o ON o.skeleton_id = c.skeleton_id AND o.node_id = c.anc AND o.leaf = c.node),
    final AS (SELECT skeleton_id, leaf, max(pos) AS pos, max(d) AS d FROM body GROUP BY ALL),
    seg AS (FROM body UNION ALL SELECT c.skeleton_id, c.node, c.anc, c.hops, c.dist FROM clo c JOIN final l ON l.skeleton_id = c.skeleton_id AND l.leaf = c.node AND c.hops = l.pos + 1),
    whole AS (SELECT skeleton_id, leaf, max(d) AS length FROM seg GROUP BY ALL),
    num AS (SELECT w.*, row_number() OVER (PARTITION BY w.skeleton_id ORDER BY length DESC, t.dist DESC, leaf) - 1 AS segment FROM whole w JOIN top t ON t.skeleton_id = w.skeleton_id AND t.node = w.leaf)
"""
_KIDS = ", kids AS (SELECT skeleton_id, parent AS node_id, count(*) AS n FROM par WHERE parent IS NOT NULL GROUP BY ALL)"
# s1: all nodes; s(k): nodes at or above one that has two children in s(k - 1)
_STRAHLER = ", s1 AS (SELECT skeleton_id, node_id FROM par)" + "".join(
    f""", s{k} AS (SELECT DISTINCT c.skeleton_id, c.anc AS node_id FROM clo c JOIN (SELECT p.skeleton_id, p.parent FROM par p JOIN s{k - 1} USING (skeleton_id, node_id) WHERE p.parent IS NOT NULL GROUP BY ALL HAVING count(*) > 1) b
        ON b.skeleton_id = c.skeleton_id AND b.parent = c.node)"""
    for k in range(2, 13)
)
_LCA = """
    SELECT s.skeleton_id, s.node AS source, t.node AS target, min(s.dist + t.dist) AS dist
    FROM clo s JOIN clo t ON t.skeleton_id = s.skeleton_id AND t.anc = s.anc WHERE {} GROUP BY ALL
"""
_BLOCK = """
    SELECT a.skeleton_id, a.node_id AS source, b.node_id AS target, coalesce(d.dist, -1) AS dist
    FROM forest a JOIN forest b ON b.skeleton_id = a.skeleton_id AND {t} LEFT JOIN ({d}) d
    ON d.skeleton_id = a.skeleton_id AND d.source = a.node_id AND d.target = b.node_id WHERE {s}
"""
_EXTREME = """
    SELECT s.skeleton_id, s.node_id, coalesce(e.dist, -1) AS dist, coalesce(e.target, -1) AS target FROM forest s
    LEFT JOIN (
        SELECT skeleton_id, source, {0}(dist) AS dist, min_by(target, ({1}dist, target)) AS target
        FROM (""" + _LCA.format("t.node % 11 = 4 AND s.node <> t.node") + """) GROUP BY ALL
    ) e ON e.skeleton_id = s.skeleton_id AND e.source = s.node_id
"""

ORACLES = {"region_distance": REGION_DISTANCE} | {
    k: with_forest(v)
    for k, v in {
        "node_indices": "SELECT a.skeleton_id, a.node_id * 2 AS node_id, coalesce(b.node_id, -1) AS pos FROM forest a LEFT JOIN forest b ON b.skeleton_id = a.skeleton_id AND b.node_id = a.node_id * 2",
        "classify_nodes": "SELECT skeleton_id, node_id, kind FROM kinds",
        "has_cycles": """, ring AS (SELECT f.skeleton_id, f.node_id, p.node_id AS up FROM forest f JOIN forest p ON p.skeleton_id = f.skeleton_id AND p.node_id = CASE WHEN f.skeleton_id % 3 = 0 AND f.node_id = 17 THEN 35 ELSE f.parent_id END),
            over AS (SELECT skeleton_id, node_id, up FROM ring UNION SELECT o.skeleton_id, o.node_id, r.up FROM over o JOIN ring r ON r.skeleton_id = o.skeleton_id AND r.node_id = o.up)
            SELECT f.skeleton_id, f.skeleton_id IN (SELECT skeleton_id FROM over WHERE node_id = up) AS cyclic FROM (SELECT DISTINCT skeleton_id FROM forest) f""",
        "connected_components": "SELECT skeleton_id, node AS node_id, root AS root_id FROM top",
        "parent_dist": "SELECT f.skeleton_id, f.node_id, coalesce(round(sqrt((f.x-p.x)*(f.x-p.x)+(f.y-p.y)*(f.y-p.y)+(f.z-p.z)*(f.z-p.z)), 6), 0) AS dist FROM forest f LEFT JOIN forest p ON p.skeleton_id = f.skeleton_id AND p.node_id = f.parent_id",
        "dist_to_root": "SELECT skeleton_id, node AS node_id, dist FROM top",
        "dist_to_root_by_doubling": "SELECT skeleton_id, node AS node_id, root AS root_id, dist, hops FROM top",
        "ancestor_closure": "SELECT * FROM clo",
        "dist_to_root_hops": "SELECT skeleton_id, node AS node_id, hops::DOUBLE AS dist FROM top",
        "subtree_height": "SELECT skeleton_id, anc AS node_id, max(dist) AS height FROM clo GROUP BY ALL",
        # depth-first with children in order of id: the order of the paths from the root
        "descendants": """, line AS (SELECT skeleton_id, node, list(anc ORDER BY hops DESC) AS line FROM clo GROUP BY ALL)
            SELECT c.skeleton_id, c.anc AS source, row_number() OVER (PARTITION BY c.skeleton_id, c.anc ORDER BY l.line) - 1 AS pos, c.node AS node_id FROM clo c JOIN line l USING (skeleton_id, node)""",
        "paths_to_root": "SELECT skeleton_id, node AS source, hops AS pos, anc AS node_id FROM clo",
        "descendant_counts": "SELECT skeleton_id, anc AS node_id, count(*) - 1 AS n FROM clo GROUP BY ALL",
        "betweenness_directed": "SELECT d.skeleton_id, d.node_id, d.n * t.hops AS betweenness FROM (SELECT skeleton_id, anc AS node_id, count(*) - 1 AS n FROM clo GROUP BY ALL) d JOIN top t ON t.skeleton_id = d.skeleton_id AND t.node = d.node_id",
        "betweenness_undirected": """, size AS (SELECT skeleton_id, anc AS node_id, count(*) AS n FROM clo GROUP BY ALL),
            whole AS (SELECT t.skeleton_id, t.node AS node_id, s.n AS n FROM top t JOIN size s ON s.skeleton_id = t.skeleton_id AND s.node_id = t.root),
            kid AS (SELECT p.skeleton_id, p.parent AS node_id, sum(s.n) AS s1, sum(s.n * s.n) AS s2 FROM par p JOIN size s USING (skeleton_id, node_id) WHERE p.parent IS NOT NULL GROUP BY ALL)
            SELECT w.skeleton_id, w.node_id, (((w.n - 1) * (w.n - 1) - coalesce(s2, 0) - (w.n - 1 - coalesce(s1, 0)) * (w.n - 1 - coalesce(s1, 0))) // 2)::BIGINT AS betweenness
            FROM whole w LEFT JOIN kid USING (skeleton_id, node_id)""",
        "geodesic_matrix": _BLOCK.format(s="a.node_id % 23 = 3", t="b.node_id % 29 = 4", d=_LCA.format("s.node % 23 = 3 AND t.node % 29 = 4")),
        "geodesic_matrix_directed": _BLOCK.format(s="a.node_id % 23 = 3", t="b.node_id % 3 = 0", d="SELECT skeleton_id, node AS source, anc AS target, dist FROM clo"),
        "geodesic_matrix_all": _BLOCK.format(s="true", t="true", d=_LCA.format("true")),
        "geodesic_matrix_directed_all": _BLOCK.format(s="true", t="true", d="SELECT skeleton_id, node AS source, anc AS target, dist FROM clo"),
        "geodesic_pairs": "SELECT f.skeleton_id, f.node_id AS source, f.node_id // 3 AS target, coalesce(d.dist, -1) AS dist FROM forest f LEFT JOIN (" + _LCA.format("t.node = s.node // 3") + ") d ON d.skeleton_id = f.skeleton_id AND d.source = f.node_id",
        "geodesic_nearest": _EXTREME.format("min", ""),
        "geodesic_farthest": _EXTREME.format("max", "-"),
        "break_segments": """, ends AS (
                SELECT c.skeleton_id, c.node, c.anc, c.hops, row_number() OVER (PARTITION BY c.skeleton_id, c.node ORDER BY c.hops) AS r
                FROM clo c JOIN kinds a ON a.skeleton_id = c.skeleton_id AND a.node_id = c.node AND a.kind IN (1, 2)
                JOIN kinds b ON b.skeleton_id = c.skeleton_id AND b.node_id = c.anc AND b.kind IN (0, 2) WHERE c.hops > 0)
            SELECT c.skeleton_id, dense_rank() OVER (PARTITION BY c.skeleton_id ORDER BY c.node) - 1 AS segment, c.hops AS pos, c.anc AS node_id
            FROM ends e JOIN clo c ON c.skeleton_id = e.skeleton_id AND c.node = e.node AND c.hops <= e.hops WHERE e.r = 1""",
        "generate_segments": _PEEL + "SELECT skeleton_id, segment, pos, node_id, length FROM seg JOIN num USING (skeleton_id, leaf)",
        "segment_coords": _PEEL + "SELECT s.skeleton_id, n.segment, s.pos, s.node_id, n.length, f.x, f.y, f.z FROM seg s JOIN num n USING (skeleton_id, leaf) JOIN forest f ON f.skeleton_id = s.skeleton_id AND f.node_id = s.node_id",
        # the same peel, each path ending before the node it would join; paths whose catchment is too small end the list
        "longest_paths": _PEEL + """, fan AS (SELECT skeleton_id, parent AS node_id, sum(weight) AS w FROM par WHERE parent IS NOT NULL GROUP BY ALL),
            rank AS (SELECT b.skeleton_id, b.leaf, row_number() OVER (PARTITION BY b.skeleton_id ORDER BY l.d DESC, b.leaf) - 1 AS path, coalesce(sum(w), 0) AS catchment
                FROM body b JOIN final l USING (skeleton_id, leaf) LEFT JOIN fan f ON f.skeleton_id = b.skeleton_id AND f.node_id = b.node_id GROUP BY b.skeleton_id, b.leaf, l.d),
            stop AS (SELECT skeleton_id, min(path) FILTER (catchment <= 2) AS path FROM rank GROUP BY ALL)
            SELECT b.skeleton_id, r.path, b.pos, b.node_id FROM body b JOIN rank r USING (skeleton_id, leaf) JOIN stop s ON s.skeleton_id = b.skeleton_id WHERE r.path < least(5, coalesce(s.path, 5))""",
        "strahler_index": _STRAHLER + "SELECT skeleton_id, node_id, max(k) AS strahler FROM (" + " UNION ALL ".join(f"SELECT *, {k}::BIGINT AS k FROM s{k}" for k in range(1, 13)) + ") GROUP BY ALL",
        # leaves right below a branch point are left out and take its index; the others are counted
        "strahler_greedy": _KIDS + """, gone AS (SELECT p.skeleton_id, p.node_id, p.parent FROM par p LEFT JOIN kids k USING (skeleton_id, node_id) JOIN kids u ON u.skeleton_id = p.skeleton_id AND u.node_id = p.parent WHERE k.n IS NULL AND u.n > 1),
            live AS (SELECT skeleton_id, node_id, parent FROM par ANTI JOIN gone USING (skeleton_id, node_id)),
            ends AS (SELECT skeleton_id, node_id FROM live l WHERE NOT EXISTS (FROM live k WHERE k.skeleton_id = l.skeleton_id AND k.parent = l.node_id)),
            value AS (SELECT c.skeleton_id, c.anc AS node_id, count(*) AS strahler FROM clo c JOIN ends e ON e.skeleton_id = c.skeleton_id AND e.node_id = c.node GROUP BY ALL)
            FROM value UNION ALL SELECT g.skeleton_id, g.node_id, v.strahler FROM gone g JOIN value v ON v.skeleton_id = g.skeleton_id AND v.node_id = g.parent""",
        "prune_twigs": _KIDS + """, leafs AS (SELECT skeleton_id, node_id FROM par ANTI JOIN kids USING (skeleton_id, node_id)),
            fork AS (SELECT c.skeleton_id, c.node, min(c.hops) AS hops FROM clo c JOIN kids k ON k.skeleton_id = c.skeleton_id AND k.node_id = c.anc AND k.n > 1 GROUP BY ALL),
            twig AS (SELECT c.skeleton_id, c.node AS leaf, c.anc AS node_id, f.weight FROM clo c JOIN leafs l ON l.skeleton_id = c.skeleton_id AND l.node_id = c.node JOIN forest f ON f.skeleton_id = c.skeleton_id AND f.node_id = c.anc
                LEFT JOIN fork k ON k.skeleton_id = c.skeleton_id AND k.node = c.node WHERE c.hops < coalesce(k.hops, 1000000)),
            small AS (SELECT skeleton_id, leaf FROM twig GROUP BY ALL HAVING sum(weight) <= 4)
            SELECT skeleton_id, node_id FROM forest ANTI JOIN (SELECT t.skeleton_id, t.node_id FROM twig t JOIN small USING (skeleton_id, leaf)) USING (skeleton_id, node_id)""",
        # closest pairs of fragments; one is a bridge where no way over closer pairs joins its fragments
        "stitch_fragments": """, pairs AS (SELECT a.skeleton_id, u.root AS ra, v.root AS rb, a.node_id AS a, b.node_id AS b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d
                FROM forest a JOIN forest b ON b.skeleton_id = a.skeleton_id AND a.node_id < b.node_id JOIN top u ON u.skeleton_id = a.skeleton_id AND u.node = a.node_id JOIN top v ON v.skeleton_id = b.skeleton_id AND v.node = b.node_id WHERE u.root <> v.root),
            near AS (SELECT skeleton_id, least(ra, rb) AS p, greatest(ra, rb) AS q, min((d, a, b)) AS k FROM pairs GROUP BY ALL),
            links AS (SELECT skeleton_id, p, q, k FROM near UNION ALL SELECT skeleton_id, q, p, k FROM near),
            way AS (SELECT skeleton_id, p, q, k, p AS at FROM near UNION SELECT w.skeleton_id, w.p, w.q, w.k, l.q FROM way w JOIN links l ON l.skeleton_id = w.skeleton_id AND l.p = w.at AND l.k < w.k)
            SELECT n.skeleton_id, k[2] AS a, k[3] AS b, round(sqrt(k[1]), 6) AS length FROM near n WHERE NOT EXISTS (FROM way w WHERE w.skeleton_id = n.skeleton_id AND w.p = n.p AND w.q = n.q AND w.at = n.q)""",
        "synapse_flow_centrality": """, below AS (SELECT c.skeleton_id, c.anc AS node_id, sum(f.presynapses) AS pre, sum(f.postsynapses) AS post
                FROM clo c JOIN forest f ON f.skeleton_id = c.skeleton_id AND f.node_id = c.node GROUP BY ALL)
            SELECT b.skeleton_id, b.node_id, ((r.post - b.post) * b.pre + (r.pre - b.pre) * b.post)::BIGINT AS flow
            FROM below b JOIN top t ON t.skeleton_id = b.skeleton_id AND t.node = b.node_id JOIN below r ON r.skeleton_id = t.skeleton_id AND r.node_id = t.root""",
        "reroot": """, wanted AS (SELECT t.skeleton_id, t.root, min(t.node) AS node FROM top t WHERE t.node % 41 = 40 GROUP BY ALL),
            flip AS (SELECT c.skeleton_id, c.anc AS node_id, lag(c.anc, 1, -1) OVER (PARTITION BY c.skeleton_id, c.node ORDER BY c.hops) AS parent_id
                FROM clo c JOIN wanted w ON w.skeleton_id = c.skeleton_id AND w.node = c.node)
            SELECT p.skeleton_id, p.node_id, coalesce(f.parent_id, p.parent, -1) AS parent_id FROM par p LEFT JOIN flip f USING (skeleton_id, node_id)""",
        "contract_nodes": "SELECT skeleton_id, node_id, CASE WHEN parent IS NULL OR parent - parent % 3 = node_id THEN -1 ELSE parent - parent % 3 END AS parent_id FROM par WHERE node_id % 3 = 0",
        "simplify_skeleton": """, key AS (SELECT skeleton_id, node_id FROM kinds WHERE kind <> 3),
            up AS (SELECT c.skeleton_id, c.node AS node_id, min_by(c.anc, c.hops) AS anc, min(c.dist) AS dist FROM clo c JOIN key k ON k.skeleton_id = c.skeleton_id AND k.node_id = c.anc WHERE c.hops > 0 GROUP BY ALL),
            low AS (SELECT c.skeleton_id, c.anc AS node_id, min_by(c.node, c.hops) AS node, min(c.dist) AS dist FROM clo c JOIN key k ON k.skeleton_id = c.skeleton_id AND k.node_id = c.node GROUP BY ALL),
            moved AS (SELECT p.skeleton_id, p.node_id, CASE WHEN k.node_id IS NOT NULL THEN p.node_id WHEN u.dist <= l.dist THEN u.anc ELSE l.node END AS target
                FROM par p LEFT JOIN key k USING (skeleton_id, node_id) LEFT JOIN up u USING (skeleton_id, node_id) LEFT JOIN low l USING (skeleton_id, node_id))
            SELECT m.skeleton_id, m.node_id, m.target, coalesce(u.anc, -1) AS target_parent, coalesce(u.dist, 0) AS target_weight FROM moved m LEFT JOIN up u ON u.skeleton_id = m.skeleton_id AND u.node_id = m.target""",
        "adjacency": "SELECT skeleton_id, node_id AS row, parent AS col, weight AS value FROM par WHERE parent IS NOT NULL UNION ALL SELECT skeleton_id, parent, node_id, weight FROM par WHERE parent IS NOT NULL",
        "adjacency_positions": """, part_of AS (SELECT *, row_number() OVER (PARTITION BY skeleton_id ORDER BY node_id) - 1 AS pos FROM forest WHERE node_id % 5 <> 3)
            SELECT c.skeleton_id, c.pos AS row, p.pos AS col, c.weight AS value FROM part_of c JOIN part_of p ON p.skeleton_id = c.skeleton_id AND p.node_id = c.parent_id""",
        "longest_path": ", far AS (SELECT skeleton_id, min_by(node, (-dist, node)) AS node FROM top GROUP BY ALL) SELECT c.skeleton_id, c.hops AS pos, c.anc AS node_id FROM clo c JOIN far f ON f.skeleton_id = c.skeleton_id AND f.node = c.node",
    }.items()
}
