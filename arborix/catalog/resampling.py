"""Queries of the resampling operators: one chain of turns per conversation, and the heap-shaped forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborix.catalog.inputs import forest, table
from arborix.operators import resampling as r


def chains(spark, sf_dir):
    """A chain per user over all events in order of id; each event's parent is the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumns({"prev": F.lag("event_id", 1, -1).over(w), "k": F.row_number().over(w)})
    return e.select(
        F.col("user_id").alias("skeleton_id"), F.col("event_id").alias("node_id"), F.col("prev").alias("parent_id"), F.col("event_id").alias("ord"),
        F.lit(1.0).alias("weight"), F.col("k").cast("double").alias("x"), (F.col("event_id") % 17).cast("double").alias("y"), (F.col("event_id") % 5).cast("double").alias("z"),
    )


CHAINS = """WITH chains AS (
    SELECT user_id AS skeleton_id, event_id AS node_id, lag(event_id, 1, -1) OVER w AS parent_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n,
           (row_number() OVER w)::DOUBLE AS x, (event_id % 17)::DOUBLE AS y, (event_id % 5)::DOUBLE AS z
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def _q(fn, source=chains):
    return lambda spark, sf_dir: fn(source(spark, sf_dir))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("x", "y", "z")})


QUERIES = {
    "downsample_skeleton": _q(lambda n: r.downsample_skeleton(n, 3)[0]),
    "downsample_node_map": _q(lambda n: r.downsample_skeleton(n, 3)[1]),
    "simplify_rdp": _q(lambda n: r.simplify_rdp(n, 4.0)[0]),
    "simplify_vw": _q(lambda n: r.simplify_vw(n, 5.0)[0]),
    "resample_skeleton": _q(lambda n: r.resample_skeleton(n, 20.0), forest),
    "resample_node_map": _q(lambda n: r.resample_node_map(n, 20.0), forest),
    "smooth_skeleton": _q(lambda n: _rounded(r.smooth_skeleton(n, 5))),
    "smooth_skeleton_gaussian": _q(lambda n: r.smooth_skeleton_gaussian(n, 10.0)),
}
ORACLES = {
    # kept: both ends, and every third counted from the distal (last) one
    "downsample_skeleton": CHAINS + """, kept AS (SELECT *, lag(k) OVER (PARTITION BY skeleton_id ORDER BY k) AS pk, lag(node_id, 1, -1) OVER (PARTITION BY skeleton_id ORDER BY k) AS p FROM chains WHERE k = 1 OR (n - k) % 3 = 0)
        SELECT skeleton_id, node_id, p AS parent_id, coalesce(k - pk, 0)::DOUBLE AS weight FROM kept""",
    "downsample_node_map": CHAINS + """, mark AS (SELECT *, CASE WHEN k = 1 OR (n - k) % 3 = 0 THEN k END AS here FROM chains),
        ends AS (SELECT *, max(here) OVER (PARTITION BY skeleton_id ORDER BY k) AS up, min(here) OVER (PARTITION BY skeleton_id ORDER BY k DESC) AS down FROM mark)
        SELECT e.skeleton_id, e.node_id, t.node_id AS target FROM ends e JOIN chains t ON t.skeleton_id = e.skeleton_id AND t.k = CASE WHEN e.k - e.up <= e.down - e.k THEN e.up ELSE e.down END""",
    "smooth_skeleton": CHAINS + """, h AS (SELECT *, least(2, k - 1, n - k) AS h FROM chains)
        SELECT a.skeleton_id, a.node_id, round(avg(b.x), 6) AS x, round(avg(b.y), 6) AS y, round(avg(b.z), 6) AS z
        FROM h a JOIN h b ON b.skeleton_id = a.skeleton_id AND b.k BETWEEN a.k - a.h AND a.k + a.h GROUP BY ALL""",
}
