"""Queries of the score-table operators: average order values between groups of customers and clerks' priorities."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborix.catalog.inputs import table
from arborix.operators import scores as s


def square(spark, sf_dir):
    """How often line items of supplier group q carry part group t (61 by 61), as a share of 128."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 61).alias("q"), (F.col("l_partkey") % 61).alias("t")).agg((F.sum((F.col("l_linenumber") + F.col("l_partkey") % 5).cast("long")) / 128.0).alias("score"))


SQUARE = "WITH scores AS (SELECT l_suppkey % 61 AS q, l_partkey % 61 AS t, sum(l_linenumber + l_partkey % 5) / 128.0::DOUBLE AS score FROM lineitem GROUP BY ALL)"


def _q(fn):
    return lambda spark, sf_dir: fn(square(spark, sf_dir))


def _sets(x):
    return s.condensed_distances(x, "mean", "none").withColumn("cluster_set", F.lit(0).cast("long"))


QUERIES = {
    "top_matches": _q(lambda x: s.top_matches(x, 5, skip_self=True)),
    "matches_above": _q(lambda x: s.matches_above(x, percentage=0.1)),
    "count_matches": _q(lambda x: s.count_matches(x, threshold=0.8)),
    "symmetrize": _q(lambda x: s.symmetrize(x, "mean")),
    "condensed_distances": _q(lambda x: s.condensed_distances(x, "max")),
    "linkage": _q(lambda x: s.linkage(_sets(x), "average")),
    "linkage_single": _q(lambda x: s.linkage(_sets(x), "single").select("cluster_set", "step", "distance")),
    "linkage_ward": _q(lambda x: s.linkage(_sets(x), "ward")),
    "leaf_order": _q(lambda x: s.leaf_order(s.linkage(_sets(x), "single"))),
}
ORACLES = {
    "top_matches": SQUARE + """, r AS (SELECT q, t, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS rank FROM scores WHERE q <> t),
        g AS (SELECT DISTINCT q, unnest(range(1, 6)) AS rank FROM scores)
        SELECT g.q AS grp, g.rank::INT AS rank, coalesce(r.t, -1) AS other, coalesce(r.score, 'nan'::DOUBLE) AS score FROM g LEFT JOIN r ON r.q = g.q AND r.rank = g.rank""",
    "matches_above": SQUARE + """, b AS (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM scores)
        SELECT q AS grp, row_number() OVER (PARTITION BY q ORDER BY score DESC, t)::INT AS rank, t AS other, score FROM b WHERE score >= best - abs(best * 0.1::DOUBLE)""",
    "count_matches": SQUARE + " SELECT q AS grp, count(*) FILTER (score >= 0.8) AS n FROM scores GROUP BY ALL",
    "symmetrize": SQUARE + " SELECT a.q, a.t, (a.score + b.score) / 2 AS score FROM scores a JOIN scores b ON b.q = a.t AND b.t = a.q",
    # the heights of single linkage are the edges of the minimum spanning tree
    "linkage_single": SQUARE.replace("WITH", "WITH RECURSIVE") + """, pairs AS (SELECT a.q AS p, a.t AS q, ((a.score + b.score) / 2, a.q, a.t) AS k FROM scores a JOIN scores b ON b.q = a.t AND b.t = a.q WHERE a.q < a.t),
        links AS (SELECT p, q, k FROM pairs UNION ALL SELECT q, p, k FROM pairs),
        way AS (SELECT k, p AS place FROM pairs UNION SELECT w.k, l.q FROM way w JOIN links l ON l.p = w.place AND l.k < w.k)
        SELECT 0::BIGINT AS cluster_set, row_number() OVER (ORDER BY k) - 1 AS step, k[1] AS distance FROM pairs n WHERE NOT EXISTS (FROM way w WHERE w.k = n.k AND w.place = n.q)""",
    "condensed_distances": SQUARE + " SELECT a.q AS a, a.t AS b, 1 - greatest(a.score, b.score) AS distance FROM scores a JOIN scores b ON b.q = a.t AND b.t = a.q WHERE a.q < a.t",
}
