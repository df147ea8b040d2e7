"""Inputs derived from the standard tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight heap-shaped skeletons over part keys, cut into fragments at every 17th node."""
    i = F.expr("p_partkey div 8")
    return table(spark, sf_dir, "part").select(
        F.expr("p_partkey % 8").alias("skeleton_id"),
        i.alias("node_id"),
        F.expr("if((p_partkey div 8) % 17 = 0, -1L, ((p_partkey div 8) - 1) div 2)").alias("parent_id"),
        i.alias("ord"),
        F.expr("cast(1 + p_size % 7 as double)").alias("weight"),
        F.expr("cast(p_partkey % 101 as double)").alias("x"),
        F.expr("cast(p_size as double)").alias("y"),
        F.expr("cast((p_partkey * 7) % 53 as double)").alias("z"),
        F.expr("p_partkey % 3").alias("presynapses"),
        F.expr("p_partkey % 5").alias("postsynapses"),
    )


FOREST = """
    forest AS (
        SELECT p_partkey % 8 AS skeleton_id, p_partkey // 8 AS node_id,
               CASE WHEN (p_partkey // 8) % 17 = 0 THEN -1 ELSE ((p_partkey // 8) - 1) // 2 END AS parent_id,
               (1 + p_size % 7)::DOUBLE AS weight, (p_partkey % 101)::DOUBLE AS x, p_size::DOUBLE AS y,
               ((p_partkey * 7) % 53)::DOUBLE AS z, p_partkey % 3 AS presynapses, p_partkey % 5 AS postsynapses
        FROM part
    ), par AS (
        SELECT f.skeleton_id, f.node_id, p.node_id AS parent, CASE WHEN p.node_id IS NULL THEN 0 ELSE f.weight END AS weight
        FROM forest f LEFT JOIN forest p ON p.skeleton_id = f.skeleton_id AND p.node_id = f.parent_id
    ), clo AS (
        SELECT skeleton_id, node_id AS node, node_id AS anc, 0 AS hops, 0::DOUBLE AS dist FROM par
        UNION ALL
        SELECT c.skeleton_id, c.node, p.parent, c.hops + 1, c.dist + p.weight
        FROM clo c JOIN par p ON p.skeleton_id = c.skeleton_id AND p.node_id = c.anc WHERE p.parent IS NOT NULL
    ), kinds AS (
        SELECT p.skeleton_id, p.node_id, CASE WHEN p.parent IS NULL THEN 0 WHEN k.n IS NULL THEN 1 WHEN k.n > 1 THEN 2 ELSE 3 END AS kind
        FROM par p LEFT JOIN (SELECT skeleton_id, parent, count(*) AS n FROM par WHERE parent IS NOT NULL GROUP BY ALL) k
        ON k.skeleton_id = p.skeleton_id AND k.parent = p.node_id
    ), top AS (
        SELECT skeleton_id, node, max_by(anc, hops) AS root, max(dist) AS dist, max(hops) AS hops FROM clo GROUP BY ALL
    )
"""


def with_forest(sql: str) -> str:
    return f"WITH RECURSIVE {FOREST} {sql}"


def marked(nodes: DataFrame, modulus: int, rest: int) -> DataFrame:
    """The nodes whose id leaves ``rest``: the operator's own argument (sources or targets)."""
    return nodes.where(F.col("node_id") % modulus == rest).select("skeleton_id", "node_id")
