"""Ancestors of forest nodes as DataFrames: for objects too large for one task, and for joins on ancestry.

``nodes`` has skeleton_id, node_id, parent_id and optionally weight (the edge to the parent).
Each doubling round joins the pointer table to itself, so depth d takes log2(d) + 1 rounds whatever the width.
Each round is written by ``checkpoint``, to cut the lineage.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["skeleton_id", "node_id"]


def parents(nodes: DataFrame) -> DataFrame:
    """skeleton_id, node_id, parent (null for a root: -1 or an id that is not a node), weight."""
    weight = F.col("weight").cast("double") if "weight" in nodes.columns else F.lit(1.0)
    own = nodes.select("skeleton_id", "node_id", F.col("parent_id").alias("p"), weight.alias("weight"))
    there = nodes.select(F.col("skeleton_id").alias("s"), F.col("node_id").alias("n"))
    out = own.join(there, (own["skeleton_id"] == there["s"]) & (own["p"] == there["n"]), "left")
    return out.select("skeleton_id", "node_id", F.col("n").alias("parent"), F.when(F.col("n").isNull(), 0.0).otherwise(F.col("weight")).alias("weight"))


def _cut(df: DataFrame) -> DataFrame:
    """Checkpoint below ``spark.checkpoint.dir``; unset, in a fresh folder on a single machine and an error on a cluster."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.conf.get("spark.master", "")
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="arborix-")
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def to_root(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """skeleton_id, node_id, root, dist, hops; root is null for nodes that never arrive (a cycle)."""
    hop = parents(nodes).select(
        *KEY, F.col("parent").alias("to"), F.coalesce("parent", "node_id").alias("root"), F.col("weight").alias("dist"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("hops")
    )
    n = nodes.groupBy("skeleton_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(min(max_rounds, max(1, int(n).bit_length() + 1))):
        if not hop.where("to is not null").limit(1).count():
            break
        far = hop.select(F.col("skeleton_id").alias("s"), F.col("node_id").alias("k"), F.col("to").alias("to2"), F.col("root").alias("root2"), F.col("dist").alias("d2"), F.col("hops").alias("h2"))
        met = hop.join(far, (hop["skeleton_id"] == far["s"]) & (hop["to"] == far["k"]), "left")
        hop = _cut(
            met.select(
                *KEY, F.col("to2").alias("to"), F.coalesce("root2", "root").alias("root"), (F.col("dist") + F.coalesce("d2", F.lit(0.0))).alias("dist"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops")
            )
        )
    return hop.select(*KEY, F.when(F.col("to").isNull(), F.col("root")).alias("root"), "dist", "hops")


def closure(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """skeleton_id, node, anc, hops, dist: every node with each of its ancestors, itself included; N times depth rows."""
    p = parents(nodes)
    step = p.where("parent is not null").select("skeleton_id", F.col("node_id").alias("node"), F.col("parent").alias("anc"), F.lit(1).cast("long").alias("hops"), F.col("weight").alias("dist"))
    out = p.select("skeleton_id", F.col("node_id").alias("node"), F.col("node_id").alias("anc"), F.lit(0).cast("long").alias("hops"), F.lit(0.0).alias("dist"))
    # out: ancestors of fewer than 2**k hops; step: those of exactly 2**k hops
    for _ in range(max_rounds):
        if not step.limit(1).count():
            return out
        a = out.select("skeleton_id", F.col("node").alias("via"), "anc", F.col("hops").alias("h"), F.col("dist").alias("d"))
        b = step.select("skeleton_id", "node", F.col("anc").alias("via"), "hops", "dist")
        more = b.join(a, ["skeleton_id", "via"]).select("skeleton_id", "node", "anc", (F.col("hops") + F.col("h")).alias("hops"), (F.col("dist") + F.col("d")).alias("dist"))
        out = _cut(out.unionByName(more))
        c = step.select("skeleton_id", F.col("node").alias("via"), "anc", F.col("hops").alias("h"), F.col("dist").alias("d"))
        step = _cut(b.join(c, ["skeleton_id", "via"]).select("skeleton_id", "node", "anc", (F.col("hops") + F.col("h")).alias("hops"), (F.col("dist") + F.col("d")).alias("dist")))
    raise ValueError("the parent relation is deeper than 2 ** max_rounds or has a cycle")
