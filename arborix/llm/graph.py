"""Connected components of a large edge list, by alternating large-star and small-star steps.

Edges and labels stay distributed: each partition first keeps a spanning forest of its own edges (in bounded buffers), each
step is a minimum per node (combined before the shuffle) and a join, and each round is written to the shared folder. Nodes are
integers; the label of a component is its smallest node. Nodes without edges are not in the result; nulls are no nodes.
The path is the same at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.llm._spark import discard, save

HELD = 400_000  # edges a task reduces at once


def local_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list in memory and the smallest node each can reach."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges that connect the same nodes: each node with the smallest it can reach."""
    node, root = local_labels(a, b)
    return node[node != root], root[node != root]


def _forests(batches):
    held, size = [], 0

    def reduced():
        return local_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def sent(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += batch.num_rows
        if size > HELD:
            held = [reduced()]
            size = len(held[0][0])
            if size > HELD // 2:
                yield sent(*held[0])
                held, size = [], 0
    if held:
        yield sent(*reduced())


def _stars(e: DataFrame) -> bool:
    """Whether every node is either a root or has exactly one neighbour, its root."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return not ends.where("up > 1 or (up = 1 and root = 1)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); read from a scratch file that ``discard`` deletes."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    e = save(e.mapInArrow(_forests, "a bigint, b bigint").distinct(), "edges")
    while not _stars(e):
        # large star: every larger neighbour goes to the smallest one
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, e = e, save(small.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        discard(before)
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    out._scratch = e._scratch
    return out
