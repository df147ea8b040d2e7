"""Rooted-forest operators: DataFrame in, DataFrame out, many skeletons at once.

``nodes``: skeleton_id, node_id, parent_id, and as an operator needs them ord (input order, for ties),
weight (of the edge to the parent; without it edges count 1), x, y, z. Operators that look at a node and its
neighbours are joins and aggregates. Those that walk are kernels on one skeleton per group after one shuffle on skeleton_id;
``plans.closure`` has the relational forms of the most used ones for a skeleton too large for one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.kernels.forest import CycleError, Forest, block_distances, climb
from arborix.plans import closure as plans
from arborix.schema import NONE, euclid, need, only, per_block, per_object, per_pair

BASE = ("skeleton_id", "node_id", "parent_id", "ord", "weight")
NODE = "skeleton_id bigint, node_id bigint"
#: result rows of a dealt block, and the arrays that a skeleton's blocks need
BLOCK, RUNS = 1 << 24, 1 << 22
_LABELS = ("ids", "source", "target", "place", "end", "deep", "low", "low_deep")
_RUNS = ("ids", "link", "source", "start", "count")
_MATRIX = "skeleton_id bigint, blocks bigint, " + ", ".join(f"{c} binary" for c in _LABELS)


def _forest(pdf: pd.DataFrame, weighted: bool = True) -> tuple[Forest, pd.DataFrame]:
    pdf = pdf.sort_values("ord" if "ord" in pdf else "node_id", kind="stable").reset_index(drop=True)
    return Forest(pdf.node_id, pdf.parent_id, pdf.weight if weighted and "weight" in pdf else None), pdf


def _each(nodes: DataFrame, fn, schema: str, *more: str) -> DataFrame:
    need(nodes, "skeleton_id", "node_id", "parent_id")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        f, pdf = _forest(pdf)
        out = fn(f, pdf)
        out.insert(0, "skeleton_id", pdf.skeleton_id.iloc[0])
        return out

    return per_object(only(nodes, *BASE, *more), "skeleton_id", kernel, schema)


def _with(nodes: DataFrame, other: DataFrame, fn, schema: str) -> DataFrame:
    """As ``_each``, with the skeleton's rows of a second table."""
    columns = other.columns

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        f, left = _forest(left)
        if not len(right):
            right = pd.DataFrame({c: pd.Series([], dtype="int64") for c in columns})
        out = fn(f, left, right)
        out.insert(0, "skeleton_id", left.skeleton_id.iloc[0])
        return out

    return per_pair(only(nodes, *BASE), other, "skeleton_id", kernel, schema)


# -- identity and neighbours: relational -----------------------------------------------------------------


def node_indices(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """For each row of ``ids`` (skeleton_id, node_id) its row number in ``nodes`` by ord, or -1."""
    order = "ord" if "ord" in nodes.columns else "node_id"
    from pyspark.sql import Window

    pos = nodes.select("skeleton_id", "node_id", (F.row_number().over(Window.partitionBy("skeleton_id").orderBy(order)) - 1).cast("long").alias("pos"))
    return ids.select("skeleton_id", "node_id").join(pos, ["skeleton_id", "node_id"], "left").na.fill(NONE, ["pos"])


def classify_nodes(nodes: DataFrame) -> DataFrame:
    """kind: 0 root, 1 leaf, 2 branch, 3 slab; a root is a root whatever its children."""
    p = plans.parents(nodes)
    kids = p.where("parent is not null").groupBy("skeleton_id", F.col("parent").alias("node_id")).agg(F.count("*").alias("kids"))
    kind = F.when(F.col("parent").isNull(), 0).when(F.col("kids").isNull(), 1).when(F.col("kids") > 1, 2).otherwise(3)
    return p.join(kids, ["skeleton_id", "node_id"], "left").select("skeleton_id", "node_id", kind.cast("int").alias("kind"))


def parent_dist(nodes: DataFrame, root_dist: float | None = None) -> DataFrame:
    """Euclidean distance to the parent; NaN (or ``root_dist``) for roots."""
    need(nodes, "x", "y", "z")
    up = nodes.select("skeleton_id", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    met = nodes.join(up, ["skeleton_id", "parent_id"], "left")
    d = euclid(tuple(F.col(c) for c in "xyz"), tuple(F.col(f"p{c}") for c in "xyz"))
    rest = F.lit(float("nan") if root_dist is None else float(root_dist))
    return met.select("skeleton_id", "node_id", F.when(F.col("px").isNull(), rest).otherwise(d).alias("dist"))


def contract_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Survivors and their parents after each node is mapped (skeleton_id, node_id, target); a cycle is an error when the result is read.

    A survivor maps to itself. Only its own parent edge is followed; an edge into itself makes it a root.
    """
    stays = mapping.where(F.col("node_id") == F.col("target")).select("skeleton_id", "node_id")
    own = nodes.select("skeleton_id", "node_id", "parent_id").join(stays, ["skeleton_id", "node_id"])
    to = mapping.select("skeleton_id", F.col("node_id").alias("parent_id"), F.col("target").alias("to"))
    out = own.join(to, ["skeleton_id", "parent_id"], "left")
    out = out.select("skeleton_id", "node_id", F.when(F.col("to").isNull() | (F.col("to") == F.col("node_id")), NONE).otherwise(F.col("to")).alias("parent_id"))

    def checked(pdf: pd.DataFrame) -> pd.DataFrame:
        if Forest(pdf.node_id, pdf.parent_id).has_cycles():
            raise CycleError(f"contracting skeleton {pdf.skeleton_id.iloc[0]} makes a cycle")
        return pdf

    return per_object(out, "skeleton_id", checked, f"{NODE}, parent_id bigint")


def adjacency(nodes: DataFrame, directed: bool = True, transpose: bool = False, positions: bool = False) -> DataFrame:
    """Sparse rows (row, col, value): child to parent; both ways if undirected; flipped if transposed.

    Rows and columns are node ids, or with ``positions`` the nodes' row numbers by ord (by id without it), as a compressed matrix has them.
    """
    if positions:
        at = node_indices(nodes, nodes.select("skeleton_id", "node_id"))
        child, parent = (at.select("skeleton_id", F.col("node_id").alias(c), F.col("pos").alias(n)) for c, n in (("node_id", "own"), ("parent_id", "up")))
        nodes = nodes.join(child, ["skeleton_id", "node_id"]).join(parent, ["skeleton_id", "parent_id"], "left")
        nodes = nodes.withColumns({"node_id": F.col("own"), "parent_id": F.coalesce("up", F.lit(NONE))})
    e = plans.parents(nodes).where("parent is not null").select("skeleton_id", F.col("node_id").alias("row"), F.col("parent").alias("col"), F.col("weight").alias("value"))
    flip = e.select("skeleton_id", F.col("col").alias("row"), F.col("row").alias("col"), "value")
    return e.unionByName(flip) if not directed else flip if transpose else e


# -- walks: one skeleton per group ------------------------------------------------------------------------


def has_cycles(nodes: DataFrame) -> DataFrame:
    """skeleton_id, cyclic."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f, pdf = _forest(pdf, False)
        return pd.DataFrame({"skeleton_id": pdf.skeleton_id.iloc[:1], "cyclic": [f.has_cycles()]})

    return per_object(only(nodes, *BASE), "skeleton_id", fn, "skeleton_id bigint, cyclic boolean")


def connected_components(nodes: DataFrame) -> DataFrame:
    """Each node's root id."""
    return _each(nodes, lambda f, p: pd.DataFrame({"node_id": f.ids, "root_id": f.ids[f.root()]}), f"{NODE}, root_id bigint")


def dist_to_root(nodes: DataFrame, weighted: bool = True) -> DataFrame:
    """Summed weights (or edges) to the root; 0 for roots. Join with the wanted sources, which may repeat."""
    return _each(nodes, lambda f, p: pd.DataFrame({"node_id": f.ids, "dist": f.root_distance(weighted)}), f"{NODE}, dist double")


def subtree_height(nodes: DataFrame) -> DataFrame:
    return _each(nodes, lambda f, p: pd.DataFrame({"node_id": f.ids, "height": f.height()}), f"{NODE}, height double")


def descendants(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Subtrees of ``sources`` (skeleton_id, node_id), the source first, in depth-first order."""

    def lay(f, at):
        pre = f.preorder()
        place = np.empty(f.n, np.int64)
        place[pre] = np.arange(f.n)
        return f.ids[pre], np.zeros(0, np.int64), place[at], f._sizes()[at]

    return _runs(nodes, sources, lay, lambda _, start, count, pos: np.repeat(start, count) + pos)


def paths_to_root(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Paths from each source to its root, the source first."""

    def lay(f, at):
        return f.ids, np.where(f.is_root, np.arange(f.n), f.parent), at, f.depth[at] + 1

    return _runs(nodes, sources, lay, lambda up, start, count, _: climb(up, start, count))


def _runs(nodes: DataFrame, sources: DataFrame, lay, fill) -> DataFrame:
    """(source, pos, node_id): a run of nodes for each source, dealt in blocks of sources that yield a few runs at a time.

    ``lay`` gives from a forest and the sources' rows the ids, what ``fill`` needs, and each run's start and length.
    """
    binary = "skeleton_id bigint, blocks bigint, " + ", ".join(f"{c} binary" for c in _RUNS)

    def pack(left, right):
        if not len(left):
            return pd.DataFrame({c.split()[0]: [] for c in binary.split(", ")})
        f, left = _forest(left, False)
        at = f.index(right.node_id)
        ids, link, start, count = lay(f, at[at >= 0])
        arrays = [ids, link, right.node_id.to_numpy(np.int64)[at >= 0], start, count]
        return pd.DataFrame({"skeleton_id": left.skeleton_id.iloc[:1], "blocks": [min(-(-int(count.sum()) // RUNS), len(count))]} | {c: [a.tobytes()] for c, a in zip(_RUNS, arrays, strict=True)})

    def expand(row):
        ids, link, source, start, count = (np.frombuffer(row[c], np.int64) for c in _RUNS)
        ends = np.cumsum(count)
        a, b = np.searchsorted(ends, [ends[-1] * k // row["blocks"] for k in (row["block"], row["block"] + 1)], "right").tolist()
        while a < b:
            c = max(a + 1, min(b, int(np.searchsorted(ends, ends[a] - count[a] + (1 << 19), "right"))))
            n = count[a:c]
            pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([np.full(len(pos), row["skeleton_id"]), np.repeat(source[a:c], n), pos, ids[fill(link, start[a:c], n, pos)]], ["skeleton_id", "source", "pos", "node_id"])
            a = c

    packed = per_pair(only(nodes, *BASE[:4]), sources.select("skeleton_id", "node_id"), "skeleton_id", pack, binary)
    return per_block(packed, "skeleton_id", expand, "skeleton_id bigint, source bigint, pos bigint, node_id bigint")


def descendant_counts(nodes: DataFrame, target: str | None = None) -> DataFrame:
    """Nodes strictly below (of those flagged by the boolean column ``target``)."""
    return _each(nodes, lambda f, p: pd.DataFrame({"node_id": f.ids, "n": f.descendant_counts(p[target] if target else None)}), f"{NODE}, n bigint", *([target] if target else []))


def betweenness(nodes: DataFrame, directed: bool = True) -> DataFrame:
    return _each(nodes, lambda f, p: pd.DataFrame({"node_id": f.ids, "betweenness": f.betweenness(directed)}), f"{NODE}, betweenness bigint")


def geodesic_matrix(nodes: DataFrame, sources: DataFrame | None = None, targets: DataFrame | None = None, directed: bool = False, weighted: bool = True) -> DataFrame:
    """(source, target, dist) of each skeleton's wanted nodes (all, or skeleton_id, node_id tables); -1 unreachable.

    One task labels a skeleton's wanted nodes, in memory linear in its nodes; blocks of sources are dealt over all tasks and each
    yields its distances a few sources at a time. An edge whose weight is not finite is no way.
    """
    asked = lambda df, role: (nodes.select("skeleton_id", "node_id") if df is None else df.select("skeleton_id", "node_id").distinct()).withColumn("role", F.lit(role).cast("int"))
    role = asked(None, 3) if sources is None and targets is None else asked(sources, 1).unionByName(asked(targets, 2))

    def pack(left, right):
        if not len(left):
            return pd.DataFrame({c.split()[0]: [] for c in _MATRIX.split(", ")})
        f, left = _forest(left)
        if weighted and not np.isfinite(f.weight).all():
            f = Forest(f.ids, np.where(np.isfinite(f.weight), left.parent_id, min(f.ids.min(), 0) - 1), f.weight)
        at = f.index(right.node_id)
        wanted = [np.sort(right.node_id[(at >= 0) & (right.role & r > 0)].to_numpy(np.int64)) for r in (1, 2)]
        rows, place, end, low, tops = f.labels(np.unique(at[at >= 0]))
        deep, position = f.root_distance(weighted), np.zeros(f.n, np.int64)
        position[rows] = np.arange(len(rows))
        arrays = [f.ids[rows], *(position[f.index(w)] for w in wanted), place, end, deep[rows], low, deep[tops]]
        blocks = -(-len(wanted[0]) * len(wanted[1]) // BLOCK)
        return pd.DataFrame({"skeleton_id": left.skeleton_id.iloc[:1], "blocks": [min(blocks, len(wanted[0]))]} | {c: [a.tobytes()] for c, a in zip(_LABELS, arrays, strict=True)})

    def distances(row):
        ids, s, t, place, end, deep, low, low_deep = (np.frombuffer(row[c], float if "deep" in c else np.int64) for c in _LABELS)
        s = s[len(s) * row["block"] // row["blocks"] : len(s) * (row["block"] + 1) // row["blocks"]]
        for k, d in block_distances(s, t, place, end, deep, low, low_deep, directed):
            yield pa.RecordBatch.from_arrays([np.full(d.size, row["skeleton_id"]), np.repeat(ids[s[k : k + len(d)]], len(t)), np.tile(ids[t], len(d)), d.ravel()], ["skeleton_id", "source", "target", "dist"])

    return per_block(per_pair(only(nodes, *BASE), role, "skeleton_id", pack, _MATRIX), "skeleton_id", distances, "skeleton_id bigint, source bigint, target bigint, dist double")


def geodesic_pairs(nodes: DataFrame, pairs: DataFrame, directed: bool = False, weighted: bool = True) -> DataFrame:
    """Distance of each listed pair (skeleton_id, source, target), repeats kept."""

    def fn(f, left, right):
        i, j = f.index(right.source), f.index(right.target)
        d, ok = np.full(len(i), -1.0), (i >= 0) & (j >= 0)
        d[ok] = f.pair_distances(i[ok], j[ok], directed, weighted)
        return pd.DataFrame({"source": right.source, "target": right.target, "dist": d})

    return _with(nodes, pairs.select("skeleton_id", "source", "target"), fn, "skeleton_id bigint, source bigint, target bigint, dist double")


def _extreme(nodes, sources, targets, far, directed, weighted):
    role = sources.select("skeleton_id", "node_id").withColumn("role", F.lit("s")).unionByName(targets.select("skeleton_id", "node_id").distinct().withColumn("role", F.lit("t")))

    def fn(f, left, right):
        s = right.node_id[right.role == "s"].to_numpy()
        t = f.index(right.node_id[right.role == "t"])
        d, who = f.extreme(f.index(s), t[t >= 0], far, directed, weighted)
        return pd.DataFrame({"node_id": s, "dist": d, "target": who})

    return _with(nodes, role, fn, f"{NODE}, dist double, target bigint")


def geodesic_nearest(nodes: DataFrame, sources: DataFrame, targets: DataFrame, directed: bool = False, weighted: bool = True) -> DataFrame:
    """Nearest target other than the source itself; (-1, -1) if none; ties to the least id."""
    return _extreme(nodes, sources, targets, False, directed, weighted)


def geodesic_farthest(nodes: DataFrame, sources: DataFrame, targets: DataFrame, directed: bool = False, weighted: bool = True) -> DataFrame:
    return _extreme(nodes, sources, targets, True, directed, weighted)


def _rows(segments, f, lengths=None) -> pd.DataFrame:
    n = [len(s) for s in segments]
    out = pd.DataFrame({"segment": np.repeat(np.arange(len(segments)), n), "pos": np.concatenate([np.arange(k) for k in n] or [[]]), "node_id": f.ids[np.concatenate([*segments, []]).astype(np.int64)]}).astype("int64")
    if lengths is not None:
        out["length"] = np.repeat(np.array(lengths, float), n)
    return out


def generate_segments(nodes: DataFrame, weighted: bool = True) -> DataFrame:
    """Longest-first decomposition: (segment, pos, node_id, length), segments by falling length."""

    def fn(f, p):
        s = f.long_segments(weighted)
        return _rows([x for x, _ in s], f, [d for _, d in s])

    return _each(nodes, fn, "skeleton_id bigint, segment bigint, pos bigint, node_id bigint, length double")


def break_segments(nodes: DataFrame) -> DataFrame:
    """Linear chains between leaves, branch points and roots, ends shared."""
    return _each(nodes, lambda f, p: _rows(f.linear_segments(), f), "skeleton_id bigint, segment bigint, pos bigint, node_id bigint")


def segment_coords(nodes: DataFrame, color: str | None = None) -> DataFrame:
    """``generate_segments`` with coordinates (and a colour column) of each node."""
    need(nodes, "x", "y", "z")
    return generate_segments(nodes).join(nodes.select("skeleton_id", "node_id", "x", "y", "z", *([color] if color else [])), ["skeleton_id", "node_id"])


def strahler_index(nodes: DataFrame, method: str = "standard", ignore: str | None = None, min_twig_size: int | None = None) -> DataFrame:
    if method not in ("standard", "greedy"):
        raise ValueError(f"unknown method: {method}")
    return _each(nodes, lambda f, p: pd.DataFrame({"node_id": f.ids, "strahler": f.strahler(method == "greedy", p[ignore] if ignore else None, min_twig_size)}), f"{NODE}, strahler bigint", *([ignore] if ignore else []))


def prune_twigs(nodes: DataFrame, threshold: float, mask: str | None = None) -> DataFrame:
    """Node ids that stay."""
    return _each(nodes, lambda f, p: pd.DataFrame({"node_id": f.ids[f.prune(threshold, p[mask] if mask else None)]}), NODE, *([mask] if mask else []))


def synapse_flow_centrality(nodes: DataFrame, pre: str = "presynapses", post: str = "postsynapses", mode: str = "sum") -> DataFrame:
    return _each(nodes, lambda f, p: pd.DataFrame({"node_id": f.ids, "flow": f.flow(p[pre], p[post], mode)}), f"{NODE}, flow bigint", pre, post)


def reroot(nodes: DataFrame, new_roots: DataFrame) -> DataFrame:
    """(node_id, parent_id) after each component's first wanted root (by ``ord``, else by id) becomes its root."""

    def fn(f, left, right):
        wanted = right.sort_values("ord" if "ord" in right else "node_id", kind="stable").node_id
        return pd.DataFrame({"node_id": f.ids, "parent_id": f.reroot(wanted)})

    return _with(nodes, new_roots, fn, f"{NODE}, parent_id bigint")


def simplify_skeleton(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots, leaves and branch points with summed edges; and where every node went (node_id, target)."""
    return rewired(nodes, lambda f, p: f.topology())


def rewired(nodes: DataFrame, keep, *more: str) -> tuple[DataFrame, DataFrame]:
    def kept(f, p):
        rows, parents, weights, _ = f.rewire(keep(f, p))
        return pd.DataFrame({"node_id": f.ids[rows], "parent_id": parents, "weight": weights})

    def moved(f, p):
        return pd.DataFrame({"node_id": f.ids, "target": f.rewire(keep(f, p))[3]})

    return _each(nodes, kept, f"{NODE}, parent_id bigint, weight double", *more), _each(nodes, moved, f"{NODE}, target bigint", *more)


def longest_path(nodes: DataFrame, weighted: bool = True) -> DataFrame:
    return longest_paths(nodes, 1, None, weighted).drop("path")


def longest_paths(nodes: DataFrame, n: int, min_length: float | None = None, weighted: bool = True) -> DataFrame:
    """(path, pos, node_id) of up to n disjoint longest paths, distal end first."""
    return _each(nodes, lambda f, p: _rows(f.longest(n, min_length, weighted), f).rename(columns={"segment": "path"}), "skeleton_id bigint, path bigint, pos bigint, node_id bigint")
