"""General-graph operators over edge tables, many graphs at once.

``edges``: graph_id, src, dst and optionally edge_id (input order), weight; ``nodes``: graph_id, node_id, for
graphs with isolated nodes. Node ids may be any integers. Kernels run on one graph per group;
``components_at_scale`` and ``spanning_forest_at_scale`` are DataFrame fixpoints for one graph too large for a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.kernels.forest import CycleError, Forest
from arborix.kernels.graph import Graph, Items, Union, bridges as _bridges, labels, spanning_forest
from arborix.plans.closure import _cut
from arborix.schema import only, per_object

EDGE = ("graph_id", "edge_id", "src", "dst", "weight")
_KINDS = "kind int, a bigint, b bigint, ord bigint, w double"


def _rows(edges: DataFrame, nodes: DataFrame | None = None, **more: DataFrame) -> DataFrame:
    """All tables of a graph as one, so that one shuffle brings them together: kind 0 edges, 1 nodes, then ``more`` in order."""
    order = F.col("edge_id") if "edge_id" in edges.columns else F.lit(0)
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(None).cast("double")
    parts = [edges.select("graph_id", F.lit(0).alias("kind"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), order.cast("long").alias("ord"), weight.alias("w"))]
    blank = F.lit(None).cast("long")
    for k, df in enumerate([nodes, *more.values()], 1):
        if df is not None:
            second = F.col("target").cast("long") if "target" in df.columns else F.col("label").cast("long") if "label" in df.columns else blank
            rank = F.col("ord").cast("long") if "ord" in df.columns else F.lit(0).cast("long")
            parts.append(df.select("graph_id", F.lit(k).alias("kind"), F.col("node_id").cast("long").alias("a"), second.alias("b"), rank.alias("ord"), F.lit(None).cast("double").alias("w")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class _Parts:
    def __init__(self, pdf: pd.DataFrame, directed: bool = False, weighted: bool = True, blocks: int = 1):
        self.id = pdf.graph_id.iloc[0]
        self.block, self.blocks = int(pdf.block.iloc[0]) if blocks > 1 else 0, blocks
        e = pdf[pdf.kind == 0].sort_values(["ord", "a", "b"], kind="stable")
        self.edges = e
        self.ids = np.unique(np.concatenate([e.a, e.b, pdf[pdf.kind == 1].a]).astype(np.int64))
        self.src, self.dst = np.searchsorted(self.ids, e.a.to_numpy(np.int64)), np.searchsorted(self.ids, e.b.to_numpy(np.int64))
        self.weight = e.w.to_numpy(float) if weighted and e.w.notna().all() else None
        self.pdf, self.directed = pdf, directed

    def mine(self, rows: np.ndarray) -> np.ndarray:
        """Those of some sources that this task answers for."""
        return rows[np.arange(len(rows)) % self.blocks == self.block]

    def graph(self) -> Graph:
        return Graph(len(self.ids), self.src, self.dst, self.weight, self.directed)

    def extra(self, kind: int) -> tuple[np.ndarray, pd.DataFrame]:
        rows = self.pdf[self.pdf.kind == kind].sort_values(["ord", "a"], kind="stable")
        rows = rows[np.isin(rows.a, self.ids)]
        return np.searchsorted(self.ids, rows.a.to_numpy(np.int64)), rows

    def frame(self, **columns) -> pd.DataFrame:
        out = pd.DataFrame(columns)
        out.insert(0, "graph_id", self.id)
        return out


def _each(rows: DataFrame, fn, schema: str, directed: bool = False, weighted: bool = True, blocks: int = 1) -> DataFrame:
    """The kernel on each graph; with ``blocks`` in as many tasks, each with a copy of the graph and ``g.mine`` telling its own nodes."""
    if blocks == 1:
        return per_object(rows, "graph_id", lambda pdf: fn(_Parts(pdf, directed, weighted)), "graph_id bigint, " + schema)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return per_object(rows, ["graph_id", "block"], lambda pdf: fn(_Parts(pdf, directed, weighted, blocks)), "graph_id bigint, " + schema)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Each node's smallest reachable node."""
    return _each(_rows(edges, nodes), lambda g: g.frame(node_id=g.ids, component=g.ids[labels(len(g.ids), g.src, g.dst)]), "node_id bigint, component bigint")


def components_at_scale(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The same by rounds of minimum labels and pointer jumping over DataFrames."""
    both = edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    both = both.unionByName(both.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    all_nodes = both.select("graph_id", F.col("a").alias("node_id"))
    if nodes is not None:
        all_nodes = all_nodes.unionByName(nodes.select("graph_id", "node_id"))
    label = _cut(all_nodes.distinct().withColumn("component", F.col("node_id")))
    while True:
        near = both.join(label.select("graph_id", F.col("node_id").alias("b"), F.col("component").alias("c")), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("node_id")).agg(F.min("c").alias("c"))
        new = label.join(near, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("old"))
        up = new.select("graph_id", F.col("node_id").alias("component"), F.col("component").alias("up"))
        new = _cut(new.join(up, ["graph_id", "component"]).select("graph_id", "node_id", F.col("up").alias("component"), "old"))
        if not new.where("component <> old").limit(1).count():
            return new.select("graph_id", "node_id", "component")
        label = new.drop("old")


def level_set_components(edges: DataFrame, node_labels: DataFrame) -> DataFrame:
    """Components among nodes of one label (graph_id, node_id, label); dense numbers by first node, -1 for negative labels."""

    def fn(g):
        at, rows = g.extra(1)
        label = np.full(len(g.ids), -1, np.int64)
        label[at] = rows.b.to_numpy(np.int64)
        same = (label[g.src] == label[g.dst]) & (label[g.src] >= 0)
        root = labels(len(g.ids), g.src[same], g.dst[same])
        ok = label >= 0
        out = np.full(len(g.ids), -1, np.int64)
        out[ok] = np.unique(root[ok], return_inverse=True)[1]
        return g.frame(node_id=g.ids, component=out)

    return _each(_rows(edges, node_labels), fn, "node_id bigint, component bigint")


def contract_vertices(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct edges between mapped nodes (graph_id, node_id, target), loops dropped; ord follows (larger, smaller)."""
    m = lambda end: mapping.select("graph_id", F.col("node_id").alias(end), F.col("target").alias(f"{end}_to"))
    e = edges.select("graph_id", "src", "dst").join(m("src"), ["graph_id", "src"]).join(m("dst"), ["graph_id", "dst"])
    e = e.select("graph_id", F.least("src_to", "dst_to").alias("src"), F.greatest("src_to", "dst_to").alias("dst")).where("src <> dst").distinct()
    return e.withColumn("ord", F.row_number().over(Window.partitionBy("graph_id").orderBy("dst", "src")) - 1)


def minimum_spanning_tree(edges: DataFrame, maximize: bool = False) -> DataFrame:
    """Rows (ord, edge_id) of the spanning forest, by weight, ties in input order."""

    def fn(g):
        rows = spanning_forest(len(g.ids), g.src, g.dst, g.weight if g.weight is not None else np.ones(len(g.src)), maximize)
        return g.frame(ord=np.arange(len(rows)), edge_id=g.edges.ord.to_numpy(np.int64)[rows])

    return _each(_rows(edges), fn, "ord bigint, edge_id bigint")


HELD = 200_000  # edges whose forest a task finds at once


def _forest_of(t: pa.Table) -> pa.Table:
    """The edges of a table that its spanning forests keep, by (w, edge_id)."""
    t = t.combine_chunks().take(pa.array(np.lexsort((t["edge_id"].to_numpy(), t["w"].to_numpy()))))
    g = t["graph_id"].to_numpy()
    ends = np.stack([np.concatenate([g, g]), np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()])])
    code = np.unique(ends, axis=1, return_inverse=True)[1].ravel()
    u = Union(int(code.max(initial=-1)) + 1)
    keep = [k for k, (x, y) in enumerate(zip(code[: len(g)].tolist(), code[len(g) :].tolist(), strict=True)) if u.join(x, y)]
    return t.take(pa.array(keep, pa.int64()))


def _local_forests(batches):
    """The edges of each task that its own spanning forest keeps: one that closes a circle of lighter ones is in no forest."""
    held: list[pa.Table] = []
    size = 0

    def reduced() -> pa.Table:
        return _forest_of(pa.concat_tables(held))

    for b in batches:
        held.append(pa.Table.from_batches([b]))
        size += b.num_rows
        if size > HELD:
            held = [reduced()]
            size = held[0].num_rows
            if size > HELD // 2:
                yield from held[0].to_batches()
                held, size = [], 0
    if held:
        yield from reduced().to_batches()


def spanning_forest_at_scale(edges: DataFrame, maximize: bool = False) -> DataFrame:
    """The same edges (graph_id, edge_id) for graphs larger than a task: Boruvka's rounds over DataFrames.

    Each task first drops what its own forest drops; graphs left with at most ``HELD`` edges (counted) are finished in one
    group each, the others in rounds. In a round every component picks its lightest edge; the picks point
    along trees whose roots are the two components that picked the same edge, so pointer doubling over the picks names the new
    components. Of parallel edges between two components only the lightest goes on.
    """
    sign = -1.0 if maximize else 1.0
    columns = "graph_id bigint, edge_id bigint, w double, a bigint, b bigint"
    e = edges.select(F.col("graph_id").cast("long").alias("graph_id"), F.col("edge_id").cast("long").alias("edge_id"), (F.col("weight") * sign).cast("double").alias("w"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
    e = _cut(e.where("a <> b").mapInArrow(_local_forests, columns))
    large = e.groupBy("graph_id").count().where(F.col("count") > HELD).select("graph_id")
    few = e.join(large, "graph_id", "left_anti").select("graph_id", "edge_id", "w", "a", "b")
    chosen = few.groupBy("graph_id").applyInArrow(_forest_of, columns).select("graph_id", "edge_id")
    e = e.join(large, "graph_id", "left_semi")
    while True:
        key = lambda c, o: e.select("graph_id", F.col(c).alias("c"), F.struct("w", "edge_id", F.col(o).alias("to")).alias("k"))
        pick = key("a", "b").unionByName(key("b", "a")).groupBy("graph_id", "c").agg(F.min("k").alias("k"))
        pick = _cut(pick.select("graph_id", "c", F.col("k.edge_id").alias("edge_id"), F.col("k.to").alias("to")))
        if not pick.limit(1).count():
            return chosen
        chosen = chosen.unionByName(pick.select("graph_id", "edge_id").distinct())
        back = pick.select("graph_id", F.col("c").alias("to"), F.col("to").alias("up"))
        # two components that picked the same edge: the smaller is the root
        point = pick.join(back, ["graph_id", "to"]).select("graph_id", "c", F.when((F.col("up") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        while True:
            up = point.select("graph_id", F.col("c").alias("to"), F.col("to").alias("up"))
            point = _cut(point.join(up, ["graph_id", "to"]).select("graph_id", "c", F.col("to").alias("old"), F.col("up").alias("to")))
            if not point.where("old <> to").limit(1).count():
                break
            point = point.drop("old")
        at = lambda c: point.select("graph_id", F.col("c").alias(c), F.col("to").alias(f"{c}_to"))
        e = e.join(at("a"), ["graph_id", "a"]).join(at("b"), ["graph_id", "b"]).where("a_to <> b_to")
        e = e.groupBy("graph_id", F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).agg(F.min(F.struct("w", "edge_id")).alias("k"))
        e = _cut(e.select("graph_id", F.col("k.edge_id").alias("edge_id"), F.col("k.w").alias("w"), "a", "b"))


def bridges(edges: DataFrame) -> DataFrame:
    return _each(_rows(edges), lambda g: g.frame(edge_id=g.edges.ord.to_numpy(np.int64), bridge=_bridges(len(g.ids), g.src, g.dst)), "edge_id bigint, bridge boolean")


def parents_from_edges(edges: DataFrame, nodes: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(node_id, parent_id, ord): a shortest-path forest and the order nodes settle in."""

    def fn(g):
        parent, order = g.graph().forest(g.extra(2)[0].tolist())
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return g.frame(node_id=g.ids, parent_id=np.where(parent < 0, -1, g.ids[parent]), ord=rank)

    return _each(_rows(edges, nodes, roots=roots), fn, "node_id bigint, parent_id bigint, ord bigint")


def geodesic_matrix(edges, sources=None, targets=None, nodes=None, directed=False, weighted=True, limit=np.inf, predecessors=False, missing=-1.0, blocks=1) -> DataFrame:
    """(source, target, dist [, pred]); ``missing`` where a target is out of reach or beyond the limit (inclusive).

    ``blocks`` deals the sources of each graph over so many tasks.
    """

    some_sources, some_targets = sources is not None, targets is not None

    def fn(g):
        s = g.mine(g.extra(2)[0] if some_sources else np.arange(len(g.ids)))
        t = g.extra(3)[0] if some_targets else np.arange(len(g.ids))
        graph, rows = g.graph(), []
        for x in s.tolist():
            dist, pred, *_ = graph.search([x], limit, t.tolist())
            out = {"source": np.full(len(t), g.ids[x]), "target": g.ids[t], "dist": np.where(np.isfinite(dist[t]), dist[t], missing)}
            if predecessors:
                out["pred"] = np.where(pred[t] < 0, -1, g.ids[pred[t]])
            rows.append(pd.DataFrame(out))
        out = pd.concat(rows) if rows else pd.DataFrame({"source": [], "target": [], "dist": []} | ({"pred": []} if predecessors else {}))
        out.insert(0, "graph_id", g.id)
        return out

    return _each(_rows(edges, nodes, sources=sources, targets=targets), fn, "source bigint, target bigint, dist double" + ", pred bigint" * predecessors, directed, weighted, blocks)


def geodesic_predecessors(edges, **options) -> DataFrame:
    return geodesic_matrix(edges, predecessors=True, **options)


def geodesic_path(edges: DataFrame, pairs: DataFrame, directed: bool = False, weighted: bool = True) -> DataFrame:
    """(source, target, pos, node_id) of each wanted pair (graph_id, node_id, target), source first; none if unreachable."""

    def fn(g):
        at, rows = g.extra(2)
        graph, out = g.graph(), []
        for s, t in zip(at.tolist(), rows.b.tolist(), strict=True):
            j = int(np.searchsorted(g.ids, t))
            if j < len(g.ids) and g.ids[j] == t:
                out += [(g.ids[s], int(t), k, g.ids[x]) for k, x in enumerate(graph.path(s, j))]
        out = np.array(out, np.int64).reshape(-1, 4)
        return g.frame(source=out[:, 0], target=out[:, 1], pos=out[:, 2], node_id=out[:, 3])

    return _each(_rows(edges, None, pairs=pairs), fn, "source bigint, target bigint, pos bigint, node_id bigint", directed, weighted)


def geodesic_extreme(edges, sources, targets, far=False, directed=False, weighted=True, blocks=1) -> DataFrame:
    """Nearest (farthest) reachable target other than the source: (node_id, dist, target), (-1, -1) if none, ties to the least id.

    ``blocks`` deals the sources of each graph over so many tasks.
    """

    def fn(g):
        s, t = g.mine(g.extra(2)[0]), np.unique(g.extra(3)[0])
        graph, dist, who = g.graph(), [], []
        for x in s.tolist():
            d = graph.search([x])[0][t]
            ok = np.isfinite(d) & (t != x)
            j = int(np.argmax(np.where(ok, d, -1)) if far else np.argmin(np.where(ok, d, np.inf))) if ok.any() else -1
            dist.append(d[j] if j >= 0 else -1.0)
            who.append(g.ids[t[j]] if j >= 0 else -1)
        return g.frame(node_id=g.ids[s], dist=dist, target=who)

    return _each(_rows(edges, None, sources=sources, targets=targets), fn, "node_id bigint, dist double, target bigint", directed, weighted, blocks)


def geodesic_clusters(edges: DataFrame, max_dist: float, nodes=None, seeds=None, directed=False, weighted=True) -> DataFrame:
    return _each(_rows(edges, nodes, seeds=seeds), lambda g: g.frame(node_id=g.ids, cluster=g.graph().clusters(max_dist, g.extra(2)[0].tolist())[0]), "node_id bigint, cluster bigint", directed, weighted)


def geodesic_mst(edges: DataFrame, terminals: DataFrame, limit: float = np.inf, weighted: bool = True) -> DataFrame:
    """(a, b, weight): spanning tree of geodesic distances among the terminals."""

    def fn(g):
        at = g.extra(2)[0]
        e = g.graph().terminal_tree(at.tolist(), limit)
        return g.frame(a=[g.ids[at[x]] for x, _, _ in e], b=[g.ids[at[y]] for _, y, _ in e], weight=[d for *_, d in e]).astype({"a": "int64", "b": "int64", "weight": float})

    return _each(_rows(edges, None, terminals=terminals), fn, "a bigint, b bigint, weight double", False, weighted)


def csgraph_dijkstra(matrix: DataFrame, indices: DataFrame | None = None, directed: bool = True, unweighted: bool = False, limit: float = np.inf) -> DataFrame:
    """Sparse rows (graph_id, row, col, value) in, distances out; infinity where unreachable; a stored zero is an edge."""
    edges = matrix.select("graph_id", F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").alias("weight"))
    return geodesic_matrix(edges, indices, None, None, directed, not unweighted, limit, missing=float("inf"))


def csgraph_components(matrix: DataFrame, nodes: DataFrame | None = None, checks: bool = True) -> DataFrame:
    """(node_id, n_components, label) with dense labels in order of the smallest node.

    With ``checks`` a matrix that is no forest of child rows and parent columns is an error when the result is read: a row with
    two values above 0, or a cycle.
    """
    edges = matrix.select("graph_id", F.col("row").alias("src"), F.col("col").alias("dst"), *([F.col("value").alias("weight")] if "value" in matrix.columns else []))

    def fn(g):
        if checks:
            up = np.unique(np.stack([g.src, g.dst])[:, g.weight > 0 if g.weight is not None else slice(None)], axis=1)
            if len(np.unique(up[0])) < up.shape[1]:
                raise ValueError(f"graph {g.id} is not a tree: each node must have at most one parent")
            parent = np.full(len(g.ids), -1)
            parent[g.src] = g.dst
            if Forest(np.arange(len(g.ids)), parent).has_cycles():
                raise CycleError(f"graph {g.id} is not a tree: it contains cycles")
        return g.frame(node_id=g.ids, component=g.ids[labels(len(g.ids), g.src, g.dst)])

    found = _each(_rows(edges, nodes), fn, "node_id bigint, component bigint")
    w = Window.partitionBy("graph_id").orderBy("component")
    found = found.withColumn("label", F.dense_rank().over(w) - 1)
    return found.select("graph_id", "node_id", (F.max("label").over(Window.partitionBy("graph_id")) + 1).cast("int").alias("n_components"), F.col("label").cast("int").alias("label"))


class GeodesicGraph:
    """A prepared set of graphs: edges partitioned by graph id once, with items attached to nodes.

    Every method is one pass over the prepared partitions, which ``close`` (or leaving a with block) lets go; nothing is mutated: ``set_weights`` and ``subset`` return new objects.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None, items: DataFrame | None = None, directed: bool = False, partitions: int | None = None):
        self.directed, self.nodes, self.items = directed, nodes, items
        edges = only(edges, *EDGE)
        self.edges = edges.repartition(partitions, "graph_id").persist() if partitions else edges.persist()

    def close(self) -> None:
        """Let go of the prepared partitions."""
        self.edges.unpersist()

    def __enter__(self) -> GeodesicGraph:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def distances(self, **o) -> DataFrame:
        return geodesic_matrix(self.edges, nodes=self.nodes, directed=self.directed, **o)

    def predecessors(self, **o) -> DataFrame:
        return self.distances(predecessors=True, **o)

    def nearest(self, sources, targets) -> DataFrame:
        return geodesic_extreme(self.edges, sources, targets, False, self.directed)

    def farthest(self, sources, targets) -> DataFrame:
        return geodesic_extreme(self.edges, sources, targets, True, self.directed)

    def path(self, pairs) -> DataFrame:
        return geodesic_path(self.edges, pairs, self.directed)

    def clusters(self, max_dist, seeds=None) -> DataFrame:
        return geodesic_clusters(self.edges, max_dist, self.nodes, seeds, self.directed)

    def components(self) -> DataFrame:
        return connected_components(self.edges, self.nodes)

    def item_components(self) -> DataFrame:
        return self.items.join(self.components(), ["graph_id", "node_id"]).select("graph_id", "item_id", "component")

    def ball(self, sources: DataFrame, max_dist: float = np.inf) -> DataFrame:
        """(node_id, dist, source, ord) within the radius (inclusive), in order of distance."""

        def fn(g):
            dist, _, owner, order = g.graph().search(g.extra(2)[0].tolist(), max_dist)
            return g.frame(node_id=g.ids[order], dist=dist[order], source=g.ids[owner[order]], ord=np.arange(len(order)))

        return _each(_rows(self.edges, self.nodes, sources=sources), fn, "node_id bigint, dist double, source bigint, ord bigint", self.directed)

    def set_weights(self, changes: DataFrame) -> GeodesicGraph:
        """Re-weight existing edges (graph_id, src, dst, weight, optional ord: the last write wins; among equals the greatest weight); an unknown edge is an error."""
        if "weight" not in self.edges.columns:
            raise ValueError("the graph has no weights")
        key = lambda a, b: (a, b) if self.directed else (F.least(a, b), F.greatest(a, b))
        ka, kb = key(F.col("src"), F.col("dst"))
        rank = F.col("ord") if "ord" in changes.columns else F.lit(0)
        new = changes.select("graph_id", ka.alias("ka"), kb.alias("kb"), F.struct(rank.alias("o"), F.col("weight").alias("w")).alias("k")).groupBy("graph_id", "ka", "kb").agg(F.max("k.w").alias("m"), F.max_by("k.w", "k").alias("new"))
        own = self.edges.withColumns({"ka": ka, "kb": kb})
        if new.join(own, ["graph_id", "ka", "kb"], "left_anti").limit(1).count():
            raise ValueError("set_weights names an edge that is not in the graph")
        out = own.join(new, ["graph_id", "ka", "kb"], "left").withColumn("weight", F.coalesce("new", "weight")).drop("ka", "kb", "m", "new")
        return GeodesicGraph(out, self.nodes, self.items, self.directed)

    def subset(self, keep: DataFrame) -> GeodesicGraph:
        """The subgraph induced by ``keep`` (graph_id, node_id, ord), renumbered in that order."""
        new = keep.select("graph_id", "node_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("ord")) - 1).cast("long").alias("new"))
        a, b = (new.select("graph_id", F.col("node_id").alias(c), F.col("new").alias(f"{c}_new")) for c in ("src", "dst"))
        e = self.edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).drop("src", "dst").withColumnsRenamed({"src_new": "src", "dst_new": "dst"})
        items = None if self.items is None else self.items.join(new, ["graph_id", "node_id"]).select("graph_id", "item_id", F.col("new").alias("node_id"))
        return GeodesicGraph(e, new.select("graph_id", F.col("new").alias("node_id")), items, self.directed)

    def _items(self, fn, schema: str, seeds: DataFrame | None = None) -> DataFrame:
        items = self.items.select("graph_id", "node_id", F.col("item_id").alias("target"))
        seeds = None if seeds is None else seeds.select("graph_id", F.col("item_id").alias("node_id"), *[F.col("forbidden").cast("long").alias("target")] * ("forbidden" in seeds.columns))

        def run(g):
            at, rows = g.extra(2)
            order = np.argsort(rows.b.to_numpy(np.int64), kind="stable")
            item_ids, held = rows.b.to_numpy(np.int64)[order], Items(g.graph(), at[order])
            marks = g.pdf[g.pdf.kind == 3]
            return fn(g, held, item_ids, marks)

        return _each(_rows(self.edges, self.nodes, items=items, seeds=seeds), run, schema, self.directed)

    def grow(self, seeds: DataFrame, size: int) -> DataFrame:
        """(item_id, dist, ord): the ``size`` items nearest to each graph's seed; ``seeds``: graph_id, item_id, forbidden (0 the seed, 1 closed)."""

        def fn(g, held, ids, marks):
            shut = marks[marks.b == 1].a
            seed = marks[marks.b != 1].a
            got, far = held.grow(int(np.searchsorted(ids, seed.iloc[0])), size, np.searchsorted(ids, shut).tolist()) if len(seed) else ([], [])
            return g.frame(item_id=ids[got] if got else [], dist=far, ord=np.arange(len(got))).astype({"item_id": "int64", "dist": float})

        return self._items(fn, "item_id bigint, dist double, ord bigint", seeds)

    def farthest_points(self, k: int) -> DataFrame:
        """(item_id, ord): farthest-point sampling, the first seed being the largest component's lowest item."""

        def fn(g, held, ids, marks):
            got = held.spread(k)
            return g.frame(item_id=ids[got], ord=np.arange(len(got)))

        return self._items(fn, "item_id bigint, ord bigint")

    def farthest_seed(self, done: DataFrame) -> DataFrame:
        """(item_id): each graph's next seed given the done items; graphs that are done have no row."""

        def fn(g, held, ids, marks):
            nxt = held.farthest_seed(np.searchsorted(ids, marks.a).tolist())
            return g.frame(item_id=[] if nxt is None else [ids[nxt]]).astype("int64")

        return self._items(fn, "item_id bigint", done)
