"""Kernels against plain brute force on random objects, ties included."""

import numpy as np
import pytest

from arborix.kernels import clouds, graph
from arborix.kernels.forest import CycleError, Forest, bfs_rewire, stitch
from arborix.kernels.points import PointIndex
from arborix.operators import graphs, repair, scores, trees


def random_forest(rng, n, roots=0.1):
    ids = rng.permutation(np.arange(1000, 1000 + 3 * n, 3))
    parent = [-1 if i == 0 or rng.random() < roots else int(ids[rng.integers(0, i)]) for i in range(n)]
    order = rng.permutation(n)
    return Forest(ids[order], np.array(parent)[order], rng.integers(1, 6, n))


@pytest.mark.parametrize("far", [False, True])
@pytest.mark.parametrize("directed", [False, True])
def test_extreme_equals_the_distance_matrix(far, directed):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 200):
        f = random_forest(rng, n)
        targets = np.flatnonzero(rng.random(n) < 0.3)
        d = f.distances(np.arange(n), np.arange(n), directed)
        dist, who = f.extreme(np.arange(n), targets, far, directed, True)
        for i in range(n):
            offers = [((-d[i, t] if far else d[i, t]), f.ids[t]) for t in targets if t != i and d[i, t] >= 0]
            want = (abs(min(offers)[0]), min(offers)[1]) if offers else (-1, -1)
            assert (dist[i], who[i]) == want


def test_rewire_follows_chains():
    rng = np.random.default_rng(2)
    for n in (1, 5, 80, 300):
        f = random_forest(rng, n)
        keep = f.topology() | (rng.random(n) < 0.2)
        kept, parents, weights, node_map = f.rewire(keep)
        want_map = {}
        for slot, i in enumerate(kept.tolist()):
            chain, total, at = [], 0.0, i
            while f.parent[at] >= 0:
                total += f.weight[at]
                at = int(f.parent[at])
                if keep[at]:
                    break
                chain.append((at, total))
            up = at if at != i and keep[at] else -1
            assert parents[slot] == (f.ids[up] if up >= 0 else -1) and weights[slot] == (total if up >= 0 else 0)
            want_map[i] = i
            for x, d in chain:
                want_map[x] = up if up >= 0 and total - d <= d else i
        assert node_map.tolist() == [f.ids[want_map[i]] if i in want_map else -1 for i in range(n)]


def test_height():
    rng = np.random.default_rng(3)
    f = random_forest(rng, 120)
    d = f.distances(np.arange(120), np.arange(120), True)  # from each node up to its ancestors
    assert np.allclose(f.height(), np.where(d >= 0, d, 0).max(0))


@pytest.mark.parametrize("leaf", [1, 3, 1000])
def test_point_index(leaf):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 6, (150, 3)).astype(float)  # many ties
    queries = np.concatenate([rng.random((80, 3)) * 6, points[:20]])
    d = ((queries[:, None] - points[None]) ** 2).sum(2)
    index = PointIndex(points, leaf)
    dist, row = index.nearest(queries)
    assert (row == d.argmin(1)).all() and np.allclose(dist, d.min(1))
    assert (index.neighbours(queries, 9) == np.argsort(d, 1, kind="stable")[:, :9]).all()
    group = rng.integers(0, 4, 150)
    own = rng.integers(0, 5, len(queries))
    other = np.where(group[None] == own[:, None], np.inf, d)
    dist, row = index.nearest(queries, group, own)
    assert (row == other.argmin(1)).all() and np.allclose(dist, other.min(1))
    dist, row = PointIndex(points[:0]).nearest(queries)
    assert (row == -1).all() and np.isinf(dist).all()
    assert clouds.nearest(queries, points[:0])[1].tolist() == [-1] * len(queries)


def test_stitch_is_the_minimum_spanning_tree_of_fragments():
    rng = np.random.default_rng(5)
    for dims in (3, 4):
        xyz, label = rng.random((90, dims)) * 10, rng.integers(0, 12, 90)
        allowed = rng.random(90) < 0.8
        rows = np.flatnonzero(allowed)
        pairs = sorted((((xyz[a] - xyz[b]) ** 2).sum(), a, b) for a in rows for b in rows if a < b and label[a] != label[b])
        u, want = graph.Union(90), []
        for a in range(90):
            u.join(int(np.flatnonzero(label == label[a])[0]), a)
        for d, a, b in pairs:
            if u.join(int(a), int(b)):
                want.append((int(a), int(b), float(np.sqrt(d))))
        assert sorted(stitch(xyz, label, allowed)) == sorted(want)
        limit = sorted(x[2] for x in want)[len(want) // 2]
        assert sorted(stitch(xyz, label, allowed, limit)) == sorted(x for x in want if x[2] <= limit)


def test_spread_equals_a_search_from_all_seeds():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 60, (2, 90))
    items = graph.Items(graph.Graph(60, a, b, rng.integers(1, 5, 90).astype(float)), rng.integers(0, 60, 40))
    out = []
    for _ in range(20):
        out.append(items.farthest_seed(out))
    assert items.spread(20) == out


@pytest.mark.parametrize("method", scores.METHODS)
def test_linkage_equals_merging_the_closest_pair(method):
    rng = np.random.default_rng(7)
    p = rng.random((40, 4))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    z = scores.linkage_matrix(d, method)
    # clusters as member sets; Lance-Williams by the definition on a dictionary
    squared = method in ("ward", "centroid", "median")
    live = {i: 1 for i in range(40)}
    dist = {(i, j): (d[i, j] ** 2 if squared else d[i, j]) for i in range(40) for j in range(i)}
    get = lambda x, y: dist[max(x, y), min(x, y)]
    for step in range(39):
        h, i, j = min((get(x, y), y, x) for x in live for y in live if y < x)
        assert z[step, 2] == pytest.approx(np.sqrt(max(h, 0)) if squared else h) and sorted((i, j)) == z[step, :2].tolist()
        a, b = live.pop(i), live.pop(j)
        for c, n in live.items():
            dist[40 + step, c] = float(scores._updated(method, get(i, c), get(j, c), h, a, b, np.float64(n)))
        live[40 + step] = a + b
        assert z[step, 3] == a + b


def test_new_edges_count_in_their_order(spark):
    nodes = spark.createDataFrame([(1, i, -1, i) for i in (5, 1, 2, 3)], "skeleton_id bigint, node_id bigint, parent_id bigint, ord bigint")
    edges = [(1, 5, 3, 0), (1, 5, 1, 1), (1, 3, 2, 2), (1, 1, 2, 3)]
    got = {r.node_id: r.parent_id for r in repair.reroot_rewire(nodes, spark.createDataFrame(edges, "skeleton_id bigint, a bigint, b bigint, ord bigint"), nodes.where("node_id = 5")).collect()}
    assert got == {5: -1, 3: 5, 1: 5, 2: 3}
    assert bfs_rewire([5, 1, 2, 3], [-1] * 4, [(5, 1), (5, 3), (1, 2), (3, 2)], 5).tolist() == [-1, 5, 1, 5]


def test_contraction_into_a_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([(1, 0, -1), (1, 1, 0), (1, 2, 1), (1, 3, 2)], "skeleton_id bigint, node_id bigint, parent_id bigint")
    mapping = spark.createDataFrame([(1, 0, 3), (1, 1, 1), (1, 2, 2), (1, 3, 3)], "skeleton_id bigint, node_id bigint, target bigint")
    with pytest.raises(Exception, match=CycleError.__name__):
        trees.contract_nodes(nodes, mapping).collect()


def test_spanning_forest_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(g), k, int(a), int(b), float(w)) for k, (g, a, b, w) in enumerate(zip(rng.integers(0, 3, 300), *rng.integers(0, 40, (2, 300)), rng.integers(0, 9, 300), strict=True))]
    monkeypatch.setattr(graphs, "HELD", 30)
    edges = spark.createDataFrame(rows, "graph_id bigint, edge_id bigint, src bigint, dst bigint, weight double").repartition(5)
    for maximize in (True,):
        want = {(r.graph_id, r.edge_id) for r in graphs.minimum_spanning_tree(edges, maximize).collect()}
        assert {(r.graph_id, r.edge_id) for r in graphs.spanning_forest_at_scale(edges, maximize).collect()} == want


def test_weights_written_twice(spark):
    edges = spark.createDataFrame([(1, 0, 1, 2, 1.0)], "graph_id bigint, edge_id bigint, src bigint, dst bigint, weight double")
    twice = spark.createDataFrame([(1, 2, 1, 5.0, 1), (1, 1, 2, 7.0, 0)], "graph_id bigint, src bigint, dst bigint, weight double, ord bigint")
    with graphs.GeodesicGraph(edges) as g:
        assert g.set_weights(twice).edges.first().weight == 5.0
        assert g.set_weights(twice.drop("ord")).edges.first().weight == 7.0


def test_direction_bins_ignore_signs_and_cover_the_sphere():
    rng = np.random.default_rng(9)
    v = rng.normal(size=(500, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for n in (0, 1, 3, 12, 256):
        bins = clouds.directions(v, n)
        assert (clouds.directions(-v, n) == bins).all() and bins.min() == 0 and bins.max() == max(0, n - 1) or n == 256
    assert clouds.directions(np.array([[0.9, 0.1, 0.1], [0, -1, 0], [0, 0, 1.0]]), 3).tolist() == [0, 1, 2]


def test_nearest_neurons_of_a_second_table(spark):
    from arborix.operators import clouds as ops

    rng = np.random.default_rng(10)
    rows = []
    for neuron in range(12):
        p, v = rng.normal(size=(20, 3)) + rng.integers(0, 2, 3), rng.normal(size=(20, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rows += [(neuron, i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(p, v, strict=True))]
    dots = spark.createDataFrame(rows, "neuron_id bigint, point_id bigint, " + ", ".join(f"{c} double" for c in ("x", "y", "z", "vx", "vy", "vz")))
    table = clouds.ScoreTable([[10 - 3 * r + 2 * s for s in range(4)] for r in range(6)], [0, 0.2, 0.4, 0.8, 1.2, 2], [0, 0.25, 0.5, 0.75])
    query, target = dots.where("neuron_id < 4"), dots.where("neuron_id >= 3")
    for voxel, n_dirs in ((2.0, 3), (0.01, 7)):  # the small cells share nothing: all lists are filled by nearest centroid
        got = ops.nblast_knn(query, table, 3, voxel=voxel, n_dirs=n_dirs, target=target, symmetry="forward").collect()
        assert sorted((r.q, r.rank) for r in got) == [(q, k) for q in range(4) for k in (1, 2, 3)]
        exact = {(r.q, r.t): r.score for r in ops.nblast(query, target, table).collect()}
        assert all(r.score == pytest.approx(exact[r.q, r.t]) for r in got)
        assert next(r.t for r in got if (r.q, r.rank) == (3, 1)) == 3  # no self-exclusion between two tables
        if voxel == 2.0:
            for q in range(4):
                best = sorted((s for (a, _), s in exact.items() if a == q), reverse=True)[:3]
                assert [r.score for r in sorted(got) if r.q == q] == pytest.approx(best)


def test_checks_of_sparse_trees(spark):
    m = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "graph_id bigint, row bigint, col bigint, value double")
    assert graphs.csgraph_components(m([(1, 0, 1.0), (2, 0, 1.0)])).count() == 3
    with pytest.raises(Exception, match="at most one parent"):
        graphs.csgraph_components(m([(1, 0, 1.0), (1, 2, 1.0)])).collect()
    with pytest.raises(Exception, match="contains cycles"):
        graphs.csgraph_components(m([(1, 0, 1.0), (0, 1, 1.0)])).collect()
    assert graphs.csgraph_components(m([(1, 0, 1.0), (0, 1, 1.0)]), checks=False).count() == 2


def test_jobs_are_cancelled_by_name(spark):
    import threading
    import time

    from arborix.functions import runtime

    with pytest.raises(KeyError), runtime.jobs(spark, "left early"):
        raise KeyError
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    errors = []

    def slow():
        try:
            with runtime.jobs(spark, "slow"):
                spark.range(8, numPartitions=8).selectExpr("java_method('java.lang.Thread', 'sleep', id * 0 + 60000L)").collect()
        except Exception as e:
            errors.append(e)

    from pyspark import InheritableThread

    t = InheritableThread(target=slow)
    t.start()
    for _ in range(100):
        if runtime.progress(spark, "slow")[1]:
            break
        time.sleep(0.1)
    runtime.cancel(spark, "slow")
    t.join(30)
    assert not t.is_alive() and errors and threading.active_count()
