"""Forest kernels and operators: documented shapes, brute force on random forests, traps."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborix.kernels.forest import CycleError, Forest, bfs_rewire, stitch
from arborix.operators import repair, resampling, trees

IDS, PARENTS = [0, 1, 2, 3, 4, 5, 6], [-1, 0, 1, 2, 1, 4, 5]


@pytest.fixture
def tree():
    return Forest(IDS, PARENTS)


def test_documented_tree(tree):
    assert tree.root_distance().tolist() == [0, 1, 2, 3, 2, 3, 4]
    assert tree.linear_segments() == [[1, 0], [3, 2, 1], [6, 5, 4, 1]]
    assert [s for s, _ in tree.long_segments()] == [[6, 5, 4, 1, 0], [3, 2, 1]]
    assert tree.kinds().tolist() == [0, 2, 3, 1, 3, 3, 1]
    assert tree.strahler().tolist() == [2, 2, 1, 1, 1, 1, 1]
    assert tree.height().tolist() == [4, 3, 1, 0, 2, 1, 0]
    assert tree.reroot([6]).tolist() == [1, 4, 1, 2, 5, 6, -1]


def test_prune_is_inclusive_and_counts_the_entry_edge(tree):
    assert tree.prune(2).tolist() == [0, 1, 4, 5, 6]
    assert tree.prune(1.9).tolist() == IDS
    # a masked node in the middle only stops the walk; a masked leaf protects its twig
    assert tree.prune(3, mask=[1, 1, 1, 1, 1, 0, 1]).tolist() == [0, 1, 4, 5]
    assert tree.prune(3, mask=[1, 1, 1, 0, 1, 1, 1]).tolist() == [0, 1, 2, 3]


def test_roots_cycles_and_odd_ids():
    f = Forest([90, 20, 50, 10, 70, 30], [20, 50, 12345, 70, 20, 50])
    assert f.is_root.tolist() == [False, False, True, False, False, False]
    assert Forest([5, 6, 7], [-1, -1, -1]).kinds().tolist() == [0, 0, 0]
    assert Forest([1, 2], [2, 1]).has_cycles() and not f.has_cycles()
    with pytest.raises(CycleError):
        Forest([1, 2], [2, 1]).root()
    assert Forest([], []).root_distance().tolist() == []
    deep = Forest(np.arange(50_000), np.arange(50_000) - 1)
    assert deep.root_distance()[-1] == 49_999


def test_longest_paths_measure_the_catchment(tree):
    assert tree.longest(2) == [[6, 5, 4, 1, 0], [3, 2]]
    assert tree.longest(2, min_length=5) == []  # four own edges and one twig's first edge
    assert tree.longest(2, min_length=4.5) == [[6, 5, 4, 1, 0]]


@st.composite
def forests(draw):
    n = draw(st.integers(1, 40))
    parent = [draw(st.integers(-1, k - 1)) for k in range(n)]
    order = draw(st.permutations(range(n)))
    weight = draw(st.lists(st.integers(0, 9), min_size=n, max_size=n))
    ids = [1000 + 7 * k for k in range(n)]
    return [ids[k] for k in order], [ids[parent[k]] if parent[k] >= 0 else -1 for k in order], [weight[k] for k in order]


@settings(max_examples=60, deadline=None)
@given(forests())
def test_against_brute_force(x):
    ids, parents, weight = x
    f = Forest(ids, parents, weight)
    up = dict(zip(ids, parents, strict=True))
    w = dict(zip(ids, weight, strict=True))

    def chain(i):
        out = [i]
        while up[out[-1]] in up:
            out.append(up[out[-1]])
        return out

    chains = {i: chain(i) for i in ids}
    assert f.root_distance().tolist() == [sum(w[j] for j in chains[i][:-1]) for i in ids]
    assert f.ids[f.root()].tolist() == [chains[i][-1] for i in ids]
    assert f.descendant_counts().tolist() == [sum(i in chains[j] for j in ids) - 1 for i in ids]
    below = {i: sum(i in chains[j] for j in ids) for i in ids}
    assert f.betweenness().tolist() == [(below[i] - 1) * (len(chains[i]) - 1) for i in ids]
    pre = f.ids[f.preorder()].tolist()
    for i, at in zip(ids, range(len(ids)), strict=True):
        assert f.ids[f.descendants(at)].tolist() == pre[pre.index(i) : pre.index(i) + below[i]]
    d = f.distances(np.arange(f.n), np.arange(f.n))
    assert np.array_equal(d, d.T)
    i, j = np.divmod(np.arange(f.n**2), f.n)
    assert np.array_equal(f.pair_distances(i, j), d.ravel())
    assert np.array_equal(f.pair_distances(i, j, directed=True), f.distances(np.arange(f.n), np.arange(f.n), directed=True).ravel())
    # undirected betweenness: unordered pairs whose path runs through a node
    hops = f.distances(np.arange(f.n), np.arange(f.n), weighted=False)
    want = [sum(hops[a, b] > 0 and hops[a, i] > 0 and hops[i, b] > 0 and hops[a, i] + hops[i, b] == hops[a, b] for a in range(f.n) for b in range(a)) for i in range(f.n)]
    assert f.betweenness(directed=False).tolist() == want
    kept, new_parents, new_weights, node_map = f.rewire(f.topology())
    assert set(node_map) <= set(f.ids[kept].tolist())
    assert sum(new_weights) == sum(w[i] for i in ids if up[i] in up)


def test_bridges_have_minimal_total_length():
    xyz = np.array([[0, 0, 0], [1, 0, 0], [5, 0, 0], [6, 0, 0], [6, 4, 0]], float)
    label = np.array([0, 0, 2, 2, 4])
    assert stitch(xyz, label, np.ones(5, bool)) == [(1, 2, 4.0), (3, 4, 4.0)]
    assert stitch(xyz, label, np.ones(5, bool), 3.9) == []
    assert bfs_rewire([1, 2, 3], [-1, 1, -1], [(2, 3)], 3).tolist() == [2, 3, -1]


def test_operators_take_many_skeletons(spark):
    rows = [(s, i, p, k, 1.0, float(i), 0.0, 0.0) for s in (1, 2) for k, (i, p) in enumerate(zip(IDS, PARENTS, strict=True))]
    nodes = spark.createDataFrame(rows, "skeleton_id bigint, node_id bigint, parent_id bigint, ord bigint, weight double, x double, y double, z double")
    assert {(r.skeleton_id, r.node_id): r.dist for r in trees.dist_to_root(nodes).collect()}[(2, 6)] == 4
    some = nodes.where("node_id = 1").select("skeleton_id", "node_id")
    assert [r.node_id for r in trees.descendants(nodes, some).where("skeleton_id = 1").orderBy("pos").collect()] == [1, 2, 3, 4, 5, 6]
    assert trees.dist_to_root(nodes.where("false")).count() == 0
    assert repair.heal_skeleton(nodes).count() == 14
    kept, moved = resampling.downsample_skeleton(nodes, 2)
    assert {r.node_id for r in kept.where("skeleton_id = 1").collect()} == {0, 1, 3, 4, 6}
    assert moved.count() == 14
    new = resampling.resample_skeleton(nodes, 0.5).where("skeleton_id = 1")
    assert new.where("parent_id = -1").count() == 1 and new.count() > 7
    with pytest.raises(ValueError):
        trees.strahler_index(nodes, "other")


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("some", [False, True])
def test_one_matrix_is_dealt_over_tasks(spark, monkeypatch, directed, some):
    from pyspark.sql import functions as F

    monkeypatch.setattr(trees, "BLOCK", 50, raising=False)
    ids = list(range(40))
    parents, weights = [(k - 1) // 2 if k % 17 else -1 for k in ids], [float(k % 5) for k in ids]
    weights[9] = float("inf")  # no way
    nodes = spark.createDataFrame([(0, k, p, w) for k, p, w in zip(ids, parents, weights, strict=True)], "skeleton_id long, node_id long, parent_id long, weight double")
    s, t = (ids[1::3], ids[::2]) if some else (ids, ids)
    wanted = [spark.createDataFrame([(0, k) for k in x], "skeleton_id long, node_id long") if some else None for x in (s, t)]
    got = trees.geodesic_matrix(nodes, *wanted, directed=directed).withColumn("task", F.spark_partition_id()).collect()
    brute = Forest(ids, parents, weights).distances(s, t, directed)
    assert {(r.source, r.target): r.dist for r in got} == {(a, b): d for a, line in zip(s, brute.tolist(), strict=True) for b, d in zip(t, line, strict=True)}
    assert len(got) == len(s) * len(t) and len({r.task for r in got}) > 1


def test_blocks_of_distances_are_bounded():
    from arborix.kernels.forest import block_distances

    n = 200
    f = Forest(np.arange(n), (np.arange(n) - 1) // 2)
    rows, place, end, low, tops = f.labels(np.arange(n))
    at = np.empty(n, np.int64)
    at[rows] = np.arange(n)
    for directed in (False, True):
        blocks = [b for _, b in block_distances(at, at, place, end, f.root_distance()[rows], low, f.root_distance()[tops], directed, step=1000)]
        assert max(b.size for b in blocks) <= 1000
        assert np.array_equal(np.concatenate(blocks), f.distances(np.arange(n), np.arange(n), directed))


def test_paths_and_subtrees_are_dealt_over_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(trees, "RUNS", 30, raising=False)
    ids = list(range(60))
    parents = [k - 1 if k < 20 else (k - 1) // 2 for k in ids]
    f = Forest(ids, parents)
    nodes = spark.createDataFrame([(0, k, p) for k, p in zip(ids, parents, strict=True)], "skeleton_id long, node_id long, parent_id long")
    sources = spark.createDataFrame([(0, k) for k in [*ids, 7, 999]], "skeleton_id long, node_id long")
    for got, walk in ((trees.paths_to_root(nodes, sources), f.path), (trees.descendants(nodes, sources), lambda i: f.descendants(i).tolist())):
        got = got.withColumn("task", F.spark_partition_id()).collect()
        want = [(s, k, x) for s in [*ids, 7] for k, x in enumerate(walk(s))]
        assert sorted((r.source, r.pos, r.node_id) for r in got) == sorted(want)
        assert len({r.task for r in got}) > 1


def test_resampled_map_takes_little_memory():
    import tracemalloc

    import pandas as pd

    n = 30_000
    f = Forest(np.arange(n), np.where(np.arange(n) % 17, (np.arange(n) - 1) // 2, -1))
    p = pd.DataFrame({c: np.arange(n) * k % 101.0 for c, k in zip("xyz", (1, 7, 30), strict=True)})
    made = getattr(resampling, "_mapped", None) or (lambda *a: resampling._resampled(*a)[1])
    tracemalloc.start()
    out = made(f, p, 20.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == n and peak < 400 * n
    segments = f.linear_segments()
    flat, count = f.linear_rows()
    assert flat.tolist() == [i for s in segments for i in s] and count.tolist() == [len(s) for s in segments]
    # a node inside a segment goes to one of its ends or to a new one
    ends = {i: {s[0], s[-1]} for s in segments for i in s[1:-1]}
    assert all(t == i if i not in ends else t in ends[i] or t >= n for i, t in zip(out.node_id, out.target, strict=True))
