"""Graph and mesh kernels and operators."""

import numpy as np
import pytest

from arborix.kernels import graph as g
from arborix.kernels import mesh as m
from arborix.operators import graphs


def test_bridges_and_parallel_edges():
    a, b = [0, 1, 2, 2, 3, 4, 5, 5], [1, 2, 0, 3, 4, 5, 3, 3]
    assert g.bridges(6, a, b).tolist() == [False, False, False, True, False, False, False, False]
    assert g.bridges(2, [0, 0], [1, 1]).tolist() == [False, False]


def test_spanning_forest_matches_weights_and_ties():
    assert g.spanning_forest(3, [0, 1, 0], [1, 2, 2], [1, 1, 1]).tolist() == [0, 1]
    with pytest.raises(ValueError):
        g.spanning_forest(2, [0], [1], [np.nan])


def test_search_limit_is_inclusive_and_clusters_reach_through():
    line = g.Graph(4, [0, 1, 2], [1, 2, 3], [1.0, 1.0, 1.0])
    assert np.isfinite(line.search([0], 2.0)[0]).tolist() == [True, True, True, False]
    assert line.path(0, 3) == [0, 1, 2, 3] and line.path(0, 3, 2.0) == []
    assert line.clusters(1.0)[0].tolist() == [0, 0, 1, 1]
    assert line.terminal_tree([0, 3]) == [(0, 1, 3.0)]
    items = g.Items(line, [0, 1, 3])
    assert items.grow(0, 2) == ([0, 1], [0.0, 1.0])
    assert items.spread(3) == [0, 2, 1]


def grid(n):
    v = np.array([[i, j, 0] for i in range(n) for j in range(n)], float)
    f = [t for i in range(n - 1) for j in range(n - 1) for t in ([i * n + j, (i + 1) * n + j, i * n + j + 1], [(i + 1) * n + j, (i + 1) * n + j + 1, i * n + j + 1])]
    return v, np.array(f)


def test_decimation_keeps_a_flat_sheet_flat_and_its_budget():
    v, f = grid(8)
    nv, nf, moved = m.simplify(v, f, target=40)
    assert len(nf) <= 49 and np.allclose(nv[:, 2], 0) and moved.max() < len(nv)
    lock = np.zeros(len(v), bool)
    lock[27] = True
    nv, nf, moved = m.simplify(v, f, target=20, lock=lock)
    assert np.allclose(nv[moved[27]], v[27])


def test_rings_close_and_fill():
    v, f = grid(4)
    half = np.array([e for t in f.tolist() for e in zip(t, t[1:] + t[:1], strict=True)])
    once = [e for e in half.tolist() if e[::-1] not in half.tolist()]
    ring = m.loops(np.array(once))
    assert len(ring) == 1 and len(ring[0]) == 12
    assert len(m.fill(ring[0], v)) == 10


@pytest.mark.parametrize("method", ["laplacian", "taubin", "humphrey"])
@pytest.mark.parametrize("weights", ["uniform", "inverse", "cotangent"])
def test_smoothing_flattens_a_bump_and_keeps_what_is_locked(method, weights):
    v, f = grid(7)
    v[24, 2] = 1.0
    out = m.smooth(v, f, method, iterations=3, weights=weights, preserve_border=True)
    assert out[24, 2] < 1 and np.allclose(out[0], v[0])
    lock = np.arange(len(v)) == 24
    assert np.allclose(m.smooth(v, f, method, lock=lock)[24], v[24])


def test_operators(spark):
    edges = spark.createDataFrame([(1, 0, 10, 20, 1.0), (1, 1, 20, 30, 1.0), (1, 2, 10, 30, 5.0), (2, 3, 7, 8, 2.0)], "graph_id bigint, edge_id bigint, src bigint, dst bigint, weight double")
    d = {(r.graph_id, r.source, r.target): r.dist for r in graphs.geodesic_matrix(edges).collect()}
    assert d[(1, 10, 30)] == 2 and d[(2, 7, 8)] == 2
    assert {(r.graph_id, r.source, r.target): r.dist for r in graphs.geodesic_matrix(edges, blocks=3).collect()} == d
    some = edges.selectExpr("graph_id", "src as node_id").distinct()
    assert sorted(graphs.geodesic_extreme(edges, some, some, blocks=2).collect()) == sorted(graphs.geodesic_extreme(edges, some, some).collect())
    assert sorted(r.edge_id for r in graphs.minimum_spanning_tree(edges).collect()) == [0, 1, 3]
    assert sorted(r.edge_id for r in graphs.spanning_forest_at_scale(edges).collect()) == [0, 1, 3]
    prepared = graphs.GeodesicGraph(edges)
    change = spark.createDataFrame([(1, 30, 10, 0.5)], "graph_id bigint, src bigint, dst bigint, weight double")
    assert prepared.set_weights(change).edges.where("edge_id = 2").first().weight == 0.5
    with pytest.raises(ValueError):
        prepared.set_weights(spark.createDataFrame([(1, 30, 11, 0.5)], "graph_id bigint, src bigint, dst bigint, weight double"))
