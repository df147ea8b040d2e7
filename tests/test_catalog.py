"""Every query of the catalog beside its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from arborix import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracles())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("-" if v != v else round(float(v), 5) if not isinstance(v, str) else v for v in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(db.sql(catalog.oracles()[name]).df())


def test_oracles_belong_to_queries():
    assert set(catalog.oracles()) <= set(catalog.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_geodesic_matrices_of_all_nodes(spark):
    import numpy as np

    from arborix.catalog.graphs import trade
    from arborix.catalog.inputs import forest
    from arborix.catalog.meshes import sheet
    from arborix.operators.meshes import as_graph

    v, f = sheet(spark, SF)
    tree = forest(spark, SF).selectExpr("skeleton_id as o", "node_id as a", "parent_id as b", "weight as w").toPandas()
    graph = trade(spark, SF).selectExpr("graph_id as o", "src as a", "dst as b", "weight as w").toPandas()
    mesh = as_graph(f, v).selectExpr("graph_id as o", "src as a", "dst as b", "weight as w").toPandas()
    cases = [("geodesic_matrix_all", tree, False), ("geodesic_matrix_directed_all", tree, True), ("geodesic_matrix_graph_all", graph, False), ("csgraph_dijkstra_all", graph, True), ("geodesic_matrix_mesh_all", mesh, False)]
    for name, edges, directed in cases:
        got = catalog.queries()[name](spark, SF).toPandas()
        first = got.columns[0]
        o = edges.o.min()
        e, got = edges[edges.o == o], got[got[first] == o]
        ids = np.unique(e.a if edges is tree else np.concatenate([e.a, e.b]))
        d = np.full((len(ids),) * 2, np.inf)
        np.fill_diagonal(d, 0)
        for a, b, w in zip(e.a, e.b, e.w, strict=True):
            if a in ids and b in ids:
                i, j = np.searchsorted(ids, [a, b])
                d[i, j] = min(d[i, j], w)
                d[j, i] = d[j, i] if directed else min(d[j, i], w)
        for k in range(len(ids)):
            d = np.minimum(d, d[:, k : k + 1] + d[k])
        got = got.sort_values(["source", "target"])
        assert len(got) == len(ids) ** 2, name
        assert np.allclose(got.dist.replace(-1, np.inf).to_numpy().reshape(d.shape), d), name
    for name in ("geodesic_predecessors_all", "geodesic_path_all"):
        got = catalog.queries()[name](spark, SF).toPandas()
        nodes = set(zip(graph.o, graph.a, strict=True)) | set(zip(graph.o, graph.b, strict=True))
        wanted = {(o, x) for o, x in nodes if name != "geodesic_path_all" or (o, x + 31) in nodes}
        assert set(zip(got.graph_id, got.source, strict=True)) <= wanted and len(got), name
        if name == "geodesic_predecessors_all":
            assert set(zip(got.graph_id, got.source, strict=True)) == wanted
