"""Score tables, clustering, transforms, clouds and file sources."""

import gzip

import numpy as np
import pytest

from arborix.catalog import warps as samples
from arborix.kernels import clouds as c
from arborix.kernels.warp import Mls, Tps
from arborix.operators import scores as s
from arborix.sources import cmtk, elastix, swc


@pytest.fixture
def table(spark):
    m = [[1, 0.2, 0.9], [0.2, 1, 0.4], [0.9, 0.4, 1]]
    return spark.createDataFrame([(q, t, float(v)) for q, r in enumerate(m) for t, v in enumerate(r)], "q bigint, t bigint, score double")


def test_matches(spark, table):
    top = {(r.grp, r["rank"]): r.other for r in s.top_matches(table, 2).collect()}
    assert [[top[(q, k)] for k in (1, 2)] for q in range(3)] == [[0, 2], [1, 2], [2, 0]]
    assert [r.n for r in s.count_matches(table, threshold=0.5).orderBy("grp").collect()] == [2, 1, 2]
    nan = table.unionByName(spark.createDataFrame([(0, 3, float("nan"))], table.schema))
    assert s.matches_above(nan, percentage=0.1).where("other = 3").count() == 0
    padded = s.top_matches(table, 5).where("rank = 5").collect()
    assert all(r.other == -1 and np.isnan(r.score) for r in padded)
    with pytest.raises(ValueError):
        s.matches_above(table, 0.5, max_matches=2)
    with pytest.raises(ValueError):
        s.matches_above(table)
    assert s.observations_from_condensed(6) == 4


def test_linkage():
    x = np.random.default_rng(0).normal(size=(12, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for method in s.METHODS:
        z = s.linkage_matrix(d, method)
        assert z[-1, 3] == 12 and sorted(s.leaf_order_of(z)) == list(range(12))
    z = s.linkage_matrix(d, "single")
    assert np.all(np.diff(z[:, 2]) >= 0)
    # the definition of average linkage, merge by merge
    z, groups = s.linkage_matrix(d, "average"), {k: [k] for k in range(12)}
    for k, (a, b, height, _) in enumerate(z):
        best = min(np.mean(d[np.ix_(groups[i], groups[j])]) for i in groups for j in groups if i < j)
        assert height == pytest.approx(best)
        groups[12 + k] = groups.pop(int(a)) + groups.pop(int(b))


def test_transforms():
    x = np.random.default_rng(1).uniform(-1, 1, (40, 3))
    tps = Tps(samples.SOURCE, samples.TARGET)
    assert np.allclose(tps(samples.SOURCE), samples.TARGET)
    assert np.allclose((-tps)(samples.TARGET), samples.SOURCE)
    for make in (Tps, Mls):
        assert np.allclose(make(samples.SOURCE, samples.LINEAR)(x), x * 2 + [1, -1, 0.5])
    with pytest.raises(ValueError):
        Tps(samples.SOURCE[:3], samples.TARGET[:3])
    with pytest.raises(ValueError):
        Tps(np.zeros((5, 3)), np.ones((5, 3)))


def test_cmtk(tmp_path):
    chain = samples.cmtk()
    x = np.random.default_rng(2).uniform(0.5, 7, (30, 3))
    assert np.allclose(chain.xform_inv(chain.xform(x)), x, atol=1e-6)
    assert np.isnan(chain.xform([[9.0, 1, 1]])).all()
    assert np.allclose(chain.xform([[9.0, 1, 1]], fallback_to_affine="chain"), chain.xform([[9.0, 1, 1]], transform="affine"))
    assert np.allclose(chain.xform(chain.xform(x), invert=[True]), x, atol=1e-6)
    text = b'! TYPEDSTREAM 1.1\nregistration {\n affine_xform {\n  xlate 0 0 0\n  rotate 0 0 0\n  scale 1 2 3\n  shear 0 0 0\n  center 0 0 0\n }\n}\n'
    folder = tmp_path / "a.list"
    folder.mkdir()
    (folder / "registration.gz").write_bytes(gzip.compress(text))
    assert np.allclose(cmtk.load_cmtk_registration(str(folder)).xform([[1.0, 1, 1]]), [[1, 2, 3]])
    with pytest.raises(cmtk.FormatError):
        cmtk.Registration(b"nonsense")


def test_elastix(tmp_path):
    t = samples.elastix()
    x = np.random.default_rng(3).uniform(-3, 3, (30, 3))
    assert np.allclose(t.xform(t.xform_inv(t.xform(x))), t.xform(x), atol=1e-4)
    (tmp_path / "a.txt").write_text('(Transform "TranslationTransform")\n(TransformParameters 1 2 3) // note\n(InitialTransformParametersFileName "NoInitialTransform")\n')
    (tmp_path / "b.txt").write_text('(Transform "TranslationTransform")\n(TransformParameters 1 0 0)\n(InitialTransformParametersFileName "elsewhere/a.txt")\n(HowToCombineTransforms "Add")\n')
    both = elastix.load_elastix_transform(str(tmp_path / "b.txt"))
    assert np.allclose(both.xform([[0.0, 0, 0]]), [[2, 2, 3]])
    assert both.affine is None and np.allclose(elastix.load_elastix_transform(str(tmp_path / "a.txt")).affine[:3, 3], [1, 2, 3])
    assert not both.invertible and not elastix.is_invertible(str(tmp_path / "b.txt")) and elastix.is_invertible(str(tmp_path / "a.txt"))
    (tmp_path / "c.txt").write_text('(Transform "TranslationTransform")\n(TransformParameters 1 0 0)\n(InitialTransformParametersFileName "c.txt")\n')
    with pytest.raises(ValueError):
        elastix.load_elastix_transform(str(tmp_path / "c.txt"))


def test_score_bins_are_left_closed_and_the_limit_strict():
    t = c.ScoreTable([[1, 2], [3, 4]], [0, 1], [0, 0.5])
    assert t.score(np.array([1.0]), np.array([0.5])) == 4
    assert t.score(np.array([0.99]), np.array([0.49])) == 1
    assert t.score(np.array([1.5]), np.array([0.9]), limit=1.5) == 4
    assert t.score(np.array([1.6]), np.array([0.9]), limit=1.5) == 3
    r = c.read_scores(['"","(0,0.5]","(0.5,1]"', '"(0,1]",1,2', '"(1,2]",3,4'])
    assert r.values.tolist() == [[1, 2], [3, 4]] and r.auto_limit == pytest.approx(1.05)


def test_tangents_of_a_line():
    p = np.column_stack([np.arange(10.0), np.zeros(10), np.zeros(10)])
    v, alpha = c.tangents(p, 5)
    assert np.allclose(np.abs(v[:, 0]), 1) and np.allclose(alpha, 1)
    v, alpha = c.tangents(np.zeros((4, 3)), 3)
    assert np.allclose(v, [1, 0, 0]) and np.allclose(alpha, 0)


def test_swc(spark, tmp_path):
    (tmp_path / "77.swc").write_text("# head\n1 1 0 0 0 1.5 -1\n2 3 1 2 3 0.5 1\n")
    rows = swc.read_swc(spark, f"file://{tmp_path}/77.swc").orderBy("ord").collect()
    assert [(r.skeleton_id, r.node_id, r.parent_id, r.radius) for r in rows] == [(77, 1, -1, 1.5), (77, 2, 1, 0.5)]
    swc.write_swc(swc.read_swc(spark, f"file://{tmp_path}/77.swc"), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").count() == 2


def test_synblast_asks_places_once_and_passes_over_broken_ones(spark):
    from arborix.kernels.clouds import ScoreTable
    from arborix.operators import clouds

    table = ScoreTable([[9.5, 10.0], [4.0, 5.0], [-2.0, -1.5]], [0.0, 0.5, 1.0], [0.0, 0.5])
    rng = np.random.default_rng(3)
    rows = [(int(n), i, *(rng.integers(0, 4, 3) / 4).tolist(), int(k)) for i, (n, k) in enumerate(zip(rng.integers(0, 9, 300), rng.integers(0, 3, 300), strict=True))]
    rows = [r for r in rows if not (r[0] == 4 and r[5] == 1)]  # neuron 4 lacks a type
    rows += [(n, 1000 + n, float("nan"), 0.0, 0.0, 0) for n in (2, 5)]
    df = spark.createDataFrame(rows, "neuron_id long, cn_id long, x double, y double, z double, cn_type long")
    got = {(r.q, r.t): r.score for r in clouds.synblast(df, table).collect()}
    for q in range(9):
        mine = [r for r in rows if r[0] == q]
        for t in range(9):
            total = 0.0
            for r in mine:
                d = [np.sqrt(sum((a - b) ** 2 for a, b in zip(r[2:5], u[2:5], strict=True))) for u in rows if u[0] == t and u[5] == r[5]]
                near = min([x for x in d if x == x], default=np.inf)
                total += 10.0 if near < 0.5 else 5.0 if near < 1 else -1.5
            assert np.isclose(got[q, t], 1.0 if q == t else total / (10 * len(mine))), (q, t)
    assert len(got) == 81
