"""Queries of the similarity operators: clouds of embeddings by label, and of events by user group."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborix.catalog.inputs import table
from arborix.kernels.clouds import ScoreTable
from arborix.operators import clouds as c

# a rule instead of a table: high for near and parallel points, falling with distance
_EDGES = [0.0, 0.05, 0.1, 0.2, 0.4, 0.8]
_DOTS = [0.0, 0.25, 0.5, 0.75]
TABLE = ScoreTable([[10 - 3 * r + 2 * s for s in range(4)] for r in range(6)], _EDGES, _DOTS)


def dots(spark, sf_dir):
    """Every embedding a point of its label's cloud: place from dimensions 1-3, unit tangent from 4-6."""
    e = table(spark, sf_dir, "embeddings")
    v = [F.col("embedding")[k].cast("double") for k in range(6)]
    size = F.sqrt(v[3] * v[3] + v[4] * v[4] + v[5] * v[5])
    return e.select(F.col("label").cast("long").alias("neuron_id"), F.col("vec_id").alias("point_id"), *[v[k].alias(n) for k, n in enumerate("xyz")], *[(v[k + 3] / size).alias(f"v{n}") for k, n in enumerate("xyz")])


def connectors(spark, sf_dir):
    """Every event a connector of its user group: type by event type, place by value and time."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 40).alias("neuron_id"), F.col("event_id").alias("cn_id"), (F.col("event_id") % 101 / 100.0).alias("x"), (F.col("event_id") % 37 / 50.0).alias("y"), (F.col("user_id") % 11 / 20.0).alias("z"), (F.length("event_type") % 3).cast("long").alias("cn_type"))


def _q(fn, source=dots):
    return lambda spark, sf_dir: fn(source(spark, sf_dir))


def _pairs(d):
    ids = d.select("neuron_id").distinct()
    return ids.select(F.col("neuron_id").alias("q"), (F.col("neuron_id") + 1).alias("t")).join(ids.select(F.col("neuron_id").alias("t")), "t", "left_semi")


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


QUERIES = {
    "dotprops": _q(lambda d: c.dotprops(d.select("neuron_id", "point_id", "x", "y", "z"), 10)),
    "nblast_allbyall": _q(lambda d: _rounded(c.nblast_allbyall(d, TABLE))),
    "nblast_allbyall_mean": _q(lambda d: _rounded(c.nblast_allbyall(d, TABLE, symmetry="mean", limit_dist="auto"))),
    "nblast": _q(lambda d: _rounded(c.nblast(d, d, TABLE, symmetry="min"))),
    "nblast_pairs": _q(lambda d: _rounded(c.nblast_pairs(d, _pairs(d), TABLE))),
    "nblast_smart": _q(lambda d: _rounded(c.nblast_smart(d, TABLE, 50, downsample=3))),
    "nblast_knn": _q(lambda d: _rounded(c.nblast_knn(d, TABLE, 3, voxel=0.2))),
    "synblast": _q(lambda d: _rounded(c.synblast(d, TABLE)), connectors),
}

_BIN = lambda edges, x: " + ".join(f"({x} >= {e})::INT" for e in edges[1:])
_DOTSQL = """WITH v AS (SELECT label::BIGINT AS n, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings),
    d AS (SELECT n, id, x, y, z, a / sqrt(a*a+b*b+c*c) AS vx, b / sqrt(a*a+b*b+c*c) AS vy, c / sqrt(a*a+b*b+c*c) AS vz FROM v),
    best AS (SELECT q.n AS q, t.n AS t, q.id, min_by({'d': sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.z-t.z)*(q.z-t.z)), 'p': abs(q.vx*t.vx+q.vy*t.vy+q.vz*t.vz)}, ((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.z-t.z)*(q.z-t.z), t.id)) AS m FROM d q JOIN d t ON q.n <> t.n GROUP BY q.n, t.n, q.id),
    own AS (SELECT n, count(*) * 16 AS s FROM d GROUP BY n),
    raw AS (SELECT q, t, sum(10 - 3 * (""" + _BIN(_EDGES, "m.d") + ") + 2 * (" + _BIN(_DOTS, "m.p") + """))::DOUBLE AS s FROM best GROUP BY ALL),
    fwd AS (SELECT q, t, raw.s / own.s AS score FROM raw JOIN own ON own.n = q UNION ALL SELECT n, n, 1 FROM own)
"""
def _forward(d, name, limit=None):
    """CTEs for the forward scores among the points of ``d``; beyond a limit the score is that of its distance at a dot product of 0."""
    far = f"CASE WHEN m.d > {limit} THEN 10 - 3 * 5 ELSE 10 - 3 * ({_BIN(_EDGES, 'm.d')}) + 2 * ({_BIN(_DOTS, 'm.p')}) END" if limit else f"10 - 3 * ({_BIN(_EDGES, 'm.d')}) + 2 * ({_BIN(_DOTS, 'm.p')})"
    gap = "(q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.z-t.z)*(q.z-t.z)"
    return f""", {name}_best AS (SELECT q.n AS q, t.n AS t, q.id, min_by({{'d': sqrt({gap}), 'p': abs(q.vx*t.vx+q.vy*t.vy+q.vz*t.vz)}}, ({gap}, t.id)) AS m FROM {d} q JOIN {d} t ON q.n <> t.n GROUP BY q.n, t.n, q.id),
        {name}_own AS (SELECT n, count(*) * 16 AS s FROM {d} GROUP BY n),
        {name} AS (SELECT q, t, sum({far})::DOUBLE / any_value(o.s) AS score FROM {name}_best JOIN {name}_own o ON o.n = q GROUP BY q, t UNION ALL SELECT n, n, 1 FROM {name}_own)
    """


ORACLES = {
    "nblast_allbyall_mean": _DOTSQL + _forward("d", "near", 0.84) + "SELECT a.q, a.t, round((a.score + b.score) / 2, 6) AS score FROM near a JOIN near b ON b.q = a.t AND b.t = a.q",
    "nblast": _DOTSQL + "SELECT a.q, a.t, round(least(a.score, b.score), 6) AS score FROM fwd a JOIN fwd b ON b.q = a.t AND b.t = a.q",
    "nblast_smart": _DOTSQL + ", third AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY id) - 1 AS k FROM d) WHERE k % 3 = 0)" + _forward("third", "coarse") + """,
        pick AS (SELECT *, score >= quantile_cont(score, 0.5) OVER (PARTITION BY q) AS exact FROM coarse)
        SELECT p.q, p.t, round(CASE WHEN exact THEN f.score ELSE p.score END, 6) AS score, exact FROM pick p JOIN fwd f USING (q, t)""",
    # every pair is a candidate here, so the three best of all are found
    "nblast_knn": _DOTSQL + """, mean AS (SELECT a.q, a.t, (a.score + b.score) / 2 AS score FROM fwd a JOIN fwd b ON b.q = a.t AND b.t = a.q WHERE a.q <> a.t)
        SELECT q, rank::INT AS rank, t, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS rank FROM mean) WHERE rank <= 3""",
    "nblast_allbyall": _DOTSQL + "SELECT q, t, round(score, 6) AS score FROM fwd",
    "nblast_pairs": _DOTSQL + "SELECT q, t, round(score, 6) AS score FROM fwd WHERE t = q + 1",
    "synblast": """WITH d AS (SELECT user_id % 40 AS n, event_id AS id, event_id % 101 / 100.0::DOUBLE AS x, event_id % 37 / 50.0::DOUBLE AS y, user_id % 11 / 20.0::DOUBLE AS z, len(event_type) % 3 AS k FROM events),
        near AS (SELECT q.n AS q, t.n AS t, q.id, min((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.z-t.z)*(q.z-t.z)) AS d FROM d q JOIN d t ON t.k = q.k AND t.n <> q.n GROUP BY ALL),
        own AS (SELECT n, count(*) AS c FROM d GROUP BY n),
        hit AS (SELECT q, t, count(*) AS c, sum(16 - 3 * (""" + _BIN(_EDGES, "sqrt(d)") + """)) AS s FROM near GROUP BY ALL)
        SELECT a.n AS q, b.n AS t, round(CASE WHEN a.n = b.n THEN 1 ELSE (coalesce(h.s, 0) + (a.c - coalesce(h.c, 0)) * 1) / (a.c * 16.0::DOUBLE) END, 6) AS score
        FROM own a CROSS JOIN own b LEFT JOIN hit h ON h.q = a.n AND h.t = b.n""",
}
