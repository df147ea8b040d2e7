"""Transforms of point tables (x, y, z among other columns), batch by batch with a broadcast transform."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborix.kernels.warp import Mls, Tps
from arborix.schema import need


def xform(points: DataFrame, by, **options) -> DataFrame:
    """Points with new x, y, z; all other columns stay. ``by``: a callable on (n, 3) arrays, or an object with ``xform``.

    A null coordinate gives NaN. The transform's size is its own (landmarks, lattice), not the table's.
    """
    need(points, "x", "y", "z")
    shared = points.sparkSession.sparkContext.broadcast(by)
    names = points.columns
    from pyspark.sql import functions as F

    src = points.withColumns({c: F.col(c).cast("double") for c in "xyz"})

    def run(batches):
        t = shared.value
        move = t.xform if hasattr(t, "xform") else t
        for b in batches:
            xyz = np.column_stack([b.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in "xyz"])
            out = np.full(xyz.shape, np.nan)
            ok = np.isfinite(xyz).all(1)
            if ok.any():
                out[ok] = move(xyz[ok], **options)
            new = dict(zip("xyz", out.T, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else b.column(c) for c in names], names)

    return src.mapInArrow(run, src.schema)


def xform_inv(points: DataFrame, by, **options) -> DataFrame:
    return xform(points, by.xform_inv, **options)


def tps(points: DataFrame, source, target) -> DataFrame:
    return xform(points, Tps(source, target))


def mls(points: DataFrame, source, target, reverse: bool = False) -> DataFrame:
    return xform(points, Mls(source, target, reverse))
