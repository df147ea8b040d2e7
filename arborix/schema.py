"""Column contracts: checks, defaults and the grouped runner shared by the operators.

Tables hold many objects at once; the first column of each names the object (``skeleton_id``, ``graph_id``,
``mesh_id``, ``neuron_id``). Sentinels are values, not nulls: -1 for no node, no distance, no match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = -1


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def with_order(df: DataFrame, *keys: str) -> DataFrame:
    """``ord``, the input row order that ties go by; the ids' order where the table has none."""
    return df if "ord" in df.columns else df.withColumn("ord", F.struct(*keys))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """These columns, as far as the table has them: what a kernel does not read is not shuffled."""
    return df.select(*[c for c in columns if c in df.columns])


def per_object(df: DataFrame, key: str | list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One shuffle on the object id, then the kernel on each object's rows."""
    return df.groupBy(key).applyInPandas(kernel, schema)


def per_pair(left: DataFrame, right: DataFrame, key: str, kernel: Callable, schema: str) -> DataFrame:
    """The kernel on the rows of both tables that share an object id (either may be empty)."""
    # new column identities: both sides may stem from one table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(kernel, schema)


def per_block(packed: DataFrame, key: str, kernel: Callable, schema: str) -> DataFrame:
    """The kernel on each of the ``blocks`` of each object's one row, dealt over all tasks; it yields its result piece by piece.

    Blocks travel as ``block``. They are small beside what they become, so the number of partitions is set: by size they would meet in a few tasks.
    """
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from kernel({c: batch.column(c)[row].as_py() for c in batch.schema.names})

    return dealt.repartition(n, key, "block").groupBy(key, "block").applyInArrow(run, schema)


def euclid(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    total = None
    for p, q in zip(a, b, strict=True):
        d = (p - q) * (p - q)
        total = d if total is None else total + d
    return F.sqrt(total)
