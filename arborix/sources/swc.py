"""SWC skeleton files as a nodes table and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """skeleton_id (of the file's name), ord, node_id, label, x, y, z, radius, parent_id of all files at ``path``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("v"))
    parts = F.split("v", r"\s+")
    rows = lines.where("v <> '' and not startswith(v, '#')").select("file", "at", parts.alias("p"))
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.swc)?$", 1)
    name = F.when(stem.rlike("^[0-9]{1,18}$"), stem.cast("long")).otherwise(F.xxhash64(stem))
    return rows.select(
        name.alias("skeleton_id"),
        F.row_number().over(Window.partitionBy("file").orderBy("at")).cast("long").alias("ord"),
        F.col("p")[0].cast("long").alias("node_id"),
        F.col("p")[1].cast("int").alias("label"),
        *[F.col("p")[k].cast("double").alias(c) for k, c in enumerate(("x", "y", "z", "radius"), 2)],
        F.col("p")[6].cast("long").alias("parent_id"),
    )


def write_swc(nodes: DataFrame, path: str) -> None:
    """One folder per skeleton (skeleton_id=...), rows by ord; read it back with the partition column."""
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t) if c in nodes.columns else F.lit(0).cast(t)
    line = F.concat_ws(" ", "node_id", zero("label", "int"), "x", "y", "z", zero("radius", "double"), "parent_id")
    order = "ord" if "ord" in nodes.columns else "node_id"
    nodes.repartition("skeleton_id").sortWithinPartitions("skeleton_id", order).select("skeleton_id", line.alias("value")).write.partitionBy("skeleton_id").text(path)
