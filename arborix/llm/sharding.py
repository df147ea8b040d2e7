"""Sharding by bytes: contiguous shards of near equal size, from global prefix sums.

Rows are range-partitioned and sorted by (doc_id, checksum, size); only these small columns travel.
Each partition's total gives, by a prefix sum over the partitions, the bytes before it; a running sum
inside the partition gives each row's place. Shard k takes the rows whose middle byte lies in the
k-th equal part of all bytes, so a shard's size misses the mean by less than the two rows at its ends.

Edge cases: a null text counts 0 bytes (plus 1) and has the checksum of no bytes; null ids sort first;
repeated rows each get a slot of their own; an empty table gives an empty result; a text larger than a
shard's share leaves shards empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.llm._spark import save

# twice the middle byte of a row (so that it is whole), as a decimal that the product cannot overflow
_MIDDLE = "cast(2 * (bytes_before + upto) - size as decimal(28, 0))"


def by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    small = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    n = max(1, docs.rdd.getNumPartitions())
    order = ["doc_id", "text_crc32", "size"]
    # written: the partition numbers must stay as they are for all that follows
    placed = save(
        small.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}),
        "shard-places",
    )
    parts = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # one row for each partition: their prefix sums are the only global step
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("at")
    running = placed.withColumns(
        {
            "upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "nth": F.row_number().over(inside),
        }
    ).join(parts, "part")
    cut = running.select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.expr(f"int(({_MIDDLE}) * {shards} div (2 * total))"), F.lit(shards - 1)).alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("place"),
    )
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))  # at most `shards` rows
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

