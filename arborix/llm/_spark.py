"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm._text import mix

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Unset, a fresh folder on a single machine and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="arborix-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Write Parquet; the shuffle files of this one query go with its end."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEAN)
        else:
            conf.set(_CLEAN, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*saved: DataFrame) -> None:
    """Delete what ``save`` wrote; nothing may read it any more."""
    for df in saved:
        spark, path = df.sparkSession, getattr(df, "_scratch", None)
        if path:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


SIEVE_BITS, _SIEVE_BLOCK = 26, 19


def _probes(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Three places of each value in its block of a sieve."""
    h, low = mix(x ^ np.uint64(0xA5A5)), np.uint64((1 << _SIEVE_BLOCK) - 1)
    return tuple(((h >> np.uint64(k * _SIEVE_BLOCK)) & low).astype(np.int64) for k in range(3))


def sieve(ids: DataFrame):
    """A function on bigint columns: true for all values of ``ids`` (one bigint column) and for few others, so that rows it leaves out need no join.

    A Bloom filter of 16 bits a value or more, 2 ** SIEVE_BITS (8 MB) at most: far beyond 4 million values it leaves out little.
    """
    ids = ids.where(F.col(ids.columns[0]).isNotNull())
    blocks = 1 << max(0, min(SIEVE_BITS, (16 * ids.count()).bit_length()) - _SIEVE_BLOCK)

    def block_of(x):
        return (mix(x) % np.uint64(blocks)).astype(np.int64)

    def packed(batches):
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            block = block_of(x)
            full = np.unique(block).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([x[block == k].tobytes() for k in full], pa.binary())], ["block", "ids"])

    def filled(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _SIEVE_BLOCK, bool)
        for x in group["ids"].to_pylist():
            for at in _probes(np.frombuffer(x, np.uint64)):
                bits[at] = True
        return pa.table([pa.array([group["block"][0].as_py()], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])

    table = np.zeros((blocks, 1 << (_SIEVE_BLOCK - 3)), np.uint8)
    for r in ids.mapInArrow(packed, "block int, ids binary").groupBy("block").applyInArrow(filled, "block int, bits binary").collect():
        table[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(table)

    def passes(col: pa.Array) -> pa.Array:
        x = col.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        block, out = block_of(x), np.ones(len(x), bool)
        for at in _probes(x):
            out &= (shared.value[block, at >> 3] >> (7 - (at & 7))) & 1 > 0
        return pa.array(out)

    return F.arrow_udf(passes, "boolean")


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """The columns that text kernels read, whatever else ``docs`` carries; a null text is the empty one."""
    return docs.select(*more, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def n_buckets(docs: DataFrame, per: int = 2, least: int = 16) -> int:
    """Key ranges for hashed blobs: grows with the number of input partitions."""
    return max(least, per * docs.rdd.getNumPartitions())


def crc_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))
