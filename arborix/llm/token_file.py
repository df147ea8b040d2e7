"""Token-id files: ids of whole texts in ascending doc_id order, entropy coded by ``arborix.llm.rans``.

Format: a Parquet dataset with one row per segment (about ``SEGMENT`` ids of consecutive documents):
``part, segment`` (the order), ``doc_ids`` and ``lengths`` (the documents' index), ``symbols`` and
``freqs`` (the frequency table all blocks of the segment share) and ``blocks`` (independent blocks
with states, checkpoint, checksum). Any segment, block or half block decodes on its own.

Edge cases: a null or empty text has only the end id; null ids sort first and stay null; repeated rows
each have their own entry, ties ordered by text; one text longer than a segment makes a larger segment;
an empty table gives an empty dataset; extra columns are ignored; a damaged block raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborix.llm import rans
from arborix.llm._spark import text_of
from arborix.llm._text import id_array, ids_of, slices, trim
from arborix.llm.tokens import crc, encoder

SEGMENT, _PIECE = 4 << 20, 1 << 20  # ids of a segment; bytes of text encoded at once
_BLOCK = pa.struct(
    [
        ("n", pa.int64()),
        ("lanes", pa.int64()),
        ("states", pa.binary()),
        ("words", pa.binary()),
        ("check_step", pa.int64()),
        ("check_word", pa.int64()),
        ("check_states", pa.binary()),
        ("crc", pa.int64()),
    ]
)
_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("symbols", pa.binary()),
        ("freqs", pa.binary()),
        ("blocks", pa.list_(_BLOCK)),
    ]
)
_DDL = (
    "part int, segment int, doc_ids array<bigint>, lengths array<bigint>, symbols binary, freqs binary, "
    "blocks array<struct<n:bigint,lanes:bigint,states:binary,words:binary,check_step:bigint,check_word:bigint,check_states:binary,crc:bigint>>"
)


def segment_row(part: int, segment: int, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    symbols, freqs = rans.table(ids)
    coder = rans.Coder(symbols, freqs)
    blocks = [coder.encode(ids[a : a + rans.BLOCK]) for a in range(0, len(ids), rans.BLOCK)]
    cols = [
        [part],
        [segment],
        *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (id_array(doc_ids), pa.array(lengths, pa.int64()))),
        [symbols.astype("<u4").tobytes()],
        [freqs.astype("<u4").tobytes()],
        [blocks],
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Encode every text and write the dataset at ``path``."""
    n = max(1, docs.rdd.getNumPartitions())
    ordered = text_of(docs, "doc_id").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, segment = TaskContext.get().partitionId(), 0
        enc = encoder(vocabulary)
        held: list[tuple] = []
        size = 0
        for b in batches:
            text, doc = b.column("text"), ids_of(b.column("doc_id"))
            for lo, hi in slices(text, _PIECE):
                ids, off = enc.encode(text.slice(lo, hi - lo), end_id)
                held.append((doc[lo:hi], np.diff(off), ids))
                size += len(ids)
                if size >= SEGMENT:
                    yield segment_row(part, segment, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size, segment = [], 0, segment + 1
        if held:
            yield segment_row(part, segment, *(np.concatenate(x) for x in zip(*held, strict=True)))
        held = []
        trim()

    ordered.mapInArrow(run, _DDL).write.option("compression", "uncompressed").parquet(path)


def decoded(row: dict) -> np.ndarray:
    coder = rans.Coder(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["freqs"], "<u4"))
    return np.concatenate([coder.decode(b) for b in row["blocks"]] or [np.zeros(0, np.uint32)])


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document, decoded from the files."""
    rows = spark.read.schema(_DDL).parquet(path)
    # one row for each segment
    totals = rows.select("part", "segment", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n"))
    before = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                # one segment at a time
                own, ids = b.column("doc_ids").slice(k, 1).flatten(), decoded(b.select(["symbols", "freqs", "blocks"]).slice(k, 1).to_pylist()[0])
                length = b.column("lengths").slice(k, 1).flatten().to_numpy()
                stop = np.cumsum(length)
                start = stop - length
                cols = [
                    *(pa.repeat(b.column(c)[k], len(length)) for c in ("part", "segment")),
                    own,
                    pa.array(start),
                    pa.array(length),
                    pa.array([crc(ids[x:y]) for x, y in zip(start.tolist(), stop.tolist(), strict=True)], pa.int64()),
                ]
                names = ["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(start, stop[-1:]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    ddl = "part int, segment int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    out = rows.mapInArrow(run, ddl).join(totals, ["part", "segment"])
    return out.select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
