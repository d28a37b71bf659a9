"""Token ids as files: Simple-8b words in ascending order of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sitelore.llm import simple8b
from sitelore.llm.common import small_batches
from sitelore.llm.tokens import coder

VOCABULARY, END_ID = "word_bpe_49k.json", 2

#: A row of a file is a segment: some documents in order.  ``part`` and ``seq`` give the order of segments.
SEGMENTS = (
    "part int, seq bigint, n_ids bigint, doc_ids array<{id}>, lengths array<bigint>, "
    "block_ends array<bigint>, raw array<bigint>, words binary"
)


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int | None = END_ID,
    id_col: str = "doc_id", text: str = "text",
) -> None:
    """Encode all texts and write the ids below ``path`` in ascending order of ids (null first).

    The texts are shuffled once into ranges of ids; each task sorts its range, encodes it and writes
    segments of some hundred documents.  A segment's words are Simple-8b with the end of every block,
    in a Parquet row, so Spark's writer commits whole files only and lost tasks leave nothing behind.

    Null and empty texts hold the end id alone.  Rows that repeat an id stand side by side, ordered by
    text.  Other columns are not read.  An empty table gives an empty folder of files.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq = coder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, ids, bounds in code.ids_of(batch.column(1), end_id):
                words, ends, raw = simple8b.encode(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()),
                     pa.ListArray.from_arrays([0, j - i], batch.column(0).slice(i, j - i)),
                     *(pa.array([x.astype(np.int64)]) for x in (np.diff(bounds), ends, raw)),
                     pa.array([words.astype("<u8").tobytes()], pa.binary())],
                    ["part", "seq", "n_ids", "doc_ids", "lengths", "block_ends", "raw", "words"],
                )
                seq += 1

    kind = docs.schema[id_col].dataType.simpleString()
    ordered = (
        docs.select(docs[id_col].alias("doc_id"), docs[text].alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(run, SEGMENTS.format(id=kind)).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files.

    ``start`` counts the ids of all documents before: those of earlier parts and segments come from the
    narrow columns alone, those of the segment from its lengths.
    """
    small_batches(spark, 16)
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, n = (batch.column(k)[row].as_py() for k in range(3))
                ids, lengths, ends, raw = (batch.column(k)[row].values for k in range(3, 7))
                words = np.frombuffer(batch.column(7)[row].as_buffer(), "<u8")
                tokens = simple8b.decode(words, ends.to_numpy(), raw.to_numpy(), n)
                data = memoryview(tokens.astype("<u4")).cast("B")
                size = lengths.to_numpy()
                last = np.cumsum(size)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((last - size).tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(size), part, np.int32)), pa.array(np.full(len(size), seq, np.int64)),
                     ids, pa.array(last - size), pa.array(size), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "_in", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(
        run, f"part int, seq bigint, doc_id {kind}, _in bigint, n_tokens bigint, ids_crc32 bigint"
    )
    segments = files.select("part", "seq", "n_ids")
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("_part"))  # a row per task that wrote
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_part"))
    bases = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_seq"))
    bases = bases.join(parts, "part").select("part", "seq", (F.col("_part") + F.col("_seq")).alias("_base"))
    return rows.join(bases, ["part", "seq"]).select(
        "doc_id", (F.col("_base") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32"
    )
