"""Packing of documents into sequences of a fixed length: first fit decreasing in random groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitelore.llm.common import small_batches
from sitelore.llm.tokens import coder

VOCABULARY, LENGTH, END_ID = "byte_bpe_50k.json", 2048, 1
#: Rows of documents in a group, on average.
GROUP_ROWS = 2048

PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class BinTree:
    """Tournament tree over the free room of bins; the leftmost bin with enough room wins."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Bin for an item and the room left in it afterwards."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        number, left = node - self.leaves, room[node]
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return number, left


def first_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; the sizes must be in descending order and at most ``length``."""
    tree = BinTree(len(sizes), length)
    placed = [tree.place(int(s)) for s in sizes]
    bins = np.array([b for b, _ in placed], np.int64)
    left = np.array([r for _, r in placed], np.int64)
    return bins, length - left - np.asarray(sizes, np.int64)


def cut(docs: DataFrame, vocabulary: str, length: int, end_id: int, id_col: str, text: str) -> DataFrame:
    """Pieces of at most ``length`` ids: whole ones from the start of a document, then the rest."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary)
        for batch in batches:
            for i, _, ids, bounds in code.ids_of(batch.column(1), end_id):
                data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                total = np.diff(bounds)
                per = -(-total // length)
                row = np.repeat(np.arange(len(total)), per)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * length
                size = np.minimum(length, total[row] - start)
                at = bounds[row] + start
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + i)), *map(pa.array, (start, size)),
                     pa.array(crc, pa.int64()), pa.array(total[row])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECES}")


def pack(
    docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end_id: int = END_ID,
    group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Where each piece of each document lies: doc_id, start, length, crc, doc_tokens, sequence, offset.

    Documents are tokenised where they are read and cut into pieces; only the narrow piece rows are
    shuffled.  Pieces are dealt by a hash into groups of about ``group_rows`` documents, or of as many bytes as
    ``group_rows`` sequences have ids where documents are long, and each group is packed by itself: the longest
    piece first, into the first sequence with room, found by a tournament tree.  A group wastes little more than its last sequence.  The hash
    takes in the start, so a very long document is spread over groups as well.

    Null and empty texts are the end id alone.  Null ids, repeated ids and repeated rows are packed like
    any others, row by row.  Other columns are not read.  An empty table gives no rows.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(docs[text])), F.lit(0)).alias("b")).first()
    groups = max(1, -(-size["n"] // group_rows), -(-size["b"] // (group_rows * length)))
    pieces = cut(docs, vocabulary, length, end_id, id_col, text).withColumn(
        "_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups))
    )

    def place(items: pa.Table) -> pa.Table:
        items = items.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offset = first_fit_decreasing(items.column("length").to_numpy(), length)
        first = items.column("_group").to_numpy() << np.int64(32)
        return items.drop_columns(["_group"]).append_column("sequence_id", pa.array(first + bins)).append_column(
            "offset", pa.array(offset)
        )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.groupBy("_group").applyInArrow(
        place, f"doc_id {kind}, {PIECES}, sequence_id bigint, offset bigint"
    )
