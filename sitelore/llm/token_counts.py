"""Token counts without the ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitelore.llm.common import small_batches, text_buffers
from sitelore.llm.tokens import coder

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024


def count_tokens(
    docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; no shuffle.

    Arrow functions encode batches of about equal bytes and return lengths only.  Texts of any length
    are cut at safe places, so memory is bounded by the batch.  Null and empty texts have 0 bytes and
    0 tokens.  A null id stays null, repeated rows are counted each, other columns are not read, and an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            n = code.counts_of(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
