"""What the operators share: tables, shared folders, Arrow batches, numpy hashing, split joins."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows handed to Python at once; long texts make a batch large, so it is far below Spark's default.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_sitelore_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "sitelore_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._sitelore_shipped = True


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch for texts; called before any Python function is used."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without it gets a temporary one."""
    from sitelore.functions.scale import shared_dir as shared

    return shared(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: its cleaner waits for a collection."""
    for pause in (0.3, 0.3):  # what the first collection finds, the second one gives to the cleaner
        time.sleep(pause)
        spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def byte_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges with about ``most`` bytes each; a longer row makes a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser; a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keys64(n: int, seed: int) -> np.ndarray:
    """The first ``n`` of an endless list of odd 64-bit keys."""
    k = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(k) | np.uint64(1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
    return out


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start; with the length of the array at the end."""
    n = len(sorted_keys)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [n]))


def find(parent: np.ndarray, x: int) -> int:
    """Root of ``x`` with path halving."""
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = int(parent[x])
    return x


def skew_join(rows: DataFrame, per_key: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join many rows per key with a narrow table of one row per key.

    The narrow side is written first: its size is then known, so Spark broadcasts it where its bytes
    allow, and both sides are shuffled right below the join, so adaptive execution splits a hot key.
    """
    return rows.join(written(per_key, "keys"), on, how)


def in_blocks(members: DataFrame, key: list[str], size: int, by: str) -> DataFrame:
    """Deal the members of each key into blocks of about ``size`` and name the pairs of blocks.

    Any two members of a key meet in at least one (key, block_i, block_j); a member of a key with k
    blocks is copied k times.  Members carry ``side`` = 0 (block_i), 1 (block_j) or 2 (both).
    """
    counts = members.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    sized = counts.select(*key, F.ceil(F.col("_n") / size).cast("int").alias("_k"))
    dealt = skew_join(members, sized, key).withColumn(
        "_b", F.pmod(F.xxhash64(F.col(by), F.lit(7)), F.col("_k")).cast("int")
    )
    other = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return other.select(
        *members.columns,
        F.least("_b", "_o").alias("block_i"),
        F.greatest("_b", "_o").alias("block_j"),
        F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
        .cast("int").alias("side"),
    )


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables with all rows of some groups, from batches of a partition sorted by its keys.

    A table holds whole groups only; it may hold many of them, about one batch at a time.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = 0
        same = np.ones(batch.num_rows - 1, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            same &= v[1:] == v[:-1]
        edges = np.flatnonzero(~same)
        if held:
            last = held[-1]
            if any(last.column(k)[last.num_rows - 1] != batch.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
        if len(edges):
            cut = int(edges[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
