"""Live job states from a stream of job events: changes by batch, snapshots, states that retire."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitelore.operators.runs import localise_progress
from sitelore.streaming.page_stream import use_rocksdb

#: How late an event may come, and for how long a job without events is kept as state.
LATENESS, IDLE_SECONDS = "1 hour", 6 * 3600
#: Batches of changes that are folded into one snapshot.
COMPACT_EVERY = 10

STATE = "ts bigint, last_event bigint, status string, progress string, total bigint, done bigint, max_event bigint"
CHANGES = (
    "job_id bigint, ts bigint, last_event bigint, status string, progress string, total bigint, done bigint, "
    "max_event bigint, retired boolean"
)


def latest_states(events: DataFrame) -> DataFrame:
    """Latest status and the progress counter ``n/total`` per job, from a batch of all events."""
    at = F.struct("ts", "event_id")
    state = events.groupBy("job_id").agg(
        F.max_by(F.struct("status", "progress", "total"), at).alias("last"),
        F.max("done").alias("done"), F.max("event_id").alias("last_event"),
    )
    return state.select("job_id", "last_event", *_shown("last.status", "last.progress", "last.total"))


def _shown(status: str, progress: str, total: str) -> list:
    return [
        F.col(status).alias("status"), F.expr(localise_progress(progress)).alias("progress_fa"),
        F.concat_ws("/", F.col("done").cast("string"), F.col(total).cast("string")).alias("counter"),
    ]


#: Column labels of the rows that ``_fold`` gives, made once.
COLUMNS = pd.Index([f.split()[0] for f in CHANGES.split(", ")])


def _row(*values) -> pd.DataFrame:
    """One row of ``CHANGES``; all columns are objects of one block, which is quick to make and to join to others."""
    block = np.empty((1, len(values)), dtype=object)
    block[0] = values
    return pd.DataFrame(block, columns=COLUMNS)


def _fold(idle_seconds: int):
    """State of one job over batches; its rows come in frames, so a job with very many events is no matter.

    Most jobs have few events in a batch, so the time goes into calls for a job and not into its rows: the last
    row is found by its place, without a sorted copy of the frame.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = lambda v: None if v is None or v is pd.NaT or v != v else v
        if state.hasTimedOut:
            yield _row(key[0], *state.get, True)
            state.remove()
            return
        now = list(state.get) if state.exists else [None] * 7
        for frame in frames:
            ts, ids = frame["ts_us"], frame["event_id"]
            last = np.lexsort((ids, ts))[-1]  # by time, then number; the later one of equal rows
            at = (int(ts.iat[last]), int(ids.iat[last]))
            done, most = none(frame["done"].max()), int(ids.max())
            done = None if done is None else int(done)
            if now[0] is None or at > (now[0], now[1]):
                total = none(frame["total"].iat[last])
                status, progress = none(frame["status"].iat[last]), none(frame["progress"].iat[last])
                now[:5] = [*at, status, progress, None if total is None else int(total)]
            now[5] = done if now[5] is None else now[5] if done is None else max(now[5], done)
            now[6] = most if now[6] is None else max(now[6], most)
        state.update(tuple(now))
        state.setTimeoutTimestamp(max(now[0] // 1000, state.getCurrentWatermarkMs()) + idle_seconds * 1000)
        yield _row(key[0], *now, False)

    return run


def changes(events: DataFrame, lateness: str = LATENESS, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Rows of ``CHANGES`` for each job that a batch touches or that retires.

    Events older than the watermark of ``ts`` change nothing; ``late_events`` counts them.  A job without
    events for ``idle_seconds`` of event time leaves the state with a last row (``retired``).  A job that goes on
    after that starts a new state; the snapshot keeps what it had.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).select(
        "job_id", "ts", F.unix_micros("ts").alias("ts_us"), "event_id",
        "status", "progress", F.col("total").cast("bigint").alias("total"), F.col("done").cast("bigint").alias("done"),
    )
    return rows.groupBy("job_id").applyInPandasWithState(
        _fold(idle_seconds), CHANGES, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def merged(parts: DataFrame) -> DataFrame:
    """One row of ``CHANGES`` per job from snapshots and changes: the newest state, the highest counters."""
    last = F.max_by(F.struct("ts", "last_event", "status", "progress", "total"), F.when(F.col("ts").isNotNull(), F.struct("ts", "last_event")))
    return parts.groupBy("job_id").agg(
        last.alias("s"), F.max("done").alias("done"), F.max("max_event").alias("max_event"),
        F.max_by("retired", F.struct("ts", "last_event", "retired")).alias("retired"),
    ).select("job_id", "s.*", "done", "max_event", "retired").select([f.split()[0] for f in CHANGES.split(", ")])


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished ``n=…`` folders below a path; one listing, no file is opened."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = store.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/n=*/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getName()[2:]) for s in done)


def _since(spark: SparkSession, out: str, before: int | None = None) -> tuple[list[str], int]:
    """Newest snapshot (of batches up to its number) below ``before``, and the changes after it; last number."""
    below = lambda numbers: [n for n in numbers if before is None or n < before]
    snaps = below(_folders(spark, f"{out}/snapshots"))
    first = snaps[-1] if snaps else -1
    newer = [n for n in below(_folders(spark, f"{out}/changes")) if n > first]
    return [f"{out}/snapshots/n={n}" for n in snaps[-1:]] + [f"{out}/changes/n={n}" for n in newer], first


def start(
    events: DataFrame, out: str, checkpoint: str, lateness: str = LATENESS, idle_seconds: int = IDLE_SECONDS,
    compact_every: int = COMPACT_EVERY, **trigger
) -> StreamingQuery:
    """Write each batch's changes below ``out``, and after every few batches a snapshot of all jobs.

    Folders carry the number of their batch.  A snapshot is made of the one before and the changes
    since, so a batch that runs again writes the same rows to the same folders.
    """
    use_rocksdb(events.sparkSession)

    def save(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        changed.write.mode("overwrite").parquet(f"{out}/changes/n={batch}")
        if batch % compact_every == compact_every - 1:
            parts, _ = _since(spark, out, batch)
            rows = spark.read.schema(CHANGES).parquet(*parts, f"{out}/changes/n={batch}")
            merged(rows).write.mode("overwrite").parquet(f"{out}/snapshots/n={batch}")

    writer = changes(events, lateness, idle_seconds).writeStream.outputMode("update").foreachBatch(save)
    return writer.option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


def late_events(query: StreamingQuery) -> int:
    """Events of the batches in the query's recent progress that came after the watermark had passed them."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def folders_of_current(spark: SparkSession, out: str) -> list[str]:
    """What ``current`` reads: one snapshot and the fewer than ``compact_every`` batches after it."""
    return _since(spark, out)[0]


def jobs(spark: SparkSession, out: str) -> DataFrame:
    """One row of ``CHANGES`` per job, retired ones too."""
    paths = folders_of_current(spark, out)
    return merged(spark.read.schema(CHANGES).parquet(*paths)) if paths else spark.createDataFrame([], CHANGES)


def current(spark: SparkSession, out: str) -> DataFrame:
    """Current state of each job, as far as the stream has come."""
    return jobs(spark, out).filter("ts is not null").select("job_id", *_shown("status", "progress", "total"))
