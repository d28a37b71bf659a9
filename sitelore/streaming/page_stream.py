"""Incremental intake of crawled pages: each version of an address once, cleaned, with its contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelore.functions import contacts as C, text as T, urls as U

PAGE_SCHEMA = "page_id bigint, url string, html string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a version of a page is remembered after it was first seen.
REMEMBERED = "7 days"


def use_rocksdb(session: SparkSession) -> None:
    """Keep states on disk, unless the session names a store of that kind already."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (session.conf.get(provider, None) or ""):
        session.conf.set(provider, ROCKSDB)


def table_files(path: str) -> str:
    """A pattern for the one path of a table, which may be a file or a folder of files.

    A stream takes a plain path for a folder, and a filter on names sees the files inside a folder, not the folder.
    """
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def read_pages(spark: SparkSession, folder: str, name_filter: str | None = "*.parquet") -> DataFrame:
    """Stream of page files that arrive in a folder; ``seen_at`` is when the file was written."""
    source = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", 1000)
    if name_filter is not None:
        source = source.option("pathGlobFilter", name_filter)
    return source.parquet(folder).select("*", F.col("_metadata.file_modification_time").alias("seen_at"))


def page_facts(pages: DataFrame, *more: str) -> DataFrame:
    """Row-local facts of pages (page_id, url, html); also usable on a batch table."""
    return pages.select(
        "page_id", F.expr(U.netloc("url")).alias("site"), F.expr(U.normalize("url")).alias("url"),
        F.expr(T.page_title("html")).alias("title"), F.expr(T.main_content("html")).alias("chunk"), *more,
    ).select(
        "page_id", "site", "url", "title", "chunk",
        F.array_join(F.array_sort(F.expr(C.emails("chunk"))), ", ").alias("emails"),
        F.array_join(F.array_sort(F.expr(C.phones("chunk"))), ", ").alias("phones"), *more,
    )


def start(
    pages: DataFrame, out: str, checkpoint: str, remembered: str = REMEMBERED, **trigger
) -> StreamingQuery:
    """Append the facts of page versions not seen before to ``out``.

    A version is an address and the hash of its HTML: a page that changed comes out again, the same page
    doesn't.  Facts and hash are taken where pages are read, so no HTML is shuffled.  Spark keeps a
    version in its state store from when it is first seen until the watermark of ``seen_at`` is ``remembered``
    past it, so the state is bounded by the versions of that time and not by those of the whole crawl.
    A page that comes later than that is dropped as late; an equal one after that time comes out anew.
    A batch reads no earlier output, and the file sink commits each batch exactly once.
    """
    use_rocksdb(pages.sparkSession)
    hashed = pages.withColumn("content_hash", F.md5(F.coalesce("html", F.lit(""))))
    facts = page_facts(hashed, "content_hash", "seen_at")
    fresh = facts.withWatermark("seen_at", remembered).dropDuplicatesWithinWatermark(["url", "content_hash"])
    writer = fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
