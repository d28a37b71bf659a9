"""Exact de-duplication: 128-bit content hash, the best row of each group stays, bytes decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: White space that does not count when texts are compared.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", content_hash=F.md5) -> DataFrame:
    """One row per input row: the row that stays for its text, the size of its group, and the hash.

    Rows are grouped by a 128-bit hash of the normalised text and, inside, by the bytes themselves, so
    a collision of the hash never joins two texts.  Copies meet in a partial aggregate: each task sends
    one row per text it holds.  Each row then finds its class by the two hashes of the text; the text
    is not sent again.  Of equal texts the longest original stays, then the smallest id (null last).

    Null and empty texts, and those of white space only, are one group.  Rows that repeat an id and a
    text share their fate.  Other columns are not read, whatever their names.  An empty table gives
    no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("_n"),
        normalised(text).alias("_norm"),
    ).select("doc_id", "_n", "_norm", content_hash("_norm").alias("_key"), F.sha2("_norm", 256).alias("text_sha256"))
    best = F.min(F.struct(-F.col("_n"), F.col("doc_id").isNull(), F.col("doc_id")))
    classes = (
        rows.groupBy("_key", "text_sha256", "_norm")
        .agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
        .select("_key", "text_sha256", F.col("_best.doc_id").alias("keep_id"), "group_size")
    )
    return (
        rows.select("doc_id", "_key", "text_sha256")
        .join(classes, ["_key", "text_sha256"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that ``mark_copies`` keeps, with their own columns; of wholly repeated rows one stays.

    Rows are found again by id and text hash, null safe, so neither null nor repeated ids lose a text.
    """
    norm = normalised(text)
    marks = mark_copies(docs, id_col, text).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")
    ).distinct()
    tagged = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.sha2(norm, 256).alias("_sha"),
        F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("_n"),
    )
    kept = tagged.alias("t").join(
        marks.alias("m"), F.col("t._id").eqNullSafe(F.col("m._id")) & (F.col("t._sha") == F.col("m._sha")), "left_semi"
    )
    one = kept.groupBy("_id", "_sha").agg(F.max_by("_row", "_n").alias("_row"))
    return one.select("_row.*")
