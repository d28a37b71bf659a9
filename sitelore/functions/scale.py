"""Helpers that keep jobs whole and even on a large cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SALTS = 16


def salted_join(
    rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join many rows per key with at most one row per key, without a hot task.

    The rows of a key are spread over ``salts`` sub-keys by a hash of their other columns and the
    single row of the key is copied to each sub-key.  If the copied side is small at run time,
    adaptive execution turns this into a broadcast join by its measured size.
    """
    rest = [c for c in rows.columns if c not in keys]
    if not rest:  # nothing but keys: distinct rows are one per key already
        return rows.join(per_key, keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def first_per_group(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank"
) -> DataFrame:
    """First ``limit`` rows per group with their rank.

    ``row_number() <= limit`` is cut per input partition before the shuffle (window group limit),
    so one group may hold most rows and its task still sees ``limit`` rows per input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)
    return ranked.withColumn(rank, F.col(rank).cast("bigint"))


def first_many_per_group(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """As ``first_per_group`` for limits above the window-group-limit threshold.

    A first pass ranks salted sub-groups, so a hot group is split; the second pass ranks at most
    ``salts * limit`` rows per group.
    """
    rest = [c for c in df.columns if c not in keys]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    sub = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = salted.withColumn("_sub", F.row_number().over(sub)).filter(F.col("_sub") <= limit)
    return first_per_group(cut.drop("_salt", "_sub"), keys, order, limit, rank)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only where local runs set none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def new_shared_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def project_wanted(pages: DataFrame, wanted: DataFrame, key: str, project) -> DataFrame:
    """Wide rows named by a narrow table: joined first, so only the named rows are projected.

    One plan for every size.  Spark broadcasts the narrow side where its bytes allow it; beyond
    that, wide rows stay where they are if their table is bucketed by ``key``.
    """
    return project(pages.join(wanted, key))


def reused(df: DataFrame) -> DataFrame:
    """Keep a result that several branches read; lost blocks are recomputed from lineage."""
    return df if df.is_cached else df.persist(StorageLevel.MEMORY_AND_DISK)


def measured(df: DataFrame) -> DataFrame:
    """A narrow result computed now, of known size and with a short plan, for plans that are made after this.

    Beside a table of unknown size a join deals out both of its sides before it can see that one is small; the
    size of the kept rows goes along with their checkpoint.  A plan over kept tables shows the plan of each
    one wherever it is read, so plans that read this one several times would grow by its whole history each time.
    """
    kept = reused(df)
    kept.count()
    out = checkpointed(kept.select("*"))
    kept.unpersist()
    return out
