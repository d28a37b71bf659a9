"""Running sums over groups of any size: rows in sorted ranges, sums inside a range, totals of the ranges before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitelore.functions.scale import checkpointed

RANGE = "_range"


def in_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with the number of their range in the order of keys and ``order``.

    A group with most of the rows is spread over many ranges.  Where a row lies is fixed by a
    checkpoint: the bounds are drawn from a sample and would change if they were drawn again.  ``order`` must tell the
    rows of a group apart, or rows that are equal in it stand in any order inside one range.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id())
    return checkpointed(ranged)


def running(ranged: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """The rows of ``in_ranges`` with sums over the rows of their group up to and with them.

    A window sees one range of a group; the window over totals sees one row per range.
    """
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    names = {name: f"_before_{name}" for name in sums}
    totals = ranged.groupBy(*keys, RANGE).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).select(
        *keys, RANGE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(b) for n, b in names.items()]
    )
    summed = ranged.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    joined = summed.join(totals, [*keys, RANGE])
    keep = [c for c in summed.columns if c not in sums]
    return joined.select(*keep, *[(F.col(n) + F.col(b)).alias(n) for n, b in names.items()])
