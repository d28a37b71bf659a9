"""Deterministic URL filtering: one reason per URL, copies counted, product sample re-admitted.

Copies of one address are merged by a partial aggregate on (site, normalised URL) before the
shuffle, so an address that makes up a third of all rows costs one row per input partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitelore.functions import urls as U, vocab as V
from sitelore.functions.scale import first_per_group, reused


def classify_urls(candidates: DataFrame) -> DataFrame:
    """One row per distinct (site, URL): first position, number of copies, reason."""
    norm = F.when(F.col("url") != "", F.expr(U.normalize("url")))
    merged = candidates.select("site", "pos", norm.alias("norm")).groupBy("site", "norm").agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("copies")
    )
    return merged.select(
        "site", F.col("norm").alias("url"), "pos", "copies",
        F.expr(U.drop_reason("site", "norm")).alias("reason"),
    )


def product_sample(candidates: DataFrame, limit: int = V.PRODUCT_SAMPLE) -> DataFrame:
    """First product addresses per site."""
    return _first_products(classify_urls(candidates), limit)


def _first_products(classified: DataFrame, limit: int) -> DataFrame:
    products = classified.filter("reason = 'product'").select("site", "url", "pos")
    return first_per_group(products, ["site"], [F.col("pos"), F.col("url")], limit)


def prefilter_urls(candidates: DataFrame, keep_products: int = V.PRODUCT_SAMPLE) -> DataFrame:
    """Kept addresses in order (tail, pos): the product sample comes after all others.

    Candidates are read and classified once; the reason depends on the grouping keys only, so the
    filter reaches the rows before the shuffle and no dropped address is ever moved.
    """
    rows = reused(classify_urls(candidates).filter("reason IN ('kept', 'product')"))
    kept = rows.filter("reason = 'kept'").select("site", "url", "pos", F.lit(0).cast("bigint").alias("tail"))
    return kept.unionByName(_first_products(rows, keep_products).select(
        "site", "url", "pos", F.lit(1).cast("bigint").alias("tail")
    ))


def dropped_by_reason(candidates: DataFrame, keep_products: int = V.PRODUCT_SAMPLE) -> DataFrame:
    """Rows dropped per (site, reason); the re-admitted product sample is not counted."""
    valid = F.col("reason") != "invalid"
    parts = F.array(
        F.struct(
            F.col("reason").alias("reason"),
            F.when(valid, F.lit(1).cast("bigint")).otherwise(F.col("copies")).alias("n"),
        ),
        F.struct(F.lit("duplicate").alias("reason"), F.when(valid, F.col("copies") - 1).alias("n")),
    )
    counted = (
        classify_urls(candidates)
        .select("site", F.inline(parts))
        .filter("reason <> 'kept' AND n > 0")
        .groupBy("site", "reason")
        .agg(F.sum("n").alias("n"))
    )
    less = F.when(F.col("reason") == "product", keep_products).otherwise(0)
    return counted.withColumn("n", F.col("n") - less).filter("n > 0")


def dropped_totals(candidates: DataFrame, keep_products: int = V.PRODUCT_SAMPLE) -> DataFrame:
    """``dropped_by_reason`` with a total per site and per all sites, from one aggregate.

    ``level`` is 0 for a reason of a site, 1 for a site (``reason`` is null) and 3 for all sites (both are).
    """
    rows = dropped_by_reason(candidates, keep_products)
    return rows.rollup("site", "reason").agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level"))
