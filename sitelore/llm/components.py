"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitelore.functions.scale import salted_join
from sitelore.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of the links ``u``, ``v``.

    Large-star and small-star rounds: each node hands its neighbours to its smallest one, until all
    links point at the smallest node of their component.  A round's links are written to the shared
    folder.  A node with very many links is met by a partial minimum and a salted join.  Null ends,
    loops and repeated links count for nothing; no links give no rows.
    """
    links = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u is not null and v is not null and u > v and least(u, v) = v").distinct(),
        "links",
    )
    while not _stars(links):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, ["u"]).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    odd = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return odd.filter("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0
