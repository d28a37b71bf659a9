"""Tiers, categories, keyword clusters and the budgeted page selection.

Every per-site decision is taken on a set whose size per site is fixed by a limit, reached with
window group limits; per-site totals come from partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitelore.functions import urls as U, vocab as V
from sitelore.functions.let import contains_any
from sitelore.functions.scale import first_per_group, reused


def _cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def knowledge_tier(kept: DataFrame) -> DataFrame:
    """Tier of every kept address."""
    return kept.select("site", "url", "pos", "tail").withColumn("tier", F.expr(U.knowledge_tier("url")))


def tier_quota_sample(
    kept: DataFrame, threshold: int = V.TIER_THRESHOLD, high_limit: int = V.TIER_HIGH_LIMIT
) -> DataFrame:
    """At most ``threshold`` addresses per site with their rank, to fit a prompt.

    A sampling operator of its own; the page selection does not go through it.  Small sites keep every address.  Large ones take the first high ones, then up to half of the
    free places from medium, then low; medium and low are drawn in md5 order, the same on every
    cluster.
    """
    kept = reused(kept)  # read by the pools and by the counts
    # Each row enters two pools, the whole list and its tier; one window cuts every pool to a
    # fixed size per site before the shuffle.
    ordered = F.col("pool").isin("all", "high")
    pools = first_per_group(
        kept.select(
            "site", "url", "pos", "tail",
            F.explode(F.array(F.lit("all"), F.expr(U.knowledge_tier("url")))).alias("pool"),
        ).filter("pool <> 'skip'"),
        ["site", "pool"],
        [F.when(ordered, F.col("tail")), F.when(ordered, F.col("pos")),
         F.when(~ordered, F.md5("url")), F.col("url")],
        threshold,
    )
    counts = kept.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_urls"),
        *[
            F.count_if(F.expr(U.knowledge_tier("url")) == t).alias(f"n_{t}")
            for t in ("high", "medium", "low")
        ],
    )
    take_high = F.least("n_high", F.lit(high_limit))
    take_medium = F.least(F.floor((threshold - take_high) / 2), F.col("n_medium"))
    take_low = F.least(threshold - take_high - take_medium, F.col("n_low"))
    pool = F.col("pool")
    chosen = pools.join(counts, "site").filter(
        F.when(F.col("n_urls") <= threshold, pool == "all")
        .when(pool == "high", F.col("rank") <= take_high)
        .when(pool == "medium", F.col("rank") <= take_medium)
        .when(pool == "low", F.col("rank") <= take_low)
        .otherwise(F.lit(False))
    )
    before = (
        F.when(pool == "medium", take_high).when(pool == "low", take_high + take_medium).otherwise(0)
    )
    return chosen.select(
        "site", "url", "pos", "tail", pool.alias("tier"), (F.col("rank") + before).alias("rank")
    )


def url_category_sample(
    kept: DataFrame, threshold: int | None = None,
    priority_limit: int = V.CATEGORY_PRIORITY_LIMIT, total: int = V.CATEGORY_TOTAL,
) -> DataFrame:
    """All addresses; with a ``threshold``, sites above it keep a sample that fits a prompt.

    The sample is the first priority addresses, then regular ones in md5 order.
    """
    if threshold is None:
        return kept.select("site", "url", F.lit("all").alias("kind"))
    kept = reused(kept)
    first = F.expr(contains_any("lower(url)", V.CATEGORY_PRIORITY))
    skipped = F.expr(contains_any("lower(url)", V.CATEGORY_SKIP))
    kind = F.when(first, "priority").when(~skipped, "regular")
    ordered = F.col("kind").isin("all", "priority")
    pools = first_per_group(
        kept.select(
            "site", "url", "pos", "tail",
            F.explode(F.array_compact(F.array(F.lit("all"), kind))).alias("kind"),
        ),
        ["site", "kind"],
        [F.when(ordered, F.col("tail")), F.when(ordered, F.col("pos")),
         F.when(~ordered, F.md5("url")), F.col("url")],
        threshold,
    )
    counts = kept.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.count_if(first).alias("n_priority"),
    )
    take_priority = F.least("n_priority", F.lit(priority_limit))
    return (
        pools.join(counts, "site")
        .filter(
            F.when(F.col("n_urls") <= threshold, F.col("kind") == "all")
            .when(F.col("kind") == "priority", F.col("rank") <= take_priority)
            .when(F.col("kind") == "regular", F.col("rank") <= total - take_priority)
            .otherwise(F.lit(False))
        )
        .select("site", "url", "kind")
    )


def url_category(kept: DataFrame, classified: DataFrame, first_n: int | None = None) -> DataFrame:
    """(site, category, url): keyword categories of the kept addresses, the rest by drop reason.

    ``first_n`` limits the categories to the first addresses of each site; by default all are read.
    """
    rows = kept
    if first_n is not None:
        rows = first_per_group(kept.select("site", "url", "pos", "tail"), ["site"], _cols("tail", "pos", "url"), first_n)
    holds = lambda words: F.expr(contains_any("lower(url)", words))
    company, service = holds(V.CATEGORY_COMPANY), holds(V.CATEGORY_SERVICE)
    product = ~holds(V.CATEGORY_NOT_PRODUCT + V.CATEGORY_COMPANY + V.CATEGORY_SERVICE)
    named = F.array(
        F.when(company, F.lit("company_info_pages")), F.when(service, F.lit("service_pages")),
        F.when(product, F.lit("product_pages")),
    )
    by_word = rows.select("site", F.explode(F.array_compact(named)).alias("category"), "url")
    reasons = {"transactional": "technical_pages", "asset": "asset_pages",
               "archive": "other_pages", "faceted": "other_pages"}
    by_reason = classified.filter(F.col("reason").isin(*reasons)).select(
        "site",
        F.create_map(*[F.lit(x) for p in reasons.items() for x in p])[F.col("reason")].alias("category"),
        "url",
    )
    return by_word.unionByName(by_reason)


def cluster_assign(kept: DataFrame, limit: int | None = None) -> DataFrame:
    """(site, cluster, url, pos, tail): an address may be in several clusters.

    With a ``limit``, the first of each cluster in list order, with their rank.
    """
    tests = [f"CASE WHEN {contains_any('lower(url)', w)} THEN '{c}' END" for c, w in V.CLUSTER_WORDS.items()]
    labels = F.expr(f"array_compact(array({', '.join(tests)}))")
    rows = kept.select("site", F.explode(labels).alias("cluster"), "url", "pos", "tail")
    if limit is None:
        return rows
    return first_per_group(rows, ["site", "cluster"], _cols("tail", "pos", "url"), limit)


def cluster_counts(kept: DataFrame) -> DataFrame:
    """Addresses per (site, cluster), every cluster listed, and the total."""
    hits = {
        c: F.expr(f"count_if({contains_any('lower(url)', w)})") for c, w in V.CLUSTER_WORDS.items()
    }
    counts = kept.groupBy("site").agg(*[n.alias(c) for c, n in hits.items()])
    total = sum((F.col(c) for c in V.CLUSTER_WORDS), F.lit(0))
    shown = F.array(
        *[
            F.struct(
                F.lit(c).alias("cluster"),
                (F.col(c) if c in V.CLUSTER_WORDS else F.lit(0)).cast("bigint").alias("n"),
            )
            for c in V.CLUSTERS
        ]
    )
    return counts.select(
        "site", total.cast("bigint").alias("total_knowledge_pages"), F.inline(shown)
    )


def page_budget(requested: Column) -> Column:
    """Requested number of pages brought into range; none or 0 means the default."""
    asked = F.coalesce(F.nullif(requested, F.lit(0)), F.lit(V.PAGE_BUDGET_DEFAULT))
    return F.greatest(F.lit(1), F.least(asked, F.lit(V.PAGE_BUDGET_MAX))).cast("bigint")


def select_pages(
    bases: DataFrame, kept: DataFrame, budget: int = V.PAGE_BUDGET_DEFAULT
) -> DataFrame:
    """(site, rank, url, cluster, pos): start page, then clusters in pick order, then kept order.

    The kept list starts with the start page; every kept address of a site takes part.  No source
    can give more pages than the budget, so each is cut there before the shuffle (the list at
    twice the budget, as the others may repeat some of it), and the final window sees no more rows
    of a site than that.  A column ``budget`` in ``bases`` sets the budget of each site instead.
    """
    own = "budget" in bases.columns
    budget = V.PAGE_BUDGET_MAX if own else max(1, budget or V.PAGE_BUDGET_DEFAULT)
    home = bases.select("site", F.col("base_url").alias("url"), F.col("page_id").alias("pos"))
    front = F.lit(-1).cast("bigint")
    listed = (
        kept.select("site", "url", "pos", "tail")
        .unionByName(home.withColumn("pos", front).withColumn("tail", front))
        .groupBy("site", "url")
        # the start page keeps its own place when it is in the list, else it goes first
        .agg(
            F.coalesce(
                F.min(F.when(F.col("tail") >= 0, F.struct("tail", "pos"))),
                F.min(F.struct("tail", "pos")),
            ).alias("place")
        )
        .select("site", "url", "place.tail", "place.pos")
    )
    listed = reused(listed)  # read by the clusters and the backfill
    clusters = cluster_assign(listed, budget)
    pick = F.create_map(*[F.lit(x) for i, c in enumerate(V.CLUSTER_PICK_ORDER, 1) for x in (c, i)])
    backfill = first_per_group(listed, ["site"], _cols("tail", "pos", "url"), 2 * budget)
    picks = (
        home.select("site", "url", "pos", F.lit(V.START_CLUSTER).alias("cluster"),
                    F.lit(0).alias("source"), F.lit(0).cast("bigint").alias("ord"))
        .unionByName(clusters.select("site", "url", "pos", "cluster", pick[F.col("cluster")].alias("source"),
                                     F.col("rank").alias("ord")))
        .unionByName(backfill.select("site", "url", "pos", F.lit(V.START_CLUSTER).alias("cluster"),
                                     F.lit(9).alias("source"), F.col("rank").alias("ord")))
        .groupBy("site", "url")
        .agg(F.min(F.struct("source", "ord", "cluster", "pos")).alias("best"))
        .select("site", "url", "best.*")
    )
    chosen = first_per_group(picks, ["site"], _cols("source", "ord", "url"), budget).select(
        "site", "rank", "url", "cluster", "pos"
    )
    if not own:
        return chosen
    limits = bases.select("site", page_budget(F.col("budget")).alias("budget"))
    return chosen.join(limits, "site").filter("rank <= budget").drop("budget")


def pages_by_cluster(selected: DataFrame) -> DataFrame:
    return selected.groupBy("site", "cluster").agg(F.count(F.lit(1)).alias("n"))
