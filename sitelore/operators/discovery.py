"""Finding pages: sitemaps to a fixpoint, crawl reach over stored links, core and given pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sitelore.functions import urls as U, vocab as V
from sitelore.functions.scale import (
    checkpointed, first_many_per_group, first_per_group, reused, salted_join,
)
from sitelore.sources.tables import fetched


def reachable(
    start: DataFrame, edges: DataFrame, max_depth: int | None = None, full: Callable | None = None
) -> DataFrame:
    """(site, url, depth) reached from ``start`` (site, url) over ``edges`` (site, src_url, dst_url).

    ``full`` names the sites, given all that was reached, whose search is over.  One join per level.  Each level is checkpointed, so the plan stays short and a lost executor
    costs one level at most.  A page with very many links is spread by the salted join; targets
    are made distinct by a partial aggregate before they are compared with what was seen.
    """
    edges = reused(edges.select("site", "src_url", "dst_url").distinct())
    level = checkpointed(
        start.select("site", "url").distinct().withColumn("depth", F.lit(0).cast("bigint"))
    )
    seen, depth = level, 0
    while (max_depth is None or depth < max_depth) and not level.isEmpty():
        depth += 1
        found = salted_join(
            edges, level.select("site", F.col("url").alias("src_url")), ["site", "src_url"]
        ).select("site", F.col("dst_url").alias("url")).distinct()
        level = checkpointed(
            found.join(seen.select("site", "url"), ["site", "url"], "left_anti")
            .withColumn("depth", F.lit(depth).cast("bigint"))
        )
        seen = seen.unionByName(level)
        if full is not None:
            level = checkpointed(level.join(full(seen), "site", "left_anti"))
    edges.unpersist()
    return seen


def sitemap_expand(start: DataFrame, locs: DataFrame) -> DataFrame:
    """Page addresses (site, url) of all sitemaps reached from ``start`` (site, sitemap_url).

    Only the short sitemap-to-sitemap edges take part in the iteration.
    """
    locs = reused(locs)
    nested = F.col("loc").endswith(".xml")
    edges = locs.filter(nested).select(
        "site", F.col("sitemap_url").alias("src_url"), F.col("loc").alias("dst_url")
    )
    files = reachable(start.select("site", F.col("sitemap_url").alias("url")), edges)
    return salted_join(
        locs.filter(~nested), files.select("site", F.col("url").alias("sitemap_url")),
        ["site", "sitemap_url"],
    ).select("site", F.col("loc").alias("url")).distinct()


def crawl_reach(
    bases: DataFrame, links: DataFrame, pages: DataFrame, max_pages: int, max_depth: int | None = None
) -> DataFrame:
    """(site, rank, url, depth): first HTML pages per site by (depth, url) over same-site links.

    A site is left as soon as it has its pages, after the whole level that brought the last one.
    """
    start = bases.select("site", F.col("base_url").alias("url"))
    same = links.filter(F.expr(U.netloc("dst_url")) == F.col("site"))
    html_pages = reused(fetched(pages).select("site", F.expr(U.normalize("url")).alias("url")).distinct())
    full = lambda seen: seen.join(html_pages, ["site", "url"]).groupBy("site").agg(
        F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= max_pages).select("site")
    seen = reachable(start, same, max_depth, full)
    found = seen.join(html_pages, ["site", "url"])
    return first_per_group(found, ["site"], [F.col("depth"), F.col("url")], max_pages).select(
        "site", "rank", "url", "depth"
    )


def _stage_counts(bases: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    counts = sitemap_urls.groupBy("site").agg(F.count(F.lit(1)).alias("sitemap_urls"))
    return bases.join(counts, "site", "left").withColumn(
        "sitemap_urls", F.coalesce("sitemap_urls", F.lit(0)).cast("bigint")
    )


def _needs_crawl(n: Column) -> Column:
    return n < V.CRAWL_FALLBACK_BELOW


def discover_candidates(
    bases: DataFrame, sitemap_urls: DataFrame, crawled: DataFrame, cap: int | None = None
) -> DataFrame:
    """(site, source, ord, url[, pos]): start page, sitemap addresses, and the crawl where those are few.

    The list of a site is ordered by source (0 start, 1 sitemap, 2 crawl), ``ord`` and url.  With a
    ``cap`` (``vocab.DISCOVERY_CAP``) only its first addresses stay, with their place ``pos``.
    """
    stage = _stage_counts(bases, sitemap_urls)
    few = stage.filter(_needs_crawl(F.col("sitemap_urls"))).select("site")
    first = bases.select(
        "site", F.col("base_url").alias("url"), F.lit(0).alias("source"), F.lit(0).cast("bigint").alias("ord")
    )
    listed = sitemap_urls.select("site", "url", F.lit(1).alias("source"), F.lit(0).cast("bigint").alias("ord"))
    # the crawl holds at most the fallback limit per site
    walked = crawled.join(few, "site", "left_semi").select(
        "site", "url", F.lit(2).alias("source"), F.col("rank").alias("ord")
    )
    rows = first.unionByName(listed).unionByName(walked)
    if cap is None:
        return rows
    ranked = first_many_per_group(
        rows, ["site"], [F.col("source"), F.col("ord"), F.col("url")], cap, "pos"
    )
    return ranked.select("site", "source", "ord", "url", (F.col("pos") - 1).alias("pos"))


def discovery_meta(
    bases: DataFrame, sitemap_urls: DataFrame, crawled: DataFrame, cap: int | None = None
) -> DataFrame:
    """(site, sitemap_urls, crawled_urls, method, capped); ``capped`` only ever true with a ``cap``."""
    stage = _stage_counts(bases, sitemap_urls)
    walked = crawled.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    crawls = _needs_crawl(F.col("sitemap_urls"))
    n_crawled = F.when(crawls, F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint")
    return stage.join(walked, "site", "left").select(
        "site", "sitemap_urls", n_crawled.alias("crawled_urls"),
        F.when(crawls, "crawl").otherwise("sitemap").alias("method"),
        (F.lit(False) if cap is None else F.col("sitemap_urls") + n_crawled + 1 > cap).alias("capped"),
    )


def core_pages(bases: DataFrame, crawl: DataFrame) -> DataFrame:
    """Start page and the reachable core paths per site.

    Instead of probing every path of every site, the crawled addresses are matched with the path
    list, a filter on the scan; a site keeps at most one row per path.
    """
    order = F.create_map(*[F.lit(x) for i, p in enumerate(V.CORE_PATHS, 1) for x in (p, i)])
    path = F.expr(U.path("url"))
    hits = (
        crawl.filter((F.col("status") < 400) & path.isin(*V.CORE_PATHS))
        .select("site", "url", path.alias("path"), F.expr(U.scheme("url")).alias("scheme"))
        .filter(F.col("url") == F.concat("scheme", F.lit("://"), "site", "path"))
        .distinct()
    )
    found = hits.join(bases, "site").filter(F.col("scheme") == F.expr(U.scheme("base_url"))).select(
        "site", order[F.col("path")].cast("bigint").alias("ord"), "url",
        F.initcap(F.replace(F.regexp_replace("path", "^/|/$", ""), F.lit("-"), F.lit(" "))).alias("title"),
        F.lit(V.CORE_TYPE).alias("type"),
    )
    return _start_rows(bases).unionByName(found)


def _start_rows(bases: DataFrame) -> DataFrame:
    return bases.select(
        "site", F.lit(0).cast("bigint").alias("ord"), F.col("base_url").alias("url"),
        F.lit(V.START_TITLE).alias("title"), F.lit(V.START_TYPE).alias("type"),
    )


def specified_pages(bases: DataFrame, requests: DataFrame, crawl: DataFrame) -> DataFrame:
    """Requested addresses (site, pos, url) that are reachable; the start page where missing."""
    asked = requests.groupBy("site", "url").agg(F.min("pos").alias("ord"))
    alive = crawl.filter("status < 400").select("site", "url").distinct()
    kept = asked.join(alive, ["site", "url"], "left_semi").select(
        "site", "ord", "url", F.lit(V.GIVEN_TITLE).alias("title"), F.lit(V.GIVEN_TYPE).alias("type")
    )
    missing = _start_rows(bases.withColumnRenamed("base_url", "url").join(
        kept, ["site", "url"], "left_anti"
    ).withColumnRenamed("url", "base_url"))
    return kept.unionByName(missing)
