"""Link extraction and start pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitelore.functions import urls as U
from sitelore.functions.let import lit
from sitelore.functions.text import ATTRIBUTES_RE, unescape, without_scripts


def extract_links(pages: DataFrame, base: str | None = None) -> DataFrame:
    """Every ``a[href]`` of each page with its absolute, fragment-free address.

    Relative links are resolved against the page's own address, or against column ``base``.
    No shuffle: links are split off inside the task that reads the page.
    """
    anchors = f"regexp_extract_all({without_scripts('html')}, {lit(rf'(?is)<a\b{ATTRIBUTES_RE}>')}, 0)"
    found = f"transform({anchors}, tag -> regexp_extract(tag, {lit(U.HREF_RE)}, 1))"
    hrefs = F.expr(f"filter({found}, href -> href <> '')")
    found = pages.select(
        "page_id", "site", F.col("url").alias("src_url"),
        F.col(base or "url").alias("_base"), F.posexplode(hrefs).alias("link_no", "raw"),
    ).withColumn("href", F.expr(unescape(U.unquote_attribute("raw"))))
    return found.select(
        "page_id", "site", "src_url", F.col("link_no").cast("bigint").alias("link_no"), "href",
        F.expr(U.normalize(U.resolve("_base", "href"))).alias("dst_url"),
    )


def same_site_links(links: DataFrame) -> DataFrame:
    return links.filter(F.expr(U.netloc("dst_url")) == F.col("site"))


def homepages(pages: DataFrame) -> DataFrame:
    """Start address per site: its root page, or its smallest page when the root is missing."""
    first = f"min(struct(NOT {U.is_root('url')}, page_id, {U.normalize('url')} AS base_url))"
    return pages.groupBy("site").agg(F.expr(first).alias("first")).select(
        "site", "first.base_url", "first.page_id"
    )
