"""Scans: pages, robots files, sitemaps and prospect lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelore.functions import urls as U, vocab as V
from sitelore.functions.text import cap, strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fetched(pages: DataFrame) -> DataFrame:
    """Successful HTML responses, where the table says so."""
    out = pages
    if "status" in pages.columns:
        out = out.filter(F.col("status") < 400)
    if "content_type" in pages.columns:
        out = out.filter(F.lower("content_type").contains("text/html"))
    return out


def scan_pages(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Successful responses of any type; ``max_chars`` caps the HTML (see ``vocab.HTML_CAP``)."""
    ok = pages.filter(F.col("status") < 400) if "status" in pages.columns else pages
    return ok.withColumn("html", cap(F.col("html"), max_chars))


def scan_lang_snippet(pages: DataFrame, chars: int = V.LANG_SNIPPET_CHARS) -> DataFrame:
    """Opening part of each HTML page: the snippet language detection is fed with."""
    return fetched(pages).select("page_id", "url", F.substring("html", 1, chars).alias("snippet"))


def robots_sitemaps(robots: DataFrame, bases: DataFrame) -> DataFrame:
    """Sitemap addresses per site: ``Sitemap:`` lines plus the two usual places."""
    line = F.explode(F.split("body", r"\R")).alias("line")
    declared = (
        robots.select("site", line)
        .withColumn("line", F.expr(strip("line")))
        .filter(F.lower("line").startswith("sitemap:"))
        .select("site", F.expr(strip("regexp_replace(line, '^[^:]*:', '')")).alias("sitemap_url"))
    )
    usual = bases.select(
        "site",
        F.explode(
            F.transform(
                F.array(F.lit("/sitemap.xml"), F.lit("/sitemap_index.xml")),
                lambda p: F.concat(F.expr(U.scheme("base_url")), F.lit("://"), F.expr(U.netloc("base_url")), p),
            )
        ).alias("sitemap_url"),
    )
    return declared.unionByName(usual).distinct()


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """Trimmed ``loc`` texts per sitemap; a document that is not well-formed gives no rows.

    Names count without their prefix, so any prefix of the namespace is read.
    """
    schema = (
        "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _corrupt_record string"
    )
    parsed = sitemaps.withColumn(
        "doc", F.from_xml("xml", schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    ).filter("doc._corrupt_record IS NULL")
    found = F.xpath("xml", F.lit("/*/*[local-name()='url' or local-name()='sitemap']/*[local-name()='loc']/text()"))
    return (
        parsed.select("site", "sitemap_url", F.explode(found).alias("loc"))
        .select("site", "sitemap_url", F.expr(strip("loc")).alias("loc"))
        .filter("loc <> ''")
    )


def prospect_list(urls: DataFrame) -> DataFrame:
    """Prospect addresses (request_id, url): trimmed, empty ones dropped, each once in its request."""
    return (
        urls.select("request_id", F.expr(strip("url")).alias("url")).filter("url <> ''").distinct()
    )
