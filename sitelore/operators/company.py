"""Company descriptions and prospect scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitelore.functions import text as T, urls as U, vocab as V
from sitelore.functions.let import lit
from sitelore.functions.scale import project_wanted, reused, salted_join

TERM_RE = r"\p{L}{4,}"


def company_pages(pages: DataFrame, reached: DataFrame) -> DataFrame:
    """(site, rank, url, description): first two sentences of each crawled page that has text."""
    first_copy = pages.groupBy("site", F.expr(U.normalize("url")).alias("url")).agg(
        F.min("page_id").alias("page_id")
    )
    wanted = reached.join(first_copy, ["site", "url"]).select("page_id", "site", "rank", "url")
    describe = lambda rows: rows.withColumn(
        "description", F.expr(T.first_sentences(T.plain_text("html"), 2))
    ).drop("html")
    rows = project_wanted(pages.select("page_id", "html"), wanted, "page_id", describe)
    return rows.filter("description <> ''").select("site", "rank", "url", "description")


def company_summary(described: DataFrame, bases: DataFrame) -> DataFrame:
    """Roll-up of the page descriptions per site; the crawl limit bounds a site's rows."""
    line = F.concat(F.lit(V.COMPANY_URL), "url", F.lit(V.COMPANY_TEXT), "description")
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]
    )
    grouped = described.groupBy("site").agg(
        F.count(F.lit(1)).alias("analyzed_pages"), F.array_join(lines, "\n").alias("lines")
    )
    return grouped.join(bases, "site").select(
        "site", "analyzed_pages",
        F.concat(F.lit(V.COMPANY_HEAD), "base_url", F.lit(":\n\n"), "lines").alias("summary"),
    )


def terms(text: str) -> Column:
    """Distinct lower-case words of at least four letters."""
    return F.expr(f"array_distinct(regexp_extract_all(lower({text}), {lit(TERM_RE)}, 0))")


def prospect_texts(prospects: DataFrame, pages: DataFrame) -> DataFrame:
    """(request_id, url, text): page text per request and address; NULL when the page was not fetched."""
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    wanted = prospects.select("url").distinct().join(first, "url").select("page_id", "url")
    read = lambda rows: rows.withColumn("text", F.expr(T.plain_text("html"))).drop("html")
    got = project_wanted(pages.select("page_id", "html"), wanted, "page_id", read)
    return prospects.select("request_id", "url").join(got.select("url", "text"), "url", "left")


def prospect_status(texts: DataFrame) -> DataFrame:
    empty = F.expr(T.is_blank("text"))
    return texts.select(
        "request_id", "url",
        F.when(empty, "failed").otherwise("completed").alias("status"),
        F.when(empty, V.EMPTY_PAGE_ERROR).alias("error"),
        F.when(empty, 0).otherwise(F.expr(T.tokens("text"))).cast("bigint").alias("prompt_tokens"),
    )


def _reasons(words: Column) -> Column:
    return F.array_join(F.array_sort(words), ", ")


def prospect_score(texts: DataFrame, personas: DataFrame) -> DataFrame:
    """Best persona of a page's own request by the share of its terms found on the page.

    ``personas`` (request_id, persona_id, text) come with a request, and pages meet those of their
    request only.  Persona terms, one row per term, are joined by request and salted term.  Pages'
    terms are read and made distinct once, and matches of a page are counted in its own task first.
    """
    page, mine = ["request_id", "url"], ["request_id", "persona_id"]
    profile = personas.select(*mine, terms("text").alias("persona_terms"))
    sized = profile.withColumn("n_terms", F.size("persona_terms").cast("bigint"))
    by_term = sized.select(*mine, "n_terms", F.explode("persona_terms").alias("term"))
    known = reused(texts.filter(~F.expr(T.is_blank("text"))).select(*page, terms("text").alias("page_terms")))
    words = known.select(*page, F.explode("page_terms").alias("term"))
    matched = salted_join(words, by_term, ["request_id", "term"]).groupBy(*page, "persona_id", "n_terms").agg(
        F.count(F.lit(1)).alias("hits")
    )
    share = F.floor((200 * F.col("hits") + F.col("n_terms")) / (2 * F.col("n_terms")))
    best = matched.groupBy(*page).agg(
        F.max(F.struct(share.alias("confidence"), (-F.col("persona_id")).alias("neg"))).alias("top")
    ).select(*page, "top.confidence", (-F.col("top.neg")).alias("best_id"))
    # no match: the first persona of the request, 0 %
    any_id = profile.groupBy("request_id").agg(F.min("persona_id").alias("any_id"))
    chosen = salted_join(known.join(best, page, "left"), any_id, ["request_id"]).select(
        *page, "page_terms", F.coalesce("confidence", F.lit(0)).cast("bigint").alias("confidence_score"),
        F.coalesce("best_id", "any_id").alias("persona_id"),
    )
    return salted_join(chosen, profile, mine).select(
        *page, "persona_id", (F.col("confidence_score") >= 50).alias("is_potential_customer"),
        "confidence_score",
        _reasons(F.array_intersect("persona_terms", "page_terms")).alias("reasoning_for"),
        _reasons(F.array_except("persona_terms", "page_terms")).alias("reasoning_against"),
    )


def prospect_report(texts: DataFrame, personas: DataFrame) -> DataFrame:
    """Status and analysis per prospect; failed rows have no analysis."""
    return prospect_status(texts).join(prospect_score(texts, personas), ["request_id", "url"], "left")
