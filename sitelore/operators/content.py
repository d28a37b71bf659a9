"""From pages to chunks, and the per-site facts read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitelore.functions import contacts as C, language as G, text as T, urls as U, vocab as V
from sitelore.functions.let import contains_any, let, lit
from sitelore.functions.scale import first_per_group, project_wanted, reused


def section_of(url: str, title: str) -> str:
    """Section of a page by the words in its path and title; ``additional`` when none fits."""
    tests = " ".join(
        f"WHEN {contains_any('low', terms)} THEN {lit(key)}" for key, terms in V.SECTION_WORDS.items()
    )
    return let("low", f"lower(concat_ws(' ', {U.path(url)}, {title}))", f"CASE {tests} ELSE 'additional' END")


def chunk_columns(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Title, section, main text and its tokens, one row per page; every other column stays."""
    text = pages.withColumn("title", F.expr(T.page_title("html"))).withColumn(
        "chunk", F.expr(T.main_content("html", max_chars))
    )
    return text.drop("html").withColumn("section", F.expr(section_of("url", "title"))).withColumn(
        "tokens", F.expr(T.tokens("chunk"))
    )


def page_chunks(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Chunk row per page; pages without text are dropped."""
    rows = chunk_columns(pages.select("page_id", "site", "url", "html"), max_chars)
    return rows.filter(~F.expr(T.is_blank("chunk")))


def selected_chunks(
    pages: DataFrame, selected: DataFrame, max_chars: int | None = None
) -> DataFrame:
    """Chunks of the selected pages (site, rank, url, cluster, page_id); ``pos`` is the rank.

    The text is taken by page number, so HTML is never shuffled.  Texts are kept before blank ones are
    dropped: a filter on a text in the same plan moves below the join, where it takes the text of every page.
    """
    wanted = selected.select("page_id", "site", F.col("rank").alias("pos"), "url", "cluster")
    texts = lambda rows: rows.select(
        "page_id", *[c for c in wanted.columns if c != "page_id" and c in rows.columns],
        F.expr(T.page_title("html")).alias("title"),
        F.expr(T.main_content("html", max_chars)).alias("chunk"),
    )
    rows = project_wanted(pages.select("page_id", "html"), wanted, "page_id", texts)
    kept = reused(
        rows.withColumn("section", F.expr(section_of("url", "title"))).withColumn("tokens", F.expr(T.tokens("chunk")))
    )
    return kept.filter(~F.expr(T.is_blank("chunk")))


def harvested(texts: DataFrame, site: str, text: str, kind: str) -> DataFrame:
    """Distinct (site, value) of one contact kind."""
    find = {"email": C.emails, "phone": C.phones}[kind]
    return texts.select(F.col(site).alias("site"), F.explode(F.expr(find(text))).alias(kind)).distinct()


def contact_rows(texts: DataFrame, site: str = "site", text: str = "chunk") -> DataFrame:
    """Distinct (site, kind, value) of all contacts."""
    tagged = lambda kind, found: (
        f"transform({found}, v -> named_struct('kind', '{kind}', 'value', v))"
    )
    both = f"concat({tagged('email', C.emails(text))}, {tagged('phone', C.phones(text))})"
    return texts.select(F.col(site).alias("site"), F.expr(f"inline({both})")).distinct()


def site_contacts(
    texts: DataFrame, site: str = "site", text: str = "chunk", limit: int | None = None
) -> DataFrame:
    """Contacts of each kind per site in sorted order, joined by ``, ``.

    A view of ``contact_rows``; ``limit`` (``vocab.CONTACT_LIMIT``) keeps the first of each kind.
    """
    ranked = contact_rows(texts, site, text)
    if limit is not None:
        ranked = first_per_group(ranked, ["site", "kind"], [F.col("value")], limit)
    listed = lambda kind: F.array_join(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))), ", "
    )
    return ranked.groupBy("site").agg(listed("email").alias("emails"), listed("phone").alias("phones"))


def site_language(chunks: DataFrame, probes: int | None = None) -> DataFrame:
    """Language per site: most votes of its pages, the default only where no page says another.

    Ties go to the first language in alphabetical order.  ``probes`` looks at the first pages only.
    """
    seen = chunks if probes is None else chunks.filter(F.col("pos") <= probes)
    votes = seen.select("site", F.expr(G.detect_language("chunk")).alias("lang")).groupBy("site", "lang").agg(
        F.count(F.lit(1)).alias("n")
    )
    best = F.struct((F.col("lang") == V.DEFAULT_LANGUAGE).alias("default"), (-F.col("n")).alias("n"), "lang")
    return votes.groupBy("site").agg(F.min(best)["lang"].alias("lang"))


HEX_RE = r"(?i)#(?:[0-9a-f]{6}|[0-9a-f]{3})\b"
BACKGROUND_RE = r"(?i)background(?:-color)?\s*:\s*(#(?:[0-9a-f]{6}|[0-9a-f]{3})\b)"


def _long_hex(code: str) -> str:
    return f"""CASE WHEN length({code}) = 4 THEN regexp_replace(lower({code}), '([0-9a-f])', '$1$1')
        ELSE lower({code}) END"""


def _most_frequent(codes: str) -> str:
    """Most frequent value of an array and minus its number, the smallest one on a tie; NULL if empty."""
    tally = f"""transform(array_distinct({codes}), c -> named_struct(
        'n', -size(filter({codes}, x -> x = c)), 'code', c))"""
    return f"array_min({tally})"


def colors(html: str, max_chars: int | None = None) -> str:
    """struct(background, brand): most frequent background colour and most frequent other one, as (n, code)."""
    behind = f"transform(regexp_extract_all(css, {lit(BACKGROUND_RE)}, 1), h -> {_long_hex('h')})"
    rest = T.replace_all("css", BACKGROUND_RE)
    others = f"transform(regexp_extract_all({rest}, {lit(HEX_RE)}, 0), h -> {_long_hex('h')})"
    background = let("found", behind, _most_frequent("found"))
    brand = let("found", others, _most_frequent("found"))
    return let("css", T.cap(html, max_chars), f"named_struct('background', {background}, 'brand', {brand})")


def site_colors(pages: DataFrame, bases: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Colours of each site's start page with a description, the defaults where none was found."""
    wanted = bases.select("site", "page_id")
    found = lambda rows: rows.withColumn("c", F.expr(colors("html", max_chars))).drop("html")
    got = project_wanted(pages.select("page_id", "html"), wanted, "page_id", found)
    out = bases.select("site").join(got, "site", "left")
    told = lambda c, text, default: F.when(
        F.col(f"{c}.n").isNotNull(), F.format_string(text, (-F.col(f"{c}.n")).cast("bigint"))
    ).otherwise(default)
    return out.select(
        "site",
        F.coalesce("c.background.code", F.lit(V.DEFAULT_BACKGROUND)).alias("main_background_color"),
        F.coalesce("c.brand.code", F.lit(V.DEFAULT_BRAND)).alias("primary_brand_color"),
        told("c.background", V.BACKGROUND_FORMAT, V.BACKGROUND_FALLBACK).alias("background_color_description"),
        told("c.brand", V.BRAND_FORMAT, V.BRAND_FALLBACK).alias("brand_color_description"),
    )
