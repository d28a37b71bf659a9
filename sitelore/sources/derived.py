"""Inputs derived from the given tables by plain key arithmetic.

The given pages never show product, cart, core or Persian addresses, so these tables rewrite or
extend the real rows; every one of them grows with the table it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sitelore.functions import urls as U, vocab as V
from sitelore.functions.scale import salted_join
from sitelore.operators import links as L
from sitelore.sources.tables import fetched, table

SHOP = "shop.example.com"
ROW = 1_000_000  # positions reserved per page


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with response columns; every third page sits at one of the core paths of its site."""
    core = F.array(*[F.lit(p) for p in V.CORE_PATHS])
    pid, url = F.col("page_id"), F.col("url")
    core_url = F.concat(
        F.expr(U.origin("url")), F.element_at(core, (F.floor(pid / 3) % len(V.CORE_PATHS) + 1).cast("int"))
    )
    return table(spark, sf, "pages").select(
        "page_id",
        F.expr(U.netloc("url")).alias("site"),
        F.when(pid % 3 == 0, core_url).otherwise(url).alias("url"),
        F.when(pid % 17 == 5, 404).otherwise(200).cast("bigint").alias("status"),
        F.when(pid % 19 == 7, "application/json").otherwise("text/html; charset=utf-8").alias("content_type"),
        "html",
    )


def bases(spark: SparkSession, sf: str) -> DataFrame:
    """Start address per site, the shop included."""
    shop = table(spark, sf, "part").groupBy(F.lit(SHOP).alias("site")).agg(
        F.first(F.lit(f"https://{SHOP}/")).alias("base_url"), F.lit(-1).cast("bigint").alias("page_id")
    )
    return L.homepages(fetched(crawl(spark, sf))).unionByName(shop)


def shop_urls(spark: SparkSession, sf: str) -> DataFrame:
    """One address per part on a single large site."""
    key = F.col("p_partkey")
    kinds = ["/product/", "/category/", "/guide-", "/brand/", "/item-product-", "/help/"]
    stem = F.element_at(F.array(*[F.lit(k) for k in kinds]), (key % len(kinds) + 1).cast("int"))
    tail = F.when(key % len(kinds) == 5, "?page=2").otherwise("")
    return table(spark, sf, "part").select(
        F.lit(SHOP).alias("site"),
        key.alias("pos"),
        F.concat(F.lit(f"https://{SHOP}"), stem, key.cast("string"), tail).alias("url"),
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """(site, pos, url): page addresses, their links, repeats, junk and the shop."""
    pages = crawl(spark, sf)
    first = F.col("page_id") * ROW
    own = pages.select("site", first.alias("pos"), "url")
    linked = L.extract_links(pages).select(
        "site", (first + 1 + F.col("link_no")).alias("pos"), F.col("dst_url").alias("url")
    )
    repeats = pages.filter("page_id % 7 = 0").select("site", (first + 900_000).alias("pos"), "url")
    home = F.concat(F.lit("https://"), F.col("site"))
    junk = F.element_at(
        F.array(
            F.concat(home, F.lit("/cart")), F.concat(home, F.lit("/tag/x")),
            F.concat(home, F.lit("/a.pdf")), F.concat(home, F.lit("/x?orderby=1")),
            F.lit("mailto:a@b.co"), F.lit(""), F.lit(None).cast("string"),
            F.lit("https://cdn.example.org/x"),
            F.concat(home, F.lit("/how-to-"), F.col("page_id").cast("string")),
        ),
        (F.col("page_id") % 9 + 1).cast("int"),
    )
    extra = pages.select("site", (first + 900_001).alias("pos"), junk.alias("url"))
    return (
        own.unionByName(linked).unionByName(repeats).unionByName(extra)
        .unionByName(shop_urls(spark, sf))
    )


def hrefs(spark: SparkSession, sf: str) -> DataFrame:
    """One href per page, its form chosen by the key."""
    n = F.col("page_id").cast("string")
    forms = F.array(
        F.concat(F.lit("/a/./b/../"), n), F.concat(F.lit("../"), n), F.concat(F.lit("sub/"), n),
        F.concat(F.lit("?q="), n), F.concat(F.lit("#s"), n), F.concat(F.lit("//cdn.example.org/"), n),
        F.lit("mailto:a@b.co"), F.lit(""), F.concat(F.lit("http://other.example.org/x?y#"), n),
        F.concat(F.lit("./../../"), n, F.lit("/..")),
    )
    return table(spark, sf, "pages").select(
        "page_id", "url", F.element_at(forms, (F.col("page_id") % 10 + 1).cast("int")).alias("href")
    )


def link_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Links by section: start page -> first page of each section -> its pages.

    The last section is a chain, each page linking to the next one only, so a site goes deep.
    """
    pages = fetched(crawl(spark, sf)).select(
        "site", "page_id", F.expr(U.normalize("url")).alias("url"),
        (F.col("page_id") % 4).alias("part"),
    )
    heads = pages.groupBy("site", "part").agg(F.min_by("url", "page_id").alias("src_url"))
    chain = Window.partitionBy("site", "part").orderBy("page_id")
    listed = pages.select("site", "part", "url", "page_id", F.lag("url").over(chain).alias("before"))
    down = salted_join(listed, heads, ["site", "part"]).withColumn(
        "src_url", F.when(F.col("part") == 3, F.coalesce("before", "src_url")).otherwise(F.col("src_url"))
    )
    top = L.homepages(fetched(crawl(spark, sf)))
    across = heads.join(top, "site").select(
        "site", F.col("base_url").alias("src_url"), F.col("src_url").alias("dst_url")
    )
    return down.select("site", "src_url", F.col("url").alias("dst_url")).unionByName(across)


def script_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts, some rewritten letter by letter into Persian or Arabic script."""
    key, text = F.col("doc_id"), F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(key % 4 == 1, F.translate(F.lower(text), "aeioutnsrlp", "اهیوتنسرلپچ"))
        .when(key % 4 == 2, F.translate(F.lower(text), "aeioutnsrl", "اهعوتنسرلد"))
        .otherwise(text).alias("text"),
    )


def robots(spark: SparkSession, sf: str) -> DataFrame:
    """Robots files that name one sitemap index per thousand page numbers."""
    key = F.floor(F.col("page_id") / 1000).cast("string")
    index_url = F.concat(F.lit("https://"), F.col("site"), F.lit("/index-"), key, F.lit(".xml"))
    return crawl(spark, sf).select(
        "site", F.concat(F.lit("User-agent: *\n\t SITEMAP:\t "), index_url, F.lit("\nDisallow: /x\n")).alias("body")
    ).distinct()


def sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemap files of at most 50 pages, index files of at most 20 sitemaps, some malformed."""
    pages = crawl(spark, sf).select("site", "page_id", "url")
    number = F.floor(F.col("page_id") / 50)
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    loc = lambda c: F.concat(F.lit("<loc> "), c, F.lit(" </loc>"))
    address = lambda kind, n: F.concat(
        F.lit("https://"), F.col("site"), F.lit(f"/{kind}-"), n.cast("string"), F.lit(".xml")
    )
    files = pages.groupBy("site", number.alias("n")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("page_id", escaped.alias("u")))),
                lambda r: F.concat(F.lit("<url>"), loc(r["u"]), F.lit("</url>")),
            ),
            "",
        ).alias("entries")
    )
    plain = F.concat(F.lit("<urlset>"), F.col("entries"), F.lit("</urlset>"))
    spaced = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        F.col("entries"), F.lit("</urlset>"),
    )
    broken = F.concat(F.lit("<urlset>"), F.col("entries"), F.lit("</url"))
    prefixed = F.concat(
        F.lit('<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        F.regexp_replace("entries", "(</?)(url|loc)>", "$1sm:$2>"), F.lit("</sm:urlset>"),
    )
    leaf = files.select(
        "site", address("pages", F.col("n")).alias("sitemap_url"),
        F.when(F.col("n") % 5 == 4, broken).when(F.col("n") % 5 == 3, prefixed).when(F.col("n") % 2 == 0, plain).otherwise(spaced).alias("xml"),
    )
    index = files.groupBy("site", F.floor(F.col("n") / 20).alias("m")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list("n")),
                lambda n: F.concat(F.lit("<sitemap>"), loc(address("pages", n)), F.lit("</sitemap>")),
            ),
            "",
        ).alias("entries")
    ).select(
        "site", address("index", F.col("m")).alias("sitemap_url"),
        F.concat(
            F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
            F.col("entries"), F.lit("</sitemapindex>"),
        ).alias("xml"),
    )
    return leaf.unionByName(index)


def usage(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Model calls, one per order; the run is the customer."""
    key = F.col("o_orderkey")
    models = F.array(
        F.lit("gpt-5-nano"), F.lit("gpt-5-mini"), F.lit("gpt-5-mini-2025-08-07"), F.lit("gpt-4o"),
        F.lit("other-model"), F.lit(None).cast("string"), F.lit(""), F.lit("gpt-5-2025"), F.lit("gpt-4o-mini"),
    )
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.element_at(models, (key % 9 + 1).cast("int")).alias("model"),
        (key % 5000 + 100).alias("prompt_tokens"),
        F.when(key % 11 == 0, None).otherwise(key % 700).alias("completion_tokens"), *more,
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers as text, one per conversation turn: plain, fenced, broken or incomplete."""
    key = F.col("conv_id") * 3 + F.col("turn")
    categories = F.array(*[F.lit(c) for c in ("contact", " FAQ ", "policies", "unknown_kind")])
    full = F.to_json(
        F.struct(
            F.concat(F.lit("https://x.example.org/"), F.col("conv_id").cast("string")).alias("url"),
            F.col("role").alias("title_suggestion"),
            F.element_at(categories, (key % 4 + 1).cast("int")).alias("primary_category"),
            F.regexp_replace(F.regexp_replace("text", r'["\\]', ""), r"\s+", " ").alias("extracted_chunk"),
        )
    )
    answer = (
        F.when(key % 7 == 0, full)
        .when(key % 7 == 1, F.concat(F.lit("Here:\n```json\n"), full, F.lit("\n```\nDone.")))
        .when(key % 7 == 2, F.concat(F.lit("```\n"), full, F.lit("\n```")))
        .when(key % 7 == 3, F.concat(F.lit("{broken "), full))
        .when(key % 7 == 4, F.lit('{"primary_category": "faq"}'))
        .when(key % 14 == 5, F.concat(full, F.lit(' {"x":1}')))
        .when(key % 7 == 5, F.lit(""))
        .otherwise(F.concat(F.lit("```json\n"), full))
    )
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.concat(F.lit("https://site.example.org/"), F.col("conv_id").cast("string")).alias("page_url"),
        F.concat(F.lit("Title "), F.col("role")).alias("page_title"),
        answer.alias("content"),
    )


def dated_usage(spark: SparkSession, sf: str) -> DataFrame:
    """The calls of ``usage`` with the day of their order."""
    day = F.col("o_orderdate").cast("date").cast("timestamp").alias("called_at")
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_k"), day)
    calls = usage(spark, sf, "o_orderkey")
    return calls.join(own, calls["o_orderkey"] == own["_k"]).drop("_k", "o_orderkey")


def price_table(spark: SparkSession, sf: str) -> DataFrame:
    """Prices that change with the year, one set for each year with orders; names are models and prefixes of them."""
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    names = [*V.PRICES.items(), ("gpt", (9.0, 9.0)), ("gpt-5-mini-2025", (0.3, 2.5)), ("other-model-x", (1.0, 1.0))]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("i"), F.lit(o).alias("o")) for n, (i, o) in names])
    changed = years.select("y", F.inline(rows)).filter("name <> 'gpt-4o' OR y % 2 = 0")
    return changed.select(
        "name", (F.col("i") + F.col("y") % 5).alias("input"), (F.col("o") + F.col("y") % 3).alias("output"),
        F.make_date("y", F.lit(7), F.lit(1)).cast("timestamp").alias("valid_from"),
    )


ANSWER_KINDS = ("prospect", "colors", "audit", "categories", "clusters", "introduction")


def kind_answers(spark: SparkSession, sf: str) -> DataFrame:
    """(request_id, kind, content): answers of six kinds from conversation turns; plain, fenced, broken, of wrong types."""
    key = F.col("conv_id") * 8 + F.col("turn")
    link = lambda k: F.concat(F.lit("https://x.example.org/"), (key + k).cast("string"))
    said = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r'["\\]', ""), r"\s+", " ")
    urls = lambda *ks: F.array(*[link(k) for k in ks])
    full = {
        "prospect": F.struct(
            (key % 2 == 0).alias("is_potential_customer"), (key % 101).alias("confidence_score"), said.alias("reasoning_for"),
            F.col("role").alias("reasoning_against")),
        "colors": F.struct(
            F.concat(F.lit("#"), F.lpad((key % 1000000).cast("string"), 6, "0")).alias("main_background_color"),
            F.lit("#123456").alias("primary_brand_color"), said.alias("background_color_description")),
        "audit": F.struct(
            (key % 3 == 0).alias("has_contact"), F.lit(True).alias("has_faq"), F.array(F.lit("policies"), F.col("role")).alias("missing"),
            said.alias("notes")),
        "categories": F.struct(urls(1, 2).alias("company_info_pages"), urls(3).alias("other_pages"), urls(4).alias("no_such_pages")),
        "clusters": F.struct(
            F.struct(urls(1, 2, 3).alias("urls"), said.alias("description")).alias("educational_content"),
            F.struct(urls(4).alias("urls")).alias("company_information"),
            F.array(F.lit("company_information"), F.lit("educational_content")).alias("priority_extraction_order")),
    }
    wrong = {
        "prospect": '{"is_potential_customer": "maybe", "confidence_score": "high", "reasoning_against": "r"}', "colors": "[1, 2]",
        "audit": '{"missing": "faq", "has_faq": true, "has_contact": null}',
        "categories": '{"company_info_pages": {"urls": ["u"]}, "product_pages": ["a", null, "b"]}',
        "clusters": '{"educational_content": ["a"], "buying_guides": {"urls": ["b"]}}',
    }
    kind = F.element_at(F.array(*[F.lit(k) for k in ANSWER_KINDS]), (key % 6 + 1).cast("int"))
    content = F.when(kind == "introduction", F.concat(F.lit(" \n"), F.coalesce("text", F.lit("")), F.lit("\n ")))
    for name, value in full.items():
        json = F.to_json(value)
        form = F.when(key % 4 == 0, json).when(key % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), json, F.lit("\n```"))).when(
            key % 4 == 2, F.concat(F.lit("{oops "), json)
        ).otherwise(F.lit(wrong[name]))
        content = content.when(kind == name, form)
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), kind.alias("kind"), content.alias("content")
    )


STATUSES = {"view": "pending", "click": "running", "purchase": "completed", "signup": "completed", "error": "failed"}


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    return as_job_events(table(spark, sf, "events"))


def as_job_events(events: DataFrame) -> DataFrame:
    """Job state changes, one per event; the job is the user.  Works on a batch or a stream."""
    status = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])
    key = F.col("event_id")
    messages = F.array(
        F.lit("Detecting language..."), F.lit("Extracting from page 3/20: https://x.example.org/a:b"),
        F.lit("Extracting knowledge 4/9 pages..."), F.lit("Writing section: FAQ..."),
        F.lit("Warming up"), F.lit("Knowledge base generation completed successfully."),
    )
    return events.select(
        F.col("user_id").alias("job_id"),
        key.alias("event_id"),
        F.col("ts"),
        F.when(F.col("user_id") % 3 == 0, "prospects").otherwise("knowledge_base").alias("job_type"),
        status[F.col("event_type")].alias("status"),
        F.element_at(messages, (key % 6 + 1).cast("int")).alias("progress"),
        (key % 40 + 1).alias("done"),
        F.lit(40).cast("bigint").alias("total"),
        F.when(
            F.col("event_type").isin("purchase", "signup"),
            F.concat(F.lit("# Knowledge Base\n\n"), F.repeat(F.concat(F.col("props"), F.lit(" ")), (key % 90).cast("int"))),
        ).alias("document"),
    )


def element_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with action elements put before the footer, their attributes chosen by the key."""
    pid = F.col("page_id")
    n = pid.cast("string")
    pick = lambda options, k=1: F.element_at(
        F.array(*[F.lit(o) for o in options]), (F.floor(pid / k) % len(options) + 1).cast("int")
    )
    widgets = F.concat(
        F.lit('<button id="'), pick(["follow", "id_12", "auto9x", "menu", "content", "btn-number-12345"]),
        F.lit('" class="x btn-main" aria-label="'), pick(["Follow user", "Like post", "Share 5", "Open"], 2),
        F.lit('">'), pick(["Follow", "Save", "Reply 7", "Don\'t like", "Go"], 3), F.lit("</button>"),
        F.lit('<div role="'), pick(["button", "menu", "note"]), F.lit('" data-testid="'),
        pick(["tweetText", "likeBtn", "share-box", "follow-x", "box"]), F.lit('">text'), n, F.lit("</div>"),
        F.lit('<input type="'), pick(["submit", "button", "search", "text"]), F.lit('" name="q" placeholder="Search '),
        pick(["here", "2024"]), F.lit('">'),
        F.lit('<img alt="'), pick(["Profile picture of A", "logo", "a@b"]), F.lit('" src="/i.png">'),
        F.lit('<a href="'), pick(["/user/", "/x/followers", "/x/following", "/@me", "/plain"]), F.lit('">'),
        pick(["followers", "Home", "About us"]), F.lit("</a>"),
        F.lit('<input type=submit name=q2><my-widget role="button" aria-label="a > b">w</my-widget>'),
        F.lit('<textarea class="post-box wide"></textarea><form class="plain"></form><h2 title="More">View more</h2>'),
    )
    return table(spark, sf, "pages").select(
        "page_id", F.expr(U.netloc("url")).alias("site"),
        F.concat(F.col("html"), widgets).alias("html"),
    )


def styled_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Crawled pages with colour declarations in the head, chosen by the key."""
    pid = F.col("page_id")
    pick = lambda options: F.element_at(
        F.array(*[F.lit(o) for o in options]), (pid % len(options) + 1).cast("int")
    )
    css = F.concat(
        F.lit("<style>body{background:"), pick(["#FAFAFA", "#fff", "#123456", "white"]),
        F.lit(";color:"), pick(["#0a0", "#00AA00", "red"]), F.lit("}a{border:1px solid "),
        pick(["#abc", "#00aa00", "#c0ffee"]), F.lit(";background-color : #EEE}</style></head>"),
    )
    return crawl(spark, sf).withColumn("html", F.regexp_replace("html", "(?i)</head>", css))
