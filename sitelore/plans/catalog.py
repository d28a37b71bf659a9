"""Every registered query: name -> function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelore.functions import contacts as C, language as G, pricing as P, text as T, urls as U, vocab as V
from sitelore.functions.scale import new_shared_path
from sitelore.operators import (
    answers, clusters, company, content, costs, discovery, document, elements, links, models, prefilter, runs,
    sections,
)
from sitelore.plans import knowledge_base as knowledge
from sitelore.sources import derived as D, sinks, tables as S
from sitelore.streaming import job_progress as stream_jobs, page_stream as stream_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- scans ----------------------------------------------------------------------------------
@query
def scan_pages(spark, sf):
    return S.scan_pages(D.crawl(spark, sf)).select(
        "page_id", "url", "status", F.length("html").cast("bigint").alias("n_chars"),
        F.md5("html").alias("html_md5"),
    )


@query
def scan_lang_snippet(spark, sf):
    return S.scan_lang_snippet(D.crawl(spark, sf))


# --- URLs -----------------------------------------------------------------------------------
@query
def url_parts(spark, sf):
    parts = (U.scheme, U.netloc, U.path, U.query, U.fragment)
    return D.candidates(spark, sf).select(
        "site", "pos", *[F.expr(part("url")).alias(part.__name__) for part in parts]
    )


@query
def url_normalize(spark, sf):
    return D.candidates(spark, sf).select("site", "pos", F.expr(U.normalize("url")).alias("norm"))


@query
def url_resolve(spark, sf):
    return D.hrefs(spark, sf).select(
        "page_id", "href", F.expr(U.resolve("url", "href")).alias("resolved")
    )


@query
def extract_links(spark, sf):
    return links.extract_links(D.crawl(spark, sf)).select("page_id", "link_no", "href", "dst_url")


@query
def same_site_links(spark, sf):
    return links.same_site_links(links.extract_links(D.crawl(spark, sf))).select(
        "page_id", "link_no", "dst_url"
    )


def kept(spark, sf):
    return prefilter.prefilter_urls(D.candidates(spark, sf))


@query
def prefilter_urls(spark, sf):
    return kept(spark, sf)


@query
def dropped_by_reason(spark, sf):
    return prefilter.dropped_by_reason(D.candidates(spark, sf))


@query
def dropped_totals(spark, sf):
    return prefilter.dropped_totals(D.candidates(spark, sf))


@query
def is_product_url(spark, sf):
    found = U.is_product(f"lower({U.path('url')})")
    return D.candidates(spark, sf).select(
        "site", "pos", F.expr(f"coalesce({found}, false)").alias("is_product")
    )


@query
def product_sample(spark, sf):
    return prefilter.product_sample(D.candidates(spark, sf)).select("site", "url", "rank")


@query
def knowledge_tier(spark, sf):
    return clusters.knowledge_tier(kept(spark, sf)).select("site", "url", "tier")


@query
def tier_quota_sample(spark, sf):
    return clusters.tier_quota_sample(kept(spark, sf)).select("site", "url", "tier", "rank")


@query
def url_category_sample(spark, sf):
    return clusters.url_category_sample(kept(spark, sf), V.CATEGORY_THRESHOLD)


@query
def url_category(spark, sf):
    return clusters.url_category(kept(spark, sf), prefilter.classify_urls(D.candidates(spark, sf)))


@query
def cluster_assign(spark, sf):
    return clusters.cluster_assign(kept(spark, sf))


@query
def cluster_counts(spark, sf):
    return clusters.cluster_counts(kept(spark, sf))


@query
def page_budget(spark, sf):
    key = F.col("p_partkey")
    asked = F.when(key % 5 == 0, None).otherwise(F.col("p_size") * 3 - 10 - key % 3)
    return S.table(spark, sf, "part").select("p_partkey", clusters.page_budget(asked).alias("budget"))


@query
def select_pages(spark, sf):
    return clusters.select_pages(D.bases(spark, sf), kept(spark, sf)).drop("pos")


@query
def pages_by_cluster(spark, sf):
    return clusters.pages_by_cluster(select_pages(spark, sf))


# --- text and page facts --------------------------------------------------------------------
def pages(spark, sf):
    return S.table(spark, sf, "pages")


def documents(spark, sf):
    return S.table(spark, sf, "documents")


@query
def page_title(spark, sf):
    return pages(spark, sf).select("page_id", F.expr(T.page_title("html")).alias("title"))


@query
def clean_text(spark, sf):
    return pages(spark, sf).select("page_id", F.expr(T.clean_text("html")).alias("text"))


@query
def plain_text(spark, sf):
    return pages(spark, sf).select("page_id", F.expr(T.plain_text("html")).alias("text"))


@query
def main_content(spark, sf):
    """Pages with their article tags kept, renamed, or renamed and without paragraph tags."""
    pid, html = F.col("page_id"), F.col("html")
    plain = F.replace(html, F.lit("article"), F.lit("div"))
    shaped = (
        F.when(pid % 3 == 0, html).when(pid % 3 == 1, plain)
        .otherwise(F.replace(plain, F.lit("<p>"), F.lit("<br>")))
    )
    return pages(spark, sf).select("page_id", shaped.alias("html")).select(
        "page_id", F.expr(T.main_content("html")).alias("chunk")
    )


@query
def strip_noise_html(spark, sf):
    return pages(spark, sf).select("page_id", F.expr(T.strip_noise_html("html")).alias("html"))


@query
def token_count(spark, sf):
    return documents(spark, sf).select("doc_id", F.expr(T.tokens("text")).alias("tokens"))


@query
def detect_script_lang(spark, sf):
    return D.script_texts(spark, sf).select("doc_id", F.expr(G.script_language("text")).alias("lang"))


@query
def detect_lang(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.expr(G.stopword_language("text")).alias("detected"), F.col("lang").alias("labelled")
    )


@query
def language_name(spark, sf):
    key, lang = F.col("doc_id") % 6, F.col("lang")
    code = (
        F.when(key == 0, F.upper(lang)).when(key == 1, "Xx").when(key == 2, "")
        .when(key == 3, None).when(key == 4, "fa").otherwise(lang)
    )
    return documents(spark, sf).select("doc_id", code.alias("code")).withColumn(
        "name", F.expr(G.language_name("code"))
    )


@query
def harvest_emails(spark, sf):
    return content.harvested(documents(spark, sf), "source", "text", "email")


@query
def harvest_phones(spark, sf):
    return content.harvested(documents(spark, sf), "source", "text", "phone")


@query
def site_contacts(spark, sf):
    return content.site_contacts(documents(spark, sf), "source", "text")


@query
def site_colors(spark, sf):
    good = S.fetched(D.styled_pages(spark, sf))
    return content.site_colors(good, links.homepages(good))


@query
def page_section(spark, sf):
    good = S.fetched(D.crawl(spark, sf))
    return good.select(
        "page_id", F.expr(content.section_of("url", T.page_title("html"))).alias("section")
    )


@query
def page_chunks(spark, sf):
    return content.page_chunks(S.fetched(D.crawl(spark, sf)))


@query
def faq_pairs(spark, sf):
    """Document texts with a question line made of each clause that ends in a comma."""
    lines = "replace(replace(text, ', ', '?\\n'), '. ', '.\\n')"
    return documents(spark, sf).select("doc_id", F.expr(f"inline({T.faq_pairs(lines)})"))


# --- sections, documents, the full chain ----------------------------------------------------
def built(spark, sf, **options):
    return knowledge.build(D.crawl(spark, sf), **options)


@query
def site_language(spark, sf):
    return built(spark, sf).languages


@query
def section_chunks(spark, sf):
    kb = built(spark, sf)
    return sections.section_chunks(kb.chunks, kb.contacts)


@query
def token_batches(spark, sf):
    return sections.token_batches(built(spark, sf).chunks, budget=1500)


@query
def section_partial(spark, sf):
    return sections.section_partial(built(spark, sf).chunks, budget=1500)


@query
def section_merge(spark, sf):
    return sections.section_merge(built(spark, sf).chunks)


@query
def contact_context(spark, sf):
    return built(spark, sf).contacts.select(
        "site", F.expr(C.context("emails", "phones")).alias("block")
    )


@query
def section_title(spark, sf):
    key = F.col("doc_id")
    names = F.array(*[F.lit(k) for k in V.SECTIONS], F.lit("unknown"))
    return documents(spark, sf).select(
        "doc_id", F.element_at(names, (key % 9 + 1).cast("int")).alias("section"),
        F.when(key % 3 == 0, "FA").otherwise(F.col("lang")).alias("lang"),
    ).withColumn("title", F.expr(document.section_title("section", "lang")))


@query
def toc(spark, sf):
    kb = built(spark, sf)
    return document.toc(kb.sections, kb.languages)


@query
def overview_source(spark, sf):
    return document.overview_source(built(spark, sf).sections)


@query
def target_tokens(spark, sf):
    key = F.col("o_orderkey")
    asked = F.when(key % 4 == 0, None).when(key % 4 == 1, "many").when(key % 8 == 2, "99999999999").otherwise(
        ((key * 37) % 200000 - 500).cast("string")
    )
    return S.table(spark, sf, "orders").select(
        "o_orderkey", document.target_tokens(asked).alias("target")
    )


@query
def compression_plan(spark, sf):
    return document.compression_plan(built(spark, sf).sections, target=2000).drop("body", "whole_body")


@query
def assemble_document(spark, sf):
    """Documents under the smallest target, so that sections are condensed."""
    return built(spark, sf, target=V.TARGET_TOKENS_MIN).documents


@query
def completeness_audit(spark, sf):
    return built(spark, sf).audit()


@query
def kb_summary(spark, sf):
    return built(spark, sf).summary()


@query
def knowledge_base(spark, sf):
    return built(spark, sf).documents


@query
def knowledge_base_discovered(spark, sf):
    """Documents over the addresses that discovery found."""
    return built(spark, sf, discovered=discovery.discover_candidates(*discovered(spark, sf))).documents


@query
def knowledge_base_core(spark, sf):
    return built(spark, sf, mode="core").documents


@query
def knowledge_base_specified(spark, sf):
    """Documents of every crawled address of each site, asked for beside addresses that were not crawled."""
    asked = asked_pages(D.crawl(spark, sf))
    return built(spark, sf, mode="specified", requests=asked).documents


@query
def document_parts(spark, sf):
    """The documents of ``knowledge_base_specified`` in parts, without a row for a whole site."""
    return built(spark, sf, mode="specified", requests=asked_pages(D.crawl(spark, sf))).parts()


@query
def legacy_compile(spark, sf):
    return sections.legacy_compile(built(spark, sf).chunks)


# --- discovery ------------------------------------------------------------------------------
@query
def scan_robots_sitemaps(spark, sf):
    return S.robots_sitemaps(D.robots(spark, sf), links.homepages(D.crawl(spark, sf)))


@query
def sitemap_locs(spark, sf):
    return S.sitemap_locs(D.sitemaps(spark, sf))


@query
def sitemap_expand(spark, sf):
    return discovery.sitemap_expand(scan_robots_sitemaps(spark, sf), sitemap_locs(spark, sf))


def crawled(spark, sf, max_pages):
    pages_ = D.crawl(spark, sf)
    return discovery.crawl_reach(
        links.homepages(S.fetched(pages_)), D.link_graph(spark, sf), pages_, max_pages
    )


@query
def crawl_reach(spark, sf):
    return crawled(spark, sf, V.COMPANY_CRAWL_PAGES)


def discovered(spark, sf):
    bases = links.homepages(S.fetched(D.crawl(spark, sf)))
    return bases, sitemap_expand(spark, sf), crawled(spark, sf, V.CRAWL_FALLBACK_PAGES)


@query
def discover_candidates(spark, sf):
    return discovery.discover_candidates(*discovered(spark, sf)).select("site", "source", "ord", "url")


@query
def discovery_meta(spark, sf):
    return discovery.discovery_meta(*discovered(spark, sf))


@query
def core_pages(spark, sf):
    pages_ = D.crawl(spark, sf)
    return discovery.core_pages(links.homepages(pages_), pages_)


def asked_pages(pages_):
    """Requests for every crawled address, and for as many that were not crawled."""
    pid = F.col("page_id")
    return pages_.select("site", pid.alias("pos"), "url").unionByName(
        pages_.select("site", pid.alias("pos"), F.concat("url", F.lit("-missing")).alias("url"))
    )


@query
def specified_pages(spark, sf):
    pages_ = D.crawl(spark, sf)
    return discovery.specified_pages(links.homepages(pages_), asked_pages(pages_), pages_)


# --- models and costs -----------------------------------------------------------------------
@query
def model_requests(spark, sf):
    return models.model_requests(built(spark, sf).chunks)


@query
def model_responses(spark, sf):
    return models.model_responses(D.responses(spark, sf))


@query
def model_answers_prospect(spark, sf):
    return answers.answer_objects(answers.parsed(D.kind_answers(spark, sf)), "prospect")


@query
def model_answers_colors(spark, sf):
    return answers.answer_objects(answers.parsed(D.kind_answers(spark, sf)), "colors")


@query
def model_answers_audit(spark, sf):
    return answers.answer_objects(answers.parsed(D.kind_answers(spark, sf)), "audit")


@query
def model_answer_items(spark, sf):
    rows = answers.parsed(D.kind_answers(spark, sf))
    found = [answers.answer_items(rows, kind).withColumn("kind", F.lit(kind)) for kind in answers.LISTS]
    return found[0].union(found[1]).union(found[2]).withColumnRenamed("group", "list")


@query
def model_answer_texts(spark, sf):
    return answers.answer_texts(D.kind_answers(spark, sf))


@query
def model_apply(spark, sf):
    def score(frame):
        return frame.assign(score=frame["text"].str.len()).drop(columns="text")

    return models.model_apply(
        documents(spark, sf).select("doc_id", "text"), score, "doc_id bigint, score bigint"
    )


@query
def model_price(spark, sf):
    return D.usage(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n")).select(
        "model", "n", F.expr(P.price("model", "input")).alias("input"),
        F.expr(P.price("model", "output")).alias("output"),
    )


@query
def model_price_table(spark, sf):
    """Prices of the day from a table, per model and day of a call."""
    calls = D.dated_usage(spark, sf).select("model", "called_at").distinct()
    return costs.price_of(calls, D.price_table(spark, sf), at="called_at").withColumn(
        "called_at", F.date_format("called_at", "yyyy-MM-dd")
    )


@query
def cost_at_prices(spark, sf):
    return costs.cost_at_prices(D.dated_usage(spark, sf), D.price_table(spark, sf), at="called_at")


@query
def cost_by_model(spark, sf):
    return costs.cost_by_model(D.usage(spark, sf))


@query
def cost_estimate(spark, sf):
    return costs.cost_estimate(D.usage(spark, sf))


@query
def cost_flat(spark, sf):
    return costs.cost_flat(D.usage(spark, sf))


# --- companies and prospects ----------------------------------------------------------------
def described(spark, sf):
    return company.company_pages(S.fetched(D.crawl(spark, sf)), crawl_reach(spark, sf))


@query
def company_pages(spark, sf):
    return described(spark, sf)


@query
def company_summary(spark, sf):
    bases = links.homepages(S.fetched(D.crawl(spark, sf)))
    return company.company_summary(described(spark, sf), bases)


@query
def scan_prospect_list(spark, sf):
    """Three requests; every fifth page is asked for by a second one."""
    pid = F.col("page_id")
    asked = F.array_compact(F.array(pid % 3, F.when(pid % 5 == 0, (pid + 1) % 3)))
    return S.prospect_list(D.crawl(spark, sf).select(
        F.explode(asked).alias("request_id"), F.concat(F.lit(" \t"), "url", F.lit(" ")).alias("url")
    ))


def prospects(spark, sf):
    return company.prospect_texts(scan_prospect_list(spark, sf), S.fetched(D.crawl(spark, sf)))


def personas(spark, sf):
    return S.table(spark, sf, "benchmark").select(
        (F.col("item_id") % 3).alias("request_id"), F.col("item_id").alias("persona_id"), "text"
    )


@query
def prospect_score(spark, sf):
    return company.prospect_score(prospects(spark, sf), personas(spark, sf))


@query
def prospect_status(spark, sf):
    return company.prospect_status(prospects(spark, sf))


# --- jobs and runs --------------------------------------------------------------------------
@query
def jobs_list(spark, sf):
    return runs.jobs_list(D.job_events(spark, sf))


@query
def job_latest(spark, sf):
    return runs.job_latest(D.job_events(spark, sf))


@query
def progress_localise(spark, sf):
    return D.job_events(spark, sf).select(
        "event_id", F.expr(runs.localise_progress("progress")).alias("progress_fa")
    )


@query
def run_flatten(spark, sf):
    return runs.run_flatten(runs.runs(D.job_events(spark, sf)))


@query
def run_summary(spark, sf):
    return runs.run_summary(runs.runs(D.job_events(spark, sf)))


@query
def run_totals(spark, sf):
    return runs.run_totals(runs.runs(D.job_events(spark, sf)))


# --- page elements --------------------------------------------------------------------------
@query
def element_inventory(spark, sf):
    return elements.element_inventory(D.element_pages(spark, sf)).select(
        "page_id", "category", "selector", F.col("element.no").alias("element_no"),
        F.col("element.tag").alias("tag"), F.col("element.text").alias("text"),
    )


@query
def element_xpaths(spark, sf):
    return elements.element_xpaths(D.element_pages(spark, sf)).select(
        "page_id", "category", "selector", "element_no", "xpath_no", "xpath"
    )


@query
def page_xpaths(spark, sf):
    return elements.page_xpaths(D.element_pages(spark, sf).select("page_id", "html"))


@query
def selector_coverage(spark, sf):
    return elements.selector_coverage(D.element_pages(spark, sf))


# --- sinks: written below the shared folder and read back -----------------------------------
GENERATED, STAMP = "2024-01-01 00:00:00", "20240101_000000"


def reports(spark, sf):
    kb = built(spark, sf)
    n = kb.chunks.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    return (
        kb.documents.join(kb.bases, "site").join(kb.audit(), "site").join(n, "site", "left")
        .withColumn("pages", F.coalesce("pages", F.lit(0)).cast("bigint"))
        .withColumn("job_id", F.md5("site")).withColumn("depth", F.lit("deep"))
        .withColumn("cost", F.expr(P.usd(P.flat_cost("final_doc_tokens", "0"))))
        .join(kb.summary().select("site", "analysis_summary"), "site")
    )


@query
def sink_kb_markdown(spark, sf):
    path = new_shared_path(spark, "kb_markdown")
    sinks.write_kb_markdown(sinks.kb_markdown(reports(spark, sf), GENERATED, STAMP), path)
    return sinks.read_kb_markdown(spark, path)


@query
def sink_kb_metadata(spark, sf):
    path = new_shared_path(spark, "kb_metadata")
    rows = sinks.kb_metadata(reports(spark, sf), GENERATED, STAMP)
    sinks.write_kb_metadata(rows, path)
    m = "metadata"
    return spark.read.schema(rows.schema).json(path).select(
        "site", "name", f"{m}.job_id", f"{m}.url", f"{m}.knowledge_base_file",
        f"{m}.extracted_pages_count", f"{m}.detected_target_language",
        f"{m}.cost_estimation.total_cost_usd", f"{m}.analysis_summary", f"{m}.quality_report.has_email", f"{m}.quality_report.doc_tokens",
        F.array_join(f"{m}.quality_report.missing", ",").alias("missing"),
    )


@query
def sink_prospect_csv(spark, sf):
    path = new_shared_path(spark, "prospects")
    sinks.write_csv(
        sinks.prospect_rows(company.prospect_report(prospects(spark, sf), personas(spark, sf))), path,
        by=["request_id"],
    )
    return sinks.read_csv(spark, path, V.PROSPECT_COLUMNS, "request_id bigint")


@query
def sink_run_csv(spark, sf):
    path = new_shared_path(spark, "runs")
    sinks.write_csv(run_flatten(spark, sf), path)
    return sinks.read_csv(spark, path, V.RUN_COLUMNS).withColumn(
        "duration_seconds", F.col("duration_seconds").cast("double")
    )


# --- streams: run to the end of the given files ---------------------------------------------
@query
def page_stream(spark, sf):
    out = new_shared_path(spark, "page_stream")
    given = S.table(spark, sf, "pages").select("page_id", "url", "html")  # a table that is not there is an error
    source = stream_pages.read_pages(spark, stream_pages.table_files(f"{sf.rstrip('/')}/pages.parquet"), None)
    stream_pages.start(source, out, out + "-state").awaitTermination()
    return spark.read.schema(stream_pages.page_facts(given).schema).parquet(out)


@query
def job_progress_stream(spark, sf):
    out = new_shared_path(spark, "job_progress")
    schema = S.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(stream_pages.table_files(f"{sf.rstrip('/')}/events.parquet"))
    stream_jobs.start(D.as_job_events(raw), out, out + "-state").awaitTermination()
    return stream_jobs.current(spark, out)
