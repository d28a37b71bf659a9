"""The full chain: crawled pages of all sites to one knowledge-base document per site."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sitelore.functions import urls as U, vocab as V
from sitelore.functions.ranges import in_ranges, running
from sitelore.functions.scale import measured, reused, salted_join
from sitelore.operators import clusters, content, discovery, document, links, parts, prefilter, sections
from sitelore.sources.tables import fetched


@dataclass(frozen=True)
class KnowledgeBase:
    """Tables of one run, each usable on its own."""

    bases: DataFrame
    candidates: DataFrame
    selected: DataFrame
    chunks: DataFrame
    contacts: DataFrame
    languages: DataFrame
    sections: DataFrame
    documents: DataFrame

    def summary(self) -> DataFrame:
        return document.kb_summary(
            self.bases, self.candidates, self.selected, self.chunks, self.documents, self.contacts,
            prefilter.dropped_by_reason(self.candidates),
        )

    def parts(self, size: int = V.PART_CHARS) -> DataFrame:
        """The documents in parts of ``size`` characters, uncondensed; for sites of any length."""
        return parts.parts_of(parts.document_pieces(self.chunks, self.contacts, self.languages, self.bases), size)

    def audit(self) -> DataFrame:
        return document.completeness_audit(self.documents, self.contacts)


#: Places of one source in the list of candidates; page numbers stay below it.
SOURCE_STEP = 1_000_000_000_000


def build(
    pages: DataFrame, budget: int = V.PAGE_BUDGET_DEFAULT, target: int | None = None,
    max_chars: int | None = None, mode: str = "deep", discovered: DataFrame | None = None,
    requests: DataFrame | None = None,
) -> KnowledgeBase:
    """Knowledge bases of every site in ``pages`` (page_id, site, url, html[, status, content_type]).

    ``mode`` says which pages are read: ``deep`` selects from all candidates under the budget, ``core``
    takes the start page and the core paths, ``specified`` the addresses of ``requests`` (site, url,
    pos).  Candidates are the crawled pages, or those addresses of ``discovered`` (site, source, url;
    see ``discovery.discover_candidates``) that were crawled.

    Addresses are filtered, ranked and cut on narrow columns; only then is HTML read, once, for
    the selected pages.  The chunks feed contacts, language and sections and are kept for them.
    """
    good = fetched(pages)
    bases = reused(links.homepages(good))  # one row per site, read by the selection, the documents and the summary
    candidates = good.select("site", F.col("page_id").alias("pos"), "url")
    addresses = good.groupBy("site", F.expr(U.normalize("url")).alias("url")).agg(F.min("page_id").alias("page_id"))
    if discovered is not None:
        found = discovered.select("site", "source", F.expr(U.normalize("url")).alias("url"))
        candidates = salted_join(found, addresses, ["site", "url"]).select(
            "site", (F.col("source") * SOURCE_STEP + F.col("page_id")).alias("pos"), "url"
        )
    if mode == "deep":
        picked = clusters.select_pages(bases, prefilter.prefilter_urls(candidates), budget).withColumn(
            "page_id", F.col("pos") % SOURCE_STEP  # candidates stand at their page number
        ).drop("pos")
    elif mode in ("core", "specified"):
        rows = (
            discovery.core_pages(bases, good) if mode == "core" else discovery.specified_pages(bases, requests, good)
        ).select("site", "ord", F.expr(U.normalize("url")).alias("url"))
        once = rows.groupBy("site", "url").agg(F.min("ord").alias("ord"))
        found = in_ranges(once.join(addresses, ["site", "url"]), ["site"], ["ord", "url"])  # no limit on a site's addresses
        picked = running(found, ["site"], ["ord", "url"], {"rank": F.lit(1).cast("bigint")}).select(
            "site", "rank", "url", F.lit(V.START_CLUSTER).alias("cluster"), "page_id"
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    selected = measured(picked)  # by its size Spark tells whether HTML can stay where it is
    chunks = content.selected_chunks(good, selected, max_chars)
    contacts = reused(content.site_contacts(chunks))
    languages = content.site_language(chunks)
    bodies = sections.section_docs(sections.section_merge(chunks), contacts)
    documents = reused(document.assemble_document(bodies, languages, bases, target))
    return KnowledgeBase(bases, candidates, selected, chunks, contacts, languages, bodies, documents)
