"""Section bodies to one document per site under a token budget, with its audit.

A site has at most eight sections, so every window and group here is bounded by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitelore.functions import text as T, vocab as V
from sitelore.functions.let import let, lit, mapping

ORDER = {k: i for i, k in enumerate(V.SECTIONS)}
BOTH = ("company_overview", "products_services")  # the sections that the introduction is drawn from
PRIORITY = {k: i for i, k in enumerate(V.SECTION_PRIORITY)}


def _number(section: Column, numbers: dict[str, int]) -> Column:
    return F.expr(mapping(numbers))[section]


def section_title(section: str, lang: str) -> str:
    """Heading in the site's language, else English, else the key itself."""
    local = f"""CASE WHEN lower(coalesce({lang}, '')) = 'fa'
        THEN try_element_at({mapping(V.SECTIONS_FA)}, {section}) END"""
    return f"coalesce({local}, try_element_at({mapping(V.SECTIONS)}, {section}), {section})"


CONTENTS = f"array_join(transform(s, x -> concat('- ', {section_title('x.section', 'lang')})), '\\n')"


def toc(sections: DataFrame, languages: DataFrame) -> DataFrame:
    """Present sections and table of contents per site, in canonical order."""
    rows = sections.filter(~F.expr(T.is_blank("body"))).select("site", "section").join(languages, "site")
    listed = rows.groupBy("site", "lang").agg(
        F.array_sort(F.collect_list(F.struct(_number(F.col("section"), ORDER).alias("ord"), "section"))).alias("s")
    )
    return listed.select(
        "site",
        F.array_join(F.transform("s", lambda x: x["section"]), ",").alias("sections_present"),
        F.when(F.col("lang") == "fa", V.TOC_TITLE_FA).otherwise(V.TOC_TITLE).alias("heading"),
        F.expr(CONTENTS).alias("toc"),
    )


def overview_source(sections: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Text the introduction is drawn from: company overview, then products and services."""
    parts = sections.filter(F.col("section").isin(*BOTH))
    ordered = F.array_sort(F.collect_list(F.struct("section", "body")))  # c before p
    return parts.groupBy("site").agg(
        F.array_join(F.transform(ordered, lambda x: x["body"]), "\n\n").alias("overview")
    ).select("site", F.expr(T.cap("overview", max_chars)).alias("overview"))


def target_tokens(requested: Column) -> Column:
    """Requested document size brought into range; no number means the default."""
    number = F.when(requested.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(requested))
    # any number of digits: beyond eighteen it is out of range on either side anyway
    far = F.when(number.startswith("-"), F.lit(V.TARGET_TOKENS_MIN)).otherwise(F.lit(V.TARGET_TOKENS_MAX))
    asked = F.when(F.length(number) <= 18, F.expr("0L") + number.cast("bigint")).when(number.isNotNull(), far)
    asked = F.coalesce(asked, F.lit(V.TARGET_TOKENS_DEFAULT))
    return F.greatest(F.lit(V.TARGET_TOKENS_MIN), F.least(asked, F.lit(V.TARGET_TOKENS_MAX))).cast("bigint")


def compression_plan(sections: DataFrame, target: int | None = None) -> DataFrame:
    """Which sections to condense, lowest priority first, until the section tokens fit ``target``.

    Without a target nothing is condensed.  What condensing drops is in ``left_out``.

    What condensing a section saves does not depend on the others, so a running sum of the savings
    of lower-priority sections decides each one.
    """
    # a body that needs no condensing is not cut: its saving is 0 either way
    body = sections.withColumn("condensed", F.expr(T.leading_paragraphs("body", V.CONDENSE_TOKENS)))
    sized = body.withColumn("condensed_tokens", F.expr(T.tokens("condensed")))
    long = F.col("tokens") >= V.CONDENSE_MIN_TOKENS
    saving = F.when(long, F.col("tokens") - F.col("condensed_tokens")).otherwise(0)
    lowest_first = Window.partitionBy("site").orderBy(
        _number(F.col("section"), PRIORITY).desc()
    ).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("site")
    left = F.sum("tokens").over(whole) - F.coalesce(F.sum(saving).over(lowest_first), F.lit(0))
    fits = F.lit(False) if target is None else long & (left > target)
    return sized.withColumn("compress", fits).select(
        "site", "section", "tokens", "condensed_tokens", "compress",
        F.when(F.col("compress"), F.col("condensed")).otherwise(F.col("body")).alias("body"),
        F.col("body").alias("whole_body"),
    )


def left_out(sections: DataFrame, target: int) -> DataFrame:
    """(site, section, no, para): the paragraphs that condensing to ``target`` tokens drops or cuts."""
    plan = compression_plan(sections, target).filter("compress")
    kept = F.expr(f"size({T.paragraphs('body')})").alias("_kept")
    rows = plan.select(
        "site", "section", "body", kept, F.posexplode(F.expr(T.paragraphs("whole_body"))).alias("no", "para")
    )
    # a first paragraph that was cut is left out in part, so it is listed whole
    cut = (F.col("no") == 0) & ~F.expr("startswith(body, para)")
    return rows.filter((F.col("no") >= F.col("_kept")) | cut).select(
        "site", "section", F.col("no").cast("bigint").alias("no"), "para"
    )


def no_content(base_url: Column) -> Column:
    return F.concat(F.lit(V.NO_CONTENT), base_url, F.lit("."))


def assemble_document(
    sections: DataFrame, languages: DataFrame, bases: DataFrame, target: int | None = None
) -> DataFrame:
    """One document per site: introduction, contents, then each section under its title."""
    present = sections.filter(~F.expr(T.is_blank("body")))
    both = F.col("section").isin(*BOTH)
    # the introduction is drawn from the sections before they are condensed
    rows = compression_plan(present, target).withColumn("source", F.when(both, F.col("whole_body")))
    parts = rows.groupBy("site").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    _number(F.col("section"), ORDER).alias("ord"), "section", "body", "compress", "source"
                )
            )
        ).alias("s")
    )
    all_sites = bases.join(languages, "site", "left").withColumn(
        "lang", F.coalesce("lang", F.lit(V.DEFAULT_LANGUAGE))
    ).join(parts, "site", "left")
    source = "array_join(transform(s, x -> x.source), '\\n\\n')"
    intro = f"get(filter({T.paragraphs(source)}, line -> line <> '---'), 0)"
    heading = f"concat('## ', CASE WHEN lang = 'fa' THEN {lit(V.TOC_TITLE_FA)} ELSE {lit(V.TOC_TITLE)} END)"
    part = f"array(concat('## ', {section_title('x.section', 'lang')}), {T.strip('x.body')})"
    parts_ = f"concat(array_compact(array({intro}, {heading}, {CONTENTS})), flatten(transform(s, x -> {part})))"
    text = F.expr(T.strip(f"array_join({parts_}, '\\n\\n')"))
    names = lambda keep: F.array_join(
        F.transform(F.filter("s", keep), lambda x: x["section"]), ","
    )
    return all_sites.select(
        "site", "lang",
        F.coalesce(text, no_content(F.col("base_url"))).alias("document"),
        F.coalesce(names(lambda x: F.lit(True)), F.lit("")).alias("sections_present"),
        F.coalesce(names(lambda x: x["compress"]), F.lit("")).alias("compressed_sections"),
    ).withColumn("trimmed", F.col("compressed_sections") != "").withColumn(
        "final_doc_tokens", F.expr(T.tokens("document"))
    )


def completeness_audit(documents: DataFrame, contacts: DataFrame) -> DataFrame:
    """Which support-critical parts each document has and which it lacks."""
    present = F.split("sections_present", ",")
    has = {name: F.array_contains(present, key) for name, key in V.REQUIRED_SECTIONS.items()}
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    any_contact = given("emails") | given("phones")
    rows = documents.join(contacts, "site", "left")
    missing = F.array_compact(
        F.array(*[F.when(~known, F.lit(name)) for name, known in has.items()])
    )
    return rows.select(
        "site",
        (F.col("document").rlike(V.EMAIL_RE) | given("emails")).alias("has_email"),
        (F.col("document").rlike(V.DOC_PHONE_RE) | given("phones")).alias("has_phone"),
        F.col("final_doc_tokens").alias("doc_tokens"),
        (has["contact"] | any_contact).alias("has_contact"),
        has["policies"].alias("has_policies"),
        has["faq"].alias("has_faq"),
        has["services"].alias("has_services"),
        F.array_join(missing, ",").alias("missing"),
    )


def kb_summary(
    bases: DataFrame, candidates: DataFrame, selected: DataFrame, chunks: DataFrame,
    documents: DataFrame, contacts: DataFrame, dropped: DataFrame,
) -> DataFrame:
    """Counts of every stage per site, what was dropped by reason, and the summary sentence.

    ``dropped``: (site, reason, n), see ``prefilter.dropped_by_reason``; a site has a row per reason.
    """
    reasons = dropped.groupBy("site").agg(
        F.sum("n").alias("n_dropped"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("reason", "n"))),
                lambda x: F.concat_ws("=", x["reason"], x["n"].cast("string")),
            ),
            ",",
        ).alias("dropped_by_reason"),
    )
    found = candidates.groupBy("site").agg(F.count(F.lit(1)).alias("discovered"))
    by_type = selected.groupBy("site", "cluster").agg(F.count(F.lit(1)).alias("n"))
    types = by_type.groupBy("site").agg(
        F.sum("n").alias("total_pages_analyzed"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("cluster", "n"))),
                lambda x: F.concat_ws("=", x["cluster"], x["n"].cast("string")),
            ),
            ",",
        ).alias("pages_by_type"),
    )
    extracted = chunks.groupBy("site").agg(F.count(F.lit(1)).alias("extracted_pages_count"))
    out = bases.select("site")
    for part in (found, reasons, types, extracted, documents.drop("document"), contacts):
        out = out.join(part, "site", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    n_sections = F.when(F.col("sections_present") == "", 0).otherwise(
        F.size(F.split("sections_present", ","))
    )
    return out.select(
        "site", "lang", n("discovered").alias("discovered"),
        (n("discovered") - n("n_dropped")).alias("kept"),
        F.coalesce("dropped_by_reason", F.lit("")).alias("dropped_by_reason"),
        n("total_pages_analyzed").alias("total_pages_analyzed"),
        n("extracted_pages_count").alias("extracted_pages_count"),
        F.coalesce("pages_by_type", F.lit("")).alias("pages_by_type"),
        "sections_present", "compressed_sections", "final_doc_tokens",
        F.coalesce("emails", F.lit("")).alias("emails"), F.coalesce("phones", F.lit("")).alias("phones"),
        F.format_string(
            V.SUMMARY_FORMAT,
            n("discovered"), n("total_pages_analyzed"), n("extracted_pages_count"), n_sections.cast("bigint"),
        ).alias("analysis_summary"),
    )
