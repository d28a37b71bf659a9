"""Report sinks: Markdown documents, JSON metadata, prospect and run CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitelore.functions import urls as U, vocab as V

CSV = {"header": "true", "escape": '"', "multiLine": "true", "emptyValue": ""}


def report_name(stamp: str, kind: str, suffix: str) -> Column:
    """File name from columns base_url and job_id."""
    domain = f"replace(replace({U.netloc('base_url')}, 'www.', ''), '.', '_')"
    return F.expr(f"concat('{kind}_', {domain}, '_{stamp}_', substring(job_id, 1, 8), '{suffix}')")


def kb_markdown(reports: DataFrame, generated: str, stamp: str) -> DataFrame:
    """(site, name, content): header block, rule and document.

    ``reports``: site, job_id, base_url, lang, pages, cost, depth, document and the audit columns.
    """
    flags = F.concat_ws(
        ", ",
        *[F.when(F.col(f), F.lit(f)) for f in
          ("has_contact", "has_email", "has_phone", "has_policies", "has_faq", "has_services")],
    )
    missing = F.when(F.col("missing") != "", F.concat(F.lit("; missing="), F.replace("missing", F.lit(","), F.lit(", "))))
    line = lambda label, value: F.concat(F.lit(f"**{label}:** "), value)
    header = F.concat_ws(
        "\n",
        F.lit("# Knowledge Base Report\n"),
        line("Generated", F.lit(generated)),
        line("Job ID", F.col("job_id")),
        line("Source URL", F.col("base_url")),
        line("Language", F.coalesce("lang", F.lit("unknown"))),
        line("Pages Processed", F.col("pages").cast("string")),
        line("Screenshot Captured", F.lit("False")),
        line("Total Cost", F.concat(F.lit("$"), F.coalesce("cost", F.lit("0.00")))),
        line("Depth", F.col("depth")),
        line("Models", F.lit(f"cheap={V.CHEAP_MODEL} / strong={V.CHEAP_MODEL}")),
        line("Completeness", F.concat(
            F.lit("present="), F.coalesce(F.nullif(flags, F.lit("")), F.lit("none")), F.coalesce(missing, F.lit("")))),
    )
    return reports.select(
        "site", report_name(stamp, "knowledge_base", ".md").alias("name"),
        F.concat(header, F.lit("\n\n---\n\n"), F.col("document")).alias("content"),
    )


def write_kb_markdown(markdown: DataFrame, path: str, packed: bool = False) -> None:
    """Documents as Markdown text, each in a folder of its site and file name.

    Millions of folders would burden any file system; ``packed`` writes JSON lines (site, name,
    content) instead.
    """
    if packed:
        markdown.write.mode("overwrite").json(path)
    else:
        rows = markdown.select("site", "name", F.col("content").alias("value"))
        rows.write.mode("overwrite").partitionBy("site", "name").text(path)


def read_kb_markdown(spark, path: str) -> DataFrame:
    """(site, name, content) of the Markdown files that ``write_kb_markdown`` wrote."""
    files = spark.read.schema("value string, site string, name string").text(path, wholetext=True)
    return files.select("site", "name", F.expr("substring(value, 1, length(value) - 1)").alias("content"))


def kb_metadata(reports: DataFrame, generated: str, stamp: str) -> DataFrame:
    """(site, name, metadata) with nested statistics."""
    nested = F.struct(
        "job_id", F.col("base_url").alias("url"), F.lit(generated).alias("generated_at"),
        report_name(stamp, "knowledge_base", ".md").alias("knowledge_base_file"),
        F.col("pages").alias("extracted_pages_count"), F.col("lang").alias("detected_target_language"),
        "depth", F.struct(F.col("cost").alias("total_cost_usd")).alias("cost_estimation"), "analysis_summary",
        F.struct(
            "has_email", "has_phone", "doc_tokens", "has_contact", "has_policies", "has_faq",
            "has_services", F.filter(F.split("missing", ","), lambda m: m != "").alias("missing"),
        ).alias("quality_report"),
    )
    return reports.select(
        "site", report_name(stamp, "metadata", ".json").alias("name"),
        nested.alias("metadata"),
    )


def write_kb_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(path)


def prospect_rows(report: DataFrame) -> DataFrame:
    """Seven flat columns and the request; a prospect without analysis has empty fields."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = {"website": "url"}
    return report.select(*[text(source.get(c, c)).alias(c) for c in V.PROSPECT_COLUMNS], "request_id")


def write_csv(rows: DataFrame, path: str, by: list[str] = ()) -> None:
    """CSV files; with ``by``, in one folder per value."""
    writer = rows.write.mode("overwrite").options(**{k: v for k, v in CSV.items() if k != "multiLine"})
    writer.partitionBy(*by).csv(path)


def read_csv(spark, path: str, columns, by: str | None = None) -> DataFrame:
    """What ``write_csv`` wrote; empty fields come back as empty text."""
    schema = ", ".join([*(f"{c} string" for c in columns), *([by] if by else [])])
    return spark.read.schema(schema).options(**CSV).csv(path).fillna("")
