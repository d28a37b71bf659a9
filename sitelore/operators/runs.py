"""Job states and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitelore.functions import vocab as V
from sitelore.functions.let import let, lit


def localise_progress(message: str) -> str:
    """Persian text of a progress message: page pattern, then the first message it contains."""
    part = lambda n: f"regexp_extract(m, {lit(V.PAGE_PROGRESS_RE)}, {n})"
    tests = " ".join(
        f"WHEN contains(m, {lit(english)}) THEN {lit(persian)}" for english, persian in V.PROGRESS_FA.items()
    )
    return let("m", message, f"""CASE WHEN m RLIKE {lit(V.PAGE_PROGRESS_RE)}
        THEN concat({lit(V.PAGE_PROGRESS_FA)}, {part(1)}, ': ', {part(2)}) {tests} ELSE m END""")


def stamp(ts: Column) -> Column:
    """Wall-clock text, the same in every session time zone."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _when() -> Column:
    return F.struct("ts", "event_id")


def job_latest(events: DataFrame, preview: int = V.PREVIEW_CHARS) -> DataFrame:
    """Latest state per job; the document in full only when the job is completed."""
    has_doc = F.when(F.col("document").isNotNull() & (F.col("document") != ""), _when())
    state = events.groupBy("job_id").agg(
        F.max_by("status", _when()).alias("status"),
        F.max_by("progress", _when()).alias("progress"),
        F.max_by("document", has_doc).alias("document"),
    )
    return state.select(
        "job_id", "status", "progress", F.expr(localise_progress("progress")).alias("progress_fa"),
        F.concat(F.substring("document", 1, preview), F.lit("...")).alias("preview"),
        F.when(F.col("status") == "completed", F.col("document")).alias("document"),
    )


def jobs_list(events: DataFrame) -> DataFrame:
    """One row per job, newest first; jobs without a creation time come last."""
    finished = F.col("status").isin("completed", "failed")
    rows = events.groupBy("job_id").agg(
        F.max_by("job_type", _when()).alias("job_type"),
        F.max_by("status", _when()).alias("status"),
        F.min("ts").alias("created"),
        F.max("ts").alias("last"),
    )
    return rows.orderBy(F.desc_nulls_last("created"), "job_id").select(
        "job_id", "job_type", "status", stamp(F.col("created")).alias("created_at"),
        F.when(finished, stamp(F.col("last"))).alias("finished_at"),
    )


def runs(events: DataFrame) -> DataFrame:
    """One nested run record per job; a job that never finished counts as timed out."""
    latest = events.groupBy("job_id").agg(
        F.max_by("status", _when()).alias("state"),
        F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.max("done").alias("pages_processed"),
        F.max_by("document", F.when(F.col("document").isNotNull(), _when())).alias("knowledge_base"),
        F.sum("done").alias("prompt_tokens"), F.count(F.lit(1)).alias("completion_tokens"),
    )
    status = F.when(F.col("state").isin("completed", "failed"), F.col("state")).otherwise("timeout")
    micros = F.expr("timestampdiff(MICROSECOND, `start`, `end`)")
    hex_byte = F.lpad(F.lower(F.hex(F.col("job_id") % 256)), 2, "0")
    color = F.concat(F.lit("#"), hex_byte, hex_byte, hex_byte)
    return latest.select(
        F.concat(F.lit("https://site"), F.col("job_id").cast("string"), F.lit(".example.org/")).alias("url"),
        status.alias("status"), F.col("job_id").cast("string").alias("job_id"),
        stamp(F.col("start")).alias("start_time"), stamp(F.col("end")).alias("end_time"),
        (micros / F.lit(1_000_000)).alias("duration_seconds"), "pages_processed",
        F.struct(
            color.alias("main_background_color"),
            F.lit(V.DEFAULT_BRAND).alias("primary_brand_color"),
            F.lit("from run").alias("background_color_description"),
            F.lit(None).cast("string").alias("brand_color_description"),
        ).alias("website_colors"),
        F.when(
            status != "timeout",
            F.struct(
                F.format_string("%d.%06d", F.floor(F.col("prompt_tokens") / 1_000_000), F.col("prompt_tokens") % 1_000_000).alias("total_cost_usd"),
                "prompt_tokens", "completion_tokens",
            ),
        ).alias("cost_estimation"),
        F.when(status == "failed", "job failed").alias("error"), "knowledge_base",
    )


def run_flatten(runs: DataFrame) -> DataFrame:
    """Sixteen flat columns of nested run records; missing parts are empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    colors = [c for c in V.RUN_COLUMNS if c.endswith(("_color", "_color_description"))]
    source = {c: f"website_colors.{c}" for c in colors} | {
        c: f"cost_estimation.{c}" for c in ("total_cost_usd", "prompt_tokens", "completion_tokens")
    }
    special = {
        "duration_seconds": F.col("duration_seconds"),
        "pages_processed": F.coalesce("pages_processed", F.lit(0)).cast("bigint"),
        "knowledge_base_length": F.length(F.coalesce("knowledge_base", F.lit(""))).cast("bigint"),
    }
    return runs.select(
        *[special.get(c, empty(source.get(c, c))).alias(c) for c in V.RUN_COLUMNS]
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals over all runs."""
    count = lambda s: F.count_if(F.col("status") == s)
    whole = F.sum(F.round(F.col("duration_seconds") * 1_000_000).cast("bigint"))
    return runs.agg(
        F.count(F.lit(1)).alias("total"), count("completed").alias("completed"),
        count("failed").alias("failed"), count("timeout").alias("timed_out"),
        (whole / F.lit(1_000_000)).alias("total_duration_seconds"),
    )


def run_totals(runs: DataFrame) -> DataFrame:
    """Runs, pages and seconds per (day, status), per day and in all; ``level`` 0, 1 and 3."""
    micros = F.sum(F.round(F.col("duration_seconds") * 1_000_000).cast("bigint"))
    return runs.select(F.substring("start_time", 1, 10).alias("day"), "status", "duration_seconds", "pages_processed").rollup(
        "day", "status"
    ).agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.coalesce("pages_processed", F.lit(0))).cast("bigint").alias("pages"),
        (micros / F.lit(1_000_000)).alias("seconds"), F.grouping_id().cast("int").alias("level"),
    )
