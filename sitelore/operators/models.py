"""Tables around a model: what is asked, what came back, and a seat for a batch scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from sitelore.functions import pricing as P, text as X, vocab as V
from sitelore.functions.let import let, lit
from sitelore.operators.sections import RULE, token_batches

ANSWER = "_bad string, url string, title_suggestion string, primary_category string, extracted_chunk string"


def model_requests(chunks: DataFrame, batch_tokens: int = V.BATCH_TOKENS) -> DataFrame:
    """Request rows with their size and highest price: one per page, one per section batch."""
    page = chunks.select(
        "site", F.lit("page_extraction").alias("kind"), F.col("url").alias("ref"),
        F.col("chunk").alias("text"), F.lit("cheap").alias("tier"),
    )
    batches = token_batches(chunks, batch_tokens).select("site", "section", "pos", "batch")
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]), RULE
    )
    section = (
        chunks.join(batches, ["site", "section", "pos"])
        .groupBy("site", "section", "batch").agg(text.alias("text"))
        .select(
            "site", F.lit("section_synthesis").alias("kind"),
            F.concat_ws("#", "section", F.col("batch").cast("string")).alias("ref"), "text",
            F.lit("strong").alias("tier"),
        )
    )
    limit = F.create_map(*[F.lit(x) for p in V.MAX_OUTPUT_TOKENS.items() for x in p])
    sized = page.unionByName(section).withColumn("tokens", F.expr(X.tokens("text"))).withColumn(
        "max_output_tokens", limit[F.col("kind")].cast("bigint")
    )
    return sized.withColumn(
        "max_cost_usd", F.expr(P.cost(lit(V.CHEAP_MODEL), "tokens", "max_output_tokens"))
    )


def answer_json(content: str) -> str:
    """JSON part of a model answer: inside a json fence, else inside any fence, else all of it."""
    tagged, plain = lit("(?s)```json(.*?)```"), lit("(?s)```(.+)```")
    part = f"""CASE WHEN contains(answer, '```json') THEN
          CASE WHEN answer RLIKE {tagged} THEN regexp_extract(answer, {tagged}, 1) ELSE answer END
        WHEN answer RLIKE {plain} THEN regexp_extract(answer, {plain}, 1) ELSE answer END"""
    return let("answer", X.strip(f"coalesce({content}, '')"), X.strip(part))


def model_responses(responses: DataFrame) -> DataFrame:
    """Typed rows from answers (request_id, page_url, page_title, content); defaults when unreadable."""
    body = F.expr(answer_json("content"))
    parsed = responses.withColumn("body", body).withColumn(
        "a",
        F.when(
            F.col("body").rlike(r"(?s)^\{.*\}$"),
            F.from_json("body", ANSWER, {
                "allowSingleQuotes": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad",
            }),
        ),
    ).withColumn("a", F.when(F.col("a._bad").isNull() & (F.json_array_length(F.concat(F.lit("["), "body", F.lit("]"))) == 1), F.col("a")))
    category = F.expr(f"lower({X.strip("coalesce(a.primary_category, '')")})")
    return parsed.select(
        "request_id",
        F.coalesce("a.url", "page_url").alias("url"),
        F.coalesce("a.title_suggestion", "page_title").alias("title_suggestion"),
        F.when(category.isin(*V.SECTIONS), category).otherwise("additional").alias("primary_category"),
        F.coalesce("a.extracted_chunk", F.lit("")).alias("extracted_chunk"),
    )


def model_apply(
    rows: DataFrame, score: Callable, schema: T.StructType | str
) -> DataFrame:
    """Apply a user's batch scorer: pandas frame in, pandas frame out, in Arrow batches per task."""

    def batches(frames: Iterator) -> Iterator:
        for frame in frames:
            yield score(frame)

    return rows.mapInPandas(batches, schema)
