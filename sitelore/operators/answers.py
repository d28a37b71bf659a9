"""Rows from model answers of every kind: parsed once as VARIANT, nested lists to rows, typed defaults.

An answer that can't be read, or whose fields have another type, gets the defaults of its kind; a list counts
its readable items only.  Free texts (introduction, condensed section, page and company descriptions) are
trimmed answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitelore.functions import text as X, vocab as V
from sitelore.functions.let import lit
from sitelore.operators.models import answer_json

#: kind -> (field, type, default) of answers that are one object.
OBJECTS = {
    "prospect": (
        ("is_potential_customer", "boolean", False), ("confidence_score", "int", 0),
        ("reasoning_for", "string", ""), ("reasoning_against", "string", ""),
    ),
    "colors": (
        ("main_background_color", "string", V.DEFAULT_BACKGROUND), ("primary_brand_color", "string", V.DEFAULT_BRAND),
        ("background_color_description", "string", V.BACKGROUND_FALLBACK), ("brand_color_description", "string", V.BRAND_FALLBACK),
    ),
    "audit": (
        ("has_contact", "boolean", False), ("has_policies", "boolean", False), ("has_faq", "boolean", False),
        ("has_services", "boolean", False), ("notes", "string", ""),
    ),
}
#: kind -> (group, path of its list of strings) of answers that are lists.
LISTS = {
    "categories": tuple((c, f"$.{c}") for c in V.ANSWER_CATEGORIES),
    "clusters": (*((c, f"$.{c}.urls") for c in V.CLUSTERS), ("priority_extraction_order", "$.priority_extraction_order")),
    "audit": (("missing", "$.missing"),),
}
TEXTS = ("page_description", "company_summary", "introduction", "condensed")


def parsed(responses: DataFrame) -> DataFrame:
    """The rows with ``v``, the answer as VARIANT; null where it is no JSON object."""
    body = f"try_parse_json({answer_json('content')})"
    whole = responses.withColumn("v", F.expr(body))
    return whole.withColumn("v", F.expr("CASE WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN v END"))


def answer_objects(rows: DataFrame, kind: str) -> DataFrame:
    """request_id, readable and the fields of one kind from parsed rows, with defaults."""
    fields = [
        F.coalesce(F.expr(f"try_variant_get(v, '$.{name}', '{of}')"), F.lit(default).cast(of)).alias(name)
        for name, of, default in OBJECTS[kind]
    ]
    return rows.filter(F.col("kind") == kind).select("request_id", F.col("v").isNotNull().alias("readable"), *fields)


def answer_items(rows: DataFrame, kind: str) -> DataFrame:
    """request_id, group, item_no, item: the items of the lists of one kind from parsed rows, in order."""
    lists = ", ".join(
        f"named_struct('group', {lit(group)}, 'items', try_variant_get(v, {lit(path)}, 'array<variant>'))"
        for group, path in LISTS[kind]
    )
    texts = "filter(transform(l.items, x -> try_variant_get(x, '$', 'string')), x -> x IS NOT NULL)"
    return (
        rows.filter(F.col("kind") == kind).select("request_id", F.explode(F.expr(f"array({lists})")).alias("l"))
        .select("request_id", F.col("l.group").alias("group"), F.posexplode(F.expr(texts)).alias("item_no", "item"))
        .withColumn("item_no", (F.col("item_no") + 1).cast("bigint"))
    )


def answer_texts(responses: DataFrame) -> DataFrame:
    """request_id, kind, text of answers in free text; empty where there is none."""
    return responses.filter(F.col("kind").isin(*TEXTS)).select(
        "request_id", "kind", F.expr(X.strip("coalesce(content, '')")).alias("text")
    )
