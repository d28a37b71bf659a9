"""From documents to packed sequences, each stage by one operator of ``sitelore.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's documents.  All stages but the last return the
columns of their documents.  No stage drops a clean document: the language stage drops texts without
letters and texts without an n-gram of a profile, the next two leave one document of each group of copies, the
mix reads every source at least once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelore.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from sitelore.llm.common import shared_dir

#: Near copies: shingles of five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def _free_name(docs: DataFrame, name: str) -> str:
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share an n-gram with a language learned from the labelled ones; the rest go.

    The score is 0 where no n-gram of the text is in any profile, and above 0 elsewhere.  Null, empty and
    letterless texts go.  Where nothing is labelled nothing can be judged, and all
    documents with a text stay.
    """
    profiles = language_id.learn(docs)
    names = _free_name(docs, "lang_pred"), _free_name(docs, "score")
    rated = language_id.identify(docs, profiles, names=names)
    if profiles.langs:
        rated = rated.filter((F.col(names[0]) != language_id.UNKNOWN) & (F.col(names[1]) > 0))
    else:
        rated = rated.filter(F.length("text") > 0)
    return rated.select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of near copies.

    Documents without words stay, and so do documents with a null id unless they are linked to one
    that has an id.  Rows that repeat an id stay or go together.
    """
    linked = jaccard_join.link_documents(docs, WORDS, PERCENT)
    stay = linked.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stays"]), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources up to twice, by temperature of the shares of tokens."""
    tokens = _free_name(docs, "n_tokens")
    mixed = mixing.mix_sources(mixing.with_tokens(docs, docs.columns, tokens), tokens=tokens)
    return mixed.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("pack", pack),
]

#: Language profiles, similarity joins at this scale and tokenizers are beyond SQL; tests go by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
