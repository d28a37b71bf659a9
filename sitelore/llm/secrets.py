"""Secret scans over an incremental ledger of content-addressed texts.

A ledger is a folder in the shared store with two tables: ``scanned`` (blob, rules: every pair of a
text's SHA-256 and a version of the rules that was scanned) and ``findings`` (blob, rules, spans).  A
scan hashes every version of every path, reads only the texts of pairs that are not in the ledger, adds
them, and joins the findings of all blobs back to all paths and versions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelore.llm.common import skew_join, small_batches

_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join(re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", n) for n in _NAMES)

#: kind, pattern, group that is measured, least length of that group; the base kinds come first.
RULES = (
    ("assign", f"({_EITHER}){_VALUE}", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("forge", r"(?:gh[pousr]|glpat)[_-][A-Za-z0-9_]{20,}", 0, 0),
)
BASE, RULES_VERSION = ("assign", "access", "hex"), "rules-1"

FINDINGS = "blob string, rules string, spans array<struct<kind: int, start: bigint, end: bigint>>"


def find_spans(text: str, rules=RULES) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) in code points by start, then kind; leftmost first per kind."""
    found = []
    for k, (_, pattern, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end()))
    return [(k, a, b) for a, k, b in sorted(found)]


def _scan(rules, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            blobs, spans = [], []
            for blob, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if got := find_spans(text.as_py() or "", rules):
                    blobs.append(blob)
                    spans.append([{"kind": k, "start": a, "end": b} for k, a, b in got])
            yield pa.RecordBatch.from_arrays(
                [pa.array(blobs, pa.string()), pa.array([version] * len(blobs), pa.string()), pa.array(spans, kind)],
                ["blob", "rules", "spans"],
            )

    return run


def _ledger(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of the ledger; without rows where none was written yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(f"{path}/{name}") if store.exists(folder) else spark.createDataFrame([], schema)


def scan_versions(
    versions: DataFrame, ledger: str, rules=RULES, version: str = RULES_VERSION, id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Findings of every path: doc_id, blob and spans (an empty list where nothing was found).

    Equal texts are one blob.  One row stands for each blob that the ledger lacks under this version of
    the rules; a row's text is read again for that, so that hashing sends no text anywhere.  The text
    moves to its blob only where Spark can't broadcast the list of new blobs.  The ledger is written
    before it is joined; a scan that dies halfway leaves at most findings that the next scan adds again,
    and those are read once per blob.

    Null texts count as empty.  Null and repeated ids keep their rows, rows that are wholly equal as
    well.  Other columns are not read.  An empty table gives no rows.
    """
    spark = versions.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    paths = versions.select(F.col(id_col).alias("doc_id"), F.sha2(body, 256).alias("blob"))
    done = _ledger(spark, ledger, "scanned", "blob string, rules string").filter(F.col("rules") == version)
    new = paths.groupBy("blob").agg(F.min("doc_id").alias("_id")).join(done.select("blob"), "blob", "left_anti")
    texts = versions.select(F.col(id_col).alias("_id"), body.alias("text")).join(
        new.select(F.col("_id").alias("_stands")).distinct(), F.col("_id").eqNullSafe(F.col("_stands")), "left_semi"
    ).select(F.sha2("text", 256).alias("blob"), "text")
    found = texts.mapInArrow(_scan(rules, version), FINDINGS)
    found.write.mode("append").parquet(f"{ledger}/findings")
    new.select("blob", F.lit(version).alias("rules")).write.mode("append").parquet(f"{ledger}/scanned")
    findings = (
        _ledger(spark, ledger, "findings", FINDINGS).filter(F.col("rules") == version)
        .groupBy("blob").agg(F.max("spans").alias("spans"))
    )
    return skew_join(paths, findings, ["blob"], "left").select(
        "doc_id", "blob", F.coalesce("spans", F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint>>)")).alias("spans")
    )


def digest(found: DataFrame, rules=RULES) -> DataFrame:
    """Counts and written spans of ``scan_versions`` per row."""
    names = ", ".join(f"'{r[0]}'" for r in rules)
    written = "array_join(transform({0}, s -> concat_ws(':', element_at(array(" + names + "), s.kind + 1), s.start, s.end)), ',')"
    base = f"filter(spans, s -> s.kind < {len(BASE)})"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as bigint)").alias(f"n_{n}") for k, n in enumerate(BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(F.expr(written.format(base)), 256).alias("base_sha256"),
        F.expr(written.format("spans")).alias("spans"),
    )
