"""Chunks to sections: token batches, first-wins paragraph merge, partial and final."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sitelore.functions import contacts as C, text as T, vocab as V
from sitelore.functions.let import lit
from sitelore.functions.ranges import in_ranges, running
from sitelore.functions.scale import checkpointed

RULE = V.CHUNK_RULE


def section_chunks(chunks: DataFrame, contacts: DataFrame | None = None) -> DataFrame:
    """Chunks and tokens per (site, section); ``contact`` also appears for contacts alone."""
    canonical = F.when(F.col("section").isin(*V.SECTIONS), F.col("section")).otherwise("additional")
    grouped = chunks.groupBy("site", canonical.alias("section")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("tokens").alias("tokens")
    )
    if contacts is None:
        return grouped
    alone = contacts.select("site", F.lit("contact").alias("section")).join(
        grouped, ["site", "section"], "left_anti"
    )
    zero = F.lit(0).cast("bigint")
    return grouped.unionByName(
        alone.withColumn("n_chunks", zero).withColumn("tokens", zero)
    )


def token_batches(chunks: DataFrame, budget: int = V.BATCH_TOKENS) -> DataFrame:
    """(site, section, pos, tokens, batch): greedy packing in order under a token budget.

    A batch closes when the next text would exceed the budget; an oversize text stands alone.
    Texts lie on a line of tokens; a batch that starts with text i is followed by one that starts with
    the text over the place ``budget`` behind i's, which is found among the texts of one stretch of the
    line.  The starts are those that are reached from a section's first text; jumps over 1, 2, 4 … batches
    find them in as many rounds as the logarithm of the batches.  No section is gathered in a row or task.
    """
    keys = ["site", "section"]
    weight = F.greatest("tokens", F.lit(1).cast("bigint"))
    ranged = in_ranges(chunks.select(*keys, "pos", weight.alias("tokens")), keys, ["pos"])
    line = running(ranged, keys, ["pos"], {"end": F.col("tokens"), "no": F.lit(1).cast("bigint")})
    # two neighbouring batches hold more than a budget
    most = ranged.groupBy(*keys).agg((F.sum("tokens") * 2 / budget).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return line.select(*keys, "pos", "tokens", F.lit(1).cast("bigint").alias("batch"))
    line = checkpointed(line)
    jumps = [checkpointed(_next_starts(line, keys, budget))]
    while 2 ** len(jumps) <= most:
        far = jumps[-1].select(*keys, F.col("no").alias("to"), F.col("to").alias("further"))
        jumps.append(checkpointed(jumps[-1].join(far, [*keys, "to"]).select(*keys, "no", F.col("further").alias("to"))))
    starts = line.filter("no = 1").select(*keys, "no")
    for jump in reversed(jumps):
        reached = starts.join(jump, [*keys, "no"]).select(*keys, F.col("to").alias("no"))
        starts = checkpointed(starts.union(reached))
    marked = line.join(starts.withColumn("first", F.lit(1).cast("bigint")), [*keys, "no"], "left").fillna(0, ["first"])
    return running(marked, keys, ["pos"], {"batch": F.col("first")}).select(*keys, "pos", "tokens", "batch")


def _next_starts(line: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """(keys, no, to): the text that would start the next batch if ``no`` started one.

    The line is cut into stretches of one budget; a text is listed in each stretch that it touches.  Each
    text has a token, so a stretch has at most a budget of texts.
    """
    begin = F.col("end") - F.col("tokens")
    stretch = lambda place: F.floor(place / budget).cast("bigint")
    texts = line.select(
        *keys, F.explode(F.sequence(stretch(begin), stretch(F.col("end") - 1))).alias("stretch"),
        begin.alias("place"), F.lit(0).alias("asks"), "no", "end",
    )
    asked = line.select(
        *keys, stretch(begin + budget).alias("stretch"), (begin + budget).alias("place"), F.lit(1).alias("asks"), "no", "end"
    )
    up_to = Window.partitionBy(*keys, "stretch").orderBy("place", "asks").rowsBetween(Window.unboundedPreceding, 0)
    over = F.last(F.when(F.col("asks") == 0, F.struct("no", "end")), ignorenulls=True).over(up_to)
    # behind the last text of a section there is none; an oversize text lies over its own place
    return texts.union(asked).withColumn("over", over).filter("asks = 1 AND place < over.end").select(
        *keys, "no", F.greatest(F.col("over.no"), F.col("no") + 1).alias("to")
    )


def _merged_bodies(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, pos, no, para) -> body per key: first copy of each paragraph, in order.

    Copies meet in a partial aggregate, so a paragraph repeated on most pages moves once per input
    partition.  Paragraphs of one chunk are joined by a newline, chunks by a rule.
    """
    firsts = _first_copies(paragraphs, keys)
    before = f"""CASE WHEN i = 0 THEN '' WHEN get(ps, i - 1).pos = p.pos THEN '\\n' ELSE {lit(RULE)} END"""
    joined = f"array_join(transform(ps, (p, i) -> concat({before}, p.para)), '')"
    return firsts.groupBy(*keys).agg(F.array_sort(F.collect_list("first")).alias("ps")).select(
        *keys, F.expr(joined).alias("body")
    )


def _first_copies(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    return paragraphs.groupBy(*keys, F.expr(T.paragraph_key("para")).alias("key")).agg(
        F.min(F.struct("pos", "no", "para")).alias("first")
    )


def first_paragraphs(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, no, para): the first copy of each paragraph, as rows."""
    return _first_copies(_paragraph_rows(chunks, keys, "chunk"), keys).select(*keys, "first.*")


def _paragraph_rows(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    return rows.select(*keys, "pos", F.posexplode(F.expr(T.paragraphs(text))).alias("no", "para"))


def section_partial(chunks: DataFrame, budget: int = V.BATCH_TOKENS) -> DataFrame:
    """One de-duplicated partial body per (site, section, batch)."""
    batches = token_batches(chunks, budget).select("site", "section", "pos", "batch")
    rows = chunks.join(batches, ["site", "section", "pos"])
    keys = ["site", "section", "batch"]
    return _merged_bodies(_paragraph_rows(rows, keys, "chunk"), keys)


def section_merge(chunks: DataFrame) -> DataFrame:
    """De-duplicated body per (site, section); sections without text give no row."""
    keys = ["site", "section"]
    return _merged_bodies(_paragraph_rows(chunks, keys, "chunk"), keys)


def merge_partials(partials: DataFrame) -> DataFrame:
    """Bodies of the batches merged into the section body: keeps what one global pass keeps."""
    keys = ["site", "section"]
    rows = partials.withColumnRenamed("batch", "pos")
    paragraphs = _paragraph_rows(rows, keys, "body").filter("para <> '---'")
    return _merged_bodies(paragraphs, keys)


def section_docs(merged: DataFrame, contacts: DataFrame) -> DataFrame:
    """(site, section, body, tokens): merged bodies, the contact block put before ``contact``."""
    block = contacts.select(
        "site", F.lit("contact").alias("section"),
        F.expr(C.context("emails", "phones")).alias("block"),
    ).filter("block IS NOT NULL")
    return (
        merged.join(block, ["site", "section"], "full_outer")
        .select("site", "section", F.concat_ws("\n\n", "block", "body").alias("body"))
        .withColumn("tokens", F.expr(T.tokens("body")))
    )


def legacy_compile(chunks: DataFrame) -> DataFrame:
    """Older document forms: chunks per cluster under an upper-case heading, and one list of all.

    A site has at most the page budget of chunks.
    """
    ordered = lambda item: F.transform(
        F.array_sort(F.collect_list(F.struct("pos", item.alias("text")))), lambda x: x["text"]
    )
    by_cluster = chunks.groupBy("site", "cluster").agg(
        F.array_join(ordered(F.col("chunk")), "\n\n").alias("text")
    ).select(
        "site", "cluster",
        F.concat(F.upper(F.replace(F.col("cluster"), F.lit("_"), F.lit(" "))), F.lit(":\n"), F.col("text")).alias("text"),
    )
    listing = F.concat(
        F.lit(V.LEGACY_HEAD), F.col("url"), F.lit(V.LEGACY_TITLE), F.col("title"),
        F.lit(V.LEGACY_TEXT), F.col("chunk"),
    )
    whole = chunks.groupBy("site").agg(F.array_join(ordered(listing), "\n\n").alias("text"))
    return by_cluster.unionByName(whole.withColumn("cluster", F.lit("(all)")))
