"""Mixing of sources to target weights by temperature."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sitelore.functions.scale import salted_join
from sitelore.llm.common import small_batches, written
from sitelore.llm.token_counts import VOCABULARY
from sitelore.llm.tokens import coder

#: Entropy to reach, as a share of that of equal weights; most passes over a source.
ENTROPY, MAX_REPEATS = 0.9, 2.0
#: Tokens of a block of a source's permutation, and blocks of a source at most (then they grow).
BLOCK_TOKENS, MAX_BLOCKS = 65_536, 65_536
#: Exponents tried at once and rounds: the bisection narrows the exponent by CUTS in each round.
CUTS, ROUNDS = 16, 4
#: Sources whose plan is broadcast; beyond that the plan is joined by salted keys.
BROADCAST_SOURCES = 100_000
_KEY_BITS = 62


def about_tokens(text: str = "text") -> Column:
    """A quarter of the bytes, at least one token: no source is without size."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / 4)).cast("long")


def with_tokens(
    docs: DataFrame, columns: list[str], name: str = "n_tokens", vocabulary: str = VOCABULARY, text: str = "text"
) -> DataFrame:
    """``columns`` of every row and, as ``name``, the tokens of its text; written once, no shuffle.

    The tokens are those of ``token_counts``: null and empty texts have none.
    """
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary)
        for batch in batches:
            own, n = batch.columns[1:], code.counts_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([*own, pa.array(n)], [*columns, name])

    read = docs.select(F.col(f"`{text}`").alias("\x00text"), *[F.col(f"`{c}`") for c in columns])
    return written(read.mapInArrow(run, f"{fields}, `{name}` bigint"), "counted")


def place(id_col: str, seed: int) -> Column:
    """A document's place in its source's permutation: ``_KEY_BITS`` bits."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 64 - _KEY_BITS)


@dataclass
class Temperature:
    """Exponent of the token shares, and sums over sources that the weights need."""

    exponent: float
    largest: int
    tokens: int
    mixed: float
    entropy: float
    sources: int


def repeats(tokens: Column, largest: int, exponent: Column, most: float) -> Column:
    """Passes over a source: its weight over its share, set so that the largest source is read once."""
    return F.least(F.lit(float(most)), F.pow(F.lit(float(largest)) / tokens, F.lit(1.0) - exponent))


def find_exponent(sources: DataFrame, entropy: float = ENTROPY, most: float = MAX_REPEATS) -> Temperature | None:
    """Largest exponent of 0 to 1 whose weights reach the entropy, or as much of it as the passes allow.

    Weights are token shares to the power of the exponent, cut where a source would be read more than
    ``most`` times.  Entropy falls as the exponent grows, so it is bisected, ``CUTS`` values at a time,
    each round one aggregate over the table of sources; the driver sees one row for each value.
    """
    size = sources.agg(F.max("tokens").alias("top"), F.sum("tokens").alias("all"), F.count(F.lit(1)).alias("n")).first()
    if not size["n"]:
        return None

    def rate(values: list[float]) -> dict[float, tuple[float, float]]:
        tried = sources.select("tokens", F.explode(F.array(*map(F.lit, values))).alias("a"))
        mixed = tried.select("a", (F.col("tokens") * repeats(F.col("tokens"), size["top"], F.col("a"), most)).alias("x"))
        rows = mixed.groupBy("a").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.log("x")).alias("l")).collect()
        return {r["a"]: (math.log(r["s"]) - r["l"] / r["s"], r["s"]) for r in rows}

    low, high = 0.0, 1.0
    rated = rate([low, high])
    goal = min(entropy * math.log(size["n"]), rated[low][0] - 1e-9)
    if rated[high][0] >= goal:
        low = high
    for _ in range(ROUNDS if low < high else 0):
        steps = [low + (high - low) * k / CUTS for k in range(1, CUTS)]
        rated |= rate(steps)
        good = [a for a in steps if rated[a][0] >= goal]
        low, high = (max(good), min([a for a in steps if a > max(good)], default=high)) if good else (low, steps[0])
    return Temperature(low, size["top"], size["all"], rated[low][1], rated[low][0], size["n"])


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", source: str = "source", tokens: Column | None = None,
    entropy: float = ENTROPY, most: float = MAX_REPEATS, budget: float | None = None, seed: int = 9,
) -> DataFrame:
    """One row per source: tokens, weight, whole passes, last place of the part pass, and blocks.

    A source gets ``weight`` times the budget; without a budget, as much as reads the largest source
    once.  What exceeds whole passes is read from one more: the blocks of a permutation of its documents
    in order, whole blocks first, then documents of the block in which the budget ends.  Blocks are
    ranges of a hash, so only their sums are ordered, at most ``MAX_BLOCKS`` a source.
    """
    tokens = about_tokens() if tokens is None else tokens
    rows = docs.select(F.col(source).cast("string").alias("source"), tokens.alias("tokens"), place(id_col, seed).alias("place"))
    size = F.greatest(F.lit(1), F.sum("tokens")).cast("long")  # no source is without size
    sources = written(rows.groupBy("source").agg(size.alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    found = find_exponent(sources, entropy, most)
    if found is None:
        return sources.select(
            "source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("passes"),
            F.lit(-1).cast("long").alias("last"), F.lit(1).cast("long").alias("blocks"),
        )
    scale = 1.0 if budget is None else budget / found.mixed
    times = repeats(F.col("tokens"), found.largest, F.lit(found.exponent), most)
    wanted = sources.select(
        "source", "tokens", (F.col("tokens") * times / found.mixed).alias("weight"),
        F.least(times * scale, F.lit(float(most))).alias("times"),
        F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long").alias("blocks"),
    ).withColumn("passes", F.floor(F.col("times") + 1e-9).cast("long"))
    wanted = written(
        wanted.withColumn("part", F.greatest(F.lit(0.0), (F.col("times") - F.col("passes")) * F.col("tokens"))), "wanted"
    )
    keyed = _with_plan(rows, wanted.filter("part >= 1").select(F.col("source").alias("_s"), "blocks", "part")).withColumn(
        "block", F.floor(F.col("place") / (F.lit(float(1 << _KEY_BITS)) / F.col("blocks"))).cast("long")
    )
    sums = keyed.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.max("place").alias("end"), F.first("part").alias("part"))
    until = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("tokens").over(until), F.lit(0)))
    whole = sums.filter("before + tokens <= part").groupBy("source").agg(F.max("end").alias("end"))
    edge = sums.filter("before < part and before + tokens > part").select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), (F.col("part") - F.col("before")).alias("left")
    )
    inside = keyed.join(F.broadcast(edge) if edge.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else edge,
                        F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    running = Window.partitionBy("source", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("sum", F.sum("tokens").over(running)).filter("sum <= left")
    ends = whole.union(fits.groupBy("source").agg(F.max("place").alias("end"))).groupBy("source").agg(F.max("end").alias("last"))
    plan = wanted.join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    return plan.select("source", "tokens", "weight", "passes", F.coalesce("last", F.lit(-1)).cast("long").alias("last"), "blocks")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan (``_s`` is its source), null safe; no row moves if the plan is small."""
    name = "\x00none"
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    left = rows.withColumn("_key", F.coalesce("source", F.lit(name)))
    right = plan.withColumn("_key", F.coalesce("_s", F.lit(name))).drop("_s")
    return salted_join(left, right, ["_key"]).drop("_key")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
    entropy: float = ENTROPY, most: float = MAX_REPEATS, budget: float | None = None, seed: int = 9,
    tokens: str | None = None,
) -> DataFrame:
    """The rows of the mix: struct ``row`` with a document's own columns, source, n_tokens, epoch, block.

    A document stands in the mix once for each pass of its source, and once more if its place lies in
    the part pass; ``epoch`` counts them.  Reading the rows by epoch, block and place gives the order of
    the permutations.  Without a budget every document is in the mix at least once.

    ``tokens`` names the column with the tokens of each row, as ``with_tokens`` adds it; without it, shares
    and ``n_tokens`` are an estimate, ``about_tokens``, in which null and empty texts count as one token.

    A null source is a source of its own.  Rows with null or repeated ids share a place and are in or out
    together.  A source without any token counts as one token.  An empty table gives no rows.
    """
    size = about_tokens(text) if tokens is None else F.col(f"`{tokens}`").cast("long")
    plan = written(plan_mix(docs, id_col, source, size, entropy, most, budget, seed), "plan")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).cast("string").alias("source"),
        size.alias("n_tokens"), place(id_col, seed).alias("place"),
    )
    chosen = _with_plan(rows, plan.select(F.col("source").alias("_s"), "passes", "last", "blocks"))
    copies = F.col("passes") + F.when(F.col("place") <= F.col("last"), 1).otherwise(0)
    block = F.floor(F.col("place") / (F.lit(float(1 << _KEY_BITS)) / F.col("blocks"))).cast("long")
    return chosen.withColumn("_copies", copies).filter("_copies > 0").select(
        "row", "source", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("epoch"),
        block.alias("block"), "place",
    )
