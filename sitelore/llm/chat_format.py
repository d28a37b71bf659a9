"""Chat formatting by prefix-target expansion: an example for every assistant turn, only its reply trainable.

Turns are written as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed.  Inside texts a
backslash is put into each ``<``, backslashes, ``|``, so no control string is left, and none is lost: reading
takes one backslash out of each.  Roles write ``%``, ``<`` and line feeds as ``%25``, ``%3C`` and ``%0A``.

Examples are written in two tables.  The first (``format_examples``) has one row for each assistant turn, in blocks
of ``BLOCK_TURNS``: its ``text`` starts with its block, and the text of a whole block is that of its last row
(``closes_block``).  No row holds more than a block, so a conversation of any length is spread over tasks.  The
second (``write_whole``) is the result: every example with its whole context, all turns before it, written
out.  A conversation of n turns is written about n / 4 times over, whatever its length; a context of
more than ``PART_CHARS`` characters lies in several rows, which are cut between blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sitelore.llm.common import _free_shuffles, small_batches

TRAINED_ROLE = "assistant"
#: Turns of a block, from which whole contexts are put together.
BLOCK_TURNS = 64
#: Characters of a row of whole examples, give or take a block.
PART_CHARS = 1_000_000
#: Characters of examples that a task holds before it hands them on.
HELD_CHARS = 4_000_000
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"

#: ``target``: place of the trained turn in its block, null where a row only closes a block.  ``loss_start`` and
#: ``loss_end``: the trained span of ``text`` in code points, end exclusive; null where nothing is trained.
EXAMPLES = (
    "block bigint, target int, closes_block boolean, text string, loss_start bigint, loss_end bigint"
)


def escaped(text: Column) -> Column:
    """No ``<|`` is left: ``<``, any backslashes, ``|`` get one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    for sign, code in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(sign), F.lit(code))
    return role


def unescaped_role(role: Column) -> Column:
    for sign, code in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(sign))
    return role


def _expand(block_turns: int, kind: pa.DataType):
    """Examples of the turns of a sorted partition; a block is closed before its conversation goes on or ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        conv, pieces, trained, held = None, [], [], 0
        rows: list[tuple] = []

        def close() -> None:
            text, spans = "", {}
            upto = []
            for k, (head, body) in enumerate(pieces):
                spans[k] = (len(text) + len(head), len(text) + len(head) + len(body))
                text += head + body + END
                upto.append(len(text))
            last = len(pieces) - 1
            for k in trained:
                rows.append((conv, number, k, k == last, text[: upto[k]], *spans[k]))
            if last not in trained:
                rows.append((conv, number, None, True, text, None, None))

        names = ["conv_id", *(f.split()[0] for f in EXAMPLES.split(", "))]
        kinds = [kind, pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            ids, roles, heads, bodies = (c.to_pylist() for c in batch.columns)
            for i, role, head, body in zip(ids, roles, heads, bodies):
                if pieces and (i != conv or len(pieces) == block_turns):
                    first = len(rows)
                    close()
                    held += sum(len(r[4]) for r in rows[first:])
                    number, pieces, trained = number + 1, [], []
                    if held > HELD_CHARS:
                        yield out()
                        rows, held = [], 0
                conv = i
                if role == TRAINED_ROLE:
                    trained.append(len(pieces))
                pieces.append((head, body))
        if pieces:
            close()
        yield out()

    return run


def format_examples(
    turns: DataFrame, path: str, block_turns: int = BLOCK_TURNS, id_col: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> None:
    """Write the examples of all conversations as a Parquet table.

    Turns are dealt by ranges of (conversation, turn) and sorted there, so a conversation of any length is
    spread over tasks; a task holds one block of one conversation at a time.  A block ends where a range
    ends, and blocks are numbered in the order of the ranges.

    Null texts and roles count as empty.  Turns without a number come last; turns with the same number go
    by the MD5 of role and text, wholly repeated ones stay.  Rows with a null conversation are one
    conversation.  A conversation without trained turns, or that goes on after the last one, gets a row
    with a null ``target`` that holds the rest.  A very long text is held in a block with its neighbours.
    Other columns are not read.  An empty table gives an empty table.
    """
    small_batches(turns.sparkSession)
    roles, texts = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    kind = turns.schema[id_col].dataType
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn).isNull().alias("_late"), F.col(turn).alias("_turn"),
        F.md5(F.concat(roles, F.lit("\n"), texts)).alias("_tie"), roles.alias("_role"),
        F.concat(F.lit(START), escaped_role(roles), F.lit(MIDDLE)).alias("_head"), escaped(texts).alias("_body"),
    )
    order = ["conv_id", "_late", "_turn", "_tie"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "_role", "_head", "_body").mapInArrow(
        _expand(block_turns, to_arrow_type(kind)), f"conv_id {kind.simpleString()}, {EXAMPLES}"
    ).write.parquet(path)
    _free_shuffles(turns.sparkSession)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def turns_of(text: Column) -> Column:
    """Turns of a formatted text as an array of (role, text), unescaped."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda p: p.startswith(START))

    def parsed(piece: Column) -> Column:
        end = F.position(F.lit("\n"), piece)
        return F.struct(
            unescaped_role(F.substring(piece, F.lit(len(START) + 1), end - F.lit(len(START) + 1))).alias("role"),
            unescaped(F.substring(piece, end + 1, F.length(piece))).alias("text"),
        )

    return F.transform(pieces, parsed)


def whole_examples(examples: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Examples of ``format_examples`` with their whole contexts.

    conv_id, block, target, part, ends, text, loss_start, loss_end.  The rows of an example (block, target) in order
    of ``part`` are its text; the last of them has the example's block and the trained span, in code points of
    that row.  ``ends``: the example holds the whole conversation; its target is null where nothing is
    trained in the end.  The window over a conversation sees its blocks without their texts; texts meet by
    parts of about ``part_chars`` characters.
    """
    closing = examples.filter("closes_block")
    own_conv = Window.partitionBy("conv_id").orderBy("block")
    placed = closing.select("conv_id", "block", F.length("text").cast("long").alias("_n")).select(
        "block", F.lead("block").over(own_conv).isNull().alias("_last"),
        F.floor(
            F.coalesce(F.sum("_n").over(own_conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / part_chars
        ).alias("part"),
    )
    blocks = closing.select("conv_id", "block", "text").join(placed, "block")
    before = Window.partitionBy("conv_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select("block", "part", "_last", F.array_join(F.collect_list("text").over(before), "").alias("_head"))
    last_rows = examples.filter("target is not null or closes_block").join(heads, "block").filter(
        "target is not null or _last"
    ).withColumn("ends", F.col("closes_block") & F.col("_last"))
    full = blocks.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("_l")
    ).select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.array_join("_l.text", "").alias("text"))
    names = ["conv_id", "block", "target", "part", "ends", "text", "loss_start", "loss_end"]
    earlier = last_rows.filter("part > 0").drop("text").join(
        full, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_p") < F.col("part"))
    ).withColumn("part", F.col("_p")).withColumns({n: F.lit(None).cast("long") for n in names[-2:]})
    up = F.length("_head")
    return last_rows.withColumns({
        "text": F.concat("_head", "text"), "loss_start": up + F.col("loss_start"), "loss_end": up + F.col("loss_end"),
    }).select(*names).union(earlier.select(*names))


def write_whole(examples: DataFrame, path: str, part_chars: int = PART_CHARS) -> None:
    """Write ``whole_examples`` as a Parquet table; contexts repeat, which zstd packs well."""
    whole_examples(examples, part_chars).write.option("compression", "zstd").parquet(path)
    _free_shuffles(examples.sparkSession)


def whole_texts(examples: DataFrame) -> DataFrame:
    """Examples with their contexts in one string: conv_id, text, loss_start, loss_end.

    Only for conversations whose whole text fits in a row.
    """
    whole = whole_examples(examples, part_chars=2**62)
    return whole.filter("target is not null").select("conv_id", "text", "loss_start", "loss_end")


DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest(kind: pa.DataType):
    """One row for each conversation of a sorted partition, from pieces fed to two running hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *(f.split()[0] for f in DIGEST.split(", "))]
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows: list[tuple] = []
        conv, started, turns, loss = None, False, hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = formatted = 0

        def close() -> None:
            rows.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted))

        for batch in batches:
            for i, n, told, reply, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if started and i != conv:
                    close()
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n_turns = loss_chars = formatted = 0
                conv, started = i, True
                n_turns += n
                turns.update(told.encode())
                loss.update(reply.encode())
                loss_chars += len(reply)
                formatted += chars
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                rows = []
        if started:
            close()
        columns = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def digest_whole(whole: DataFrame) -> DataFrame:
    """What whole examples say, one row for each conversation.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of every turn), loss_chars and loss_sha256
    (all trained spans in order), formatted_chars (code points of all examples with their contexts, as they
    stand there).  Turns are read from the example that ends the conversation, replies by the spans of the mask;
    they are sorted and fed to running hashes, so a long conversation is never held as one.
    """
    small_batches(whole.sparkSession)
    kind = whole.schema["conv_id"].dataType
    told = turns_of(F.col("text"))
    rows = whole.select(
        "conv_id", "block", F.coalesce("target", F.lit(2**31 - 1)).alias("_k"), "part",
        F.when(F.col("ends"), F.size(told)).otherwise(0).cast("long").alias("n"),
        F.when(F.col("ends"), F.array_join(F.transform(told, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).otherwise("").alias("told"),
        F.coalesce(
            unescaped(F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))), F.lit("")
        ).alias("reply"),
        F.length("text").cast("long").alias("chars"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "_k", "part").drop("block", "_k", "part").mapInArrow(
        _digest(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, {DIGEST}"
    )


def digest(examples: DataFrame) -> DataFrame:
    """``digest_whole`` of the whole examples of a table of ``format_examples``."""
    return digest_whole(whole_examples(examples))
