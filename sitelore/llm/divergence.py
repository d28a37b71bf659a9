"""Source divergence audit: how the terms of each source differ from those of its language and other sources.

The vectors are those of a CountVectorizer for each language: terms by document counts, a vocabulary of all terms in
``MIN_DF`` documents and no largest size.  Its own model holds the vocabulary on the driver and sends it to
all executors, and nothing bounds a corpus' vocabulary, so here the vocabulary is a table.  A task builds the
sparse vectors of its documents (term number, count), adds them up by source as a Summarizer does and sends
the sums on; counts of documents are added up in the same pass.  Vectors are linear, so the sums are cut to the vocabulary
afterwards, and the corpus is read once.

Pairs of sources are evaluated on the sparse sums.  With p0 for a term that a source lacks, the sum over all V kept
terms is V f(p0, q0), plus what changes where one side has the term (by a histogram of the side's values), plus
what is left where both have it; only those are met as pairs, inside tasks, and leave as sums.
All arithmetic is in whole numbers; products that pass 64 bits are taken in decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sitelore.llm.common import byte_slices, grouped, ragged, runs, small_batches, text_buffers, written

MIN_DF, TOP_TERMS, UNIT = 3, 200, 1_000_000_000
#: Bytes of text that make one set of vectors; rows of sums, and pairs of them, that are met at once.
SLICE_BYTES, SUM_ROWS, PAIRS_AT_ONCE = 8_000_000, 200_000, 1_000_000

LETTER = np.ones(256, bool)
LETTER[:128] = False
LETTER[65:91] = LETTER[97:123] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SUMS = "lang string, source string, term string, n bigint, df bigint"


def letter_slices(body: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int, list[int]]]:
    """(first text, last text, cuts): about ``most`` bytes each; a longer text is cut further, between terms."""
    for i, j in byte_slices(offsets, most):
        cuts, end = [offsets[i]], offsets[j]
        while end - cuts[-1] > 2 * most:
            at = cuts[-1] + most
            while at < end and LETTER[body[at]]:
                at += 1
            cuts.append(at)
        yield i, j, [*cuts, end]


def term_vectors(body: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of some texts, and their sparse vectors as (text, term number, count) in order of text and term."""
    letter = LETTER[body]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    inside = offsets[(offsets > 0) & (offsets < len(body))]
    first[inside] = letter[inside]
    last[inside - 1] = letter[inside - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    places = np.concatenate(([0], np.cumsum(ends - starts)))
    coded = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(places), pa.py_buffer(LOWER[body[letter]])
    ).dictionary_encode()
    text = np.searchsorted(offsets, starts, "right") - 1
    size = max(1, len(coded.dictionary))
    keys, counts = np.unique(text * size + np.asarray(coded.indices, np.int64), return_counts=True)
    return coded.dictionary, keys // size, keys % size, counts


def _long_vector(body: np.ndarray, cuts: list[int]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The vector of one text from those of its parts."""
    parts = []
    for a, z in zip(cuts[:-1], cuts[1:]):
        terms, _, term, count = term_vectors(body[a:z], np.array([0, z - a]))
        parts.append(pa.table({"term": terms.take(pa.array(term)), "n": count}))
    whole = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
    number = np.arange(len(whole))
    return whole.column("term").combine_chunks(), np.zeros_like(number), number, whole.column("n_sum").to_numpy()


def _sum_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each (lang, source), and the texts with each term."""
    names = [f.split()[0] for f in SUMS.split(", ")]

    def sums(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        groups = rows.select(["lang", "source"]).append_column("row", pa.array(np.arange(len(rows))))
        first = groups.group_by(["lang", "source"]).aggregate([("row", "min")])
        group = groups.join(first.append_column("group", pa.array(np.arange(len(first)))), ["lang", "source"]).sort_by("row")
        group = group.column("group").to_numpy()
        body, offsets = text_buffers(rows.column("text"))
        for i, j, cuts in letter_slices(body, offsets, SLICE_BYTES):
            if len(cuts) == 2:
                terms, text, term, count = term_vectors(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            else:
                terms, text, term, count = _long_vector(body, cuts)
            keys = group[i:j][text] * max(1, len(terms)) + term
            order = np.argsort(keys, kind="stable")
            at = runs(keys[order])
            if len(at) < 2:
                continue
            whose, which = np.divmod(keys[order][at[:-1]], len(terms))
            yield pa.RecordBatch.from_arrays(
                [first.column("lang").take(pa.array(whose)).combine_chunks(), first.column("source").take(pa.array(whose)).combine_chunks(),
                 terms.take(pa.array(which)).cast(pa.string()), pa.array(np.add.reduceat(count[order], at[:-1])), pa.array(np.diff(at))],
                names,
            )

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield from sums(held)
            held, size = [], 0
    if held:
        yield from sums(held)


def kept_terms(docs: DataFrame, min_df: int = MIN_DF, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The vocabulary and the sums: lang, term, n (in the language) and entries (source, n), written once."""
    small_batches(docs.sparkSession)
    named = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    sums = docs.select(*named).mapInArrow(_sum_vectors, SUMS)
    by_source = sums.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = by_source.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("entries")
    )
    return written(terms.filter(F.col("df") >= min_df).drop("df"), "terms")


def _share(count: str, total: str, size: str) -> str:
    """1 + floor(UNIT (count + 1) / (total + size)), null where that divides by 0; the product may pass 64 bits."""
    top = f"CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))"
    return f"(1 + {top} DIV CAST(nullif({total} + {size}, 0) AS DECIMAL(20,0)))"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) DIV {q})"


def group_sizes(docs: DataFrame, terms: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Every occurring (lang, source): occurrences of kept terms, those of the language, kept terms, p of a lacking term."""
    zero = F.lit(0).cast("bigint")
    every = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    own = terms.select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("total"))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("size"))
    filled = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "size")]
    )
    return written(filled.withColumn("p0", F.expr(_share("0", "total", "size"))), "groups")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (lang, term, source, p, p0) in order of lang and term: what terms that both have change, by pair."""

    def meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, term, source = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
        codes = [np.asarray(c.indices, np.int64) for c in (lang, term, source)]
        p, p0 = (rows.column(c).to_numpy() for c in ("p", "p0"))
        at = runs(codes[0] * max(1, len(term.dictionary)) + codes[1])
        sizes = np.repeat(np.diff(at), np.diff(at))
        firsts = np.repeat(at[:-1], np.diff(at))
        whose = codes[0] * max(1, len(source.dictionary)) + codes[2]
        known, whose = np.unique(whose, return_inverse=True)
        done = np.concatenate(([0], np.cumsum(sizes)))
        i = 0
        keys, sums = [], []
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(done, done[i] + PAIRS_AT_ONCE, "right")) - 1)
            a = np.repeat(np.arange(i, j), sizes[i:j])
            b = ragged(firsts[i:j], sizes[i:j])
            a, b = a[a != b], b[a != b]
            f = lambda x, y: (x - y) * (x - y) // y
            change = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
            key = whose[a] * len(known) + whose[b]
            if len(known) <= 2000:
                total = np.zeros(len(known) ** 2, np.int64)
                np.add.at(total, key, change)
                found = np.flatnonzero(total)
                keys.append(found)
                sums.append(total[found])
            else:
                order = np.argsort(key, kind="stable")
                cut = runs(key[order])
                if len(cut) > 1:
                    keys.append(key[order][cut[:-1]])
                    sums.append(np.add.reduceat(change[order], cut[:-1]))
            i = j
        if not keys:
            return
        a, b = np.divmod(np.concatenate(keys), len(known))
        name = lambda x, d, k: d.take(pa.array(k(known[x], max(1, len(source.dictionary)))))
        yield pa.RecordBatch.from_arrays(
            [name(a, lang.dictionary, np.floor_divide), name(a, source.dictionary, np.mod), name(b, source.dictionary, np.mod),
             pa.array(np.concatenate(sums))],
            ["lang", "source", "item", "value"],
        )

    held: list[pa.Table] = []
    for table in grouped(batches, ["lang", "term"]):
        held.append(table)
        if sum(len(t) for t in held) >= SUM_ROWS:
            yield from meet(pa.concat_tables(held))
            held = []
    if held:
        yield from meet(pa.concat_tables(held))


def audit_sources(
    docs: DataFrame, min_df: int = MIN_DF, top: int = TOP_TERMS, text: str = "text", lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank.

    ``pair``: each other source of the language and how far it lies, over all kept terms.  ``term``: the
    terms by which a source stands out from its language, the first ``top`` of them.

    Null texts, languages and sources count as empty.  A group without kept terms has p0 everywhere; where a
    language keeps no term its pairs have value 0 and no term is listed.  Terms are cut where the text is read; a very
    long text is cut into parts between terms, whose vectors are added up.  Repeated rows are documents of their own.  Ties go by
    the bytes of the item.  Other columns are not read.  An empty table gives no rows.
    """
    terms = kept_terms(docs, min_df, text, lang, source)
    groups = group_sizes(docs, terms, lang, source)
    spread = terms.select("lang", "term", F.col("n").alias("lang_n"), F.inline("entries"))
    rows = spread.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", F.expr(_share("n", "total", "size")).alias("p"), "p0",
        F.expr(_share("lang_n", "lang_total", "size")).alias("q"),
    )
    rows = written(rows, "shares")

    both = rows.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions(
        "lang", "term", "source"
    ).mapInArrow(_pair_sums, "lang string, source string, item string, value bigint")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    values = rows.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    one = values.join(other, "lang").filter("source <> item").select(
        "lang", F.explode(F.array(
            F.struct("source", "item", F.expr(f"n * ({_f('p', 'q0')} - {_f('p0', 'q0')})").alias("value")),
            F.struct(F.col("item").alias("source"), F.col("source").alias("item"),
                     F.expr(f"n * ({_f('q0', 'p')} - {_f('q0', 'p0')})").alias("value")),
        )).alias("x"),
    ).select("lang", "x.*")
    none = groups.join(other, "lang").filter("source <> item").select(
        "lang", "source", "item", F.expr(f"coalesce(size * {_f('p0', 'q0')}, 0)").alias("value")
    )
    pairs = none.union(one).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    stands_out = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )
    return ranked(pairs, "pair").union(ranked(stands_out, "term").filter(F.col("rank") <= top))
