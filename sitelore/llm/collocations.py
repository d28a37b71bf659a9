"""Phrase collocation mining: frequent phrases of each language, counted by tries, scored by their weakest cut.

Five scans of the texts (two for step 3), each in tasks that see bounded slices of bytes:

1. words by language; those below the least count are in no frequent phrase;
2. pairs of neighbouring words that are both frequent, as pairs of 32-bit hashes;
3. three words both of whose pairs are frequent, then four and five words all of whose threes are frequent, as hashes;
   in a corpus so small that few buckets fill up, one more scan each counts buckets, and only full ones are proposed;
4. the candidates so found, as words, in double-array tries: all positions of a text walk down at once, level by level, and
   the states that accept a phrase are counted and added up over tasks.

Steps 2 and 3 only propose.  A hash that stands for two words can make a count too large and never too small,
every part of a frequent phrase is as frequent, so no frequent phrase is missed, and the counts returned are those of
step 4.  Joining frequent pairs on their common word would propose ten times more than what occurs.  Hashes go from task
to task as packed columns, in parts by the hash of a key, and are added up part by part by numpy.

What is sent to all executors is bounded: the filters of steps 2 and 3 are bitmaps of at most ``2 ** FILTER_BITS``
bits, and a trie holds about ``TRIE_PHRASES`` phrases; more phrases make more tries, with a scan for every ``TRIES_AT_ONCE``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sitelore.functions.scale import first_many_per_group
from sitelore.llm.common import byte_slices, mix, small_batches, text_buffers, written
from sitelore.llm.double_array import DoubleArray, build_flat, count_phrases

LEAST, LONGEST, TOP, UNKNOWN = 100, 5, 2000, "und"
#: Size of a filter, as a power of two of its bits, and bits for each thing in it, as a power of two.
FILTER_BITS, BITS_EACH = 28, 6
TRIE_PHRASES, TRIES_AT_ONCE = 500_000, 4
#: Bytes of text at once, and keys that a task gathers before it counts them.
SLICE_BYTES, KEYS_AT_ONCE = 8_000_000, 3_000_000
#: Words of the corpus for each part of the keys that are added up at once, at most, and keys that leave a task in one row.
PART_WORDS, ROW_KEYS = 1 << 20, 4096
#: Bytes of packed keys that leave a task at once.
BATCH_BYTES = 8_000_000
#: Counts of phrases that leave a task in one row.
PIECE = 2048
VECTOR = "piece bigint, counts array<bigint>"
#: Buckets, as a power of two, that longer phrases are counted in before they are proposed one by one.
BUCKET_BITS = 21

KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """The words of some texts in order: numbers of (language, word), and words left in the piece from each on."""

    langs: list[str]
    words: pa.Array
    number: np.ndarray
    left: np.ndarray

    def present(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers that occur, and how often."""
        counts = np.bincount(self.number, minlength=1)
        found = np.flatnonzero(counts)
        return found, counts[found]

    def symbols(self) -> np.ndarray:
        """A 32-bit hash of language and word for each word, the same in all scans."""
        hashed = lambda names: pd.util.hash_array(np.asarray(names, object), categorize=False)
        lang, word = np.divmod(self.number, max(1, len(self.words)))
        words = hashed(self.words.to_numpy(zero_copy_only=False)) if len(self.words) else np.zeros(0, np.uint64)
        return mix(words[word] ^ mix(hashed(self.langs)[lang])) >> np.uint64(32)


def cut_words(body: np.ndarray, offsets: np.ndarray, langs: list[str], lang: np.ndarray) -> Words:
    """Words of some texts; ``lang`` numbers the language of each text."""
    kind = KIND[body]
    word = kind == 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inside = offsets[(offsets > 0) & (offsets < len(body))]
    first[inside] = word[inside]
    last[inside - 1] = word[inside - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    coded = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(np.concatenate(([0], np.cumsum(ends - starts)))), pa.py_buffer(LOWER[body[word]])
    ).dictionary_encode()
    text = np.searchsorted(offsets, starts, "right") - 1
    stop = np.searchsorted(np.flatnonzero(kind == 2), starts)
    n = np.arange(len(starts))
    piece_end = np.flatnonzero(np.append((text[1:] != text[:-1]) | (stop[1:] != stop[:-1]), [True] * (len(n) > 0)))
    left = piece_end[np.searchsorted(piece_end, n)] - n + 1 if len(n) else n
    number = lang[text].astype(np.int64) * max(1, len(coded.dictionary)) + np.asarray(coded.indices, np.int64)
    return Words(langs, coded.dictionary, number, left)


def word_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of (lang, text) rows in slices of about ``most`` bytes; a longer text is cut where a piece ends."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[Words]:
        rows = pa.Table.from_batches(held)
        coded = rows.column("lang").combine_chunks().dictionary_encode()
        langs, lang = coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64)
        body, offsets = text_buffers(rows.column("text"))
        for i, j in byte_slices(offsets, most):
            at = int(offsets[i])
            while offsets[j] - at > 2 * most:  # one long text
                end = at + most
                while end < offsets[j] and KIND[body[end - 1]] != 2:
                    end += 1
                if end == offsets[j]:
                    break
                yield cut_words(body[at:end], np.array([0, end - at]), langs, lang[i:j])
                at = end
            yield cut_words(body[at : offsets[j]], np.maximum(offsets[i : j + 1], at) - at, langs, lang[i:j])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from cut(held)
            held, size = [], 0
    if held:
        yield from cut(held)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, symbol, n; the row of a language without a word has all its words."""
    for part in word_slices(batches):
        found, counts = part.present()
        lang, word = np.divmod(found, max(1, len(part.words)))
        symbols = np.zeros(max(1, len(part.langs)) * max(1, len(part.words)), np.uint64)
        symbols[part.number] = part.symbols()
        langs = pa.array(part.langs, pa.string())
        total = np.zeros(len(part.langs), np.int64)
        np.add.at(total, lang, counts)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([langs.take(pa.array(lang)), langs]),
             pa.concat_arrays([part.words.take(pa.array(word)).cast(pa.string()), pa.nulls(len(langs), pa.string())]),
             pa.array(np.concatenate((symbols[found].astype(np.int64), np.zeros(len(langs), np.int64)))),
             pa.array(np.concatenate((counts, total)))],
            ["lang", "word", "symbol", "n"],
        )


@dataclass
class Filter:
    """A bitmap by the high bits of a mixed key: no key put in is missed, some others pass."""

    bits: int
    bitmap: np.ndarray

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = places(keys, self.bits)
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _one_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(np.uint64)) ^ b.astype(np.uint64)


def filter_of(keys: DataFrame, n: int, most_bits: int = FILTER_BITS) -> Filter:
    """The filter of ``n`` rows of one or two columns, put together on the executors in pieces of 4 KB."""
    bits = min(most_bits, max(15, int(n).bit_length() + BITS_EACH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            key = columns[0] if len(columns) == 1 else _one_key(*columns)
            yield pa.RecordBatch.from_arrays([pa.array(places(key, bits) + 1)], ["place"])

    return _bitmap(keys.mapInArrow(run, "place bigint"), bits)


def _bitmap(places_: DataFrame, bits: int) -> Filter:
    """The filter of some places, numbered from 1."""
    pieces = places_.groupBy(F.expr("bitmap_bucket_number(place)").alias("piece")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits")
    )
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for piece, content in pieces.collect():
        bitmap[(piece - 1) * 4096 : piece * 4096] = np.frombuffer(content, np.uint8)
    return Filter(bits, bitmap)


def _counted(keys: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows of some columns, how often each occurs (or the sum of its ``n``) and their hashes, which are in order."""
    mixed = mix(keys[0])
    for k in keys[1:]:
        mixed = mix(mixed ^ k)

    def sorted_by(order: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        columns, hashes = [k[order] for k in keys], mixed[order]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return columns, hashes, new

    order = np.argsort(mixed)
    columns, hashes, new = sorted_by(order)
    if (new[1:] & (hashes[1:] == hashes[:-1])).any():  # two keys of one hash may lie mixed up
        columns, hashes, new = sorted_by(order := np.lexsort((*keys, mixed)))
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(order))) if n is None or not len(at) else np.add.reduceat(n[order], at)
    return [c[at] for c in columns], counts, hashes[at]


def _packed(columns: list[np.ndarray], counts: np.ndarray, hashes: np.ndarray, names: list[str], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``ROW_KEYS`` keys of one part, with their counts; the part is the first bits of the hash."""
    size, shift = len(hashes), np.uint64(64 - bits)
    edges = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << shift)
    cuts = np.unique(np.concatenate((edges, np.arange(0, size, ROW_KEYS), [size])))
    parts = (hashes[cuts[:-1]] >> shift).astype(np.int32)
    arrays = [pa.array(parts)]
    for c in (*(c.astype(np.int64) for c in columns), counts.astype(np.int32)):
        ends = (cuts * c.itemsize).astype(np.int32)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(c)]))
    rows = pa.RecordBatch.from_arrays(arrays, ["part", *names, "n"])
    step = max(1, BATCH_BYTES // (ROW_KEYS * (8 * len(columns) + 4)))
    for i in range(0, len(parts), step):
        yield rows.slice(i, step)


def _propose(propose: Callable[[Words], list[list[np.ndarray]]], names: list[str], bits: int):
    """Packed rows of keys that a function finds in slices, with how often each occurs in some slices of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for part in word_slices(batches):
            held += propose(part)
            if sum(len(h[0]) for h in held) >= KEYS_AT_ONCE:
                yield from _packed(*_counted([np.concatenate(c) for c in zip(*held)]), names, bits)
                held = []
        if any(len(h[0]) for h in held):
            yield from _packed(*_counted([np.concatenate(c) for c in zip(*held)]), names, bits)

    return run


def _frequent(names: list[str], least: int):
    """Keys that occur ``least`` times in all tasks, and how often, from packed rows in order of the part.

    One part is held at a time; its keys are added up whenever they are twice as many as after the last time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, most = None, [], 0, KEYS_AT_ONCE

        def added() -> list[np.ndarray]:
            *columns, n = [np.concatenate(c) for c in zip(*held)]
            columns, n, _ = _counted(columns, n)
            return [*columns, n]

        def out() -> pa.RecordBatch:
            *columns, n = added()
            enough = n >= least
            return pa.RecordBatch.from_arrays([pa.array(c[enough].astype(np.int64)) for c in (*columns, n)], [*names, "n"])

        for batch in batches:
            for i, p in enumerate(batch.column(0).to_pylist()):
                if p != part:
                    if held:
                        yield out()
                    part, held, size, most = p, [], 0, KEYS_AT_ONCE
                own = [np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in range(1, 1 + len(names))]
                held.append([*own, np.frombuffer(batch.column(1 + len(names))[i].as_buffer(), np.int32).astype(np.int64)])
                size += len(own[0])
                if size >= most:
                    held = [added()]
                    size = len(held[0][0])
                    most = max(KEYS_AT_ONCE, 2 * size)
        if held:
            yield out()

    return run


def _alive(symbols: np.ndarray, left: np.ndarray, filters: list) -> list[np.ndarray]:
    """Where one word, two and three words pass their filters; as many as there are filters, padded at the end."""
    pad = np.zeros(LONGEST, bool)
    alive = [np.append(filters[0].value(symbols), pad)]
    if len(filters) > 1:
        at = np.flatnonzero(alive[0][:-1] & alive[0][1:] & np.append(left > 1, pad[1:]))
        alive.append(_marked(len(alive[0]), at[filters[1].value(symbols[at] << np.uint64(32) | symbols[at + 1])]))
    if len(filters) > 2:
        at = np.flatnonzero(alive[1][:-1] & alive[1][1:])
        key = _one_key(symbols[at] << np.uint64(32) | symbols[at + 1], symbols[at + 2] << np.uint64(32))
        alive.append(_marked(len(alive[0]), at[filters[2].value(key)]))
    return alive


def _marked(size: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(size, bool)
    out[at] = True
    return out


def _pairs(words) -> Callable[[Words], list[list[np.ndarray]]]:
    def propose(part: Words) -> list[list[np.ndarray]]:
        if len(part.number) < 2:
            return []
        symbols = part.symbols()
        good = words.value(symbols)
        at = np.flatnonzero((part.left[:-1] > 1) & good[:-1] & good[1:])
        return [[symbols[at] << np.uint64(32) | symbols[at + 1]]]

    return propose


def _phrases(filters: list, part: Words, longest: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Phrases that are longer than what the filters know and all parts of which pass.

    For each length, in columns: words 1 and 2, 3 and 4, 5 and the length.
    """
    known, high = len(filters), np.uint64(32)
    if len(part.number) <= known:
        return
    symbols = part.symbols()
    alive = _alive(symbols, part.left, filters)[-1]
    at = np.flatnonzero(alive)
    for k in range(known + 1, longest + 1):
        at = at[alive[at + k - known]]
        s = [symbols[at + d] if d < k else np.zeros(len(at), np.uint64) for d in range(5)]
        yield k, [s[0] << high | s[1], s[2] << high | s[3], s[4] << high | np.uint64(k)]


def _bucket_keys(k: int, columns: list[np.ndarray]) -> np.ndarray:
    first = _one_key(columns[0], columns[1])
    return first if k < 5 else _one_key(first, columns[2])


def _count_buckets(filters: list, longest: int):
    """How many longer phrases of a task fall into each bucket of keys, as pieces of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for part in word_slices(batches):
            for k, columns in _phrases(filters, part, longest):
                at, n = np.unique(places(_bucket_keys(k, columns), BUCKET_BITS), return_counts=True)
                counts[at] += n
        yield _pieces(counts)

    return run


def _longer(filters: list, longest: int, buckets) -> Callable[[Words], list[list[np.ndarray]]]:
    """Phrases that are longer than what the filters know, all parts of which pass, in full buckets where those were counted."""

    def propose(part: Words) -> list[list[np.ndarray]]:
        out = []
        for k, columns in _phrases(filters, part, longest):
            if buckets is not None:
                full = buckets.value(_bucket_keys(k, columns))
                columns = [c[full] for c in columns]
            out.append(columns)
        return out

    return propose


def _symbol(column: str, high: bool) -> str:
    return f"shiftrightunsigned({column}, 32)" if high else f"({column} & 4294967295)"


def candidates(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Frequent words with the totals of the languages, and phrases that may be frequent: lang, words."""
    if not 2 <= longest <= 5:
        raise ValueError("phrases have 2 to 5 words")
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    counted = docs.mapInArrow(_count_words, "lang string, word string, symbol bigint, n bigint")
    words = written(
        counted.groupBy("lang", "word", "symbol").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("word").isNull()),
        "words",
    )
    known = words.filter("word is not null")
    frequent = send(filter_of(known.select(F.col("symbol").alias("key")), known.count()))
    total = words.filter("word is null").agg(F.sum("n")).first()[0] or 0
    bits = max(4, int(total // PART_WORDS).bit_length())

    def enough(propose: Callable[[Words], list[list[np.ndarray]]], names: list[str], table: str) -> tuple[DataFrame, int, int]:
        """The frequent ones of the keys that a function finds, their number, and how often they occur."""
        packed = docs.mapInArrow(_propose(propose, names, bits), ", ".join(["part int", *(f"{c} binary" for c in names), "n binary"]))
        found = packed.repartition("part").sortWithinPartitions("part").mapInArrow(
            _frequent(names, least), ", ".join(f"{c} bigint" for c in (*names, "n"))
        )
        found = written(found, table)
        n, occur = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        return found.drop("n"), n, occur or 0

    def longer(filters: list, most: int, occur: int) -> tuple[DataFrame, int, int]:
        """Frequent longer phrases; ``occur`` is how often the longest parts that the filters know occur."""
        buckets = None
        if 2 * occur <= least << BUCKET_BITS:  # else most buckets would be full
            full = _summed(docs.mapInArrow(_count_buckets(filters, most), VECTOR)).filter(F.col("a") >= least)
            buckets = send(_bitmap(full.select((F.col("number") + 1).alias("place")), BUCKET_BITS))
        return enough(_longer(filters, most, buckets), ["a", "b", "c"], "longer")

    pairs, n, occur = enough(_pairs(frequent), ["key"], "pairs")
    filters = [frequent, send(filter_of(pairs, n))]
    runs = spark.createDataFrame([], "a bigint, b bigint, c bigint")
    if longest > 2:
        runs, n, occur = longer(filters, 3, occur)
    if longest > 3:
        filters.append(send(filter_of(runs.select("a", "b"), n)))
        runs = runs.union(longer(filters, longest, occur)[0])
    symbols = [("a", True), ("a", False), ("b", True), ("b", False), ("c", True)]
    phrases = pairs.select(F.col("key").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(2).cast("bigint").alias("c")).union(runs)
    phrases = written(phrases.select(
        *[F.expr(_symbol(c, h)).alias(f"s{k}") for k, (c, h) in enumerate(symbols)], F.expr(_symbol("c", False)).alias("k")
    ), "runs")
    ids = [f"s{k}" for k in range(5)] + ["k"]
    spelt = phrases.select(*ids, F.posexplode(F.expr("slice(array(s0, s1, s2, s3, s4), 1, cast(k as int))")).alias("pos", "symbol")).join(
        known.select("symbol", "lang", "word"), "symbol"
    ).groupBy(*ids, "lang").agg(F.collect_list(F.struct("pos", "word")).alias("w"))
    # a symbol with several words stands for each of them; a place without a word of the language for none
    each = "transform(sequence(0, cast(k as int) - 1), p -> transform(filter(w, x -> x.pos = p), x -> x.word))"
    every = f"""aggregate({each}, array(cast(array() as array<string>)), (acc, ws) ->
        flatten(transform(acc, a -> transform(ws, x -> array_append(a, x)))))"""
    return words, spelt.select("lang", F.explode(F.expr(every)).alias("words"))


@dataclass
class Tries:
    """A trie of phrases and the words of each language in it, with their numbers."""

    trie: DoubleArray
    words: dict[str, tuple[pa.Array, np.ndarray]]
    longest: int

    @classmethod
    def of(cls, phrases: pa.Table) -> Tries:
        """The trie of (lang, words) rows; a phrase is accepted by the number of its row.

        Words that follow others most often get the smallest numbers, so that children lie close together.
        """
        rows = phrases.select(["lang", "words"]).combine_chunks()
        lists = rows.column("words").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.string()))
        lengths = np.asarray(lists.value_lengths(), np.int64)
        langs = pa.array(rows.column("lang").to_pylist(), pa.string()).dictionary_encode()
        spelt = lists.flatten().cast(pa.large_string()).dictionary_encode()
        many = max(1, len(spelt.dictionary))
        keys = np.repeat(np.asarray(langs.indices, np.int64), lengths) * many + np.asarray(spelt.indices, np.int64)
        known, place = np.unique(keys, return_inverse=True)
        follow = np.ones(len(keys), np.int64)
        follow[np.cumsum(lengths) - lengths] = 0
        order = np.argsort(-np.bincount(place, follow, len(known)), kind="stable")
        number = np.empty(len(known), np.int64)
        number[order] = np.arange(len(known))
        lang, word = np.divmod(known, many)
        words = {
            name: (spelt.dictionary.take(pa.array(word[lang == code])), number[lang == code])
            for code, name in enumerate(langs.dictionary.to_pylist())
        }
        return cls(build_flat(number[place], lengths), words, int(lengths.max(initial=0)))

    def symbols(self, part: Words) -> np.ndarray:
        """The number of each word of a slice, -1 where it is in no phrase of its language."""
        found, _ = part.present()
        lang, word = np.divmod(found, max(1, len(part.words)))
        out = np.full(int(found[-1]) + 1 if len(found) else 1, -1, np.int64)
        for code, name in enumerate(part.langs):
            own = lang == code
            if name in self.words and own.any():
                known, numbers = self.words[name]
                at = pc.index_in(part.words.take(pa.array(word[own])), value_set=known).fill_null(-1).to_numpy()
                out[found[own]] = np.where(at >= 0, numbers[at], -1)
        return out[part.number]


def _count_in(tries):
    """How often each phrase of some tries occurs in the rows of a task, as pieces of a vector.

    The vector holds the phrases of one trie after those of another, each by their numbers, in as many places for each trie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, each = tries.value
        met = [np.zeros(len(t.trie.check), np.int64) for t in own]
        for part in word_slices(batches):
            for t, counts in zip(own, met):
                counts += count_phrases(t.trie, t.symbols(part), part.left, t.longest)
        for n, (t, counts) in enumerate(zip(own, met)):
            states = np.flatnonzero(t.trie.accepts >= 0)
            vector = np.zeros(each, np.int64)
            vector[t.trie.accepts[states]] = counts[states]
            yield _pieces(vector, n * each // PIECE)

    return run


def _pieces(counts: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """A vector in pieces of ``PIECE`` numbers, numbered from ``first``, without those that are all 0."""
    pieces = counts.reshape(-1, PIECE)
    found = np.flatnonzero(pieces.any(axis=1))
    ends = pa.array(np.arange(len(found) + 1) * PIECE, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(found + first), pa.ListArray.from_arrays(ends, pa.array(pieces[found].ravel()))], ["piece", "counts"])


def _summed(pieces: DataFrame) -> DataFrame:
    """(number, a): the sums of the vectors of all tasks where they are not 0."""
    return pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(_add_up, "number bigint, a bigint")


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces of all tasks, from rows in order of the piece; one sum is held at a time."""
    piece, total = None, None

    def out() -> pa.RecordBatch:
        met = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(piece * PIECE + met), pa.array(total[met])], ["number", "a"])

    for batch in batches:
        for p, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            if p != piece:
                if piece is not None:
                    yield out()
                piece, total = p, np.zeros(PIECE, np.int64)
            total += counts.values.to_numpy()
    if piece is not None:
        yield out()


def count_in_tries(docs: DataFrame, phrases: DataFrame, least: int, per_trie: int = TRIE_PHRASES) -> DataFrame:
    """lang, words, a: exact counts of those phrases that reach ``least``, by one scan for every ``TRIES_AT_ONCE`` tries."""
    spark = docs.sparkSession
    tries = max(1, -(-phrases.count() // per_trie))
    shard = F.pmod(F.xxhash64("lang", "words"), F.lit(tries)).cast("int")
    rows = phrases.withColumn("trie", shard)
    number = F.row_number().over(Window.partitionBy("trie").orderBy("lang", "words")) - 1
    rows = written(rows.withColumn("number", number.cast("bigint")), "candidates")
    counts = None
    for first in range(0, tries, TRIES_AT_ONCE):
        own = []
        for t in range(first, min(first + TRIES_AT_ONCE, tries)):
            held = rows.filter(F.col("trie") == t).orderBy("number").select("lang", "words").toArrow()  # about per_trie rows
            own.append((Tries.of(held), held.num_rows))
        each = -(-max(1, *(n for _, n in own)) // PIECE) * PIECE
        sent = spark.sparkContext.broadcast(([t for t, _ in own], each))
        pieces = docs.mapInArrow(_count_in(sent), VECTOR)
        found = _summed(pieces).filter(F.col("a") >= least).selectExpr(
            f"cast({first} + number div {each} as int) AS trie", f"number % {each} AS number", "a"
        )
        found = written(found, "counts")
        sent.destroy()
        counts = found if counts is None else counts.union(found)
    return written(rows.join(counts, ["trie", "number"]).select("lang", "words", "a"), "phrases")


def score_phrases(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the lowest-scoring cut; phrases inside equally frequent longer ones go."""
    joined = lambda c: F.array_join(c, " ")
    counts = words.filter("word is not null").select("lang", F.col("word").alias("part"), F.col("n").alias("a")).union(
        phrases.select("lang", joined("words").alias("part"), "a")
    )
    totals = words.filter("word is null").select("lang", "n")
    rows = phrases.select("lang", joined("words").alias("phrase"), "words", F.size("words").alias("k"), "a")
    inside = rows.filter("k > 2").select(
        "lang", "a", F.expr("""flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1),
            i -> array_join(slice(words, i, m), ' '))))""").alias("parts")
    ).select("lang", "a", F.explode("parts").alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = rows.join(inside, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * a")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("""transform(sequence(1, k - 1), c -> named_struct(
        'cut', c, 'first', array_join(slice(words, 1, c), ' '), 'rest', array_join(slice(words, c + 1, k), ' ')))""")).alias("c")).select(
        "lang", "phrase", "a", "c.*"
    )
    of = lambda name, n: counts.select("lang", F.col("part").alias(name), F.col("a").alias(n))
    big = lambda c, k: f"CAST({c} AS DECIMAL({k},0))"
    score = f"({big(1000, 4)} * {big('a', 16)} * {big('n', 16)}) DIV ({big('l', 16)} * {big('r', 16)})"
    scored = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang").withColumn(
        "score", F.expr(score)
    )
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("x")
    return scored.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def mine_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, per_trie: int = TRIE_PHRASES,
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    Ties in the score go by count, then by the bytes of the phrase.  Null texts count as empty, null
    languages as ``UNKNOWN``.  A very long text is cut where a piece ends.  Repeated rows count each time.
    Other columns are not read.  An empty table, or one where nothing is frequent, gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(lang, F.lit(UNKNOWN)).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    words, proposed = candidates(rows, least, longest)
    scored = score_phrases(words, count_in_tries(rows, proposed, least, per_trie))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = first_many_per_group(scored, ["lang"], order, top)
    return first.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
