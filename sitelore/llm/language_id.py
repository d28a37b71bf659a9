"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sitelore.functions.scale import first_many_per_group
from sitelore.llm.common import byte_slices, mix, ragged, runs, ship, skew_join, small_batches, text_buffers, written

#: n-grams in a profile; labelled documents read for a language, about.
TOP, SAMPLE_DOCS = 300, 2000
#: (text, language) cells, or n-grams of texts met in profiles, that are held at once; one text may have more.
CELLS = 2_000_000
UNKNOWN = "und"
#: Bytes of text whose n-grams are held at once; a longer text is held whole.
SLICE_BYTES = 400_000
_BITS, _MASK = np.uint64(44), np.uint64((1 << 44) - 1)


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def gram_counts(column, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, 44-bit hash, count) of all 1- to 3-grams of letters, sorted by group and hash.

    Groups are the texts, or what ``group`` says of each text.  A word's two ends count as a letter of
    their own, so "_a" and "a_" are n-grams; no n-gram runs across words.
    """
    body, offsets = text_buffers(column)
    texts = len(offsets) - 1
    points = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))[offsets]
    letters = np.insert(_lower()[points], first[1:], 0)
    owner = np.repeat(np.arange(texts) if group is None else group, np.diff(first) + 1)
    keep = letters != 0
    keep[1:] |= letters[:-1] != 0
    s = np.concatenate(([0], letters[keep])).astype(np.uint64)
    d = np.concatenate(([0], owner[keep])).astype(np.uint64) << _BITS
    one = s != 0
    keys = [mix(s[one] * np.uint64(3) + np.uint64(1)) >> np.uint64(20) | d[one]]
    if len(s) > 1:
        two = (s[:-1] << np.uint64(21)) | s[1:]
        pair = (s[:-1] != 0) | (s[1:] != 0)
        keys.append((mix(two * np.uint64(5) + np.uint64(2)) >> np.uint64(20) | d[1:])[pair])
    if len(s) > 2:
        three = (two[:-1] << np.uint64(21)) | s[2:]
        middle = s[1:-1] != 0
        keys.append((mix(three * np.uint64(7) + np.uint64(3)) >> np.uint64(20) | d[2:])[middle])
    keys = np.concatenate(keys)
    keys.sort()
    at = runs(keys)
    keys = keys[at[:-1]]
    return (keys >> _BITS).astype(np.int64), keys & _MASK, np.diff(at)


def ranked(column, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, rank) of the ``top`` most frequent n-grams of each text; ties by hash."""
    text, gram, count = gram_counts(column)
    cap = np.uint64((1 << 20) - 1)
    order = (text.astype(np.uint64) << _BITS) | ((cap - np.minimum(count.astype(np.uint64), cap)) << np.uint64(24))
    order = np.argsort(order | (gram >> np.uint64(20)), kind="stable")
    text, gram = text[order], gram[order]
    at = runs(text)
    rank = np.arange(len(text)) - np.repeat(at[:-1], np.diff(at))
    keep = rank < top
    return text[keep], gram[keep], rank[keep]


class Profiles:
    """Ranks of the n-grams of each language; a missing n-gram has the rank ``top``.

    ``lang`` and ``rank`` list the languages that have an n-gram, one n-gram of ``grams`` after another.
    """

    def __init__(self, counts: dict[str, list[tuple[int, int]]], top: int = TOP):
        self.langs, self.top = sorted(counts), top
        first = [[g for g, _ in sorted(counts[lang], key=lambda x: (-x[1], x[0]))[:top]] for lang in self.langs]
        sizes = np.array([len(grams) for grams in first], np.int64)
        gram = np.array([g for grams in first for g in grams], np.uint64)
        order = np.argsort(gram, kind="stable")
        self.lang = np.repeat(np.arange(len(first)), sizes)[order]
        self.rank = ragged(np.zeros(len(first), np.int64), sizes)[order]
        gram = gram[order]
        at = runs(gram)
        self.grams, self.starts, self.sizes = gram[at[:-1]], at[:-1], np.diff(at)

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        """Language with the least out-of-place distance, and 1 minus that distance by the largest one."""
        langs, scores = [], []
        for i, j in byte_slices(text_buffers(column)[1], SLICE_BYTES):
            lang, score = self._predict(column.slice(i, j - i))
            langs += lang
            scores.append(score)
        return langs, np.concatenate(scores) if scores else np.zeros(0)

    def _predict(self, column) -> tuple[list[str], np.ndarray]:
        n = len(column)
        text, gram, rank = ranked(column, self.top)
        grams = np.bincount(text, minlength=n)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        at = np.searchsorted(self.grams, gram)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == gram[known]
        text, at, rank = text[known], at[known], rank[known]
        met = np.bincount(text, weights=self.sizes[at], minlength=n).astype(np.int64)
        first = np.searchsorted(text, np.arange(n + 1))
        nearness, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, j in byte_slices(np.concatenate(([0], np.cumsum(np.maximum(met, len(self.langs))))), CELLS):
            own = slice(first[i], first[j])
            sizes = self.sizes[at[own]]
            there = ragged(self.starts[at[own]], sizes)
            cell = np.repeat(text[own] - i, sizes) * len(self.langs) + self.lang[there]
            near = self.top - np.abs(self.rank[there] - np.repeat(rank[own], sizes))
            total = np.bincount(cell, weights=near, minlength=(j - i) * len(self.langs)).reshape(j - i, len(self.langs))
            best[i:j] = total.argmax(axis=1)
            nearness[i:j] = total[np.arange(j - i), best[i:j]]
        score = np.where(grams > 0, 1 - (grams * self.top - nearness) / np.maximum(1, grams * self.top), 0.0)
        return [self.langs[b] if g else UNKNOWN for b, g in zip(best.tolist(), grams)], np.clip(score, 0, 1)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 by 4; null ids too are none."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", top: int = TOP,
    sample_docs: int = SAMPLE_DOCS,
) -> Profiles:
    """Profiles of all labelled languages, from about ``sample_docs`` documents of each.

    Labels are counted over all rows.  A language's documents are then picked by a hash of the id below
    a threshold, where they are read; only n-gram counts are shuffled, and cut to the first ``top`` of
    each language before they reach the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("_id"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    own = own.filter(F.col("_id").isNotNull() & F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out("_id"))
    sizes = own.groupBy("_lang").count().filter(F.col("count") > sample_docs)
    share = sizes.select("_lang", (F.lit(float(sample_docs)) / F.col("count")).alias("_share"))
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    picked = skew_join(own, share, ["_lang"], "left").filter(place < F.coalesce("_share", F.lit(1.0)) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).cast(pa.string()).dictionary_encode()
            group = names.indices.to_numpy().astype(np.int64)
            for i, j in byte_slices(text_buffers(batch.column(1))[1], SLICE_BYTES):
                g, gram, count = gram_counts(batch.column(1).slice(i, j - i), group[i:j])
                yield pa.RecordBatch.from_arrays(
                    [names.dictionary.take(pa.array(g)), pa.array(gram.astype(np.int64)), pa.array(count)],
                    ["lang", "gram", "n"],
                )

    grams = picked.select("_lang", "_text").mapInArrow(run, "lang string, gram bigint, n bigint")
    grams = written(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in first_many_per_group(grams, ["lang"], [F.desc("n"), F.col("gram")], top).collect():
        counts.setdefault(r["lang"], []).append((r["gram"], r["n"]))
    return Profiles(counts, top)


def identify(
    docs: DataFrame, profiles: Profiles, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The rows with language and score added under ``names`` (such columns are replaced); no shuffle.

    A text that is null or has no letters gets ``und`` and 0.  Ties of distance go to the first language
    in alphabetical order.  Whole texts are ranked.  Without profiles all texts get ``und``.
    """
    small_batches(docs.sparkSession)
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in names]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = profiles.predict(batch.column(kept.index(text)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*kept, *names]
            )

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out.

    Null ids are neither learned from nor held out; repeated rows are all rated; other columns are not
    read, whatever their names; an empty table gives no rows.
    """
    profiles = learn(docs, id_col, text, lang)
    rated = identify(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), profiles)
    return rated.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
