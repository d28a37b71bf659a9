"""Repeated passages: every byte covered by a string of some length that also starts earlier.

Suffixes are sorted with comparisons by prefix hashes: a polynomial hash of every prefix gives the hash
of any range at once, binary search over the length finds how far two suffixes agree, and one byte
decides.  A merge sort with such comparisons brings equal strings together; bytes confirm them.

Not all suffixes of a corpus are sorted.  The smallest hash of a k-gram inside a window of ``LENGTH``
bytes (its anchor) depends on the window alone, so equal windows have equal anchors.  Windows of a
document with one anchor are a segment; segments whose anchor occurs once hold nothing that repeats and
are dropped by a count.  A segment that equals an earlier one as a whole is repeated as a whole.  What
is left, distinct segments with a common anchor, is sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sitelore.llm.common import (
    byte_slices, grouped, keys64, mix, ragged, runs, skew_join, small_batches, text_buffers, written,
)

LENGTH, GRAM = 100, 32
#: Distinct segments of an anchor that are sorted at once.
BLOCK = 512
SLICE_BYTES, CHUNK = 1_000_000, 1 << 23
_BASE = 0x9E3779B97F4A7C15
_VALUES = keys64(256, 41)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(_BASE)
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    out = []
    for x in (base, inverse):
        p = np.full(n + 1, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class PrefixHashes:
    """Polynomial hashes of all prefixes of some bytes; of any range by a difference."""

    def __init__(self, body: np.ndarray):
        size = 1 << max(10, len(body).bit_length())
        power, inverse = _powers(size)
        self.body, self.inverse = body, inverse
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_VALUES[body] * power[: len(body)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Bytes, up to ``most``, in which the suffixes at ``a`` and ``b`` agree."""
        found = np.zeros(len(a), np.int64)
        step = 1 << (most.bit_length() - 1)
        while step:
            longer = found + step
            ok = longer <= most
            longer = np.minimum(longer, most)
            ok &= self.of(a, longer) == self.of(b, longer)
            found = np.where(ok, longer, found)
            step //= 2
        return found

    def before(self, a: np.ndarray, b: np.ndarray, most: int, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at ``a`` sorts before that at ``b`` by its first ``most`` bytes."""
        same = self.common(a, b, most)
        at = np.minimum(same, most - 1)
        return np.where(same == most, or_equal, self.body[a + at] < self.body[b + at])


def sort_suffixes(hashes: PrefixHashes, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Stable order of suffixes inside their groups (``group`` ascending): a merge sort, all groups at once."""
    n = len(at)
    order = np.arange(n)
    edges = runs(group)
    first = np.repeat(edges[:-1], np.diff(edges))
    last = np.repeat(edges[1:], np.diff(edges))
    largest, width = int(np.diff(edges).max()) if n else 0, 1
    while width < largest:
        here = np.flatnonzero(last - first > width)
        own = here - first[here]
        run = own // width
        start = first[here] + run // 2 * 2 * width
        is_left = run % 2 == 0
        other = np.where(is_left, start + width, start)
        end = np.minimum(other + width, last[here])
        busy = other < end
        here, start, is_left, low, high, own = (x[busy] for x in (here, start, is_left, other, end, own))
        me = at[order[here]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            less = hashes.before(at[order[mid]], me[open_], most, ~is_left[open_])
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        base = np.where(is_left, start + width, start)
        target = start + own % width + (low - base)
        merged = order.copy()
        merged[target] = order[here]
        order, width = merged, width * 2
    return order


def repeated(body: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal string before it in its group, number of the first equal one) for strings at ``at``.

    Strings come in the order that says what is earlier, group by group.  Neighbours in the sorted order
    that agree by hash are compared byte by byte; a group in which a hash lied is compared by bytes alone.
    """
    dup, lead = np.zeros(len(at), bool), np.arange(len(at))
    if len(at) < 2:
        return dup, lead
    hashes = PrefixHashes(body)
    order = sort_suffixes(hashes, at, group, length)
    a, b = at[order[:-1]], at[order[1:]]
    pair = np.flatnonzero(group[1:] == group[:-1])
    pair = pair[hashes.of(a[pair], length) == hashes.of(b[pair], length)]
    windows = np.lib.stride_tricks.sliding_window_view(body, length)
    true = np.zeros(len(pair), bool)
    for k in range(0, len(pair), 20_000):
        part = pair[k : k + 20_000]
        true[k : k + 20_000] = (windows[a[part]] == windows[b[part]]).all(axis=1)
    same = np.zeros(len(at), bool)
    same[pair[true] + 1] = True
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
    lead[order] = order[heads]
    dup[order] = same
    for g in np.unique(group[order[pair[~true]]]):
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(group == g).tolist():
            lead[i] = seen.setdefault(body[at[i] : at[i] + length].tobytes(), i)
            dup[i] = lead[i] != i
    return dup, lead


def segments(body: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, first window, windows, place of the anchor, hash of the anchor, hash of all bytes) of all segments."""
    parts = []
    for i, j in byte_slices(offsets, SLICE_BYTES):
        lo, hi = int(offsets[i]), int(offsets[j])
        for start in range(lo, max(lo + 1, hi - length + 1), CHUNK):  # one slice, but for very long texts
            end = min(hi, start + CHUNK + length - 1)
            if end - start >= length:
                parts.append(_segments(body[start:end], np.clip(offsets[i : j + 1] - start, 0, end - start), start, i, offsets, length, gram))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _segments(body, bounds, shift, first_text, offsets, length, gram):
    hashes = PrefixHashes(body)
    n, width = len(body), length - gram + 1
    starts = np.arange(n - gram + 1)
    x = mix(hashes.of(starts, gram))
    low = np.uint64((1 << 24) - 1)
    y = (x & ~low) | starts.astype(np.uint64)  # of equal hashes the leftmost wins
    span = 1
    while span * 2 <= width:
        y = np.minimum(y[:-span], y[span:])
        span *= 2
    if width > span:
        y = np.minimum(y[: len(y) - (width - span)], y[width - span :])
    anchor = (y & low).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: n - length + 1]
    window = np.flatnonzero(np.arange(n - length + 1) + length <= bounds[text + 1])
    if not len(window):
        return tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
    place, text = anchor[window], text[window]
    cut = np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    at = np.append(np.flatnonzero(cut), len(window))
    lo, m, place, text = window[at[:-1]], np.diff(at), place[at[:-1]], text[at[:-1]]
    whole = mix(hashes.of(lo, m + length - 1) + m.astype(np.uint64))
    inside = lo + shift - offsets[first_text + text]
    return text + first_text, inside, m, place - lo, mix(x[place] + np.uint64(1)), whole


def _emit_segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            body, offsets = text_buffers(batch.column(1))
            text, lo, m, place, anchor, whole = segments(body, offsets, length, gram)
            at = (lo * 128 + m) * 128 + place
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[text]), pa.array(at)],
                ["h", "e", "doc", "at"],
            )

    return run


def _anchors_only(length: int, gram: int):
    emit = _emit_segments(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emit(batches):
            yield batch.select(["h"])

    return run


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 14, (at >> 7) & 127, at & 127


def merge_spans(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray):
    """(text, start, end) of the maximal runs of covered bytes of all texts, in order."""
    lo, hi = np.minimum(lo, size[owner]), np.minimum(hi, size[owner])
    keep = lo < hi
    order = np.lexsort((lo[keep], owner[keep]))
    owner, lo, hi = owner[keep][order], lo[keep][order], hi[keep][order]
    if not len(owner):
        return owner, lo, hi
    base = np.concatenate(([0], np.cumsum(size + 1)))[owner]  # each text in a range of its own
    ends = np.maximum.accumulate(hi + base)
    first = np.flatnonzero(np.concatenate(([True], (lo + base)[1:] > ends[:-1])))
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], lo[first], (ends - base)[last]


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """Row of each item, and the items of all rows one after another; a null list has none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _numbers(items: pa.StructArray, name: str) -> np.ndarray:
    return items.field(name).to_numpy(zero_copy_only=False)


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text binary"


def _result(ids, body: np.ndarray, offsets: np.ndarray, rows: np.ndarray, runs_of, keep_text: bool):
    """Result columns of some rows, given the runs to remove of all rows."""
    owner, lo, hi = runs_of
    first, last = np.searchsorted(owner, rows), np.searchsorted(owner, rows, "right")
    out = []
    for row, a, b in zip(rows.tolist(), first.tolist(), last.tolist()):
        data = body[offsets[row] : offsets[row + 1]].tobytes()
        at, kept, gone = 0, [], 0
        for x, y in zip(lo[a:b].tolist(), hi[a:b].tolist()):
            kept.append(data[at:x])
            at, gone = y, gone + y - x
        kept = b"".join([*kept, data[at:]])
        out.append((len(data), gone, b - a, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
    n, removed, count, sha, kept = zip(*out) if out else ((),) * 5
    return [ids.take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string()),
            pa.array(kept, pa.binary())]


_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]


def _finish_or_keep(length: int, keep_text: bool):
    """Documents with nothing left to sort get their result, the others go on with text and segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, items = _flat(batch.column(2))
            to_sort = items.field("h").is_valid().to_numpy(zero_copy_only=False)
            waits = np.bincount(owner[to_sort], minlength=batch.num_rows) > 0
            body, offsets = text_buffers(batch.column(1))
            lo, m, _ = _unpack(_numbers(items, "at")[~to_sort])
            spans = merge_spans(owner[~to_sort], lo, lo + m + length - 1, np.diff(offsets))
            out = _result(batch.column(0), body, offsets, np.flatnonzero(~waits), spans, keep_text)
            nothing = [pa.nulls(len(out[0]), batch.schema.field(c).type) for c in (1, 2)]
            yield pa.RecordBatch.from_arrays([*out, *nothing], [*_NAMES, "text", "items"])
            rest = batch.take(pa.array(np.flatnonzero(waits)))
            empty = [pa.nulls(rest.num_rows, x.type) for x in out[1:]]
            yield pa.RecordBatch.from_arrays(
                [rest.column(0), *empty, rest.column(1), rest.column(2)], [*_NAMES, "text", "items"]
            )

    return run


def _extract(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, items = _flat(batch.column(2))
            pick = np.flatnonzero(items.field("h").is_valid().to_numpy(zero_copy_only=False))
            body, offsets = text_buffers(batch.column(1))
            lo, m, _ = _unpack(_numbers(items, "at")[pick])
            # another text with the same id may be too short for a segment
            fits = lo + m + length - 1 <= np.diff(offsets)[owner[pick]]
            pick, lo, size = pick[fits], lo[fits], (m + length - 1)[fits]
            owner, items = owner[pick], items.take(pa.array(pick))
            data = np.ascontiguousarray(body[ragged(offsets[owner] + lo, size)])
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [*(items.field(c) for c in ("h", "block", "split")), batch.column(0).take(pa.array(owner)), items.field("at"), data],
                ["h", "block", "split", "doc", "at", "bytes"],
            )

    return run


def _sort_segments(length: int):
    """Repeated windows of the segments of each anchor and block as spans.

    Where an anchor has several blocks, the first of each distinct window is returned with its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["h", "block"]):
            table = table.combine_chunks()
            h, block, doc, at = (table.column(c).to_numpy() for c in ("h", "block", "doc", "at"))
            split = table.column("split").to_numpy(zero_copy_only=False)
            order = np.lexsort((at, doc, block, h))
            h, block, doc, at, split = (x[order] for x in (h, block, doc, at, split))
            data = table.column("bytes").chunk(0).take(pa.array(order))
            offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
            body = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            lo, m, place = _unpack(at)
            owner = np.repeat(np.arange(len(h)), m)
            step = ragged(np.zeros(len(m), np.int64), m)
            start = (offsets[:-1] - offsets[0])[owner] + step
            # equal windows have their anchor at one offset, so each offset is a group of its own
            unit = np.concatenate(([0], np.cumsum((h[1:] != h[:-1]) | (block[1:] != block[:-1]))))[owner]
            key = unit * 128 + (place[owner] - step)
            by = np.lexsort((step, owner, key))
            dup, lead = repeated(body, start[by], key[by], length)
            flag = np.zeros(len(by), bool)
            flag[by] = dup
            hit = np.flatnonzero(flag)
            edge = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]))) if len(hit) else np.zeros(0, bool)
            a = np.flatnonzero(edge)
            b = np.append(a[1:], len(hit))
            who = owner[hit[a]] if len(hit) else np.zeros(0, np.int64)
            out_lo = lo[who] + step[hit[a]] if len(hit) else who
            out_hi = lo[who] + step[hit[b - 1]] + length if len(hit) else who
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[who]), pa.array(out_lo), pa.array(out_hi), pa.nulls(len(who), pa.binary())],
                ["doc", "lo", "hi", "window"],
            )
            firsts = np.flatnonzero(~flag & split[owner])
            if len(firsts):
                win = np.lib.stride_tricks.sliding_window_view(body, length)[start[firsts]]
                ends = np.arange(0, length * len(firsts) + 1, length, dtype=np.int32)
                win = pa.BinaryArray.from_buffers(
                    pa.binary(), len(firsts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(win))]
                )
                who = owner[firsts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[who]), pa.array(lo[who] + step[firsts]), pa.array(lo[who] + step[firsts] + length), win],
                    ["doc", "lo", "hi", "window"],
                )

    return run


def _remove(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, items = _flat(batch.column(2))
            whole = ~items.field("h").is_valid().to_numpy(zero_copy_only=False)
            lo, m, _ = _unpack(_numbers(items, "at")[whole])
            who, found = _flat(batch.column(3))
            body, offsets = text_buffers(batch.column(1))
            spans = merge_spans(
                np.concatenate((owner[whole], who)), np.concatenate((lo, _numbers(found, "lo"))),
                np.concatenate((lo + m + length - 1, _numbers(found, "hi"))), np.diff(offsets),
            )
            rows = np.arange(batch.num_rows)
            yield pa.RecordBatch.from_arrays(_result(batch.column(0), body, offsets, rows, spans, keep_text), _NAMES)

    return run


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a
    smaller id, or in the same one at an earlier place.  Strings are judged on the input.  Matches never
    cross documents.

    What is shuffled: the anchor of each segment (about one for 35 bytes) for the count, the segments
    once, then the texts once.  Anchors with very many distinct segments are sorted in blocks; the first
    of each distinct window of a block then meets the other blocks' in a partial aggregate of its bytes.

    Null and empty texts have no bytes and lose none.  Rows with a null id lose nothing and count for no
    other row.  Rows that share an id are one document: equal strings at equal places of them are no
    repeats, and what goes from one goes from the others at the same places.  Other columns are not read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = rows.filter("doc_id is not null")
    anchors = known.mapInArrow(_anchors_only(length, gram), "h bigint")
    twice = written(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("h"), "anchors")
    found = known.mapInArrow(_emit_segments(length, gram), "h bigint, e bigint, doc bigint, at bigint")
    found = written(found.join(twice, "h").withColumn("m", F.expr("shiftright(at, 7) & 127")), "segments")
    same = ["h", "e", "m"]
    distinct = written(
        found.groupBy(*same).agg(F.min(F.struct("doc", "at")).alias("_f"), F.count(F.lit(1)).alias("_n"))
        .select(*same, F.col("_f.doc").alias("first_doc"), F.col("_f.at").alias("first_at"), "_n"), "distinct",
    )
    whole = found.join(distinct.filter("_n > 1").drop("_n"), same).filter("doc <> first_doc or at <> first_at")
    mixed = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    mixed = mixed.select("h", F.ceil(F.col("_k") / BLOCK).cast("int").alias("_k"))
    sort_these = skew_join(distinct.select("h", F.col("first_doc").alias("doc"), F.col("first_at").alias("at")), mixed, ["h"])
    items = whole.select(
        "doc", F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("block"), F.lit(False).alias("split"), "at"
    ).union(sort_these.select(
        "doc", "h", F.pmod(F.xxhash64("doc", "at"), F.col("_k")).cast("int").alias("block"), (F.col("_k") > 1).alias("split"), "at"
    ))
    per_doc = items.groupBy("doc").agg(F.collect_list(F.struct("h", "block", "split", "at")).alias("items"))
    # the text moves once, to its segments; documents that are done leave only their result
    item = "array<struct<h: bigint, block: int, split: boolean, at: bigint>>"
    joined = rows.join(per_doc, rows["doc_id"] == per_doc["doc"], "left").select("doc_id", "text", "items")
    stage = written(
        joined.mapInArrow(_finish_or_keep(length, keep_text), f"doc_id bigint, {RESULT}, text string, items {item}"), "stage"
    )
    work = stage.filter("items is not null")
    pieces = work.select("doc_id", "text", "items").mapInArrow(
        _extract(length), "h bigint, block int, split boolean, doc bigint, at bigint, bytes binary"
    )
    small_batches(spark, 4000)
    sorted_ = written(
        pieces.repartition("h", "block").sortWithinPartitions("h", "block")
        .mapInArrow(_sort_segments(length), "doc bigint, lo bigint, hi bigint, window binary"), "spans",
    )
    small_batches(spark)
    firsts = sorted_.filter("window is not null")
    earliest = firsts.groupBy("window").agg(F.min(F.struct("doc", "lo")).alias("_f"), F.count(F.lit(1)).alias("_n"))
    again = skew_join(firsts, earliest.filter("_n > 1").drop("_n"), ["window"]).filter(
        "doc <> _f.doc or lo <> _f.lo"
    )
    spans = sorted_.filter("window is null").select("doc", "lo", "hi").union(again.select("doc", "lo", "hi"))
    per_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    rest = work.select("doc_id", "text", "items").join(per_doc, F.col("doc_id") == F.col("doc"), "left")
    cut = rest.select("doc_id", "text", "items", "found").mapInArrow(_remove(length, keep_text), f"doc_id bigint, {RESULT}")
    out = stage.filter("items is null").select(*_NAMES).union(cut)
    return out if keep_text else out.drop("kept_text")
