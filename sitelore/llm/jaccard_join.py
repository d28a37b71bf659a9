"""Near-duplicate documents: grouped prefix join on the Jaccard similarity of word shingles.

A total order of shingles, the rare ones first, makes two similar sets share a shingle among the first
few of each (the prefix).  Documents with equal sets, and then those with equal prefixes and sizes, are
one group.  Pairs of groups that share a prefix shingle are filtered by their sizes and by how much can
still be common from that shingle on; the members of the pairs left are verified with their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitelore.llm.common import (
    byte_slices, find, grouped, keys64, mix, ragged, skew_join, small_batches, text_buffers, written,
)
from sitelore.llm.components import components
from sitelore.llm.shingles import shingle_sets

#: Words of a shingle and least similarity in hundredths.
WORDS, PERCENT = 3, 90
#: Shingles whose frequency is counted: this multiple of the prefix share of all shingles.
COUNTED = 2.2
#: Documents of a cell: those of two cells are verified at once.
BLOCK = 128
#: Entries of a posting list on each side of a block, pairs of them judged at once, and prefix shingles
#: before the common one that an entry carries, so that a pair is proposed once.
POSTED, PAIRS, EARLIER = 1024, 200_000, 4
SLICE_BYTES = 1_000_000


def prefix_size(n, percent: int):
    """Shingles of a set of ``n`` that must hold one of any similar set's prefix: n - ceil(t n) + 1."""
    return n - -(-n * percent // 100) + 1


def counted_share(percent: int) -> float:
    return min(1.0, COUNTED * (1 - percent / 100))


def _sets(batch: pa.RecordBatch, column: int, words: int):
    """(first row, last row, hashes, offsets) for slices of a batch's texts."""
    body, offsets = text_buffers(batch.column(column))
    for i, j in byte_slices(offsets, SLICE_BYTES):
        part = body[offsets[i] : offsets[j]]
        flat, bounds = shingle_sets(part, offsets[i : j + 1] - offsets[i], words)
        yield i, j, flat, bounds


def _names(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, whatever its order."""
    sums = [np.zeros(len(flat) + 1, np.uint64) for _ in range(2)]
    for x, salt in zip(sums, (11, 97)):
        np.cumsum(mix(flat + np.uint64(salt)), dtype=np.uint64, out=x[1:])
    size = np.diff(bounds).astype(np.uint64)
    return tuple(mix(x[bounds[1:]] - x[bounds[:-1]] + size * k) for x, k in zip(sums, keys64(2, 5)))


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, flat, bounds in _sets(batch, 1, words):
                one, two = _names(flat, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(one.view(np.int64)),
                     pa.array(two.view(np.int64))], ["doc_id", "n", "c", "c2"],
                )

    return run


def _counted(flat: np.ndarray, percent: int) -> np.ndarray:
    """Which shingles have their frequency counted: a share of all by hash, the same in every set."""
    return (mix(flat + np.uint64(3)) >> np.uint64(44)) < np.uint64(counted_share(percent) * (1 << 20))


def _count(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, flat, _ in _sets(batch, 0, words):
                yield pa.RecordBatch.from_arrays([pa.array(flat[_counted(flat, percent)].view(np.int64))], ["token"])

    return run


def _post(words: int, percent: int):
    """Rows (token, c, n, counted): the counted shingles, and the first others if a prefix needs more.

    ``extra`` marks those others; they stand behind all counted shingles, by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, flat, bounds in _sets(batch, 0, words):
                one, _ = _names(flat, bounds)
                size = np.diff(bounds)
                owner = np.repeat(np.arange(len(size)), size)
                yes = _counted(flat, percent)
                counted = np.bincount(owner[yes], minlength=len(size))
                rest = ~yes
                place = np.cumsum(rest)  # the sets are sorted by hash, so the first others come first
                start = np.concatenate(([0], place))[bounds[:-1]]
                need = np.maximum(0, prefix_size(size, percent) - counted)
                extra = rest & (place - start[owner] <= need[owner])
                keep = yes | extra
                who = owner[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[keep].view(np.int64)), pa.array(one.view(np.int64)[who]), pa.array(size[who]),
                     pa.array(counted[who]), pa.array(extra[keep])], ["token", "c", "n", "counted", "extra"],
                )

    return run


def _members(words: int):
    """The sets of the documents that stand for a candidate set, and no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(1).to_numpy()
            for i, j, flat, bounds in _sets(batch, 0, words):
                one, _ = _names(flat, bounds)
                hit = np.flatnonzero(one.view(np.int64) == want[i:j])
                size = np.diff(bounds)[hit]
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(want[i:j][hit]),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[ragged(bounds[:-1][hit], size)].view(np.int64)))],
                    ["c", "shingles"],
                )

    return run


def _filter_pairs(percent: int):
    """Pairs of group parts in the posting lists that may reach the similarity, by pair of cells.

    A pair passes if its sizes fit and the shingles from its common one on suffice; a pair that shares one
    of the first prefix shingles before this one was judged there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["token", "size", "block_i", "block_j"]):
            table = table.combine_chunks()
            keys = [table.column(x).to_numpy() for x in ("token", "size", "block_i", "block_j")]
            side, part, cell, n, place, upper = (
                table.column(x).to_numpy() for x in ("side", "part", "cell", "n", "place", "upper")
            )
            lists = table.column("earlier").chunk(0)
            offs = lists.offsets.to_numpy()
            width = np.arange(EARLIER)[None, :] < np.diff(offs)[:, None]
            earlier = np.zeros((len(part), EARLIER), np.int64)
            earlier[width] = lists.flatten().to_numpy()
            change = np.zeros(len(part), bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            heads = np.concatenate(([0], np.flatnonzero(change)))
            ends = np.concatenate((heads[1:], [len(part)]))
            owner = np.cumsum(change)
            second = ends - np.add.reduceat((side == 1).astype(np.int64), heads)  # side 1 stands at the end
            row = np.arange(len(part))
            start = np.where(side == 2, row + 1, second[owner])
            count = np.where(side == 1, 0, ends[owner] - start)
            upto, at, found = np.cumsum(count), 0, []
            while at < len(part):
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                left = np.repeat(row[at:stop], count[at:stop])
                right = ragged(start[at:stop], count[at:stop])
                at = stop
                small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
                rest = np.minimum(n[left] - place[left], n[right] - place[right])
                fit = (small * 100 >= large * percent) & ((100 + percent) * rest >= percent * (small + large))
                fit &= ~(upper[left] & upper[right]) & (part[left] != part[right])
                left, right = left[fit], right[fit]
                seen = np.zeros(len(left), bool)
                for x in range(EARLIER):
                    for y in range(EARLIER):
                        seen |= (earlier[left, x] == earlier[right, y]) & width[left, x] & width[right, y]
                found.append((left[~seen], right[~seen]))
            left, right = (np.concatenate(x) for x in zip(*found))
            yield _by_cells(part[left], part[right], cell[left], cell[right])

    return run


def _by_cells(u: np.ndarray, v: np.ndarray, cu: np.ndarray, cv: np.ndarray) -> pa.RecordBatch:
    """One row for each pair of cells, with its pairs in two arrays; the lesser (cell, part) comes first."""
    swap = (cu > cv) | ((cu == cv) & (u > v))
    u, v, cu, cv = np.where(swap, v, u), np.where(swap, u, v), np.where(swap, cv, cu), np.where(swap, cu, cv)
    order = np.lexsort((v, u, cv, cu))
    u, v, cu, cv = u[order], v[order], cu[order], cv[order]
    new = np.ones(len(u), bool)
    new[1:] = (cu[1:] != cu[:-1]) | (cv[1:] != cv[:-1])
    first = np.flatnonzero(new)
    ends = pa.array(np.concatenate((first, [len(u)])).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(cu[first]), pa.array(cv[first]), pa.ListArray.from_arrays(ends, pa.array(u)),
         pa.ListArray.from_arrays(ends, pa.array(v))], ["cu", "cv", "us", "vs"],
    )


def _verify(percent: int):
    """A forest of the links among the members of the group pairs of each pair of cells."""

    def links(c, part, flat, bounds, us, vs):
        order = np.argsort(part, kind="stable")
        parts, first, many = np.unique(part[order], return_index=True, return_counts=True)
        codes = np.unique(np.searchsorted(parts, us) * len(parts) + np.searchsorted(parts, vs))
        pu, pv = codes // len(parts), codes % len(parts)
        size = np.diff(bounds)
        local = np.unique(flat, return_inverse=True)[1]
        mark = np.zeros(int(local.max()) + 1, bool)
        parent = np.arange(len(c))
        for p in np.unique(pu).tolist():
            others = pv[pu == p]
            own = others == p
            outside = order[ragged(first[others[~own]], many[others[~own]])]
            inside = order[first[p] : first[p] + many[p]] if own.any() else order[:0]
            for k, a in enumerate(order[first[p] : first[p] + many[p]].tolist()):
                root = find(parent, a)
                fit = np.concatenate((inside[k + 1 :], outside))
                fit = fit[parent[fit] != root]
                if not len(fit):
                    continue
                tokens = local[bounds[a] : bounds[a + 1]]
                mark[tokens] = True
                met = np.concatenate(([0], np.cumsum(mark[local[ragged(bounds[fit], size[fit])]])))
                mark[tokens] = False
                ends = np.cumsum(size[fit])
                same = met[ends] - met[ends - size[fit]]
                near = 100 * same >= percent * (size[fit] + size[a] - same)
                for b in fit[near].tolist():
                    x, y = find(parent, a), find(parent, b)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        yield c[a], c[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["cu", "cv"]):
            table = table.combine_chunks()
            cu, cv = (table.column(x).to_numpy() for x in ("cu", "cv"))
            is_set = table.column("c").is_valid().to_numpy()
            c, part = (table.column(x).fill_null(0).to_numpy() for x in ("c", "part"))
            sets, us, vs = (table.column(x).chunk(0) for x in ("shingles", "us", "vs"))
            change = np.flatnonzero((cu[1:] != cu[:-1]) | (cv[1:] != cv[:-1])) + 1
            out = []
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(cu)]):
                pick = np.flatnonzero(is_set[a:b])
                if len(pick) < 2:
                    continue
                own = sets.slice(a, b - a).take(pa.array(pick))
                bounds = own.offsets.to_numpy().astype(np.int64)
                out += links(
                    c[a:b][pick], part[a:b][pick], own.flatten().to_numpy(), bounds - bounds[0],
                    us.slice(a, b - a).flatten().to_numpy(), vs.slice(a, b - a).flatten().to_numpy(),
                )
            u, v = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _prefixes(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """c, n and the prefix shingles that another document has too, for each set that has such ones.

    Frequencies are counted for a fixed share of all shingles, by hash, over all documents.  The order is:
    counted shingles by frequency, then the others; any order the documents agree on is right, this one
    makes most prefixes hold nothing that another document has.
    """
    tokens = texts.mapInArrow(_count(words, percent), "token bigint")
    common = written(
        tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shingles"
    )
    posts = texts.mapInArrow(_post(words, percent), "token bigint, c bigint, n bigint, counted bigint, extra boolean")
    met = posts.join(common, "token", "left").filter("df is not null or extra")
    once = met.groupBy("c", "token").agg(
        F.first("n").alias("n"), F.first("counted").alias("counted"), F.first("extra").alias("extra"), F.first("df").alias("df")
    )
    per_set = once.groupBy("c").agg(
        F.first("n").alias("n"), F.first("counted").alias("counted"), F.sum(F.when(F.col("extra"), 0).otherwise(1)).alias("met"),
        F.sort_array(F.collect_list(F.struct(
            "extra", F.coalesce("df", F.lit(0)).alias("df"), F.col("token").bitwiseXOR(F.lit(-(1 << 63))).alias("rank"), "token"
        ))).alias("tokens"),  # ``rank`` orders as unsigned, as the others were chosen
    )
    # the counted shingles that no other document has come first, and nothing is found by them
    room = f"n - cast(ceil(n * {percent} / 100.0BD) as bigint) + 1 - (counted - met)"
    return (
        per_set.withColumn("room", F.expr(room)).filter("room > 0")
        .select("c", "n", F.expr("transform(slice(tokens, 1, cast(room as int)), x -> x.token)").alias("prefix"))
    )


def group_pairs(prefixes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidates: (cu, cv, us, vs), pairs of group parts by pair of cells, and (c, part), the members.

    Sets with equal sizes and prefixes are a group; one of more than ``BLOCK`` members has several parts,
    so a pair of cells is bounded.  Parts are posted under their prefix shingles and size classes; a long
    posting list is dealt into pairs of blocks.  Pairs are filtered by size and place inside tasks.  A
    cell holds about ``BLOCK`` sets that are likely to meet (they have the same least partner), so the
    sets of many near copies are sent once for each pair of cells, not once for each pair.
    """
    same = prefixes.groupBy("n", "prefix").agg(F.min("c").alias("g"), F.count(F.lit(1)).alias("_m"))
    dealt = skew_join(prefixes, same, ["n", "prefix"]).withColumn("_k", F.ceil(F.col("_m") / BLOCK))
    part = F.when(F.col("_k") == 1, F.col("g")).otherwise(F.xxhash64("g", F.pmod(F.xxhash64("c", F.lit(3)), "_k")))
    groups = written(dealt.select("c", "n", "prefix", part.alias("part")), "groups")
    parts = groups.groupBy("part").agg(
        F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("prefix").alias("prefix")
    )
    # sizes that allow the similarity lie in the same or in neighbouring classes
    step = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9
    entries = parts.withColumn("_size", F.floor(F.log("n") / F.lit(step))).select(
        "part", "m", "n", "_size", F.size("prefix").alias("_long"), F.posexplode("prefix").alias("_at", "token"),
        "prefix",
    ).select(
        "part", "m", "n", "token",
        F.expr(f"n - cast(ceil(n * {percent} / 100.0BD) as bigint) + 1 - _long + _at").alias("place"),
        F.expr(f"slice(prefix, 1, least(_at, {EARLIER}))").alias("earlier"),
        F.posexplode(F.array("_size", F.col("_size") + 1)).alias("_up", "size"),
    ).withColumn("upper", F.col("_up") == 1).drop("_up")
    heads = entries.groupBy("token", "size").agg(F.min("part").alias("head"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    posted = written(skew_join(entries, heads, ["token", "size"]), "posted")
    labels = posted.groupBy("part").agg(F.min("head").alias("label"), F.first("m").alias("m"))
    copies = parts.filter("m > 1").select("part", "m")
    labels = written(
        labels.join(copies.select("part", F.col("m").alias("_m")), "part", "full")
        .select("part", F.coalesce("label", "part").alias("label"), F.coalesce("m", "_m").alias("m")), "labels",
    )
    per_label = labels.groupBy("label").agg(F.ceil(F.sum("m") / BLOCK).alias("_k"))
    cells = written(
        skew_join(labels, per_label, ["label"])
        .select("part", "m", F.xxhash64("label", F.pmod(F.xxhash64("part", F.lit(5)), "_k")).alias("cell")), "cells",
    )
    lists = posted.join(cells.select("part", "cell"), "part").withColumn("_k", F.ceil(F.col("_n") / POSTED).cast("int"))
    lists = lists.withColumn("_b", F.pmod(F.xxhash64("part", F.lit(7)), "_k").cast("int")).withColumn(
        "_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    )
    blocks = lists.select(
        "token", "size", F.least("_b", "_o").alias("block_i"), F.greatest("_b", "_o").alias("block_j"),
        F.expr("case when _b = _o then 2 when _b < _o then 0 else 1 end").alias("side"),
        "part", "cell", "n", "place", "upper", "earlier",
    )
    blocks = blocks.repartition("token", "size", "block_i", "block_j").sortWithinPartitions(
        "token", "size", "block_i", "block_j", "side"
    )
    shape = "cu bigint, cv bigint, us array<bigint>, vs array<bigint>"
    own = cells.filter("m > 1").groupBy("cell").agg(F.collect_list("part").alias("us"))
    own = own.select(F.col("cell").alias("cu"), F.col("cell").alias("cv"), "us", F.col("us").alias("vs"))
    return written(blocks.mapInArrow(_filter_pairs(percent), shape).union(own), "pairs"), groups.select("c", "part")


def parts_met(pairs: DataFrame) -> DataFrame:
    """(cu, cv, part): the group parts of each pair of cells, named once however many shingles propose them."""
    met = pairs.groupBy("cu", "cv").agg(F.array_distinct(F.flatten(F.collect_list(F.array_union("us", "vs")))).alias("parts"))
    return met.select("cu", "cv", F.explode("parts").alias("part"))


def link_documents(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, and ``set_id``, equal for equal sets.

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle sets; a component
    is named by its smallest id.  Shingles are 64-bit hashes of words; whole texts are read.  Only
    members of group pairs that pass the filters of ``group_pairs`` are compared, and only a forest of
    links leaves the tasks.  A very long text is one set, held whole by the task that reads it.

    Documents without words (null, empty, white space only) have no shingles and link with nothing.
    Rows with a null id get a component by their links like others; a component of null ids only has
    a null id.  Rows that repeat an id are one document.  Other columns are not read.  An empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = written(
        rows.mapInArrow(_describe(words), "doc_id bigint, n bigint, c bigint, c2 bigint"), "sets"
    )
    sets = named.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"))
    prefixes = written(_prefixes(rows.select("text"), words, percent), "prefixes")
    pairs, parts = group_pairs(prefixes, percent)
    wanted = written(parts_met(pairs).join(parts, "part"), "wanted")
    stand = wanted.select("c").distinct().join(sets, "c").select(F.col("rep").alias("_rep"), "c")
    chosen = rows.join(stand, F.col("doc_id").eqNullSafe(F.col("_rep"))).select("text", "c")
    members = chosen.mapInArrow(_members(words), "c bigint, shingles array<bigint>").dropDuplicates(["c"])
    members = written(members, "members")
    none = F.lit(None).cast("array<bigint>")
    dealt = wanted.join(members, "c").select(
        "cu", "cv", "part", "c", "shingles", none.alias("us"), none.alias("vs")
    ).unionByName(pairs.select(
        "cu", "cv", F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("c"), none.alias("shingles"), "us", "vs"
    )).repartition("cu", "cv").sortWithinPartitions("cu", "cv")
    linked = components(dealt.mapInArrow(_verify(percent), "u bigint, v bigint"))
    roots = sets.join(linked, sets["c"] == linked["node"], "left").select("c", "rep", F.coalesce("component", "c").alias("root"))
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))
    per_set = skew_join(roots.select("c", "root"), least, ["root"]).select("c", "least")
    known = skew_join(named.select("doc_id", "n", "c"), per_set, ["c"], "left")
    return known.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("c").alias("set_id"),
    )

