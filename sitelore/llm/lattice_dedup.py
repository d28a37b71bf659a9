"""Near-duplicate vectors by lattice hashing: projections decoded to points of E8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitelore.llm.common import find, grouped, in_blocks, mix, skew_join, small_batches, written
from sitelore.llm.components import components

#: Least cosine of a link.
COSINE = 0.98
#: Tables of random projections, lattice cells probed in each, and size of a unit vector in lattice units.
TABLES, PROBES, SCALE = 10, 3, 7.0
#: Vectors of one cell that are compared at once.
BLOCK = 1024
SEED = 20


def nearest_points(y: np.ndarray, probes: int) -> np.ndarray:
    """Twice the ``probes`` nearest of six close points of E8 for each row of 8 numbers: (n, probes, 8).

    E8 is D8 and D8 shifted by one half.  In each, the numbers are rounded; where the sum is odd, the
    cheapest number is rounded the other way.  The next candidates round another one, or two more.
    """
    points, costs = [], []
    for shift in (0.0, 0.5):
        z = y - shift
        f = np.rint(z)
        error = z - f
        price = 1 - 2 * np.abs(error)  # what rounding a number the other way adds to the squared distance
        cheap = np.argsort(price, axis=1)[:, :3]
        other = np.where(error >= 0, 1.0, -1.0)
        odd = (f.sum(axis=1).astype(np.int64) & 1).astype(bool)
        base = (error * error).sum(axis=1)
        row = np.arange(len(y))
        flips = ((odd, (0,), ()), (odd, (1,), (0, 1)), (odd, (2,), (0, 2)))
        for is_odd, when_odd, when_even in flips:
            p, cost = f.copy(), base.copy()
            for chosen, where in ((when_odd, is_odd), (when_even, ~is_odd)):
                for k in chosen:
                    i, c = row[where], cheap[where, k]
                    p[i, c] += other[i, c]
                    cost[i] += price[i, c]
            points.append(p + shift)
            costs.append(cost)
    points, costs = np.stack(points, 1), np.stack(costs, 1)
    best = np.argsort(costs, axis=1, kind="stable")[:, :probes]
    return np.rint(2 * np.take_along_axis(points, best[:, :, None], 1)).astype(np.int64)


def cells(unit: np.ndarray, label: np.ndarray, tables: int, probes: int, scale: float, seed: int = SEED) -> np.ndarray:
    """Hashes of (table, label, lattice point) that each unit vector is filed under: (n, tables * probes)."""
    dim = unit.shape[1]
    rng, out = np.random.default_rng([seed, dim]), []
    weights = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    table = mix(np.arange(1, tables + 1, dtype=np.uint64))
    mark = mix(label.astype(np.int64).view(np.uint64) + np.uint64(77))
    for t in range(tables):
        plane = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))[0][:dim]
        point = nearest_points((unit @ plane) * scale, probes).view(np.uint64)
        out.append(mix(((point * weights).sum(axis=2, dtype=np.uint64) + table[t]) ^ mark[:, None]))
    return np.concatenate(out, axis=1).view(np.int64)


def _file_vectors(tables: int, probes: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, number, label, vectors = (batch.column(k) for k in range(4))
            sizes = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(sizes):  # vectors of another length are another space
                pick = np.flatnonzero(sizes == dim)
                rows = vectors.take(pa.array(pick))
                unit = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(pick), dim)
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                keys = np.sort(cells(unit, label.to_numpy()[pick], tables, probes, scale), axis=1)
                ends = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rep.take(pa.array(pick)), number.take(pa.array(pick)), label.take(pa.array(pick)), rows,
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                    ["rep", "n", "label", "vector", "cells"],
                )

    return run


def _compare(cosine: float):
    """Links inside each pair of blocks: a forest of them, and each vector's number of links.

    A pair is counted in the smallest cell that its two vectors share, and nowhere else.
    """

    def group(rep, number, label, vectors, cell, side, key, dim):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        links = np.zeros(len(rep), np.int64)
        parent, edges = np.arange(len(rep)), []
        right_cells = cell[right]
        for a in left.tolist():
            near = unit[right] @ unit[a] >= cosine
            near &= (label[right] == label[a]) & (rep[right] != rep[a]) & (dim[right] == dim[a])
            if side[a] == 2:
                near &= (side[right] != 2) | (rep[right] > rep[a])
            hit = np.flatnonzero(near)
            if not len(hit):
                continue
            earlier = np.isin(right_cells[hit], cell[a][cell[a] < key]).any(axis=1)
            for b in right[hit[~earlier]].tolist():
                links[a] += number[b]
                links[b] += number[a]
                x, y = find(parent, a), find(parent, b)
                if x != y:
                    parent[x] = y
                    edges.append((rep[a], rep[b]))
        return links, edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["key", "block_i", "block_j"]):
            table = table.combine_chunks()
            key, i, j = (table.column(c).to_numpy() for c in ("key", "block_i", "block_j"))
            change = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            rep, number, label, side = (table.column(c).to_numpy() for c in ("rep", "n", "label", "side"))
            vector, cell = (table.column(c).chunk(0) for c in ("vector", "cells"))
            dims = np.diff(vector.offsets.to_numpy())
            wide = np.zeros((len(rep), dims.max()))
            inside = np.arange(dims.max())[None, :] < dims[:, None]
            wide[inside] = vector.flatten().to_numpy(zero_copy_only=False)
            filed = cell.flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
            out_u, out_v, out_n = [], [], []
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(rep)]):
                if b - a < 2:
                    continue
                links, edges = group(rep[a:b], number[a:b], label[a:b], wide[a:b], filed[a:b], side[a:b], key[a], dims[a:b])
                hit = np.flatnonzero(links)
                out_u += rep[a:b][hit].tolist() + [u for u, _ in edges]
                out_v += [None] * len(hit) + [v for _, v in edges]
                out_n += links[hit].tolist() + [0] * len(edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_n, pa.int64())], ["u", "v", "n"]
            )

    return run


def link_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Equal vectors with equal labels are one class, met by a partial aggregate.  A class is filed under
    its nearest points of E8 in each table of random projections, with its label; only cells with two
    classes or more go on.  A cell of many classes is dealt into blocks and compared pair of blocks by
    pair of blocks inside tasks, which return counts and a forest of links, never the pairs.  Cosines
    are taken in double precision.  Vectors are found near each other if they share a cell, so a pair
    close to the limit can be missed with a small chance; the tests measure it.

    Rows with a null id, label or vector, with null or non-finite components, or with a zero vector link
    with nothing: no links, and a component of their own.  Rows that repeat an id are one vector as far
    as components go.  Other columns are not read.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("_label"),
        F.col(vector).cast("array<double>").alias("_vector"),
    )
    finite = "x -> x is null or isnan(x) or abs(x) = double('infinity')"
    good = F.expr(
        f"vec_id is not null and _label is not null and _vector is not null and not exists(_vector, {finite}) and exists(_vector, x -> x != 0)"
    )
    rows = rows.withColumn("_good", good).withColumns({
        "_k1": F.when(F.col("_good"), F.xxhash64("_label", "_vector")),
        "_k2": F.when(F.col("_good"), F.xxhash64("_vector", "_label")),
    })
    classes = written(
        rows.filter("_good").groupBy("_label", "_vector")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .select("rep", "n", F.col("_label").alias("label"), F.col("_vector").alias("vector")), "classes",
    )
    filed = written(
        classes.mapInArrow(
            _file_vectors(tables, probes, scale),
            "rep bigint, n bigint, label bigint, vector array<double>, cells array<bigint>",
        ), "cells",
    )
    names = filed.select("rep", "label", F.xxhash64("label", "vector").alias("class"), F.explode(F.array_distinct("cells")).alias("key"))
    blocks = in_blocks(names.select("key", "class"), ["key"], BLOCK, "class")
    wide = filed.withColumn("class", F.xxhash64("label", "vector"))
    members = blocks.join(wide, "class").select(
        "key", "block_i", "block_j", "side", "rep", "n", "label", "vector", "cells"
    )
    dealt = members.repartition("key", "block_i", "block_j").sortWithinPartitions("key", "block_i", "block_j")
    found = written(dealt.mapInArrow(_compare(cosine), "u bigint, v bigint, n bigint"), "found")
    degree = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("_degree"))
    together = components(found.filter("v is not null").select("u", "v"))
    per_class = (
        classes.join(degree, classes["rep"] == degree["u"], "left").join(together, classes["rep"] == together["node"], "left")
        .select(
            F.xxhash64("label", "vector").alias("_k1"), F.xxhash64("vector", "label").alias("_k2"),
            (F.coalesce("_degree", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    joined = skew_join(rows.select("vec_id", "_k1", "_k2"), per_class, ["_k1", "_k2"], "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
