"""The most similar vectors of every vector.

Method: shifted space-filling curves. Each curve projects the unit vectors on a few random orthogonal directions, shifts and
quantises them, and orders them by their Hilbert key; Spark range-partitions and sorts all curves at once. Along a curve,
blocks of neighbouring keys are compared with themselves and the next block; the candidates of all curves are merged and
reranked with exact cosines in double precision. A near pair that one curve tears apart is adjacent on another. Within a cell,
vectors are ordered by one more direction of the curve, so crowded cells are cut otherwise on each curve.

Where a vector has more close ones than windows can hold, its neighbours may be outside all its windows: such vectors (the
crowd) are compared with each other in full, tile by tile; pairs of tiles that are too far apart to hold a neighbour are skipped.

Equal vectors are searched once: one representative of each takes part, and its result is written for all its copies. So a
vector that a third of all rows share costs no more than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

#: By how much a cosine of vectors rounded to bytes may differ from the true one (ten standard deviations).
SLACK = 0.01


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The position on the Hilbert curve of each row of cell numbers (below 2**bits); bits times columns at most 63.

    Per level, from the coarsest: the Gray-coded corner of the cell, then the reflection and exchange of axes that bring the
    sub-cube into standard position, for all rows at once (the transposed form of the published axis-exchange algorithm).
    """
    x = cells.T.astype(np.uint32)
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(d):
            mirror = (x[i] >> np.uint32(level)) & np.uint32(1) == 1
            swap = np.where(mirror, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(mirror, low, swap).astype(np.uint32)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix ^= np.where((x[-1] >> np.uint32(level)) & np.uint32(1) == 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= fix
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> np.uint32(level)) & np.uint32(1)).astype(np.int64)
    return key


class Curves:
    """The projections and shifts of all curves, from a seed."""

    def __init__(self, width: int, count: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.dims, self.bits = min(dims, width), bits
        scale = np.sqrt(width)  # a coordinate of a random unit vector has this standard deviation's inverse
        self.axes = [np.linalg.qr(rng.standard_normal((width, width)))[0][:, : self.dims] * scale for _ in range(count)]
        self.shift = [rng.uniform(-0.5, 0.5, self.dims) for _ in range(count)]
        self.within = [rng.standard_normal(width) for _ in range(count)]

    def keys(self, unit: np.ndarray, curve: int) -> np.ndarray:
        reach, cells = 2.5, 1 << self.bits
        y = unit @ self.axes[curve] + self.shift[curve]
        return hilbert_keys(np.clip((y + reach) / (2 * reach) * cells, 0, cells - 1).astype(np.uint32), self.bits)

    def fine(self, unit: np.ndarray, curve: int) -> np.ndarray:
        """The order within a cell: the position along a direction of the curve's own."""
        return (unit @ self.within[curve]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fixed(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A binary column of equally long values as a matrix, without an object a value."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], kind, count=(int(at[-1]) - int(at[0])) // size, offset=int(at[0])).reshape(-1, width)


def _reach(rows: np.ndarray, values: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of each row the score from which it keeps candidates: twice the rounding error below its k-th best."""
    order = np.lexsort((-values, rows))
    counts = np.bincount(rows, minlength=n)
    first = np.cumsum(counts) - counts
    out = np.full(n, -np.inf)
    full = counts >= k
    out[full] = values[order][first[full] + k - 1] - 2 * SLACK
    return out


def _candidates(s: np.ndarray, k: int, least: float, close: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of scores (rounded vectors): row and column of every pair that may be among the k best of either end and reach `least`,
    and how many scores of at least `close` each row and each column has."""
    i, j = np.divmod(np.flatnonzero(s.ravel() >= least), s.shape[1])
    v = s[i, j]
    near = v >= close
    rows, cols = (np.bincount(x[near], minlength=n) for x, n in ((i, s.shape[0]), (j, s.shape[1])))
    keep = (v >= _reach(i, v, s.shape[0], k)[i]) | (v >= _reach(j, v, s.shape[1], k)[j])
    return i[keep], j[keep], rows, cols


def _blocks(batches: Iterator[pa.RecordBatch], block: int, width: int) -> Iterator[tuple[tuple | None, np.ndarray, np.ndarray]]:
    """(space and curve, ids, unit vectors) of consecutive blocks of a sorted partition; no block spans two curves."""
    ids: list[np.ndarray] = []
    vecs: list[np.ndarray] = []
    run, held = None, 0

    def made():  # noqa: ANN202
        q = np.concatenate(vecs).astype(np.float32)
        return run, np.concatenate(ids), q / np.linalg.norm(q, axis=1, keepdims=True)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        space = b.column("space").dictionary_encode()
        curve, of = b.column("curve").to_numpy(), space.indices.to_numpy(zero_copy_only=False)
        small, rep = _fixed(b.column("small"), np.int8, width), b.column("rep").to_numpy()
        cut = [0, *(np.flatnonzero((curve[1:] != curve[:-1]) | (of[1:] != of[:-1])) + 1).tolist(), n]
        for s, e in zip(cut, cut[1:]):
            now = (space.dictionary[int(of[s])].as_py(), int(curve[s]))
            if held and now != run:
                yield made()
                ids, vecs, held = [], [], 0
            run = now
            while s < e:
                if held == block:
                    yield made()
                    ids, vecs, held = [], [], 0
                m = min(block - held, e - s)
                ids.append(rep[s : s + m])
                vecs.append(small[s : s + m])
                held, s = held + m, s + m
    if held:
        yield made()


def _crowd_neighbours(dense: DataFrame, made: Curves, k: int, low: float, decimals: int, tile: int) -> DataFrame:
    """(space, cosine, rep, near): of each vector of the crowd (space, rep, vec, floor) every one of its k nearest in the crowd whose cosine
    is at least its floor (what it has already) and `low`."""
    width = made.axes[0].shape[0]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = _unit(_fixed(b.column("vec"), np.float32, width))
                yield pa.RecordBatch.from_arrays([b.column("space"), b.column("rep"), b.column("vec"), b.column("floor"), pa.array(made.keys(unit, 0)), pa.array(made.fine(unit, 0))], ["space", "rep", "vec", "floor", "key", "fine"])

    kinds = "space string, rep bigint, vec binary, floor double"
    keys = materialise(dense.mapInArrow(keyed, f"{kinds}, key bigint, fine float"), "crowd")
    # consecutive tiles along one curve, by range partitions: a tile is a partition's run of at most `tile` of one space
    n = keys.count()
    ranges = max(1, -(-n // tile))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, run, number = TaskContext.get().partitionId(), 0, None, 0
        for b in batches:
            tiles = []
            for s in b.column("space").to_pylist():
                if s != run or count == tile:
                    run, count, number = s, 0, number + 1
                count += 1
                tiles.append((part << 32) + number)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("space", "rep", "vec", "floor")), pa.array(tiles, pa.int64())], ["space", "rep", "vec", "floor", "tile"])

    rows = materialise(keys.repartitionByRange(ranges, "space", "key", "fine", "rep").sortWithinPartitions("space", "key", "fine", "rep").mapInArrow(tiled, f"{kinds}, tile bigint"), "tiles")

    def summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        unit = _unit(_fixed(got.column("vec").combine_chunks(), np.float32, width))
        mid = unit.sum(axis=0)
        mid = mid / norm if (norm := np.linalg.norm(mid)) > 1e-9 else unit[0]
        reach = float(np.arccos(np.clip((unit @ mid).min(), -1, 1)))
        yield pa.RecordBatch.from_arrays([got.column("space").combine_chunks()[:1], pa.array([key[0].as_py()]), pa.array([mid.tobytes()], pa.binary()), pa.array([reach]), pa.array([min(got.column("floor").to_pylist())])], ["space", "tile", "mid", "reach", "floor"])

    tiles = materialise(rows.groupBy("tile").applyInArrow(summed, "space string, tile bigint, mid binary, reach double, floor double"), "tile_sums")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float64).reshape(-1, width) for c in ("mid", "mid2"))
                col = lambda c: b.column(c).to_numpy()  # noqa: B023, E731
                apart = np.arccos(np.clip(np.einsum("ij,ij->i", one, two), -1, 1)) - col("reach") - col("reach2")
                keep = pa.array((col("tile") == col("tile2")) | (np.cos(np.clip(apart, 0, np.pi)) >= np.minimum(col("floor"), col("floor2")) - 1e-5))
                yield pa.RecordBatch.from_arrays([b.column("tile").filter(keep), b.column("tile2").filter(keep)], ["x", "y"])

    other = tiles.select("space", *(F.col(c).alias(f"{c}2") for c in ("tile", "mid", "reach", "floor")))
    pairs = materialise(tiles.join(other, "space").filter("tile <= tile2").mapInArrow(possible, "x bigint, y bigint"), "tile_pairs")

    def multiplied(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)).combine_chunks()
        x, y = key[0].as_py(), key[1].as_py()
        unit, ids, floor, of = _unit(_fixed(got.column("vec").combine_chunks(), np.float32, width)), got.column("rep").to_numpy(), got.column("floor").to_numpy(), got.column("tile").to_numpy()
        sides = [(np.flatnonzero(of == x), np.flatnonzero(of == y))]
        if x != y:
            sides.append(sides[0][::-1])
        for mine, theirs in sides:
            for at in range(0, len(mine), 512):
                m = mine[at : at + 512]
                s = unit[m] @ unit[theirs].T
                if x == y:
                    s[np.arange(len(m)), np.arange(at, at + len(m))] = -3
                i, j = np.nonzero(s >= np.maximum(floor[m], low)[:, None] - 2 * 10.0**-decimals)
                c = np.round(s[i, j], decimals)
                a, b = ids[m][i], ids[theirs][j]
                fine = c >= low
                i, a, b, c = i[fine], a[fine], b[fine], c[fine]
                order = np.lexsort((b, -c, i))
                i, a, b, c = i[order], a[order], b[order], c[order]
                counts = np.bincount(i, minlength=len(m))
                first = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) < k
                yield pa.RecordBatch.from_arrays([pa.repeat(got.column("space")[0], int(first.sum())), pa.array(c[first]), pa.array(a[first]), pa.array(b[first])], ["space", "cosine", "rep", "near"])

    both = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("tile"))
    return both.join(rows, "tile").groupBy("x", "y").applyInArrow(multiplied, "space string, cosine double, rep bigint, near bigint")


def nearest(df: DataFrame, k: int = 5, min_cosine: float | None = None, width: int = 64, curves: int = 16, dims: int = 16, bits: int = 3, block: int = 512, seed: int = 11, decimals: int = 6, crowded: float = 0.85, tile: int = 4096) -> DataFrame:
    """(space, id, neighbour, cosine, rank): the k most similar others of every vector of the same space.

    df: space STRING, id BIGINT (unique within the space), vec ARRAY<FLOAT>. Cosines are exact (double, rounded); equal ones
    are ranked by id. With min_cosine, only neighbours at least that similar are wanted. What the search may miss: pairs that
    are in no common window of 2 x `block` on any curve (the README has measured recalls), unless both are of the crowd: vectors
    that in some window have a quarter of a block or more others of cosine `crowded` (or min_cosine, if that is higher). The crowd's
    neighbours within it are exact. Within a window nothing is missed: vectors are rounded to bytes there, and every pair goes on to the exact
    ranking that is within twice the rounding error of the k-th best of either end, however many there are.

    Left out, neither searching nor found: null vectors, those of another width, with null or non-finite numbers, all zero.
    Vectors need not have unit length. Repeated vectors are each other's neighbours with cosine 1. An empty table gives no
    rows; other columns are ignored whatever their names.

    Plan: one shuffle to single out distinct vectors (written once), one range shuffle of `curves` keys with byte-sized
    vectors, which is streamed block by block, and joins of the candidate pairs. Windows don't reach across the borders of
    the range partitions, of which each holds many blocks; another curve has other borders. If there is a crowd, it is dealt in tiles of
    `tile` vectors, and each pair of tiles that may hold neighbours is one block product: quadratic in each group of close vectors.
    """
    fine = F.col("vec").isNotNull() & (F.size("vec") == width) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    src = df.select("space", F.col("id").cast("bigint").alias("id"), "vec").filter(fine)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width) + np.float32(0)
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays(
                [b.column("space"), b.column("id"), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["space", "id", "same", "vec"]
            )

    rows = src.mapInArrow(packed, "space string, id bigint, same binary, vec binary")
    distinct = materialise(rows.groupBy("space", "same").agg(F.min("id").alias("rep"), F.first("vec").alias("vec")), "vectors")
    members = materialise(rows.select("space", "same", "id"), "members")

    made = Curves(width, curves, dims, bits, seed)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit(_fixed(b.column("vec"), np.float32, width))
            small = pa.array([r.tobytes() for r in np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 127).astype(np.int8)], pa.binary())
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([b.column("space"), pa.repeat(pa.scalar(c, pa.int32()), b.num_rows), pa.array(made.keys(unit, c)), pa.array(made.fine(unit, c)), b.column("rep"), small], ["space", "curve", "key", "fine", "rep", "small"])

    least = -2.0 if min_cosine is None else min_cosine - SLACK
    close = max(crowded, least)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for run, ids, x in _blocks(batches, block, width):
            s = x @ x.T
            np.fill_diagonal(s, -3)
            i, j, dense, _ = _candidates(s, k, least, close)
            found = [(ids[i], ids[j]), (ids[dense >= block // 4],) * 2]
            if before is not None and before[0] == run:
                i, j, dense, dense_too = _candidates(before[2] @ x.T, k, least, close)
                found += [(before[1][i], ids[j]), (before[1][dense >= block // 4],) * 2, (ids[dense_too >= block // 4],) * 2]
            a, b = (np.concatenate(p) for p in zip(*found))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(run[0], pa.string()), len(pairs)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["space", "a", "b"])
            before = (run, ids, x)

    spark = df.sparkSession
    n = distinct.count()
    parts = max(1, min(max(spark.sparkContext.defaultParallelism, n * curves // 30_000), max(1, n * curves // (4 * block))))
    on_curves = distinct.select("space", "rep", "vec").mapInArrow(keyed, "space string, curve int, key bigint, fine float, rep bigint, small binary")
    sorted_curves = on_curves.repartitionByRange(parts, "space", "curve", "key", "fine", "rep").sortWithinPartitions("space", "curve", "key", "fine", "rep")
    found = materialise(sorted_curves.mapInArrow(compared, "space string, a bigint, b bigint").distinct(), "pairs")
    pairs, crowd = found.filter("a < b"), found.filter("a = b").select("space", F.col("a").alias("rep"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cos = np.round(np.einsum("ij,ij->i", _unit(_fixed(b.column("va"), np.float32, width)), _unit(_fixed(b.column("vb"), np.float32, width))), decimals)
            yield pa.RecordBatch.from_arrays([b.column("space"), b.column("a"), b.column("b"), pa.array(cos)], ["space", "a", "b", "cosine"])

    side = lambda c: distinct.select(F.col("space"), F.col("rep").alias(c), F.col("vec").alias(f"v{c}"))
    scored = pairs.join(side("a"), ["space", "a"]).join(side("b"), ["space", "b"]).mapInArrow(exact, "space string, a bigint, b bigint, cosine double")
    if min_cosine is not None:
        scored = scored.filter(F.col("cosine") >= min_cosine)
    both = scored.select("space", "cosine", F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("near")), F.struct(F.col("b").alias("rep"), F.col("a").alias("near")))).alias("p")).select("space", "p.rep", "p.near", "cosine")
    nearest_k = lambda df: df.withColumn("rn", F.row_number().over(Window.partitionBy("space", "rep").orderBy(F.col("cosine").desc(), "near"))).filter(f"rn <= {k}").drop("rn")
    near = nearest_k(both)
    if not crowd.isEmpty():
        near = materialise(near, "near")
        floor = near.groupBy("space", "rep").agg(F.count("*").alias("c"), F.min("cosine").alias("floor")).filter(f"c = {k}").drop("c")
        low = -2.0 if min_cosine is None else min_cosine
        dense = crowd.join(distinct, ["space", "rep"]).join(floor, ["space", "rep"], "left").select("space", "rep", "vec", F.coalesce("floor", F.lit(low)).alias("floor"))
        near = nearest_k(near.unionByName(_crowd_neighbours(dense, made, k, low, decimals, tile)).distinct())

    # of each distinct vector its k+1 smallest ids; then of each its k+1 best rows, its own copies among them
    low = members.withColumn("rn", F.row_number().over(Window.partitionBy("space", "same").orderBy("id"))).filter(f"rn <= {k + 1}")
    copies = low.groupBy("space", "same").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0])
    copies = materialise(copies, "copies")
    others = near.join(copies.select("space", F.col("rep").alias("near"), "ids"), ["space", "near"]).select("space", "rep", "cosine", F.explode("ids").alias("neighbour"))
    own = copies.select("space", "rep", F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour"))
    best = others.unionByName(own).withColumn("rn", F.row_number().over(Window.partitionBy("space", "rep").orderBy(F.col("cosine").desc(), "neighbour"))).filter(f"rn <= {k + 1}")
    lists = best.groupBy("space", "rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("minus"), "neighbour"))).alias("list")).filter(F.size("list") > 1)
    lists = lists.join(copies.select("space", "rep", "same"), ["space", "rep"]).select("space", "same", "list")
    out = members.join(lists, ["space", "same"]).select("space", "id", F.expr(f"slice(filter(list, x -> x.neighbour != id), 1, {k})").alias("list"))
    return out.select("space", "id", F.posexplode("list").alias("pos", "n")).select("space", "id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.minus")).alias("cosine"), (F.col("pos") + 1).alias("rank"))
