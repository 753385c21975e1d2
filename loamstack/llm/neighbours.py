"""Operator 8: approximate nearest neighbours with a vantage-point tree per shard.

Every row is indexed; the queries are the rows whose id is divisible by ``every``. Pivots drawn by a seeded hash, one for
each ``shard_rows`` vectors, cut the vectors into cells; a cell of more than twice as many rows is split further by hash,
so that shards are of bounded size whatever the data. Each shard builds a vantage-point tree. A query is searched first
in its own shard, which bounds the distance of its k-th neighbour; then in each other shard that the triangle inequality
can't exclude. Inside a tree, a side of a vantage point is skipped if its gap times ``factor`` exceeds the k-th distance
so far; a cell likewise. Factor 1 gives exact results; greater factors skip more. Without a factor, the greatest one
that reaches ``recall`` is taken, measured against brute force on a sample of ``SAMPLE`` rows at most.

A vector's cell is found over two levels, so it is compared with about 2 * sqrt(pivots) of them. Queries go to a shard in
blocks of about ``query_rows``; no task holds more than a shard and a block.

Distances are Euclidean. The result has k rows (or as many others as there are) for each query: vec_id, neighbour_id,
distance, rank; ties go to the lower id, within the search's rounding. Rows without id or vector, with a null or
non-finite element, or with a length other than the commonest (the longer, if two are as common) are left out. Of rows
that repeat an id, the least vector counts. Columns besides vec_id and embedding are ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, plain, to_arrow

K, EVERY, RECALL, SHARD_ROWS, QUERY_ROWS, LEAF = 10, 50, 0.97, 32_768, 32_768, 128
#: Bounds of what the factor is fitted on: rows indexed, and queries among them.
SAMPLE, SAMPLE_QUERIES = 16_384, 256
FACTORS = (32, 24, 16, 12, 10, 8, 7, 6, 5, 4, 3, 2.5, 2, 1.5, 1.25)
FOUND = "vec_id bigint, neighbour_id bigint, distance double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, square))


class Tree:
    """A vantage-point tree searched by many queries at a time; ``scanned`` counts the distances computed in leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.points, self.leaf = points, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows, self.points[rows]
        vantage = int(rows[self.rng.integers(len(rows))])
        far = distances(self.points[rows], self.points[[vantage]])[:, 0]
        inside = far <= np.median(far)
        if inside.all() or not inside.any():
            return rows, self.points[rows]
        bounds = [(float(side.min()), float(side.max())) for side in (far[inside], far[~inside])]
        return vantage, bounds, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, queries: np.ndarray, k: int, factor: float, ids: np.ndarray, own: np.ndarray, bound: np.ndarray):
        """(distances, ids), k columns each; no row finds its own id, and only what is at most ``bound`` away is sure to be found."""
        self.q, self.k, self.factor, self.ids, self.own, self.bound = queries, k, factor, ids, own, bound
        self.scanned = 0
        self.best = np.full((len(queries), k), np.inf)
        self.who = np.full((len(queries), k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(queries)))
        return self.best, self.who

    def _reach(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(self.best[rows, -1], self.bound[rows]) + 1e-9

    def _visit(self, node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if len(node) == 2:
            for start in range(0, len(rows), 4096):
                self._scan(*node, rows[start : start + 4096])
            return
        vantage, bounds, *sides = node
        d = distances(self.q[rows], self.points[[vantage]])[:, 0]
        gaps = [np.maximum(0, np.maximum(low - d, d - high)) for low, high in bounds]
        near_inner = gaps[0] <= gaps[1]
        for chosen, order in ((near_inner, (0, 1)), (~near_inner, (1, 0))):
            mine = rows[chosen]
            for side in order:
                self._visit(sides[side], mine[gaps[side][chosen] * self.factor <= self._reach(mine)])

    def _scan(self, leaf: np.ndarray, points: np.ndarray, rows: np.ndarray) -> None:
        self.scanned += len(leaf) * len(rows)
        near = distances(self.q[rows], points)
        near[self.own[rows][:, None] == self.ids[leaf][None, :]] = np.inf
        at, j = np.nonzero(near <= np.minimum(self._reach(rows), 1e300)[:, None])
        if not len(at):
            return
        # The new ones and the best so far, by row, distance and id; each row keeps its first k.
        hit = np.unique(at)
        row = np.concatenate([np.repeat(hit, self.k), at])
        far = np.concatenate([self.best[rows[hit]].ravel(), near[at, j]])
        who = np.concatenate([self.who[rows[hit]].ravel(), self.ids[leaf][j]])
        order = np.lexsort((who, far.round(9), row))
        starts = np.searchsorted(row[order], hit)
        take = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.best[rows[hit]] = far[take].reshape(-1, self.k)
        self.who[rows[hit]] = who[take].reshape(-1, self.k)


def fit_factor(sample: np.ndarray, k: int, recall: float) -> float:
    """The greatest of FACTORS whose search finds ``recall`` of the true neighbours of some of the sample's rows; else 1."""
    ids = np.arange(len(sample))
    asked = ids[:: max(1, len(ids) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1.0
    far = distances(sample[asked], sample)
    far[np.arange(len(asked)), asked] = np.inf
    limit = np.partition(far, k - 1, axis=1)[:, k - 1]
    tree = Tree(sample)
    for factor in FACTORS:
        found, _ = tree.search(sample[asked], k, factor, ids, asked, np.full(len(asked), np.inf))
        if (found <= limit[:, None] + 1e-9).mean() >= recall:
            return float(factor)
    return 1.0


def _matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _searcher(k: int, factor: float, width: int):
    kind = to_arrow(T.StructType.fromDDL(FOUND))

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not points.num_rows or not queries.num_rows:
            return kind.empty_table()
        ids, own = points["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        order = np.argsort(ids)
        tree = Tree(_matrix(points["vector"], width)[order])
        bound = np.array([np.inf if b is None else b for b in queries["bound"].to_pylist()], float)
        far, who = tree.search(_matrix(queries["vector"], width), k, factor, ids[order], own, bound)
        good = np.isfinite(far)
        rows = np.repeat(own, good.sum(axis=1))
        return pa.table([pa.array(rows, kind[0].type), pa.array(who[good], kind[1].type), pa.array(far[good], kind[2].type)], schema=kind)

    return run


class Pivots:
    """Cells around pivots, found over two levels: the nearest of about sqrt(n) heads, then the nearest pivot of its group."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.heads = points[: math.isqrt(max(0, len(points) - 1)) + 1]
        self.groups: list[np.ndarray] = []
        if len(points):
            of = np.concatenate([distances(points[s : s + 4096], self.heads).argmin(axis=1) for s in range(0, len(points), 4096)])
            self.groups = [np.flatnonzero(of == h) for h in range(len(self.heads))]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its distance from the pivot."""
        cell, far = np.zeros(len(x), np.int32), np.zeros(len(x))
        head = distances(x, self.heads).argmin(axis=1)
        for h in np.unique(head):
            mine = np.flatnonzero(head == h)
            # A head is a pivot, but an equal one before it may have taken it.
            group = self.groups[h] if len(self.groups[h]) else np.array([h])
            d = distances(x[mine], self.points[group])
            cell[mine], far[mine] = group[d.argmin(axis=1)], d.min(axis=1)
        return cell, far


def clean(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, and their width."""
    vectors = plain(vectors, "vec_id", "embedding")
    named = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector"))
    sound = named.where("vec_id is not null and vector is not null and size(vector) > 0").where(
        ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    widths = sound.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    width = widths[0][0] if widths else 1
    return sound.where(F.size("vector") == width).groupBy("vec_id").agg(F.min("vector").alias("vector")), width


def neighbours(
    vectors: DataFrame,
    k: int = K,
    factor: float | None = None,
    every: int = EVERY,
    recall: float = RECALL,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The k nearest other rows of each query."""
    spark = vectors.sparkSession
    points, width = clean(vectors)
    points = cut(points, "vectors")
    total, asked = (int(x or 0) for x in points.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first())
    n, query_blocks = max(1, -(-total // shard_rows)), max(1, -(-asked // query_rows))
    chosen = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(n, SAMPLE)).toArrow()
    first_rows = _matrix(chosen["vector"], width) if total else np.zeros((1, width))
    factor = fit_factor(first_rows[:SAMPLE], k, recall) if factor is None else factor
    # One pivot for each shard_rows vectors: 8 bytes a number for 1/shard_rows of the rows.
    sent = spark.sparkContext.broadcast(Pivots(first_rows[:n]))
    celled_kind = T.StructType.fromDDL("vec_id bigint, vector array<float>, cell int, far double")
    arrow_kind = to_arrow(celled_kind)

    def place(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                b = batch.slice(s, 1024)
                cell, far = sent.value.place(_matrix(b.column(1), width))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(arrow_kind[1].type), pa.array(cell), pa.array(far)], schema=arrow_kind)

    celled = cut(points.mapInArrow(place, celled_kind), "cells")
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("far").alias("low"), F.max("far").alias("high")).collect()
    splits, low, high = np.ones(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
    for cell, rows, nearest, furthest in cells:
        splits[cell], low[cell], high[cell] = max(1, -(-rows // (2 * shard_rows))), nearest, furthest
    parts = F.element_at(F.split(F.lit(",".join(map(str, splits))), ",").cast("array<int>"), F.col("cell") + 1)
    sharded = celled.withColumn("split", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    queries = sharded.where(F.col("vec_id") % every == 0)
    search = _searcher(k, factor, width)
    found_kind = T.StructType.fromDDL(FOUND)
    at_home = queries.withColumn("bound", F.lit(None).cast("double")).groupBy("cell", "split")
    first = cut(sharded.groupBy("cell", "split").cogroup(at_home).applyInArrow(search, found_kind), "first")
    if n == 1 and splits[0] == 1:
        return _ranked(first, k)
    reach = first.groupBy("vec_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
    asked_rows = queries.join(reach, "vec_id", "left").select("vec_id", "vector", "cell", "split", "bound")
    routed_kind = T.StructType.fromDDL("vec_id bigint, vector array<float>, bound double, cell int, split int")
    routed_arrow = to_arrow(routed_kind)

    def route(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                b = batch.slice(s, 256)
                d = distances(_matrix(b.column(1), width), sent.value.points)
                bound = np.array([np.inf if v is None else v for v in b.column(4).to_pylist()])
                gap = np.maximum(0, np.maximum(d - high, low - d))
                row, cell = np.nonzero((gap * factor <= bound[:, None] + 1e-9) & np.isfinite(high))
                many = splits[cell]
                split = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row, cell = np.repeat(row, many), np.repeat(cell, many)
                away = (cell != b.column(2).to_numpy()[row]) | (split != b.column(3).to_numpy()[row])
                taken = b.take(pa.array(row[away]))
                to = [pa.array(x[away].astype(np.int32)) for x in (cell, split)]
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1).cast(routed_arrow[1].type), taken.column(4), *to], schema=routed_arrow)

    routed = asked_rows.mapInArrow(route, routed_kind).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
    held = sharded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    keys = ("cell", "split", "block")
    second = held.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(search, found_kind)
    return _ranked(first.unionByName(second), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("vec_id").orderBy(F.round("distance", 9), "neighbour_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("vec_id", "neighbour_id", F.round("distance", 6).alias("distance"), "rank")
