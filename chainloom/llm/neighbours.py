"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are projected to a few dimensions by Gaussian (2-stable) directions: the squared
projected distance of two vectors, over their squared distance, follows a chi-square law.
A kd-tree over the projections yields a query's projected neighbours in growing distance,
leaf by leaf, and each is verified on the original vectors.  The search stops when the
chi-square distribution says that a nearer vector would, with probability ``SURE``, have
been met by now: when the next projected distance exceeds the k-th best distance by the
quantile.

Largest inner product is turned into least distance by one more coordinate, which brings
all candidates to one length.

The upper levels of the tree, fitted on a bounded sample, cut the projected space into
cells; every vector is indexed in its cell.  A query first searches its own cell, and then
those that its bound from there does not rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chainloom.llm import common

DIMENSIONS = 8
SURE = 0.97
K = 20
LEAF = 512
CELL_ROWS = 4096
DEEPEST = 14
# Rows that the cells' borders are fitted on; the borders decide the work, not the result.
SAMPLE_ROWS = 65_536
# Queries of one cell that are searched in one task.
CHUNK = 2048
# Rounding of a product of two vectors, of their squared lengths.
SLACK = 1e-9
SEED = 20_140_829


def chi_square_cdf(x: float, m: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 10.0 * m
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, m) < p else (low, middle)
    return high


def directions(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width + 1, DIMENSIONS))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32)), pa.array(values.ravel(), kind))


class Borders:
    """The upper levels of the tree: at each inner node a dimension and a value."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dimension = np.zeros(2**depth, np.int64)
        self.value = np.zeros(2**depth)
        work = [(1, sample)]
        while work:
            node, points = work.pop()
            if node >= 2**depth:
                continue
            spread = np.ptp(points, axis=0) if len(points) else np.zeros(DIMENSIONS)
            d = int(spread.argmax())
            v = float(np.median(points[:, d])) if len(points) else 0.0
            self.dimension[node], self.value[node] = d, v
            right = points[:, d] > v
            work += [(2 * node, points[~right]), (2 * node + 1, points[right])]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dimension[node]] > self.value[node])
        return node - 2**self.depth


class Tree:
    """A kd-tree over one cell's projections; leaves lie one after another."""

    def __init__(self, points: np.ndarray):
        order, ends = [], []
        work = [np.arange(len(points))]
        while work:
            rows = work.pop()
            own = points[rows]
            if len(rows) <= LEAF or not np.ptp(own, axis=0).any():
                order.append(rows)
                ends.append(len(rows))
                continue
            d = np.ptp(own, axis=0).argmax()
            half = np.argsort(own[:, d], kind="stable")
            work += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2:]]]
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ends = np.cumsum(ends)
        self.starts = self.ends - np.array(ends, np.int64)
        self.points = points[self.order]
        self.low = np.minimum.reduceat(self.points, self.starts, axis=0) if len(points) else self.points
        self.high = np.maximum.reduceat(self.points, self.starts, axis=0) if len(points) else self.points


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to boxes."""
    off = np.maximum(np.maximum(low - point, point - high), 0)
    return (off * off).sum(axis=1)


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, own: int, query: np.ndarray, point: np.ndarray, k: int, floor: float, reach: float, ceiling: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of a query's best candidates, best first.

    ``ceiling`` is the squared length of all candidates plus that of the query, ``reach``
    the chi-square quantile; of candidates below ``floor`` the query knows enough already.
    A fast product of a leaf only tells which of its vectors are worth the exact score,
    which does not depend on where a vector lies."""
    best_ids, best, kth = np.zeros(0, np.int64), np.zeros(0), floor
    to_leaf = box_distance(point, tree.low, tree.high)
    for leaf in np.argsort(to_leaf, kind="stable"):
        if to_leaf[leaf] > reach * max(ceiling - 2 * kth + SLACK * ceiling, 0.0):
            break
        part = slice(tree.starts[leaf], tree.ends[leaf])
        rough = vectors[part] @ query
        near = np.flatnonzero((rough >= kth - SLACK * ceiling) & (ids[part] != own))
        if not len(near):
            continue
        near += tree.starts[leaf]
        best_ids, best = np.r_[best_ids, ids[near]], np.r_[best, (vectors[near] * query).sum(axis=1)]
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
        if len(best) == k:
            kth = max(kth, float(best[-1]))
    return best_ids[best >= floor], best[best >= floor]


def nearest(df: DataFrame, every: int = 20, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the
    ``k`` other rows of largest inner product that the search finds, ties to smaller ids.

    Rows with a null id take no part, nor do vectors that are null, empty, zero, or hold a
    null or non-finite component.  Only vectors of one length are compared, each length with
    an index of its own.  If there are fewer candidates, all are returned.  Equal rows count
    once.  Of equal vectors only the ``k`` + 1 smallest ids can be among anyone's nearest, so
    no others are compared, which is exact.  Different vectors of one id are candidates of
    their own, and never candidates of a query with that id; the query's vector is the least
    of them, component by component.  An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    # -0.0 and 0.0 are one component.
    rows = rows.withColumn("v", F.expr("transform(v, x -> x + 0.0D)"))
    rows = common.written(rows, "neighbours-rows")
    lengths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("longest"))
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # One row for each length of vectors.
    for width, total, longest in sorted(map(tuple, lengths.collect())):
        out = out.unionByName(nearest_of_width(rows.where(F.size("v") == width), width, total, longest, every, k))
    return out


def nearest_of_width(rows: DataFrame, width: int, total: int, longest: float, every: int, k: int) -> DataFrame:
    """The search among (vec_id, v) of one length, of which ``total`` is the number and
    ``longest`` the largest squared length."""
    # Equal rows count once, so that ids are ranked; each task keeps the first of its own.
    by_copy = Window.partitionBy("v").orderBy("vec_id")
    candidates = rows.distinct().withColumn("copy", F.row_number().over(by_copy)).where(F.col("copy") <= k + 1).select("vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    turn = directions(width)

    def project(lengthen: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch.column("v"), width)
                p = v @ turn[:-1]
                if lengthen:
                    p += np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))[:, None] * turn[-1]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists(p, pa.float64())], ["vec_id", "v", "p"])
        return run

    projected = common.written(candidates.mapInArrow(project(True), "vec_id bigint, v array<double>, p array<double>"), "neighbours-projected")
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(total, 1) / CELL_ROWS))))
    sample = projected.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("p").toArrow()
    borders = Borders(matrix(sample.column("p"), DIMENSIONS), depth)

    def with_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = borders.cell(matrix(batch.column("p"), DIMENSIONS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], ["vec_id", "v", "p", "cell"])

    celled = "vec_id bigint, v array<double>, p array<double>, cell bigint"
    indexed = common.written(projected.mapInArrow(with_cell, celled), "neighbours-cells")
    # One row for each of at most 2 ** DEEPEST cells.
    boxes = indexed.groupBy("cell").agg(
        *[F.min(F.col("p")[i]).alias(f"low{i}") for i in range(DIMENSIONS)], *[F.max(F.col("p")[i]).alias(f"high{i}") for i in range(DIMENSIONS)]
    ).collect()
    cells = np.array([b["cell"] for b in boxes], np.int64)
    low = np.array([[b[f"low{i}"] for i in range(DIMENSIONS)] for b in boxes])
    high = np.array([[b[f"high{i}"] for i in range(DIMENSIONS)] for b in boxes])
    reach = chi_square_quantile(SURE, DIMENSIONS)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the cell that holds it, or else the nearest."""
        for batch in batches:
            p = matrix(batch.column("p"), DIMENSIONS)
            at = cells[[int(box_distance(x, low, high).argmin()) for x in p]] if len(p) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at, pa.int64()), pa.array(np.full(len(p), -np.inf))], ["vec_id", "v", "p", "cell", "floor"]
            )

    asked = queries.mapInArrow(project(False), "vec_id bigint, v array<double>, p array<double>").mapInArrow(home, celled + ", floor double")

    def search_cells(asked: DataFrame) -> DataFrame:
        """The best candidates of each query in each of its cells.  Queries of a cell are
        dealt into parts, and the cell's candidates go to each part."""
        asked = common.written(asked, "neighbours-asked")
        # One row for each of at most 2 ** DEEPEST cells.
        parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
        left = asked.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
        right = indexed.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def run(queries: pa.Table, own: pa.Table) -> pa.Table:
            found, n = [], len(queries)
            if n and len(own):
                tree = Tree(matrix(own.column("p"), DIMENSIONS))
                vectors, ids = matrix(own.column("v"), width)[tree.order], own.column("vec_id").to_numpy()[tree.order]
                for q, v, p, floor in zip(queries.column("vec_id").to_pylist(), matrix(queries.column("v"), width), matrix(queries.column("p"), DIMENSIONS), queries.column("floor").to_pylist()):
                    found.append(search(tree, vectors, ids, q, v, p, k, floor, reach, longest + float(v @ v)))
            else:
                found = [(np.zeros(0, np.int64), np.zeros(0))] * n
            return pa.table({
                "vec_id": queries.column("vec_id"), "v": queries.column("v"), "p": queries.column("p"), "cell": queries.column("cell"),
                "ids": pa.array([i.tolist() for i, _ in found], pa.list_(pa.int64())), "scores": pa.array([s.tolist() for _, s in found], pa.list_(pa.float64())),
            })

        return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(run, celled + ", ids array<bigint>, scores array<double>")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every other cell that its k-th best so far doesn't rule out."""
        for batch in batches:
            v, p = matrix(batch.column("v"), width), matrix(batch.column("p"), DIMENSIONS)
            rows_at, cell_at, floors = [], [], []
            for i, (at, scores) in enumerate(zip(batch.column("cell").to_pylist(), batch.column("scores").to_pylist())):
                floor = scores[-1] if len(scores) == k else -np.inf
                ceiling = longest + float(v[i] @ v[i])
                near = np.flatnonzero((box_distance(p[i], low, high) <= reach * max(ceiling - 2 * floor + SLACK * ceiling, 0.0)) & (cells != at))
                rows_at += [i] * len(near)
                cell_at += cells[near].tolist()
                floors += [floor] * len(near)
            picked = batch.take(pa.array(rows_at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [picked.column("vec_id"), picked.column("v"), picked.column("p"), pa.array(cell_at, pa.int64()), pa.array(floors, pa.float64())],
                ["vec_id", "v", "p", "cell", "floor"],
            )

    at_home = common.written(search_cells(asked), "neighbours-home")
    elsewhere = search_cells(at_home.mapInArrow(others, celled + ", floor double"))
    both = at_home.select("vec_id", "ids", "scores").unionAll(elsewhere.select("vec_id", "ids", "scores"))
    pairs = both.select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("b"))
    pairs = pairs.select("query_id", F.col("b.ids").alias("vec_id"), F.col("b.scores").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
