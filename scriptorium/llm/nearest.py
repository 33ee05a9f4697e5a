"""Approximate nearest neighbours: stable projections, a kd-tree, a chi-square stopping test.

Vectors are projected to DIMS dimensions with Gaussian (2-stable) directions, so that for two
vectors at distance d the squared projected distance is d^2 times a chi-square variable with DIMS
degrees of freedom. A coarse kd-tree over the projections of a bounded sample cuts space into cells;
every vector goes to its cell. A query searches its own cell first, and then every other cell
for which the stopping test is still open, with what it found as its limit. In a cell, a finer
kd-tree over all its projections yields leaves by growing projected distance; the vectors of a leaf
are verified with their true distances. The search ends when the bound D of the next leaf (or of a
cell) holds D^2 > x * d_k^2, with x the chi-square quantile of CONFIDENCE and d_k the k-th
distance so far: a vector nearer than d_k is then still unseen with a chance of at most
1 - CONFIDENCE. Leaves at the bound are opened, with a margin for the rounding of projections, so
of many equal vectors the smallest ids are found (d_k is 0 there). The k best of all are ranked together.

A cell with more vectors than BLOCK_ROWS is dealt to blocks, and its queries to portions, so a task
holds BLOCK_ROWS vectors and QUERY_ROWS queries whatever the table's size. Only the coarse
tree goes to all workers: at most a sixteenth of SAMPLE_ROWS cells for each length of vectors.

Defined results: null vectors, zero vectors and those with null or non-finite components take
no part; vectors meet only those of the same length. Distances are computed in double
precision on the original components; ties go to the smaller id. Repeated ids count as separate
candidates; a query is never its own candidate, by id. Equal query rows are one query; different
vectors under one query id are queries of their own, each with ranks from 1 (`query_key` tells them
apart). Vectors of any length take part; other columns are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.language_id import sampled
from scriptorium.session import materialise, ship, table

DIMS, LEAF, CONFIDENCE, SEED = 8, 32, 0.999, 3
#: Vectors from which the coarse tree is fitted, and for which it has one cell.
SAMPLE_ROWS, CELL_ROWS = 100_000, 131_072
BLOCK_ROWS, QUERY_ROWS = 16_384, 8_192
#: Cells whose sizes are sent to all workers; more are joined by key.
MOST_SENT = 100_000


def chi_square_quantile(p: float, dims: int) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return hi


@dataclass
class KdTree:
    """Leaves of at most LEAF points: rows of `order` from cut[i] to cut[i + 1], and their boxes."""

    order: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> KdTree:
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            own = points[rows]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            rows = rows[np.argpartition(own[:, axis], len(rows) // 2)]
            todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
        sizes = [len(x) for x in leaves]
        order = np.concatenate(leaves)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        return cls(order, cut, np.minimum.reduceat(points[order], cut[:-1]), np.maximum.reduceat(points[order], cut[:-1]))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance from q to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


@dataclass
class Cells:
    """A kd-tree that cuts all space into cells: for each node the axis (-1: a cell), where it is cut
    and its first child (the second follows), and for each cell its number and region."""

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, n: int) -> Cells:
        """About `n` cells with as many of the points each, the fullest cell cut first."""
        nodes = [[-1, 0.0, 0, np.full(DIMS, -np.inf), np.full(DIMS, np.inf)]]
        open_ = [(-len(points), 0, np.arange(len(points)))]
        cells = 1
        while open_ and cells < n:
            _, at, rows = heapq.heappop(open_)
            own = points[rows]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(rows) else 0
            if len(rows) < 2 or own[:, axis].max() == own[:, axis].min():
                continue
            x = np.sort(own[:, axis])
            cut = x[(len(x) - 1) // 2]
            cut = float(cut if cut < x[-1] else x[x < cut][-1])  # both sides get points
            nodes[at][:3] = axis, cut, len(nodes)
            for side, part in enumerate((rows[own[:, axis] <= cut], rows[own[:, axis] > cut])):
                low, high = nodes[at][3].copy(), nodes[at][4].copy()
                (low if side else high)[axis] = cut
                heapq.heappush(open_, (-len(part), len(nodes), part))
                nodes.append([-1, 0.0, 0, low, high])
            cells += 1
        axis = np.array([x[0] for x in nodes])
        leaf = axis < 0
        return cls(axis, np.array([x[1] for x in nodes]), np.array([x[2] for x in nodes]), np.cumsum(leaf) - 1, np.array([x[3] for x in nodes])[leaf], np.array([x[4] for x in nodes])[leaf])

    def home(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while len(points) and (inner := self.axis[node] >= 0).any():
            right = points[np.arange(len(points)), np.maximum(self.axis[node], 0)] > self.cut[node]
            node = np.where(inner, self.child[node] + right, node)
        return self.number[node]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from q to each cell."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, DIMS))


def stop_factor(confidence: float) -> float:
    """How many times d_k a projected distance must be to end the search."""
    return math.sqrt(chi_square_quantile(confidence, DIMS))


def distances(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares added up in the order of the components."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        gap = vectors[:, j] - q[j]
        total += gap * gap
    return np.sqrt(total)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, confidence: float = CONFIDENCE, limits: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(number of the query, id, distance) of the k nearest found in one block, for each query; with
    `limits`, only of those within each query's limit."""
    limits = np.full(len(queries), math.inf) if limits is None else limits
    points, targets = vectors @ directions(vectors.shape[1]), queries @ directions(vectors.shape[1])
    tree = KdTree.build(points)
    ids, vectors = ids[tree.order], vectors[tree.order]
    stop, out = stop_factor(confidence), []
    margin = 1e-9 * max(np.abs(points).max(), np.abs(targets).max(initial=0))
    for number, (qid, q, target, limit) in enumerate(zip(query_ids, queries, targets, limits)):
        bound = tree.bounds(target)
        near, best, worst, step = np.argsort(bound, kind="stable"), [], limit, 4
        at = 0
        while at < len(near) and bound[near[at]] <= (stop * worst + margin) ** 2:
            leaves = near[at : at + step]
            at, step = at + step, min(2 * step, 64)
            rows = np.concatenate([np.arange(tree.cut[x], tree.cut[x + 1]) for x in leaves])
            rows = rows[ids[rows] != qid]
            found = zip(distances(vectors[rows], q).tolist(), ids[rows].tolist())
            best = sorted([*best, *found])[:k]
            worst = min(limit, best[-1][0]) if len(best) == k else limit
        out += [(number, i, d) for d, i in best if d <= limit]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, a row each."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("size").to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        yield size, batch.take(pa.array(np.flatnonzero(sizes == size)))


def _fitted(rows: DataFrame) -> dict[int, Cells]:
    """The coarse trees of the lengths that a bounded sample of the rows (size, id, v) has."""
    n = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch):
                points = _matrix(part.column("v")) @ directions(size)
                yield pa.RecordBatch.from_arrays([part.column("size"), part.column("id"), pa.array(list(points), pa.list_(pa.float64()))], names=["size", "id", "p"])

    if n <= CELL_ROWS:
        return {}
    found = rows.where(sampled(n, SAMPLE_ROWS, "id")).mapInArrow(run, "size int, id long, p array<double>").toArrow()
    sizes, points = found["size"].to_numpy(), _matrix(found["p"])
    order = np.argsort(found["id"].to_numpy(), kind="stable")
    sizes, points = sizes[order], points[order]
    return {s: Cells.fit(own := points[sizes == s], min(-(-n * len(own) // (len(sizes) * CELL_ROWS)), len(own) // 16)) for s in np.unique(sizes).tolist()}


def _searched(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, query_key, id, score: the k nearest of each block, of the rows (size, cell, id, v) for the
    queries (size, cell, id, key, limit, v) that come to their cell."""
    at = ["size", "cell"]
    n = rows.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).join(asked.groupBy(*at).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("portions")), at)
    n = materialise(n, "cells")
    n = F.broadcast(n) if n.count() <= MOST_SENT else n
    own = lambda m, *key: F.pmod(F.xxhash64(*key), F.col(m)).cast("int")
    other = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    none = F.lit(None)
    dealt = rows.join(n, at).select(*at, own("blocks", "id").alias("block"), other("portions").alias("portion"), F.lit(0).alias("kind"), "id", none.cast("long").alias("key"), none.cast("double").alias("limit"), "v")
    dealt = dealt.unionByName(asked.join(n, at).select(*at, other("blocks").alias("block"), own("portions", "id", "key").alias("portion"), F.lit(1).alias("kind"), "id", "key", "limit", "v"))

    def run(group: pa.Table) -> pa.Table:
        kind, ids = group["kind"].to_numpy(), group["id"].to_numpy()
        vectors, ask = _matrix(group["v"]), np.flatnonzero(kind == 1)
        base = np.flatnonzero(kind == 0)
        limits = group["limit"].to_numpy()[ask]
        found = search(ids[base], vectors[base], ids[ask], vectors[ask], k, limits=np.where(np.isnan(limits), math.inf, limits)) if len(base) and len(ask) else []
        of = ask[[x[0] for x in found]] if found else ask[:0]
        return pa.table({"query_id": pa.array(ids[of], pa.int64()), "query_key": group["key"].take(pa.array(of)), "id": pa.array([x[1] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.float64())})

    return materialise(dealt.groupBy(*at, "block", "portion").applyInArrow(run, "query_id long, query_key long, id long, score double"), "found")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "query_key", "rank", "id", "score")


def nearest(df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int) -> DataFrame:
    """query_id, query_key (a hash of its vector), rank, id, score: the k nearest rows of `df` found for
    each different row of `queries`."""
    spark = df.sparkSession
    ship(spark)

    def valid(x: DataFrame) -> DataFrame:
        x = x.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
        finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        return x.where(finite & F.exists("v", lambda c: c != 0)).select(F.size("v").alias("size"), "id", "v")

    rows = valid(df)
    asked = valid(queries).distinct().select("size", "id", F.xxhash64("v").alias("key"), F.lit(None).cast("double").alias("limit"), "v")
    shared = spark.sparkContext.broadcast(_fitted(rows))
    stop = stop_factor(CONFIDENCE)

    def placed(further: bool, names: list[str]):
        """Rows with the cell that they lie in, or (`further`) with each other cell that is open to them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, part in _by_size(batch):
                    cells = shared.value.get(size)
                    points = _matrix(part.column("v")) @ directions(size) if cells else np.zeros((part.num_rows, DIMS))
                    home = cells.home(points) if cells else np.zeros(part.num_rows, np.int64)
                    at = np.arange(part.num_rows)
                    if further:
                        limits = part.column("limit").to_numpy(zero_copy_only=False)
                        margin = 1e-9 * np.abs(points).max(initial=0)
                        opened = [np.flatnonzero((cells.bounds(p) <= (stop * d + margin) ** 2) & (np.arange(len(cells.low)) != h)) if cells else at[:0] for p, d, h in zip(points, limits, home)]
                        at, home = np.repeat(at, [len(x) for x in opened]), np.concatenate([at[:0], *opened])
                    own = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), *(own.column(c) for c in names)], names=["cell", *names])

        return run

    kinds = {"size": "int", "id": "long", "key": "long", "limit": "double", "v": "array<double>"}
    schema = lambda names: "cell int, " + ", ".join(f"{c} {kinds[c]}" for c in names)
    celled = materialise(rows.mapInArrow(placed(False, rows.columns), schema(rows.columns)), "celled")
    first = _searched(celled, asked.mapInArrow(placed(False, asked.columns), schema(asked.columns)), k)
    if not shared.value:
        return _best(first, k)
    reached = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("query_key").alias("key"), F.col("score").alias("limit"))
    again = asked.drop("limit").join(reached, ["id", "key"], "left").select("size", "id", "key", F.coalesce("limit", F.lit(float("inf"))).alias("limit"), "v")
    second = _searched(celled, again.mapInArrow(placed(True, again.columns), schema(again.columns)), k)
    return _best(first.unionByName(second), k)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: ten nearest of every row whose vec_id 100 divides."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = nearest(vectors, "vec_id", "embedding", vectors.where("vec_id % 100 = 0"), 10)
    return found.drop("query_key").withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM d
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
