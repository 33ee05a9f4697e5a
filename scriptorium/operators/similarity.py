"""Exact vector search by cosine distance over an inverted file, and leader clustering.

On unit vectors cosine distance c is half the squared Euclidean distance, so the triangle inequality holds for
sqrt(2 c). Every row goes to the cell of its nearest pivot, and in the cell to a ring by its distance
to the pivot; rings of many rows are dealt to blocks of BLOCK_ROWS. A query at distance p from a pivot has nothing
nearer than p - outer or inner - p in a ring of that pivot, and blocks beyond its limit are never sent
anywhere. The limit of a range search is given; that of a k-nearest search is the k-th distance in the
query's own cell. Pivots, at most MOST_CELLS for each length of vectors, are the centres of a bounded sample; they
and the extent of their cells go to all workers.

Vectors meet only those of the same length and group; rows without an id or a vector, or with a null in
it, take no part. A zero vector has distance 1 to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.dedup import greedy_drops
from scriptorium.session import Scratch, materialise, ship

BLOCK_ROWS, QUERY_ROWS = 8192, 16_384
#: Queries of a task that are compared with a batch of rows at once.
MET_ROWS = 1024
#: Rows for which there is a cell, cells at most, and vectors that pivots are fitted on.
CELL_ROWS, MOST_CELLS, SAMPLE_ROWS = 32_768, 1024, 8192
#: Rings of a cell (Euclidean distances are up to 2), and what rounding may add to a bound.
RINGS, SLACK = 32, 1e-6
#: Rows from which leaders are taken at once, and the share of rows that must fall for another such round.
LEADER_ROWS, FALLING = 2048, 0.05

#: Centres of cells by length of vectors; others have one cell around zero.
Pivots = dict[int, np.ndarray]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _columns(df: DataFrame, group: str | None, id_col: str, vector_col: str) -> DataFrame:
    """g (group and length), id, v."""
    v = F.col(vector_col).cast("array<double>")
    own = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")) if group else F.lit("")
    rows = df.select(F.concat(own, F.lit("|"), F.size(vector_col)).alias("g"), F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each length of vectors in a batch."""
    v = batch.column(column)
    size, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
    begin = np.cumsum(size) - size
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield rows, _unit(flat[begin[rows][:, None] + np.arange(d)])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a and b."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """About n centres of x: the farthest points in turn, then a few rounds of means."""
    nearest, at = np.full(len(x), np.inf), 0
    chosen = []
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(at)
        nearest = np.minimum(nearest, _apart(x, x[at : at + 1])[:, 0])
        at = int(nearest.argmax())
    centres = x[chosen]
    for _ in range(4):
        home = _apart(x, centres).argmin(axis=1)
        rows = np.bincount(home, minlength=len(centres))[:, None]
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        centres = np.where(rows > 0, sums / np.maximum(rows, 1), centres)
    return centres


def _pivots(base: DataFrame) -> Pivots:
    cells = min(MOST_CELLS, -(-base.count() // CELL_ROWS))
    if cells <= 1:
        return {}
    sample = base.select("id", "v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE_ROWS).select("v").toArrow()
    return {x.shape[1]: _centres(x, cells) for batch in sample.combine_chunks().to_batches() for _, x in _matrices(batch, "v")}


def _celled(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """g, id, v with cell, r (distance to its pivot) and ring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, r = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for rows, x in _matrices(batch, "v"):
                d = _apart(x, pivots.get(x.shape[1], np.zeros((1, x.shape[1]))))
                cell[rows] = d.argmin(axis=1)
                r[rows] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(r), pa.array((r * RINGS / 2).astype(np.int32))], names=["g", "id", "v", "cell", "r", "ring"])

    return rows.mapInArrow(run, "g string, id long, v array<double>, cell int, r double, ring int")


_RING = ["g", "cell", "ring"]


def _block(sub) -> F.Column:
    return F.concat_ws("/", *_RING, sub).alias("block")


class Inverted:
    """An inverted file over rows (g, id, v)."""

    def __init__(self, base: DataFrame, scratch: Scratch) -> None:
        ship(base.sparkSession)
        self.scratch = scratch
        self.pivots = _pivots(base)
        rows = scratch.write(_celled(base, self.pivots), "celled")
        rings = rows.groupBy(*_RING).agg(F.min("r").alias("inner"), F.max("r").alias("outer"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("subs"))
        self.rings = scratch.write(rings, "rings")
        subs = self.rings.select(*_RING, "subs")
        self.rows = rows.join(subs, _RING).select(_block(F.pmod(F.xxhash64("id"), "subs")), "id", "v")
        self.blocks = self.rings.select(*_RING, "inner", "outer", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")).select("g", "cell", "inner", "outer", _block(F.col("sub")))
        extent = self.rings.groupBy(F.regexp_extract("g", "([0-9]+)$", 1).cast("int").alias("d"), "cell").agg(F.min("inner"), F.max("outer")).collect()  # MOST_CELLS for each length
        self.extent = {(r[0], r[1]): (r[2], r[3]) for r in extent}

    def own_visits(self, queries: DataFrame) -> DataFrame:
        """block, query_id, v: each query with the blocks of its own cell."""
        asked = _celled(queries, self.pivots).select("g", "cell", F.col("id").alias("query_id"), "v")
        return asked.join(self.blocks.select("g", "cell", "block"), ["g", "cell"]).select("block", "query_id", "v")

    def visits(self, queries: DataFrame, elsewhere: bool = False) -> DataFrame:
        """block, query_id, v: each query (g, id, v, limit) with the blocks that may hold rows within its
        limit, only outside its own cell if `elsewhere`."""
        pivots, extent = self.pivots, self.extent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                limit = batch.column("limit").to_numpy()
                for rows, x in _matrices(batch, "v"):
                    length = x.shape[1]
                    d = _apart(x, pivots.get(length, np.zeros((1, length))))
                    inner, outer = (np.array([extent.get((length, c), (np.inf, -np.inf))[k] for c in range(d.shape[1])]) for k in (0, 1))
                    open_ = np.maximum(d - outer, inner - d) <= limit[rows][:, None] + SLACK
                    if elsewhere:
                        open_[np.arange(len(d)), d.argmin(axis=1)] = False
                    i, cell = np.nonzero(open_)
                    at = pa.array(rows[i])
                    yield pa.RecordBatch.from_arrays([batch.column("g").take(at), batch.column("id").take(at), pa.array(cell, pa.int32()), pa.array(d[i, cell]), pa.array(limit[rows[i]])], names=["g", "query_id", "cell", "p", "limit"])

        met = queries.select("g", "id", "v", "limit").mapInArrow(run, "g string, query_id long, cell int, p double, limit double")
        near = F.greatest(F.col("p") - F.col("outer"), F.col("inner") - F.col("p")) <= F.col("limit") + SLACK
        found = met.join(self.blocks, ["g", "cell"]).where(near).select("block", "query_id", F.col("g").alias("_g")).distinct()
        own = queries.select(F.col("id").alias("query_id"), F.col("g").alias("_g"), "v")
        return found.join(own, ["query_id", "_g"]).drop("_g")

    def pairs(self, visits: DataFrame, most: float, k: int | None = None) -> DataFrame:
        """query_id, id, distance below `most` (k nearest of each batch of a block, if given), other ids only. A task holds
        QUERY_ROWS queries of a block and streams over the block's rows."""
        visits = self.scratch.write(visits, "visits")
        portions = visits.groupBy("block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("portions"))
        asked = visits.join(portions, "block").select("block", F.pmod(F.xxhash64("query_id"), "portions").cast("int").alias("portion"), F.lit(0).alias("kind"), F.col("query_id").alias("id"), "v")
        rows = self.rows.join(portions, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(1).alias("kind"), "id", "v")
        both = asked.unionByName(rows).select(F.concat_ws("/", "block", "portion").alias("key"), "kind", "id", "v")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, ids, asked = None, np.empty(0, np.int64), np.empty((0, 0))
            for batch in batches:
                keys, kinds = batch.column("key"), batch.column("kind").to_numpy()
                names = keys.dictionary_encode()
                codes = names.indices.to_numpy()
                cut = np.concatenate([[0], np.flatnonzero((np.diff(codes) != 0) | (np.diff(kinds) != 0)) + 1, [len(codes)]]) if len(codes) else [0]
                for a, b in zip(cut[:-1].tolist() if len(codes) else [], cut[1:].tolist() if len(codes) else []):
                    part = batch.slice(a, b - a)
                    key, own = keys[a].as_py(), part.column("id").to_numpy()
                    ((_, x),) = _matrices(part, "v")  # one length in a block
                    if kinds[a] == 0:
                        same = key == of
                        of, ids, asked = key, np.concatenate([ids, own]) if same else own, np.concatenate([asked, x]) if same else x
                        continue
                    if key != of:
                        continue
                    for at in range(0, len(ids), MET_ROWS):
                        some = ids[at : at + MET_ROWS]
                        d = 1 - asked[at : at + MET_ROWS] @ x.T
                        d[some[:, None] == own[None, :]] = np.inf
                        if k and k < d.shape[1]:
                            d = np.where(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k], d, np.inf)
                        i, j = np.nonzero(d < most)
                        yield pa.RecordBatch.from_arrays([pa.array(some[i]), pa.array(own[j]), pa.array(d[i, j])], names=["query_id", "id", "distance"])

        return both.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(run, "query_id long, id long, distance double")


def pairs_within(base: DataFrame, queries: DataFrame, id_col: str, vector_col: str, most: float, group: str | None = None) -> DataFrame:
    """query_id, id, distance: cosine distances below `most` between queries and rows of the same
    group, other ids only."""
    file = Inverted(_columns(base, group, id_col, vector_col), Scratch(base.sparkSession))
    asked = _columns(queries, group, id_col, vector_col).withColumn("limit", F.lit(float(np.sqrt(2 * max(most, 0)))))
    return file.pairs(file.visits(asked), most)


def top_k(base: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, group: str | None = None, most: float = 3.0) -> DataFrame:
    """query_id, rank, id, distance: the k nearest below `most`, ties to the smaller id."""
    scratch = Scratch(base.sparkSession)
    file = Inverted(_columns(base, group, id_col, vector_col), scratch)
    asked = _columns(queries, group, id_col, vector_col)
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    found = file.pairs(file.own_visits(asked), most, k)
    if file.pivots:  # there are other cells
        found = scratch.write(found, "own-cell")
        rank = F.row_number().over(order)
        limit = found.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt(F.greatest(2 * F.col("distance"), F.lit(0.0)) + SLACK).alias("limit"))
        bound = float(np.sqrt(2 * min(max(most, 0), 2)))
        asked = scratch.write(asked.join(limit, "id", "left").withColumn("limit", F.least(F.coalesce("limit", F.lit(bound)), F.lit(bound))), "limits")
        found = found.unionByName(file.pairs(file.visits(asked, elsewhere=True), most, k))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def leader_clusters(df: DataFrame, id_col: str, vector_col: str, group: str, least: float = 0.62) -> DataFrame:
    """group, id, leader: in order of id a row seeds a cluster unless an earlier seed is near
    enough; every other row belongs to its earliest near seed.

    The first LEADER_ROWS rows that are left are judged in order; the seeds among them (a bounded number) go to all
    rows left, and what is near one falls and meets nobody any more. So a cluster costs a
    comparison a row and round and not one a pair. Once few rows fall to such seeds, the pairs of the rest are
    found by the inverted file and resolved in rounds."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    ship(spark)
    most = 1 - least + 1e-12
    rows = scratch.write(_columns(df, group, id_col, vector_col), "rows")
    of = df.select(F.col(group), F.col(id_col).cast("long").alias("id")).where("id is not null")
    done, left, n = spark.createDataFrame([], "id long, leader long"), rows, rows.count()

    def seeds(part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        ((_, x),) = _matrices(part.combine_chunks().to_batches()[0], "v")
        near, own = 1 - x @ x.T < most, []
        for i in range(len(x)):
            if not near[i, own].any():
                own.append(i)
        return part.take(pa.array(own, pa.int64()))

    while n:
        first = left.orderBy("id").limit(LEADER_ROWS).groupBy("g").applyInArrow(seeds, left.schema).toArrow().sort_by("id")
        by: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for g in first["g"].unique().to_pylist():
            own = first.filter(pc.equal(first["g"], g)).combine_chunks()
            ((_, x),) = _matrices(own.to_batches()[0], "v")
            by[g] = own["id"].to_numpy(), x

        def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g, leader = batch.column("g").dictionary_encode(), np.full(batch.num_rows, -1, np.int64)
                for code, name in enumerate(g.dictionary.to_pylist()):
                    at = np.flatnonzero(g.indices.to_numpy() == code)
                    if name in by and len(at):
                        ids, x = by[name]
                        ((_, own),) = _matrices(batch.take(pa.array(at)), "v")
                        near = 1 - own @ x.T < most
                        near[batch.column("id").to_numpy()[at][:, None] == ids[None, :]] = True
                        leader[at[near.any(axis=1)]] = ids[near.argmax(axis=1)[near.any(axis=1)]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leader, mask=leader < 0)], names=["g", "id", "v", "leader"])

        judged = scratch.write(left.mapInArrow(fall, "g string, id long, v array<double>, leader long"), "judged")
        done = done.unionByName(judged.where("leader is not null").select("id", "leader"))
        left = judged.where("leader is null").drop("leader")
        before, n = n, left.count()
        if before - n < FALLING * before:
            break
    if not n:
        return of.join(done, "id").select(group, "id", "leader")
    file = Inverted(left, scratch)
    pairs = file.pairs(file.visits(left.withColumn("limit", F.lit(float(np.sqrt(2 * max(most, 0)))))), most).where("query_id < id").select("query_id", "id").distinct()
    edges = scratch.write(pairs.join(left.select("id", "g").distinct(), "id").select("g", F.col("query_id").alias("a"), F.col("id").alias("b")), "near")
    fallen = materialise(greedy_drops(edges, "g").select(F.col("dropped").alias("b")).distinct(), "fallen")
    own = left.join(fallen, left["id"] == fallen["b"], "left_anti")
    members = edges.join(fallen, "b").join(own.select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("leader"))
    found = done.unionByName(own.select("id", F.col("id").alias("leader"))).unionByName(members.select(F.col("b").alias("id"), "leader"))
    return of.join(found, "id").select(group, "id", "leader")
