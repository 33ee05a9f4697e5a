"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Entries become whole numbers, x = floor(256 c), so that everything up to the covariance is exact: the
fit list holds each different vector once; its sums S and, around the rounded mean, its
products are added up as integers, a task its rows and Spark the tasks, in any order with one result.
V = P L L' P' is the pivoted Cholesky factorisation of the covariance, stopped at the rank. One-sided
Jacobi rotates pairs of columns of L, disjoint pairs at once, until all are orthogonal: L J = U D. The squared norms of
the rotated columns are the eigenvalues of V and the normalised columns, rows put back in place, its
components, small ones as exact relative to themselves as large ones.

Vectors go nowhere but into one distinct; sums and products are rows of (length, i, j), and a group
of them has at most length * length rows. The driver gets a model for each length of vectors.

Defined results: null vectors and those with null or non-finite entries take no part, nor do those with an entry of
2^40 or more. Vectors of each length are whitened among themselves. Components without variance do
not exist: fewer than four rows come of vectors with fewer dimensions or a smaller rank, and none of
one vector or of equal vectors. Repeated rows, repeated ids and rows without an id get rows each.
Equal eigenvalues leave their components open up to a rotation. `deviation` is null where it is
beyond a long. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import materialise, ship, table

#: Entries are counted in so many parts of one, and are smaller than this.
SCALE, LARGEST = 256, 2.0**40
#: Rotations end when columns are orthogonal but for rounding, or after so many sweeps.
ORTHOGONAL, SWEEPS = 1e-15, 60
#: The value's place: of counts, of sums, and else of a product.
COUNT, SUM = -2, -1


@dataclass(frozen=True)
class Model:
    """Of vectors of one length: fit rows, their sums, and components (a row each) by falling eigenvalue."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        mean = self.sums.astype(np.float64) / self.n
        return (x - mean) @ self.components.T / np.sqrt(self.eigenvalues)


def whole_entries(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each length of vectors: which rows have it, and their entries as whole numbers."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    values = pc.fill_null(pc.cast(flat, pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    good = np.ones(len(size), bool)
    good[np.repeat(np.arange(len(size)), size)[~(np.abs(values) < LARGEST)]] = False  # NaN compares as false
    begin = np.cumsum(size) - size
    for d in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == d))
        if d:
            yield rows, np.floor(SCALE * values[begin[rows][:, None] + np.arange(d)]).astype(np.int64)


def products(y: np.ndarray) -> np.ndarray:
    """y' y, exactly, as Python's whole numbers."""
    most = float(np.abs(y).max(initial=0))
    if most * most * len(y) < 2**53:
        y = y.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (d x rank) and the order p of rows with v[p][:, p] = L L', the largest pivot first."""
    d = len(v)
    rest, order, factor = v.copy(), np.arange(d), np.zeros((d, d))
    least = np.finfo(float).eps * d * max(v.diagonal().max(initial=0), 0)
    for k in range(d):
        i = k + int(np.argmax(rest.diagonal()[k:]))
        if rest[i, i] <= least:
            return factor[:, :k], order
        for m in (rest, rest.T, factor):
            m[[k, i]] = m[[i, k]]
        order[[k, i]] = order[[i, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def rotated(factor: np.ndarray) -> np.ndarray:
    """The columns after one-sided Jacobi: orthogonal, the longest first."""
    a = np.asfortranarray(factor)
    r = a.shape[1]
    seats = np.arange(r + r % 2)  # the circle method: every pair meets once a sweep, disjoint pairs at once
    for _ in range(SWEEPS if r > 1 else 0):
        worst = 0.0
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            aa, bb, ab = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(ab) / np.sqrt(aa * bb)
            worst = max(worst, float(off.max(initial=0)))
            turn = off > ORTHOGONAL
            if turn.any():
                p, q, x, y, aa, bb, ab = p[turn], q[turn], x[:, turn], y[:, turn], aa[turn], bb[turn], ab[turn]
                zeta = (bb - aa) / (2 * ab)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * (x - t * y), c * (t * x + y)
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= 4 * ORTHOGONAL * len(a) ** 0.5:
            break
    return a[:, np.argsort(-(a * a).sum(axis=0), kind="stable")]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues of v, falling, and a unit eigenvector each (rows)."""
    factor, order = pivoted_cholesky(v)
    a = rotated(factor)
    values = (a * a).sum(axis=0)
    vectors = np.empty_like(a.T)
    vectors[:, order] = (a / np.sqrt(values)).T
    return values, vectors


def _entries(d: int, *parts: tuple[int, np.ndarray | list]) -> list[tuple]:
    """(length, i, j, value) of counts, sums and products."""
    return [(d, i, j, Decimal(int(x))) for i, row in parts for j, x in enumerate(row)]


_ENTRY = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.decimal128(38, 0))])


def _added(fit: DataFrame, made) -> DataFrame:
    """The entries that `made` gives for the sums over a task's vectors, added up: d, i, j, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size).tolist():
                x = np.frombuffer(b"".join(batch.column("x").filter(pa.array(size == d)).to_pylist()), "<i8").reshape(-1, d)
                more = made(d, x)
                held[d] = [a + b for a, b in zip(held[d], more)] if d in held else more
        rows = [e for d, parts in held.items() for e in _entries(d, *((SUM + k if k < 1 else k - 1, p) for k, p in enumerate(parts)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ENTRY)], schema=_ENTRY)

    return fit.mapInArrow(run, "d int, i int, j int, value decimal(38,0)").groupBy("d", "i", "j").agg(F.sum("value").alias("value"))


def _distinct(vectors: DataFrame) -> DataFrame:
    """d, x: every different vector of whole numbers once (bytes of longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole_entries(batch.column(0)):
                own = np.unique(x, axis=0) if len(x) > 1 else x
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(own), pa.int32()), pa.array([r.astype("<i8").tobytes() for r in own], pa.binary())], names=["d", "x"])

    return vectors.mapInArrow(run, "d int, x binary").distinct()


def fit(vectors: DataFrame, components: int) -> tuple[dict[int, Model], dict[int, float]]:
    """A model for each length of the vectors in the only column of `vectors`, and the largest entry of the
    whitened fit list's covariance less the identity, measured over that list."""
    rows = materialise(_distinct(vectors), "fit")
    firsts: dict[int, tuple[int, list[int]]] = {}
    for r in _added(rows, lambda d, x: [np.array([len(x), *x.astype(object).sum(axis=0)], object)]).collect():
        n, sums = firsts.setdefault(r.d, [0, [0] * r.d])
        if r.j:
            sums[r.j - 1] = int(r.value)
        else:
            firsts[r.d][0] = int(r.value)
    middle = {d: np.array([round(s / n) for s in sums], np.int64) for d, (n, sums) in firsts.items()}

    def scatter(d: int, x: np.ndarray) -> list[np.ndarray]:
        return [np.array([len(x)], object), *products(x - middle[d])]

    def solved(key: tuple, group: pa.Table) -> pa.Table:
        d = key[0].as_py()
        n, sums = firsts[d]
        m = np.zeros((d, d), object)
        for i, j, value in zip(*(group[c].to_pylist() for c in ("i", "j", "value"))):
            if i >= 0:
                m[i, j] = int(value)
        rest = np.array([s - n * int(c) for s, c in zip(sums, middle[d].tolist())], object)
        exact = n * m - np.outer(rest, rest)  # n^2 times the covariance
        v = np.array([[x / (n * n) for x in row] for row in exact.tolist()], np.float64)
        values, vectors = eigen(v)
        values, vectors = values[:components], vectors[:components]
        return pa.table({"d": pa.array([d], pa.int32()), "trace": pa.array([float(sum(exact.diagonal().tolist()) / (n * n))]), "eigenvalues": pa.array([values.tolist()], pa.list_(pa.float64())), "components": pa.array([vectors.reshape(-1).tolist()], pa.list_(pa.float64()))})

    found = _added(rows, scatter).groupBy("d").applyInArrow(solved, "d int, trace double, eigenvalues array<double>, components array<double>")
    models = {}
    for r in found.collect():
        n, sums = firsts[r.d]
        models[r.d] = Model(n, np.array(sums, object), np.array(r.components).reshape(-1, r.d), np.array(r.eigenvalues), r.trace)
    return models, _identity_errors(rows, models)


def _identity_errors(rows: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size).tolist():
                x = np.frombuffer(b"".join(batch.column("x").filter(pa.array(size == d)).to_pylist()), "<i8").reshape(-1, d)
                w = models[d].whitened(x)
                w = np.column_stack([np.ones(len(w)), w])
                held[d] = held.get(d, 0) + w.T @ w
        out = [(d, i, j, float(x)) for d, m in held.items() for i, row in enumerate(m) for j, x in enumerate(row)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["d", "i", "j", "value"])

    sums = rows.mapInArrow(run, "d int, i int, j int, value double").groupBy("d", "i", "j").agg(F.sum("value").alias("value"))
    by: dict[int, np.ndarray] = {}
    for r in sums.collect():
        k = len(models[r.d].eigenvalues) + 1
        by.setdefault(r.d, np.zeros((k, k)))[r.i, r.j] = r.value
    out = {}
    for d, m in by.items():
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        out[d] = float(np.abs(m[1:, 1:] / n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))
    return out


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row, exactly; None beyond a long."""
    bound = model.n * (float(np.abs(x).max(initial=0)) + float(max(map(abs, model.sums.tolist()))) / model.n)
    if bound * bound * x.shape[1] < 2**62:
        y = model.n * x - model.sums.astype(np.int64)
        return (y * y).sum(axis=1).tolist()
    y = model.n * x.astype(object) - model.sums
    return [s if s < 2**63 else None for s in (y * y).sum(axis=1).tolist()]


def whiten(df: DataFrame, id_col: str, vector_col: str, components: int = 4) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector
    and component."""
    ship(df.sparkSession)
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("vector is not null")
    models, errors = fit(vectors.select("vector"), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_entries(batch.column(1)):
                model, d = models[x.shape[1]], x.shape[1]
                k = len(model.eigenvalues)
                each = lambda column: pa.array(np.tile(column, len(rows)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(rows, k))),
                    each(np.arange(1, k + 1, dtype=np.int32)),
                    pa.array(np.full(k * len(rows), model.n)),
                    pa.array([v for v in deviations(x, model) for _ in range(k)], pa.int64()),
                    pa.array(model.whitened(x).reshape(-1)),
                    each(model.eigenvalues / model.trace if k else model.eigenvalues),
                    pa.array(np.full(k * len(rows), errors[d])),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component (to 4), n, deviation, whitened, explained, identity_error of embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4).withColumnRenamed("id", "vec_id")
