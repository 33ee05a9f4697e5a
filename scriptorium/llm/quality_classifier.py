"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed byte trigrams and of words that repeat the word before or the
one before that (over its whole length), weighted by inverse
document frequency and brought to unit length; a truncated singular value decomposition of
labelled rows gives the latent space. The labelled vectors are sent to every worker; each
document's cosines with all of them are computed exactly, block by block, and the nearest
vote with their labels, weighted by similarity.

The labelled rows are a bounded sample (`sample_rows`, by a hash of the id), so what is sent to
the workers and what the driver decomposes has a fixed size. All documents are scored.

Defined results: an empty or null text has no direction and gets the share of good labels.
Without labelled rows each score is 0.5. Equal similarities keep the order of the labelled
ids. An id labelled several times counts once, with its largest label, and an id with several
texts once, with the smallest. Rows without an id are scored but not learned from. A very long text
is read whole, one at a time. Repeated rows are scored each; empty tables give empty tables; other
columns stay as they are, and the score's column has the name that the caller gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.language_id import fold, sampled
from scriptorium.llm.words import plain, text_parts
from scriptorium.session import ship, table

TRIGRAMS, RANK, NEIGHBOURS, SHARPNESS = 2048, 48, 25, 8
#: What the share of good labels weighs in a vote; it decides only where no neighbour is near.
PRIOR_WEIGHT = 0.5
#: Terms: trigram buckets, and repeats at a distance of one and two words.
TERMS = TRIGRAMS + 2
#: Labelled rows at most, about.
SAMPLE_ROWS = 4_000
PART_BYTES, BLOCK_ROWS = 2_000_000, 256


def counts(texts: list[str | None]) -> np.ndarray:
    """Term counts, a row for each text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        out[i, TRIGRAMS] = sum(map(eq, words, islice(words, 1, None)))
        out[i, TRIGRAMS + 1] = sum(map(eq, words, islice(words, 2, None)))
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        if len(b) > 2:
            x = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
            out[i, :TRIGRAMS] = np.bincount(x >> np.uint32(21), minlength=TRIGRAMS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequency
    space: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled latent vectors, unit length
    labels: np.ndarray
    prior: float

    def latent(self, c: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.sqrt(c) * self.weights) @ self.space)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        for a in range(0, len(texts), BLOCK_ROWS):
            c = counts(texts[a : a + BLOCK_ROWS])
            sims = self.latent(c) @ self.vectors.T
            k = min(NEIGHBOURS, len(self.labels))
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(float) ** SHARPNESS
            total = w.sum(axis=1)
            ok = (total > 0) & (c.sum(axis=1) > 0)
            vote = ((w * self.labels[near]).sum(axis=1) + PRIOR_WEIGHT * self.prior) / (total + PRIOR_WEIGHT)
            out[a : a + len(c)][ok] = vote[ok].clip(0, 1)
        return out


def _main_directions(y: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(11).standard_normal((y.shape[1], min(rank + 16, y.shape[1]))).astype(np.float32)
    for _ in range(8):
        basis, _ = np.linalg.qr(y.T @ (y @ basis))
    _, _, right = np.linalg.svd(y @ basis, full_matrices=False)
    return (basis @ right[:rank].T).astype(np.float32)


def learn(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """From the rows of `labels` (id_col, label_col 0 or 1) that are in `df`; a bounded sample."""
    ship(df.sparkSession)
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    sample = given.where(sampled(given.count(), sample_rows, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_parts(batch, 2, PART_BYTES):
                rows = counts(batch.column(2)[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "label", "counts"])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    one = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # a row for each sampled id
    rows = one.select("id", "label", "text").mapInArrow(run, "id long, label double, counts binary").collect()
    rows.sort(key=lambda r: r.id)
    if not rows:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), 0.5)
    x = np.frombuffer(b"".join(r.counts for r in rows), np.float32).reshape(len(rows), TERMS)
    labels_of = np.array([r.label for r in rows])
    weights = (np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    y = _unit(np.sqrt(x) * weights)
    space = _main_directions(y, min(RANK, len(rows)))
    return Model(weights, space, _unit(y @ space), labels_of, float(labels_of.mean()))


def score(df: DataFrame, model: Model, text_col: str, score_col: str) -> DataFrame:
    """All columns of `df` and `score_col`, which must not be among them."""
    if score_col in df.columns:
        raise ValueError(f"there is a column {score_col} already")
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = df.columns.index(text_col)
    own, _ = plain(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_parts(batch, at, PART_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(part.column(at).to_pylist()), pa.float64())], names=[*part.schema.names, "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{kinds}, score double").toDF(*df.columns, score_col)


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """From documents and labels, without the rows that are held out."""
    return learn(docs, "doc_id", "text", labels.where(fold("doc_id") != 1), "quality")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learned(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, "text", "score")
    return out.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
