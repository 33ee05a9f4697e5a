"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find grouping.

Each document's set of word shingles gets a SuperMinHash signature: an element draws
one random value per step j = 0, 1, ... at a fresh position of a random permutation, worth
j + r; a position keeps its smallest. The ranks of one element are correlated, which lowers
the estimate's variance. Step j + 1 cannot improve a signature whose values are all below
j + 1, so a document stops there; long documents need a step or two. Documents with
equal sets form one class. Classes that agree in all rows of a band meet in a bucket, and `links`
finds the links of its members on their full sets and groups them.

The HOT largest classes are sent to their rows, so that these need not meet by key.

Defined results: documents without words (null, empty or blank texts) have an empty set, link
with nothing and stay; fewer words than a shingle make one shingle of all words. Rows of one id are one
document, linked by any of its texts; each row is returned. Rows without an id have their
n_shingles, no component_id, and stay. A very long text is read whole, one at a time. Ties cannot
occur (ids are ordered). An empty table gives an empty table. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import links
from scriptorium.llm.links import shingle_set
from scriptorium.llm.words import mix, text_parts
from scriptorium.session import Scratch, ship, table

PART_BYTES = 2_000_000


@dataclass(frozen=True)
class Settings:
    """Linked: percent * union <= 100 * intersection. bands x rows values make a signature."""

    shingle: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 4

    @property
    def values(self) -> int:
        return self.bands * self.rows


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (documents x m) of non-empty sets, all at once, step by step.

    A value is the step in the upper 16 bits and the random part below."""
    sizes = np.array([len(s) for s in sets])
    elements, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    best = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    swaps: list[np.ndarray] = []  # of the partial permutation of each element so far
    for step in range(m):
        if not len(elements):
            break
        r = mix(elements ^ np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = (step + (r >> np.uint64(32)) % np.uint64(m - step)).astype(np.int16)
        # position k after the earlier exchanges: the last that moved something there wins
        at = k.copy()
        for j in range(step - 1, -1, -1):
            at = np.where(at == swaps[j], np.int16(j), at) if j else np.where(at == swaps[0], np.int16(0), at)
        swaps.append(k)
        value = np.uint64(step << 48) | (mix(r) >> np.uint64(16))
        np.minimum.at(best, doc * m + at, value)
        done = (best.reshape(-1, m).max(axis=1) >> np.uint64(48)) <= step
        open_ = ~done[doc]
        elements, doc, swaps = elements[open_], doc[open_], [s[open_] for s in swaps]
    return best.reshape(-1, m)


def _signed(df: DataFrame, s: Settings) -> DataFrame:
    """id, n_shingles, set_key, bands (a hash each)."""
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_parts(batch, 1, PART_BYTES):
                sets = [shingle_set(t, s.shingle) for t in batch.column(1)[a:b].to_pylist()]
                full = [i for i, x in enumerate(sets) if len(x)]
                keys: list[bytes | None] = [None] * len(sets)
                bands: list[list[int] | None] = [None] * len(sets)
                if full:
                    sig = super_minhash([sets[i] for i in full], s.values)
                    band = np.zeros((len(full), s.bands), np.uint64)
                    for j in range(s.rows):
                        band = mix(band + sig[:, j :: s.rows]) + np.uint64(j)
                    band = band.astype(np.int64)
                    for n, i in enumerate(full):
                        keys[i], bands[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), band[n].tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, schema.field("bands").type)], schema=schema)

    return df.mapInArrow(run, "id long, n_shingles long, set_key binary, bands array<long>")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, settings: Settings = Settings()) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links), kept (it is its own)."""
    s, scratch = settings, Scratch(df.sparkSession)
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    signed = scratch.write(_signed(docs, s), "signed")
    full = signed.where("n_shingles > 0 and id is not null")
    # Equal sets are one class; its smallest id stands for it.
    classes = full.groupBy("set_key").agg(F.min("id").alias("id"), F.min_by("bands", "id").alias("bands"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
    classes = scratch.write(classes, "classes")
    members = classes.select("id", "n_shingles", F.posexplode("bands").alias("band", "value")).select("id", "n_shingles", F.xxhash64("band", "value").alias("bucket"))
    leaders = scratch.write(members.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1"), "leaders")
    met = scratch.write(links.by_key(members, leaders, "bucket", "n").select("bucket", "leader", "id", "n_shingles"), "buckets")
    # Only members of buckets are compared: from here on their texts are enough.
    texts = scratch.write(links.restricted(docs, met.select("id")), "texts")

    def load(text: str | None) -> np.ndarray:
        return shingle_set(text, s.shingle)

    def confirmed(pairs: DataFrame) -> DataFrame:
        return links.paired(texts, pairs, load, lambda a, b: links.linked(a, b, s.percent), scratch)

    groups, rest = links.by_leaders(met, links.bridges(full, classes), confirmed, scratch)
    groups = links.joined(groups, links.across(texts, links.unsettled(rest, groups, scratch), load, s.percent, scratch), scratch)
    of_class = scratch.write(classes.join(groups, "id", "left").select("set_key", "copies", F.coalesce("component", "id").alias("component")), "of-class")
    del classes, members, leaders, met, texts, groups, rest
    scratch.drop(keep=("signed", "of-class"))  # the result needs no more than these
    found = links.by_key(full.select("id", "n_shingles", "set_key"), of_class, "set_key", "copies").select("id", "n_shingles", "component")
    alone = signed.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component"))
    out = found.unionByName(alone)
    return out.select("id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links from 85 in 100: doc_id, n_shingles, component_id, kept."""
    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", Settings(shingle=3, percent=85))
    return found.withColumnRenamed("id", "doc_id")
