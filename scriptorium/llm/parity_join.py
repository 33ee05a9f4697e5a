"""N-gram Jaccard join by parity sketches: pigeonhole over sketch parts per size band, then verification.

A document's parity sketch has a bit for each possible token (hash of a shingle of words), and each
token of the set flips its bit; the exclusive or of two sketches is the sketch of the symmetric difference, so
their Hamming distance is at most its size. Sets with a similarity of at least t differ in at most
D = (|A| + |B|) (1 - t) / (1 + t) tokens. The sketch of a size band is cut into p > D parts, so two such
sketches agree in p - D parts at least, and, however the parts are ordered, as long as it is one order for
all, both have an equal part among their first D + 1. These parts are the keys on which documents meet:
a join key is band, part number and a hash of the part that is linear like the sketch (the exclusive or of
the values of its bits), so the wide sketch never has to be written out. Bands are powers of two; a
set also joins the next band if a partner could be there.

Parts with most bits come first, as they are the rarest; empty ones come last and are only used
by sets with too few others. Buckets that many documents share without being linked (a passage
common to them) are joined again: the parts of these documents are counted, over all of them, and
ordered by frequency. Buckets with the same members count once.

Candidates are compared by a short sketch first (the wide one folded to about four bits a token; sketches
of different bands fold to the smaller size), whose Hamming distance is a lower bound, too. What passes
is verified on the full sets, as `links` describes: stars to leaders, then blocks, never all pairs.
Equal sets are one class and meet nobody.

Defined results: null, empty and blank texts have an empty set and link with nothing; fewer words than a
shingle make one shingle of all words. Rows of one id are one document, linked by any of its texts; each row is
returned. Rows without an id have their n_shingles and no component_id. A very long text is read whole, one at a time.
Ties cannot occur (ids are ordered). An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm import links
from scriptorium.llm.links import shingle_set
from scriptorium.llm.words import mix, text_parts
from scriptorium.session import Scratch, ship, table

PART_BYTES = 2_000_000
#: Parts of a band for each that may differ, and at least so many.
SPARE, LEAST_PARTS = 1.35, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Linked: percent * union <= 100 * intersection."""

    shingle: int = 5
    percent: int = 80

    def differ(self, both: int) -> int:
        """The most tokens in which linked sets of `both` tokens together differ."""
        return both * (100 - self.percent) // (100 + self.percent)

    def bands(self, size: int) -> list[tuple[int, int, int]]:
        """(band, parts, tokens in which a partner there may differ) for a set of `size` tokens."""
        largest = size * 100 // self.percent
        out = []
        for band in range(size.bit_length() - 1, largest.bit_length()):
            above = 2 << band  # sizes of the band and of those that join it are below
            parts = max(LEAST_PARTS, int(SPARE * (self.differ(2 * above - 2) + 1)))
            out.append((band, parts, self.differ(size + min(largest, above - 1))))
        return out


def sketch_parts(tokens: np.ndarray, band: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of bits of the parts that have any. `tokens`: sorted, distinct, uniform."""
    part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    begin = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
    value = np.bitwise_xor.reduceat(mix(tokens), begin)
    return mix(value ^ mix(part[begin] + np.uint64(band << 40))), np.diff(np.concatenate([begin, [len(tokens)]]))


def empty_parts(tokens: np.ndarray, band: int, parts: int, n: int) -> np.ndarray:
    """Keys of the first `n` parts without a bit, in an order for all."""
    part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    keys = mix(mix(np.setdiff1d(np.arange(parts, dtype=np.uint64), part) + np.uint64(band << 40)) + _STEP)
    return np.sort(keys)[:n]


def first_keys(tokens: np.ndarray, s: Settings) -> list[int]:
    """The join keys of a set: of each band, the first parts by bits, falling."""
    out = []
    for band, parts, differ in s.bands(len(tokens)):
        if differ:  # else only an equal set is linked
            keys, bits = sketch_parts(tokens, band, parts)
            own = keys[np.lexsort((keys, -bits))[: differ + 1]]
            if len(own) <= differ:
                own = np.concatenate([own, empty_parts(tokens, band, parts, differ + 1 - len(own))])
            out += own.astype(np.int64).tolist()
    return out


def short_sketch(tokens: np.ndarray) -> bytes:
    """The number of tokens (8 bytes) and the sketch folded to a power of two of bits, four a token at most."""
    bits = max(8, 4 << (len(tokens).bit_length() - 1))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(tokens).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def unpacked(sketch: bytes) -> tuple[int, np.ndarray]:
    return int.from_bytes(sketch[:8], "little"), np.frombuffer(sketch, np.uint8, offset=8)


def may_link(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], s: Settings) -> bool:
    """Whether the sketches, folded to one size, differ in no more bits than linked sets may."""
    (n, x), (m, y) = sorted((a, b), key=lambda z: len(z[1]))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 100 * min(n, m) >= s.percent * max(n, m) and int(np.bitwise_count(x ^ y).sum()) <= s.differ(n + m)


def may_link_all(sketches: list[tuple[int, np.ndarray]], s: Settings) -> np.ndarray:
    """may_link of all pairs: sketches of one size by a product, and of the next size folded to it."""
    sizes = np.array([len(x) for _, x in sketches])
    n = np.array([k for k, _ in sketches])
    may = np.zeros((len(sketches), len(sketches)), bool)
    for size in np.unique(sizes).tolist():
        own, larger = np.flatnonzero(sizes == size), np.flatnonzero(sizes == 2 * size)
        x = np.stack([sketches[i][1] for i in own])
        for at, y in ((own, x), (larger, np.stack([sketches[i][1][:size] ^ sketches[i][1][size:] for i in larger]) if len(larger) else x[:0])):
            a, b = (np.unpackbits(z, axis=1).astype(np.float32) for z in (x, y))
            apart = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - 2 * (a @ b.T)
            both = n[own][:, None] + n[at][None, :]
            near = (apart <= both * (100 - s.percent) // (100 + s.percent)) & (100 * np.minimum(n[own][:, None], n[at][None, :]) >= s.percent * np.maximum(n[own][:, None], n[at][None, :]))
            may[np.ix_(own, at)] |= near
            may[np.ix_(at, own)] |= near.T
    return may


def _signed(docs: DataFrame, s: Settings) -> DataFrame:
    """id, n_shingles, set_key, keys, sketch."""
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_parts(batch, 1, PART_BYTES):
                sets = [shingle_set(t, s.shingle) for t in batch.column(1)[a:b].to_pylist()]
                made = [(len(x), xxhash.xxh3_128_digest(x.tobytes()), first_keys(x, s), short_sketch(x)) if len(x) else (0, None, None, None) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(c, f.type) for c, f in zip(zip(*made), list(schema)[1:]))], schema=schema)

    return docs.mapInArrow(run, "id long, n_shingles long, set_key binary, keys array<long>, sketch binary")


def _parts(texts: DataFrame, s: Settings) -> DataFrame:
    """id, n_shingles, band, differ, key, last: all parts of the sketches (id, body) that may be keys."""
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("band", pa.int32()), ("differ", pa.int32()), ("key", pa.int64()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = shingle_set(text.as_py(), s.shingle)
                for band, parts, differ in s.bands(len(tokens)) if len(tokens) else ():
                    keys, _ = sketch_parts(tokens, band, parts)
                    empty = empty_parts(tokens, band, parts, max(0, differ + 1 - len(keys)))
                    n, key = len(keys) + len(empty), np.concatenate([keys, empty]).astype(np.int64)
                    if differ:
                        yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), *(pa.array(np.full(n, x, t)) for x, t in ((len(tokens), np.int64), (band, np.int32), (differ, np.int32))), pa.array(key), pa.array(np.arange(n) >= len(keys))], schema=schema)

    return texts.mapInArrow(run, "id long, n_shingles long, band int, differ int, key long, last boolean")


def _rare_first(texts: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """key, id, n_shingles: the join keys of these documents by the frequency of parts among them."""
    parts = scratch.write(_parts(texts, s), "parts")
    often = scratch.write(parts.groupBy("key").agg(F.count("*").alias("df")), "often")
    counted = links.by_key(parts, often, "key", "df")
    place = F.row_number().over(Window.partitionBy("id", "n_shingles", "band").orderBy("last", "df", "key"))  # a document each
    return counted.withColumn("place", place).where("place <= differ + 1").select(F.col("key").alias("bucket"), "id", "n_shingles")


def _buckets(members: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, leader, id, n_shingles of buckets with several members; buckets with the same members are one. Rows
    go by their bucket once: most have none to meet and end there."""
    by = Window.partitionBy("bucket").orderBy("id")
    met = members.withColumns({"next": F.lead("id").over(by), "last": F.lag("id").over(by)})
    met = scratch.write(met.where("next is not null or last is not null").drop("next", "last"), "met")
    whole = Window.partitionBy("bucket")
    of_ids = [F.sum(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 32)).over(whole) for seed in range(3)]  # alike only for the same members
    same = F.xxhash64(F.count("*").over(whole), F.max("id").over(whole), *of_ids)
    named = met.withColumns({"same": same, "leader": F.min("id").over(whole), "largest": F.max("id").over(whole)}).where("leader < largest")
    return scratch.write(named.select(F.xxhash64("same", "leader").alias("bucket"), "leader", "id", "n_shingles").dropDuplicates(["bucket", "id"]), "buckets")


def _met(full: DataFrame, scratch: Scratch) -> DataFrame:
    own = full.groupBy("set_key").agg(F.min_by(F.struct("keys", "n_shingles"), "id").alias("own"), F.min("id").alias("id"))
    return _buckets(own.select("id", F.col("own.n_shingles").alias("n_shingles"), F.explode("own.keys").alias("bucket")), scratch)


def similar(df: DataFrame, id_col: str, text_col: str, settings: Settings = Settings()) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links)."""
    s, spark = settings, df.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    keyed = scratch.write(_signed(docs, s), "keyed")
    some = "n_shingles > 0 and id is not null"
    # Equal sets are one class; its smallest id stands for it.
    classes = scratch.write(keyed.where(some).groupBy("set_key").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    met = _met(keyed.where(some), scratch)
    signed = scratch.write(keyed.drop("keys"), "signed")
    del keyed
    scratch.drop(keep=("classes", "buckets", "signed"))  # the keys, and the shuffles that they went through
    full = signed.where(some)
    groups = _grouped(docs, full, classes, met, s, scratch)
    of_class = scratch.write(classes.join(groups, "id", "left").select("set_key", "copies", F.coalesce("component", "id").alias("component")), "of-class")
    del classes, met, groups
    scratch.drop(keep=("signed", "of-class"))  # the result needs no more than these
    found = links.by_key(full.select("id", "n_shingles", "set_key"), of_class, "set_key", "copies").select("id", "n_shingles", F.col("component").alias("component_id"))
    return found.unionByName(signed.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id")))


def _grouped(docs: DataFrame, full: DataFrame, classes: DataFrame, met: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """id, component of the ids that have links."""
    texts = scratch.write(links.restricted(docs, met.select("id")), "texts")
    sketches = scratch.write(links.restricted(full.select("id", F.col("sketch").alias("body")), met.select("id")).distinct(), "sketches")

    def load(text: str | None) -> np.ndarray:
        return shingle_set(text, s.shingle)

    def confirmed(pairs: DataFrame) -> DataFrame:
        near = links.paired(sketches, pairs, unpacked, lambda a, b: may_link(a, b, s), scratch)
        return links.paired(texts, near.toDF("a", "b"), load, lambda a, b: links.linked(a, b, s.percent), scratch)

    def whole(groups: DataFrame, members: DataFrame) -> DataFrame:
        left = links.promising(sketches, links.unsettled(members, groups, scratch), unpacked, lambda x: may_link_all(x, s), scratch)
        return links.joined(groups, links.across(texts, left, load, s.percent, scratch), scratch)

    groups, rest = links.by_leaders(met, links.bridges(full, classes), confirmed, scratch)
    if rest.isEmpty():
        return groups
    groups = whole(groups, rest.where(F.col("n") <= links.BLOCK).drop("n"))
    many = links.unsettled(rest.where(F.col("n") > links.BLOCK).drop("n"), groups, scratch).select("id").distinct()
    if many.isEmpty():
        return groups
    met = _buckets(_rare_first(links.restricted(texts, many), s, scratch), scratch)
    groups, rest = links.by_leaders(met, groups.select(F.col("component").alias("u"), F.col("id").alias("v")), confirmed, scratch)
    return groups if rest.isEmpty() else whole(groups, rest.drop("n"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles, links from 80 in 100: doc_id, n_shingles, component_id."""
    return similar(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
