"""Exact and near duplicates within a group, first in order kept."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.session import Scratch, collect_garbage, ship

THRESHOLD = 0.88
#: Bounds of later length to earlier length of near rows.
LENGTHS = (0.6, 1.67)
#: Slots of token hashes whose frequency is kept.
SLOTS = 1 << 20
#: Rows of a token and band that a task compares with all others of these.
SALT_ROWS = 2_000
#: Rows that share a token, on average over rows, above which rows are first compared with the first ones only; rounds of that.
DENSE, ROUNDS = 50, 8


def _match(df: DataFrame, other: DataFrame, names: list[str], how: str) -> DataFrame:
    """`df` joined on `names` with nulls equal, as in a window partition."""
    right = {n: f"_of_{n}" for n in names}
    on = reduce(and_, (F.col(n).eqNullSafe(F.col(r)) for n, r in right.items()))
    return df.join(other.withColumnsRenamed(right), on, how).drop(*right.values())


def exact_duplicates(df: DataFrame, group: str, order: str, text_col: str) -> DataFrame:
    """Adds `duplicate`: an equal text (identity form) comes earlier in the group.

    The first is found by an aggregate, so a text with many copies is no window partition.
    A null group is a group, and null texts are equal."""
    keyed = df.withColumn("_key", F.sha2(tx.normalize(F.col(text_col)), 256))
    first = keyed.groupBy(group, "_key").agg(F.min(order).alias("_first"))
    return _match(keyed, first, [group, "_key"], "inner").withColumn("duplicate", F.col(order) > F.col("_first")).drop("_key", "_first")


def _items(df: DataFrame, group: str, order: str, text_col: str, scratch: Scratch) -> DataFrame:
    """g, o, len, n, w, class: the tokens of each row as 64-bit hashes, rarest first, and a digest of its
    group, tokens and length.

    How frequent tokens are is kept for SLOTS slots of hashes, which all workers get: a fixed size, whatever the
    vocabulary. Any order that is one for all rows gives exact results."""
    ship(df.sparkSession)
    tokens = F.transform(F.array_distinct(tx.dedup_tokens(F.col(text_col))), lambda t: F.xxhash64(t))
    rows = scratch.write(df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.length(tx.normalize(F.col(text_col))).alias("len"), tokens.alias("w")).where("size(w) > 0"), "items")
    slot = F.pmod(F.col("token"), F.lit(SLOTS)).cast("int")
    counts = rows.select(F.explode("w").alias("token")).groupBy(slot.alias("slot")).agg(F.ceil(4 * F.log2(F.count("*"))).cast("int").alias("level")).toArrow()  # SLOTS rows at most
    level = np.zeros(SLOTS, np.uint8)
    level[counts["slot"].to_numpy()] = counts["level"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("w")
            values, size = w.flatten().to_numpy(), w.value_lengths().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            values = values[np.lexsort((values, level[values % SLOTS], row))]
            cut = np.concatenate([[0], np.cumsum(size)])
            of = [hashlib.blake2b(values[x:y].tobytes(), digest_size=16).digest() for x, y in zip(cut[:-1], cut[1:])]
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int32()), lists, pa.array(of, pa.binary())], names=["g", "o", "len", "n", "w", "set"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("g", "o", "len"))
    ranked = scratch.write(rows.mapInArrow(run, f"{kinds}, n int, w array<long>, set binary"), "ranked")
    scratch.drop_named("items")
    return ranked


def _classes(items: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The first row of those with one group, token set and length, and (g, a, b) for each other row b of the class of a.
    `items` are deleted."""
    firsts = items.groupBy("g", "set", "len").agg(F.min("o").alias("first"))
    of = scratch.write(_match(items.select("g", "o", "set", "len"), firsts, ["g", "set", "len"], "inner").select("g", "o", "first"), "classes")
    kept = scratch.write(_match(items, of.where("o = first").select("g", "o"), ["g", "o"], "left_semi").drop("set"), "firsts")
    scratch.drop_named("ranked")
    return kept, of.where("o <> first").select("g", F.col("first").alias("a"), F.col("o").alias("b"))


def _prefixes(items: DataFrame, threshold: float) -> DataFrame:
    """bucket, at (place in the order of tokens), g, o, len, n: of each row the tokens of which a near row has one, too."""
    length = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    exploded = items.select("g", "o", "len", "n", F.posexplode(F.slice("w", F.lit(1), length)).alias("at", "token"))
    return exploded.select(F.xxhash64(F.struct("g", "token")).alias("bucket"), "at", "g", "o", "len", "n")


def _candidates(prefixes: DataFrame, threshold: float) -> DataFrame:
    """g, a, b that share a token of their prefixes and may be near by size, length and place of the token.

    Rows meet by token and band of size (neighbouring bands hold all partners), the larger row in its
    own band and the one below; tokens of many rows are salted."""
    band = F.floor(F.log("n") / (-1.001 * math.log(threshold))).cast("int")
    rows = prefixes.withColumn("band", band)
    sizes = rows.groupBy("bucket", "band").agg(F.count("*").alias("rows"))
    both = sizes.unionByName(sizes.select("bucket", (F.col("band") - 1).alias("band"), "rows"))
    both = both.groupBy("bucket", "band").agg(F.ceil(F.sum("rows") / SALT_ROWS).cast("int").alias("salts"), F.sum("rows").alias("rows")).where("rows > 1").drop("rows")
    left = rows.join(both, ["bucket", "band"]).withColumn("salt", F.pmod(F.xxhash64("o"), F.col("salts")).cast("int"))
    right = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).join(both, ["bucket", "band"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    l, r = left.alias("l"), right.alias("r")
    met = l.join(r, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.salt") == F.col("r.salt")))
    smaller = (F.col("l.n") < F.col("r.n")) | (F.col("l.n") == F.col("r.n")) & (F.col("l.o") < F.col("r.o"))
    most = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at"))  # common tokens, if this is the first one
    need = threshold / (1 + threshold) * (F.col("l.n") + F.col("r.n")) - 1e-6
    first_l = F.col("l.o") < F.col("r.o")
    lengths = F.when(first_l, F.col("r.len") / F.col("l.len")).otherwise(F.col("l.len") / F.col("r.len"))
    met = met.where(smaller & (F.col("l.n") >= threshold * F.col("r.n") - 1e-9) & (most >= need) & lengths.between(*LENGTHS) & F.col("l.g").eqNullSafe(F.col("r.g")))
    return met.select(F.col("l.g").alias("g"), F.least("l.o", "r.o").alias("a"), F.greatest("l.o", "r.o").alias("b")).distinct()


def _near(prefixes: DataFrame, items: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs g, a, b of rows with these prefixes that are near. Those that met are written first: their shuffles are gone
    before tokens are sent to them."""
    met = scratch.write(_candidates(prefixes, threshold), "candidates")
    collect_garbage(scratch.spark)
    near = scratch.write(_verified(met, items, threshold), "near")
    scratch.drop_named("candidates", "prefixes")
    return near


def _verified(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The pairs g, a, b (a before b) that are near."""
    for x in ("a", "b"):
        own = items.select(F.col("g").alias("_g"), F.col("o").alias("_o"), F.col("w").alias(f"w{x}"), F.col("len").alias(f"len{x}"))
        pairs = pairs.join(own, F.col("g").eqNullSafe(F.col("_g")) & (F.col(x) == F.col("_o"))).drop("_g", "_o")
    inter = F.size(F.array_intersect("wa", "wb"))
    near = (F.col("lenb") / F.col("lena")).between(*LENGTHS) & (inter >= threshold * (F.size("wa") + F.size("wb") - inter) - 1e-9)
    return pairs.where(near).select("g", "a", "b")


def near_pairs(df: DataFrame, group: str, order: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """group, a, b: earlier and later rows whose token sets have Jaccard >= threshold and whose
    normal forms have similar lengths.

    Rows of one group, token set and length are a class: its first row stands for it in all pairs, and
    each other one has one pair, with the first, so a clique of copies is a star. Exact: tokens of
    prefixes meet, rarest first, with filters by size and by place."""
    scratch = Scratch(df.sparkSession)
    firsts, members = _classes(_items(df, group, order, text_col, scratch), scratch)
    pairs = _near(scratch.write(_prefixes(firsts, threshold), "prefixes"), firsts, threshold, scratch)
    scratch.drop_named("firsts")
    return pairs.unionByName(members).withColumnRenamed("g", group)


def near_drops(df: DataFrame, group: str, order: str, text_col: str, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """group, dropped: the rows that are near an earlier *kept* row of their group, rows taken in order.

    Other rows of a class fall with or to its first. While tokens are shared by many rows, rows that come first for
    all their tokens are kept, and only they are compared with those they meet; what falls to them
    meets nobody any more, so a group of near copies costs a comparison a row and not one a
    pair. Of what is left all pairs are found and resolved in rounds. What a step wrote is deleted once the next one
    is written."""
    scratch = scratch or Scratch(df.sparkSession)
    firsts, members = _classes(_items(df, group, order, text_col, scratch), scratch)
    left = scratch.write(_prefixes(firsts, threshold), "prefixes")
    dropped = members.select("g", F.col("b").alias("dropped"))
    for k in range(ROUNDS):
        sizes = scratch.write(left.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("o").alias("first")).where("rows > 1"), "sizes")
        load = sizes.agg(F.sum(F.col("rows").cast("double") * F.col("rows")).alias("pairs"), F.sum("rows").alias("rows")).first()
        if not load.rows or load.pairs <= DENSE * load.rows:
            break
        met = scratch.write(left.join(sizes.drop("rows"), "bucket"), "met")
        scratch.drop_named("prefixes", "sizes", f"left{k - 1}")
        kept = scratch.write(met.groupBy("g", "o").agg(F.bool_and(F.col("o") == F.col("first")).alias("kept")).where("kept").drop("kept"), "kept")
        stars = _match(met.where("o <> first").select("g", F.col("first").alias("o"), F.col("o").alias("b")).distinct(), kept, ["g", "o"], "left_semi")
        fallen = scratch.write(_verified(stars.withColumnRenamed("o", "a"), firsts, threshold).select("g", F.col("b").alias("dropped")).distinct(), "fallen")
        dropped = dropped.unionByName(fallen)
        gone = kept.unionByName(fallen.withColumnRenamed("dropped", "o"))
        left = scratch.write(_match(met.drop("first"), gone, ["g", "o"], "left_anti"), f"left{k}")
        scratch.drop_named("met", "kept")
    rest = greedy_drops(_near(left, firsts, threshold, scratch), "g", scratch)
    scratch.drop_named("firsts", "sizes", "near", *[f"left{k}" for k in range(ROUNDS)])
    return dropped.unionByName(rest).withColumnRenamed("g", group)


def greedy_drops(pairs: DataFrame, group: str, scratch: Scratch | None = None) -> DataFrame:
    """group, dropped: what is dropped when rows are taken in order and a row falls to an
    earlier *kept* neighbour. Rounds: rows without an earlier neighbour are kept, their
    later neighbours fall and take their pairs along, until no pair is left."""
    scratch = scratch or Scratch(pairs.sparkSession)
    pairs, k = scratch.write(pairs, "pairs0"), 0
    dropped = scratch.spark.createDataFrame([], pairs.select(group, F.col("b").alias("dropped")).schema)
    while not pairs.isEmpty():
        later = pairs.select(group, F.col("b").alias("a")).distinct()
        kept = _match(pairs.select(group, "a").distinct(), later, [group, "a"], "left_anti")
        gone = scratch.write(_match(pairs, kept, [group, "a"], "left_semi").select(group, F.col("b").alias("dropped")).distinct(), "dropped")
        dropped = dropped.unionByName(gone)
        for x in ("a", "b"):
            pairs = _match(pairs, gone.select(group, F.col("dropped").alias(x)), [group, x], "left_anti")
        pairs, k = scratch.write(pairs.select(group, "a", "b"), f"pairs{k + 1}"), k + 1
        scratch.drop_named(f"pairs{k - 1}")
    return dropped


def dedup(df: DataFrame, group: str, order: str, text_col: str, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """Adds `verdict`: kept, exact (a copy) or near (close to an earlier kept row).

    Which rows are copies is written once: it is read for the near ones and for the verdicts, and normal forms are long work.
    What the result is made from lies in `scratch`, if there is one, until that is dropped. `df` is not read any more; if it
    was written there by the name "given", it is deleted."""
    scratch = scratch or Scratch(df.sparkSession)
    marked = scratch.write(exact_duplicates(df, group, order, text_col), "marked")
    scratch.drop_named("given")
    drops = near_drops(marked.where("not duplicate"), group, order, text_col, threshold, scratch).withColumnRenamed("dropped", order).withColumn("_near", F.lit(True))
    return _match(marked, drops, [group, order], "left").withColumn("verdict", F.when(F.col("duplicate"), "exact").when(F.col("_near"), "near").otherwise("kept")).drop("duplicate", "_near")
