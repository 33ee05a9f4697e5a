"""Links between documents that share buckets, found on their full shingle sets, and the groups that they form.

A bucket does not emit all its pairs. First every member is compared with the bucket's leader
(smallest id), and the links found are grouped. In buckets that still hold several groups, another
leader (smallest hash) tries again. What is then still apart is compared exactly: the members of the
bucket's largest group are dealt to blocks, and so are all others; blocks of the others meet each other
and those of the largest group, and a product of the membership matrix of two blocks gives every
intersection. So a large group of copies costs a comparison or two a copy, and no link between
members of one bucket is lost.

Grouping: tasks reduce a bounded number of links each by union-find, and alternating large-star and
small-star steps shrink what is left, until all links form stars. No link or group passes the driver.

No task gets a hot key: the HOT largest buckets are sent to their rows, so that these need not meet by
key; all other rows do. Blocks are cut by members and by the size of their sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.words import gram_hashes, hash_words, split_words, text_parts
from scriptorium.session import Scratch

#: Members of a bucket's largest group, and of the others, that are compared at once, and shingles.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Keys that are sent to their rows, the most frequent ones.
HOT = 1_000
#: Ids that are sent to all documents.
SENT_IDS = 500_000
#: Links that one task reduces by union-find.
FOREST_LINKS = 50_000
#: Members that one salted task compares with one leader.
SALT_ROWS = 500
PART_BYTES = 2_000_000


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    words = split_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hash_words(words), min(size, len(words))) + np.uint64(min(size, len(words))))


def by_key(rows: DataFrame, facts: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `facts`, one row a key, by key; `n` of facts is how many rows have the key. The
    HOT most frequent keys are sent to the rows; the others, none of which has more than a HOT-th of
    the rows, meet by key."""
    first = facts.orderBy(F.desc(n), key).limit(HOT)
    hot, cold = F.broadcast(first), facts.join(F.broadcast(first.select(key)), key, "left_anti")  # HOT rows
    rest = rows.join(F.broadcast(first.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key, how))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _few(bodies: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """`bodies` (id, body) with one of the n ids, if these are SENT_IDS at most, and else all of them: what a join by id
    has no use for need not be shuffled."""
    return bodies.join(F.broadcast(ids), "id", "left_semi") if n <= SENT_IDS else bodies


def paired(bodies: DataFrame, pairs: DataFrame, load: Callable[[Any], Any], agree: Callable[[Any, Any], bool], scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that agree by their bodies (id, body; loaded): u, v. A pair's bodies meet in a task
    by a and a salt; the salts of an `a` grow with its pairs, and a task streams with one set of an
    `a` in memory."""
    pairs = scratch.write(pairs, "pairs")
    n = pairs.count()
    if not n:
        return pairs.toDF("u", "v")
    bodies = _few(bodies, pairs.select(F.explode(F.array("a", "b")).alias("id")), 2 * n)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
    where = pairs.join(salts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.lit(1).alias("kind"))
    where = where.unionByName(salts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind")))
    rows = bodies.join(where.hint("merge"), "id").select("a", "salt", "kind", "id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bases = None, []
        for batch in batches:
            for x, y in text_parts(batch, 4, PART_BYTES):
                u, v = [], []
                part = batch.slice(x, y - x)
                for a, kind, i, body in zip(*(part.column(c).to_pylist() for c in ("a", "kind", "id", "body"))):
                    own = load(body)
                    if kind == 0:
                        of, bases = a, [*bases, own] if of == a else [own]
                    elif of == a and any(agree(base, own) for base in bases):
                        u.append(a)
                        v.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return scratch.write(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind").mapInArrow(run, "u long, v long"), "links")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task, in bounded portions: one link a node to its root, the smallest of its tree."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def stars() -> pa.RecordBatch:
        nodes = [x for x in root if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > 2 * FOREST_LINKS:
            yield stars()
            root.clear()
    yield stars()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component for every id in links (u, v): the smallest id reachable.

    Each round reduces FOREST_LINKS links a task by union-find, which ends it if these were all, and
    alternates large-star (link larger neighbours to the smallest one) and small-star (link
    smaller neighbours and the node itself to it) until all links form stars."""
    edges = scratch.write(links.select("u", "v").where("u <> v"), "edges")
    while True:
        tasks = max(1, -(-edges.count() // FOREST_LINKS))
        edges = scratch.write(edges.coalesce(tasks).mapInArrow(_forest, "u long, v long").distinct(), "forest")
        if tasks == 1 or _stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = scratch.write(small.where("u <> v").distinct(), "small")
    edges = edges.coalesce(tasks)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one link, to a node without one; links go from larger to smaller."""
    ends = edges.groupBy("u").agg(F.count("*").alias("n"))
    if not ends.where("n > 1").isEmpty():
        return False
    return edges.join(ends.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _crossing(sets: list[np.ndarray], group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different groups that connect groups not yet connected, exactly:
    the product of the membership matrix with itself holds every intersection."""
    sizes = np.array([len(x) for x in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)
    place = np.full(len(often), -1)
    place[shared] = np.arange(len(shared))
    column, row = place[column], np.repeat(np.arange(len(sets)), sizes)
    both = np.zeros((len(sets), len(sets)))
    for lo in range(0, len(shared), 8192):
        at = (column >= lo) & (column < lo + 8192)
        m = np.zeros((len(sets), min(8192, len(shared) - lo)), np.float32)
        m[row[at], column[at] - lo] = 1
        both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    a, b = np.nonzero(np.triu(100 * both >= percent * union, 1) & (group[:, None] != group[None, :]))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(group[i]), find(group[j])
        if x != y:
            root[x] = y
            out.append((i, j))
    return out


def _in_blocks(bodies: DataFrame, members: DataFrame, load: Callable[[Any], Any], found: Callable[[int, list[int], list[int], list], pa.RecordBatch], names: str, scratch: Scratch) -> DataFrame:
    """What `found` makes of bucket, ids, groups and loaded bodies (id, body) of each two blocks of members (bucket, id,
    n_shingles, component) of one bucket that meet."""
    bodies = _few(bodies, members.select("id"), members.count())
    groups = members.groupBy("bucket", "component").agg(F.struct(F.count("*").alias("n"), F.sum("n_shingles").alias("w"), "component").alias("x"))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    sizes = groups.groupBy("bucket").agg(F.max("x").alias("x"), F.sum("x.n").alias("all"), F.sum("x.w").alias("w"))
    sizes = scratch.write(sizes.select("bucket", F.col("x.component").alias("main"), "all", blocks(F.col("x.n"), F.col("x.w")).alias("m"), blocks(F.col("all") - F.col("x.n"), F.col("w") - F.col("x.w")).alias("s")), "sizes")
    # Members of the main group meet each block of the others; the others also meet each other.
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    as_main = F.transform(upto(F.col("s")), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("x"), own(F.col("m")).alias("y")))
    as_other = F.concat(
        F.transform(upto(F.col("m")), lambda j: F.struct(F.lit(0).alias("kind"), own(F.col("s")).alias("x"), j.alias("y"))),
        F.transform(upto(F.col("s")), lambda k: F.struct(F.lit(1).alias("kind"), F.least(own(F.col("s")), k).alias("x"), F.greatest(own(F.col("s")), k).alias("y"))),
    )
    placed = by_key(members, sizes, "bucket", "all").select("bucket", "id", "component", F.explode(F.when(F.col("component") == F.col("main"), as_main).otherwise(as_other)).alias("block"))
    rows = bodies.join(placed.hint("merge"), "id").select("bucket", "block", "id", "component", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, groups, loaded = None, [], [], []
        for batch in batches:
            for x, y in text_parts(batch, 4, PART_BYTES):
                part = batch.slice(x, y - x)
                for bucket, block, i, group, body in zip(*(part.column(c).to_pylist() for c in range(5))):
                    if (bucket, block) != of:
                        if len(set(groups)) > 1:
                            yield found(of[0], ids, groups, loaded)
                        of, ids, groups, loaded = (bucket, block), [], [], []
                    ids.append(i)
                    groups.append(group)
                    loaded.append(load(body))
        if len(set(groups)) > 1:
            yield found(of[0], ids, groups, loaded)

    return scratch.write(rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(run, names), "crossing")


def across(bodies: DataFrame, members: DataFrame, load: Callable[[Any], np.ndarray], percent: int, scratch: Scratch) -> DataFrame:
    """Links u, v between members (bucket, id, n_shingles, component) of one bucket in different groups. Bodies
    (id, body) are loaded as sets."""

    def found(_: int, ids: list[int], groups: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        own = _crossing(sets, np.array(groups), percent)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in own], pa.int64()), pa.array([ids[j] for _, j in own], pa.int64())], names=["u", "v"])

    return _in_blocks(bodies, members, load, found, "u long, v long", scratch)


def promising(bodies: DataFrame, members: DataFrame, load: Callable[[Any], Any], may: Callable[[list], np.ndarray], scratch: Scratch) -> DataFrame:
    """The members (bucket, id, n_shingles, component) that may be linked to one of another group in their
    bucket, as `may` tells of all pairs of a list of loaded bodies."""

    def found(bucket: int, ids: list[int], groups: list[int], loaded: list) -> pa.RecordBatch:
        group = np.array(groups)
        own = np.array(ids, np.int64)[(may(loaded) & (group[:, None] != group[None, :])).any(axis=1)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), bucket, np.int64)), pa.array(own)], names=["bucket", "id"])

    kept = _in_blocks(bodies, members, load, found, "bucket long, id long", scratch)
    return scratch.write(members.join(kept.distinct(), ["bucket", "id"], "left_semi"), "promising")


def restricted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`docs` (id, ...) with one of the ids: these go to the documents if they are SENT_IDS at most, and else
    both meet by id."""
    found = ids.distinct()
    few = found.limit(SENT_IDS + 1).count() <= SENT_IDS
    return docs.join(F.broadcast(found) if few else found.hint("merge"), "id", "left_semi")


def unsettled(members: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, id, n_shingles, component, n (members of the bucket) of the members of buckets that hold several groups."""
    grouped = scratch.write(members.join(groups, "id", "left").select("bucket", "id", "n_shingles", F.coalesce("component", "id").alias("component")), "grouped")
    mixed = grouped.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("bucket", "n")
    return scratch.write(by_key(grouped, scratch.write(mixed, "mixed"), "bucket", "n"), "unsettled")


def joined(groups: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The groups (id, component) with more links (u, v)."""
    if links.isEmpty():
        return groups
    return components(links.unionByName(groups.select(F.col("component").alias("u"), F.col("id").alias("v"))), scratch)


def bridges(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links u, v between an id with several sets and the ids of these sets' classes."""
    several = full.groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("id")
    own = full.join(several, "id", "left_semi").select(F.col("id").alias("u"), "set_key").distinct()
    return own.join(classes.select("set_key", F.col("id").alias("v")), "set_key").select("u", "v")


def by_leaders(met: DataFrame, known: DataFrame, confirmed: Callable[[DataFrame], DataFrame], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Groups by the links `known` (u, v) and by those of bucket members (bucket, leader, id, n_shingles) with
    the leader, then with a second one where several groups are left; and the members of buckets (bucket, id,
    n_shingles, n) that a second leader had to be tried on. `confirmed` finds the links among pairs a, b."""
    stars = met.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    groups = components(confirmed(stars).unionByName(known), scratch)
    rest = unsettled(met.select("bucket", "id", "n_shingles"), groups, scratch)
    if rest.isEmpty():
        return groups, rest.drop("component")
    others = rest.groupBy("bucket").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id")).alias("x"), F.count("*").alias("of_n")).select("bucket", "of_n", F.col("x.id").alias("a"), F.col("x.component").alias("of"))
    again = by_key(rest, scratch.write(others, "others"), "bucket", "of_n").where("component <> of").select("a", F.col("id").alias("b")).distinct()
    return joined(groups, confirmed(again), scratch), rest.drop("component")
