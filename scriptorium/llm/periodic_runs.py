"""Periodic runs of words: suffix classes united by decreasing LCP, newly adjacent positions seed runs.

The suffixes of a text (in words) are sorted; neighbours in that order with their longest common
prefix (LCP) are edges. Edges are taken by falling LCP, as in Kruskal's algorithm, and unite classes of
suffixes by union-find; a class keeps its positions in order, and the smaller class is dealt into the
larger one. When position i becomes the neighbour of i + d in a class united at LCP l, and d is within
l, the words from i on have period d for d + l words. If the word before breaks the period, this is a whole
run, and its period is the smallest: a smaller period would put a position between the two into
the class at a larger LCP. For the same reason a run of at least twice its period is found: its
first position and the one a period later have LCP = length - period, and are neighbours in the
class when that LCP's turn comes. So each run is seeded once, at its first word.

Sorting is prefix doubling over the texts of a task's part at once; equal blocks of words are told apart by
text, so only what repeats within a text goes on. LCPs are taken for positions whose next BLOCK words
repeat, as no run has less. All else of a text costs one sort and nothing more.

Texts are independent: no shuffle, and a task holds a part of PART_BYTES of texts, or one longer text.

Defined results: null, empty and blank texts have no word and no run. Equal rows, rows of one id
and rows without an id have results each. Of two runs with one start the smaller period comes first.
A very long text is searched whole. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.words import split_words, text_parts
from scriptorium.session import ship, table

PART_BYTES = 1_500_000
#: Words that must repeat before an LCP is taken; a power of two, not above the smallest LCP of a run.
BLOCK = 4
#: (start, length, period)
Run = tuple[int, int, int]


@dataclass(frozen=True)
class Settings:
    """A run has at least `words` words and `times` (2 or more) times its period."""

    words: int = 6
    times: int = 4

    @property
    def least_lcp(self) -> int:
        return max(BLOCK, min(max(self.words - p, (self.times - 1) * p) for p in range(1, self.words + 1)))

    def holds(self, length: int, period: int) -> bool:
        return length >= max(self.words, self.times * period)


class Positions:
    """A set of positions in order, in pieces of 2^SHIFT places."""

    SHIFT = 10
    __slots__ = ("size", "keys", "pieces")

    def __init__(self, i: int) -> None:
        self.size, self.keys, self.pieces = 1, [i >> self.SHIFT], {i >> self.SHIFT: [i]}

    def __iter__(self) -> Iterator[int]:
        for k in self.keys:
            yield from self.pieces[k]

    def add(self, i: int) -> tuple[int, int]:
        """Adds i; the positions before and after it, or -1."""
        self.size += 1
        k = i >> self.SHIFT
        own = self.pieces.get(k)
        if own is None:
            own = self.pieces[k] = [i]
            insort(self.keys, k)
            at = 0
        else:
            at = bisect_left(own, i)
            own.insert(at, i)
        if 0 < at < len(own) - 1:
            return own[at - 1], own[at + 1]
        place = bisect_left(self.keys, k)
        before = own[at - 1] if at else self.pieces[self.keys[place - 1]][-1] if place else -1
        after = own[at + 1] if at + 1 < len(own) else self.pieces[self.keys[place + 1]][0] if place + 1 < len(self.keys) else -1
        return before, after


def repeated(words: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours a, b in the order of suffixes whose first BLOCK words agree. `words`: a number for
    each word, another one in each text; `end`: where the text of each position ends."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].reshape(-1)
    live = np.flatnonzero(np.bincount(rank)[rank] > 1)
    # the rank of a position is the place of the first of its equals
    first = np.concatenate([[0], np.cumsum(np.bincount(rank))])
    rank = first[rank]
    step, kept = 1, None
    while True:
        if step == BLOCK:
            kept = live.copy()
            block = rank[kept]
        if not len(live):
            break
        then = np.where(live + step < end[live], rank[np.minimum(live + step, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + then
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        group = key // (n + 1)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        inside = np.arange(len(live)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(live)]])))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))
        rank[live] = group + inside[lead]
        alone = new & np.concatenate([new[1:], [True]])
        live = live[~alone]
        step *= 2
    if kept is None or not len(kept):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(rank[kept], kind="stable")
    kept, block = kept[order], block[order]
    same = block[1:] == block[:-1]
    return kept[:-1][same], kept[1:][same]


def lcps(words: list[int], end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The LCP of each a with its b, from left to right: the next one is at most one word shorter."""
    out = np.zeros(len(b), np.int64)
    last, l = -2, 0
    order = np.argsort(b, kind="stable")
    for at, i, j, e in zip(order.tolist(), b[order].tolist(), a[order].tolist(), end[b[order]].tolist()):
        l = max(l - 1, BLOCK) if i == last + 1 else BLOCK
        last, most = i, e - max(i, j)
        while l < most and words[i + l] == words[j + l]:
            l += 1
        out[at] = l
    return out


def runs_of(texts: list[list[bytes]], settings: Settings = Settings()) -> list[list[Run]]:
    """The runs of each text, by start and then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    found: list[list[Run]] = [[] for _ in texts]
    names: defaultdict[bytes, int] = defaultdict()
    names.default_factory = names.__len__  # the next number
    words = [*map(names.__getitem__, chain.from_iterable(texts))]
    if not words:
        return found
    first = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    a, b = repeated(text * len(names) + np.array(words, np.int64), end)
    lcp = lcps(words, end, a, b)
    enough = lcp >= settings.least_lcp
    a, b, lcp = a[enough], b[enough], lcp[enough]
    order = np.lexsort((-lcp, text[a]))
    root: dict[int, int] = {}
    classes: dict[int, Positions] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    of, n = -1, len(words)
    for i, j, l, t in zip(a[order].tolist(), b[order].tolist(), lcp[order].tolist(), text[a[order]].tolist()):
        if t != of:
            of = t
            root.clear()
            classes.clear()
            base, out = int(first[t]), found[t]
        x, y = find(i), find(j)
        small, large = classes.pop(x, None) or Positions(x), classes.pop(y, None) or Positions(y)
        if small.size > large.size:
            small, large, x, y = large, small, y, x
        root[x] = y
        classes[y] = large
        moved = list(small)
        for last, p, then in zip([-1, *moved], moved, [*moved[1:], n]):
            before, after = large.add(p)
            # newly adjacent: not to a position of the smaller class, and none of it comes in between
            for u, v in ((before, p) if before != last else (-1, p), (p, after if after < then else -1)):
                d = v - u
                if u >= 0 and v >= 0 and d <= l and settings.holds(d + l, d) and (u == base or words[u - 1] != words[v - 1]):
                    out.append((u - base, d + l, d))
    for out in found:
        out.sort(key=lambda r: (r[0], r[2]))
    return found


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words a run holds after its first period."""
    edge = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


Finish = Callable[[list[bytes], list[Run]], tuple]
Prepare = Callable[[int | None, list[bytes]], list[bytes]]
_TYPES = {"long": pa.int64(), "string": pa.string(), "array<struct<start:bigint,length:bigint,period:bigint>>": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))}


def by_text(df: DataFrame, id_col: str, text_col: str, finish: Finish, names: str, prepare: Prepare | None = None, settings: Settings = Settings()) -> DataFrame:
    """id and what `finish` makes of the words and runs of each text, in the columns `names`. `prepare`
    makes other words of an id and its words first."""
    ship(df.sparkSession)
    made = [x.split(" ", 1) for x in names.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in text_parts(batch, 1, PART_BYTES):
                ids = batch.column(0)[x:y]
                texts = [split_words(t) for t in batch.column(1)[x:y].to_pylist()]
                if prepare:
                    texts = [prepare(i, w) for i, w in zip(ids.to_pylist(), texts)]
                columns = zip(*(finish(w, r) for w, r in zip(texts, runs_of(texts, settings))))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, made))], names=["id", *(n for n, _ in made)])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id long, {names}")


def periodic_runs(df: DataFrame, id_col: str, text_col: str, settings: Settings = Settings()) -> DataFrame:
    """id, start, length, period: a row for each run of each text, in words from 0."""
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    finish = lambda words, runs: ([{"start": s, "length": n, "period": p} for s, n, p in runs],)
    return by_text(df, id_col, text_col, finish, f"runs {kind}", settings=settings).select("id", F.inline("runs"))


def collapsed_texts(df: DataFrame, id_col: str, text_col: str, settings: Settings = Settings()) -> DataFrame:
    """id, text, n_dropped: of each run the first period is left; words are joined by one space. Texts
    without words are empty."""

    def finish(words: list[bytes], runs: list[Run]) -> tuple:
        gone = dropped(len(words), runs)
        return b" ".join(w for w, g in zip(words, gone) if not g).decode("utf-8", "surrogatepass"), int(gone.sum())

    return by_text(df, id_col, text_col, finish, "text string, n_dropped long", settings=settings)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten repeats itself from a place on, as the query's contract has it."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + period]
    return words[:a] + (again * (-(-(n - a) // len(again))))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256 and
    collapsed_sha256 of every whole text of documents; rows without an id are not planted."""

    def finish(words: list[bytes], runs: list[Run]) -> tuple:
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        kept = words
        if runs:
            gone = dropped(len(words), runs)
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        return len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()

    names = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return by_text(table(spark, sf_dir, "documents"), "doc_id", "text", finish, names, planted).withColumnRenamed("id", "doc_id")
