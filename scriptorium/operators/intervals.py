"""Silence and speech intervals of recordings, packed into clips."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import materialise, ship

GAP, INSIDE, LEAST, MOST, PAD = 0.05, 0.5, 3.0, 15.0, 0.15
#: Seconds of a recording that a task packs at once.
BUCKET = 600.0


def parse_silences(log: DataFrame, key: str, line: str, text: str) -> DataFrame:
    """key, start, end: a start line and the next end line; an end without a start is skipped."""
    number = lambda word: F.nullif(F.regexp_extract(text, f"silence_{word}:\\s*([0-9.]+)", 1), F.lit("")).cast("double")
    rows = log.select(key, line, number("start").alias("s"), number("end").alias("e")).where("s is not null or e is not null")
    before = F.lag("s").over(Window.partitionBy(key).orderBy(line))
    return rows.withColumn("start", before).where("e is not null and start is not null").select(key, "start", F.col("e").alias("end"))


def _gaps(silences: DataFrame, by: list[str], begin: Column, end: Column) -> DataFrame:
    """by, start, end: what lies from `begin` to `end` outside the silences of each group, by the
    running end of the silences before; gaps up to 0.05 s don't count. Both ends are the same in a group."""
    before = F.max("end").over(Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    inner = silences.select(*by, F.greatest(begin, F.coalesce(before, begin)).alias("from"), F.col("start").alias("to"))
    tail = silences.groupBy(*by).agg(F.max("end").alias("from"), F.max(end).alias("to"))
    return inner.unionByName(tail).where(F.col("to") > F.col("from") + GAP).select(*by, F.col("from").alias("start"), F.col("to").alias("end"))


def speech_spans(silences: DataFrame, key: str, total: float) -> DataFrame:
    """key, start, end: what is not silent in [0, total]; gaps up to 0.05 s don't count."""
    return _gaps(silences, [key], F.lit(0.0), F.lit(total))


def refine_spans(spans: DataFrame, finer: DataFrame, key: str, levels: list[int]) -> DataFrame:
    """key, start, end: spans that are too long, cut at silences (key, level, start, end) that lie
    half a second inside. Each level in turn cuts what is still too long; a span without such
    a silence goes on to the next level."""
    inside = (F.col("start") > F.col("_start") + INSIDE) & (F.col("end") < F.col("_end") - INSIDE)
    for level in levels:
        long = F.col("end") - F.col("start") > MOST
        whole = spans.where(long).select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"))
        own = finer.where(F.col("level") == level).select(key, "start", "end")
        cuts = materialise(own.join(whole, (F.col(key) == F.col("_key")) & inside).drop("_key"), "cuts")
        made = _gaps(cuts, [key, "_start", "_end"], F.col("_start"), F.col("_end"))
        done = cuts.select(F.col(key).alias("_key"), "_start").distinct()
        left = spans.join(done, (F.col(key) == F.col("_key")) & (F.col("start") == F.col("_start")), "left_anti")
        spans = materialise(left.unionByName(made.select(key, "start", "end")), "spans")
    return spans


def _jumps(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each span in order, the span that begins the next clip if it begins one."""
    n = len(start)
    after = np.searchsorted(end, start + MOST, "right")
    after -= (after > 0) & (end[np.maximum(after, 1) - 1] - start > MOST)  # the sum may round, the difference decides
    after += (after < n) & (end[np.minimum(after, n - 1)] - start <= MOST)
    return np.maximum(after, np.arange(n) + 1)


def _bucketed(spans: DataFrame, key: str) -> DataFrame:
    """Spans with the bucket of their start, and once more (`own` false) with the bucket before if a clip from there may reach them."""
    bucket = F.floor(F.col("start") / BUCKET).cast("long")
    rows = spans.select(key, "start", "end", bucket.alias("bucket"))
    again = rows.where(F.col("start") - F.col("bucket") * BUCKET <= MOST).select(key, "start", "end", (F.col("bucket") - 1).alias("bucket"), F.lit(False).alias("own"))
    return rows.withColumn("own", F.lit(True)).unionByName(again)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows of whole groups, and where the groups begin and the last one ends; the last group of a batch waits for the next."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        codes = [rows.column(c).dictionary_encode("encode").indices.to_numpy() for c in by]
        cut = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in codes])) + 1])
        if len(cut) > 1:
            yield rows.slice(0, int(cut[-1])), cut
        held = rows.slice(int(cut[-1]))
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _by_group(rows: DataFrame, by: list[str], order: list[str], work: Callable[..., tuple], schema: str) -> DataFrame:
    """`schema` (the first is the group's `key`): what `work` makes of the columns of each group, in the `order`, as arrays.

    A task goes through its sorted groups batch by batch: recordings are many and short, and a call for each
    group from Spark takes longer than its work."""
    columns, names = [*by[1:], *order], [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64() if part.endswith(" long") else pa.float64() for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cut in _whole_groups(batches, by):
            own = [rows.column(c).to_numpy(zero_copy_only=False) for c in columns]
            made = [work(*(c[x:y] for c in own)) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            of = pa.array(np.repeat(cut[:-1], [len(m[0]) for m in made]))
            values = [pa.array(np.concatenate([np.asarray(m[i]) for m in made]), kind) for i, kind in enumerate(kinds[1:])]
            yield pa.RecordBatch.from_arrays([rows.column("key").take(of), *values], names=names)

    return rows.select("key", *columns).repartition(*by).sortWithinPartitions("key", *columns).mapInArrow(run, schema)


def plan_clips(spans: DataFrame, key: str, total: float) -> DataFrame:
    """key, start, end, dropped: consecutive spans packed into clips of 3 to 15 seconds, cut
    only in silences; a span that is too long and a clip that is too short are dropped with
    the reason.

    Which span begins a clip depends on all before it, so buckets of BUCKET seconds are packed on
    their own from each span that can be the first there to begin one: those up to the first that ends
    more than 15 seconds into the bucket. That gives a bucket's jump, from its first clip to the next bucket's; jumps,
    a few for each bucket, are followed in order, and each bucket is packed from the start that is left. No
    task holds more than a bucket's spans."""
    ship(spans.sparkSession)
    kind, width = spans.schema[key].dataType.simpleString(), BUCKET
    rows = materialise(_bucketed(spans, key), "buckets")

    def jumps(bucket: np.ndarray, start: np.ndarray, end: np.ndarray, mine: np.ndarray) -> tuple:
        own, then = int(mine.sum()), _jumps(start, end)
        leaves = np.zeros(own)  # where the last clip ends that begins here
        for i in range(own - 1, -1, -1):
            leaves[i] = end[then[i] - 1] if then[i] >= own else leaves[then[i]]
        first = np.flatnonzero(np.concatenate([[own > 0], end[: max(own, 1) - 1] <= bucket[0] * width + MOST + GAP]))
        return np.repeat(bucket[:1], len(first)), start[first], leaves[first]

    def followed(bucket: np.ndarray, entry: np.ndarray, exit: np.ndarray) -> tuple:
        at, buckets, entries = -np.inf, [], []
        cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for x, y in zip(cut[:-1], cut[1:]):
            here = x + int(np.searchsorted(entry[x:y], at))
            if here < y:  # else a clip from before holds all spans here
                buckets.append(bucket[x])
                entries.append(entry[here])
                at = exit[here]
        return np.array(buckets, np.int64), np.array(entries)

    def packed(bucket: np.ndarray, start: np.ndarray, end: np.ndarray, mine: np.ndarray, entry: np.ndarray) -> tuple:
        own, then, i, out = int(mine.sum()), _jumps(start, end), int(np.searchsorted(start, entry[0])), []
        while i < own:
            out.append((start[i], end[i : then[i]].max()))
            i = int(then[i])
        return tuple(np.array(out, float).reshape(-1, 2).T)

    named = rows.withColumnRenamed(key, "key")
    spans_in = ["start", "end", "own"]
    found = materialise(_by_group(named, ["key", "bucket"], spans_in, jumps, f"key {kind}, bucket long, entry double, exit double"), "jumps")
    entries = _by_group(found, ["key"], ["bucket", "entry", "exit"], followed, f"key {kind}, bucket long, entry double")
    entries = entries.withColumnsRenamed({"key": "_key", "bucket": "_bucket"})
    entered = named.join(entries, F.col("key").eqNullSafe(F.col("_key")) & (F.col("bucket") == F.col("_bucket"))).drop("_key", "_bucket")
    clips = _by_group(entered, ["key", "bucket"], [*spans_in, "entry"], packed, f"key {kind}, clip double, last double").withColumnRenamed("key", key)
    long = F.col("last") - F.col("clip") > MOST
    start = F.when(long, F.col("clip")).otherwise(F.greatest(F.lit(0.0), F.col("clip") - PAD))
    end = F.when(long, F.col("last")).otherwise(F.least(F.lit(total), F.col("last") + PAD))
    reason = F.when(F.col("long"), "too long").when(F.col("end") - F.col("start") < LEAST, "too short")
    return clips.select(key, start.alias("start"), end.alias("end"), long.alias("long")).select(key, "start", "end", reason.alias("dropped"))
