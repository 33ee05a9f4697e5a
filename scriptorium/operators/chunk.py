"""Chunking of long texts, and what is regrouped or packed from chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.session import ship

TARGET, MOST = 300, 400
_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*\s*")


def count_tokens(text: str) -> int:
    """The default counter: words and single marks. Callers may give another function."""
    return len(_TOKEN.findall(text))


def chunks(text: str | None, most: int = MOST, target: int = TARGET, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Paragraphs, else sentences, else runs of words of at most `most` tokens, packed with
    blank lines up to `target`. The counter adds up over parts, so the work is linear."""
    text = (text or "").strip()
    if not text:
        return []
    if count(text) <= most:
        return [text]
    units: list[tuple[str, int]] = []
    for p in (q.strip() for q in re.split(r"\n{2,}", text)):
        n = count(p)
        if n <= most:
            units += [(p, n)] if p else []
            continue
        held, size = [], 0
        for s in _SENTENCE.findall(p) or [p]:
            n = count(s)
            if size + n > most and held:
                units.append(("".join(held).strip(), size))
                held, size = [], 0
            if n > most:
                units += _runs(s, most, count)
            else:
                held.append(s)
                size += n
        if "".join(held).strip():
            units.append(("".join(held).strip(), size))
    out, held, size = [], [], 0
    for unit, n in units:
        if held and size + n > target:
            out.append("\n\n".join(held))
            held, size = [], 0
        held.append(unit)
        size += n
    return out + (["\n\n".join(held)] if held else [])


def _runs(text: str, most: int, count: Callable[[str], int]) -> list[tuple[str, int]]:
    out, held, size = [], [], 0
    for w in text.split():
        held.append(w)
        size += count(w)
        if size >= most - 10:
            out.append((" ".join(held), size))
            held, size = [], 0
    return out + ([(" ".join(held), size)] if held else [])


def chunk_rows(df: DataFrame, id_col: str, text_col: str, most: int = MOST, target: int = TARGET, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """id, number, of, text: a row for each chunk; narrow, a text at a time."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = [chunks(t, most, target, count) for t in part.column(1).to_pylist()]
                at = pa.array([i for i, c in enumerate(found) for _ in c], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array([k for c in found for k in range(len(c))], pa.int32()), pa.array([len(c) for c in found for _ in c], pa.int32()), pa.array([x for c in found for x in c], pa.string())], names=["id", "number", "of", "text"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, number int, of int, text string")


def regroup(df: DataFrame, keys: list[str], order: str, text_col: str, most: int = 6000) -> DataFrame:
    """keys, text: chunks joined in order; one is added only while the text is shorter than
    `most`. The running length cuts a group before it is gathered: first within each partition
    as it is read, for what is beyond `most` there is so in the whole group, and then in all."""

    def cut(rows: DataFrame, *within: str) -> DataFrame:
        before = F.sum(F.length(text_col) + 1).over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("_before", F.coalesce(before, F.lit(0)) - 1).where(F.col("_before") < most)

    own = cut(cut(df.withColumn("_part", F.spark_partition_id()), *keys, "_part"), *keys)
    listed = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t")))).alias("x"))  # at most `most` characters and a chunk
    return listed.select(*keys, F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("text"))


def passages(text: Column, least: int = 40, most: int = 120) -> Column:
    """Consecutive sentences until there are `least` tokens; longer than `most` is left out."""
    parts = F.filter(F.transform(tx.sentences(text), lambda s: F.trim(s)), lambda s: s != "")
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        held = F.when(acc["held"] == "", s).otherwise(F.concat(acc["held"], F.lit(" "), s))
        n = acc["n"] + F.size(tx.style_tokens(s))
        full = n >= least
        out = F.when(full & (n <= most), F.concat(acc["out"], F.array(held))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(full, "").otherwise(held).alias("held"), F.when(full, 0).otherwise(n).alias("n"))

    return F.aggregate(parts, empty, step, lambda acc: acc["out"])
