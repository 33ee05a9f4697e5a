"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its
character n-grams (with marks for the word's begin and end): those of the longest order of
which the model knows at least one, then shorter ones. A text's score for a language
is the sum over all its words, each a run of letters of any length; the answer is the best
language and its posterior share.

The model is learned from a sample of about `sample_rows` labelled rows (by a 64-bit hash of the
id, so that it depends neither on partitioning nor on the table's size) and holds every
word and n-gram of their whole texts; the sample alone bounds what is sent to the workers. All rows
are predicted, over their whole texts.

Defined results: null texts and texts without a letter are `und` with score 0. Ties between
languages go to the first by name. Without any labelled row every text is `und`. Repeated
rows are predicted each, and learned from once; rows without an id are predicted but not learned
from. A very long text is learned and scored whole, one at a time. An empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.words import text_parts
from scriptorium.session import ship, table

WORD = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 4
#: Words of which a worker remembers the scores, and letters of the longest that it remembers;
#: longer ones are scored whole as well, each time anew.
CACHE_WORDS, WORD_LETTERS = 400_000, 64
PART_BYTES = 4_000_000


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3: rows with 1 are held out of any learning."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def sampled(n: int, most: int, *key: str) -> Column:
    """Whether a row is among about `most` of `n`, by a hash of its key: all rows if n <= most."""
    if n <= most:
        return F.lit(True)
    return F.xxhash64(F.lit(17), *key) < F.lit(-(2**63) + 2**64 * most // n)


def grams(word: str, n: int) -> Iterator[str]:
    marked = f"<{word}>" if n > 1 else word
    return (marked[i : i + n] for i in range(len(marked) - n + 1))


@dataclass
class Model:
    """Rows of `logs` (log frequency by language, less its mean over the languages)."""

    languages: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def score(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.logs[at]
        for n in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            known = Counter(map(self.grams.get, grams(word, n)))
            known.pop(None, None)
            if known:
                often = np.fromiter(known.values(), float, len(known))
                return often @ self.logs[list(known)] / often.sum()
        return np.zeros(len(self.languages))


def modelled(kinds: list[int], items: list[str], langs: list[str], n: list[int]) -> Model:
    """The model of counts: kind 0 for words, otherwise the order of an n-gram. Shares are
    taken among the words, or among the n-grams of one order."""
    languages = sorted(set(langs))
    at = {lang: i for i, lang in enumerate(languages)}
    own: tuple[dict[str, int], dict[str, int]] = {}, {}
    rows = np.fromiter((own[k > 0].setdefault(x, len(own[0]) + len(own[1])) for k, x in zip(kinds, items)), np.int64, len(items))
    total = len(own[0]) + len(own[1])
    counts, kind = np.full((total, len(languages)), 0.5), np.zeros(total, np.int64)
    counts[rows, np.fromiter((at[x] for x in langs), np.int64, len(langs))] += n
    kind[rows] = kinds
    for k in np.unique(kind):
        logs = np.log(counts[kind == k] / counts[kind == k].sum(axis=0))
        counts[kind == k] = logs - logs.mean(axis=1, keepdims=True)
    return Model(languages, *own, counts.astype(np.float32))


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int = 12_000) -> Model:
    """Frequencies from a bounded sample of the rows of `df` that have an id, a language and a text."""
    ship(df.sparkSession)
    labelled = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null")
    chosen = sampled(labelled.count(), sample_rows, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((lang, 0, w) for w in WORD.findall(text.lower()))
            for (lang, _, w), c in list(counts.items()):
                for n in range(1, min(LONGEST_GRAM, len(w) + 2) + 1):
                    for g in grams(w, n):
                        counts[lang, n, g] += c
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[1] for k in keys], pa.int32()), pa.array([k[0] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "lang", "item", "n"])

    sample = labelled.where(chosen & F.col("text").isNotNull()).distinct().select("lang", "text")
    found = sample.mapInArrow(run, "kind int, lang string, item string, n long").groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")).toArrow()
    return modelled(*(found[c].to_pylist() for c in ("kind", "item", "lang", "n")))


class _Scores(dict):
    """Rows of remembered words. Row 0 stays zero: long words add to `long` instead."""

    def __init__(self, model: Model):
        self.model = model
        self.rows = np.zeros((CACHE_WORDS + 1, len(model.languages)), np.float32)
        self.long = np.zeros(len(model.languages))

    def __missing__(self, word: str) -> int:
        if len(word) > WORD_LETTERS:
            self.long += self.model.score(word)
            return 0
        at = self[word] = len(self) + 1
        self.rows[at] = self.model.score(word)
        return at

    def total(self, words: list[str]) -> np.ndarray:
        """In portions, between which the memory may be emptied."""
        out = np.zeros(self.rows.shape[1])
        self.long[:] = 0
        for i in range(0, len(words), 20_000):
            if len(self) > CACHE_WORDS - 20_000:
                self.clear()
            part = words[i : i + 20_000]
            out += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0, dtype=float)
        return out + self.long


def predict(df: DataFrame, model: Model, text_col: str, *keep: str) -> DataFrame:
    """The columns `keep`, lang_pred and score, a row for each row of `df`."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value)
        names = shared.value.languages
        for batch in batches:
            last = batch.num_columns - 1
            for a, b in text_parts(batch, last, PART_BYTES):
                langs, shares = [], []
                for text in batch.column(last)[a:b].to_pylist():
                    if not names or not text or not any(map(str.isalpha, text)):
                        langs.append("und")
                        shares.append(0.0)
                        continue
                    total = scores.total(WORD.findall(text.lower()))
                    best = int(total.argmax())
                    langs.append(names[best])
                    shares.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:last]), pa.array(langs, pa.string()), pa.array(shares, pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", F.coalesce(fold("doc_id") == 1, F.lit(False)))
    return predict(docs, learn(docs.where("not held_out"), "doc_id", "text", "lang"), "text", "doc_id", "held_out")
