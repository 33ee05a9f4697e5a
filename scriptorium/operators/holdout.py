"""Sealed content, copies and leaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators.style import bind, grams
from scriptorium.session import materialise

LEAST_CHARS, GRAM = 40, 8
#: Words of an anchor, and its characters where there are no words for one.
ANCHOR, LETTERS = 4, 16


def word_grams(df: DataFrame, keys: list[str], text_col: str, n: int = GRAM) -> DataFrame:
    """keys, pos, gram of every run of n style tokens."""
    tokens = df.select(*keys, tx.style_tokens(F.col(text_col)).alias("_w"))  # a column, not split again for each run
    return tokens.select(*keys, F.posexplode(grams(F.col("_w"), n)).alias("pos", "gram"))


def longest_copied_run(replies: DataFrame, key: str, text_col: str, sources: DataFrame, source_text: str, n: int = GRAM) -> DataFrame:
    """key, run: the longest run of words shared with the sources; 0 below n words.

    Semi join on distinct grams; consecutive matches are islands of pos - row number."""
    known = word_grams(sources, [], source_text, n).select("gram").distinct()
    hit = word_grams(replies, [key], text_col, n).join(known, "gram", "left_semi")
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    runs = hit.withColumn("_i", island).groupBy(key, "_i").agg(F.count("*").alias("k")).groupBy(key).agg((F.max("k") + (n - 1)).alias("run"))
    return replies.select(key).join(runs, key, "left").select(key, F.coalesce("run", F.lit(0)).cast("long").alias("run"))


def _run_hashes(words: Column, n: int) -> Column:
    """A hash of each run of n words; different lengths have different hashes."""
    of = lambda w: lambda i: F.xxhash64(F.lit(n), *[F.get(w, i + j) for j in range(n)])
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), of(w))
    return bind(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.expr("cast(array() as array<bigint>)")))


def _met(split: DataFrame, anchored: DataFrame, kinds: list[int]) -> DataFrame:
    """id, sid where a run of a row's words `_w` has the hash of an anchor."""
    found = []
    if longest := max(kinds, default=0):
        # The words from each place on, side by side, so that no expression is interpreted for a run.
        shifted = split.select("id", *[F.slice("_w", j + 1, F.size("_w")).alias(f"_w{j}") for j in range(longest)])
        rows = shifted.select("id", F.inline(F.arrays_zip(*[f"_w{j}" for j in range(longest)])))
        runs = [F.when(F.col(f"_w{k - 1}").isNotNull(), F.xxhash64(F.lit(k), *[f"_w{j}" for j in range(k)])) for k in kinds if k]
        found.append(rows.select("id", F.stack(F.lit(len(runs)), *runs).alias("_a")).where("_a is not null"))
    if 0 in kinds:
        found.append(split.select("id", F.explode(F.array_distinct(_letter_hashes(F.col("_w")))).alias("_a")))
    return reduce(DataFrame.unionByName, [hashes.join(anchored, "_a").select("id", "sid") for hashes in found]).distinct()


def _letter_hashes(words: Column) -> Column:
    """A hash of each run of LETTERS characters within the long words."""
    long = F.filter(words, lambda w: F.length(w) >= LETTERS)
    runs = F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (LETTERS - 1)), lambda i: F.xxhash64(F.lit(0), F.substr(w, i, F.lit(LETTERS)))))
    return F.flatten(runs)


def sealed_matches(docs: DataFrame, id_col: str, text_col: str, sealed: DataFrame, sealed_id: str, sealed_text: str) -> DataFrame:
    """id, sealed_id of texts that contain a sealed text (identity forms, both long enough).

    Anchored: one run (of the largest hash) of up to ANCHOR interior words of each sealed text
    meets the runs of the documents; the first and last word may be cut by a match within words.
    A text of one or two words is so long that one of them has LETTERS characters, which lie
    in one word of the document: its anchor is a run of these. Only ids and hashes are spread out;
    sealed texts join the pairs that met, these the texts, and containment is checked there, so a sealed text that many
    meet brings no texts to one task. Sealed texts longer than every text are left out first."""
    longest = docs.agg(F.max(F.length(F.lower(F.col(text_col))))).first()[0] or 0  # a normal form is no longer
    s = sealed.select(F.col(sealed_id).alias("sid"), tx.normalize(F.col(sealed_text)).alias("sealed")).where(F.length("sealed").between(LEAST_CHARS, longest))
    s = materialise(s, "sealed")
    d = docs.select(F.col(id_col).alias("id"), tx.normalize(F.col(text_col)).alias("norm")).where(F.length("norm") >= LEAST_CHARS)
    inner = s.withColumn("_w", F.split("sealed", " ")).withColumn("_k", F.greatest(F.lit(0), F.least(F.lit(ANCHOR), F.size("_w") - 2)))
    kinds = sorted(r[0] for r in inner.select("_k").distinct().collect())  # ANCHOR + 1 at most
    if not kinds:
        return d.crossJoin(s).select("id", "sid").limit(0)
    own = lambda k, w: _letter_hashes(w) if k == 0 else _run_hashes(w, k)
    anchors = [F.when(F.col("_k") == k, F.array_max(own(k, F.col("_w") if k == 0 else F.expr("slice(_w, 2, size(_w) - 2)")))) for k in kinds]
    anchored = materialise(inner.select("sid", F.coalesce(*anchors).alias("_a")).where("_a is not null"), "anchors")
    met = _met(d.select("id", F.split("norm", " ").alias("_w")), anchored, kinds)
    return met.join(s, "sid").join(d, "id").where(F.col("norm").contains(F.col("sealed"))).select("id", "sid").distinct()
