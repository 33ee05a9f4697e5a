"""Token counts for every context limit, from an exact histogram of encoded lengths.

Documents are encoded and counted by length; only the histogram (a row for each distinct
length) is shuffled further. Suffix sums over it answer, for a limit L: documents and tokens
at or above it, tokens left after truncation to L, and quantiles of the length. The sums run in
two levels, within blocks of lengths and over the blocks, so no task sees all lengths.

Defined results: null and empty texts have length 0 and count as documents. Repeated rows
count each, and documents of one length are one row (ties). A very long text is encoded whole and is
one document of its length. An empty table gives an empty histogram, and no answers; any limit then
has 0 documents and tokens. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.bpe import encoded_length
from scriptorium.session import materialise, table

#: Lengths in one block of the suffix sums.
BLOCK = 1024


def histogram(df: DataFrame, text_col: str, path: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many texts encode to each length."""
    return encoded_length(df, text_col, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def answers(hist: DataFrame) -> DataFrame:
    """For each occurring length as a limit: docs_at_least, tokens_at_least, docs_below,
    tokens_below, truncated_total (tokens left when texts are cut to this length) and
    quantile (the share of documents that are at most this long)."""
    hist = materialise(hist, "lengths").withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("n"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each 1,024 lengths
    whole = Window.partitionBy(F.lit(0))
    tails = blocks.select("block", F.coalesce(F.sum("n").over(after), F.lit(0)).alias("n_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("n").over(whole).alias("n_all"), F.sum("t").over(whole).alias("t_all"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.join(tails, "block").select(
        "n_tokens", "n_docs", "n_all", "t_all",
        (F.sum("n_docs").over(inside) + F.col("n_after")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("t_after")).alias("tokens_at_least"),
    )
    below = F.col("t_all") - F.col("tokens_at_least")
    return rows.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("n_all") - F.col("docs_at_least")).alias("docs_below"), below.alias("tokens_below"),
        (below + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("n_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("n_all")).alias("quantile"),
    )


def at_limit(found: DataFrame, limit: int) -> DataFrame:
    """Any limit, occurring or not: documents and tokens, documents cut, tokens left."""
    least = F.min_by(F.struct("docs_at_least", "tokens_below"), "n_tokens").alias("x")
    up = found.where(F.col("n_tokens") >= limit).agg(least)
    total: Column = F.max(F.col("tokens_at_least"))
    rest = found.agg(F.max("docs_at_least").alias("docs"), total.alias("tokens"))
    cut = F.coalesce("x.docs_at_least", F.lit(0))
    left = F.coalesce("x.tokens_below", "tokens", F.lit(0)) + cut * F.lit(limit)
    return rest.crossJoin(up).select(F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), cut.alias("docs_at_least"), left.alias("truncated_total"))


def length_quantile(found: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents doesn't exceed."""
    return found.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every length in tokens that a whole text of documents has: the columns of `answers`."""
    return answers(histogram(table(spark, sf_dir, "documents"), "text"))
