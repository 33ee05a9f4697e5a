"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised; tokens are whatever the
caller counts (the query: words). Bisection finds the
smallest alpha in [0, 1] whose weights stay within a target entropy (a share of the highest
possible one) and a repetition limit: alpha 1 keeps the shares, a smaller alpha is flatter,
and both the entropy and the most repeated source grow as alpha falls. Where not even alpha 1
stays within the target entropy or the limit, the shares are kept as they are (alpha is 1).

The weights are realised to the token: a source with budget b and size t is passed over
b div t times in full; the rest is a permutation (documents in the order of a hash), cut
where the budget ends. A permutation is dealt in blocks by the hash's first digits: running
totals over blocks, then within a block, so no task sorts a source. Passes differ only in
their permutation, so a document's number of copies says it all; `copies` may be 0.

Only DataFrame and SQL functions. Sources are never gathered: each bisection job sums over
the table of sources for 32 exponents at once, which is five halvings.

Defined results: a null source is a source of its own. Documents without tokens weigh
nothing; they are taken as far as their block prefix is. Equal rows are separate documents; of
equal ranks and ids the shorter document comes first. A very long text is a document like any other
and is left out of the cut permutation when it does not fit. An empty table gives an empty table.
Other columns stay out of the schedule, and `mixed_rows` passes them through whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.words import plain
from scriptorium.session import materialise, table

#: Entropy as a share of the highest, and passes over a source at most.
TARGET_ENTROPY, MAX_PASSES = 0.92, 4.0
ROUNDS, CANDIDATES = 6, 32
SEED = "mix"
BLOCK_DIGITS = 3


def word_tokens(text: Column) -> Column:
    """Words as tokens: null and blank texts have none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[ \t-\r]+"), "")).cast("long"), F.lit(0).cast("long"))


def exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES) -> float:
    """The smallest alpha within the limits, for sources (tokens) and a budget of all tokens."""
    sized = sources.where("tokens > 0")
    n, total = sized.agg(F.count("*"), F.sum("tokens")).first()
    if not n or n == 1:
        return 1.0
    low, high, fits = 0.0, 1.0, lambda entropy, passes: entropy <= target_entropy * math.log(n) and passes <= max_passes
    for first in (True, *[False] * (ROUNDS - 1)):
        step = (high - low) / CANDIDATES
        alphas = [low + step * i for i in range(0 if first else 1, CANDIDATES + (1 if first else 0))]
        p = F.col("tokens") / F.lit(total)
        sums = []
        for i, a in enumerate(alphas):
            q = F.pow(p, F.lit(a))
            sums += [F.sum(q).alias(f"z{i}"), F.sum(q * F.ln(q)).alias(f"e{i}"), F.max(q / p).alias(f"r{i}")]
        row = sized.agg(*sums).first()
        # entropy ln z - sum(q ln q) / z; passes w * total / tokens = (q / z) / p
        ok = [fits(math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"], row[f"r{i}"] / row[f"z{i}"]) for i in range(len(alphas))]
        good = [a for a, o in zip(alphas, ok) if o]
        if first and not ok[-1]:
            return 1.0
        if first and ok[0]:
            return 0.0
        high = min(good, default=high)
        low = max([a for a, o in zip(alphas, ok) if not o and a < high], default=low)
    return high


def budgets(sources: DataFrame, alpha: float, total: int) -> DataFrame:
    """Adds weight, budget, passes (in full) and rest (tokens of the cut permutation)."""
    p = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(alpha))).otherwise(0.0)
    z = sources.agg(F.coalesce(F.sum(p), F.lit(1.0)).alias("z"))
    weighed = sources.join(F.broadcast(z)).withColumn("weight", F.when(F.col("z") > 0, p / F.col("z")).otherwise(0.0)).drop("z")  # one row
    weighed = weighed.withColumn("budget", F.floor(F.round(F.col("weight") * total, 3)).cast("long"))
    passes = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("long"))
    return weighed.withColumn("passes", passes).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))


def schedule(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES, keep: tuple[str, ...] = ()) -> DataFrame:
    """For docs (id, source, n_tokens): also block (of the permutation), copies; and `keep`."""
    rank = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    docs = materialise(docs.select("id", "source", F.col("n_tokens").cast("long").alias("n_tokens"), rank.alias("rank"), F.substring(rank, 1, BLOCK_DIGITS).alias("block"), *keep), "mixed")
    blocks = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"))
    sources = materialise(blocks.groupBy("source").agg(F.sum("in_block").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    found = budgets(sources, exponent(sources, target_entropy, max_passes), total)
    before = F.coalesce(F.sum("in_block").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("before", before).select(F.col("source").alias("_source"), F.col("block").alias("_block"), "before")
    found = found.select(F.col("source").alias("_of"), "passes", "rest")
    placed = placed.join(found, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    own = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("rank", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    rows = docs.withColumn("own", own).join(placed, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    copies = F.col("passes") + (F.col("before") + F.col("own") <= F.col("rest")).cast("long")
    return rows.select("id", "source", "n_tokens", "block", copies.alias("copies"), *keep)


def mixed_rows(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """The rows of `df`, each as often as the mix takes it. Rows get a number of their own, by
    which they meet their copies, so repeated and null ids are rows like any other."""
    own, at = plain(df)
    rows = materialise(own.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    taken = schedule(rows.select(F.col(at[id_col]).alias("id"), F.col(at[source_col]).alias("source"), word_tokens(F.col(at[text_col])).alias("n_tokens"), "_row"), keep=("_row",))
    times = taken.where("copies > 0").select(F.col("_row").alias("_of"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return rows.join(times, F.col("_row") == F.col("_of")).select(*own.columns).toDF(*df.columns)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, block and copies of every document, budget: all tokens."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", word_tokens(F.col("text")).alias("n_tokens"))
    return schedule(docs).withColumnRenamed("id", "doc_id")


def oracle() -> str:
    halvings = ROUNDS * int(math.log2(CANDIDATES))
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS rank,
    CAST(coalesce(len(list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda w: w <> '')), 0) AS BIGINT) AS n_tokens
  FROM documents
), s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
t AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) FILTER (WHERE tokens > 0) AS n FROM s),
limits(a) AS (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE])),
b(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END FROM (
    SELECT i, low, high, (low + high) / 2 AS mid, (
      SELECT ln(sum(q)) - sum(q * ln(q)) / sum(q) <= {TARGET_ENTROPY} * ln(count(*)) AND max(q / p) / sum(q) <= {MAX_PASSES}
      FROM (SELECT tokens / total::DOUBLE AS p, pow(tokens / total::DOUBLE, (low + high) / 2) AS q FROM s, t WHERE tokens > 0)
    ) AS ok FROM b WHERE i < {halvings})
), ends AS (
  SELECT a, ln(sum(q)) - sum(q * ln(q)) / sum(q) <= {TARGET_ENTROPY} * ln(count(*)) AND max(q / p) / sum(q) <= {MAX_PASSES} AS ok
  FROM (SELECT a, tokens / total::DOUBLE AS p, pow(tokens / total::DOUBLE, a) AS q FROM limits, s, t WHERE tokens > 0) GROUP BY a
), alpha AS (
  SELECT CASE WHEN (SELECT n FROM t) < 2 OR NOT (SELECT ok FROM ends WHERE a = 1) THEN 1.0
    WHEN (SELECT ok FROM ends WHERE a = 0) THEN 0.0 ELSE (SELECT high FROM b WHERE i = {halvings}) END AS alpha
), p AS (SELECT source, tokens, total, CASE WHEN tokens > 0 THEN pow(tokens / total::DOUBLE, alpha) ELSE 0 END AS p FROM s, t, alpha),
g AS (SELECT source, tokens, CAST(floor(round(p / (SELECT sum(p) FROM p) * total, 3)) AS BIGINT) AS budget FROM p),
r AS (SELECT source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS passes, budget - CASE WHEN tokens > 0 THEN budget // tokens * tokens ELSE 0 END AS rest FROM g)
SELECT doc_id, d.source, n_tokens, substr(rank, 1, {BLOCK_DIGITS}) AS block,
  CAST(passes + CASE WHEN sum(n_tokens) OVER (PARTITION BY d.source ORDER BY rank, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
