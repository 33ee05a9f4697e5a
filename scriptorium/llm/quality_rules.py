"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Base rules reject texts with few words or mostly repeated ones. For the rest, four transformed
statistics (mean word length, symbols, repeated words, repeated lines) make a vector. Per
language and source the estimate is that of the three quarters of the documents whose covariance
has the smallest determinant. It is searched from several starts (medians with median
deviations, covariances of squashed and of directions-only vectors, the plain estimate); each
concentration step takes the share nearest by Mahalanobis distance and estimates mean and
covariance anew, until the determinant falls no more, and of all starts the smallest
determinant wins. The covariance is regularised by adding a fixed diagonal (a statistic that is 0
nearly everywhere must not condemn every document that has it once), under which steps still
only lower the determinant. Only the winner of a group is then drawn to the mean of all groups'
winners, so that small groups lean on the others. Documents beyond the chi-square cutoff are rejected.

Only DataFrame and SQL functions; a group is summed, never gathered. Medians come from counts on
a fine grid, and the nearest share from a histogram of distances whose last bin counts in part, so
neither depends on partitioning, and a source that holds most rows is no special case.

Defined results: null and empty texts have no words and fail the base rules. A null language
or source is a group of its own; a group of equal vectors has only the fixed diagonal. Documents
with equal distances are judged alike, and repeated rows each. A very long text is a row like
any other, read whole. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.nearest import chi_square_quantile
from scriptorium.session import materialise, table

SPACE = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Transformed statistics and the standard deviation that regularises each one's.
STATISTICS = {
    "ln(word_chars / n_words)": 0.12,
    "ln(1 + 1000 * n_symbols / word_chars)": 0.8,
    "ln(1 + 100 * n_repeat_words / n_words)": 0.8,
    "ln(1 + n_dup_lines)": 0.5,
}
DIMS = len(STATISTICS)
SHARE, CUTOFF = 0.75, 0.9999
#: Steps at most (they stop by themselves), and the part by which a determinant has to fall.
MOST_STEPS, FALL = 40, 1e-6
#: Documents that the pooled estimate counts for in a group's.
POOLED_WEIGHT = 50
#: Bins of the histogram of distances in each e-fold, and of the grid of medians in each unit.
BINS, GRID = 32, 1000

#: Groups whose estimates are sent to all workers; the rows of more groups are dealt by group.
MOST_SENT = 20_000

_M = [f"m{i}" for i in range(DIMS)]
_X = [f"x{i}" for i in range(DIMS)]
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
_C = [f"c{i}{j}" for i, j in _PAIRS]
_L = [f"l{i}{j}" for i, j in _PAIRS]


def base_statistics(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The columns `keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated 3-word windows: hashes of the windows with their position in the low bits are
    sorted; equal neighbours are compared word by word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = df.select(*keep, text.alias("_t")).withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike("[^ \t-\r]"))
    gone = " \t\n\x0b\x0c\r"
    counted = words.select(
        *keep, "_w", F.size("_w").alias("_n"),
        F.length(F.translate("_t", gone, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    bits = "CAST(ceil(log2(_n + 1)) AS INT)"
    window = F.expr(f"transform(sequence(0, _n - 3), i -> (shiftleft(xxhash64(_h[i], _h[i + 1], _h[i + 2]), {bits}) | CAST(i AS BIGINT)))")
    sorted_ = counted.select(
        *keep, "_w", "_n", "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_n") >= 4, F.sort_array(window)).otherwise(F.expr("array()").cast("array<bigint>")).alias("_s"), F.expr(bits).alias("_b"),
    )
    at = "CAST({x} & (shiftleft(1L, _b) - 1) AS INT)"
    same = "(shiftrightunsigned(x, _b) = shiftrightunsigned({y}, _b) AND " + " AND ".join(f"_w[{at.format(x='x')} + {j}] = _w[{at.format(x='{y}')} + {j}]" for j in range(3)) + ")"
    near = f"coalesce({same.format(y='get(_s, k - 1)')}, false) OR coalesce({same.format(y='get(_s, k + 1)')}, false)"
    found = sorted_.withColumn("_at", F.sort_array(F.expr(f"transform(filter(_s, (x, k) -> {near}), x -> {at.format(x='x')})")))
    covered = F.expr("aggregate(zip_with(_at, slice(_at, 2, greatest(size(_at), 1)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (t, x) -> t + x)")
    return found.select(*keep, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def consistency() -> float:
    """What the covariance of the nearest SHARE of normal vectors lacks."""
    q = chi_square_quantile(SHARE, DIMS)
    inside = 1 - math.exp(-q / 2) * sum((q / 2) ** i / math.factorial(i) for i in range(DIMS // 2 + 1))  # of DIMS + 2 degrees
    return SHARE / inside


def _middle(bins: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, m, n: the lower median of `value`, which occurs k times, and the sum of k."""
    whole = Window.partitionBy(*by)
    upto = F.sum("k").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = bins.withColumn("_upto", upto).withColumn("n", F.sum("k").over(whole))
    return ranked.where(2 * F.col("_upto") >= F.col("n")).groupBy(*by, "n").agg(F.min(value).alias("m"))


def _robust(rows: DataFrame, g: list[str]) -> DataFrame:
    """g, n, medians m0.. and median deviations s0.. (with their regularisation), on the grid."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(x) * GRID).cast("long").alias("v")) for i, x in enumerate(_X)]))
    bins = materialise(rows.select(*g, grid.alias("q")).select(*g, "q.i", "q.v").groupBy(*g, "i", "v").agg(F.count("*").alias("k")), "marginals")
    middle = _middle(bins, [*g, "i"], "v")
    away = bins.join(middle, [*g, "i"]).groupBy(*g, "i", F.abs(F.col("v") - F.col("m")).alias("w")).agg(F.sum("k").alias("k"))
    both = middle.join(_middle(away, [*g, "i"], "w").select(*g, "i", F.col("m").alias("s")), [*g, "i"])
    of = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c) / GRID))
    floor = list(STATISTICS.values())
    return both.groupBy(*g).agg(F.max("n").alias("n"), *[of("m", i).alias(f"m{i}") for i in range(DIMS)], *[F.sqrt(F.pow(1.4826 * of("s", i), 2) + floor[i] ** 2).alias(f"s{i}") for i in range(DIMS)])


def _sent(estimate: DataFrame, groups: int) -> DataFrame:
    """`estimate` (a few rows a group), for a join: so that a group that holds most rows need not
    go to one task, it is sent to the rows if it is small."""
    return F.broadcast(estimate) if groups <= MOST_SENT else estimate


def _starts(rows: DataFrame, robust: DataFrame, g: list[str]) -> DataFrame:
    """g, start, n, m0.., c00..: estimates to begin with."""
    joined = rows.join(robust, g)
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(DIMS)]
    joined = joined.withColumns({f"z{i}": c for i, c in enumerate(z)})
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIMS)), F.col("z0") * F.col("z0")))
    joined = joined.withColumn("norm", norm)
    vectors = {
        "t": [F.tanh(f"z{i}") * F.col(f"s{i}") for i in range(DIMS)],
        "u": [F.when(F.col("norm") > 0, F.col(f"z{i}") / F.col("norm") * F.col(f"s{i}")).otherwise(0.0) for i in range(DIMS)],
    }
    joined = joined.withColumns({f"{k}{i}": c for k, v in vectors.items() for i, c in enumerate(v)})
    sums = [F.covar_pop(f"{k}{i}", f"{k}{j}").alias(f"{k}{i}{j}") for k in "tux" for i, j in _PAIRS]
    known = joined.groupBy(*g, "n", *_M, *[f"s{i}" for i in range(DIMS)]).agg(*sums, *[F.avg(x).alias(f"a{i}") for i, x in enumerate(_X)])
    made = []
    for start, (m, c) in enumerate([("m", None), ("m", "t"), ("m", "u"), ("a", "x")]):
        cov = [F.col(f"{c}{i}{j}") if c else F.pow(f"s{i}", F.lit(2)) if i == j else F.lit(0.0) for i, j in _PAIRS]
        made.append(known.select(*g, F.lit(start).alias("start"), F.col("n").cast("double").alias("n"), *[F.col(f"{m}{i}").alias(f"m{i}") for i in range(DIMS)], *[x.alias(n) for x, n in zip(cov, _C)]))
    return reduce(DataFrame.unionByName, made)


def _factored(estimate: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l00.. of the regularised covariance, and its determinant."""
    for i, j in _PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        if i == j:
            floor = list(STATISTICS.values())[i] ** 2
            estimate = estimate.withColumn(f"l{i}{i}", F.sqrt(F.greatest(rest + floor, F.lit(floor))))
        else:
            estimate = estimate.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    return estimate.withColumn("det", F.pow(reduce(lambda a, b: a * b, [F.col(f"l{i}{i}") for i in range(DIMS)]), F.lit(2)))


def _measured(rows: DataFrame, estimate: DataFrame, g: list[str], *also: str) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance under each estimate of the row's group, and `also`."""
    joined = rows.join(estimate, g)
    for i in range(DIMS):  # forward substitution, a column each, so that no term is computed twice
        joined = joined.withColumn(f"_z{i}", F.col(f"x{i}") - F.col(f"m{i}"))
    for i in range(DIMS):
        rest = F.col(f"_z{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"_z{j}")
        joined = joined.withColumn(f"_z{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(1, DIMS)), F.col("_z0") * F.col("_z0"))
    return joined.withColumn("d2", d2).select(*rows.columns, *also, "d2")


def _concentrated(rows: DataFrame, estimate: DataFrame, g: list[str], groups: int) -> DataFrame:
    """g, start, n, m0.., c00..: of the SHARE of a group's rows that is nearest to each estimate."""
    of = [*g, "start"]
    binned = _measured(rows.select(*g, *_X), _sent(estimate, groups), g, "start").withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * BINS))
    bins = binned.groupBy(*of, "bin").agg(F.count("*").alias("k"))
    whole = Window.partitionBy(*of)
    before = F.coalesce(F.sum("k").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("before", before).withColumn("h", F.ceil(SHARE * F.sum("k").over(whole)))
    last = bins.where("before < h and h <= before + k").select(*of, F.col("bin").alias("last"), ((F.col("h") - F.col("before")) / F.col("k")).alias("part"))
    near = binned.join(_sent(last, groups), of).where("bin <= last").withColumn("w", F.when(F.col("bin") < F.col("last"), 1.0).otherwise(F.col("part")))
    sums = near.groupBy(*of).agg(F.sum("w").alias("n"), *[(F.sum(F.col("w") * F.col(x)) / F.sum("w")).alias(f"m{i}") for i, x in enumerate(_X)], *[(F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) / F.sum("w")).alias(f"c{i}{j}") for i, j in _PAIRS])
    return sums.withColumns({f"c{i}{j}": (F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * consistency() for i, j in _PAIRS})


def estimates(rows: DataFrame, g: list[str]) -> DataFrame:
    """g, n, m0.., c00.., l00.., det: the smallest determinant found in each group. `g` has no nulls."""
    names = ["n", *_M, *_C, *_L, "det"]
    robust = materialise(_robust(rows, g), "robust")
    groups = robust.count()
    now = _factored(_starts(rows, _sent(robust, groups), g)).withColumn("det", F.lit(float("inf"))).withColumn("open", F.lit(True))
    now = materialise(now.select(*g, "start", *names, "open"), "estimate")
    for _ in range(MOST_STEPS):
        new = _factored(_concentrated(rows, now.where("open"), g, groups)).select(*g, "start", *[F.col(c).alias(f"_{c}") for c in names])
        lower = F.coalesce(F.col("_det") < F.col("det") * (1 - FALL), F.lit(False))
        both = now.join(new, [*g, "start"], "left").withColumn("lower", lower)
        now = materialise(both.select(*g, "start", *[F.when(F.col("lower"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names], F.col("lower").alias("open")), "estimate")
        if now.where("open").isEmpty():
            break
    return now.groupBy(*g).agg(F.min_by(F.struct(*names), F.struct("det", "start")).alias("best")).select(*g, "best.*")


def _pooled(estimate: DataFrame) -> DataFrame:
    """Each group's mean and covariance, drawn to the pooled ones by POOLED_WEIGHT documents."""
    w = F.sum("n")
    whole = estimate.agg(*[(F.sum(F.col(c) * F.col("n")) / w).alias(f"p_{c}") for c in _M + _C])
    out = estimate.join(F.broadcast(whole))  # one row
    drawn = {c: (F.col(c) * F.col("n") + F.col(f"p_{c}") * POOLED_WEIGHT) / (F.col("n") + POOLED_WEIGHT) for c in _M + _C}
    return out.withColumns(drawn)


def outliers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds d2 and outlier to rows with x0.. by minimum covariance determinant per `keys`."""
    g = [f"_g{i}" for i in range(len(keys))]
    marked = rows.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for n, k in zip(g, keys)})  # nulls are a value
    found = materialise(_factored(_pooled(estimates(marked, g).select(*g, "n", *_M, *_C))), "estimate")
    return _measured(marked, _sent(found, found.count()), g).withColumn("outlier", F.coalesce(F.col("d2") > chi_square_quantile(CUTOFF, DIMS), F.lit(False))).drop(*g)


def judge(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """id, the base statistics, base_failed, d2 and kept, a row for each row of `df`."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    stats = materialise(base_statistics(docs, "text", "id", "lang", "source").withColumn("base_failed", base_failed()), "statistics")
    rows = stats.where("not base_failed")
    rows = rows.select("*", *[F.expr(e).alias(f"x{i}") for i, e in enumerate(STATISTICS)])
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = outliers(rows, ["lang", "source"]).select(*names, "d2", (~F.col("outlier")).alias("kept"))
    return kept.unionByName(stats.where("base_failed").select(*names, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    out = judge(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source").drop("d2")
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
