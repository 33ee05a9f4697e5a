"""Style statistics per subject: n-grams, distinctive phrases, marker rates, authorship distance.

Everything is counted per text and added up, so that counts merge in any order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators.places import placed
from scriptorium.session import UNIQUE, collect_garbage, materialise

# Function words in rank order, and the marker lists.
FUNCTION_WORDS = (
    "the of and a to in that it is was i for on you he be with as by at have are this not but had his they from she which or we an there "
    "her were one all your what so if their who been would when will no more out do about up them then some me him time my could than into now only its also these may other new any"
).split()
DISCOURSE = ["well", "so", "anyway", "actually", "basically", "honestly", "obviously", "essentially", "literally", "frankly", "look", "right", "okay", "now", "then", "though", "however", "therefore", "because", "but", "and", "you know", "i mean", "i think", "i guess", "i suppose", "to be honest", "kind of", "sort of", "at the end of the day", "the thing is"]
FILLERS = ["um", "uh", "erm", "you know", "like", "so", "i mean", "kind of", "sort of", "just", "really", "yeah"]
HEDGES = ["maybe", "perhaps", "probably", "possibly", "i think", "i guess", "i suppose", "kind of", "sort of", "a bit", "a little", "roughly", "more or less", "not sure", "i don't know"]
INTENSIFIERS = ["really", "very", "definitely", "absolutely", "completely", "totally", "genuinely", "massively", "hugely", "seriously", "honestly", "literally"]
MARKERS = list(dict.fromkeys(FUNCTION_WORDS + DISCOURSE))
LIST_LINE = "^([-*•]|\\d+[.)])\\s"
FLOOR_PER_1K, PHRASE_PER_1K = 0.05, 0.15
#: Times that a phrase, or a word, must occur to be distinctive.
LEAST_PHRASE, LEAST_WORD = 4, 5
#: Parts in which places of grams are counted, one after the other.
STEPS = 2


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: wherever the optimizer moves the expression
    to, an array of tokens is not made again for each of its elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def grams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces."""
    if n == 1:
        return tokens
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return bind(tokens, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.expr("cast(array() as array<string>)")))


def _places(df: DataFrame, keys: list[str], tokens: Column, longest: int) -> DataFrame:
    """keys, _w0, _w1, ...: each token and those after it."""
    rows = df.select(*keys, tokens.alias("_w")).where("size(_w) > 0")
    # The runs at a place are the tokens from there on, side by side: short rows, and nothing interpreted.
    shifted = [F.slice("_w", k + 1, F.size("_w")).alias(f"_w{k}") for k in range(longest)]
    return rows.select(*keys, *shifted).select(*keys, F.inline(F.arrays_zip(*[f"_w{k}" for k in range(longest)])))


def gram_rows(df: DataFrame, keys: list[str], text_col: str, longest: int = 3) -> DataFrame:
    """keys, n (1..longest), gram: a row for each place of a gram."""
    rows = _places(df, keys, tx.style_tokens(F.col(text_col)), longest)
    run = lambda n: F.when(F.col(f"_w{n - 1}").isNotNull(), F.concat_ws(" ", *[f"_w{k}" for k in range(n)]))
    each = F.stack(F.lit(longest), *[c for n in range(1, longest + 1) for c in (F.lit(n), run(n))]).alias("n", "gram")
    return rows.select(*keys, each).where("gram is not null")


def gram_places(df: DataFrame, keys: list[str], text_col: str, longest: int = 3) -> DataFrame:
    """keys, _w0, _w1, ...: a row for each token with those after it, nulls at the end of a text. Of summed places
    `grams_at` makes the counts of all shorter grams, so only places are shuffled, and not each gram of each length."""
    return _places(df, keys, tx.style_tokens(F.col(text_col)), longest)


def grams_at(places: DataFrame, keys: list[str], n: int, longest: int = 3) -> DataFrame:
    """keys, n, gram, count of the grams of n tokens, of places that are one row each with their `count`."""
    words = [f"_w{k}" for k in range(n)]
    rows = places.where(F.col(words[-1]).isNotNull())
    if n < longest:  # else each is a row already
        rows = rows.groupBy(*keys, *words).agg(F.sum("count").alias("count"))
    return rows.select(*keys, F.lit(n).alias("n"), F.concat_ws(" ", *words).alias("gram"), "count")


def gram_counts(df: DataFrame, keys: list[str], text_col: str, longest: int = 3) -> DataFrame:
    """keys, n (1..longest), gram, count; summed before the shuffle."""
    return gram_rows(df, keys, text_col, longest).groupBy(*keys, "n", "gram").agg(F.count("*").alias("count"))


def frequent_grams(df: DataFrame, keys: list[str], text_col: str, least: int, tokens: Column | None = None, longest: int = 3) -> DataFrame:
    """keys, n (1..longest), gram, count of all words, and of phrases that occur `least` times in a group; written once.

    Most phrases occur once, so summing them before a shuffle shortens nothing. Only places are shuffled, by the two first
    words; the tasks that get them count phrases of all lengths. That is done for a part of the places after the other,
    so that only one part is on its way at once."""
    tokens = tx.style_tokens(F.col(text_col)) if tokens is None else tokens
    words = df.select(*keys, F.explode(tokens).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("count"))
    found = [materialise(words.select(*keys, F.lit(1).alias("n"), "gram", "count"), "words", **UNIQUE)]
    places = _places(df, keys, tokens, longest).where("_w1 is not null")
    for k in range(STEPS if longest > 1 else 0):
        part = places.where(F.pmod(F.xxhash64(*keys, "_w0", "_w1"), F.lit(STEPS)) == k).repartition(*keys, "_w0", "_w1")
        each = []
        for n in range(2, longest + 1):
            own = [f"_w{i}" for i in range(n)]
            # own and last words are counted, too: so all lengths read the same rows and columns, and thus one shuffle
            counts = part.groupBy(*keys, *own).agg(F.count("*").alias("count"), F.count(own[-1]).alias("_own"), F.count(f"_w{longest - 1}").alias("_last"))
            each.append(counts.where((F.col("count") >= least) & (F.col("_own") == F.col("count")) & (F.col("_last") <= F.col("count"))).select(*keys, F.lit(n).alias("n"), F.concat_ws(" ", *own).alias("gram"), "count"))
        found.append(materialise(reduce(DataFrame.unionByName, each), "phrases", **UNIQUE))
        collect_garbage(df.sparkSession)
    return reduce(DataFrame.unionByName, found)


def most_frequent(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k rows of each group with the largest `count`, ties to the first `gram`.

    How many rows of a group have a count is a short table; what lies below the count of the k-th row is left out
    before rows are ranked, so rare grams, which are most, meet in no shuffle."""
    sizes = counts.groupBy(*keys, "count").agg(F.count("*").alias("_rows"))
    above = F.sum("_rows").over(Window.partitionBy(*keys).orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1))
    floors = sizes.withColumn("_above", F.coalesce(above, F.lit(0))).where(F.col("_above") < k).groupBy(*keys).agg(F.min("count").alias("_floor"))
    named = materialise(floors.withColumnsRenamed({c: f"_of_{c}" for c in keys}), "floors")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys))
    enough = counts.join(named, same & (F.col("count") >= F.col("_floor")), "left_semi")
    return top_per(enough, keys, [F.desc("count"), "gram"], k)


def top_per(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The k first rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def text_analysis(df: DataFrame, keys: list[str], text_col: str, tokens: Column | None = None) -> DataFrame:
    """Words, sentences, non-blank lines and list lines by keys."""
    t = F.col(text_col)
    lines = F.filter(F.split(t, "\n"), lambda x: tx.matches(x, "\\S"))
    # A terminated sentence is told by its end, so a long text without an end is read once.
    ends = F.greatest(F.lit(1), F.regexp_count(t, F.lit("[^.!?\\n][.!?]")))
    rows = df.select(*keys, F.size(tx.style_tokens(t) if tokens is None else tokens).alias("w"), ends.alias("s"), F.size(lines).alias("l"), F.size(F.filter(lines, lambda x: F.trim(x).rlike(tx.java(LIST_LINE)))).alias("ll"))
    return rows.groupBy(*keys).agg(F.sum("w").alias("words"), F.sum("s").alias("sentences"), F.sum("l").alias("lines"), F.sum("ll").alias("list_lines"))


def cut_sentences(text: Column) -> Column:
    """The style tokens of each stretch between ends of sentences; some have none. All of them in order are those of the
    text: the text is cleaned once, and its marks that end sentences separate tokens, too."""
    clean = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}' .!?\\n]", " ")
    return F.transform(F.split(clean, "[.!?\\n]"), lambda s: F.array_remove(F.split(s, " "), ""))


def sentence_tokens(df: DataFrame, keys: list[str], text_col: str, cut: Column | None = None) -> DataFrame:
    """keys, _w: the style tokens of each sentence; `cut` has them if they are known."""
    if cut is not None:
        return df.select(*keys, F.explode(cut).alias("_w"))
    return df.select(*keys, F.explode(tx.sentences(F.col(text_col))).alias("_s")).select(*keys, tx.style_tokens(F.trim("_s")).alias("_w"))


def sentence_lengths(df: DataFrame, keys: list[str], text_col: str, cut: Column | None = None) -> DataFrame:
    """keys, length: style tokens of every non-empty sentence."""
    return sentence_tokens(df, keys, text_col, cut).select(*keys, F.size("_w").alias("length")).where("length > 0")


def length_bucket(n: Column) -> Column:
    out = None
    for top in (5, 10, 15, 20, 30, 40, 60, 100):
        out = (F.when if out is None else out.when)(n <= top, f"<={top}")
    return out.otherwise(">100")


def common_words(df: DataFrame, text_col: str, k: int = 250) -> DataFrame:
    """word, p: the baseline of general usage, 0.07 by rank over the k most frequent words of `df`,
    a collection other than the one that is described."""
    counts = df.select(F.explode(tx.style_tokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(k)  # k rows in one task from here on
    return top.select("word", (0.07 / F.row_number().over(Window.orderBy(F.desc("n"), "word"))).alias("p"))


def distinctive(counts: DataFrame, keys: list[str], base: DataFrame, k: int = 60, floor: float = 3e-6) -> DataFrame:
    """Grams that a subject uses more than the baseline: score, top k by score * ln(1 + n)."""
    totals = counts.where("n = 1").groupBy(*keys).agg(F.sum("count").alias("total"))
    enough = counts.where(f"(n = 1 AND count >= {LEAST_WORD} AND length(gram) >= 3) OR (n > 1 AND count >= {LEAST_PHRASE})")
    parts = enough.select(*keys, "n", "gram", "count", F.explode(F.split("gram", " ")).alias("word"))
    logs = parts.join(base, "word", "left").groupBy(*keys, "n", "gram", "count").agg(F.sum(F.log2(F.coalesce("p", F.lit(floor)))).alias("logs"))
    raw = logs.join(totals, keys).withColumn("raw", F.log2(F.col("count") / F.col("total")) - F.col("logs") / F.col("n") - F.when(F.col("n") > 1, 2).otherwise(0))
    scored = raw.where("raw > 1").withColumn("score", F.round("raw", 2)).select(*keys, "gram", "count", "score")
    return top_per(scored, keys, [F.desc(F.col("score") * F.log(1 + F.col("count"))), "gram"], k)


def _terms_in(tokens: Column, terms: list[str]) -> Column:
    """The terms that occur in an array of tokens, as often as they do. Only where a term's first
    word stands are longer runs spelled out."""
    words = [t for t in terms if " " not in t]
    phrases = [t for t in terms if " " in t]
    own = F.filter(tokens, lambda w: w.isin(words))
    if not phrases:
        return own
    firsts = sorted({t.split()[0] for t in phrases})
    lengths = sorted({len(t.split()) for t in phrases})
    at = F.array_compact(F.transform(tokens, lambda w, i: F.when(w.isin(firsts), i + 1)))
    runs = F.transform(at, lambda i: F.array_distinct(F.array(*[F.array_join(F.slice(tokens, i, n), " ") for n in lengths])))
    return F.concat(own, F.filter(F.flatten(runs), lambda g: g.isin(phrases)))


def term_rates(df: DataFrame, keys: list[str], text_col: str, terms: list[str], tokens: Column | None = None) -> DataFrame:
    """per_1k, baseline and ratio of each term that occurs; terms may have several words."""
    spark = df.sparkSession
    ranks = {w: 70.0 / (i + 1) for i, w in enumerate(dict.fromkeys(FUNCTION_WORDS))}
    given = spark.createDataFrame([(t, PHRASE_PER_1K if " " in t else ranks.get(t, FLOOR_PER_1K)) for t in terms], "term string, base double")
    found = bind(tx.style_tokens(F.col(text_col)) if tokens is None else tokens, lambda w: F.struct(F.size(w).alias("n"), _terms_in(w, terms).alias("t")))
    tokens = df.select(*keys, found.alias("_found"))
    # one pass: a text's own counts leave the row, its tokens don't; the empty term counts all
    each = F.concat(F.transform("_found.t", lambda t: F.struct(t.alias("term"), F.lit(1).alias("k"))), F.array(F.struct(F.lit("").alias("term"), F.col("_found.n").alias("k"))))
    counts = tokens.select(*keys, F.explode(each).alias("x")).groupBy(*keys, "x.term").agg(F.sum("x.k").alias("count"))
    counts = materialise(counts, "terms")
    total = counts.where("term = ''").select(*keys, F.col("count").alias("total"))
    rate = 1000 * F.col("count") / F.col("total")
    return counts.join(total, keys).join(F.broadcast(given), "term").select(*keys, "term", F.round(rate, 2).alias("per_1k"), F.round("base", 2).alias("baseline"), F.round(rate / F.col("base"), 2).alias("ratio")).where("per_1k > 0")


def listed(rates: DataFrame, keys: list[str], terms: list[str], most: int, name: str) -> DataFrame:
    """keys and `name`: the first `most` of `terms` that occur, in the order of `terms`, with their rates."""
    place = F.array_position(F.array(*map(F.lit, terms)), F.col("term"))
    own = rates.where(F.col("term").isin(terms)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place.alias("i"), "term", "per_1k"))).alias("x"))  # the list at most
    return own.select(*keys, F.array_join(F.transform(F.slice("x", 1, most), lambda t: F.concat_ws(":", t["term"], t["per_1k"])), ",").alias(name))


def markers(rates: DataFrame, keys: list[str], k: int = 25) -> DataFrame:
    weight = F.abs(F.log(F.col("ratio") + 1e-9)) * F.col("per_1k")
    return top_per(rates.where("ratio >= 1.5 OR ratio <= 0.5"), keys, [F.desc(F.round(weight, 9)), "term"], k)


def sentence_spread(df: DataFrame, keys: list[str], text_col: str, cut: Column | None = None) -> DataFrame:
    """Mean and population deviation of sentence lengths, to one decimal."""
    return sentence_lengths(df, keys, text_col, cut).groupBy(*keys).agg(F.round(F.avg("length"), 1).alias("mean_words"), F.round(F.stddev_pop("length"), 1).alias("std_words"))


def openers(df: DataFrame, keys: list[str], text_col: str, k: int = 10, cut: Column | None = None) -> DataFrame:
    """First two tokens of sentences with at least three, in three sentences or more."""
    rows = sentence_tokens(df, keys, text_col, cut)
    counts = rows.where(F.size("_w") >= 3).groupBy(*keys, F.array_join(F.slice("_w", 1, 2), " ").alias("opener")).agg(F.count("*").alias("count")).where("count >= 3")
    return top_per(counts, keys, [F.desc("count"), "opener"], k)


def punctuation(df: DataFrame, keys: list[str], text_col: str, full: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """Marks by sentences that are not blank (`full`, if known) and by tokens."""
    t = F.col(text_col)
    n = lambda p: F.sum(F.regexp_count(t, F.lit(p)))
    full = F.size(F.filter(tx.sentences(t), lambda s: F.trim(s) != "")) if full is None else full
    per_1k = lambda c: F.round(1000 * c / F.sum(F.size(tx.style_tokens(t) if tokens is None else tokens)), 2)
    return df.groupBy(*keys).agg(
        F.round(n(",") / F.sum(full), 2).alias("commas_per_sentence"), per_1k(n("[—–-]{1,2}[ \\n\\t]")).alias("dashes_per_1k"),
        per_1k(n("!")).alias("exclamations_per_1k"), per_1k(n("\\?")).alias("questions_per_1k"),
    )


def word_bags(df: DataFrame, cols: list[str], text_col: str, above: int = -1) -> DataFrame:
    """cols, word, count of function words that occur in texts of more than `above` tokens; the empty word counts all
    tokens, and is always there. Texts are cut once, the counts written; a null text has no tokens."""
    one = lambda word, k: F.struct(word.alias("word"), k.cast("long").alias("k"))
    own = lambda w: F.transform(F.filter(w, lambda x: x.isin(FUNCTION_WORDS)), lambda x: one(x, F.lit(1)))
    made = lambda w: F.when(F.size(w) > above, F.concat(own(w), F.array(one(F.lit(""), F.size(w)))))
    rows = df.select(*cols, F.inline(bind(tx.style_tokens(F.coalesce(text_col, F.lit(""))), made)))
    return materialise(rows.groupBy(*cols, "word").agg(F.sum("k").alias("count")), "bags")


def _bag_counts(bags: DataFrame, keys: list[str]) -> DataFrame:
    return bags.groupBy(*keys, "word").agg(F.sum("count").alias("count"))


def bag_profile(bags: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word, per_1k of every function word, zeros included."""
    counts = _bag_counts(bags, keys)
    every = counts.where("word = ''").select(*keys, F.col("count").alias("total"), F.explode(F.array(*map(F.lit, FUNCTION_WORDS))).alias("word"))
    return every.join(counts, [*keys, "word"], "left").select(*keys, "word", _per_1k().alias("per_1k"))


def _per_1k() -> Column:
    return 1000 * F.coalesce("count", F.lit(0)) / F.greatest("total", F.lit(1))


def word_profile(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, word, per_1k of every function word, zeros included; one pass, no gram shuffle."""
    return bag_profile(word_bags(df, keys, text_col), keys)


def bag_spread(bags: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, word, mean and population deviation (never 0) over the documents (keys, order), zeros included: only words
    that a document has are rows, the others are added by their number."""
    counts = _bag_counts(bags, [*keys, order])
    totals = counts.where("word = ''").select(*keys, order, F.col("count").alias("total"))
    documents = totals.groupBy(*keys).agg(F.count("*").alias("all"))
    own = counts.where("word <> ''").join(totals, [*keys, order]).withColumn("per_1k", _per_1k())
    own = own.groupBy(*keys, "word").agg(F.count("*").alias("some"), F.avg("per_1k").alias("own"), F.var_pop("per_1k").alias("var"))
    every = documents.select(*keys, "all", F.explode(F.array(*map(F.lit, FUNCTION_WORDS))).alias("word")).join(own, [*keys, "word"], "left")
    some, mine = F.coalesce("some", F.lit(0)), F.coalesce("own", F.lit(0.0))
    mean = F.when(some == F.col("all"), mine).otherwise(mine * some / F.col("all"))
    var = F.when(some == F.col("all"), F.col("var")).otherwise((F.coalesce("var", F.lit(0.0)) + mine * mine * (F.col("all") - some) / F.col("all")) * some / F.col("all"))
    return every.select(*keys, "word", mean.alias("mean"), F.when(var == 0, 1e-6).otherwise(F.sqrt(var)).alias("sd"))


def delta(a: DataFrame, b: DataFrame, spread: DataFrame, keys: list[str]) -> DataFrame:
    """Burrows's Delta: the mean absolute difference of z-scores over the function words."""
    both = a.select(*keys, "word", F.col("per_1k").alias("a")).join(b.select(*keys, "word", F.col("per_1k").alias("b")), [*keys, "word"]).join(spread, [*keys, "word"])
    return both.groupBy(*keys).agg(F.avg(F.abs((F.col("a") - F.col("b")) / F.col("sd"))).alias("delta"))


def self_distance(df: DataFrame, keys: list[str], order: str, text_col: str, above: int = -1) -> DataFrame:
    """Delta between alternate documents of a subject, of those with more than `above` tokens. Texts are cut once; only ids
    are ranked."""
    bags = word_bags(df, [*keys, order], text_col, above)
    places = placed(bags.where("word = ''").select(*keys, order), *keys, order)
    first = places.groupBy(*keys).agg(F.min("_i").alias("_first"))
    halves = places.join(first, keys).select(*keys, order, ((F.col("_i") - F.col("_first")) % 2).alias("_half"))
    both = materialise(bag_profile(bags.join(halves, [*keys, order]), [*keys, "_half"]), "halves")
    return delta(both.where("_half = 0"), both.where("_half = 1"), bag_spread(bags, keys, order), keys)
