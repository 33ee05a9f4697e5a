"""Queries for style statistics over documents and conversations."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import rules
from scriptorium.functions import text as tx
from scriptorium.operators import holdout
from scriptorium.operators import style as st
from scriptorium.operators.places import placed
from scriptorium.session import UNIQUE, Scratch, materialise, shared_dir, spread, table
from scriptorium.sources.stored import Stored


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(st.common_words(table(spark, sf_dir, "conversations"), "text"), "common")


def t1_text_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.text_analysis(_docs(spark, sf_dir), ["source"], "text")


def t1_sentence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.sentence_lengths(_docs(spark, sf_dir), ["source"], "text").groupBy("source", st.length_bucket(F.col("length")).alias("bucket")).agg(F.count("*").alias("n"))


def t2_gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the two halves of the corpus, merged in a stored table batch by batch; the 8,000 most frequent words
    and phrases each.

    The table has the runs of three tokens: all rows of two first tokens are in one bucket, so the phrases of a part of the
    buckets are whole, and the most frequent ones are among those of the parts."""
    docs = spread(_docs(spark, sf_dir), "doc_id")
    half = lambda k: st.gram_places(docs.where(F.col("doc_id") % 2 == k), ["source"], "text").withColumn("count", F.lit(1).cast("long"))
    keys = ["source", "_w0", "_w1", "_w2"]
    kept = Stored(spark, f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}", half(0).schema, keys, by=keys[:3])
    for k in (0, 1, 1):  # a batch that comes again counts once
        kept.add(half(k), ["count"], f"half {k}")
        kept.vacuum()
    found, scratch = [st.most_frequent(materialise(st.grams_at(kept.frame(), ["source"], 1), "words"), ["source"], 8000)], Scratch(spark)
    for part in kept.steps():
        places = kept.frame(only=part)
        both = st.grams_at(places, ["source"], 3).unionByName(scratch.write(st.grams_at(places, ["source"], 2), "pairs", **UNIQUE))
        found.append(materialise(st.most_frequent(both, ["source"], 8000), "phrases"))
        scratch.drop()
    phrases = st.top_per(reduce(DataFrame.unionByName, found[1:]), ["source"], [F.desc("count"), "gram"], 8000)
    return found[0].unionByName(phrases).select("source", "n", "gram", "count")


def t3_distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against general usage: the most frequent words of the conversations."""
    counts = st.frequent_grams(spread(_docs(spark, sf_dir), "doc_id"), ["source"], "text", st.LEAST_PHRASE)
    return st.distinctive(counts, ["source"], _general(spark, sf_dir))


def t4_chat_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every seventh conversation has no date
    date = F.when(F.col("conv_id") % 7 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") * 2 + F.col("turn")).cast("int")), "yyyy-MM-dd"))
    c = table(spark, sf_dir, "conversations").withColumns({"w": F.size(tx.style_tokens(F.col("text"))), "date": date})
    shape = st.text_analysis(c, ["role"], "text")
    base = c.groupBy("role").agg(F.count_distinct("conv_id").alias("conversations"), F.count("*").alias("messages"), F.round(F.percentile("w", 0.5)).cast("long").alias("median_words"), F.round(F.avg("w")).cast("long").alias("mean_words"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return base.join(shape, "role").select("role", "conversations", "messages", "first_date", "last_date", "median_words", "mean_words", F.round(F.col("list_lines") / F.col("lines"), 3).alias("list_ratio"))


def t4_top_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word phrases by messages that have them, not all of function words."""
    c = table(spark, sf_dir, "conversations").select("role", tx.style_tokens(F.col("text")).alias("w"))
    known = F.array(*map(F.lit, st.FUNCTION_WORDS))
    phrases = c.select("role", F.explode(F.array_distinct(st.grams(F.col("w"), 3))).alias("phrase"))
    own = phrases.where(~F.forall(F.split("phrase", " "), lambda w: F.array_contains(known, w)))
    return st.top_per(own.groupBy("role", "phrase").agg(F.count("*").alias("messages")).where("messages >= 3"), ["role"], [F.desc("messages"), "phrase"], 15)


def t5_time_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (n div 220)-th user turn in order, 220 at most, texts cut to 600 characters."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    c = c.select("conv_id", "turn", F.substring("text", 1, 600).alias("text"))
    rows = placed(c, "conv_id", "turn").withColumnsRenamed({"_i": "i", "_n": "n"})
    step = F.expr("greatest(1, n div 220)")
    return rows.where((F.col("i") % step == 0) & (F.expr("i div greatest(1, n div 220)") < 220)).select("conv_id", "turn", "text")


def t6_term_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.term_rates(_docs(spark, sf_dir), ["source"], "text", TERMS)


def t7_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.markers(st.term_rates(_docs(spark, sf_dir), ["source"], "text", st.MARKERS), ["source"])


def t8_sentence_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.sentence_spread(_docs(spark, sf_dir), ["source"], "text")


def t9_openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.openers(_docs(spark, sf_dir), ["source"], "text")


def t10_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.punctuation(_docs(spark, sf_dir), ["source"], "text")


TERMS = list(dict.fromkeys(st.MARKERS + st.FILLERS + st.HEDGES + st.INTENSIFIERS))


def t11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a subject and mode: size, sentence spread, punctuation, openers, the top markers,
    hedges, intensifiers and the subject's collocations; fillers only of what is spoken, the share of
    list lines only of what is written."""
    docs = spread(_docs(spark, sf_dir), "doc_id").withColumn("mode", F.when(F.col("doc_id") % 2 == 0, "spoken").otherwise("written"))
    keys = ["source", "mode"]
    # texts are cut once: the tokens of each sentence, and how many sentences are not blank
    full = F.size(F.filter(tx.sentences(F.col("text")), lambda s: F.trim(s) != ""))
    docs = materialise(docs.select("source", "mode", "text", st.cut_sentences(F.col("text")).alias("cut"), full.alias("full")), "cut", **UNIQUE)
    cut, w = F.col("cut"), F.flatten("cut")
    rates = materialise(st.term_rates(docs, keys, "text", TERMS, w), "rates")
    in_list = lambda c, name: F.array_join(F.sort_array(F.collect_list(c)), ",").alias(name)
    marked = st.markers(rates.where(F.col("term").isin(st.MARKERS)), keys).groupBy(*keys).agg(in_list("term", "markers"))
    listed = [st.listed(rates.where(F.col("mode").isin(modes)), keys, terms, most, name) for name, terms, most, modes in (("fillers", st.FILLERS, len(st.FILLERS), ["spoken"]), ("hedges", st.HEDGES, 10, ["spoken", "written"]), ("intensifiers", st.INTENSIFIERS, 10, ["spoken", "written"]))]
    opening = st.openers(docs, keys, "text", cut=cut).groupBy(*keys).agg(in_list("opener", "openers"))
    own = st.distinctive(st.frequent_grams(docs, ["source"], "text", st.LEAST_PHRASE, w), ["source"], _general(spark, sf_dir)).where("gram like '% %'")
    rank = [F.desc(F.col("score") * F.log(1 + F.col("count"))), "gram"]
    phrases = st.top_per(own, ["source"], rank, 15).groupBy("source").agg(in_list("gram", "collocations"))
    out = st.text_analysis(docs, keys, "text", w).select(*keys, "words", F.when(F.col("mode") == "written", F.round(F.col("list_lines") / F.col("lines"), 3)).alias("list_ratio"))
    for part in (st.sentence_spread(docs, keys, "text", cut), st.punctuation(docs, keys, "text", F.col("full"), w), marked, *listed, opening):
        out = out.join(part, keys, "left")
    return out.join(phrases, "source", "left")


def t12_word_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.word_profile(_docs(spark, sf_dir), ["source"], "text").withColumn("per_1k", F.round("per_1k", 6))


def t13_profile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.bag_spread(st.word_bags(_docs(spark, sf_dir), ["source", "doc_id"], "text"), ["source"], "doc_id")
    return out.select("source", "word", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def t14_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of English and French texts of one source, against the source's documents."""
    bags = st.word_bags(spread(_docs(spark, sf_dir), "doc_id"), ["source", "doc_id", "lang"], "text")
    a, b = (st.bag_profile(bags.where(f"lang = '{x}'"), ["source"]) for x in ("en", "fr"))
    return st.delta(a, b, st.bag_spread(bags, ["source"], "doc_id"), ["source"]).withColumn("delta", F.round("delta", 4))


def t15_self_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.self_distance(spread(_docs(spark, sf_dir), "doc_id"), ["source"], "doc_id", "text", 60).withColumn("delta", F.round("delta", 4))


#: Fillers that are spoken in one of so many turns, by the author and by the assistant.
_SPOKEN = [("um", 2, 2), ("you know", 2, 6), ("like", 4, 4), ("i mean", 3, 3), ("kind of", 6, 2), ("so", 3, 5), ("well", 2, 2)]


def t16_marker_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author's first six fillers of at least one in a thousand words, and whether the assistant
    uses each within 30 in 100. Turns are given fillers as in speech: of the author by conversation, of
    the assistant more of some and fewer of others."""
    spoken = F.concat_ws(" ", "text", *[F.when((F.col("conv_id") + F.col("turn")) % F.when(F.col("role") == "user", mine).otherwise(theirs) == 0, term) for term, mine, theirs in _SPOKEN])
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").withColumn("text", spoken)
    rates = materialise(st.term_rates(c, ["role"], "text", st.FILLERS), "rates")
    place = F.array_position(F.array(*map(F.lit, st.FILLERS)), F.col("term"))
    target = rates.where("role = 'user' and per_1k >= 1").orderBy(place).limit(6).select("term", F.col("per_1k").alias("target"))
    both = target.join(rates.where("role = 'assistant'").select("term", F.col("per_1k").alias("made")), "term", "left").withColumn("made", F.coalesce("made", F.lit(0.0)))
    return both.withColumn("within", F.col("made").between(0.7 * F.col("target"), 1.3 * F.col("target")))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, arm, text, recall (the turn before asks for a recall, so quoting is right) of the assistant's turns."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), (rules.route_intent(F.col("text")) == "explicit_recall").alias("recall"))
    arm = F.when(F.col("conv_id") % 2 == 0, "a").otherwise("b")
    rows = c.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left")
    return rows.select(F.concat_ws(":", "conv_id", "turn").alias("id"), arm.alias("arm"), "text", F.coalesce("recall", F.lit(False)).alias("recall"))


def l6_copy_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that copy eight words or more of the author's turns or of the benchmark, recalls apart."""
    replies = _replies(spark, sf_dir)
    sources = table(spark, sf_dir, "benchmark").select("text").unionByName(table(spark, sf_dir, "conversations").where("role = 'user'").select("text"))
    runs = holdout.longest_copied_run(replies, "id", "text", sources, "text").join(replies.select("id", "arm", "recall"), "id")
    flagged = ((F.col("run") >= 8) & ~F.col("recall")).cast("int")
    return runs.groupBy("arm").agg(F.count("*").alias("replies"), F.round(100 * F.avg(flagged), 1).alias("flag_rate"), F.round(F.avg("run"), 1).alias("mean_run"))


def t17_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms side by side: copies, distance to the author's own turns, the author's distance to
    themself, and whether the former is within one and a half times the latter."""
    own = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.lit("own").alias("who"), (F.col("conv_id") * 1_000 + F.col("turn")).alias("id"), "text")
    spread = materialise(st.bag_spread(st.word_bags(own, ["who", "id"], "text"), ["who"], "id"), "spread")
    whole = st.word_profile(own, ["who"], "text")
    made = st.word_profile(_replies(spark, sf_dir), ["arm"], "text")
    per_arm = lambda df: df.join(made.select("arm").distinct(), F.lit(True)).drop("who")  # noqa: E731 one row a word and arm
    distance = st.delta(made, per_arm(whole), per_arm(spread), ["arm"]).select("arm", F.round("delta", 3).alias("delta"))
    itself = st.self_distance(own, ["who"], "id", "text").select(F.round("delta", 3).alias("delta_self"))
    out = l6_copy_rate(spark, sf_dir).join(distance, "arm").join(F.broadcast(itself))  # one row
    return out.withColumn("in_band", F.col("delta") <= 1.5 * F.col("delta_self"))


TOKENS = "list_filter(string_split_regex(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}'' ]', ' ', 'g'), ' +'), lambda w: w <> '')"
SENTENCES = "regexp_extract_all(text, '[^.!?\\n]+[.!?]*')"
TOK = TOKENS.format(x="text")
STOK = TOKENS.format(x="trim(s)")


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _grams(keys: str, where: str = "true", n: int = 3, tok: str = "tok") -> str:
    each = " UNION ALL ".join(f"SELECT {keys}, {k} AS n, unnest(list_transform(range(1, greatest(len(w) - {k - 2}, 1)), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS gram FROM {tok}" for k in range(1, n + 1))
    return f"{tok} AS (SELECT {keys}, {TOK} AS w FROM documents WHERE {where}), g AS (SELECT {keys}, n, gram, count(*) AS count FROM ({each}) GROUP BY ALL)"


def _rates(keys: str, terms: list[str], source: str = "documents") -> str:
    words = list(dict.fromkeys(st.FUNCTION_WORDS))
    base = ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', {st.PHRASE_PER_1K if ' ' in t else 70.0 / (words.index(t) + 1) if t in words else st.FLOOR_PER_1K!r}::DOUBLE)" for t in terms)
    n = max(len(t.split()) for t in terms)
    each = " UNION ALL ".join(f"SELECT {keys}, unnest(list_transform(range(1, greatest(len(w) - {k - 2}, 1)), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS gram FROM tok" for k in range(1, n + 1))
    return f"""base(term, base) AS (VALUES {base}), tok AS (SELECT {keys}, {TOK} AS w FROM {source}), total AS (SELECT {keys}, sum(len(w)) AS total FROM tok GROUP BY ALL),
c AS (SELECT {keys}, gram AS term, count(*) AS count FROM ({each}) WHERE gram IN (SELECT term FROM base) GROUP BY ALL),
rates AS (SELECT {keys}, term, round(1000 * count / total, 2) AS per_1k, round(base, 2) AS baseline, round(1000 * count / total / base, 2) AS ratio FROM c JOIN total USING ({keys}) JOIN base USING (term) WHERE round(1000 * count / total, 2) > 0)"""


def _profile(keys: str, source: str = "documents", tag: str = "") -> str:
    return f"""k{tag} AS (SELECT {keys}, {TOK} AS w FROM {source}), tot{tag} AS (SELECT {keys}, sum(len(w)) AS total FROM k{tag} GROUP BY ALL),
cnt{tag} AS (SELECT {keys}, word, count(*) AS c FROM (SELECT {keys}, unnest(w) AS word FROM k{tag}) GROUP BY ALL),
prof{tag} AS (SELECT tot{tag}.*, f.word, 1000 * coalesce(c, 0) / greatest(total, 1) AS per_1k FROM tot{tag} CROSS JOIN (SELECT unnest({_list(st.FUNCTION_WORDS)}) AS word) f LEFT JOIN cnt{tag} USING ({keys}, word))"""


_SPREAD = "spread AS (SELECT source, word, avg(per_1k) AS mean, CASE WHEN stddev_pop(per_1k) = 0 THEN 1e-6 ELSE stddev_pop(per_1k) END AS sd FROM profd GROUP BY ALL)"
_BUCKET = "CASE " + " ".join(f"WHEN n <= {b} THEN '<={b}'" for b in (5, 10, 15, 20, 30, 40, 60, 100)) + " ELSE '>100' END"
_LINES = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))"
_ANALYSIS = f"sum(len({TOK}))::BIGINT AS words, sum(greatest(1, len(regexp_extract_all(text, '[^.!?\\n]+[.!?]+'))))::BIGINT AS sentences, sum(len({_LINES}))::BIGINT AS lines, sum(len(list_filter({_LINES}, lambda x: regexp_matches(trim(x), '^([-*•]|\\d+[.)])\\s'))))::BIGINT AS list_lines"
_PUNCT = f"""round(sum(len(regexp_extract_all(text, ','))) / sum(len(list_filter({SENTENCES}, lambda s: trim(s) <> ''))), 2) AS commas_per_sentence, round(1000 * sum(len(regexp_extract_all(text, '[—–-]{{1,2}}[ \\n\\t]'))) / sum(len({TOK})), 2) AS dashes_per_1k,
round(1000 * sum(len(regexp_extract_all(text, '!'))) / sum(len({TOK})), 2) AS exclamations_per_1k, round(1000 * sum(len(regexp_extract_all(text, '\\?'))) / sum(len({TOK})), 2) AS questions_per_1k"""
_MODE = "(SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'spoken' ELSE 'written' END AS mode FROM documents)"
_MARKED = "row_number() OVER (PARTITION BY {k} ORDER BY round(abs(ln(ratio + 1e-9)) * per_1k, 9) DESC, term)"

_COMMON = f"base0 AS (SELECT word, count(*) AS n FROM (SELECT unnest({TOK}) AS word FROM conversations) GROUP BY word ORDER BY n DESC, word LIMIT 250), common AS (SELECT word, 0.07 / row_number() OVER (ORDER BY n DESC, word) AS p FROM base0)"
_DISTINCT = f"""{_COMMON}, gtotal AS (SELECT source, sum(count) AS total FROM g WHERE n = 1 GROUP BY source), ge AS (SELECT *, unnest(string_split(gram, ' ')) AS word FROM g WHERE (n = 1 AND count >= 5 AND len(gram) >= 3) OR (n > 1 AND count >= 4)),
gl AS (SELECT source, n, gram, count, sum(log2(coalesce(p, 3e-6))) AS logs FROM ge LEFT JOIN common USING (word) GROUP BY ALL), gr AS (SELECT source, gram, count, log2(count / total) - logs / n - CASE WHEN n > 1 THEN 2 ELSE 0 END AS raw FROM gl JOIN gtotal USING (source)),
dist AS (SELECT source, gram, count, round(raw, 2) AS score FROM gr WHERE raw > 1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(raw, 2) * ln(1 + count) DESC, gram) <= 60)"""
_WORDS = "len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> ''))"
_RECALL = " OR ".join(f"regexp_matches(trim(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in rules.RECALL)
_EIGHT = "unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram, unnest(range(1, greatest(len(w) - 6, 1))) AS pos"
_COPIES = f"""re AS (SELECT c.conv_id || ':' || c.turn AS id, CASE WHEN c.conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, c.text AS text, coalesce(q.recall, false) AS recall FROM conversations c LEFT JOIN (SELECT conv_id, turn + 1 AS turn, {_RECALL} AS recall FROM conversations WHERE role = 'user') q USING (conv_id, turn) WHERE role = 'assistant'),
src AS (SELECT DISTINCT gram FROM (SELECT {_EIGHT} FROM (SELECT {TOK} AS w FROM benchmark UNION ALL SELECT {TOK} FROM conversations WHERE role = 'user'))), hits AS (SELECT id, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM (SELECT id, {_EIGHT} FROM (SELECT id, {TOK} AS w FROM re)) WHERE gram IN (SELECT gram FROM src)),
longest AS (SELECT id, max(c) + 7 AS run FROM (SELECT id, i, count(*) AS c FROM hits GROUP BY ALL) GROUP BY id), rate AS (SELECT arm, count(*) AS replies, round(100 * avg(CASE WHEN coalesce(run, 0) >= 8 AND NOT recall THEN 1 ELSE 0 END), 1) AS flag_rate, round(avg(coalesce(run, 0)), 1) AS mean_run FROM re LEFT JOIN longest USING (id) GROUP BY arm)"""


def _listed(name: str, terms: list[str], most: int) -> str:
    return f"""l_{name} AS (SELECT source, mode, string_agg(term || ':' || per_1k, ',' ORDER BY i) AS {name} FROM (SELECT *, list_position({_list(terms)}, term) AS i FROM rates WHERE list_contains({_list(terms)}, term) QUALIFY row_number() OVER (PARTITION BY source, mode ORDER BY i) <= {most}) GROUP BY ALL)"""


_SPOKEN_SQL = "".join(f", CASE WHEN (conv_id + turn) % (CASE WHEN role = 'user' THEN {mine} ELSE {theirs} END) = 0 THEN '{term}' END" for term, mine, theirs in _SPOKEN)
QUERIES = {f.__name__: f for f in (t1_text_analysis, t1_sentence_histogram, t2_gram_counts, t3_distinctive, t4_chat_profile, t4_top_phrases, t5_time_sample, t6_term_rates, t7_markers, t8_sentence_spread, t9_openers, t10_punctuation, t11_fingerprint, t12_word_profile, t13_profile_spread, t14_delta, t15_self_distance, t16_marker_calibration, l6_copy_rate, t17_arms)}
ORACLE = {
    "t1_text_analysis": f"SELECT source, {_ANALYSIS} FROM documents GROUP BY source",
    "t1_sentence_histogram": f"WITH s AS (SELECT source, unnest({SENTENCES}) AS s FROM documents), l AS (SELECT source, len({STOK}) AS n FROM s) SELECT source, {_BUCKET} AS bucket, count(*) AS n FROM l WHERE n > 0 GROUP BY source, {_BUCKET}",
    "t2_gram_counts": f"WITH {_grams('source')} SELECT source, n, gram, count FROM g QUALIFY row_number() OVER (PARTITION BY source, n > 1 ORDER BY count DESC, gram) <= 8000",
    "t3_distinctive": f"WITH {_grams('source')}, {_DISTINCT} SELECT source, gram, count, score FROM dist",
    "t4_chat_profile": f"WITH a AS (SELECT role, {_ANALYSIS} FROM conversations GROUP BY role), b AS (SELECT role, count(DISTINCT conv_id) AS conversations, count(*) AS messages, CAST(round(quantile_cont(len({TOK}), 0.5)) AS BIGINT) AS median_words, CAST(round(avg(len({TOK}))) AS BIGINT) AS mean_words, min(CASE WHEN conv_id % 7 <> 0 THEN strftime(DATE '2024-01-01' + CAST(conv_id * 2 + turn AS INT), '%Y-%m-%d') END) AS first_date, max(CASE WHEN conv_id % 7 <> 0 THEN strftime(DATE '2024-01-01' + CAST(conv_id * 2 + turn AS INT), '%Y-%m-%d') END) AS last_date FROM conversations GROUP BY role) SELECT role, conversations, messages, first_date, last_date, median_words, mean_words, round(list_lines / lines, 3) AS list_ratio FROM a JOIN b USING (role)",
    "t4_top_phrases": f"""WITH t AS (SELECT role, {TOK} AS w FROM conversations), p AS (SELECT role, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')))) AS phrase FROM t),
c AS (SELECT role, phrase, count(*) AS messages FROM p WHERE len(list_filter(string_split(phrase, ' '), lambda w: NOT list_contains({_list(st.FUNCTION_WORDS)}, w))) > 0 GROUP BY ALL)
SELECT * FROM c WHERE messages >= 3 QUALIFY row_number() OVER (PARTITION BY role ORDER BY messages DESC, phrase) <= 15""",
    "t5_time_sample": "WITH r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, count(*) OVER () AS n FROM conversations WHERE role = 'user') SELECT conv_id, turn, substr(text, 1, 600) AS text FROM r WHERE i % greatest(1, n // 220) = 0 AND i // greatest(1, n // 220) < 220",
    "t6_term_rates": f"WITH {_rates('source', TERMS)} SELECT * FROM rates",
    "t7_markers": f"WITH {_rates('source', st.MARKERS)} SELECT * FROM rates WHERE ratio >= 1.5 OR ratio <= 0.5 QUALIFY {_MARKED.format(k='source')} <= 25",
    "t8_sentence_spread": f"WITH s AS (SELECT source, unnest({SENTENCES}) AS s FROM documents), l AS (SELECT source, len({STOK}) AS n FROM s) SELECT source, round(avg(n), 1) AS mean_words, round(stddev_pop(n), 1) AS std_words FROM l WHERE n > 0 GROUP BY source",
    "t9_openers": f"WITH s AS (SELECT source, unnest({SENTENCES}) AS s FROM documents), l AS (SELECT source, {STOK} AS w FROM s), c AS (SELECT source, array_to_string(w[1:2], ' ') AS opener, count(*) AS count FROM l WHERE len(w) >= 3 GROUP BY ALL HAVING count(*) >= 3) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY count DESC, opener) <= 10",
    "t10_punctuation": f"SELECT source, {_PUNCT} FROM documents GROUP BY source",
    "t11_fingerprint": f"""WITH {_rates('source, mode', TERMS, _MODE)}, m AS (SELECT source, mode, term FROM rates WHERE (ratio >= 1.5 OR ratio <= 0.5) AND list_contains({_list(st.MARKERS)}, term) QUALIFY {_MARKED.format(k='source, mode')} <= 25),
l AS (SELECT source, mode, string_agg(term, ',' ORDER BY term) AS markers FROM m GROUP BY ALL), {_listed('fillers', st.FILLERS, 99)}, {_listed('hedges', st.HEDGES, 10)}, {_listed('intensifiers', st.INTENSIFIERS, 10)},
s AS (SELECT source, mode, unnest({SENTENCES}) AS s FROM {_MODE}), n AS (SELECT source, mode, {STOK} AS w FROM s),
o AS (SELECT source, mode, array_to_string(w[1:2], ' ') AS opener, count(*) AS k FROM n WHERE len(w) >= 3 GROUP BY source, mode, opener HAVING count(*) >= 3 QUALIFY row_number() OVER (PARTITION BY source, mode ORDER BY count(*) DESC, array_to_string(w[1:2], ' ')) <= 10), oo AS (SELECT source, mode, string_agg(opener, ',' ORDER BY opener) AS openers FROM o GROUP BY ALL),
sp AS (SELECT source, mode, round(avg(len(w)), 1) AS mean_words, round(stddev_pop(len(w)), 1) AS std_words FROM n WHERE len(w) > 0 GROUP BY ALL), a AS (SELECT source, mode, {_ANALYSIS} FROM {_MODE} GROUP BY ALL), p AS (SELECT source, mode, {_PUNCT} FROM {_MODE} GROUP BY ALL),
{_grams('source', tok='gtok')}, {_DISTINCT}, co AS (SELECT source, gram FROM dist WHERE contains(gram, ' ') QUALIFY row_number() OVER (PARTITION BY source ORDER BY score * ln(1 + count) DESC, gram) <= 15), cc AS (SELECT source, string_agg(gram, ',' ORDER BY gram) AS collocations FROM co GROUP BY ALL)
SELECT source, mode, words, CASE WHEN mode = 'written' THEN round(list_lines / lines, 3) END AS list_ratio, mean_words, std_words, commas_per_sentence, dashes_per_1k, exclamations_per_1k, questions_per_1k, markers, CASE WHEN mode = 'spoken' THEN fillers END AS fillers, hedges, intensifiers, openers, collocations
FROM a JOIN sp USING (source, mode) JOIN p USING (source, mode) LEFT JOIN l USING (source, mode) LEFT JOIN l_fillers USING (source, mode) LEFT JOIN l_hedges USING (source, mode) LEFT JOIN l_intensifiers USING (source, mode) LEFT JOIN oo USING (source, mode) LEFT JOIN cc USING (source)""",
    "t12_word_profile": f"WITH {_profile('source')} SELECT source, word, round(per_1k, 6) AS per_1k FROM prof",
    "t13_profile_spread": f"WITH {_profile('source, doc_id', tag='d')}, {_SPREAD} SELECT source, word, round(mean, 6) AS mean, round(sd, 6) AS sd FROM spread",
    "t14_delta": f"""WITH {_profile('source, doc_id', tag='d')}, {_SPREAD}, {_profile('source', "(SELECT * FROM documents WHERE lang = 'en')", 'a')}, {_profile('source', "(SELECT * FROM documents WHERE lang = 'fr')", 'b')}
SELECT source, round(avg(abs((a.per_1k - b.per_1k) / sd)), 4) AS delta FROM profa a JOIN profb b USING (source, word) JOIN spread USING (source, word) GROUP BY source""",
    "t15_self_distance": f"""WITH long AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 2 AS half FROM documents WHERE len({TOK}) > 60), {_profile('source, doc_id', 'long', 'd')}, {_SPREAD}, {_profile('source, half', 'long', 'h')}
SELECT a.source AS source, round(avg(abs((a.per_1k - b.per_1k) / sd)), 4) AS delta FROM profh a JOIN profh b ON a.source = b.source AND a.word = b.word AND a.half = 0 AND b.half = 1 JOIN spread s ON s.source = a.source AND s.word = a.word GROUP BY a.source""",
    "t16_marker_calibration": f"""WITH spoken AS (SELECT role, concat_ws(' ', text{_SPOKEN_SQL}) AS text FROM conversations WHERE role IN ('user', 'assistant')), {_rates('role', st.FILLERS, 'spoken')}, t AS (SELECT term, per_1k AS target FROM rates WHERE role = 'user' AND per_1k >= 1 ORDER BY list_position({_list(st.FILLERS)}, term) LIMIT 6),
m AS (SELECT t.term, target, coalesce(per_1k, 0.0) AS made FROM t LEFT JOIN rates r ON r.term = t.term AND r.role = 'assistant') SELECT *, made BETWEEN 0.7 * target AND 1.3 * target AS within FROM m""",
    "l6_copy_rate": f"WITH {_COPIES} SELECT * FROM rate",
    "t17_arms": f"""WITH {_COPIES}, own AS (SELECT 'own' AS who, conv_id * 1000 + turn AS id, text, (row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1) % 2 AS half FROM conversations WHERE role = 'user'), {_profile('who, id', 'own', 'd')}, {_profile('half', 'own', 'h')}, {_profile('who', 'own', 'o')}, {_profile('arm', 're', 'a')},
spread AS (SELECT word, avg(per_1k) AS mean, CASE WHEN stddev_pop(per_1k) = 0 THEN 1e-6 ELSE stddev_pop(per_1k) END AS sd FROM profd GROUP BY ALL), ds AS (SELECT round(avg(abs((a.per_1k - b.per_1k) / sd)), 3) AS delta_self FROM profh a JOIN profh b ON a.word = b.word AND a.half = 0 AND b.half = 1 JOIN spread s ON s.word = a.word),
da AS (SELECT arm, round(avg(abs((a.per_1k - o.per_1k) / sd)), 3) AS delta FROM profa a JOIN profo o ON o.word = a.word JOIN spread s ON s.word = a.word GROUP BY arm) SELECT *, delta <= 1.5 * delta_self AS in_band FROM rate JOIN da USING (arm), ds""",
}
