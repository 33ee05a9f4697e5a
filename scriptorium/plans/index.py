"""Queries for retrieval, clustering and index maintenance over embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import rules
from scriptorium.operators import similarity as sim
from scriptorium.operators.places import placed
from scriptorium.operators.style import top_per
from scriptorium.plans.text_rules import WORDS, found
from scriptorium.session import materialise, table

#: Wider than the defaults (0.45 and a cosine of 0.62), within which these vectors have no neighbours.
NEAR, LEADER = 0.8, 0.3
TYPES = ["fact", "belief", "preference", "insight", "decision_heuristic", "experience"]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as statements of an index."""
    e = table(spark, sf_dir, "embeddings")
    status = F.when(F.col("vec_id") % 11 == 0, "historical").when(F.col("vec_id") % 11 == 1, "superseded").when(F.col("vec_id") % 11 == 2, "merged").otherwise("active")
    return e.select(
        "vec_id", "embedding", "label", F.get(F.array(*map(F.lit, TYPES)), (F.col("vec_id") % 6).cast("int")).alias("type"), status.alias("status"),
        F.when(F.col("vec_id") % 4 == 0, "public").otherwise("private").alias("sensitivity"), F.array(F.concat(F.lit("t"), "label")).alias("topics"),
        F.array(F.concat(F.lit("o"), F.col("vec_id") % 50)).alias("origins"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("vec_id").cast("int")).alias("date"),
    )


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6: three nearest active statements of the same sensitivity for each new one, nearer than NEAR."""
    s = statements(spark, sf_dir)
    return sim.top_k(s.where("status = 'active'"), s.where("vec_id % 100 = 0"), "vec_id", "embedding", 3, "sensitivity", NEAR)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of each conversation: the one with its number."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("vec_id")).distinct()
    return statements(spark, sf_dir).join(asked, "vec_id", "left_semi")


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clusters of at least four members from at least two origins, the 25 first by size; and all members of clusters."""
    s = statements(spark, sf_dir)
    c = sim.leader_clusters(s, "vec_id", "embedding", "sensitivity", LEADER).join(s.select(F.col("vec_id").alias("id"), "origins"), "id")
    c = materialise(c, "members")
    sized = c.groupBy("sensitivity", "leader").agg(F.count("*").alias("members"), F.count_distinct(F.get("origins", F.lit(0))).alias("n_origins"), F.sum("id").alias("ids")).where("members >= 4 and n_origins >= 2")
    return top_per(sized, ["sensitivity"], [F.desc("members"), "leader"], 25), c


def d4_leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)[0]


def d5_cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an insight of each cluster inherits: private if any member is, and up to 20 origins. Members support it
    (`d5_support`), so their ids are rows and not a list."""
    chosen, members = _clusters(spark, sf_dir)
    own = members.join(F.broadcast(chosen.select("sensitivity", "leader")), ["sensitivity", "leader"])  # 25 a store
    first = top_per(own.select("sensitivity", "leader", F.explode("origins").alias("origin")).distinct(), ["sensitivity", "leader"], ["origin"], 20)
    origins = first.groupBy("sensitivity", "leader").agg(F.array_join(F.sort_array(F.collect_list("origin")), ",").alias("origins"))
    private = own.groupBy("sensitivity", "leader").agg(F.max(F.when(F.col("sensitivity") == "private", 1).otherwise(0)).alias("private"), F.count("*").alias("support"))
    return private.join(origins, ["sensitivity", "leader"])


def d5_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members that support the insight of each cluster."""
    chosen, members = _clusters(spark, sf_dir)
    return members.join(F.broadcast(chosen.select("sensitivity", "leader")), ["sensitivity", "leader"]).select("sensitivity", "leader", "id")


def d6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).withColumn("distance", F.round("distance", 6))


def d7_not_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the three that is not born from the same origin."""
    n = _near(spark, sf_dir).where("query_id % 50 <> id % 50")
    return top_per(n, ["query_id"], ["rank"], 1).select("query_id", "id")


def d8_culprit_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours named in the turn's retrieval log (ids that 3 divides) come first."""
    return top_per(_near(spark, sf_dir), ["query_id"], [F.desc(F.col("id") % 3 == 0), "rank"], 1).select("query_id", "id")


def r1_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four nearest statements from both stores; historical ones only for past-framed queries."""
    s = statements(spark, sf_dir)
    q = s.where("vec_id % 100 = 0")
    parts = []
    for past in (True, False):
        ask = q.where((F.col("vec_id") % 200 == 0) == F.lit(past))
        allowed = s.where(F.col("status").isin("active", "historical") if past else F.col("status") == "active")
        parts += [sim.top_k(allowed.where(f"sensitivity = '{store}'"), ask, "vec_id", "embedding", 4) for store in ("private", "public")]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).drop("rank")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))
    return merged.withColumn("rank", best).where("rank <= 4").select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def r2_episodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statements(spark, sf_dir)
    return sim.top_k(s.where("embedding is not null"), s.where("vec_id % 100 = 0"), "vec_id", "embedding", 3).withColumn("distance", F.round("distance", 6))


def r3_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged row a turn. Intent decides the store and how many: recalls read the raw chunks
    (every vector), questions of knowledge the active statements, and past-framed ones the historical too."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("intent", rules.route_intent(F.col("text")))
    past = (F.col("turn") % 5 == 4) | rules.past_framed(F.col("text"))  # every fifth question stands for a past-framed one
    store = F.when(F.col("intent") == "explicit_recall", "chunks").when(F.col("intent") == "knowledge", F.when(past, "all times").otherwise("now"))
    asked = materialise(c.select("conv_id", "turn", "intent", store.alias("store")), "asked")
    s = statements(spark, sf_dir)
    found = []
    for name, rows, k in (("chunks", s.where("embedding is not null"), 3), ("now", s.where("status = 'active'"), 4), ("all times", s.where("status in ('active', 'historical')"), 4)):
        queries = s.join(asked.where(F.col("store") == name).select(F.col("conv_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
        found.append(sim.top_k(rows, queries, "vec_id", "embedding", k).withColumn("of", F.lit(name)))
    best = found[0].unionByName(found[1]).unionByName(found[2])
    logged = asked.join(best, (F.col("conv_id") == F.col("query_id")) & (F.col("store") == F.col("of")), "left")
    return logged.groupBy("conv_id", "turn", "intent", "store").agg(F.count("id").alias("n"), F.round(F.min("distance"), 6).alias("best"), F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids"))  # four ids at most


def r4_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and heuristics by strength, insights above."""
    s = statements(spark, sf_dir).where("status = 'active'")
    kind = F.when(F.col("type").isin("belief", "preference", "insight"), "value").when(F.col("type") == "decision_heuristic", "heuristic")
    score = F.when(F.col("label") % 3 == 0, 2).when(F.col("label") % 3 == 1, 1).otherwise(0) + F.when(F.col("type") == "insight", 2).otherwise(0)
    return top_per(s.select("vec_id", kind.alias("kind"), score.alias("score")).where("kind is not null"), ["kind"], [F.desc("score"), "vec_id"], 8)


def r6_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 240 rows at indexes floor(i * n / 240)."""
    r = placed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").withColumnsRenamed({"_i": "i", "_n": "n"})
    return r.where("n <= 240 or ((i + 1) * 240 - 1) div n > (i * 240 - 1) div n or i = 0").select("doc_id")


def m2_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed outcomes after the clamp of the stricter tier."""
    s = statements(spark, sf_dir).select("vec_id", "date", rules.tier(F.col("type"), F.col("topics"), F.lit("")).alias("tier"))
    p = _near(spark, sf_dir).select(F.col("query_id").alias("new_id"), F.col("id").alias("old_id"))
    j = p.join(s.select(F.col("vec_id").alias("new_id"), F.col("tier").alias("new_tier")), "new_id").join(s.select(F.col("vec_id").alias("old_id"), F.col("tier").alias("old_tier")), "old_id")
    proposed = F.get(F.array(*map(F.lit, ["coexist", "augment", "evolve", "replace", "ask"])), ((F.col("new_id") + F.col("old_id")) % 5).cast("int"))
    tier = rules.stricter(F.col("new_tier"), F.col("old_tier"))
    out = rules.clamp_outcome(tier, proposed, (F.col("new_id") + F.col("old_id")) % 3 != 0, (F.col("old_id") % 100) / 100, F.col("new_id") > F.col("old_id"))
    return j.select("new_id", "old_id", tier.alias("tier"), out.alias("outcome"))


def _said(number: Column) -> Column:
    return F.concat(F.lit("statement "), number)


def m3_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements after the clamped outcomes: augment merges both into a new row with both as parents, evolve makes
    the old one historical with a period and records the change as an experience, replace supersedes it; nothing is
    deleted. Origins of both go to what is new."""
    cases = m2_clamped(spark, sf_dir)
    s = statements(spark, sf_dir)
    weight = F.when(F.col("outcome") == "augment", 3).when(F.col("outcome") == "replace", 2).when(F.col("outcome") == "evolve", 1).otherwise(0)
    by_old = cases.select(F.col("old_id").alias("vec_id"), weight.alias("w"), "new_id")
    by_new = cases.where("outcome = 'augment'").select(F.col("new_id").alias("vec_id"), F.lit(3).alias("w"), "new_id")
    worst = by_old.unionByName(by_new).groupBy("vec_id").agg(F.max("w").alias("w"), F.max(F.when(F.col("w") == 1, F.col("new_id"))).alias("by"))
    status = F.when(F.col("w") == 3, "merged").when(F.col("w") == 2, "superseded").when(F.col("w") == 1, "historical").otherwise(F.col("status"))
    period = F.when(F.col("w") == 1, F.concat(F.lit("until "), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("by").cast("int")), "yyyy-MM")))
    old = s.join(worst, "vec_id", "left").select(F.col("vec_id").cast("string").alias("id"), status.alias("status"), period.alias("period"), "type", _said(F.col("vec_id")).alias("text"), F.array_join("origins", ",").alias("origins"), F.lit(None).cast("string").alias("parents"))
    of = lambda k: s.select(F.col("vec_id").alias(f"{k}_id"), F.col("type").alias(f"{k}_type"), F.col("origins").alias(f"{k}_origins"))
    both = cases.where("outcome in ('augment', 'evolve')").join(of("old"), "old_id").join(of("new"), "new_id")
    grown = F.col("outcome") == "augment"
    before = F.concat(F.lit('This changed over time: previously "'), _said(F.col("old_id")), F.lit('"; now "'), _said(F.col("new_id")), F.lit('".'))
    new = both.select(
        F.concat("old_id", F.when(grown, "+").otherwise(">"), "new_id").alias("id"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("period"), F.when(grown, F.col("old_type")).otherwise("experience").alias("type"),
        F.when(grown, F.concat_ws(" ", _said(F.col("old_id")), _said(F.col("new_id")))).otherwise(before).alias("text"), F.array_join(F.array_distinct(F.concat("old_origins", "new_origins")), ",").alias("origins"), F.when(grown, F.concat_ws(",", "old_id", "new_id")).alias("parents"),
    )
    return old.unionByName(new)


def m6_undistilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins of documents that no statement comes from yet."""
    known = statements(spark, sf_dir).where("vec_id % 2 = 0").select(F.explode("origins").alias("origin"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("o"), F.col("doc_id") % 60).alias("origin")).distinct()
    return d.join(known, "origin", "left_anti")


def m7_born_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).where(F.arrays_overlap("origins", F.array(F.lit("o3"), F.lit("o17")))).select("vec_id", "type")


def m8_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statements(spark, sf_dir)
    by_type = s.groupBy(F.concat(F.lit("statement:"), "type").alias("what")).agg(F.count("*").alias("n"))
    topics = s.select(F.explode("topics").alias("t")).agg(F.count_distinct("t").alias("n")).select(F.lit("topics").alias("what"), "n")
    chunks = table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("chunk:"), "lang").alias("what")).agg(F.count("*").alias("n"))
    cases = table(spark, sf_dir, "events").where("event_type in ('click', 'error')").agg(F.count("*").alias("cases"), F.count_if(F.col("event_type") == "error").alias("open"))
    cases = cases.select(F.explode(F.array(F.struct(F.lit("cases").alias("what"), F.col("cases").alias("n")), F.struct(F.lit("cases open").alias("what"), F.col("open").alias("n")))).alias("x")).select("x.*")
    return by_type.unionByName(topics).unionByName(chunks).unionByName(cases)


def m9_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth from the even to all documents and events: chunks per source, cases raised and open (each
    floored at 0), and the topics (first words) that are new, the first 20 of them."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    kinds = [d.select(F.concat(F.lit("chunks:"), "source").alias("what"), (F.col("doc_id") % 2 == 0).alias("old")), e.where("event_type in ('click', 'error')").select(F.lit("cases raised").alias("what"), (F.col("event_id") % 2 == 0).alias("old")), e.where("event_type = 'error'").select(F.lit("cases open").alias("what"), (F.col("event_id") % 2 == 0).alias("old"))]
    grown = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("what").agg(F.greatest(F.lit(0).cast("long"), F.count("*") - F.count_if("old")).alias("n"))
    topics = d.groupBy(F.lower(F.get(F.split("text", " "), F.lit(0))).alias("t")).agg(F.bool_or(F.col("doc_id") % 2 == 0).alias("old"))
    new = topics.where("not old").orderBy("t").limit(20).select(F.concat(F.lit("topic:"), "t").alias("what"), F.lit(1).cast("long").alias("n"))
    return grown.unionByName(new)


def weak_retrievals(turns: DataFrame, best: DataFrame, threshold: float = 0.62) -> DataFrame:
    """topic, weak: turns (query_id, text) about a personal topic without a hit (query_id, distance) or
    with one beyond the threshold."""
    missed = turns.join(best, "query_id", "left").where(F.col("distance").isNull() | (F.col("distance") > threshold))
    return missed.where(rules.personal_topic(F.col("text"))).groupBy(rules.topic_of(F.col("text")).alias("topic")).agg(F.count("*").alias("weak"))


def m13_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak retrievals by topic; ready to invite from three on, if fewer than two invitations were
    ignored and none went out in the last 24 hours. The vectors lie close together, so 0.03 is weak here."""
    s = statements(spark, sf_dir)
    best = sim.top_k(s.where("status = 'active'"), _asked(spark, sf_dir), "vec_id", "embedding", 1).select("query_id", "distance")
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    about = F.get(F.array(*map(F.lit, ["my family ", "music and money ", "the road "])), (F.col("turn") % 3).cast("int"))
    turns = c.select(F.col("conv_id").alias("query_id"), F.concat(about, F.get(F.split("text", " "), F.lit(0))).alias("text"), "turn")
    state = turns.groupBy(rules.topic_of(F.col("text")).alias("topic")).agg(F.count_if(F.col("turn") % 4 == 0).alias("ignored"), F.min(F.col("query_id") % 72).alias("hours"))
    out = weak_retrievals(turns, best, 0.03).join(state, "topic")
    return out.select("topic", "weak", "ignored", ((F.col("weak") >= 3) & (F.col("ignored") < 2) & (F.col("hours") >= 24)).alias("ready"))


_S = f"""s AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, {TYPES}[vec_id % 6 + 1] AS type, CASE vec_id % 11 WHEN 0 THEN 'historical' WHEN 1 THEN 'superseded' WHEN 2 THEN 'merged' ELSE 'active' END AS status,
CASE WHEN vec_id % 4 = 0 THEN 'public' ELSE 'private' END AS sensitivity, 't' || label AS topic, 'o' || vec_id % 50 AS origin FROM embeddings)"""
_NEAR = f"""{_S}, near AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_distance(q.e, c.e) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(q.e, c.e), 9), c.vec_id) AS rank
FROM s q JOIN s c ON q.vec_id <> c.vec_id AND q.sensitivity = c.sensitivity WHERE q.vec_id % 100 = 0 AND c.status = 'active' AND list_cosine_distance(q.e, c.e) < {NEAR} QUALIFY rank <= 3)"""
_TIER = "CASE WHEN {t} IN ('insight', 'decision_heuristic') THEN 2 WHEN {t} IN ('belief', 'preference') THEN 1 ELSE 0 END"
_CASES = f"""{_NEAR}, p AS (SELECT query_id AS new_id, id AS old_id, greatest({_TIER.format(t='n.type')}, {_TIER.format(t='o.type')}) AS t, CASE WHEN (query_id + id) % 3 = 0 THEN 'coexist' ELSE ['coexist', 'augment', 'evolve', 'replace', 'ask'][(query_id + id) % 5 + 1] END AS o, (id % 100) / 100.0 >= 0.75 AS sure, query_id > id AS newer
FROM near JOIN s n ON n.vec_id = query_id JOIN s o ON o.vec_id = id),
cases AS (SELECT new_id, old_id, ['mutable', 'position', 'core'][t + 1] AS tier, CASE t WHEN 2 THEN CASE WHEN o = 'coexist' AND sure THEN o ELSE 'ask' END WHEN 1 THEN CASE WHEN o = 'coexist' OR (o = 'augment' AND sure) THEN o ELSE 'ask' END ELSE CASE WHEN o IN ('ask', 'augment') THEN CASE WHEN newer THEN 'evolve' ELSE 'coexist' END ELSE o END END AS outcome FROM p)"""
_BEST = "b AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_distance(q.e, c.e) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(q.e, c.e), 9), c.vec_id) AS rank FROM s q JOIN s c ON q.vec_id <> c.vec_id WHERE {w} QUALIFY rank <= {k})"
_INTENT = f"CASE WHEN {found('trim(text)', *rules.RECALL)} THEN 'explicit_recall' WHEN {found('trim(text)', *rules.SMALLTALK)} OR ({WORDS} <= 3 AND NOT contains(text, '?')) THEN 'smalltalk' ELSE 'knowledge' END"
_TOPIC = f"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda w: len(w) > 3 AND w NOT IN ({', '.join(repr(w) for w in rules.TOPIC_STOP)}))[1:3]"

_TOP = f"""WITH RECURSIVE {_S}, p AS (SELECT a.sensitivity AS sensitivity, a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.sensitivity = b.sensitivity AND a.vec_id < b.vec_id AND list_cosine_distance(a.e, b.e) < 1 - {LEADER} + 1e-12), m AS (SELECT b, list(a) AS near, row_number() OVER (ORDER BY b) AS i FROM p GROUP BY b),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT m.i, CASE WHEN len(list_filter(near, lambda y: NOT list_contains(gone, y))) > 0 THEN list_append(gone, m.b) ELSE gone END FROM r JOIN m ON m.i = r.i + 1), g AS (SELECT unnest(gone) AS id FROM r WHERE i = (SELECT max(i) FROM r)),
c AS (SELECT sensitivity, vec_id AS id, vec_id AS leader FROM s WHERE vec_id NOT IN (SELECT id FROM g) UNION ALL SELECT sensitivity, b, min(a) FROM p WHERE b IN (SELECT id FROM g) AND a NOT IN (SELECT id FROM g) GROUP BY 1, 2),
z AS (SELECT c.sensitivity AS sensitivity, leader, count(*) AS members, count(DISTINCT origin) AS n_origins, CAST(sum(id) AS BIGINT) AS ids FROM c JOIN s ON vec_id = id GROUP BY 1, 2), top AS (SELECT * FROM z WHERE members >= 4 AND n_origins >= 2 QUALIFY row_number() OVER (PARTITION BY sensitivity ORDER BY members DESC, leader) <= 25)"""

QUERIES = {f.__name__: f for f in (d4_leader_clusters, d5_cluster_rollup, d5_support, d6_neighbours, d7_not_siblings, d8_culprit_first, r1_statements, r2_episodic, r3_routing, r4_ranked, r6_even_sample, m2_clamped, m3_applied, m6_undistilled, m7_born_from, m8_snapshot, m9_snapshot_diff, m13_gaps)}
ORACLE = {
    "d4_leader_clusters": f"{_TOP} SELECT * FROM top",
    "d5_cluster_rollup": f"{_TOP}, own AS (SELECT sensitivity, leader, id, origin FROM c JOIN top USING (sensitivity, leader) JOIN (SELECT vec_id AS id, origin FROM s) USING (id)), each AS (SELECT DISTINCT sensitivity, leader, origin FROM own), listed AS (SELECT sensitivity, leader, string_agg(origin, ',' ORDER BY origin) AS origins FROM (SELECT *, row_number() OVER (PARTITION BY sensitivity, leader ORDER BY origin) AS i FROM each) WHERE i <= 20 GROUP BY 1, 2) SELECT sensitivity, leader, max(CASE WHEN sensitivity = 'private' THEN 1 ELSE 0 END) AS private, count(*) AS support, any_value(origins) AS origins FROM own JOIN listed USING (sensitivity, leader) GROUP BY 1, 2",
    "d5_support": f"{_TOP} SELECT sensitivity, leader, id FROM c JOIN top USING (sensitivity, leader)",
    "d6_neighbours": f"WITH {_NEAR} SELECT query_id, rank, id, round(distance, 6) AS distance FROM near",
    "d7_not_siblings": f"WITH {_NEAR} SELECT query_id, id FROM near WHERE query_id % 50 <> id % 50 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1",
    "d8_culprit_first": f"WITH {_NEAR} SELECT query_id, id FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id % 3 = 0 DESC, rank) = 1",
    "r1_statements": f"WITH {_S}, {_BEST.format(w='q.vec_id % 100 = 0 AND c.status IN (CASE WHEN q.vec_id % 200 = 0 THEN $$historical$$ ELSE $$active$$ END, $$active$$)', k=4)} SELECT query_id, rank, id, round(distance, 6) AS distance FROM b",
    "r2_episodic": f"WITH {_S}, {_BEST.format(w='q.vec_id % 100 = 0', k=3)} SELECT query_id, rank, id, round(distance, 6) AS distance FROM b",
    "r3_routing": f"""WITH {_S}, c AS (SELECT conv_id, turn, {_INTENT} AS intent, turn % 5 = 4 OR {found('trim(text)', *rules.PAST_FRAMED)} AS past FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, intent, CASE intent WHEN 'explicit_recall' THEN 'chunks' WHEN 'knowledge' THEN CASE WHEN past THEN 'all times' ELSE 'now' END END AS store FROM c),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.status AS status, list_cosine_distance(q.e, c.e) AS distance FROM s q JOIN s c ON q.vec_id <> c.vec_id WHERE q.vec_id IN (SELECT conv_id FROM a)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, store ORDER BY round(distance, 9), id) AS rank FROM (SELECT *, 'chunks' AS store FROM d UNION ALL SELECT *, 'now' FROM d WHERE status = 'active' UNION ALL SELECT *, 'all times' FROM d WHERE status IN ('active', 'historical')))
SELECT conv_id, turn, intent, a.store AS store, count(id) AS n, round(min(distance), 6) AS best, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids FROM a LEFT JOIN b ON query_id = conv_id AND b.store = a.store AND rank <= CASE a.store WHEN 'chunks' THEN 3 ELSE 4 END GROUP BY ALL""",
    "r4_ranked": f"WITH {_S}, k AS (SELECT vec_id, CASE WHEN type = 'decision_heuristic' THEN 'heuristic' ELSE 'value' END AS kind, CASE label % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN type = 'insight' THEN 2 ELSE 0 END AS score FROM s WHERE status = 'active' AND type IN ('belief', 'preference', 'insight', 'decision_heuristic')) SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, vec_id) <= 8",
    "r6_even_sample": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE n <= 240 OR i IN (SELECT k * (SELECT max(n) FROM r) // 240 FROM range(240) t(k))",
    "m2_clamped": f"WITH {_CASES} SELECT * FROM cases",
    "m3_applied": f"""WITH {_CASES}, w AS (SELECT old_id AS vec_id, CASE outcome WHEN 'augment' THEN 3 WHEN 'replace' THEN 2 WHEN 'evolve' THEN 1 ELSE 0 END AS w, new_id FROM cases UNION ALL SELECT new_id, 3, new_id FROM cases WHERE outcome = 'augment'),
m AS (SELECT vec_id, max(w) AS w, max(new_id) FILTER (WHERE w = 1) AS by_ FROM w GROUP BY vec_id)
SELECT CAST(vec_id AS VARCHAR) AS id, CASE w WHEN 3 THEN 'merged' WHEN 2 THEN 'superseded' WHEN 1 THEN 'historical' ELSE status END AS status, CASE WHEN w = 1 THEN 'until ' || strftime(DATE '2024-01-01' + CAST(by_ AS INT), '%Y-%m') END AS period, type, 'statement ' || vec_id AS text, origin AS origins, NULL AS parents FROM s LEFT JOIN m USING (vec_id)
UNION ALL SELECT old_id || CASE outcome WHEN 'augment' THEN '+' ELSE '>' END || new_id, 'active', NULL, CASE outcome WHEN 'augment' THEN o.type ELSE 'experience' END, CASE outcome WHEN 'augment' THEN 'statement ' || old_id || ' statement ' || new_id ELSE 'This changed over time: previously "statement ' || old_id || '"; now "statement ' || new_id || '".' END, CASE WHEN o.origin = n.origin THEN o.origin ELSE o.origin || ',' || n.origin END, CASE outcome WHEN 'augment' THEN old_id || ',' || new_id END FROM cases JOIN s o ON o.vec_id = old_id JOIN s n ON n.vec_id = new_id WHERE outcome IN ('augment', 'evolve')""",
    "m6_undistilled": f"WITH {_S} SELECT DISTINCT 'o' || doc_id % 60 AS origin FROM documents WHERE 'o' || doc_id % 60 NOT IN (SELECT origin FROM s WHERE vec_id % 2 = 0)",
    "m7_born_from": f"WITH {_S} SELECT vec_id, type FROM s WHERE origin IN ('o3', 'o17')",
    "m8_snapshot": f"WITH {_S} SELECT 'statement:' || type AS what, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'topics', count(DISTINCT topic) FROM s UNION ALL SELECT 'chunk:' || lang, count(*) FROM documents GROUP BY 1 UNION ALL SELECT 'cases', count(*) FROM events WHERE event_type IN ('click', 'error') UNION ALL SELECT 'cases open', count(*) FROM events WHERE event_type = 'error'",
    "m9_snapshot_diff": "WITH k AS (SELECT 'chunks:' || source AS what, doc_id % 2 = 0 AS old FROM documents UNION ALL SELECT 'cases raised', event_id % 2 = 0 FROM events WHERE event_type IN ('click', 'error') UNION ALL SELECT 'cases open', event_id % 2 = 0 FROM events WHERE event_type = 'error'), t AS (SELECT lower(string_split(text, ' ')[1]) AS t FROM documents GROUP BY 1 HAVING NOT bool_or(doc_id % 2 = 0) ORDER BY t LIMIT 20) SELECT what, greatest(0, count(*) - count(*) FILTER (WHERE old)) AS n FROM k GROUP BY 1 UNION ALL SELECT 'topic:' || t, 1 FROM t",
    "m13_gaps": f"""WITH {_S}, {_BEST.format(w='c.status = $$active$$ AND q.vec_id IN (SELECT conv_id FROM conversations WHERE role = $$user$$)', k=1)}, c AS (SELECT conv_id, turn, ['my family ', 'music and money ', 'the road '][turn % 3 + 1] || string_split(text, ' ')[1] AS text FROM conversations WHERE role = 'user'),
w AS (SELECT conv_id, turn, text, {_TOPIC} AS ws FROM c), t AS (SELECT conv_id, turn, text, CASE WHEN len(ws) = 0 THEN 'general' ELSE array_to_string(ws, ' ') END AS topic FROM w), st AS (SELECT topic, count(*) FILTER (WHERE turn % 4 = 0) AS ignored, min(conv_id % 72) AS hours FROM t GROUP BY 1),
k AS (SELECT topic, count(*) AS weak FROM t LEFT JOIN b ON query_id = conv_id WHERE (distance IS NULL OR distance > 0.03) AND {found('text', rules.PERSONAL_TOPIC)} GROUP BY 1) SELECT topic, weak, ignored, weak >= 3 AND ignored < 2 AND hours >= 24 AS ready FROM k JOIN st USING (topic)""",
}
