"""Queries for the remaining sources, batches, gates and validations, and the caller-supplied functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import redaction, rules
from scriptorium.functions import text as tx
from scriptorium.functions import udfs
from scriptorium.operators import chunk, holdout, pack
from scriptorium.operators.places import placed
from scriptorium.operators.style import top_per
from scriptorium.plans.tables import questions, responses
from scriptorium.plans.text_rules import NORMAL, TOK_LIST, WORDS, found, redacted_sql
from scriptorium.session import ship, spread, table


def s3_project_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description header only where there is one, and non-blank docs, exploded from JSON."""
    d = table(spark, sf_dir, "documents")
    project = F.struct(F.col("source").alias("name"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("").alias("description"), F.array(F.struct(F.lit("a").alias("filename"), F.col("text").alias("content")), F.struct(F.lit("b").alias("filename"), F.lit("  ").alias("content"))).alias("docs"))
    p = d.select("doc_id", F.from_json(F.to_json(project), "struct<name:string,description:string,docs:array<struct<filename:string,content:string>>>").alias("p"))
    head = p.where("trim(p.description) <> ''").select("doc_id", F.lit("description").alias("part"), F.concat("p.name", F.lit(": "), "p.description").alias("text"))
    docs = p.select("doc_id", F.explode("p.docs").alias("f")).where("trim(f.content) <> ''").select("doc_id", F.col("f.filename").alias("part"), F.col("f.content").alias("text"))
    return head.unionByName(docs)


def s4_export_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of an export from the head of its file; what is unknown or corrupt is skipped with a reason."""
    c = table(spark, sf_dir, "conversations")
    head = F.substring(F.when(F.col("turn") % 4 == 0, F.concat(F.lit('[{"uuid": 1, "chat_messages": ['), "text")).when(F.col("turn") % 4 == 1, F.concat(F.lit('[{"mapping": {'), "text")).when(F.col("turn") % 4 == 2, "{}").otherwise(F.col("text")), 1, 4000)
    kind = F.when(head.contains('"chat_messages"'), "a").when(head.contains('"mapping"'), "b")
    reason = F.when(kind.isNotNull(), None).when(F.ltrim(head).rlike("\\A[\\[{]"), "unknown format").otherwise("not JSON")
    return c.select("conv_id", "turn", kind.alias("format"), reason.alias("skipped"))


_MANIFEST = "struct<session:bigint,responses:array<struct<question:bigint,prompt:string,kind:string,validation:boolean,transcript:string,audio_cents:bigint>>>"


def interview_rows(df: DataFrame, json_col: str) -> DataFrame:
    """session, route, question, text, audio_cents of each response of a manifest: validation questions go
    to the holdout only, others that are not spoken or blank are left out with the reason."""
    m = df.select(F.from_json(json_col, _MANIFEST).alias("m")).select("m.session", F.explode("m.responses").alias("r"))
    route = F.when(F.col("r.validation"), "holdout").when(F.col("r.kind") != "voice", "not voice").when(F.trim(F.coalesce("r.transcript", F.lit(""))) == "", "blank").otherwise("item")
    return m.select("session", route.alias("route"), F.col("r.question").alias("question"), F.concat_ws("\n", "r.prompt", "r.transcript").alias("text"), "r.audio_cents")


def s6_interview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses nested to a manifest a session and read back; minutes (to a tenth) add up over what is kept."""
    j = responses(spark, sf_dir).join(questions(spark, sf_dir), "question_id")
    one = F.struct(F.col("question_id").alias("question"), "prompt", F.when(F.col("skipped"), "text").otherwise("voice").alias("kind"), F.col("sealed").alias("validation"), F.when(F.col("event_id") % 10 == 0, " ").otherwise(F.concat(F.lit("said "), "event_id")).alias("transcript"), F.round(F.col("audio_sec") * 100).cast("long").alias("audio_cents"))
    nested = j.groupBy("session_id").agg(F.to_json(F.struct(F.first("session_id").alias("session"), F.collect_list(one).alias("responses"))).alias("json"))  # a questionnaire at most
    rows = interview_rows(nested, "json")
    cents = F.sum("audio_cents")
    return rows.groupBy("session", "route").agg(F.count("*").alias("n"), F.sum("question").alias("questions"), F.sum(F.length("text")).alias("chars"), (F.floor((cents * 10 + 3000) / 6000) / 10).alias("minutes"))


def s7_session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries against archive entries: missing, unsupported and empty ones get a reason."""
    d = table(spark, sf_dir, "documents")
    manifest = d.select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 5 == 0, ".png").otherwise(".md")).alias("name"))
    archive = manifest.where("doc_id % 4 <> 1").join(d.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text")).alias("body")), "doc_id").select("name", "body")
    j = manifest.join(archive, "name", "left")
    reason = F.when(F.col("body").isNull(), "missing").when(F.col("name").endswith(".png"), "unsupported").when(F.trim("body") == "", "empty")
    return j.select("doc_id", "name", reason.alias("skipped"))


def k2_sealed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed texts, redacted, written to a path of their own and read back."""
    from scriptorium.session import materialise

    return materialise(redaction.redact(table(spark, sf_dir, "benchmark")).select("item_id", "redacted"), "holdout")


def k3_selective_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources rebuilt in place; the saved rows of the others stay."""
    import uuid

    from scriptorium.session import shared_dir
    from scriptorium.sources.sinks import rebuild_sources

    path = f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    rebuild_sources(d, "source", path)
    rebuild_sources(d.where("source in ('src2', 'src5')").withColumn("n_chars", F.lit(0).cast("long")), "source", path)
    return spark.read.parquet(path).select("doc_id", "n_chars", F.col("source").cast("string").alias("source"))


def c3_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows with content ids and the metadata of their item."""
    d = table(spark, sf_dir, "documents").withColumn("item", tx.item_id(F.lit("work_file"), F.col("source"), F.col("text")))
    rows = chunk.chunk_rows(d.withColumn("key", F.struct("doc_id", "source", "item")), "key", "text")
    return rows.select("id.doc_id", "id.source", tx.chunk_id(F.col("id.item"), F.col("number"), F.col("of")).alias("chunk_id"), F.sha2("text", 256).alias("sha256"))


def c5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items packed in order into requests of at most ten items and 6,000 characters."""
    return pack.request_batches(table(spark, sf_dir, "documents"), "source", "doc_id", F.length("text"))


def l4_gram_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.word_grams(table(spark, sf_dir, "benchmark"), [], "text").select("gram").distinct()


def l8_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction and meta turns whose text is in a store: in a document, in another turn or in a statement. Every third user
    turn is made a correction, and statements of every fifth conversation quote its turns, as a leak would."""
    c = table(spark, sf_dir, "conversations")
    corrected = (F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 3 == 0)
    c = c.select("conv_id", "role", F.when(corrected, F.concat(F.lit("No, that's wrong. "), "text")).otherwise(F.col("text")).alias("text"), F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("id"), "turn")
    of = rules.event_intent(F.col("text"), F.lit("text"), F.lit(0.0), F.col("turn") > 0, F.lit(None).cast("string"))
    notes = c.where("role = 'user'").withColumn("intent", of["intent"]).where("intent in ('correction', 'meta')")
    quoted = c.where("role = 'user' and conv_id % 5 = 0").select(F.concat_ws(":", F.lit("statement"), "conv_id", "turn").alias("id"), F.concat(F.lit("They said:  "), "text", F.lit(" (noted)")).alias("text"))
    documents = spread(table(spark, sf_dir, "documents").select(F.concat_ws(":", F.lit("document"), "doc_id").alias("id"), "text"), "id")
    stores = c.join(notes.select("id"), "id", "left_anti").select("id", "text").unionByName(documents).unionByName(quoted)
    return holdout.sealed_matches(stores, "id", "text", notes, "id", "text").select(F.col("id").alias("store_id"), F.col("sid").alias("turn_id"))


def p9_own_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken from interviews, written from chats and files; project documents stay out."""
    d = table(spark, sf_dir, "documents")
    kind = F.get(F.array(*map(F.lit, ["interview", "chat_export", "work_file", "project_doc"])), (F.col("doc_id") % 4).cast("int"))
    mode = F.when(kind == "interview", "spoken").when(kind.isin("chat_export", "work_file"), "written")
    return d.select("source", mode.alias("mode"), "n_chars").where("mode is not null").groupBy("source", "mode").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def _judged_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of model answers with the first check that they fail; a strength that is none is dropped."""
    c = table(spark, sf_dir, "conversations")
    answer = F.to_json(F.struct(F.array(F.struct((F.col("conv_id") % 120).alias("source_id"), F.col("text"), F.get(F.array(*map(F.lit, ["fact", "belief", "odd", "insight"])), (F.col("turn") % 4).cast("int")).alias("type"), F.get(F.array(*map(F.lit, ["strong", "weak", "very", "moderate"])), (F.col("conv_id") % 5).cast("int")).alias("strength"), F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D")).alias("topics"))).alias("statements")))
    parsed = c.select("conv_id", "turn", F.from_json(answer, "struct<statements:array<struct<source_id:bigint,text:string,type:string,strength:string,topics:array<string>>>>").alias("a")).select("conv_id", "turn", F.explode("a.statements").alias("s"))
    known = table(spark, sf_dir, "documents").where("lang <> 'es'").select(F.col("doc_id").alias("source_id"), F.lit(True).alias("known"))
    j = parsed.select("conv_id", "turn", "s.*").join(known, "source_id", "left")
    verdict = F.when(F.col("known").isNull(), "unknown source").when(F.trim("text") == "", "empty").when(~F.col("type").isin("fact", "belief", "preference", "insight", "decision_heuristic", "experience"), "bad type").when(F.size(rules.lint_reasons(F.col("text"))) > 0, "lint").otherwise("stored")
    strength = F.when(F.col("strength").isin("strong", "moderate", "weak"), F.col("strength"))
    return j.select("conv_id", "turn", verdict.alias("verdict"), strength.alias("strength"), F.array_join(F.transform(F.slice("topics", 1, 3), F.lower), ",").alias("topics"))


def p19_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of model answers: stored or rejected, by the first check that fails."""
    return _judged_statements(spark, sf_dir)


def p19_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run stored and rejected, by reason, and the strengths of what it stored."""
    v = _judged_statements(spark, sf_dir)
    strength = F.when(F.col("verdict") == "stored", F.coalesce("strength", F.lit("none")))
    return v.groupBy("verdict", strength.alias("strength")).agg(F.count("*").alias("n"))


def p21_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", udfs.token_counter(chunk.count_tokens)(F.col("text")).alias("tokens"))


def r5_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exemplars per subject: rarely asked, by style, two a topic, modes in balance, twelve at most."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("subject"), "doc_id", (F.col("n_chars") % 11).alias("style"), (F.col("doc_id") % 11).alias("asked"), F.col("source").alias("topic"), F.when(F.col("doc_id") % 2 == 0, "spoken").otherwise("written").alias("mode"))
    return pack.pick_exemplars(d, "subject", "doc_id")


def r7_correction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest four turns of a conversation, then those of 20 to 140 words."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return top_per(c, ["conv_id"], [F.desc("turn")], 4).where(tx.word_count(F.col("text")).between(20, 140)).select("conv_id", "turn")


def m12_ship_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    before, after = (F.count_if((F.col("event_id") % 2 == k) & (F.col("event_type") == "view")) for k in (0, 1))
    return e.groupBy("user_id").agg(before.alias("before"), after.alias("after")).withColumn("ship", F.col("after") >= F.col("before"))


def m14_gap_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps are the topics of the person's turns. An invitation (a turn of the assistant on the topic) is stamped and raises
    `ignored`; an answer (the first turn of a conversation) resets the topics that contain its first word."""
    c = table(spark, sf_dir, "conversations").withColumn("topic", rules.topic_of(F.col("text")))
    gaps = c.where("role = 'user'").select("topic").distinct()
    asked = c.where("role = 'assistant'").select(F.explode(F.split("topic", " ")).alias("word"), (F.col("conv_id") * 1000 + F.col("turn")).alias("stamp")).distinct()
    answers = c.where("role = 'user' and turn = 0").select(F.split("topic", " ")[0].alias("word")).distinct().withColumn("hit", F.lit(1))
    words = gaps.select("topic", F.explode(F.array_distinct(F.split("topic", " "))).alias("word"))
    stamps = asked.groupBy("word").agg(F.count("*").alias("times"), F.max("stamp").alias("last"))  # by first word of the gap
    first = gaps.withColumn("word", F.split("topic", " ")[0]).join(stamps, "word", "left").select("topic", F.coalesce("times", F.lit(0).cast("long")).alias("times"), F.col("last").alias("last_invited"))
    hit = words.join(answers, "word").select("topic").distinct().withColumn("answered", F.lit(True))
    return first.join(hit, "topic", "left").select("topic", F.when(F.col("answered"), 0).otherwise(F.col("times")).cast("long").alias("ignored"), "last_invited")


def m17_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question changes module only where number and start of the prompt fit."""
    q = questions(spark, sf_dir)
    change = q.where("question_id % 2 = 0").select("question_id", F.when(F.col("question_id") % 4 == 0, F.substring("prompt", 1, 10)).otherwise("other").alias("expected"), F.lit(9).cast("long").alias("to"))
    j = q.join(change, "question_id", "left")
    fits = F.coalesce(F.startswith(F.col("prompt"), F.col("expected")), F.lit(False))
    return j.select("question_id", F.when(fits, F.col("to")).otherwise(F.col("module")).alias("module"), (F.col("expected").isNotNull() & ~fits).alias("skipped"))


def m17_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New questions go behind the largest number there is, in the order in which they come; those whose prompt is known only
    have their module affirmed. The last row counts what was appended, affirmed and skipped by the guard."""
    q = questions(spark, sf_dir)
    came = table(spark, sf_dir, "conversations").where("role = 'user' and turn = 0").groupBy(F.col("text").alias("prompt")).agg(F.min("conv_id").alias("came"))
    came = came.unionByName(q.where("module = 4").groupBy("prompt").agg((F.min("question_id") + 1_000_000_000).alias("came"))).groupBy("prompt").agg(F.min("came").alias("came"))
    j = came.join(q.groupBy("prompt").agg(F.min("question_id").alias("known")), "prompt", "left")
    top = q.agg(F.max("question_id").alias("top"))  # one row
    new = placed(j.where("known is null"), "came").join(F.broadcast(top)).select(F.lit("appended").alias("what"), (F.col("top") + 1 + F.col("_i")).alias("number"), F.sha2("prompt", 256).alias("of"))
    known = j.where("known is not null").select(F.lit("affirmed").alias("what"), F.col("known").alias("number"), F.sha2("prompt", 256).alias("of"))
    skipped = m17_reassign(spark, sf_dir).where("skipped").agg(F.lit("guard skipped").alias("what"), F.count("*").alias("number"), F.lit(None).cast("string").alias("of"))
    return new.unionByName(known).unionByName(skipped)


def v5_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training clips by section: sealed ones out, reviewed ones only, reasons counted."""
    j = responses(spark, sf_dir).join(questions(spark, sf_dir), "question_id")
    reason = F.when(F.col("sealed"), "sealed").when(F.col("skipped"), "skipped").when(F.col("event_id") % 3 == 0, "not reviewed").when(F.col("audio_sec") < 3, "too short").otherwise("kept")
    return j.groupBy("module", reason.alias("outcome")).agg(F.count("*").alias("clips"), F.sum(F.round(F.col("audio_sec") * 100).cast("long")).alias("audio_cents"))


def v5_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset a session: clips kept, the last tenth of them (three at least) held back, drops by reason, and whether it is
    built: not without consent, and not under twenty minutes. Transcripts that nobody reviewed stay out unless
    the session overrides that (every fifth does). Recordings last up to half a minute for each second of the events."""
    j = responses(spark, sf_dir).join(questions(spark, sf_dir), "question_id").withColumn("audio_sec", (1 + F.col("session_id") % 30) * F.col("audio_sec"))
    reviewed = (F.col("event_id") % 3 != 0) | (F.col("session_id") % 5 == 0)
    outcome = F.when(F.col("sealed"), "sealed").when(F.col("skipped"), "skipped").when(~reviewed, "not reviewed").when(F.col("audio_sec") < 3, "too short").otherwise("kept")
    own = Window.partitionBy("session_id", "outcome")  # a questionnaire at most
    ranked = j.withColumn("outcome", outcome).select("session_id", "outcome", "audio_sec", F.row_number().over(own.orderBy(F.desc("question_id"))).alias("r"), F.count("*").over(own).alias("n"))
    kept = F.col("outcome") == "kept"
    held = F.count_if(kept & (F.col("r") <= F.greatest(F.lit(3), F.floor(F.col("n") * 0.1))))
    cents = F.coalesce(F.sum(F.when(kept, F.round(F.col("audio_sec") * 100).cast("long"))), F.lit(0).cast("long"))
    dropped = [F.count_if(F.col("outcome") == name).alias(name.replace(" ", "_")) for name in ("not reviewed", "too short")]
    s = ranked.groupBy("session_id").agg(F.count_if(kept).alias("clips"), held.alias("held_back"), cents.alias("audio_cents"), *dropped)
    status = F.when(F.col("session_id") % 7 == 0, "no consent").when(F.col("audio_cents") < 20 * 60 * 100, "too short").otherwise("built")
    return s.withColumn("status", status)


def u5_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker as a table function, joined laterally: number, count and size of each chunk."""
    ship(spark)
    made = udfs.chunk_table(chunk.chunks)(F.col("text").outer())
    return table(spark, sf_dir, "documents").select("doc_id", "text").lateralJoin(made).select("doc_id", "number", "of", F.length("chunk").cast("long").alias("chars"))


def u1_test_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic unit vector of each text; its size, norm and first component."""
    ship(spark)
    v = table(spark, sf_dir, "documents").select("doc_id", udfs.test_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("size"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("norm"), F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"))


def p12_past_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.past_framed(F.col("text")).alias("past_framed"))


def u3_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's embedding function; here two counts of characters."""
    import numpy as np

    ship(spark)  # batches of few rows
    made = udfs.embedder(lambda texts: np.array([[len(t), t.count("e")] for t in texts]))(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("v")).select("doc_id", F.get("v", F.lit(0)).cast("long").alias("chars"), F.get("v", F.lit(1)).cast("long").alias("es"))


def u4_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's completion function; here the prompt backwards."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return udfs.completions(c, "text", lambda prompts: [p[::-1] for p in prompts]).select("conv_id", "turn", "answer")


def w7_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that don't parse are marked with a reason; the others go on."""
    e = table(spark, sf_dir, "events").withColumn("raw", F.when(F.col("event_id") % 13 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")))
    k = F.try_variant_get(F.try_parse_json("raw"), "$.k", "long")
    return e.select("event_id", k.alias("k"), F.when(k.isNull(), "corrupt").otherwise("ok").alias("status"))


QUERIES = {f.__name__: f for f in (s3_project_docs, s4_export_format, s6_interview, s7_session_files, k2_sealed_write, k3_selective_rebuild, c3_chunk_rows, c5_batches, l4_gram_set, l8_firewall, p9_own_text, p19_validated, p19_counts, p21_token_count, r5_exemplars, r7_correction_pairs, m12_ship_gate, m14_gap_updates, m17_reassign, m17_appended, v5_dataset, v5_selection, u5_chunk_table, u1_test_embedding, p12_past_framed, u3_embedding, u4_completion, w7_bad_rows)}
_R = "r AS (SELECT user_id AS session_id, event_id % 40 AS question_id, event_id, ts, event_type = 'error' AS skipped, value AS audio_sec FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts DESC, event_id DESC) = 1)"
_Q = "q AS (SELECT item_id AS question_id, item_id % 5 AS module, item_id % 5 = 4 AS sealed, text AS prompt FROM benchmark)"
_CENTS = "CAST(sum(CAST(round(audio_sec * 100) AS BIGINT)) AS BIGINT) AS audio_cents"
_TOPICS = f"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda w: len(w) > 3 AND w NOT IN ({', '.join(repr(w) for w in rules.TOPIC_STOP)}))[1:3]"
_LINTED = f"({found('trim(text)', rules.FIRST_PERSON)} OR {found('trim(text)', rules.SECOND_PERSON)} OR {found('trim(text)', rules.FILLER)} OR {found('trim(text)', '[!?]$')} OR {WORDS} > 60)"
ORACLE = {
    "s3_project_docs": "SELECT doc_id, 'description' AS part, source || ': ' || text AS text FROM documents WHERE doc_id % 3 = 0 AND trim(text) <> '' UNION ALL SELECT doc_id, 'a', text FROM documents WHERE trim(text) <> ''",
    "s4_export_format": "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS format, CASE WHEN turn % 4 = 2 THEN 'unknown format' WHEN turn % 4 = 3 THEN CASE WHEN regexp_matches(ltrim(text), '^[\\[{]') THEN 'unknown format' ELSE 'not JSON' END END AS skipped FROM conversations",
    "s6_interview": f"WITH {_R}, {_Q} SELECT session_id AS session, CASE WHEN sealed THEN 'holdout' WHEN skipped THEN 'not voice' WHEN event_id % 10 = 0 THEN 'blank' ELSE 'item' END AS route, count(*) AS n, CAST(sum(question_id) AS BIGINT) AS questions, CAST(sum(length(prompt) + 1 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE length('said ' || event_id) END) AS BIGINT) AS chars, (CAST(sum(CAST(round(audio_sec * 100) AS BIGINT)) AS BIGINT) * 10 + 3000) // 6000 / 10.0 AS minutes FROM r JOIN q USING (question_id) GROUP BY 1, 2",
    "s7_session_files": "SELECT doc_id, source || '/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.png' ELSE '.md' END AS name, CASE WHEN doc_id % 4 = 1 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'unsupported' WHEN doc_id % 9 = 0 OR trim(text) = '' THEN 'empty' END AS skipped FROM documents",
    "k2_sealed_write": f"WITH {redacted_sql('benchmark', 'item_id')} SELECT item_id, t AS redacted FROM r{len(redaction.RULES)}",
    "k3_selective_rebuild": "SELECT doc_id, CASE WHEN source IN ('src2', 'src5') THEN 0 ELSE n_chars END AS n_chars, source FROM documents",
    "c5_batches": """WITH RECURSIVE d AS (SELECT source, doc_id, least(coalesce(length(text), 0), 4000) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), r AS (SELECT source, doc_id, i, 1 AS n, size AS total, 0 AS batch FROM d WHERE i = 1
UNION ALL SELECT d.source, d.doc_id, d.i, CASE WHEN r.total + size > 6000 OR r.n >= 10 THEN 1 ELSE r.n + 1 END, CASE WHEN r.total + size > 6000 OR r.n >= 10 THEN size ELSE r.total + size END, CASE WHEN r.total + size > 6000 OR r.n >= 10 THEN r.batch + 1 ELSE r.batch END FROM r JOIN d ON d.source = r.source AND d.i = r.i + 1) SELECT source, doc_id, batch FROM r""",
    "l4_gram_set": f"WITH t AS (SELECT {TOK_LIST} AS w FROM benchmark) SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM t",
    "l8_firewall": f"WITH c AS (SELECT conv_id, 'turn:' || conv_id || ':' || turn AS id, 'statement:' || conv_id || ':' || turn AS sid, role, turn, text, trim(text) AS t FROM (SELECT * REPLACE (CASE WHEN role = 'user' AND (conv_id + turn) % 3 = 0 THEN 'No, that''s wrong. ' || text ELSE text END AS text) FROM conversations)), k AS (SELECT *, role = 'user' AND NOT {found('t', *rules.REMEMBER)} AND ({found('t', *rules.META)} OR {found('t', *rules.CORRECTION)} OR (turn > 0 AND {found('t', rules.WEAK_CORRECTION)})) AS note FROM c), s AS (SELECT id, {NORMAL} AS n FROM k WHERE NOT note UNION ALL SELECT 'document:' || doc_id, {NORMAL} FROM documents UNION ALL SELECT sid, {NORMAL.replace('text', "('They said:  ' || text || ' (noted)')")} FROM c WHERE role = 'user' AND conv_id % 5 = 0), m AS (SELECT id, {NORMAL} AS n FROM k WHERE note) SELECT s.id AS store_id, m.id AS turn_id FROM s JOIN m ON length(m.n) >= 40 AND length(s.n) >= 40 AND contains(s.n, m.n)",
    "p9_own_text": "SELECT source, CASE WHEN doc_id % 4 = 0 THEN 'spoken' ELSE 'written' END AS mode, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id % 4 <> 3 GROUP BY 1, 2",
    "p19_validated": f"SELECT conv_id, turn, CASE WHEN conv_id % 120 NOT IN (SELECT doc_id FROM documents WHERE lang <> 'es') THEN 'unknown source' WHEN trim(text) = '' THEN 'empty' WHEN turn % 4 = 2 THEN 'bad type' WHEN {_LINTED} THEN 'lint' ELSE 'stored' END AS verdict, CASE conv_id % 5 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' WHEN 3 THEN 'moderate' END AS strength, 'a,b,c' AS topics FROM conversations",
    "p19_counts": f"WITH v AS (SELECT conv_id, turn, CASE WHEN conv_id % 120 NOT IN (SELECT doc_id FROM documents WHERE lang <> 'es') THEN 'unknown source' WHEN trim(text) = '' THEN 'empty' WHEN turn % 4 = 2 THEN 'bad type' WHEN {_LINTED} THEN 'lint' ELSE 'stored' END AS verdict, CASE conv_id % 5 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' WHEN 3 THEN 'moderate' END AS strength, 'a,b,c' AS topics FROM conversations) SELECT verdict, CASE WHEN verdict = 'stored' THEN coalesce(strength, 'none') END AS strength, count(*) AS n FROM v GROUP BY 1, 2",
    "r5_exemplars": """WITH RECURSIVE d AS (SELECT lang AS subject, doc_id, source AS topic, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS step, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 11 DESC, doc_id) AS pos FROM documents WHERE doc_id % 11 <= 4),
s AS (SELECT DISTINCT subject, 0::BIGINT AS place, NULL::BIGINT AS doc_id, 0::BIGINT AS last, []::VARCHAR[] AS topics, 0 AS ahead FROM d
UNION ALL SELECT subject, place, doc_id, pos, topics, ahead FROM (SELECT s.subject AS subject, place + 1 AS place, d.doc_id AS doc_id, pos, list_append(topics, topic) AS topics, ahead + step AS ahead, row_number() OVER (PARTITION BY s.subject ORDER BY pos) AS r FROM s JOIN d ON d.subject = s.subject AND pos > last AND len(list_filter(topics, lambda t: t = topic)) < 2 AND step * ahead < 4 WHERE place < 12) WHERE r = 1)
SELECT subject, doc_id, place FROM s WHERE place > 0""",
    "r7_correction_pairs": f"WITH c AS (SELECT * FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) SELECT conv_id, turn FROM c WHERE {WORDS} BETWEEN 20 AND 140",
    "m12_ship_gate": "WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_id % 2 = 0 AND event_type = 'view') AS before, count(*) FILTER (WHERE event_id % 2 = 1 AND event_type = 'view') AS after FROM events GROUP BY 1) SELECT *, after >= before AS ship FROM c",
    "m14_gap_updates": f"""WITH w AS (SELECT role, turn, conv_id * 1000 + turn AS stamp, {_TOPICS} AS ws FROM conversations), t AS (SELECT role, turn, stamp, CASE WHEN len(ws) = 0 THEN 'general' ELSE array_to_string(ws, ' ') END AS topic FROM w), g AS (SELECT DISTINCT topic FROM t WHERE role = 'user'), i AS (SELECT word, count(*) AS times, max(stamp) AS last FROM (SELECT DISTINCT unnest(string_split(topic, ' ')) AS word, stamp FROM t WHERE role = 'assistant') GROUP BY 1), a AS (SELECT DISTINCT string_split(topic, ' ')[1] AS word FROM t WHERE role = 'user' AND turn = 0)
SELECT topic, CASE WHEN EXISTS (SELECT 1 FROM a WHERE list_contains(string_split(topic, ' '), a.word)) THEN 0 ELSE coalesce(times, 0) END AS ignored, last AS last_invited FROM g LEFT JOIN i ON i.word = string_split(topic, ' ')[1]""",
    "m17_appended": f"""WITH {_Q}, c AS (SELECT prompt, min(came) AS came FROM (SELECT text AS prompt, conv_id AS came FROM conversations WHERE role = 'user' AND turn = 0 UNION ALL SELECT prompt, question_id + 1000000000 FROM q WHERE module = 4) GROUP BY 1), j AS (SELECT prompt, came, (SELECT min(question_id) FROM q WHERE q.prompt = c.prompt) AS known FROM c)
SELECT 'appended' AS what, (SELECT max(question_id) FROM q) + row_number() OVER (ORDER BY came) AS number, sha256(prompt) AS of FROM j WHERE known IS NULL UNION ALL SELECT 'affirmed', known, sha256(prompt) FROM j WHERE known IS NOT NULL UNION ALL SELECT 'guard skipped', count(*), NULL FROM q WHERE question_id % 4 = 2 AND NOT starts_with(prompt, 'other')""",
    "m17_reassign": f"WITH {_Q} SELECT question_id, CASE WHEN question_id % 4 = 0 OR (question_id % 2 = 0 AND starts_with(prompt, 'other')) THEN 9 ELSE module END AS module, question_id % 4 = 2 AND NOT starts_with(prompt, 'other') AS skipped FROM q",
    "v5_dataset": f"WITH {_R}, {_Q} SELECT module, CASE WHEN sealed THEN 'sealed' WHEN skipped THEN 'skipped' WHEN event_id % 3 = 0 THEN 'not reviewed' WHEN audio_sec < 3 THEN 'too short' ELSE 'kept' END AS outcome, count(*) AS clips, {_CENTS} FROM r JOIN q USING (question_id) GROUP BY 1, 2",
    "v5_selection": f"WITH {_R.replace('value AS audio_sec', '(1 + user_id % 30) * value AS audio_sec')}, {_Q}, o AS (SELECT session_id, question_id, audio_sec, CASE WHEN sealed THEN 'sealed' WHEN skipped THEN 'skipped' WHEN event_id % 3 = 0 AND session_id % 5 <> 0 THEN 'not reviewed' WHEN audio_sec < 3 THEN 'too short' ELSE 'kept' END AS outcome FROM r JOIN q USING (question_id)), k AS (SELECT *, row_number() OVER (PARTITION BY session_id, outcome ORDER BY question_id DESC) AS r, count(*) OVER (PARTITION BY session_id, outcome) AS n FROM o), s AS (SELECT session_id, count(*) FILTER (WHERE outcome = 'kept') AS clips, count(*) FILTER (WHERE outcome = 'kept' AND r <= greatest(3, floor(n * 0.1))) AS held_back, coalesce(CAST(sum(CAST(round(audio_sec * 100) AS BIGINT)) FILTER (WHERE outcome = 'kept') AS BIGINT), 0) AS audio_cents, count(*) FILTER (WHERE outcome = 'not reviewed') AS not_reviewed, count(*) FILTER (WHERE outcome = 'too short') AS too_short FROM k GROUP BY 1) SELECT *, CASE WHEN session_id % 7 = 0 THEN 'no consent' WHEN audio_cents < 120000 THEN 'too short' ELSE 'built' END AS status FROM s",
    "p21_token_count": "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS tokens FROM documents",
    "p12_past_framed": f"SELECT conv_id, turn, {found('trim(text)', *rules.PAST_FRAMED)} AS past_framed FROM conversations",
    "u3_embedding": "SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, 'e', '')) AS es FROM documents",
    "u4_completion": "SELECT conv_id, turn, reverse(text) AS answer FROM conversations",
    "w7_bad_rows": "SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 13 = 0 THEN 'corrupt' ELSE 'ok' END AS status FROM events",
}
