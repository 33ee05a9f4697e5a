"""Queries over events and derived response tables: upserts, notes, summaries, sessions, intervals, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import rules
from scriptorium.functions.text import normalize
from scriptorium.operators import intervals, scans
from scriptorium.operators.places import placed
from scriptorium.operators.style import top_per
from scriptorium.plans.style import _ANALYSIS
from scriptorium.plans.text_rules import NORMAL, WORDS, found
from scriptorium.session import table
from scriptorium.streaming import events as stream


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("question_id"), (F.col("item_id") % 5).alias("module"), (F.col("item_id") % 5 == 4).alias("sealed"), (F.col("item_id") % 7 != 0).alias("active"), F.col("text").alias("prompt"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest response of each session to each question."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 40).alias("question_id"), "event_id", "ts", (F.col("event_type") == "error").alias("skipped"), (F.col("event_id") % 7).alias("likert"), F.col("value").alias("audio_sec"))
    latest = e.groupBy("session_id", "question_id").agg(F.max_by(F.struct("event_id", "ts", "skipped", "likert", "audio_sec"), F.struct("ts", "event_id")).alias("x"))
    return latest.select("session_id", "question_id", "x.*")


def _minutes(counts: Column) -> Column:
    """Minutes to one decimal, halves up, from whole hundredths of seconds."""
    return F.floor((F.sum(F.when(counts, F.round(F.col("audio_sec") * 100).cast("long"))) * 10 + 3000) / 6000) / 10


def k6_session_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, q = responses(spark, sf_dir), questions(spark, sf_dir)
    given = r.join(q.select("question_id", F.lit(True).alias("asked")), "question_id", "left")
    answered, skipped = F.col("asked") & ~F.col("skipped"), F.col("asked") & F.col("skipped")
    counts = given.groupBy("session_id").agg(F.count_if(answered).alias("answered"), F.count_if(skipped).alias("skipped"), _minutes(answered).alias("minutes"))
    size = q.agg(F.count("*").alias("questions"))  # one row
    return counts.join(F.broadcast(size)).select("session_id", "questions", "answered", "skipped", "minutes")


def k6_export_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export's entries: a row for each question of the questionnaire and session, answered or not. Answered: there
    is a response that was not skipped, with a recording or a point on the scale."""
    r = responses(spark, sf_dir).withColumn("audio_sec", F.when(F.col("question_id") % 3 != 0, F.col("audio_sec"))).withColumn("likert", F.when(F.col("question_id") % 3 == 0, F.nullif("likert", F.lit(0))))
    sheet = questions(spark, sf_dir).agg(F.collect_list(F.struct("question_id", "module", "sealed")).alias("sheet"))  # one questionnaire
    entries = r.select("session_id").distinct().join(F.broadcast(sheet)).select("session_id", F.inline("sheet"))
    j = entries.join(r, ["session_id", "question_id"], "left")
    answered = F.coalesce(~F.col("skipped") & (F.col("audio_sec").isNotNull() | F.col("likert").isNotNull()), F.lit(False))
    return j.select("session_id", "question_id", "module", "sealed", answered.alias("answered"), F.coalesce("skipped", F.lit(False)).alias("skipped"), "audio_sec", "likert", F.col("ts").alias("answered_at"))


def k7_import_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an export by session: matched to questions by the identity form of the prompt, others to new, inactive
    questions. Sealed is what either side says is sealed; minutes are credited for answers whose recording came along.
    Entries without an answer and a transcript are passed over."""
    e = k6_export_entries(spark, sf_dir)
    q = questions(spark, sf_dir)
    prompts = q.select("question_id", F.concat(F.lit("  "), F.regexp_replace("prompt", " ", "  ")).alias("prompt"))
    came = e.join(prompts, "question_id").where(F.col("answered") | (F.col("question_id") % 11 == 0))
    own = q.where("question_id % 3 <> 1").select(normalize(F.col("prompt")).alias("k"), F.col("question_id").alias("known"), (F.col("question_id") % 4 == 1).alias("own_sealed"))
    j = came.withColumn("k", normalize(F.col("prompt"))).join(own, "k", "left")
    sealed = F.col("sealed") | F.coalesce("own_sealed", F.lit(False))
    recorded = F.col("audio_sec").isNotNull() & (F.col("question_id") % 5 != 2)  # the file is in the export
    to_ingest = ~sealed & F.col("audio_sec").isNotNull()
    return j.groupBy("session_id").agg(F.count("*").alias("imported"), F.count_if(F.col("known").isNull()).alias("new_questions"), F.count_if(sealed).alias("sealed"), F.count_if(to_ingest).alias("to_ingest"), _minutes(recorded).alias("minutes"))


def k7_import_by_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported prompts matched by identity form; unknown ones get new numbers and are inactive."""
    q = questions(spark, sf_dir)
    known = q.where("question_id % 3 <> 0").select("question_id", normalize(F.col("prompt")).alias("k"), "active")
    came = q.select(F.col("question_id").alias("import_id"), F.upper("prompt").alias("prompt"))
    j = came.withColumn("k", normalize(F.col("prompt"))).join(known, "k", "left")
    top = known.agg(F.max("question_id").alias("top"))  # one row
    new = placed(j.where("question_id is null").select("import_id"), "import_id").join(F.broadcast(top)).select("import_id", (F.col("top") + F.col("_i") + 1).alias("question_id"), F.lit(False).alias("active"))
    return j.where("question_id is not null").select("import_id", "question_id", "active").unionByName(new)


def k8_response_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest supplied field of each (session, question); a Likert value outside 1-5 is rejected."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 40).alias("question_id"), "ts", "event_id", F.when(F.col("event_type") == "click", F.col("event_id") % 7).alias("likert"), F.when(F.col("event_type") == "view", F.col("value")).alias("audio_sec"))
    ok = e.where("likert is null or likert between 1 and 5")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "event_id")))
    return ok.groupBy("session_id", "question_id").agg(last("likert").alias("likert"), last("audio_sec").alias("audio_sec"))


def k11_late_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A late result applies only to a pending, unedited row of the version that the job read."""
    e = table(spark, sf_dir, "events")
    rows = e.where("event_type <> 'error'").select("event_id", (F.col("event_id") % 5).alias("version"), (F.col("event_type") == "view").alias("pending"), (F.col("event_id") % 9 == 0).alias("edited"))
    late = e.select("event_id", (F.col("event_id") % 4).alias("read_version"))
    j = late.join(rows, "event_id", "left")
    apply_ = F.coalesce(F.col("pending") & ~F.col("edited") & (F.col("version") == F.col("read_version")), F.lit(False))
    return j.groupBy(F.when(apply_, "applied").otherwise("discarded").alias("outcome")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def m1_reply_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    up = lambda k, name: c.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("role").alias(name))
    return c.where("role = 'user'").join(up(1, "answers"), ["conv_id", "turn"], "left").join(up(2, "trigger"), ["conv_id", "turn"], "left").select("conv_id", "turn", "answers", "trigger")


def m4_correction_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a correction (a user turn) goes, by its kind: style ones pair with the turn before, facts and
    positions become statements if their register is neutral and they are not sealed, rules wait or apply
    once. Each is a regression case as well, whose fields fall back on one another; their sizes are summed."""
    kinds = ["style", "factual", "position", "behavior"]
    c = table(spark, sf_dir, "conversations")
    said = lambda role, back, name: c.where(F.col("role") == role).select("conv_id", (F.col("turn") + back).alias("turn"), F.col("text").alias(name))
    rows = c.where("role = 'user'").withColumn("kind", F.get(F.array(*map(F.lit, kinds)), (F.col("turn") % 4).cast("int")))
    rows = rows.join(said("assistant", 1, "original"), ["conv_id", "turn"], "left").join(said("user", 2, "trigger"), ["conv_id", "turn"], "left")
    same = F.sha2(normalize(F.col("text")), 256)
    sealed = table(spark, sf_dir, "benchmark").select(same.alias("same")).distinct().withColumn("sealed", F.lit(True))
    rows = rows.withColumn("same", same).join(sealed, "same", "left")
    clean = F.size(rules.lint_reasons(F.col("text"))) == 0
    ready = (F.col("kind") == "behavior") & (F.col("conv_id") % 2 == 1)
    first = rows.where(ready).groupBy("same").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    rows = rows.join(first, "same", "left")
    rule = F.when(~ready, "rule_pending").when(F.struct("conv_id", "turn") == F.col("first"), "rule_applied").otherwise("rule_known")
    route = F.when(F.col("kind") == "style", F.when(F.col("original").isNull(), "no_original").otherwise("exemplar_pair")).when(F.col("kind") == "behavior", rule).when(~clean, "rejected").when(F.col("sealed"), "sealed").otherwise("statement")
    cut = lambda *c: F.sum(F.length(F.substring(F.coalesce(*c, F.lit("")), 1, 2000)))
    return rows.groupBy("kind", route.alias("route")).agg(F.count("*").alias("n"), cut("trigger", "original", "text").alias("trigger_chars"), cut("original").alias("rejected_chars"))


def m5_live_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ten notes of a subject stay active. Those of errors are retired by event, unless a case (of every
    fourth event) is pending; a note with a case is retired when that case is resolved (by a signup)."""
    e = table(spark, sf_dir, "events").withColumn("case_id", F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 997))
    resolved = e.where("event_type = 'signup'").select((F.col("event_id") % 997).alias("case_id")).distinct().withColumn("resolved", F.lit(True))
    notes = scans.scanned(e, "user_id", [F.desc("ts"), F.desc("event_id")]).join(resolved, "case_id", "left")
    retired = (F.col("event_type") == "error") & F.col("case_id").isNull() | F.coalesce("resolved", F.lit(False))
    return notes.select("event_id", ((F.col("n") <= 10) & ~retired).alias("active"))


def m10_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open cases by theme; cases without one are general."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    theme = F.coalesce(F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("theme"), F.col("user_id") % 6)), F.lit("general"))
    return e.groupBy(theme.alias("theme")).agg(F.count("*").alias("cases"), F.min("event_id").alias("first"))


def m10_card_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every open card: its theme, its place there by age, and its question if it has one."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    theme = F.coalesce(F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("theme"), F.col("user_id") % 6)), F.lit("general"))
    placed_ = scans.scanned(e.withColumn("theme", theme), "theme", [F.col("ts"), F.col("event_id")])
    asked = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Which of "), "event_id", F.lit(" holds?")))
    return placed_.select("theme", "event_id", F.col("n").alias("place"), asked.alias("question"))


def m11_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due when 40 statements or 15 corrections came since the last run and no core case is open."""
    e = table(spark, sf_dir, "events")
    last = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("run_at"))
    j = e.join(last, "user_id", "left").where("run_at is null or ts > run_at")
    c = j.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("statements"), F.count_if(F.col("event_type") == "click").alias("corrections"), F.max((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)).alias("blocked"))
    return c.withColumn("due", ((F.col("statements") >= 40) | (F.col("corrections") >= 15)) & ~F.col("blocked"))


def m15_one_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the latest 50 turns of a conversation held a clarification or an invitation."""
    e = top_per(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50)
    return e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("clarified"), F.bool_or(F.col("event_type") == "signup").alias("invited"))


def m16_previous_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest earlier persona turn (a view) of each answer (a click)."""
    e = table(spark, sf_dir, "events").withColumn("view", F.when(F.col("event_type") == "view", F.col("event_id")))
    found = scans.scanned(e, "user_id", [F.col("ts"), F.col("event_id")], "view")
    return found.where("event_type = 'click'").select("event_id", F.col("before").alias("persona"))


def m16_oldest_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest open case (an error) of a subject that has a question and was not asked yet, and how many
    answers (clicks) go back to a case: the one that the persona turn before names, if it is still open."""
    e = table(spark, sf_dir, "events")
    open_ = (F.col("event_type") == "error") & (F.col("event_id") % 5 != 0)
    oldest = e.where(open_ & (F.col("event_id") % 3 != 0) & (F.col("event_id") % 2 == 0)).groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("oldest"))
    answers = m16_previous_turn(spark, sf_dir).join(e.select("event_id", "user_id"), "event_id").withColumn("named", F.col("persona") - F.col("persona") % 3)
    cases = e.where(open_).select(F.col("event_id").alias("named"), F.lit(1).alias("hit"))
    routed = answers.join(cases, "named").groupBy("user_id").agg(F.count("*").alias("routed"))
    return oldest.join(routed, "user_id", "full_outer").select("user_id", "oldest", F.coalesce("routed", F.lit(0).cast("long")).alias("routed"))


def m18_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals numbered by time; every third is decided."""
    e = scans.scanned(table(spark, sf_dir, "events").where("event_type = 'purchase'"), "user_id", [F.col("ts"), F.col("event_id")])
    return e.select("event_id", "n", F.when(F.col("n") % 3 == 0, F.when(F.col("n") % 2 == 0, "applied").otherwise("rejected")).otherwise("pending").alias("status"))


def a1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = responses(spark, sf_dir).where("not skipped").select("question_id").distinct().withColumn("answered", F.lit(True))
    q = questions(spark, sf_dir).where("active").join(answered, "question_id", "left")
    c = q.groupBy("module").agg(F.count("*").alias("questions"), F.count("answered").alias("answered"))
    modules = spark.range(6).select(F.col("id").alias("module"))
    return modules.join(c, "module", "left").select("module", F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("answered", F.lit(0)).alias("answered"), F.when(F.col("questions") > 0, F.round(100 * F.col("answered") / F.col("questions"))).otherwise(0.0).alias("percent"))


def a2_next_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First active question without an answer, sealed ones last: where the places of a session's answered
    questions have their first gap."""
    r = responses(spark, sf_dir)
    q = placed(questions(spark, sf_dir).where("active").select("sealed", "question_id"), "sealed", "question_id").select("question_id", F.col("_i").alias("place"))
    done = r.where(~F.col("skipped")).join(q, "question_id").select("session_id", "place")
    n = (F.row_number().over(Window.partitionBy("session_id").orderBy("place")) - 1).cast("long")  # a session's answers
    gaps = done.withColumn("n", n).groupBy("session_id").agg(F.coalesce(F.min(F.when(F.col("place") != F.col("n"), F.col("n"))), F.count("*")).alias("place"))
    first = r.select("session_id").distinct().join(gaps, "session_id", "left").withColumn("place", F.coalesce("place", F.lit(0)))
    return first.join(q, "place").select("session_id", "question_id")


def a3_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).groupBy("session_id").agg(F.count_if(~F.col("skipped")).alias("answered"), F.count("*").alias("total"), _minutes(~F.col("skipped")).alias("minutes"))


def a4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).groupBy("session_id").agg(F.count_if(~F.col("skipped")).alias("answered"), F.count_if("skipped").alias("skipped"), F.max("ts").alias("latest"))


def a5_subject_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins, chunks, minutes (at 900 characters a minute, as everywhere) and pending jobs of each subject."""
    d = table(spark, sf_dir, "documents")
    jobs = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.concat(F.lit("src"), F.col("user_id") % 20).alias("source")).agg(F.count("*").alias("pending"))
    s = d.groupBy("source").agg(F.count_distinct(F.col("doc_id") % 50).alias("origins"), F.count("*").alias("chunks"), F.round(F.sum("n_chars") / 900, 1).alias("minutes"))
    return s.join(jobs, "source", "left").withColumn("pending", F.coalesce("pending", F.lit(0).cast("long")))


def a6_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("domain"))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("domain"))
    c = table(spark, sf_dir, "conversations").select(F.col("role").alias("domain"))
    return d.union(e).union(c).union(d.sparkSession.createDataFrame([("general",)], "domain string")).distinct()


def a7_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase and queues of each subject: interviewing without statements (views), synthesizing without a fingerprint (a
    purchase) or a pack (a signup), and else active + improving; open cases, approvals, live notes and jobs."""
    e = table(spark, sf_dir, "events").where("user_id % 13 <> 0 or event_type not in ('view', 'signup')")
    n = F.count_if
    kind = lambda name: F.col("event_type") == name
    c = e.groupBy("user_id").agg(n(kind("view")).alias("statements"), F.bool_or(kind("purchase")).alias("fingerprint"), n(kind("signup")).alias("pack_version"), n(kind("error") & (F.col("event_id") % 5 != 0)).alias("clarifications"), n(kind("click") & (F.col("event_id") % 3 == 0)).alias("approvals"), n(kind("error") & (F.col("event_id") % 5 == 0)).alias("queued"))
    phase = F.when(F.col("statements") == 0, "interviewing").when(~F.col("fingerprint") | (F.col("pack_version") == 0), "synthesizing").otherwise("active + improving")
    live = m5_live_notes(spark, sf_dir).where("active").join(e.select("event_id", "user_id"), "event_id").groupBy("user_id").agg(F.count("*").alias("notes"))
    return c.join(live, "user_id", "left").select("user_id", phase.alias("phase"), "statements", "pack_version", "clarifications", "approvals", F.coalesce("notes", F.lit(0).cast("long")).alias("notes"), "queued")


def a8_build_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that a build of a subject fails: half an hour of voice (at 900 characters a minute),
    fifty statements, no sealed text among them, a fingerprint, eight exemplars (rarely asked)."""
    d = table(spark, sf_dir, "documents")
    sealed = questions(spark, sf_dir).where("sealed").select(F.sha2(normalize(F.col("prompt")), 256).alias("same")).distinct().withColumn("leak", F.lit(True))
    rows = d.withColumn("same", F.sha2(normalize(F.col("text")), 256)).join(sealed, "same", "left")
    s = rows.groupBy("source").agg(F.round(F.sum("n_chars") / 900, 1).alias("minutes"), F.count("*").alias("statements"), F.coalesce(F.bool_or("leak"), F.lit(False)).alias("leak"), F.bool_or(F.trim("text") != "").alias("fingerprint"), F.least(F.lit(12), F.count_if(F.col("doc_id") % 11 <= 4)).alias("exemplars"))
    gate = F.when(F.col("minutes") < 30, "too little voice").when(F.col("statements") < 50, "too few statements").when(F.col("leak"), "sealed text").when(~F.col("fingerprint"), "no fingerprint").when(F.col("exemplars") < 8, "too few exemplars").otherwise("ok")
    return s.select("source", "minutes", "statements", "exemplars", gate.alias("gate"))


def a9_blinding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which clip stands first, from the first byte of a digest of seed and index."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", (F.conv(F.substring(F.sha2(F.concat(F.lit("seed:"), "item_id"), 256), 1, 2), 16, 10).cast("int") % 2 == 0).alias("first_is_a"))


def a10_pick_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view', 'error')")
    local = F.when(F.col("event_type") == "error", None).otherwise((F.col("event_type") == "click") == (F.col("event_id") % 2 == 0))
    return e.rollup(F.col("user_id") % 7).agg(F.count("*").alias("n"), F.count_if(local).alias("local"), F.count_if(local.isNull()).alias("cannot_tell")).toDF("listener", "n", "local", "cannot_tell")


def a11_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements and agreements per source, and the first five documents that were not agreed on."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")  # noqa: E741
    agreed = F.col("quality") == 1
    counts = l.groupBy("source").agg(F.count_if(agreed).alias("agreed"), F.count("*").alias("judged"))
    five = top_per(l.where(~agreed).select("source", "doc_id"), ["source"], ["doc_id"], 5)
    gaps = five.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("gaps"))
    return counts.join(gaps, "source", "left").select("source", "agreed", "judged", F.coalesce("gaps", F.lit("")).alias("gaps"))


def _silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) % 3_600_000_000).cast("double") / 1e6
    return e.select(F.col("user_id").alias("recording"), F.col("event_id").alias("line"), F.round(start, 3).alias("start"), F.round(start + F.col("value") % 3, 3).alias("end"))


def v1_silence_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _silences(spark, sf_dir)
    log = s.select("recording", (F.col("line") * 2).alias("line"), F.format_string("silence_start: %.3f", "start").alias("text")).unionByName(s.select("recording", (F.col("line") * 2 + 1).alias("line"), F.format_string("silence_end: %.3f", "end").alias("text")))
    return intervals.parse_silences(log, "recording", "line", "text")


def v2_speech_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.speech_spans(_silences(spark, sf_dir), "recording", 3600.0).select("recording", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def v4_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = intervals.speech_spans(_silences(spark, sf_dir), "recording", 3600.0)
    return intervals.plan_clips(spans, "recording", 3600.0).withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})


def v3_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the long silences, refined by two finer levels."""
    s = _silences(spark, sf_dir)
    length = F.col("end") - F.col("start")
    spans = intervals.speech_spans(s.where(length >= 2.5), "recording", 3600.0)
    finer = s.where(length >= 1.5).withColumn("level", F.lit(1)).unionByName(s.withColumn("level", F.lit(2)))
    return intervals.refine_spans(spans, finer, "recording", [1, 2]).select("recording", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def w3_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.retention(table(spark, sf_dir, "events"), "user_id", "ts")


def w5_running_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.running_style(table(spark, sf_dir, "documents"), "lang", "text")


def w6_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered twice count once."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return stream.first_of_each(e.unionByName(e), "event_id", "ts").groupBy("user_id").agg(F.count("*").alias("n"))


def w1_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.captured(table(spark, sf_dir, "conversations"))


def w2_session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest 30 turns after the last reset marker (signup) and not older than 12 hours."""
    return stream.session_memory(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "signup").select("user_id", "event_id", "position")


def w4_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.due_checks(table(spark, sf_dir, "events"), 50)


def w8_hourly_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.hourly(table(spark, sf_dir, "events"))


_R = "r AS (SELECT user_id AS session_id, event_id % 40 AS question_id, event_id, ts, event_type = 'error' AS skipped, value AS audio_sec FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts DESC, event_id DESC) = 1)"
_R6 = _R.replace("value AS audio_sec", "CASE WHEN event_id % 40 % 3 <> 0 THEN value END AS audio_sec, CASE WHEN event_id % 40 % 3 = 0 THEN nullif(event_id % 7, 0) END AS likert")
_Q = "q AS (SELECT item_id AS question_id, item_id % 5 AS module, item_id % 5 = 4 AS sealed, item_id % 7 <> 0 AS active, text AS prompt FROM benchmark)"
_SIL = "z AS (SELECT user_id AS recording, event_id AS line, round((epoch_us(ts) % 3600000000) / 1e6, 3) AS start, round((epoch_us(ts) % 3600000000) / 1e6 + value % 3, 3) AS \"end\" FROM events)"
_SPANS = """spans AS (SELECT recording, cursor AS start, start AS "end" FROM (
  SELECT recording, start, coalesce(greatest(0.0, max("end") OVER (PARTITION BY recording ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0.0) AS cursor FROM z WHERE {where}
  UNION ALL SELECT recording, 3600.0, max("end") FROM z WHERE {where} GROUP BY 1) WHERE start > cursor + 0.05)"""


def _refined(n: int, of: str, where: str) -> str:
    """Spans after one more level: cut at silences half a second inside, or left as they are."""
    return f"""i{n} AS (SELECT p.recording, p.start AS s, p."end" AS e, z.start AS a, z."end" AS b FROM {of} p JOIN z ON z.recording = p.recording AND p."end" - p.start > 15 AND z.start > p.start + 0.5 AND z."end" < p."end" - 0.5 WHERE {where}),
g{n} AS (SELECT recording, s, greatest(s, coalesce(max(b) OVER (PARTITION BY recording, s ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS f, a AS t FROM i{n} UNION ALL SELECT recording, s, max(b), max(e) FROM i{n} GROUP BY 1, 2),
l{n} AS (SELECT recording, f AS start, t AS "end" FROM g{n} WHERE t > f + 0.05 UNION ALL SELECT recording, start, "end" FROM {of} p WHERE NOT EXISTS (SELECT 1 FROM i{n} WHERE i{n}.recording = p.recording AND i{n}.s = p.start))"""


_CLEAN = f"NOT ({found('trim(text)', rules.FIRST_PERSON)} OR {found('trim(text)', rules.SECOND_PERSON)} OR {found('trim(text)', rules.FILLER)} OR {found('trim(text)', '[!?]$')} OR {WORDS} > 60)"

QUERIES = {f.__name__: f for f in (k6_session_export, k6_export_entries, k7_import_by_prompt, k7_import_answers, k8_response_upsert, k11_late_results, m1_reply_chain, m4_correction_routes, m5_live_notes, m10_cards, m10_card_list, m11_due, m15_one_each, m16_previous_turn, m16_oldest_case, m18_approvals, a1_coverage, a2_next_question, a3_progress, a4_sessions, a5_subject_stats, a6_domains, a7_status, a8_build_gates, a9_blinding, a10_pick_tally, a11_agreement, v1_silence_log, v2_speech_spans, v3_refined, v4_clips, w3_retention, w5_running_style, w6_replays, w1_capture, w2_session_memory, w4_cadence, w8_hourly_intents)}
ORACLE = {
    "k6_session_export": f"WITH {_R}, {_Q}, e AS (SELECT DISTINCT session_id, q.question_id FROM r, q) SELECT e.session_id AS session_id, count(*) AS questions, count(*) FILTER (WHERE NOT skipped) AS answered, count(*) FILTER (WHERE skipped) AS skipped, (CAST(sum(CAST(round(audio_sec * 100) AS BIGINT)) FILTER (WHERE NOT skipped) AS BIGINT) * 10 + 3000) // 6000 / 10.0 AS minutes FROM e LEFT JOIN r USING (session_id, question_id) GROUP BY 1",
    "k6_export_entries": f"WITH {_R6}, {_Q} SELECT s.session_id AS session_id, q.question_id AS question_id, module, sealed, coalesce(NOT skipped AND (audio_sec IS NOT NULL OR likert IS NOT NULL), false) AS answered, coalesce(skipped, false) AS skipped, audio_sec, likert, ts AS answered_at FROM (SELECT DISTINCT session_id FROM r) s CROSS JOIN q LEFT JOIN r ON r.session_id = s.session_id AND r.question_id = q.question_id",
    "k7_import_answers": f"""WITH {_R6}, {_Q}, e AS (SELECT s.session_id AS session_id, q.question_id AS question_id, sealed, prompt, coalesce(NOT skipped AND (audio_sec IS NOT NULL OR likert IS NOT NULL), false) AS answered, audio_sec FROM (SELECT DISTINCT session_id FROM r) s CROSS JOIN q LEFT JOIN r ON r.session_id = s.session_id AND r.question_id = q.question_id),
o AS (SELECT {NORMAL.replace('text', 'prompt')} AS k, question_id AS known, question_id % 4 = 1 AS own FROM q WHERE question_id % 3 <> 1), j AS (SELECT e.*, known, sealed OR coalesce(own, false) AS shut FROM e LEFT JOIN o ON o.k = {NORMAL.replace('text', 'prompt')} WHERE answered OR question_id % 11 = 0)
SELECT session_id, count(*) AS imported, count(*) FILTER (WHERE known IS NULL) AS new_questions, count(*) FILTER (WHERE shut) AS sealed, count(*) FILTER (WHERE NOT shut AND audio_sec IS NOT NULL) AS to_ingest, (coalesce(CAST(sum(CAST(round(audio_sec * 100) AS BIGINT)) FILTER (WHERE audio_sec IS NOT NULL AND question_id % 5 <> 2) AS BIGINT), 0) * 10 + 3000) // 6000 / 10.0 AS minutes FROM j GROUP BY 1""",
    "k7_import_by_prompt": f"WITH {_Q}, n AS (SELECT question_id, {NORMAL.replace('text', 'prompt')} AS k, active FROM q), j AS (SELECT a.question_id AS import_id, b.question_id AS known, b.active FROM n a LEFT JOIN n b ON a.k = b.k AND b.question_id % 3 <> 0) SELECT import_id, coalesce(known, (SELECT max(question_id) FROM n WHERE question_id % 3 <> 0) + row_number() OVER (PARTITION BY known IS NULL ORDER BY import_id)) AS question_id, coalesce(active, false) AS active FROM j",
    "k8_response_upsert": "SELECT user_id AS session_id, event_id % 40 AS question_id, arg_max(event_id % 7, (ts, event_id)) FILTER (WHERE event_type = 'click') AS likert, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS audio_sec FROM events WHERE event_type <> 'click' OR event_id % 7 BETWEEN 1 AND 5 GROUP BY 1, 2",
    "k11_late_results": "SELECT CASE WHEN event_type = 'view' AND event_id % 9 <> 0 AND event_id % 5 = event_id % 4 THEN 'applied' ELSE 'discarded' END AS outcome, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
    "m1_reply_chain": "SELECT c.conv_id AS conv_id, c.turn AS turn, a.role AS answers, b.role AS trigger FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2 WHERE c.role = 'user'",
    "m4_correction_routes": f"""WITH c AS (SELECT c.*, a.text AS original, t.text AS trig, ['style', 'factual', 'position', 'behavior'][c.turn % 4 + 1] AS kind, {NORMAL.replace('text', 'c.text')} AS same FROM conversations c LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN conversations t ON t.role = 'user' AND t.conv_id = c.conv_id AND t.turn = c.turn - 2 WHERE c.role = 'user'),
k AS (SELECT *, {_CLEAN} AS clean, same IN (SELECT {NORMAL} FROM benchmark) AS sealed, kind = 'behavior' AND conv_id % 2 = 1 AS ready FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY ready, same ORDER BY conv_id, turn) AS i FROM k)
SELECT kind, CASE kind WHEN 'style' THEN CASE WHEN original IS NULL THEN 'no_original' ELSE 'exemplar_pair' END WHEN 'behavior' THEN CASE WHEN NOT ready THEN 'rule_pending' WHEN i = 1 THEN 'rule_applied' ELSE 'rule_known' END ELSE CASE WHEN NOT clean THEN 'rejected' WHEN sealed THEN 'sealed' ELSE 'statement' END END AS route, count(*) AS n,
CAST(sum(length(substr(coalesce(trig, original, text), 1, 2000))) AS BIGINT) AS trigger_chars, CAST(sum(length(substr(coalesce(original, ''), 1, 2000))) AS BIGINT) AS rejected_chars FROM f GROUP BY 1, 2""",
    "m5_live_notes": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10 AND NOT (event_type = 'error' AND event_id % 4 <> 0) AND NOT (event_id % 4 = 0 AND event_id % 997 IN (SELECT event_id % 997 FROM events WHERE event_type = 'signup')) AS active FROM events",
    "m10_cards": "SELECT CASE WHEN event_id % 3 <> 0 THEN 'theme' || user_id % 6 ELSE 'general' END AS theme, count(*) AS cases, min(event_id) AS first FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
    "m10_card_list": "WITH t AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN 'theme' || user_id % 6 ELSE 'general' END AS theme FROM events WHERE event_type IN ('click', 'view')) SELECT theme, event_id, row_number() OVER (PARTITION BY theme ORDER BY ts, event_id) AS place, CASE WHEN event_id % 2 = 0 THEN 'Which of ' || event_id || ' holds?' END AS question FROM t",
    "m11_due": "WITH l AS (SELECT user_id, max(ts) AS run_at FROM events WHERE event_type = 'signup' GROUP BY 1), c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS statements, count(*) FILTER (WHERE event_type = 'click') AS corrections, bool_or(event_type = 'error' AND event_id % 5 = 0) AS blocked FROM events LEFT JOIN l USING (user_id) WHERE run_at IS NULL OR ts > run_at GROUP BY 1) SELECT *, (statements >= 40 OR corrections >= 15) AND NOT blocked AS due FROM c",
    "m15_one_each": "WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50) SELECT user_id, bool_or(event_type = 'purchase') AS clarified, bool_or(event_type = 'signup') AS invited FROM e GROUP BY 1",
    "m16_previous_turn": "WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS persona FROM events) SELECT event_id, persona FROM e WHERE event_type = 'click'",
    "m16_oldest_case": "WITH o AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS oldest FROM events WHERE event_type = 'error' AND event_id % 5 <> 0 AND event_id % 3 <> 0 AND event_id % 2 = 0 GROUP BY 1), e AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS persona FROM events), r AS (SELECT e.user_id AS user_id, count(*) AS routed FROM e JOIN events c ON c.event_id = persona - persona % 3 AND c.event_type = 'error' AND c.event_id % 5 <> 0 WHERE e.event_type = 'click' GROUP BY 1) SELECT user_id, oldest, coalesce(routed, 0) AS routed FROM o FULL JOIN r USING (user_id)",
    "m18_approvals": "WITH e AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase') SELECT event_id, n, CASE WHEN n % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN 'applied' ELSE 'rejected' END ELSE 'pending' END AS status FROM e",
    "a1_coverage": f"WITH {_R}, {_Q}, c AS (SELECT module, count(*) AS questions, count(*) FILTER (WHERE question_id IN (SELECT question_id FROM r WHERE NOT skipped)) AS answered FROM q WHERE active GROUP BY 1) SELECT m AS module, coalesce(questions, 0) AS questions, coalesce(answered, 0) AS answered, CASE WHEN questions > 0 THEN round(100 * answered / questions) ELSE 0 END AS percent FROM range(6) t(m) LEFT JOIN c ON module = m",
    "a2_next_question": f"WITH {_R}, {_Q} SELECT session_id, q.question_id AS question_id FROM (SELECT DISTINCT session_id FROM r) x, q WHERE active AND NOT EXISTS (SELECT 1 FROM r WHERE r.session_id = x.session_id AND r.question_id = q.question_id AND NOT skipped) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sealed, q.question_id) = 1",
    "a3_progress": f"WITH {_R} SELECT session_id, count(*) FILTER (WHERE NOT skipped) AS answered, count(*) AS total, (CAST(sum(CAST(round(audio_sec * 100) AS BIGINT)) FILTER (WHERE NOT skipped) AS BIGINT) * 10 + 3000) // 6000 / 10.0 AS minutes FROM r GROUP BY 1",
    "a4_sessions": f"WITH {_R} SELECT session_id, count(*) FILTER (WHERE NOT skipped) AS answered, count(*) FILTER (WHERE skipped) AS skipped, max(ts) AS latest FROM r GROUP BY 1",
    "a5_subject_stats": "WITH j AS (SELECT 'src' || user_id % 20 AS source, count(*) AS pending FROM events WHERE event_type = 'error' GROUP BY 1), d AS (SELECT source, count(DISTINCT doc_id % 50) AS origins, count(*) AS chunks, round(sum(n_chars) / 900, 1) AS minutes FROM documents GROUP BY 1) SELECT source, origins, chunks, minutes, coalesce(pending, 0) AS pending FROM d LEFT JOIN j USING (source)",
    "a6_domains": "SELECT lang AS domain FROM documents UNION SELECT event_type FROM events UNION SELECT role FROM conversations UNION SELECT 'general'",
    "a7_status": """WITH e AS (SELECT * FROM events WHERE user_id % 13 <> 0 OR event_type NOT IN ('view', 'signup')), n AS (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10 AND NOT (event_type = 'error' AND event_id % 4 <> 0) AND NOT (event_id % 4 = 0 AND event_id % 997 IN (SELECT event_id % 997 FROM events WHERE event_type = 'signup'))),
l AS (SELECT user_id, count(*) AS notes FROM n WHERE event_id IN (SELECT event_id FROM e) GROUP BY 1), c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS statements, bool_or(event_type = 'purchase') AS fp, count(*) FILTER (WHERE event_type = 'signup') AS pack_version, count(*) FILTER (WHERE event_type = 'error' AND event_id % 5 <> 0) AS clarifications, count(*) FILTER (WHERE event_type = 'click' AND event_id % 3 = 0) AS approvals, count(*) FILTER (WHERE event_type = 'error' AND event_id % 5 = 0) AS queued FROM e GROUP BY 1)
SELECT user_id, CASE WHEN statements = 0 THEN 'interviewing' WHEN NOT fp OR pack_version = 0 THEN 'synthesizing' ELSE 'active + improving' END AS phase, statements, pack_version, clarifications, approvals, coalesce(notes, 0) AS notes, queued FROM c LEFT JOIN l USING (user_id)""",
    "a8_build_gates": f"WITH {_Q}, d AS (SELECT *, {NORMAL} IN (SELECT {NORMAL.replace('text', 'prompt')} FROM q WHERE sealed) AS leak FROM documents), s AS (SELECT source, round(sum(n_chars) / 900, 1) AS minutes, count(*) AS statements, bool_or(leak) AS leak, bool_or(trim(text) <> '') AS fp, least(12, count(*) FILTER (WHERE doc_id % 11 <= 4)) AS exemplars FROM d GROUP BY 1) SELECT source, minutes, statements, exemplars, CASE WHEN minutes < 30 THEN 'too little voice' WHEN statements < 50 THEN 'too few statements' WHEN leak THEN 'sealed text' WHEN NOT fp THEN 'no fingerprint' WHEN exemplars < 8 THEN 'too few exemplars' ELSE 'ok' END AS gate FROM s",
    "a9_blinding": "SELECT item_id, CAST('0x' || substr(sha256('seed:' || item_id), 1, 2) AS INT) % 2 = 0 AS first_is_a FROM benchmark",
    "a10_pick_tally": "SELECT user_id % 7 AS listener, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error' AND (event_type = 'click') = (event_id % 2 = 0)) AS local, count(*) FILTER (WHERE event_type = 'error') AS cannot_tell FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY ROLLUP (user_id % 7)",
    "a11_agreement": "WITH l AS (SELECT source, doc_id, quality FROM labels JOIN documents USING (doc_id)) SELECT source, count(*) FILTER (WHERE quality = 1) AS agreed, count(*) AS judged, coalesce(array_to_string(list_sort(list(doc_id) FILTER (WHERE quality <> 1))[1:5], ','), '') AS gaps FROM l GROUP BY 1",
    "v1_silence_log": f"WITH {_SIL} SELECT recording, start, \"end\" FROM z",
    "v2_speech_spans": f"""WITH {_SIL}, c AS (SELECT recording, start, coalesce(greatest(0.0, max("end") OVER (PARTITION BY recording ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0.0) AS cursor FROM z UNION ALL SELECT recording, 3600.0, max("end") FROM z GROUP BY 1) SELECT recording, round(cursor, 3) AS start, round(start, 3) AS "end" FROM c WHERE start > cursor + 0.05""",
    "v3_refined": f"""WITH {_SIL}, {_SPANS.format(where='"end" - start >= 2.5')}, {_refined(1, 'spans', '"z"."end" - z.start >= 1.5')}, {_refined(2, 'l1', 'true')} SELECT recording, round(start, 3) AS start, round("end", 3) AS "end" FROM l2""",
    "v4_clips": f"""WITH RECURSIVE {_SIL}, {_SPANS.format(where='true')}, n AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY start, "end") AS i FROM spans),
f AS (SELECT recording, i, start AS clip, "end" FROM n WHERE i = 1 UNION ALL SELECT n.recording, n.i, CASE WHEN n."end" - f.clip <= 15 THEN f.clip ELSE n.start END, n."end" FROM f JOIN n ON n.recording = f.recording AND n.i = f.i + 1),
c AS (SELECT recording, clip, max("end") AS last FROM f GROUP BY 1, 2), p AS (SELECT *, last - clip > 15 AS long, CASE WHEN last - clip > 15 THEN clip ELSE greatest(0, clip - 0.15) END AS s, CASE WHEN last - clip > 15 THEN last ELSE least(3600, last + 0.15) END AS e FROM c)
SELECT recording, round(s, 3) AS start, round(e, 3) AS "end", CASE WHEN long THEN 'too long' WHEN e - s < 3 THEN 'too short' END AS dropped FROM p""",
    "w1_capture": f"WITH c AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE role = 'user'), k AS (SELECT conv_id, turn, CASE WHEN {found('t', *rules.REMEMBER)} THEN 0 WHEN {found('t', *rules.META)} THEN 1 WHEN {found('t', *rules.CORRECTION)} THEN 2 WHEN turn > 0 AND {found('t', rules.WEAK_CORRECTION)} THEN 2 ELSE 3 END AS k FROM c) SELECT conv_id, turn, ['material', 'meta', 'correction', 'chat'][k + 1] AS intent, k IN (1, 2) AS note, true AS work FROM k",
    "w2_session_memory": "WITH n AS (SELECT user_id, max(ts) AS now, max(ts) FILTER (WHERE event_type = 'signup') AS reset FROM events GROUP BY 1), e AS (SELECT e.user_id AS user_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY ts DESC, event_id DESC) AS k, ts FROM events e JOIN n USING (user_id) WHERE event_type <> 'signup' AND ts > now - INTERVAL 12 HOUR AND (reset IS NULL OR ts > reset)) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM e WHERE k <= 30",
    "w3_retention": "WITH n AS (SELECT user_id, max(ts) AS now FROM events GROUP BY 1) SELECT user_id, count(*) AS stored, count(*) FILTER (WHERE ts > now - INTERVAL 12 HOUR) AS live FROM events JOIN n USING (user_id) GROUP BY 1",
    "w5_running_style": f"SELECT lang, {_ANALYSIS} FROM documents GROUP BY lang",
    "w6_replays": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
    "w4_cadence": "WITH l AS (SELECT user_id, max(ts) AS run_at FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT user_id, count(*) FILTER (WHERE event_type <> 'signup' AND (run_at IS NULL OR ts > run_at)) AS since, count(*) FILTER (WHERE event_type <> 'signup' AND (run_at IS NULL OR ts > run_at)) >= 50 AS due FROM events LEFT JOIN l USING (user_id) GROUP BY 1",
    "w8_hourly_intents": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
