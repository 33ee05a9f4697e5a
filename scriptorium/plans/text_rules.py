"""Queries for the text functions: normal forms, ids, redaction, markup, pattern rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import markup, redaction, rules
from scriptorium.functions import text as tx
from scriptorium.plans import style
from scriptorium.session import spread, table


def re2(pattern: str) -> str:
    """A pattern as a SQL literal for RE2."""
    return "'" + pattern.replace("\\z", "$").replace("'", "''") + "'"


_SPACES = re.sub(r"\\u(\w{4})", r"\\x{\1}", tx.SPACES)


def spaced(pattern: str) -> str:
    """A pattern whose white space is Unicode's for RE2, too, as `text.java` has it."""
    return re.sub(r"\[\^\\s", lambda _: f"[^{_SPACES}", pattern).replace("\\s", f"[{_SPACES}]")


def found(column: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {re2(p)})" for p in patterns) + ")"


NORMAL = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"
TOK_LIST = "list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{L}\\p{N}'' ]', ' ', 'g'), ' +'), lambda w: w <> '')"


def p1_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize(F.col("text")).alias("normalized"))


def p2_item_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.item_id(F.lit("work_file"), F.col("source"), F.col("text")).alias("item_id"))


def p3_chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    number, count = F.col("doc_id") % 150, F.col("doc_id") % 3
    return d.select("doc_id", tx.chunk_id(F.col("source"), number, count).alias("chunk_id"))


def p4_statement_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.statement_id(F.col("source"), F.col("text")).alias("statement_id"))


def p5_short_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    return redaction.redact(users).where(tx.word_count(F.col("redacted")) >= 15).select("conv_id", "turn", "redacted")


def p6_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.redact(spread(table(spark, sf_dir, "documents"), "doc_id")).select("doc_id", "redacted")


def p7_luhn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]"))
    runs = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(tx.java(r"\b(?:\d[ -]?){13,19}\b")), F.lit(0))).alias("run"))
    return runs.select("doc_id", "run", redaction.luhn_valid(F.col("run")).alias("valid"))


def p8_redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed for each rule before rules become rows: an explode of a row's own counts is turned into a filter on them, in
    which the optimizer would write out the whole chain of rules once for each count."""
    d = redaction.redact(spread(table(spark, sf_dir, "documents"), "doc_id")).select("source", "redactions")
    sums = d.groupBy("source").agg(*[F.sum(F.col("redactions")[name]).alias(name) for name in redaction.NAMES])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in redaction.NAMES])).alias("x")
    return sums.select("source", each).select("source", "x.rule", "x.n").where("n > 0")


def p10_register_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six reasons; the collocations are the fifteen phrases that a role uses most."""
    c = table(spark, sf_dir, "conversations")
    own = style.t4_top_phrases(spark, sf_dir).groupBy("role").agg(F.collect_list("phrase").alias("own"))  # fifteen a role
    rows = c.join(own, "role", "left").withColumn("own", F.coalesce("own", F.expr("cast(array() as array<string>)")))
    return rows.select("conv_id", "turn", F.array_join(rules.lint_reasons(F.col("text"), F.col("own")), ",").alias("reasons"))


def p11_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", rules.route_intent(F.col("text")).alias("intent"), rules.past_framed(F.col("text")).alias("past_framed"))


def p13_event_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 5 == 3, "file").when(F.col("turn") % 5 == 4, "audio").otherwise("text")
    hint = F.when(F.col("conv_id") % 11 == 0, "material")
    made = rules.event_intent(F.col("text"), kind, (F.col("conv_id") % 180).cast("double"), F.col("turn") > 0, hint)
    return c.select("conv_id", "turn", made.alias("i")).select("conv_id", "turn", "i.*")


def p14_classifier_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    intent = F.when(F.col("event_type") == "click", "correction").when(F.col("event_type") == "view", "chat").when(F.col("event_type") == "purchase", "meta").otherwise(F.col("event_type"))
    return e.select("event_id", rules.gated_intent(intent, (F.col("event_id") % 100) / 100).alias("route"))


def p15_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kinds = ["fact", "belief", "preference", "insight", "experience"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 5 + 1).cast("int"))
    t = rules.tier(kind, F.array(F.when(F.col("doc_id") % 7 == 0, "values").when(F.col("doc_id") % 7 == 1, "job").otherwise("other")), F.col("text"))
    rows = d.select("doc_id", t.alias("tier"))
    return rows.select("doc_id", "tier", rules.stricter(F.col("tier"), F.when(F.col("doc_id") % 2 == 0, "position").otherwise("mutable")).alias("case_tier"))


def p16_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", rules.personal_topic(F.col("text")).alias("personal"), rules.topic_of(F.col("text")).alias("topic"))


def p17_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(rules.keywords(F.col("text"), F.lit("The Source"))).alias("keyword"))


def p18_delivery_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.concat(F.lit("[pause] "), F.col("text"), F.lit(" [Sighs] [whispers]"), F.lit("  [slows down]"))
    return table(spark, sf_dir, "documents").select("doc_id", rules.strip_tags(tagged, True).alias("kept"), rules.strip_tags(tagged, False).alias("plain"))


def p20_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with and without a code fence; those that don't parse give nulls."""
    e = table(spark, sf_dir, "events")
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("not json")
    bare = F.regexp_replace(F.regexp_replace(F.trim(body), "^```(?:json)?[ \\n]*", ""), "[ \\n]*```\\z", "")
    return e.select("event_id", F.from_json(bare, "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


def s10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.html_text(F.col("html")).alias("text"))


def s11_flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.flat_text(F.col("html")).alias("text"))


def s12_mail_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped as mails in three ways, and unwrapped again."""
    head = F.trim(F.regexp_replace("text", "\\n", " "))
    tail = F.when(F.col("doc_id") % 3 == 0, "\n\nBest regards,\nAnn\n").when(F.col("doc_id") % 3 == 1, "\n> quoted\nOn Monday the 3rd, Ann wrote:\n> more\nlost").otherwise("\n-- \nAnn\nlost")
    return table(spark, sf_dir, "documents").select("doc_id", markup.own_mail_text(F.concat(head, tail)).alias("own"))


_LUHN = """(len(regexp_replace({r}, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(len(regexp_replace({r}, '[^0-9]', '', 'g'))),
  lambda i: CASE WHEN i % 2 = 0 THEN CAST(reverse(regexp_replace({r}, '[^0-9]', '', 'g'))[i + 1] AS INT)
    ELSE 2 * CAST(reverse(regexp_replace({r}, '[^0-9]', '', 'g'))[i + 1] AS INT) - CASE WHEN CAST(reverse(regexp_replace({r}, '[^0-9]', '', 'g'))[i + 1] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"""


def redacted_sql(source: str, keep: str) -> str:
    """CTEs r0, r1, ... over `source`; the last has redacted and n0, n1, ..."""
    steps = [f"r0 AS (SELECT {keep}, text AS t FROM {source})"]
    for i, rule in enumerate(redaction.RULES):
        pattern, head = spaced(rule.pattern), "\\1" if rule.head else ""
        before = f"r{i}"
        if rule.luhn:
            runs, valid = f"regexp_extract_all(t, {re2(pattern)})", _LUHN.format(r="x[2]")
            one = f"x[1] || CASE WHEN x[2] IS NULL THEN '' WHEN {valid} THEN '{redaction.MARK}' ELSE x[2] END"
            step = f"SELECT * EXCLUDE (t), len(list_filter({runs}, lambda r: {_LUHN.format(r='r')})) AS n{i}, array_to_string(list_transform(list_zip(string_split_regex(t, {re2(pattern)}), {runs}), lambda x: {one}), '') AS t FROM {before}"
        elif "(?<!" in pattern:
            # A mark between a digit and a letter makes the end of digits a word boundary, which takes no character from the next number.
            plain = "(^|[^0-9])" + pattern.replace("(?<!\\d)", "").replace("(?!\\d)", "\\b")
            steps.append(f"m{i} AS (SELECT * EXCLUDE (t), regexp_replace(replace(t, chr(1), chr(1) || chr(2)), '([0-9])([A-Za-z_])', '\\1' || chr(1) || chr(3) || '\\2', 'g') AS t FROM {before})")
            step = f"SELECT * EXCLUDE (t), len(regexp_extract_all(t, {re2(plain)})) AS n{i}, replace(replace(regexp_replace(t, {re2(plain)}, '\\1{redaction.MARK}', 'g'), chr(1) || chr(3), ''), chr(1) || chr(2), chr(1)) AS t FROM m{i}"
        else:
            step = f"SELECT * EXCLUDE (t), len(regexp_extract_all(t, {re2(pattern)})) AS n{i}, regexp_replace(t, {re2(pattern)}, '{head}{redaction.MARK}', 'g') AS t FROM {before}"
        steps.append(f"r{i + 1} AS ({step})")
    return ",\n".join(steps)


LAST = f"r{len(redaction.RULES)}"
_TAGGED = "('[pause] ' || text || ' [Sighs] [whispers]' || '  [slows down]')"
_SQUEEZE = "trim(regexp_replace({x}, '[ \\t]{{2,}}', ' ', 'g'))"
_FLAT = "html"
for _p in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]+>", "(?i)&[a-z#0-9]+;", "\\s+"):
    _FLAT = f"regexp_replace({_FLAT}, {re2(_p)}, ' ', 'g')"
_HTML = "html"
for _tag in ("script", "style", "head"):
    _HTML = f"regexp_replace({_HTML}, '(?is)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"
for _p, _by in (("(?i)<br\\s*/?>", "chr(10)"), ("(?i)</(p|div|li|h[1-6]|tr|blockquote)>", "chr(10) || chr(10)"), ("<[^>]+>", "' '")):
    _HTML = f"regexp_replace({_HTML}, {re2(_p)}, {_by}, 'g')"
_CODES = "list_distinct(regexp_extract_all(t, '&#([0-9]{1,7});', 1))"
_DECODED = f"list_reduce({_CODES}, lambda a, c: replace(a, '&#' || c || ';', chr(CAST(c AS INT))), t)"
for _e, _by in markup.ENTITIES:
    _DECODED = f"replace({_DECODED}, {re2(_e)}, {re2(_by)})"
_KEYS = ", ".join(f"'{w}'" for w in [*rules.KEYWORD_STOP, "source"])

HTML, HTML_TEXT = _HTML, f"trim(regexp_replace(regexp_replace({_DECODED}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"

QUERIES = {f.__name__: f for f in (p1_normalize, p2_item_id, p3_chunk_id, p4_statement_id, p5_short_messages, p6_redaction, p7_luhn_runs, p8_redaction_counts, p10_register_lint, p11_intent, p13_event_intent, p14_classifier_gate, p15_tier, p16_topic, p17_keywords, p18_delivery_tags, p20_model_json, s10_html_text, s11_flat_text, s12_mail_text)}
ORACLE = {
    "p1_normalize": f"SELECT doc_id, {NORMAL} AS normalized FROM documents",
    "p2_item_id": f"SELECT doc_id, substr(sha256('work_file|' || source || '|' || {NORMAL}), 1, 16) AS item_id FROM documents",
    "p3_chunk_id": "SELECT doc_id, CASE WHEN doc_id % 3 > 1 THEN source || '-c' || CASE WHEN doc_id % 150 < 10 THEN '0' ELSE '' END || CAST(doc_id % 150 AS VARCHAR) ELSE source END AS chunk_id FROM documents",
    "p4_statement_id": f"SELECT doc_id, substr(sha256(source || '|' || {NORMAL}), 1, 16) AS statement_id FROM documents",
    "p5_short_messages": f"WITH {redacted_sql('conversations', 'conv_id, turn, role')} SELECT conv_id, turn, t AS redacted FROM {LAST} WHERE role = 'user' AND {WORDS.replace('text', 't')} >= 15",
    "p6_redaction": f"WITH {redacted_sql('documents', 'doc_id')} SELECT doc_id, t AS redacted FROM {LAST}",
    "p7_luhn_runs": rf"WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:\d[ -]?){{13,19}}\b')) AS run FROM documents) SELECT doc_id, run, {_LUHN.format(r='run')} AS valid FROM r",
    "p8_redaction_counts": f"WITH {redacted_sql('documents', 'source')}, c AS (" + " UNION ALL ".join(f"SELECT source, '{r.name}' AS rule, n{i} AS n FROM {LAST}" for i, r in enumerate(redaction.RULES)) + ") SELECT source, rule, CAST(sum(n) AS BIGINT) AS n FROM c WHERE n > 0 GROUP BY 1, 2",
    "p10_register_lint": f"WITH ph AS ({style.ORACLE['t4_top_phrases']}), own AS (SELECT role, list(phrase) AS own FROM ph GROUP BY role) SELECT conv_id, turn, concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in ((found("trim(text)", rules.FIRST_PERSON), "first_person"), (found("trim(text)", rules.SECOND_PERSON), "second_person"), (found("trim(text)", rules.FILLER), "filler"), (found("trim(text)", "[!?]$"), "exclamatory"), (f"{WORDS} > 60", "too_long"), ("len(list_filter(coalesce(own, []), lambda p: contains(' ' || lower(trim(text)) || ' ', ' ' || p || ' '))) > 0", "collocation"))) + ") AS reasons FROM conversations LEFT JOIN own USING (role)",
    "p11_intent": f"SELECT conv_id, turn, CASE WHEN {found('trim(text)', *rules.RECALL)} THEN 'explicit_recall' WHEN {found('trim(text)', *rules.SMALLTALK)} OR ({WORDS} <= 3 AND NOT contains(text, '?')) THEN 'smalltalk' ELSE 'knowledge' END AS intent, {found('trim(text)', *rules.PAST_FRAMED)} AS past_framed FROM conversations",
    "p13_event_intent": f"""
WITH c AS (SELECT *, trim(text) AS t, CASE WHEN turn % 5 = 3 THEN 'file' WHEN turn % 5 = 4 THEN 'audio' ELSE 'text' END AS kind FROM conversations), r AS (
  SELECT *, CASE WHEN conv_id % 11 = 0 THEN 0 WHEN kind = 'file' THEN 1 WHEN kind = 'audio' AND conv_id % 180 >= 90 THEN 1 WHEN {found('t', *rules.REMEMBER)} THEN 1
    WHEN {found('t', *rules.META)} THEN 2 WHEN {found('t', *rules.CORRECTION)} AND turn > 0 THEN 3 WHEN {found('t', *rules.CORRECTION)} THEN 4
    WHEN turn > 0 AND {found('t', rules.WEAK_CORRECTION)} THEN 4 ELSE 5 END AS k FROM c)
SELECT conv_id, turn, ['material', 'material', 'meta', 'correction', 'correction', 'chat'][k + 1] AS intent, CASE k WHEN 0 THEN 'hint' WHEN 5 THEN 'default' ELSE 'heuristic' END AS source, k < 4 AS confident FROM r""",
    "p14_classifier_gate": "SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') AND event_id % 100 >= 60 THEN CASE event_type WHEN 'click' THEN 'correction' ELSE 'meta' END ELSE 'none_needed' END AS route FROM events",
    "p15_tier": f"""
WITH d AS (SELECT doc_id, ['fact', 'belief', 'preference', 'insight', 'experience'][doc_id % 5 + 1] AS kind, CASE doc_id % 7 WHEN 0 THEN 'values' WHEN 1 THEN 'job' ELSE 'other' END || ' ' || text AS hay FROM documents),
t AS (SELECT doc_id, CASE WHEN kind = 'insight' OR {found('hay', rules.CORE_TOPIC)} THEN 'core' WHEN kind = 'fact' AND {found('hay', rules.MUTABLE_TOPIC)} THEN 'mutable' WHEN kind IN ('belief', 'preference') THEN 'position' ELSE 'mutable' END AS tier FROM d)
SELECT doc_id, tier, CASE WHEN tier = 'mutable' AND doc_id % 2 = 0 THEN 'position' ELSE tier END AS case_tier FROM t""",
    "p16_topic": f"WITH w AS (SELECT conv_id, turn, {found('text', rules.PERSONAL_TOPIC)} AS personal, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda w: len(w) > 3 AND w NOT IN ({', '.join(repr(w) for w in rules.TOPIC_STOP)}))[1:3] AS ws FROM conversations) SELECT conv_id, turn, personal, CASE WHEN len(ws) = 0 THEN 'general' ELSE array_to_string(ws, ' ') END AS topic FROM w",
    "p17_keywords": f"SELECT DISTINCT doc_id, keyword FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}'' ]', ' ', 'g'), ' +')) AS keyword FROM documents) WHERE len(keyword) > 3 AND keyword NOT IN ({_KEYS})",
    "p18_delivery_tags": f"SELECT doc_id, {_SQUEEZE.format(x=f'''replace({_TAGGED}, '[whispers]', ' ')''')} AS kept, {_SQUEEZE.format(x=f'''regexp_replace({_TAGGED}, '[[][^]]{{{{1,30}}}}[]]', ' ', 'g')''').replace('{{1,30}}', '{1,30}')} AS plain FROM documents",
    "p20_model_json": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
    "s10_html_text": f"WITH t AS (SELECT page_id, {_HTML} AS t FROM pages) SELECT page_id, {HTML_TEXT} AS text FROM t",
    "s11_flat_text": f"SELECT page_id, trim({_FLAT}) AS text FROM pages",
    "s12_mail_text": "SELECT doc_id, trim(replace(text, chr(10), ' ')) AS own FROM documents",
}
