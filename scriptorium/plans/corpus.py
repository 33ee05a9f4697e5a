"""Queries for sources, sinks, deduplication, chunking and holdout."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import redaction, rules
from scriptorium.functions import text as tx
from scriptorium.operators import chunk, dedup, holdout
from scriptorium.plans.style import SENTENCES, TOK, TOKENS
from scriptorium.plans.text_rules import HTML, HTML_TEXT, LAST, NORMAL, WORDS, redacted_sql
from scriptorium.session import Scratch, materialise, shared_dir, ship, spread, table
from scriptorium.sources import exports, files
from scriptorium.sources.stored import Stored


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as items: redacted, short ones dropped, exact copies dropped; per source."""
    users = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("source", F.concat(F.lit("chat"), F.col("conv_id") % 5))
    items = materialise(redaction.redact(users).withColumn("pos", F.col("conv_id") * 1000 + F.col("turn")).select("source", "pos", "redacted", "redactions"), "items")
    short = tx.word_count(F.col("redacted")) < 15
    counts = items.groupBy("source").agg(F.count("*").alias("items"), F.count_if(short).alias("short"), F.sum(F.aggregate(F.map_values("redactions"), F.lit(0).cast("long"), lambda a, b: a + b)).alias("redactions"))
    kept = dedup.exact_duplicates(items.where(~short), "source", "pos", "redacted")
    return counts.join(kept.groupBy("source").agg(F.count_if(F.col("duplicate")).alias("duplicates"), F.count_if(~F.col("duplicate")).alias("kept"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")), "source", "left")


def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build over documents: redact, deduplicate (exact and near), chunk, id; counts per source."""
    scratch = Scratch(spark)
    items = scratch.write(redaction.redact(spread(_docs(spark, sf_dir), "doc_id")).select("doc_id", "source", F.col("redacted").alias("text")), "given")
    kept = materialise(dedup.dedup(items, "source", "doc_id", "text", scratch=scratch).where("verdict = 'kept'"), "kept")
    scratch.drop()
    rows = chunk.chunk_rows(kept.withColumn("id", tx.item_id(F.lit("work_file"), F.col("source"), F.col("text"))).withColumn("key", F.struct("source", "id")), "key", "text")
    public = F.conv(F.substring("id.id", 1, 1), 16, 10) % 4 == 0
    ids = rows.select("id.source", public.alias("public"), tx.chunk_id(F.col("id.id"), F.col("number"), F.col("of")).alias("chunk_id"), F.length("text").alias("chars"))
    return ids.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(~F.col("public")).alias("private"), F.count_if("public").alias("public"), F.count_distinct("chunk_id").alias("ids"), F.sum("chars").alias("chars"))


def _flat_export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as an export's JSON, and its projects: those of the sources of documents, of which not all are
    named in a conversation and some named ones do not exist."""
    c = table(spark, sf_dir, "conversations")
    sender = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    blocks = F.when(F.col("turn") % 2 == 0, F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(text).alias("text") if isinstance(text, str) else text.alias("text")) for kind, text in (("image", "x"), ("text", F.concat(F.col("text"), F.lit("  "))), ("text", F.lit("")), ("text", F.lit("(end)")))]))
    message = F.struct(F.format_string("%08d-m", "turn").alias("uuid"), sender.alias("sender"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" \n"), F.col("text"))).alias("text"), blocks.alias("content"), F.when(F.col("turn") % 3 == 0, F.format_string("2024-01-%02d", F.col("turn") % 28 + 1)).alias("created_at"))
    listed = F.sort_array(F.collect_list(F.struct("turn", message.alias("m"))))["m"].alias("chat_messages")
    named = F.when(F.col("conv_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Talk "), F.col("conv_id"))).alias("name")
    project = F.when(F.col("conv_id") % 4 == 1, F.struct(F.concat(F.lit("Own "), F.col("conv_id") % 5).alias("name"))).alias("project")
    of = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("src"), F.col("conv_id") % 25)).alias("project_uuid")
    body = F.struct(F.format_string("%08d-c", "conv_id").alias("uuid"), named, F.lit("2023-12-31").alias("created_at"), project, of, F.col("chat_messages"))
    json = c.groupBy("conv_id").agg(listed).select(F.lit("export.zip").alias("export"), F.to_json(body).alias("json"))
    return json, _docs(spark, sf_dir).select(F.col("source").alias("uuid"), F.concat(F.lit("Project "), "source").alias("name")).distinct()


def s1_chat_export_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations nested to an export's JSON and read back: human messages with projects and origins."""
    json, projects = _flat_export(spark, sf_dir)
    return exports.flat_messages(json, "export", "json", projects).drop("export")


def s2_chat_export_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of nodes by id: user role, not hidden, the strings among mixed parts, first of a repeated id."""
    c = table(spark, sf_dir, "conversations")
    parts = F.concat(F.lit('[{"asset": 1}, " ", '), F.expr("left(substring(to_json(array(text)), 2), length(to_json(array(text))) - 2)"), F.when(F.col("turn") % 4 == 0, F.lit(', 7, "(end) "]')).otherwise(F.lit("]")))
    at = F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60
    time = F.when(F.col("turn") % 4 == 3, "null").when(F.col("turn") % 4 == 1, "0").otherwise(F.concat(at.cast("string"), F.lit(".25")))
    hidden = F.when(F.col("turn") % 7 == 6, ', "metadata": {"is_visually_hidden_from_conversation": true}').otherwise("")
    node = F.concat(F.format_string('"n%03d": {"id": "n", "message": {"id": "m%d", "author": {"role": "%s"}, "create_time": ', F.col("turn"), F.expr("turn div 2"), F.col("role")), time, F.lit(', "content": {"parts": '), parts, F.lit("}"), hidden, F.lit("}}"))
    nodes = F.array_join(F.sort_array(F.collect_list(F.struct("turn", node.alias("node"))))["node"], ", ")
    head = F.concat(F.lit('{"conversation_id": "'), F.format_string("%08d-c", "conv_id"), F.lit('", "title": '), F.when(F.col("conv_id") % 3 == 0, "null").otherwise(F.concat(F.lit('"Talk '), "conv_id", F.lit('"'))), F.lit(', "create_time": '), F.lit(1704067200) + F.col("conv_id") * 3600, F.lit(', "mapping": {"root": {"id": "root", "message": null}, '))
    json = c.groupBy("conv_id").agg(nodes.alias("nodes")).select(F.lit("export.zip").alias("export"), F.concat(head, "nodes", F.lit("}}")).alias("json"))
    return exports.tree_messages(json, "export", "json").drop("export")


def s5_conversation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    json, projects = _flat_export(spark, sf_dir)
    return exports.export_stats(json, "json", projects)


def glob_pattern(glob: str) -> str:
    """`**` any path (`**/` also none), `*` and `?` within a name."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            i += 3 if glob[i + 2 : i + 3] == "/" else 2
            out += ".*"
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], "\\" + glob[i] if glob[i] in ".+^${}()|[]\\" else glob[i])
        i += 1
    return f"\\A{out}\\z"


MANIFEST = [("src1/en/*.md", "notes", "private"), ("src?/**/*.txt", "files", "public"), ("**/1*.md", "ones", "public"), ("**/*.html", "pages", "private"), ("src1*/**", "rest", "private")]
EXTENSIONS = ["md", "txt", "html", "eml", "png", "pdf", "md", "txt"]


def match_manifest(files: DataFrame, path_col: str, manifest: list[tuple[str, str, str]]) -> DataFrame:
    """Adds entry, label and sensitivity of the first entry whose glob fits; nulls for orphans."""
    if bad := [m for m in manifest if m[2] not in ("private", "public")]:
        raise ValueError(f"sensitivity must be private or public: {bad}")
    fits = [F.col(path_col).rlike(glob_pattern(g)) for g, _, _ in manifest]
    first = F.coalesce(*[F.when(f, F.lit(i)) for i, f in enumerate(fits)])
    pick = lambda k: F.get(F.array(*[F.lit(m[k]) for m in manifest]), F.col("entry"))
    return files.withColumn("entry", first).withColumns({"label": pick(1), "sensitivity": pick(2)})


def require_matched(files: DataFrame, path_col: str) -> None:
    """Fails if no entry fits a file: with the number of such files and a folder in which all their names are."""
    orphans = Scratch(files.sparkSession)
    names = orphans.write(files.where("entry is null").select(F.col(path_col).alias("path")).sort("path"), "orphans")
    n = names.count()
    if n:
        first = ", ".join(r.path for r in names.sort("path").limit(10).collect())
        raise ValueError(f"no manifest entry for {n} files, all named in {orphans.paths[-1][1]}: {first}")
    orphans.drop()


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", "text", F.concat_ws("/", "source", "lang", F.concat_ws(".", "doc_id", extension)).alias("path"))


def s8_work_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says of each file; orphans have no label. With an entry for all others the same files pass
    whole."""
    require_matched(match_manifest(_paths(spark, sf_dir), "path", [*MANIFEST, ("**", "other", "private")]), "path")
    return match_manifest(_paths(spark, sf_dir), "path", MANIFEST).select("doc_id", "path", "label", "sensitivity")


def _tree(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows (path, content) as files of a new folder, read back."""
    folder = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    files.save_tree(rows, "path", "content", folder)
    return files.read_tree(spark, folder)


def s9_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a folder of text files, pages and mails (every ninth one blank), read and loaded by extension."""
    text = F.when(F.col("doc_id") % 9 == 0, F.lit(" ")).otherwise(F.col("text"))
    kind = F.col("doc_id") % 8
    content = F.when(kind == 2, F.concat(F.lit("<html><head>x</head><body><p>"), text, F.lit("</p></body></html>"))).when(kind == 3, F.concat(F.regexp_replace(text, "\\n", " "), F.lit("\n-- \nAnn\nlost"))).otherwise(text)
    found = files.load_files(_tree(spark, _paths(spark, sf_dir).withColumn("content", content)))
    doc_id = F.regexp_extract("path", "([0-9]+)\\.[a-z]+$", 1).cast("long")
    return found.select(doc_id.alias("doc_id"), "path", F.when(F.col("skipped").isNull(), F.sha2("body", 256)).alias("sha256"), "skipped")


def unzip(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, entry, body, error: a row for each text entry; an unreadable archive is one row
    with its error."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    with zipfile.ZipFile(io.BytesIO(batch.column(1)[i].as_py() or b"")) as z:
                        rows = [(n, z.read(n).decode("utf-8", "replace"), None) for n in z.namelist() if not n.endswith("/")]
                except zipfile.BadZipFile:
                    rows = [(None, None, "unreadable archive")]
                at = pa.array([i] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *[pa.array([r[k] for r in rows], pa.string()) for k in range(3)]], names=[key, "entry", "body", "error"])

    return df.select(key, content).mapInArrow(run, f"{key} {kind}, entry string, body string, error string")


def s13_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed into archives (one in seven broken) and read back."""
    ship(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                f = io.BytesIO()
                with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("page.html", html or "")
                    z.writestr("meta/url.txt", url or "")
                out.append(b"broken" if i % 7 == 0 else f.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["page_id", "content"])

    packed = table(spark, sf_dir, "pages").select("page_id", "url", "html").mapInArrow(pack, "page_id long, content binary")
    return unzip(packed, "page_id", "content").select("page_id", "entry", F.length("body").cast("long").alias("chars"), "error")


def k1_split_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private and public rows written to two folders as JSON lines; what each holds."""
    rows = _docs(spark, sf_dir).select(F.concat(F.lit("work_file|"), "source", F.lit("|"), "doc_id").alias("key"), "text", (F.col("doc_id") % 4 == 0).alias("public"))
    from scriptorium.sources.sinks import write_split

    private, public = write_split(rows, "public", "key")
    read = lambda p, kind: spark.read.schema("key string, text string").json(p).select(F.lit(kind).alias("kind"), "key", "text")
    both = read(private, "private").unionByName(read(public, "public"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("key").alias("first"))


def upsert(old: DataFrame, new: DataFrame, key: str, mutable: list[str]) -> DataFrame:
    """Rows by content id: known ones keep all but their mutable columns, new ones are added."""
    n = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in old.columns if c != key])
    j = old.join(n, F.col(key) == F.col("_k"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in mutable else F.when(F.col(key).isNull(), F.col(f"_{c}")).otherwise(F.col(c))
    return j.select(*[F.coalesce(F.col(key), F.col("_k")).alias(key) if c == key else pick(c).alias(c) for c in old.columns])


def k4_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents are stored; then all come: known ids get another label, the others are
    inserted."""
    d = _docs(spark, sf_dir).withColumn("id", tx.item_id(F.lit("work_file"), F.col("source"), F.col("text")))
    of = lambda rows: rows.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min("lang").alias("label"))
    first, all_ = of(d.where("doc_id % 3 <> 0")), of(d).withColumns({"label": F.concat(F.lit("new-"), "label"), "doc_id": F.col("doc_id") + 1_000_000})
    kept = Stored(spark, f"{shared_dir(spark)}/items-{uuid.uuid4().hex}", first.schema, ["id"])
    kept.upsert(first, ["label"])
    kept.upsert(all_, ["label"])
    return kept.frame()


def k5_stale_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of re-ingested origins are replaced, for any number of origins; buckets of others stay as
    they are on disk."""
    d = _docs(spark, sf_dir).select("doc_id", "source", F.lit("old").alias("version"))
    kept = Stored(spark, f"{shared_dir(spark)}/origins-{uuid.uuid4().hex}", d.schema, ["source"])
    kept.replace(d)
    kept.replace(d.where("source in ('src1', 'src7')").withColumn("version", F.lit("new")))
    return kept.frame()


def k9_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and in total: documents, short ones, copies, kept private and public ones, redactions by
    rule, and a note where less than half an hour (at 900 characters a minute) is kept."""
    m = dedup.exact_duplicates(redaction.redact(spread(_docs(spark, sf_dir), "doc_id")), "source", "doc_id", "text")
    m = m.withColumn("public", F.col("doc_id") % 4 == 0).withColumn("ok", ~F.col("duplicate") & (tx.word_count(F.col("text")) >= 15))
    rules_ = redaction.NAMES
    by_rule = [F.sum(F.coalesce(F.col("redactions")[name], F.lit(0))).cast("long").alias(f"r{i}") for i, name in enumerate(rules_)]
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd")
    dates = [f(F.when(F.col("doc_id") % 7 != 0, day)).alias(name) for name, f in (("first_date", F.min), ("last_date", F.max))]  # every seventh has none
    sums = m.rollup("source").agg(F.grouping("source").alias("g"), F.count("*").alias("n"), *dates, F.count_if(tx.word_count(F.col("text")) < 15).alias("short"), F.count_if(F.col("duplicate")).alias("copies"), F.count_if(F.col("ok") & ~F.col("public")).alias("private"), F.count_if(F.col("ok") & F.col("public")).alias("public"), F.sum(F.when(F.col("ok"), F.length("text"))).alias("chars"), *by_rule)
    named = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"r{i}") > 0, F.concat(F.lit(f"{name}="), F.col(f"r{i}"))) for i, name in enumerate(rules_)])), ",")
    note = F.when(F.coalesce("chars", F.lit(0)) < 30 * 900, "under 30 minutes")
    return sums.select(F.when(F.col("g") == 1, "total").otherwise(F.col("source")).alias("source"), "n", "first_date", "last_date", "short", "copies", "private", "public", named.alias("redactions"), note.alias("note"))


def k9_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a run skips, all of them, with the reason of each."""
    blank = F.when(F.col("doc_id") % 9 == 0, F.lit(" ")).otherwise(F.col("text"))
    found = files.load_files(_paths(spark, sf_dir).withColumn("content", blank)).where("skipped is not null")
    return found.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("source"), "path", "skipped")


def k10_release_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a release: every file with its digest and what it fails for, texts for banned patterns and others
    for a media extension; the row without a path is the verdict."""
    banned = {"token": "(?i)token\\s*=", "licence": "Licensed under", "address": "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+"}
    scan = materialise(files.scanned_files(_tree(spark, _paths(spark, sf_dir).withColumn("content", F.col("text"))), banned, ["png", "jpg", "wav", "mp3", "mp4"]), "scan")
    verdict = scan.agg(F.lit(None).cast("string").alias("path"), F.sum("length").alias("length"), F.lit(None).cast("string").alias("sha256"), F.when(F.count("found") > 0, "fail").otherwise("pass").alias("found"))
    return scan.unionByName(verdict)


def d1_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(_docs(spark, sf_dir), "source", "doc_id", "text").select("doc_id", "source", "duplicate")


def d2_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(_docs(spark, sf_dir), "source", "doc_id", "text")


def d3_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(_docs(spark, sf_dir), "source", "doc_id", "text").groupBy("source", "verdict").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def c1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk.chunk_rows(_docs(spark, sf_dir), "doc_id", "text")
    return rows.select(F.col("id").alias("doc_id"), "number", "of", "text")


def c4_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.regroup(_docs(spark, sf_dir), ["source"], "doc_id", "text")


def c6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(chunk.passages(F.col("text"))).alias("pos", "passage"))


def c6_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for exemplars: passages of interviews (spoken) and work files (written), and chat messages of 40 to 120
    words whole."""
    d = _docs(spark, sf_dir).where("doc_id % 4 in (0, 2)")
    mode = F.when(F.col("doc_id") % 4 == 0, "spoken").otherwise("written")
    cut = d.select(F.concat(F.lit("document:"), "doc_id").alias("origin"), mode.alias("mode"), F.posexplode(chunk.passages(F.col("text"))).alias("pos", "text"))
    chat = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & F.size(tx.style_tokens(F.col("text"))).between(40, 120))
    return cut.unionByName(chat.select(F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("origin"), F.lit("written").alias("mode"), F.lit(0).alias("pos"), "text"))


def l1_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a sealed text or are contained in one."""
    d, b = spread(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id"), table(spark, sf_dir, "benchmark")
    inside = holdout.sealed_matches(d, "doc_id", "text", b, "item_id", "text").select(F.col("id").alias("doc_id"), F.col("sid").alias("item_id"))
    within = holdout.sealed_matches(b, "item_id", "text", d, "doc_id", "text").select(F.col("sid").alias("doc_id"), F.col("id").alias("item_id"))
    return inside.union(within).distinct()


def l2_hash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a sealed text: by content (their identity form, or a line's, is that of a sealed
    text) or by provenance (an origin begins with a sealed question's number)."""
    h = lambda c: F.sha2(tx.normalize(c), 256)
    d, b = _docs(spark, sf_dir), table(spark, sf_dir, "benchmark")
    lines = d.select("doc_id", F.explode(F.array_union(F.array("text"), F.split("text", "\n"))).alias("t"))
    content = lines.select("doc_id", h(F.col("t")).alias("h")).join(b.select("item_id", h(F.col("text")).alias("h")), "h").select("doc_id", "item_id", F.lit("content").alias("how"))
    origins = d.select("doc_id", F.array(F.concat(F.lit("q"), F.col("doc_id") % 997, F.lit("-answer")), F.concat(F.lit("file-"), "source")).alias("origins"))
    prefix = origins.select("doc_id", F.explode("origins").alias("o")).select("doc_id", F.regexp_extract("o", "^(q[0-9]+)-", 1).alias("q"))
    provenance = prefix.join(b.where("item_id % 10 = 0").select("item_id", F.concat(F.lit("q"), "item_id").alias("q")), "q").select("doc_id", "item_id", F.lit("provenance").alias("how"))
    return content.unionByName(provenance).distinct()


def l3_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed texts whose 80-character start occurs, by store (source)."""
    d = _docs(spark, sf_dir)
    b = table(spark, sf_dir, "benchmark").where(F.length("text") >= 40).withColumn("head", F.substring("text", 1, 80))
    found = holdout.sealed_matches(d, "doc_id", "text", b, "item_id", "head")
    return found.join(d.select(F.col("doc_id").alias("id"), "source"), "id").groupBy("source").agg(F.count_distinct("sid").alias("items"), F.count("*").alias("hits"))


def l5_copied_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.longest_copied_run(_docs(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")


def l7_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies against what was rejected (the turn two before) and corrected (the turn before): a reply
    fails if it repeats eight words of the former, or, where facts or positions were corrected (odd
    turns), if it has less than 30 in 100 of at least two keywords of the latter. Newly failing: it
    passed at the last run (turns that 3 does not divide)."""
    c = table(spark, sf_dir, "conversations")
    g = holdout.word_grams(c, ["conv_id", "turn"], "text").select("conv_id", "turn", "gram")
    again = g.join(g.select("conv_id", (F.col("turn") + 2).alias("turn"), "gram").distinct(), ["conv_id", "turn", "gram"], "left_semi").select("conv_id", "turn").distinct().withColumn("again", F.lit(True))
    wanted = c.select("conv_id", (F.col("turn") + 1).alias("turn"), rules.keywords(F.col("text")).alias("keys"))
    j = c.select("conv_id", "turn", F.lower("text").alias("reply")).join(again, ["conv_id", "turn"], "left").join(wanted, ["conv_id", "turn"], "left")
    share = F.size(F.filter("keys", lambda k: F.col("reply").contains(k))) / F.size("keys")
    lacking = F.coalesce((F.col("turn") % 2 == 1) & (F.size("keys") >= 2) & (share < 0.3), F.lit(False))
    failed = F.coalesce("again", F.lit(False)) | lacking
    reason = F.when(F.coalesce("again", F.lit(False)), "rejected again").when(lacking, "correction missing")
    return j.select("conv_id", "turn", failed.alias("failed"), reason.alias("reason"), (failed & (F.col("turn") % 3 != 0)).alias("newly_failing"))


_DUP = f"(row_number() OVER (PARTITION BY source, {NORMAL} ORDER BY doc_id) > 1)"
_ITEMS = f"items AS (SELECT doc_id, source, list_distinct(list_filter(string_split_regex(regexp_replace({NORMAL}, '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' +'), lambda w: w <> '')) AS w, length({NORMAL}) AS n FROM documents)"
_PATH = "source || '/' || lang || '/' || doc_id || '.' || ['md', 'txt', 'html', 'eml', 'png', 'pdf', 'md', 'txt'][doc_id % 8 + 1]"
_ID = f"substr(sha256('work_file|' || source || '|' || {NORMAL}), 1, 16)"
_GRAMS8 = "unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram, unnest(range(1, greatest(len(w) - 6, 1))) AS pos"
_RUNS = f"""b AS (SELECT DISTINCT gram FROM (SELECT {_GRAMS8} FROM (SELECT {TOK} AS w FROM benchmark))), g AS (SELECT doc_id, {_GRAMS8} FROM (SELECT doc_id, {TOK} AS w FROM documents)),
h AS (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM g WHERE gram IN (SELECT gram FROM b)), k AS (SELECT doc_id, max(c) + 7 AS run FROM (SELECT doc_id, i, count(*) AS c FROM h GROUP BY ALL) GROUP BY doc_id),
runs AS (SELECT doc_id, source, CAST(coalesce(run, 0) AS BIGINT) AS run FROM documents LEFT JOIN k USING (doc_id))"""

_BY_RULE = {name: " + ".join(f"sum(n{i})" for i, r in enumerate(redaction.RULES) if r.name == name) for name in redaction.NAMES}

QUERIES = {f.__name__: f for f in (corpus_report, corpus_build, s1_chat_export_a, s2_chat_export_b, s5_conversation_stats, s8_work_manifest, s9_extensions, s13_archives, k1_split_write, k4_upsert, k5_stale_origins, k9_report_totals, k9_skipped, k10_release_scan, d1_exact_duplicates, d2_near_pairs, d3_dedup_counts, c1_chunks, c4_regroup, c6_passages, c6_candidates, l1_sealed, l2_hash_leaks, l3_quarantine, l5_copied_run, l7_regressions)}
ORACLE = {
    "corpus_report": f"""
WITH {redacted_sql("(SELECT * FROM conversations WHERE role = 'user')", 'conv_id, turn')},
i AS (SELECT 'chat' || conv_id % 5 AS source, conv_id * 1000 + turn AS pos, t AS text, {' + '.join(f'n{i}' for i in range(len(redaction.RULES)))} AS k FROM {LAST}),
c AS (SELECT source, count(*) AS items, count(*) FILTER (WHERE {WORDS} < 15) AS short, CAST(sum(k) AS BIGINT) AS redactions FROM i GROUP BY source),
d AS (SELECT *, row_number() OVER (PARTITION BY source, {NORMAL} ORDER BY pos) > 1 AS dup FROM i WHERE {WORDS} >= 15)
SELECT source, items, short, redactions, duplicates, kept, first_pos, last_pos FROM c LEFT JOIN (SELECT source, count(*) FILTER (WHERE dup) AS duplicates, count(*) FILTER (WHERE NOT dup) AS kept, min(pos) AS first_pos, max(pos) AS last_pos FROM d GROUP BY source) USING (source)""",
    "s1_chat_export_a": f"""WITH p AS (SELECT DISTINCT source FROM documents), m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, printf('%08d', conv_id) AS c8, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations)
SELECT c8 || '-c' AS conversation, position, CASE WHEN turn % 2 = 1 THEN t WHEN t = '' THEN '(end)' ELSE t || chr(10) || chr(10) || '(end)' END AS text, CASE WHEN turn % 3 = 0 THEN printf('2024-01-%02d', turn % 28 + 1) ELSE '2023-12-31' END AS date,
CASE WHEN conv_id % 4 = 1 THEN 'Own ' || conv_id % 5 WHEN conv_id % 2 = 0 AND 'src' || conv_id % 25 IN (SELECT source FROM p) THEN 'Project src' || conv_id % 25 END AS project,
'export.zip#conv:"' || CASE WHEN conv_id % 3 = 0 THEN c8 ELSE 'Talk ' || conv_id END || '"(' || c8 || ')#msg:' || printf('%08d', turn) AS origin FROM m WHERE role = 'user' AND (turn % 2 = 0 OR t <> '')""",
    "s2_chat_export_b": """WITH r AS (SELECT conv_id, turn, 'm' || turn // 2 AS message, 1704067200 + conv_id * 3600 AS started, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, printf('%08d', conv_id) AS c8 FROM conversations WHERE role = 'user' AND turn % 7 <> 6 QUALIFY row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) = 1)
SELECT c8 || '-c' AS conversation, message, CASE WHEN turn % 4 <> 0 THEN t WHEN t = '' THEN '(end)' ELSE t || chr(10) || chr(10) || '(end)' END AS text, CASE WHEN turn % 2 = 1 THEN strftime(make_timestamp(started * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') ELSE strftime(make_timestamp((started + turn * 60) * 1000000 + 250000), '%Y-%m-%dT%H:%M:%S.250Z') END AS date,
'export.zip#conv:"' || CASE WHEN conv_id % 3 = 0 THEN c8 ELSE 'Talk ' || conv_id END || '"(' || c8 || ')#msg:' || message AS origin FROM r WHERE turn % 4 = 0 OR t <> ''""",
    "s5_conversation_stats": "SELECT count(DISTINCT conv_id) AS conversations, CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS human, CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS assistant, (SELECT count(DISTINCT source) FROM documents) AS projects FROM conversations",
    "s8_work_manifest": f"WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents), e AS (SELECT *, CASE " + " ".join(f"WHEN regexp_full_match(path, '{glob_pattern(g)[2:-2]}') THEN {i}" for i, (g, _, _) in enumerate(MANIFEST)) + f" END AS e FROM p) SELECT doc_id, path, {[m[1] for m in MANIFEST]}[e + 1] AS label, {[m[2] for m in MANIFEST]}[e + 1] AS sensitivity FROM e",
    "s9_extensions": f"""WITH p AS (SELECT doc_id, {_PATH} AS path, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS text FROM documents), h AS (SELECT *, '<html><head>x</head><body><p>' || text || '</p></body></html>' AS html FROM p), t AS (SELECT *, {HTML} AS t FROM h),
b AS (SELECT doc_id, path, CASE doc_id % 8 WHEN 2 THEN {HTML_TEXT} WHEN 3 THEN trim(replace(text, chr(10), ' ')) WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE trim(text) END AS body FROM t)
SELECT doc_id, path, CASE WHEN body <> '' THEN sha256(body) END AS sha256, CASE WHEN body IS NULL THEN 'unsupported: ' || CASE doc_id % 8 WHEN 4 THEN 'png' ELSE 'pdf' END WHEN body = '' THEN 'empty' END AS skipped FROM b""",
    "s13_archives": "SELECT page_id, 'page.html' AS entry, length(html) AS chars, NULL AS error FROM pages WHERE page_id % 7 <> 0 UNION ALL SELECT page_id, 'meta/url.txt', length(url), NULL FROM pages WHERE page_id % 7 <> 0 UNION ALL SELECT page_id, NULL, NULL, 'unreadable archive' FROM pages WHERE page_id % 7 = 0",
    "k1_split_write": "SELECT CASE WHEN doc_id % 4 = 0 THEN 'public' ELSE 'private' END AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, min('work_file|' || source || '|' || doc_id) AS first FROM documents GROUP BY 1",
    "k4_upsert": f"WITH b AS (SELECT {_ID} AS id, min(doc_id) FILTER (WHERE doc_id % 3 <> 0) AS old, min(doc_id) AS doc_id, min(lang) AS label FROM documents GROUP BY 1) SELECT id, coalesce(old, doc_id + 1000000) AS doc_id, 'new-' || label AS label FROM b",
    "k5_stale_origins": "SELECT doc_id, source, CASE WHEN source IN ('src1', 'src7') THEN 'new' ELSE 'old' END AS version FROM documents",
    "k9_report_totals": f"""WITH {redacted_sql('documents', 'doc_id, source, text AS raw')}, i AS (SELECT doc_id, source, raw AS text, {', '.join(f'n{i}' for i in range(len(redaction.RULES)))} FROM {LAST}), m AS (SELECT *, {_DUP} AS dup, {WORDS} AS words FROM i)
SELECT CASE WHEN grouping(source) = 1 THEN 'total' ELSE source END AS source, count(*) AS n, min(CASE WHEN doc_id % 7 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INT), '%Y-%m-%d') END) AS first_date, max(CASE WHEN doc_id % 7 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INT), '%Y-%m-%d') END) AS last_date, count(*) FILTER (WHERE words < 15) AS short, count(*) FILTER (WHERE dup) AS copies, count(*) FILTER (WHERE NOT dup AND words >= 15 AND doc_id % 4 <> 0) AS private, count(*) FILTER (WHERE NOT dup AND words >= 15 AND doc_id % 4 = 0) AS public,
array_to_string(list_filter([{', '.join(f"CASE WHEN {k} > 0 THEN '{name}=' || CAST({k} AS BIGINT) END" for name, k in _BY_RULE.items())}], lambda x: x IS NOT NULL), ',') AS redactions, CASE WHEN coalesce(sum(CASE WHEN NOT dup AND words >= 15 THEN length(text) END), 0) < 27000 THEN 'under 30 minutes' END AS note FROM m GROUP BY ROLLUP (source)""",
    "k9_skipped": f"SELECT source, {_PATH} AS path, CASE doc_id % 8 WHEN 4 THEN 'unsupported: png' WHEN 5 THEN 'unsupported: pdf' ELSE 'empty' END AS skipped FROM documents WHERE doc_id % 8 IN (4, 5) OR (doc_id % 9 = 0)",
    "k10_release_scan": f"""WITH p AS (SELECT {_PATH} AS path, text || chr(10) AS content, doc_id % 8 = 4 AS media FROM documents),
f AS (SELECT path, strlen(content) AS length, sha256(content) AS sha256, nullif(array_to_string(list_filter([CASE WHEN NOT media AND regexp_matches(content, '(?i)token\\s*=') THEN 'token' END, CASE WHEN NOT media AND contains(content, 'Licensed under') THEN 'licence' END, CASE WHEN NOT media AND regexp_matches(content, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') THEN 'address' END, CASE WHEN media THEN 'media' END], lambda x: x IS NOT NULL), ','), '') AS found FROM p)
SELECT * FROM f UNION ALL SELECT NULL, CAST(sum(length) AS BIGINT), NULL, CASE WHEN count(found) > 0 THEN 'fail' ELSE 'pass' END FROM f""",
    "d1_exact_duplicates": f"SELECT doc_id, source, {_DUP} AS duplicate FROM documents",
    "d2_near_pairs": f"""WITH {_ITEMS}, c AS (SELECT *, min(doc_id) OVER (PARTITION BY source, list_sort(w), n) AS first FROM items WHERE len(w) > 0), k AS (SELECT * FROM c WHERE doc_id = first)
SELECT a.source AS source, a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.source = b.source AND a.doc_id < b.doc_id AND b.n / a.n BETWEEN 0.6 AND 1.67 WHERE len(list_intersect(a.w, b.w)) >= 0.88 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9
UNION ALL SELECT source, first, doc_id FROM c WHERE doc_id <> first""",
    "d3_dedup_counts": f"""WITH RECURSIVE x AS (SELECT doc_id, source, text, {_DUP} AS dup FROM documents), {_ITEMS.replace('FROM documents', 'FROM x WHERE NOT dup')}, p AS (SELECT a.source AS source, a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.source = b.source AND a.doc_id < b.doc_id AND b.n / a.n BETWEEN 0.6 AND 1.67 WHERE len(list_intersect(a.w, b.w)) >= 0.88 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9),
m AS (SELECT b, list(a) AS near, row_number() OVER (ORDER BY b) AS i FROM p GROUP BY b), r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT m.i, CASE WHEN len(list_filter(near, lambda y: NOT list_contains(gone, y))) > 0 THEN list_append(gone, m.b) ELSE gone END FROM r JOIN m ON m.i = r.i + 1),
g AS (SELECT unnest(gone) AS doc_id FROM r WHERE i = (SELECT max(i) FROM r)) SELECT source, CASE WHEN dup THEN 'exact' WHEN doc_id IN (SELECT doc_id FROM g) THEN 'near' ELSE 'kept' END AS verdict, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM x GROUP BY 1, 2""",
    "c4_regroup": "WITH r AS (SELECT source, doc_id, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS before FROM documents) SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM r WHERE before < 6000 GROUP BY source",
    "c6_passages": f"""WITH s AS (SELECT doc_id, list_filter(list_transform({SENTENCES}, lambda x: trim(x, ' ')), lambda x: x <> '') AS list FROM documents),
k AS (SELECT doc_id, list_prepend({{'held': '', 'n': 0::BIGINT, 'out': []::VARCHAR[]}}, list_transform(list, lambda y: {{'held': y, 'n': len({TOKENS.format(x='y')})::BIGINT, 'out': []::VARCHAR[]}})) AS list FROM s),
r AS (SELECT doc_id, list_reduce(list, lambda a, x: {{'held': CASE WHEN a.n + x.n >= 40 THEN '' WHEN a.held = '' THEN x.held ELSE a.held || ' ' || x.held END, 'n': CASE WHEN a.n + x.n >= 40 THEN 0 ELSE a.n + x.n END, 'out': CASE WHEN a.n + x.n BETWEEN 40 AND 120 THEN list_append(a.out, CASE WHEN a.held = '' THEN x.held ELSE a.held || ' ' || x.held END) ELSE a.out END}}).out AS out FROM k)
SELECT doc_id, unnest(range(len(out))) AS pos, unnest(out) AS passage FROM r""",
    "c6_candidates": f"""WITH s AS (SELECT doc_id, list_filter(list_transform({SENTENCES}, lambda x: trim(x, ' ')), lambda x: x <> '') AS list FROM documents),
k AS (SELECT doc_id, list_prepend({{'held': '', 'n': 0::BIGINT, 'out': []::VARCHAR[]}}, list_transform(list, lambda y: {{'held': y, 'n': len({TOKENS.format(x='y')})::BIGINT, 'out': []::VARCHAR[]}})) AS list FROM s),
r AS (SELECT doc_id, list_reduce(list, lambda a, x: {{'held': CASE WHEN a.n + x.n >= 40 THEN '' WHEN a.held = '' THEN x.held ELSE a.held || ' ' || x.held END, 'n': CASE WHEN a.n + x.n >= 40 THEN 0 ELSE a.n + x.n END, 'out': CASE WHEN a.n + x.n BETWEEN 40 AND 120 THEN list_append(a.out, CASE WHEN a.held = '' THEN x.held ELSE a.held || ' ' || x.held END) ELSE a.out END}}).out AS out FROM k)
SELECT 'document:' || doc_id AS origin, CASE doc_id % 4 WHEN 0 THEN 'spoken' ELSE 'written' END AS mode, unnest(range(len(out))) AS pos, unnest(out) AS text FROM r WHERE doc_id % 4 IN (0, 2) UNION ALL SELECT 'turn:' || conv_id || ':' || turn, 'written', 0, text FROM conversations WHERE role = 'user' AND len({TOK}) BETWEEN 40 AND 120""",
    "l1_sealed": f"WITH d AS (SELECT doc_id, {NORMAL} AS n FROM documents), b AS (SELECT item_id, {NORMAL} AS s FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON contains(n, s) OR contains(s, n) WHERE length(n) >= 40 AND length(s) >= 40",
    "l2_hash_leaks": f"WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents), n AS (SELECT doc_id, {NORMAL} AS n FROM t) SELECT DISTINCT doc_id, item_id, 'content' AS how FROM n JOIN (SELECT item_id, {NORMAL} AS n FROM benchmark) USING (n) UNION SELECT doc_id, item_id, 'provenance' FROM documents JOIN benchmark ON item_id % 10 = 0 AND starts_with('q' || doc_id % 997 || '-answer', 'q' || item_id || '-')",
    "l3_quarantine": f"WITH d AS (SELECT doc_id, source, {NORMAL} AS n FROM documents), b AS (SELECT item_id, {NORMAL} AS s FROM (SELECT item_id, substr(text, 1, 80) AS text FROM benchmark WHERE length(text) >= 40)) SELECT source, count(DISTINCT item_id) AS items, count(*) AS hits FROM d JOIN b ON contains(n, s) WHERE length(s) >= 40 AND length(n) >= 40 GROUP BY source",
    "l5_copied_run": f"WITH {_RUNS} SELECT doc_id, run FROM runs",
    "l7_regressions": f"""WITH g AS (SELECT conv_id, turn, {_GRAMS8} FROM (SELECT conv_id, turn, {TOK} AS w FROM conversations)), f AS (SELECT DISTINCT a.conv_id, a.turn FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn = b.turn + 2 AND a.gram = b.gram),
k AS (SELECT conv_id, turn + 1 AS turn, list_distinct(list_filter({TOK}, lambda w: len(w) > 3 AND NOT list_contains({rules.KEYWORD_STOP}, w))) AS keys FROM conversations), j AS (SELECT c.conv_id AS conv_id, c.turn AS turn, lower(text) AS reply, keys, (c.conv_id, c.turn) IN (SELECT (conv_id, turn) FROM f) AS again FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn),
l AS (SELECT *, coalesce(turn % 2 = 1 AND len(keys) >= 2 AND len(list_filter(keys, lambda w: contains(reply, w))) / len(keys) < 0.3, false) AS lacking FROM j)
SELECT conv_id, turn, again OR lacking AS failed, CASE WHEN again THEN 'rejected again' WHEN lacking THEN 'correction missing' END AS reason, (again OR lacking) AND turn % 3 <> 0 AS newly_failing FROM l""",
}
