"""Operators against brute force on small inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import chunk, dedup, holdout, intervals, scans, similarity, style
from scriptorium.plans import corpus
from scriptorium.sources import sinks
from scriptorium.streaming import events as stream


def items(seed, n=80):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(90)}" for _ in range(25)] for _ in range(5)]
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(25)] = f"x{r.randrange(30)}"
        out.append((i, r.choice("ab"), " ".join(w)))
    return out + [(n, "a", ""), (n + 1, "a", "?!"), (n + 2, "a", None)]


def greedy(rows, t):
    """The sequential definition: compare with kept earlier rows of the group."""
    verdict, kept, seen = {}, {}, set()
    for i, g, text in rows:
        norm = re.sub(r"\s+", " ", (text or "").lower()).strip()
        words = set(re.sub(r"[^\w ]", "", norm).split())
        if (g, norm) in seen and text is not None:
            verdict[i] = "exact"
            continue
        seen.add((g, norm))
        near = any(words and w and len(words & w) >= t * len(words | w) - 1e-9 and 0.6 <= len(norm) / n <= 1.67 for w, n in kept.get(g, []))
        verdict[i] = "near" if near else "kept"
        if not near:
            kept.setdefault(g, []).append((words, len(norm) or 1))
    return verdict


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_is_the_sequential_one(spark, seed):
    rows = items(seed)[:-1]
    df = spark.createDataFrame(rows, "id long, g string, text string").repartition(7)
    got = {r.id: r.verdict for r in dedup.dedup(df, "g", "id", "text", 0.7).collect()}
    assert got == greedy(rows, 0.7)


def test_dedup_judges_rows_with_a_null_group_or_text(spark):
    words = [f"w{i}" for i in range(25)]
    rows = [(1, None, " ".join(words)), (2, None, " ".join(words)), (3, None, " ".join(words[:-1] + ["x"])), (4, None, None), (5, None, None), (6, "a", None), (7, "a", None), (8, "a", " ".join(words))]
    df = spark.createDataFrame(rows, "id long, g string, text string").repartition(3)
    assert {r.id: r.duplicate for r in dedup.exact_duplicates(df, "g", "id", "text").collect()} == {i: i in (2, 5, 7) for i in range(1, 9)}
    want = {1: "kept", 2: "exact", 3: "near", 4: "kept", 5: "exact", 6: "kept", 7: "exact", 8: "kept"}
    assert {r.id: r.verdict for r in dedup.dedup(df, "g", "id", "text", 0.7).collect()} == want


def test_near_pairs_are_those_of_classes(spark):
    rows = items(3)[:-1]
    df = spark.createDataFrame(rows, "id long, g string, text string").repartition(7)
    sets, firsts, want = {}, {}, set()
    for i, g, text in sorted(rows):
        norm = re.sub(r"\s+", " ", text or "").strip().lower()
        words = frozenset(re.sub(r"[^\w ]|_", "", norm).split())
        if words:
            first = firsts.setdefault((g, words, len(norm)), i)
            if first == i:
                sets[i] = (g, words, len(norm))
            else:
                want.add((g, first, i))
    for a, (g, x, n) in sets.items():
        for b, (h, y, m) in sets.items():
            if a < b and g == h and 0.6 <= m / n <= 1.67 and len(x & y) >= 0.7 * len(x | y) - 1e-9:
                want.add((g, a, b))
    assert {tuple(r) for r in dedup.near_pairs(df, "g", "id", "text", 0.7).collect()} == want
    assert want


def test_cliques_are_stars(spark, monkeypatch):
    """5,000 rows with one set of tokens, and 400 variants of one text: no list of all their pairs."""
    words = [f"w{i}" for i in range(30)]
    r = random.Random(2)
    equal = [(i, "a", " ".join(r.sample(words, 30))) for i in range(5000)]
    df = spark.createDataFrame(equal, "id long, g string, text string")
    got = dedup.near_pairs(df, "g", "id", "text").collect()
    assert len(got) == 4999 and {x.a for x in got} == {0}
    variants = [(i, "a", " ".join([*words, f"v{i}"])) for i in range(400)]
    seen = []
    verified = dedup._verified
    monkeypatch.setattr(dedup, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1])
    df = spark.createDataFrame(variants, "id long, g string, text string")
    got = {x.id: x.verdict for x in dedup.dedup(df, "g", "id", "text").collect()}
    assert got == greedy(variants, dedup.THRESHOLD) and sum(v == "near" for v in got.values()) == 399
    assert sum(seen) < 2 * 400


def test_salted_tokens_and_rounds(spark, monkeypatch):
    for salt, dense in ((2, 10**9), (3, 1)):
        monkeypatch.setattr(dedup, "SALT_ROWS", salt)
        monkeypatch.setattr(dedup, "DENSE", dense)
        rows = items(4)[:-1]
        df = spark.createDataFrame(rows, "id long, g string, text string").repartition(3)
        assert {r.id: r.verdict for r in dedup.dedup(df, "g", "id", "text", 0.7).collect()} == greedy(rows, 0.7)


def test_greedy_chain(spark):
    pairs = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 4), ("g", 1, 5), ("g", 4, 5)], "g string, a long, b long")
    assert sorted(r.dropped for r in dedup.greedy_drops(pairs, "g").distinct().collect()) == [2, 4, 5]


def clustered(seed, n=900, d=12, of=15, width=0.15):
    r = np.random.default_rng(seed)
    x = r.standard_normal((of, d))[r.integers(0, of, n)] + width * r.standard_normal((n, d))
    x[5:9] = x[4]  # equal vectors
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def small_cells(monkeypatch):
    for name, value in (("CELL_ROWS", 60), ("BLOCK_ROWS", 40), ("QUERY_ROWS", 7), ("SAMPLE_ROWS", 300)):
        monkeypatch.setattr(similarity, name, value)


def test_inverted_file_is_exact_and_skips_blocks(spark, monkeypatch):
    small_cells(monkeypatch)
    x = clustered(3)
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, "a", None), (None, "a", x[0].tolist()), (5001, "a", [1.0, 0.0]), (5002, "a", [1.0, 0.1]), (5003, None, x[0].tolist()), (5004, None, x[1].tolist()), (5005, "a", [0.0] * 12), (5006, "a", [1.0, None])]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>").repartition(5)
    ask = df.where("id % 10 = 0 or id >= 5000")
    met, visits = [], similarity.Inverted.pairs
    monkeypatch.setattr(similarity.Inverted, "pairs", lambda self, v, *rest: (met.append((v.count(), self.blocks.count())), visits(self, v, *rest))[1])
    whole = {}
    for i, g, v in rows:
        if i is not None and v is not None and None not in v:
            whole.setdefault((g, len(v)), []).append((i, np.array(v) / max(np.linalg.norm(v), 1e-12)))
    top, near = {}, set()
    for own in whole.values():
        for i, v in own:
            d = sorted((round(1 - v @ w, 9), j) for j, w in own if j != i)
            if i % 10 == 0 or i >= 5000:
                top[i] = d[:6]
                near |= {(i, j) for c, j in d if c < 0.05}
    got = {}
    for q in similarity.top_k(df, ask, "id", "v", 6, "g").collect():
        got.setdefault(q.query_id, []).append((round(q.distance, 9), q.id))
    assert {i: sorted(d) for i, d in got.items()} == {i: d for i, d in top.items() if d}
    assert {(q.query_id, q.id) for q in similarity.pairs_within(df, ask, "id", "v", 0.05, "g").collect()} == near
    asked = 98
    assert all(visited < 0.5 * asked * blocks for visited, blocks in met)


def test_leaders_of_many_rows(spark, monkeypatch):
    """Taken in several rounds, and by pairs once few rows fall."""
    small_cells(monkeypatch)
    x = clustered(5, 400, width=0.4)
    df = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "id long, g string, v array<double>").repartition(4)
    want = {}
    for i, v in enumerate(x):
        near = [j for j in range(i) if want[j] == j and j % 2 == i % 2 and x[j] @ v >= 0.8]
        want[i] = near[0] if near else i
    for leaders, falling in ((50, 0.0), (30, 0.5), (10**6, 0.05)):
        monkeypatch.setattr(similarity, "LEADER_ROWS", leaders)
        monkeypatch.setattr(similarity, "FALLING", falling)
        assert {q.id: q.leader for q in similarity.leader_clusters(df, "id", "v", "g", 0.8).collect()} == want


def test_leader_clusters(spark):
    r = np.random.default_rng(4)
    x = (r.standard_normal((6, 8))[r.integers(0, 6, 60)] + 0.35 * r.standard_normal((60, 8))).tolist()
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(x)], "id long, g string, v array<double>").repartition(4)
    got = {q.id: q.leader for q in similarity.leader_clusters(df, "id", "v", "g", 0.62).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    want, used = {}, set()
    for i in range(60):
        if i not in used:
            for j in range(i, 60):
                if j not in used and (j == i or u[i] @ u[j] >= 0.62):
                    want[j] = i
                    used.add(j)
    assert got == want


def test_chunks_keep_all_words_and_limits(spark):
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice(["word ", "longer ", "a. ", "b! ", "\n", "\n\n", "x" * 30 + " "]) for _ in range(r.randrange(400)))
        out = chunk.chunks(text, 40, 30)
        assert " ".join(" ".join(out).split()) == " ".join(text.split())
        assert all(chunk.count_tokens(c) <= 40 for c in out)
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "s. " * 900)], "id long, text string")
    rows = chunk.chunk_rows(df, "id", "text").collect()
    assert {q.id for q in rows} == {1, 3} and all(q.of == sum(p.id == q.id for p in rows) for q in rows)


def test_passages(spark):
    text = " ".join(f"{' '.join(['word'] * n)}." for n in (10, 35, 5, 130, 20, 25))
    got = spark.createDataFrame([(text,)], "t string").select(chunk.passages(F.col("t")).alias("p")).first().p
    assert [len(p.split()) for p in got] == [45, 45]


def test_copied_run(spark):
    source = spark.createDataFrame([("one two three four five six seven eight nine ten eleven",)], "t string")
    replies = spark.createDataFrame([(1, "so two three four five six seven eight nine ten end"), (2, "nothing of it"), (3, None)], "id long, t string")
    assert {r.id: r.run for r in holdout.longest_copied_run(replies, "id", "t", source, "t").collect()} == {1: 9, 2: 0, 3: 0}


def test_sealed(spark):
    docs = spark.createDataFrame([(1, "xx the quick brown fox jumps over the lazy dog and more words follow yy"), (2, "the quick brown fox only, then something else entirely for a while")], "id long, t string")
    sealed = spark.createDataFrame([(7, "Quick brown fox jumps over the lazy dog and more"), (8, "incomprehensibilities characteristically!!")], "sid long, s string")
    assert [tuple(r) for r in holdout.sealed_matches(docs, "id", "t", sealed, "sid", "s").collect()] == [(1, 7)]
    short = spark.createDataFrame([(9, "x incomprehensibilities characteristically!! y")], "id long, t string")
    assert [tuple(r) for r in holdout.sealed_matches(short, "id", "t", sealed, "sid", "s").collect()] == [(9, 8)]


def test_manifest(spark):
    fits = lambda g, p: bool(re.match(corpus.glob_pattern(g).replace("\\z", "\\Z"), p))
    assert not fits("*.md", "sub/bio.md") and fits("specs/**/*.pdf", "specs/a/b.pdf") and fits("**/*.txt", "c.txt") and not fits("file?.txt", "file10.txt")
    files = spark.createDataFrame([("a.md",), ("b/c.txt",), ("z.bin",)], "path string")
    m = corpus.match_manifest(files, "path", [("*.md", "x", "public"), ("**/*.txt", "y", "private"), ("**", "z", "private")])
    assert {r.path: r.label for r in m.collect()} == {"a.md": "x", "b/c.txt": "y", "z.bin": "z"}
    with pytest.raises(ValueError, match="z.bin"):
        corpus.require_matched(corpus.match_manifest(files, "path", [("*.md", "x", "public"), ("**/*.txt", "y", "private")]), "path")
    with pytest.raises(ValueError, match="sensitivity"):
        corpus.match_manifest(files, "path", [("*", "x", "internal")])


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, label string")
    new = spark.createDataFrame([("b", 9, "new"), ("c", 3, "z")], "id string, n int, label string")
    once = corpus.upsert(old, new, "id", ["label"])
    assert sorted(map(tuple, once.collect())) == [("a", 1, "x"), ("b", 2, "new"), ("c", 3, "z")]
    assert sorted(map(tuple, corpus.upsert(once, new, "id", ["label"]).collect())) == sorted(map(tuple, once.collect()))


def test_intervals(spark):
    s = spark.createDataFrame([("r", 4.0, 5.0), ("r", 11.0, 12.0), ("r", 30.0, 31.0)], "rec string, start double, end double")
    spans = intervals.speech_spans(s, "rec", 33.5)
    assert sorted((r.start, r.end) for r in spans.collect()) == [(0, 4), (5, 11), (12, 30), (31, 33.5)]
    clips = intervals.plan_clips(spans, "rec", 33.5).collect()
    kept = sorted((round(r.start, 2), round(r.end, 2)) for r in clips if r.dropped is None)
    assert kept == [(0, 11.15)] and sorted(r.dropped for r in clips if r.dropped) == ["too long", "too short"]
    one = spark.createDataFrame([("r", 0.0, 40.0), ("q", 0.0, 9.0), ("p", 2.0, 30.0)], "rec string, start double, end double")
    finer = spark.createDataFrame([("r", 0, 14.0, 14.5), ("r", 1, 28.0, 28.4), ("q", 0, 3.0, 4.0), ("r", 1, 5.0, 6.0), ("p", 0, 2.3, 9.0), ("p", 1, 10.0, 11.0)], "rec string, level int, start double, end double")
    got = sorted((r.rec, r.start, r.end) for r in intervals.refine_spans(one, finer, "rec", [0, 1]).collect())
    assert got == [("p", 2.0, 10.0), ("p", 11.0, 30.0), ("q", 0.0, 9.0), ("r", 0.0, 14.0), ("r", 14.5, 28.0), ("r", 28.4, 40.0)]


def greedy_clips(spans, total):
    """The definition, span by span."""
    out, i = [], 0
    while i < len(spans):
        start, end = spans[i]
        j = i
        if end - start > 15:
            out.append((start, end, "too long"))
        else:
            while j + 1 < len(spans) and spans[j + 1][1] - start <= 15:
                j += 1
            a, b = max(0.0, start - 0.15), min(total, spans[j][1] + 0.15)
            out.append((a, b, "too short" if b - a < 3 else None))
        i = j + 1
    return out


def test_clips_over_many_buckets(spark, monkeypatch):
    """Equal to the fold, whatever the buckets cut."""
    monkeypatch.setattr(intervals, "BUCKET", 20.0)
    r = random.Random(6)
    rows, want = [], []
    for rec in ["a", "b", "c", "d", None]:
        spans, at = [], r.choice([0.0, 55.0])
        for _ in range(r.choice([1, 60, 200])):
            at = round(at + r.choice([0.06, 0.5, 3.0, 16.0, 70.0]) * r.random() + 0.06, 3)
            end = round(at + r.choice([0.2, 2.0, 7.0, 14.9, 15.0, 22.0, 60.0]) * r.random() + 0.01, 3)
            spans.append((at, end))
            at = end
        rows += [(rec, *x) for x in spans]
        want += [(rec, *x) for x in greedy_clips(spans, 10_000.0)]
    df = spark.createDataFrame(rows, "rec string, start double, end double").repartition(5)
    assert sorted(map(tuple, intervals.plan_clips(df, "rec", 10_000.0).collect()), key=str) == sorted(want, key=str)
    assert intervals.plan_clips(df.limit(0), "rec", 10.0).count() == 0


def test_clips_of_many_recordings_take_no_call_each(spark):
    spans = spark.range(3_000).selectExpr("id AS rec", "explode(sequence(0, 2)) AS i").selectExpr("rec", "i * 600.0D + rec % 7 AS start", "i * 600.0D + rec % 7 + 5 AS end")
    clips = intervals.plan_clips(spans, "rec", 3600.0)
    assert clips.count() == 9_000
    assert "FlatMapGroups" not in clips._jdf.queryExecution().optimizedPlan().toString()


def test_scans_equal_windows(spark):
    """One subject has 90 in 100 rows; others, and none, have few."""
    r = random.Random(8)
    rows = [(i, r.choices([7, None, *range(20)], [180, 3, *[1] * 20])[0], r.randrange(400), r.choice([None, None, i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, u long, t long, v long").repartition(6)
    by = Window.partitionBy("u").orderBy("t", "id")
    want = df.withColumn("n", F.row_number().over(by)).withColumn("before", F.last("v", True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    got = scans.scanned(df, "u", [F.col("t"), F.col("id")], "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    down = scans.scanned(df.withColumn("s", F.col("u").cast("string")), "s", [F.desc("t"), F.desc("id")])
    last = Window.partitionBy("u").orderBy(F.desc("t"), F.desc("id"))
    assert sorted((x.id, x.n) for x in down.collect()) == sorted((x.id, x.n) for x in df.withColumn("n", F.row_number().over(last)).collect())
    sparse = df.withColumn("v", F.when(F.col("id") == 5, F.col("v")).otherwise(F.when(F.col("t") == 0, F.col("id"))))
    want = sparse.withColumn("before", F.last("v", True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    assert sorted((x.id, x.before) for x in scans.scanned(sparse, "u", [F.col("t"), F.col("id")], "v").collect()) == sorted((x.id, x.before) for x in want.collect())
    assert scans.scanned(df.limit(0), "u", [F.col("t")], "v").count() == 0


def test_split_write_and_rebuild(spark, tmp_path):
    rows = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "key string, public boolean")
    private, public = sinks.write_split(rows, "public", "key", str(tmp_path / "out"))
    assert sorted(r.key for r in spark.read.json(private).collect()) == ["b", "c"] and [r.key for r in spark.read.json(public).collect()] == ["a"]
    path = str(tmp_path / "sources")
    sinks.rebuild_sources(spark.createDataFrame([("s1", 1), ("s2", 2)], "source string, n int"), "source", path)
    sinks.rebuild_sources(spark.createDataFrame([("s1", 5)], "source string, n int"), "source", path)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [2, 5]


def test_capture_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/conversations.parquet"
    turns = spark.read.parquet(src)
    turns.write.parquet(str(tmp_path / "in"))
    out = {}

    def write(name, batch, number):
        out.setdefault(name, {})[number] = batch.collect()  # a replay replaces its batch

    q = stream.capture_stream(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")), write, str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    got = sorted(tuple(r) for rows in out["raw"].values() for r in rows)
    assert got == sorted(map(tuple, stream.captured(turns).collect())) and got


def test_hourly_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    s = stream.hourly(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("hourly_counts").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select * from hourly_counts").collect())) == sorted(map(tuple, stream.hourly(events).collect()))


def streamed(spark, tmp_path, df, make, name, mode):
    """What a stream over `df`, read in several batches, leaves behind."""
    df.repartition(4).write.parquet(str(tmp_path / name))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return sorted(map(tuple, spark.sql(f"select * from {name}").collect()), key=str)


def test_running_style_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    got = streamed(spark, tmp_path, docs, lambda s: stream.running_style(s, "lang", "text"), "running_style", "complete")
    assert got == sorted(map(tuple, stream.running_style(docs, "lang", "text").collect()), key=str) and got


def test_replays_have_no_effect_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts")).limit(300)
    twice = events.unionByName(events)
    one_hour = twice.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))  # within the retention
    got = streamed(spark, tmp_path, one_hour, lambda s: stream.first_of_each(s, "event_id", "ts"), "replays", "append")
    assert [x[0] for x in got] == sorted((r.event_id for r in events.collect()), key=str)


def test_session_stream_ends_as_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    # one day in all, so that the watermark drops nothing
    close = events.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") % 36_000_000_000)).where("user_id < 12")
    reset = F.col("event_type") == "signup"
    got = streamed(spark, tmp_path, close, lambda s: stream.session_stream(s, "user_id", "ts", "event_id", reset), "session_memory", "update")
    last = {}
    for user, version, *_ in got:
        last[user] = max(version, last.get(user, 0))
    end = sorted((user, event, place) for user, version, event, place in got if version == last[user] and place)
    assert end == sorted((r.user_id, r.event_id, r.position) for r in stream.session_memory(close, "user_id", "ts", "event_id", reset).collect()) and end


def last_of(rows):
    """The row of the highest version of each key."""
    out = {}
    for r in rows:
        if r[0] not in out or r[1] >= out[r[0]][1]:
            out[r[0]] = r
    return out


def test_cadence_stream_ends_as_the_batch(spark, tmp_path):
    """Shuffled micro-batches: checks (resets) come before and after what they clear."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    close = events.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") % 36_000_000_000)).where("user_id < 9").orderBy(F.xxhash64("event_id"))
    got = streamed(spark, tmp_path, close, lambda s: stream.cadence_stream(s, "user_id", "ts", F.col("event_type") == "signup", 3), "cadence", "update")
    want = {r.user_id: (r.since, r.due) for r in stream.due_checks(close, 3).collect()}
    assert {k: r[2:] for k, r in last_of(got).items()} == want and {d for _, d in want.values()} == {True, False}


def test_retention_streams(spark, tmp_path):
    """Late turns are stored but don't live; a key that is long silent has no live turns and no state."""
    at = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    batches = [[("a", 1, at(20)), ("b", 2, at(20)), ("a", 3, at(10))], [("a", 4, at(30)), ("c", 5, at(60))], [("a", 6, at(2)), ("c", 7, at(61))], [("c", 8, at(62))]]
    kind = "user_id string, event_id long, ts timestamp"
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "user_id string, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n}"))
    seen = []
    for n in range(len(batches)):  # one folder after the other arrives
        spark.read.schema(kind).parquet(str(tmp_path / "in" / f"{n}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "arrived"))
        source = spark.readStream.schema(kind).parquet(str(tmp_path / "arrived"))
        for q in stream.retention_streams(source, "user_id", "ts", str(tmp_path / "raw"), lambda df, _: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp")):
            assert q.awaitTermination(180)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "raw")).collect()) == list(range(1, 9))
    assert ("a", 2, 2) in seen and ("a", 3, 2) in seen  # 20 and 10 h, then 30 and 20 h
    last = last_of(seen)
    assert last["a"][2] == 0 and last["b"][2] == 0  # expired: the watermark is at 50 h
    assert last["c"] == ("c", 3, 3) and not any(r[0] == "a" and r[1] > 3 for r in seen)


def test_session_memory(spark):
    rows = [("u", i, f"2024-01-01 {h:02d}:00:00", k) for i, (h, k) in enumerate([(0, "t"), (1, "t"), (20, "t"), (21, "r"), (22, "t"), (23, "t")])]
    df = spark.createDataFrame(rows, "u string, id long, ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = stream.session_memory(df, "u", "ts", "id", F.col("k") == "r").collect()
    assert sorted((r.position, r.id) for r in got) == [(1, 4), (2, 5)]


def test_sealed_texts_of_any_number_of_words(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcde") for _ in range(n))
    sealed = [" ".join(word(r.randrange(*size)) for _ in range(n)) for n, size in ((1, (40, 50)), (2, (20, 40)), (3, (14, 20)), (4, (10, 14)), (5, (8, 12)), (6, (7, 9)), (12, (3, 6))) for _ in range(6)]
    docs = [f"{word(5)}{x if k % 2 else x[:-1]}{word(4)} {word(9)}" for k, x in enumerate(sealed)] + [f"{word(3)} {x.upper()}  {word(3)}" for x in sealed] + [word(60), " ".join(word(4) for _ in range(30)), None, "", "short"]
    d = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    s = spark.createDataFrame([*enumerate(sealed), (900, None), (901, "tiny")], "item long, text string")
    got = sorted(map(tuple, holdout.sealed_matches(d, "id", "text", s, "item", "text").collect()))
    assert got == sorted((i, j) for i, t in enumerate(docs) for j, x in enumerate(sealed) if x in " ".join((t or "").lower().split()))
    assert holdout.sealed_matches(d, "id", "text", s.limit(0), "item", "text").count() == 0


def test_most_frequent_drops_rare_rows_before_it_ranks(spark):
    rows = [(g, f"w{i:03}", 1 if i >= 30 else 100 - i // 2) for g in ("a", None) for i in range(400)] + [("few", "x", 1)]
    counts = spark.createDataFrame(rows, "g string, gram string, count long")
    for k in (7, 10, 35):
        got = style.most_frequent(counts, ["g"], k)
        want = {r for g in ("a", None, "few") for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:k]}
        assert {tuple(r) for r in got.collect()} == want
    plan = style.most_frequent(counts, ["g"], 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_sealed_texts_longer_than_every_text_meet_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "x")], "id long, text string")
    sealed = spark.createDataFrame([(7, "two three four five six seven eight nine ten"), (8, "two three four five six seven eight nine ten eleven twelve thirteen")], "sid long, s string")
    monkeypatch.setattr(holdout, "_met", lambda split, anchored, kinds, met=holdout._met: seen.append([r.sid for r in anchored.collect()]) or met(split, anchored, kinds))
    seen = []
    got = holdout.sealed_matches(docs, "id", "text", sealed, "sid", "s")
    assert [tuple(r) for r in got.collect()] == [(1, 7)] and seen == [[7]]
    assert holdout.sealed_matches(docs, "id", "text", sealed.where("sid = 8"), "sid", "s").count() == 0 and seen == [[7]]
    outer = next(line for line in got._jdf.queryExecution().analyzed().toString().splitlines() if "Join Inner" in line)
    assert "sid#" not in outer  # sealed texts join the pairs first, and only then the texts


def test_queries_of_a_task_are_compared_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id long, v array<double>")
    monkeypatch.setattr(similarity, "MET_ROWS", 7)
    got = {(r.query_id, r["rank"]): r.id for r in similarity.top_k(df, df, "id", "v", 3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T + np.diag(np.full(60, 9.0))
    assert got == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}


def test_normal_forms_for_copies_are_made_once(spark, capsys):
    """The verdicts read which rows are copies; they do not digest all normal forms again."""
    rows = [(1, "a", "one two three"), (2, "a", "one  two three"), (3, "b", "one two three"), (4, "a", "four five six")]
    got = dedup.dedup(spark.createDataFrame(rows, "id long, g string, text string"), "g", "id", "text")
    assert {r.id: r.verdict for r in got.collect()} == {1: "kept", 2: "exact", 3: "kept", 4: "kept"}
    got.explain()
    assert "sha2" not in capsys.readouterr().out


def test_places_of_grams_make_the_counts_of_all_lengths(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), " ".join(rng.choice("xyz") for _ in range(rng.randrange(9)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, text string")
    places = style.gram_places(df, ["g"], "text").groupBy("g", "_w0", "_w1", "_w2").agg(F.count("*").alias("count"))
    got = [tuple(r) for n in (1, 2, 3) for r in style.grams_at(places, ["g"], n).collect()]
    assert sorted(got, key=str) == sorted(map(tuple, style.gram_counts(df, ["g"], "text").collect()), key=str)


def test_frequent_grams_are_those_of_all_counts(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), " ".join(rng.choice("xyzuv") for _ in range(rng.randrange(9)))) for _ in range(90)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, text string")
    want = style.gram_counts(df, ["g"], "text").where("n = 1 OR count >= 4")
    got = style.frequent_grams(df, ["g"], "text", 4)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_texts_cut_once_have_the_same_sentences(spark):
    texts = ["Well, it's one. TWO, three!?  four\nfive six seven", " \n .", "...", "", None, "a-b c.d e!f", "Ünï 3.5 -- x\ty z"]
    df = spark.createDataFrame([("g", t) for t in texts], "g string, text string").withColumn("cut", style.cut_sentences(F.col("text")))
    from scriptorium.functions import text as tx

    for r in df.select(F.flatten("cut").alias("a"), tx.style_tokens(F.col("text")).alias("b")).collect():
        assert r.a == r.b
    lengths = lambda **cut: sorted(r.length for r in style.sentence_lengths(df, ["g"], "text", **cut).collect())
    assert lengths(cut=F.col("cut")) == lengths() != []


def test_dedup_deletes_what_its_steps_wrote(spark, monkeypatch):
    from scriptorium.session import Scratch

    monkeypatch.setattr(dedup, "DENSE", 0)  # rounds, too
    rows = [("a", i, f"{' '.join(f'w{j}' for j in range(30))} x{i % 6} {'again' * (i // 9)}") for i in range(40)] + [("a", 90, "one two"), ("a", 91, "one two")]
    df = spark.createDataFrame(rows, "g string, o long, text string")
    scratch, plain = Scratch(spark), Scratch(spark)
    given = scratch.write(df, "given")
    got = dedup.dedup(given, "g", "o", "text", scratch=scratch)
    assert {n.rstrip("0123456789") for n, _ in scratch.paths} <= {"marked", "classes", "fallen", "pairs", "dropped"}
    want = dedup.dedup(plain.write(df, "other"), "g", "o", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("verdict <> 'kept'").count() > 20
    scratch.drop()
    assert not scratch.paths


def test_the_build_keeps_no_copies_of_texts_but_the_kept(spark):
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    corpus.corpus_build(spark, "/root/testdata/sf0.001")
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(shared)) - before} == {"kept"}
