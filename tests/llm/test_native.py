import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat_format as cf
from scriptorium.llm import mixing as mx
from scriptorium.llm import quality_rules as qr

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def odd_texts():
    r = random.Random(4)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\ny\n x\nx\n", "é # <b> | $", "a b c d", "the end of " * 40_000]
    out += ["".join(r.choice("ab \n#\x0b") for _ in range(r.randrange(200))) for _ in range(60)]
    return out


def test_base_statistics(spark):
    rows = [(i, t, 9) for i, t in enumerate(odd_texts())]
    got = {r.id: tuple(r)[1:] for r in qr.base_statistics(spark.createDataFrame(rows, "id long, text string, n_words int"), "text", "id").collect()}
    for i, t, _ in rows:
        assert got[i] == base(t), repr(t)[:80]


def test_quality_rules_on_labels(spark):
    got = {r.doc_id: r for r in qr.op3_quality_rules(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        n, chars, symbols, lines, repeats = base(docs[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r.kept, labels[i]) for i, r in got.items() if i in labels and not r.base_failed]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.97


FLOOR = np.diag(np.array(list(qr.STATISTICS.values())) ** 2)


def steps(x, mean, cov):
    """Concentration steps on exact shares until the determinant falls no more."""
    best, h = (np.inf, None, None), math.ceil(qr.SHARE * len(x))
    while True:
        z = np.linalg.solve(np.linalg.cholesky(cov + FLOOR), (x - mean).T)
        near = x[np.argsort((z**2).sum(axis=0), kind="stable")[:h]]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * qr.consistency()
        det = np.linalg.det(cov + FLOOR)
        if det >= best[0] * (1 - 1e-9):
            return best
        best = det, mean, cov


def grouped_vectors():
    """Groups of several shapes, one with a null key, one tiny, one of equal vectors, one half of outliers' size."""
    r = np.random.default_rng(8)
    out = []
    for n, lang, source in ((900, "en", "s"), (400, None, "s"), (300, "en", None), (6, "de", "s"), (40, "fr", "t")):
        x = r.standard_normal((n, qr.DIMS)) @ (np.diag([0.5, 2, 2, 1.5]) + 0.3 * r.standard_normal((4, 4))) + 3
        x[: n // 6] += [9, 14, -12, 10]
        if source == "t":
            x[:] = 1.5
        out.append((lang, source, x))
    return out


def test_smallest_determinant_of_many_starts(spark):
    groups = grouped_vectors()
    rows = [(g * 10_000 + i, lang, source, *map(float, v)) for g, (lang, source, x) in enumerate(groups) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, lang string, source string, x0 double, x1 double, x2 double, x3 double")
    marked = df.withColumn("g", F.floor(F.col("id") / 10_000)).repartition(5)
    found = {e.g: e for e in qr.estimates(marked, ["g"]).collect()}
    r = np.random.default_rng(1)
    for g, (_, _, x) in enumerate(groups):
        tries = [x[r.choice(len(x), qr.DIMS + 1, replace=False)] for _ in range(300)]
        det, mean, _ = min((steps(x, t.mean(axis=0), np.cov(t.T, bias=True)) for t in tries), key=lambda e: e[0])
        assert found[g].det <= det * 1.03 and found[g].det >= det * 0.97, g
        if len(x) > 100:
            assert np.allclose([found[g][f"m{i}"] for i in range(4)], mean, atol=0.15)
            low = np.array([[found[g][f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
            assert math.isclose(np.linalg.det(low @ low.T), found[g].det, rel_tol=1e-9)

    verdicts = []
    for parts in (3, 61):
        verdicts.append({q.id: (round(q.d2, 6), q.outlier) for q in qr.outliers(df.repartition(parts), ["lang", "source"]).collect()})
    assert verdicts[0] == verdicts[1] and len(verdicts[0]) == len(rows)
    # estimates of the groups, drawn to their mean
    w = np.array([found[g].n for g in range(len(groups))])
    means = np.array([[found[g][f"m{i}"] for i in range(4)] for g in range(len(groups))])
    covs = np.array([[[found[g][f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)] for g in range(len(groups))])
    limit = qr.chi_square_quantile(qr.CUTOFF, 4)
    for g, (_, _, x) in enumerate(groups):
        k = qr.POOLED_WEIGHT
        mean = (means[g] * w[g] + np.average(means, axis=0, weights=w) * k) / (w[g] + k)
        cov = (covs[g] * w[g] + np.average(covs, axis=0, weights=w) * k) / (w[g] + k) + FLOOR
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        assert np.allclose([verdicts[0][g * 10_000 + i][0] for i in range(len(x))], d2, rtol=1e-4)
        assert all(verdicts[0][g * 10_000 + i][1] == (d > limit) for i, d in enumerate(d2))
        if len(x) >= 300:
            assert (d2[: len(x) // 6] > limit).all() and (d2[len(x) // 6 :] > limit).mean() < 0.02


def test_quality_rules_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert qr.judge(df, "doc_id", "text", "lang", "source").count() == 0


def sql(query, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return con.sql(query).fetchall()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    got = sorted(map(tuple, mx.op5_source_mixing(spark, path).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet'")
    assert got == sorted(con.sql(mx.oracle()).fetchall())


def test_mixing_meets_its_targets(spark):
    r = random.Random(2)
    rows = [(i, None if i % 50 == 0 else "big" if i % 3 else f"s{i % 7}", r.randrange(0, 90)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, source string, n_tokens int").repartition(5)
    got = mx.schedule(df, 0.9, 4.0).collect()
    assert sorted((g.id, g.source, g.n_tokens) for g in got) == sorted(rows)
    size, taken = Counter(), Counter()
    for g in got:
        size[g.source] += g.n_tokens
        taken[g.source] += g.n_tokens * g.copies
    total = sum(size.values())
    w = {s: taken[s] / sum(taken.values()) for s in taken}
    entropy = -sum(x * math.log(x) for x in w.values())
    assert abs(entropy / math.log(len(w)) - 0.9) < 0.01 or max(taken[s] / size[s] for s in size) > 3.9
    assert total - 90 * len(w) <= sum(taken.values()) <= total
    assert max(taken[s] / size[s] for s in size) <= 4
    for s in size:  # full passes and one cut
        assert len({g.copies for g in got if g.source == s}) <= 2
    assert mx.schedule(df.limit(0)).count() == 0
    one = mx.schedule(df.where("source = 'big'"))
    assert {g.copies for g in one.collect()} == {1}


def test_mixed_rows(spark):
    r = random.Random(6)
    rows = [(r.choice([1, 2, 3, i, None]), " ".join("abc" for _ in range(r.randrange(9))) if i % 9 else None, "big" if i % 4 else "small" if i % 8 else None, f"k{i}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string, _row int").repartition(3)
    out = mx.mixed_rows(df, "doc_id", "source", "text")
    assert out.columns == df.columns
    got = Counter(map(tuple, out.collect()))
    assert set(got) <= set(rows)
    # the same schedule by the definition: passes in full, and a prefix of each source's permutation
    con = duckdb.connect()
    con.register("documents", __import__("pandas").DataFrame([x[:3] for x in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = Counter()
    for i, source, n, _, copies in con.sql(mx.oracle()).fetchall():
        want[i, source, n] += copies
    assert sum(got.values()) == sum(want.values())
    size = Counter()
    for (i, text, source, *_), n in got.items():
        size[i, source, len((text or "").split())] += n
    assert size == Counter({k: v for k, v in want.items() if v})


ODD_CHAT = [(1, 0, "user", "hi <|end|> there"), (1, 1, "ann b!", None), (1, 2, "system", "rules"), (1, 2, "system", "rules"), (None, 0, None, "x"), (None, 1, " ", "y"), (2, 0, "system", "only"), (3, 5, "assistant", ""), (4, 0, "a b", "one"), (4, 1, "a_b", "two"), (4, 1, "a_b", "three"), (4, None, "a-b", "zero")]


def test_chat_equals_sql(spark):
    import pandas as pd

    df = spark.createDataFrame([(*x, "n") for x in ODD_CHAT], "conv_id long, turn long, role string, text string, name string")
    got = [tuple(r) for r in cf.rotate(df, "conv_id", "turn", "role", "text").collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    pdf = pd.DataFrame(ODD_CHAT, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64"})
    assert sorted(got, key=key) == sorted(sql(cf.ORACLE, conversations=pdf), key=key)
    for r in got:
        masked = r[5][r[6] : r[6] + r[7]]
        assert (r[3] == "assistant") == masked.endswith(cf.END) and r[5].count("<|") == 2
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    assert sorted(map(tuple, cf.op6_chat_rotation(spark, SF).collect()), key=key) == sorted(con.sql(cf.ORACLE).fetchall(), key=key)
    assert cf.rotate(df.limit(0), "conv_id", "turn", "role", "text").count() == 0
    # speakers keep different names
    assert {r[4] for r in got if r[0] == 4 and r[1] == "a-b" and r[4]} == {"a_b", "a_b-" + __import__("hashlib").md5(b"a b").hexdigest()[:8]}


def test_dialogues_and_their_masks(spark):
    df = spark.createDataFrame(ODD_CHAT, "conv_id long, turn long, role string, text string")
    rows = cf.rotate(df, "conv_id", "turn", "role", "text")
    turns = {}
    for r in rows.collect():
        turns.setdefault((r.conv_id, r.perspective), []).append(r)
    found = cf.dialogues(rows).collect()
    assert {(d.conv_id, d.perspective) for d in found} == set(turns) and len(found) == len(turns)
    for d in found:
        own = sorted(turns[d.conv_id, d.perspective], key=lambda r: (r.turn is not None, r.turn or 0, r.chat_role, r.name is not None, r.name or "", r.rendered))
        assert d.text == "".join(r.rendered for r in own)
        learned = [r.rendered[r.mask_start : r.mask_start + r.mask_length] for r in own if r.mask_length]
        assert [d.text[m.start : m.start + m.length] for m in d.mask] == learned and all(x.endswith(cf.END) for x in learned)
    assert cf.dialogues(rows.limit(0)).count() == 0
