import zlib

from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import language_id as li
from scriptorium.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "12 34 !"), (4, "x"), (4, "x"), (5, "the and " * 60_000), (6, "²³")]


def out_of(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")}


def test_language_held_out(spark, tables):
    rows = li.op1_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in tables["documents"].collect()}
    assert len(rows) == len(truth) and all(r.held_out == out_of(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_odd_rows(spark, tables):
    docs = tables["documents"]
    model = li.learn(docs, "doc_id", "text", "lang", sample_rows=300)
    assert model.languages == ["de", "en", "es", "fr"]
    df = spark.createDataFrame([(*x, 0.5, "q") for x in ODD], "id long, text string, score double, lang_pred string")
    got = sorted((r.id, r.lang_pred, r.score) for r in li.predict(df, model, "text", "id").collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 4, 5, 6]
    assert [g[1] for g in got if g[0] in (1, 2, 3, 6)] == ["und"] * 4 and dict((g[0], g[1]) for g in got)[5] == "en"
    empty = li.learn(docs.limit(0), "doc_id", "text", "lang")
    assert {r.lang_pred for r in li.predict(df, empty, "text", "id").collect()} == {"und"}
    assert li.predict(df.limit(0), model, "text", "id").count() == 0
    # unseen words fall back to shorter and shorter grams
    assert int(np.argmax(model.score("zzthationzz"))) == 1 and not any(model.score("漢"))


def brute_languages(learned, texts):
    """What the definition says, without sharing code: shares of words, then of shorter and shorter grams."""
    langs = sorted({lang for lang, _ in learned})
    seen = {}
    for lang, text in set(learned):
        for w in li.WORD.findall(text.lower()):
            for k in range(min(4, len(w) + 2) + 1):
                m = w if k < 2 else f"<{w}>"
                for g in [w] if k == 0 else [m[i : i + k] for i in range(len(m) - k + 1)]:
                    seen.setdefault((k, g), Counter())[lang] += 1
    total = {(k, lang): sum(c[lang] + 0.5 for (j, _), c in seen.items() if j == k) for k in range(5) for lang in langs}

    def row(k, g):
        logs = np.array([np.log((seen[k, g][lang] + 0.5) / total[k, lang]) for lang in langs])
        return logs - logs.mean()

    out = []
    for text in texts:
        if not text or not any(map(str.isalpha, text)):
            out.append(("und", 0.0))
            continue
        score = np.zeros(len(langs))
        for w in li.WORD.findall(text.lower()):
            if (0, w) in seen:
                score += row(0, w)
                continue
            for k in range(min(4, len(w) + 2), 0, -1):
                m = w if k < 2 else f"<{w}>"
                known = [row(k, m[i : i + k]) for i in range(len(m) - k + 1) if (k, m[i : i + k]) in seen]
                if known:
                    score += np.mean(known, axis=0)
                    break
        out.append((langs[int(score.argmax())], float(1 / np.exp(score - score.max()).sum())))
    return out


def test_language_equals_brute_force(spark, tables, tmp_path):
    r = np.random.default_rng(5)
    rows = [(x.doc_id, x.text[:1500], x.lang) for x in tables["documents"].orderBy("doc_id").limit(60).collect()]
    long = "".join(r.choice(list("abcdeéz"), 500))
    rows += [(100 + i, t, None) for i, t in enumerate([long, long + " the " + long, "qxz " * 9, None, "", "漢字", "Zzthé <x>"])]
    rows += [(7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (None, "kkkk kkkk", "en"), (200, "jjjj", None), (201, f"{long} word", "de")]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, lang string, kind int, item string").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.lang_pred, x.score) for x in li.op1_language_id(spark, str(tmp_path)).collect())
    learned = [(lang, t) for i, t, lang in {x for x in rows} if i is not None and lang and t is not None and not out_of(i)]
    want = sorted((i is not None, i or 0, *x) for (i, *_), x in zip(rows, brute_languages(learned, [t for _, t, _ in rows])))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-3)


def test_sample_of_a_very_large_table_is_not_empty(spark):
    ids = spark.range(200_000)
    assert ids.where(li.sampled(10, 10, "id")).count() == 200_000
    for n in (2 * 10**6, 10**7):  # as if the table had n rows
        assert abs(ids.where(li.sampled(n, 12_000, "id")).count() - 12_000 * 200_000 / n) < 5 * (12_000 * 200_000 / n) ** 0.5
    least = -(2**63) + 2**64 * 12_000 // 10**11
    assert least - -(2**63) > 10**12  # room for hashes in a table of 10^11 rows


def test_language_of_a_long_run_of_letters(spark):
    r = np.random.default_rng(8)
    glued = lambda letters, n: "".join(r.choice(list(letters), n))
    rows = [(i, " ".join(glued(letters, 6) for _ in range(60)), lang) for i, (letters, lang) in enumerate([("abcd", "aa"), ("wxyz", "zz")] * 20)]
    model = li.learn(spark.createDataFrame(rows, "id long, text string, lang string"), "id", "text", "lang")
    texts = [(1, glued("abcd", 64) + glued("wxyz", 5000)), (2, glued("wxyz", 64) + glued("abcd", 5000)), (3, glued("abcd", 64)), (4, glued("wxyz", 64))]
    got = li.predict(spark.createDataFrame(texts, "id long, text string"), model, "text", "id").collect()
    assert {x.id: x.lang_pred for x in got} == {1: "zz", 2: "aa", 3: "aa", 4: "zz"}
    # n-grams of the learned texts count beyond the first letters, too
    rows = [(i, glued("abcd", 64) + glued("wxyz", 300), "zz") for i in range(20)]
    assert any("w" in g for g in li.learn(spark.createDataFrame(rows, "id long, text string, lang string"), "id", "text", "lang").grams)


def test_quality_held_out(spark, tables):
    rows = {r.doc_id: r for r in qc.op4_quality_classifier(spark, SF).collect()}
    assert all(r.held_out == out_of(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    held = [r for r in tables["labels"].collect() if out_of(r.doc_id)]
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in held]) > 0.95


def test_quality_odd_rows(spark, tables):
    model = qc.learned(tables["documents"], tables["labels"])
    df = spark.createDataFrame([(*x, 0.1) for x in ODD], "id long, text string, quality_score double")
    got = qc.score(df, model, "text", "vote").collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 4, 5, 6] and {r.quality_score for r in got} == {0.1}
    assert {r.vote for r in got if r.id in (1, 2)} == {model.prior}
    with pytest.raises(ValueError):
        qc.score(df, model, "text", "quality_score")
    none = qc.learned(tables["documents"], tables["labels"].limit(0))
    assert {r.vote for r in qc.score(df, none, "text", "vote").collect()} == {0.5}
    assert qc.score(df.limit(0), model, "text", "vote").count() == 0


def test_quality_learns_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "aa bb cc"), (1, "aa bb cc"), (1, "zz"), (2, "dd ee"), (None, "ff")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    model = qc.learn(docs, "doc_id", "text", labels, "quality")
    assert model.labels.tolist() == [1.0, 0.0]
    two = qc.learn(docs.where("text <> 'zz'").distinct(), "doc_id", "text", labels, "quality")
    assert (model.vectors == two.vectors).all()


def test_quality_query_equals_brute_force(spark, tables, tmp_path):
    docs = tables["documents"].orderBy("doc_id").limit(60).collect()
    label = {r.doc_id: r.quality for r in tables["labels"].collect()}
    rows = [(r.doc_id, r.text) for r in docs] + [(docs[3].doc_id, docs[3].text), (10**6, None), (10**6 + 1, ""), (None, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    tables["labels"].write.parquet(f"{tmp_path}/labels.parquet")
    learned = sorted((i, t) for i, t in {(r.doc_id, r.text) for r in docs} if i in label and not out_of(i))
    c = qc.counts([t for _, t in learned]).astype(float)
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(axis=0))) + 1
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    y = unit(np.sqrt(c) * idf)
    space = np.linalg.svd(y, full_matrices=False)[2][: min(qc.RANK, len(y))].T
    marks = np.array([label[i] for i, _ in learned], float)
    for r in qc.op4_quality_classifier(spark, str(tmp_path)).collect():
        text = dict(rows)[r.doc_id]
        if not text or len(text) < 1:
            assert abs(r.score - marks.mean()) < 1e-9
            continue
        z = unit(unit(np.sqrt(qc.counts([text]).astype(float)) * idf) @ space)[0]
        sims = unit(y @ space) @ z
        near = np.argsort(-sims)[: qc.NEIGHBOURS]
        w = np.maximum(sims[near], 0) ** qc.SHARPNESS
        want = ((w * marks[near]).sum() + qc.PRIOR_WEIGHT * marks.mean()) / (w.sum() + qc.PRIOR_WEIGHT)
        assert abs(r.score - want) < 0.02, r.doc_id


def test_votes_are_exact_cosines():
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("abcdef #$"), 60)) for _ in range(40)]
    c = qc.counts(texts)
    y = qc._unit(np.sqrt(c))
    model = qc.Model(np.ones(qc.TERMS, np.float32), qc._main_directions(y, 20), qc._unit(y @ qc._main_directions(y, 20)), (r.random(40) > 0.5).astype(float), 0.5)
    got = model.scores(["abc abc#", "fed cba $$"])
    for t, g in zip(["abc abc#", "fed cba $$"], got):
        z = model.latent(qc.counts([t]))[0].astype(float)
        sims = sorted(((float(v.astype(float) @ z), lab) for v, lab in zip(model.vectors, model.labels)), reverse=True)[: qc.NEIGHBOURS]
        w = [max(s, 0) ** qc.SHARPNESS for s, _ in sims]
        want = (sum(a * s[1] for a, s in zip(w, sims)) + qc.PRIOR_WEIGHT * 0.5) / (sum(w) + qc.PRIOR_WEIGHT)
        assert abs(g - want) < 1e-4
