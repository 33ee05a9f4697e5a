"""The pipeline, stage by stage, against brute force on a small table."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from scriptorium.llm import bpe, mixing, quality_classifier  # noqa: E402
from scriptorium.session import materialise  # noqa: E402
from tests.llm.test_near_dedup import brute as near_brute  # noqa: E402
from tests.llm.test_substring_dedup import WORD  # noqa: E402
from tests.llm.test_substring_dedup import brute as span_brute  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(12)
    path = str(tmp_path_factory.mktemp("small"))
    vocabulary = [f"{a}{b}{c}" for a in ("the", "an", "ri", "so") for b in ("ea", "on", "il") for c in ("t", "nd", "", "ers")]
    good = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    junk = lambda n: " ".join(f"{r.choice(vocabulary)}{r.choice(['###', '$$$', '%%%'])}" for _ in range(n))
    passage, base = good(60), good(150)
    docs = []
    for i in range(240):
        text = junk(80) if i % 6 == 5 else good(r.randrange(30, 120))
        if i % 17 == 3:
            text = f"{good(20)}\n{passage}\n{good(20)}"
        if i % 19 == 4:
            text = base if i % 2 else base.replace("the", "tha", 1)
        docs.append((i, text, "en", "big" if i % 3 else f"s{i % 4}", len(text)))
    docs += [(240, None, None, None, None), (241, "", "en", "big", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 5), 0) for i in range(0, 240, 2)] + [(i, int(i % 6 != 5), 0) for i in range(1, 240, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    before = rows(docs)

    one = materialise(cp.keep_quality(spark, docs, sf_dir), "t1")
    assert one.schema == docs.schema
    model = quality_classifier.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = rows(one)
    scores = dict(zip(before, model.scores([r.text for r in before.values()])))
    assert set(kept) == {i for i, s in scores.items() if s >= 0.5} and all(kept[i] == before[i] for i in kept)
    assert np.mean([(i in kept) == (i % 6 != 5 or i % 17 == 3 or i % 19 == 4) for i in range(240)]) > 0.97

    two = materialise(cp.drop_near_duplicates(spark, one, sf_dir), "t2")
    groups = near_brute([(i, r.text) for i, r in kept.items()], 5, 80)
    alone = rows(two)
    assert set(alone) == {i for i, (_, g) in groups.items() if i == g} and all(alone[i] == kept[i] for i in alone)

    three = materialise(cp.cut_repeated_passages(spark, two, sf_dir), "t3")
    assert three.columns == docs.columns
    cut = rows(three)
    order = sorted((i, r.text) for i, r in alone.items())
    for (i, text), (n, words) in zip(order, span_brute(order, cp.PASSAGE_WORDS)):
        assert WORD.findall(cut[i].text or "") == words and cut[i].source == alone[i].source
        assert n != len(words) or cut[i].text == text
        assert cut[i].n_chars == (None if cut[i].text is None else len(cut[i].text))

    four = materialise(cp.mix_sources(spark, three, sf_dir), "t4")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in cut.values()]))
    want = {r[0]: r[1] for r in con.sql(f"select doc_id, copies from ({mixing.oracle()})").fetchall()}
    got = four.collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, n in want.items() for _ in range(n)) and all(r == cut[r.doc_id] for r in got)

    real = Tokenizer.from_file(bpe.default_path())
    last = cp.encode(spark, four, sf_dir).collect()
    assert len(last) == len(got)
    for r in last:
        ids = real.encode(cut[r.doc_id].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()

    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == sorted(map(tuple, last))


def test_repeated_and_missing_ids(spark):
    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    a, b, c, d = text(), text(), text(), text()
    rows = [(7, a), (7, a), (7, b), (8, b), (None, c), (None, d), (None, a), (9, d), (10, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = cp.drop_near_duplicates(spark, df, "")
    assert kept.schema == df.schema
    want = [(7, a), (7, b), (9, d), (10, None), (None, c), (None, "")]
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted(want, key=str)
    # one source, as many tokens as its budget: each row once, or where it weighs nothing at most once
    mixed = [(x.doc_id, x.text) for x in cp.mix_sources(spark, df, "").collect()]
    assert sorted((x for x in mixed if x[1]), key=str) == sorted((x for x in rows if x[1]), key=str)


def test_clashing_columns_pass_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    extra = ["_id", "_row", "_copy", "_of", "_i", "_n", "_text", "score", "score_", "quality_score", "copies", "c0", "place", "kind", "spans", "id", "a.b"]
    wide = materialise(docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in extra}), "wide")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns
        thin = stage(spark, wide.select(*docs.columns), sf_dir)
        rows = out.collect()
        assert sorted(map(str, (tuple(r)[: len(docs.columns)] for r in rows))) == sorted(map(str, map(tuple, thin.collect())))
        assert all(r[c] == (None if r.doc_id is None else f"{c}-{r.doc_id}") for r in rows for c in extra)
    assert cp.encode(spark, wide, sf_dir).count() == 60


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
