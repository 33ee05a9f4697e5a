import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

from scriptorium.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """[(n_words, kept words)] in the order of rows, which are in order."""
    seen, out = set(), []
    for _, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        out.append((len(words), [w for w, g in zip(words, gone) if not g]))
    return out


def random_rows(seed, n=60):
    r = random.Random(seed)
    passages = [[f"p{i}w{r.randrange(50)}" for _ in range(r.randrange(15, 90))] for i in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(6)):
            if r.random() < 0.6:
                p = r.choice(passages)
                a = r.randrange(len(p) // 2)
                words += p[a : a + r.randrange(10, 80)]
            else:
                words += [r.choice("abcdefgh") for _ in range(r.randrange(30))]
        rows.append((i, r.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [(n, "z " * 300), (n + 1, "z " * 400), (n + 2, None), (n + 3, ""), (n + 4, " \n"), (n + 5, "é è " * 50), (n + 6, rows[3][1]), (n + 7, rows[3][1])]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    for seed, part in ((1, 200), (2, 3000), (3, 10**7)):
        monkeypatch.setattr(sd, "PART_BYTES", part)
        rows = random_rows(seed)
        df = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, text string, id string, spans int").repartition(5)
        got = {r.id: r for r in sd.dedup_texts(df, "doc_id", "text", 20).collect()}
        assert len(got) == len(rows)
        for (i, text), (n, kept) in zip(rows, brute(rows, 20)):
            assert got[i].n_words == n and got[i].n_removed == n - len(kept), (seed, i)
            assert WORD.findall(got[i].kept_text or "") == kept
            if n == len(kept):
                assert got[i].kept_text == text


def test_query_and_long_text(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, base), (7, base), (9, "x y " + base[: len(base) // 2])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sd.op8_substring_dedup(spark, str(tmp_path)).collect()}
    for (i, _), (n, kept) in zip(rows, brute(rows, 20)):
        assert (got[i].n_words, got[i].n_removed) == (n, n - len(kept))
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def in_order(rows):
    """By id, rows without one last, then by the digest of the text."""
    digest = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + 2**63) % 2**64
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, digest(r[1]) if r[1] else 0))


def test_repeated_and_missing_ids(spark, monkeypatch):
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    t, fresh, short = text(40), text(50), text(9)
    rows = [(1, t), (1, t), (0, t), (1, fresh), (1, fresh), (2, f"{short} {t}"), (None, f"{fresh} {text(30)}"), (None, text(30)), (3, short), (3, short), (3, None), (3, None), (4, "")]
    rows += [(5, f"{text(25)} {fresh[:200]}"), (5, f"{text(25)} {fresh[:200]}"), (None, rows[7][1])]
    rows += [(i % 7 or None, x) for i, x in random_rows(11) if x]
    for part, spread in ((10**7, 1), (100, 1), (300, 9), (1, 4)):
        monkeypatch.setattr(sd, "PART_BYTES", part)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(spread)
        got = sorted(((x.id, WORD.findall(x.kept_text or ""), x.n_words) for x in sd.dedup_texts(df, "doc_id", "text", 20).collect()), key=str)
        order = in_order(rows)
        assert got == sorted(((i, kept, n) for (i, _), (n, kept) in zip(order, brute(order, 20))), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.dedup_texts(df, "doc_id", "text").count() == 0 == sd.duplicate_factors(df, "doc_id", "text").count()


def test_factors_have_true_sources(spark, monkeypatch):
    for part in (10**7, 400):
        monkeypatch.setattr(sd, "PART_BYTES", part)
        rows = random_rows(21)
        words = {i: WORD.findall(t or "") for i, t in rows}
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        found = sd.duplicate_factors(df, "doc_id", "text", 20).collect()
        covered = {i: [False] * len(w) for i, w in words.items()}
        for f in found:
            assert f.words >= 20 and (f.source_id, f.source_start) < (f.id, f.start)
            assert words[f.id][f.start : f.start + f.words] == words[f.source_id][f.source_start : f.source_start + f.words]
            covered[f.id][f.start : f.start + f.words] = [True] * f.words
        for (i, _), (_, kept) in zip(rows, brute(rows, 20)):
            assert [w for w, c in zip(words[i], covered[i]) if not c] == kept


def test_factors_are_as_long_as_text_and_source_agree():
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    texts = [a, f"{c} {a} {b}", f"{a} tail", f"{a}x y"]
    pieces = [t.encode() for t in texts]
    ref = sd.Reference.of(pieces, np.array([len(t.split()) for t in texts]))
    pos = ref.windows(20)
    begin, source, n = sd.factors(ref, 20, pos, sd.gram_hashes(sd.word_hashes(ref.raw, ref.at), 20)[pos])
    assert list(zip(begin.tolist(), source.tolist(), n.tolist())) == [(100, 0, 50), (200, 0, 50), (251, 0, 49)]
    # words are compared, not only their fingerprints: with one fingerprint for all, nothing changes
    assert [x.tolist() for x in sd.factors(ref, 20, pos, np.zeros(len(pos), np.uint64))] == [x.tolist() for x in (begin, source, n)]


def test_word_hashes():
    words = [b"a" * n for n in range(1, 200)] + [bytes([n]) * 8 for n in range(200) if not 9 <= n <= 13 and n != 32] + [b"abcdefghi", b"abcdefghj", b"abcdefgh"]
    raw = b" ".join(words)
    ref = sd.Reference.of([raw], np.array([len(words)]))
    assert len(ref.at) == len(words) + 1 and len(set(sd.word_hashes(ref.raw, ref.at).tolist())) == len(set(words))


def test_other_columns_stay(spark):
    rows = [(i, t, None if i % 7 == 0 else f"s{i}", i * 2) for i, t in random_rows(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, rest int").repartition(3)
    out = sd.dedup_columns(df, "doc_id", "text", 20)
    assert out.schema == df.schema
    kept = {r.id: r.kept_text for r in sd.dedup_texts(df, "doc_id", "text", 20).collect()}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, kept[i], s, n) for i, _, s, n in rows), key=str)


def around_one_run(n):
    """Texts of different words around the same few, whose hash is the smallest of many."""
    runs = [[f"k{i}x{j}".encode() for j in range(sd.ANCHOR)] for i in range(2000)]

    def hash_of(run):
        ref = sd.Reference.of([b" ".join(run)], np.array([sd.ANCHOR]))
        return int(sd.gram_hashes(sd.word_hashes(ref.raw, ref.at), sd.ANCHOR)[0])

    run = [w.decode() for w in min(runs, key=hash_of)]
    return [" ".join([f"a{i}b{j}" for j in range(14)] + run + [f"c{i}d{j}" for j in range(14)]) for i in range(n)]


def test_a_frequent_anchor_is_dealt_to_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(sd, "SUB_WINDOWS", 100)
    texts = around_one_run(200)
    rows = list(enumerate(texts + texts[:50]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = df.select(*sd._documents("doc_id", "text"))
    frequent = sd.frequent_anchors(docs, 20)
    assert len(frequent[0]) == 1 and frequent[1][0] >= 10
    # no block holds more than a part of the one anchor's windows
    sent = sd._phrases([tuple(r) for r in docs.collect()], 20, 1000, frequent).to_pylist()
    held = {}
    for r in (r for r in sent if r["spans"] is None):
        heads = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["heads"]), sd.PHRASE)
        held[r["block"]] = held.get(r["block"], 0) + int(heads["windows"].sum())
    assert sum(held.values()) > 1000 and max(held.values()) < 300
    got = {r.id: r for r in sd.dedup_texts(df, "doc_id", "text", 20).collect()}
    for (i, _), (n, kept) in zip(rows, brute(rows, 20)):
        assert got[i].n_removed == n - len(kept) and WORD.findall(got[i].kept_text) == kept


def test_a_block_is_parsed_in_slices(monkeypatch):
    """No reference holds a large share of a block, and together they find what brute force finds."""
    rows = [(i, i, t) for i, t in random_rows(7, 200)]
    sent = sd._phrases([r for r in rows if r[2]], 8, 1)
    sizes, of = [], sd.Reference.of
    monkeypatch.setattr(sd.Reference, "of", lambda pieces, n: sizes.append(int(n.sum())) or of(pieces, n))
    sd._parsed(pa.Table.from_batches([sent]), 8, 1)
    assert len(sizes) == 1 << sd.SLICE_BITS and max(sizes) < 0.5 * sum(sizes)
