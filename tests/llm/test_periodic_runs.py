import hashlib
import random
import re
import zlib

from scriptorium.llm import periodic_runs as pr

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(words, settings=pr.Settings()):
    """By definition: each maximal stretch of each period that has no smaller one."""
    out, n = [], len(words)
    for q in range(1, n // settings.times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(settings.words, settings.times * q) and not any(all(x == y for x, y in zip(stretch, stretch[r:])) for r in range(1, q)):
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_text(r):
    words = []
    while len(words) < r.choice([0, 3, 30, 80]):
        block = [r.choice("abc") for _ in range(r.choice([1, 1, 2, 3, 5, 9]))]
        times = r.choice([1, 1, 2, 4, 5, 7])
        words += (block * times)[: len(block) * times - r.choice([0, 0, 1])]
        words += [r.choice("abcxyz") for _ in range(r.choice([0, 0, 1, 4]))]
    return [w.encode() for w in words]


def test_equals_brute_force():
    for seed in range(60):
        r = random.Random(seed)
        texts = [random_text(r) for _ in range(r.choice([1, 3, 20]))]
        texts += texts[:2]  # equal texts in one part don't mix
        for settings in (pr.Settings(), pr.Settings(2, 2), pr.Settings(12, 3)):
            if settings.least_lcp >= pr.BLOCK and settings.words >= 6:
                assert pr.runs_of(texts, settings) == [brute(t, settings) for t in texts]


def test_two_letter_strings_whole():
    """All short strings over two letters: the densest runs there are."""
    for n in (6, 9, 12):
        texts = [[b"ab"[(x >> k) & 1 : ((x >> k) & 1) + 1] for k in range(n)] for x in range(2**n)]
        assert pr.runs_of(texts) == [brute(t) for t in texts]


def test_very_long_runs():
    one, many = [b"w"] * 60_000, [b"%d" % (i % 700) for i in range(50_000)]
    assert pr.runs_of([one, many, one[:5], []]) == [[(0, 60_000, 1)], [(0, 50_000, 700)], [], []]
    words = [b"%d" % i for i in range(3000)]
    assert pr.runs_of([words * 3]) == [[]]
    assert pr.runs_of([words * 4 + words[:1]]) == [[(0, 12_001, 3000)]]


def test_positions_in_order():
    r = random.Random(1)
    values = r.sample(range(100_000), 4000)
    own = pr.Positions(values[0])
    for n, v in enumerate(values[1:], 1):
        so_far = values[:n]
        if n % 97 == 0:
            assert own.add(v) == (max((x for x in so_far if x < v), default=-1), min((x for x in so_far if x > v), default=-1))
        else:
            own.add(v)
    assert list(own) == sorted(values) and own.size == len(values)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pr.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words) if n < 1500 else pr.runs_of([[w.encode() for w in words]])[0]
        r = got[doc_id]
        assert r.n_runs == len(runs)
        planted += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert planted > 5


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b a b a b a b c"), (4, "a b a b a b a b c"), (None, "x x x\nx x x"), (5, "x x x x x"), (6, "é é " * 6)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int").repartition(3)
    assert sorted(map(tuple, pr.periodic_runs(df, "doc_id", "text").collect()), key=str) == sorted([(4, 0, 8, 2)] * 2 + [(None, 0, 6, 1), (6, 0, 6, 1)], key=str)
    got = sorted(map(tuple, pr.collapsed_texts(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "", 0), (3, "", 0), (4, "a b c", 6), (4, "a b c", 6), (None, "x", 5), (5, "x x x x x", 0), (6, "é é", 5)], key=str)
    assert pr.periodic_runs(df.limit(0), "doc_id", "text").count() == 0
