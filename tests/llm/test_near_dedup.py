import random
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np

from scriptorium.llm import links
from scriptorium.llm import near_dedup as nd
from scriptorium.session import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=150):
    r = random.Random(seed)
    rows, bases = [], [[f"W{r.randrange(400)}" for _ in range(r.choice([5, 40, 120]))] for _ in range(12)]
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 6])):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w.lower() if r.random() < 0.2 else w for w in words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a"), (n + 4, "A"), (n + 5, "a b"), (n + 6, "a b c"), (n + 7, "É b c"), (n + 8, "é b c"), (n + 9, "w " * 30_000)]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, component int").repartition(6)
        got = {r.id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df, "doc_id", "text", nd.Settings(3, 85)).collect()}
        assert got == brute(rows, 3, 85)


def test_small_blocks_salts_and_hot_keys(spark, monkeypatch):
    """Every comparison is dealt to several tasks, and most buckets and classes are hot."""
    for block, shingles, salt, hot in ((4, 10**9, 3, 50), (10**6, 300, 2, 1)):
        monkeypatch.setattr(links, "BLOCK", block)
        monkeypatch.setattr(links, "BLOCK_SHINGLES", shingles)
        monkeypatch.setattr(links, "SALT_ROWS", salt)
        monkeypatch.setattr(links, "HOT", hot)
        rows = corpus(3, 120)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r.id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df, "doc_id", "text", nd.Settings(3, 60, 30, 2)).collect()}
        assert got == brute(rows, 3, 60)


def test_repeated_and_missing_ids(spark):
    r = random.Random(9)
    a, b, c, d = (" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(4))
    rows = [(3, a), (7, a), (7, b), (7, b), (9, b), (9, c), (12, c + " end"), (20, d), (20, d), (None, a), (None, ""), (21, None), (21, d)]
    df = spark.createDataFrame([(*x, "k", 0) for x in rows], "doc_id long, text string, set_key string, component int").repartition(3)
    got = sorted(((x.id, x.component_id, x.kept) for x in nd.near_duplicates(df, "doc_id", "text", nd.Settings(3, 85)).collect()), key=str)
    # 3 = 7 by a, 7 = 9 by b, 9 ~ 12 by c; the ids of d are one
    want = [(3, 3, True), *[(7, 3, False)] * 3, *[(9, 3, False)] * 2, (12, 3, False), *[(20, 20, True)] * 2, (21, 20, False), (21, 21, True), *[(None, None, True)] * 2]
    assert got == sorted(want, key=str)


def test_signature_is_the_sequential_one():
    r = np.random.default_rng(5)
    m = 16
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 40, 900)]
    got = nd.super_minhash(sets, m)
    for s, sig in zip(sets, got):
        best = [2**64 - 1] * m
        for e in s:
            p = list(range(m))
            for j in range(m):
                x = nd.mix(np.array([e ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))]))
                k = j + (int(x[0]) >> 32) % (m - j)
                p[j], p[k] = p[k], p[j]
                best[p[j]] = min(best[p[j]], (j << 48) | int(nd.mix(x)[0]) >> 16)
        assert best == [int(x) for x in sig]


def test_estimate_and_empty_table(spark):
    r = np.random.default_rng(6)
    pool = r.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[200:])
    sig = nd.super_minhash([a, b], 512)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.07
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_crossing_links():
    r = np.random.default_rng(3)
    pool = r.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(r.choice(pool, 280)) for _ in range(40)] + [np.unique(pool[:200]), np.unique(pool[:199])]
    group = np.array([*range(40), 50, 50])
    want = [(i, j) for i in range(42) for j in range(i + 1, 42) if group[i] != group[j] and links.linked(sets[i], sets[j], 45)]
    found = links._crossing(sets, group, 45)
    assert want and set(found) <= set(want)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, j in found:
        root[find(group[i])] = find(group[j])
    assert all(find(group[i]) == find(group[j]) for i, j in want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 200)]
    got = {r.id: r.component for r in links.components(spark.createDataFrame(chain, "u long, v long").repartition(9), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 0, 100: 100, 101: 100, 103: 100}


def test_two_calls_at_once(spark):
    """Each call deletes its own folders and no others."""
    rows = corpus(5, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ask = lambda _: {r.id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df, "doc_id", "text", nd.Settings(3, 85)).collect()}
    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(ask, range(2))
    assert a == b == brute(rows, 3, 85)


def test_few_links_end_in_one_round(spark, monkeypatch):
    """Links that one task may reduce take no rounds of large-star and small-star; more do, with the same groups."""
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 200)]
    want = {**{i: 0 for i in range(61)}, 200: 0, 100: 100, 101: 100, 103: 100}
    for most, rounds in ((links.FOREST_LINKS, False), (3, True)):
        monkeypatch.setattr(links, "FOREST_LINKS", most)
        scratch = Scratch(spark)
        got = {r.id: r.component for r in links.components(spark.createDataFrame(chain, "u long, v long").repartition(9), scratch).collect()}
        assert got == want and any(name == "small" for name, _ in scratch.paths) == rounds
