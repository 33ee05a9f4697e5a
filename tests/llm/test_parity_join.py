import random

import numpy as np

from scriptorium.llm import links
from scriptorium.llm import parity_join as pj
from tests.llm.test_near_dedup import brute, corpus


def near_sets(r, size, percent):
    """Two sets of tokens that are just linked."""
    s = pj.Settings(percent=percent)
    for _ in range(1000):
        other = r.randint(-(-size * percent // 100), size * 100 // percent)
        differ = s.differ(size + other)
        differ -= (differ - abs(size - other)) % 2
        if differ >= abs(size - other):
            break
    both = (size + other - differ) // 2
    random_ = np.random.default_rng(r.randrange(2**31))
    pool = random_.permutation(np.unique(random_.integers(0, 2**64, size + other + 10, dtype=np.uint64)))[: size + other - both]
    a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[:both], pool[size:]]))
    union, inter = len(np.union1d(a, b)), len(np.intersect1d(a, b))
    assert 100 * inter >= percent * union
    return a, b


def test_linked_sets_share_a_key_and_pass_the_sketch():
    for percent in (80, 85, 60):
        s = pj.Settings(percent=percent)
        r = random.Random(percent)
        for size in [4, 5, 6, 7, 8, 9, 13, 15, 16, 17, 31, 33, 60, 64, 100, 127, 128, 300, 1000, 2047] * 5:
            a, b = near_sets(r, size, percent)
            assert len(a) == len(b) == len(np.union1d(a, b)) or set(pj.first_keys(a, s)) & set(pj.first_keys(b, s))
            assert pj.may_link(pj.unpacked(pj.short_sketch(a)), pj.unpacked(pj.short_sketch(b)), s)


def test_keys_and_sketches_tell_others_apart():
    r = np.random.default_rng(1)
    s = pj.Settings()
    sets = [np.unique(r.integers(0, 2**64, 400, dtype=np.uint64)) for _ in range(60)]
    keys = [set(pj.first_keys(x, s)) for x in sets]
    assert all(not keys[i] & keys[j] for i in range(60) for j in range(i))
    assert all(len(k) <= 0.45 * 400 for k in keys)
    assert not any(pj.may_link(pj.unpacked(pj.short_sketch(sets[0])), pj.unpacked(pj.short_sketch(x)), s) for x in sets[1:])


def test_all_pairs_of_sketches():
    s = pj.Settings()
    r = random.Random(4)
    sets = [x for size in (5, 30, 31, 33, 63, 65, 120) for _ in range(4) for x in near_sets(r, size, 80)]
    sketches = [pj.unpacked(pj.short_sketch(x)) for x in sets]
    want = np.array([[pj.may_link(a, b, s) for b in sketches] for a in sketches])
    assert (pj.may_link_all(sketches, s) == want).all() and not want.all()


def got_of(df):
    return {r.id: (r.n_shingles, r.component_id) for r in pj.similar(df, "doc_id", "text").collect()}


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, component int").repartition(6)
        assert got_of(df) == brute(rows, 5, 80)


def test_common_passages_make_no_links_and_lose_none(spark, monkeypatch):
    """Documents that mostly consist of one passage share most parts: they are joined again by frequency."""
    monkeypatch.setattr(links, "BLOCK", 4)
    monkeypatch.setattr(links, "SALT_ROWS", 3)
    monkeypatch.setattr(links, "HOT", 2)
    monkeypatch.setattr(links, "SENT_IDS", 3)
    r = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = [f"o{r.randrange(10**6)}" for _ in range(30)]
        rows.append((i, " ".join(own + passage)))
    for i in range(60, 80):  # near copies of some of them
        words = rows[i - 60][1].split()
        words[3] = "changed"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = got_of(df)
    assert got == brute(rows, 5, 80)
    assert sum(c != i for i, (_, c) in got.items()) == 20


def test_odd_rows(spark):
    rows = [(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "x y"), (7, "x y"), (8, "A B C d e f g"), (9, None), (9, ""), (10, "q")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, bucket int").repartition(3)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in pj.similar(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(None, 3, None), (5, 3, 5), (5, 1, 5), (7, 1, 5), (8, 3, 5), (9, 0, 9), (9, 0, 9), (10, 1, 10)], key=str)
    assert pj.similar(df.limit(0), "doc_id", "text").count() == 0
