"""Stored tables: what a change writes, and what it leaves alone."""

from pathlib import Path

import pytest

from scriptorium.sources.stored import Stored


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def made(spark, rows, kind="id string, n int, label string"):
    return spark.createDataFrame(rows, kind)


def test_upsert_twice_writes_once(spark, tmp_path):
    old = made(spark, [(f"k{i}", i, "old") for i in range(50)] + [(None, 99, "old")])
    kept = Stored(spark, str(tmp_path), old.schema, ["id"], 16)
    assert rows_of(kept.frame()) == [] and kept.upsert(old, ["label"])
    before = files(tmp_path)
    new = made(spark, [("k3", -1, "new"), ("x", 1, "new"), (None, -1, "new"), ("k5", 7, "old")])  # k5 does not differ
    assert kept.upsert(new, ["label"]) and kept.version() == 2
    want = {f"k{i}": (f"k{i}", i, "old") for i in range(50)} | {None: (None, 99, "new"), "x": ("x", 1, "new"), "k3": ("k3", 3, "new")}
    assert rows_of(kept.frame()) == sorted(want.values(), key=str)
    assert rows_of(kept.frame(1)) == rows_of(old)
    first, second = kept.manifest(1)["buckets"], kept.manifest(2)["buckets"]
    changed = {n for n in second if second[n] != first.get(n)}
    assert len(changed) <= 3 and all(files(tmp_path)[f] == at for f, at in before.items())
    now = files(tmp_path)
    assert not kept.upsert(new, ["label"]) and kept.version() == 2 and files(tmp_path) == now
    kept.vacuum()
    assert rows_of(kept.frame()) == sorted(want.values(), key=str) and len(files(tmp_path)) < len(now)


def test_replace_by_origin(spark, tmp_path):
    old = made(spark, [(o, i, "old") for o in "abc" for i in range(4)])
    kept = Stored(spark, str(tmp_path), old.schema, ["id"], 64)
    kept.replace(old)
    folders = kept.manifest()["buckets"]
    assert kept.replace(made(spark, [("b", 9, "new")]))
    assert rows_of(kept.frame()) == sorted([("b", 9, "new")] + [(o, i, "old") for o in "ac" for i in range(4)])
    assert sum(f != folders[n] for n, f in kept.manifest()["buckets"].items()) == 1
    assert not kept.replace(made(spark, [])) and kept.version() == 2


def test_sums_of_a_batch_count_once(spark, tmp_path):
    kind = "g string, n long"
    kept = Stored(spark, str(tmp_path), made(spark, [], kind).schema, ["g"], 8)
    assert kept.add(made(spark, [("a", 1), ("b", 2), (None, 5)], kind), ["n"], "one")
    assert kept.add(made(spark, [("a", 10), ("c", 3), (None, 5)], kind), ["n"], "two")
    assert not kept.add(made(spark, [("a", 10)], kind), ["n"], "two")
    assert rows_of(kept.frame()) == sorted([("a", 11), ("b", 2), ("c", 3), (None, 10)], key=str)
    assert kept.manifest()["batches"] == ["one", "two"]


def test_sums_of_many_rows_a_key_touch_their_bucket_alone(spark, tmp_path):
    kind = "g string, n long"
    kept = Stored(spark, str(tmp_path), made(spark, [], kind).schema, ["g"], 64)
    assert not kept.add(made(spark, [], kind), ["n"], "none") and kept.version() == 0
    assert kept.add(made(spark, [(g, 1) for g in "abca"], kind), ["n"])
    folders = kept.manifest()["buckets"]
    assert kept.add(made(spark, [("b", 1), ("b", 2)], kind), ["n"])
    assert rows_of(kept.frame()) == [("a", 2), ("b", 4), ("c", 1)]
    assert sum(f != folders.get(n) for n, f in kept.manifest()["buckets"].items()) == 1


def test_of_two_changes_at_once_one_fails(spark, tmp_path):
    kept = Stored(spark, str(tmp_path), made(spark, []).schema, ["id"], 4)
    kept.upsert(made(spark, [("a", 1, "x")]), ["label"])
    meanwhile = kept._publish
    kept._publish = lambda before, manifest: (meanwhile(before, manifest), meanwhile(before, manifest))
    with pytest.raises(RuntimeError, match="another change"):
        kept.upsert(made(spark, [("b", 2, "y")]), ["label"])
    assert kept.version() == 2 and rows_of(kept.frame()) == [("a", 1, "x"), ("b", 2, "y")]


def test_sums_are_merged_a_part_of_the_buckets_at_a_time(spark, tmp_path):
    kind = "g string, w string, n long"
    rows = [(f"g{i // 2 % 40}" if i // 2 % 40 else None, f"w{i % 7}", i) for i in range(1200)]
    kept = Stored(spark, str(tmp_path), made(spark, [], kind).schema, ["g", "w"], 16, by=["g"])
    shuffled, put = [], kept._put
    kept._put = lambda df, folder, **o: shuffled.append(put(df, folder, **o)) or shuffled[-1]
    for k in (0, 1, 1):
        kept.add(made(spark, rows[k::2], kind), ["n"], f"half {k}")
    want = {}
    for g, w, n in rows:
        want[g, w] = want.get((g, w), 0) + n
    assert rows_of(kept.frame()) == sorted(((g, w, n) for (g, w), n in want.items()), key=str)
    assert len(shuffled) == 2 + len(kept.steps([int(n) for n in kept.manifest()["buckets"]])) and len(kept.steps()) == 4
    parts = [{r.g for r in kept.frame(only=part).select("g").distinct().collect()} for part in kept.steps()]
    assert sum(map(len, parts)) == len(set().union(*parts)) == 40  # all rows of one g are in one bucket
    kept.vacuum()
    assert rows_of(kept.frame()) == sorted(((g, w, n) for (g, w), n in want.items()), key=str)
