"""Packing, exemplars and caller-supplied functions."""

import numpy as np

from scriptorium.functions import udfs
from scriptorium.operators import pack


def test_request_batches(spark):
    assert pack.pack_sizes([100] * 11) == [0] * 10 + [1]
    assert pack.pack_sizes([9000, 3000, 10]) == [0, 1, 1]
    df = spark.createDataFrame([("s", i, "x" * 2500) for i in range(5)] + [("t", 9, None)], "s string, i long, text string")
    from pyspark.sql import functions as F

    got = {(r.s, r.i): r.batch for r in pack.request_batches(df.repartition(4), "s", "i", F.coalesce(F.length("text"), F.lit(0))).collect()}
    assert [got[("s", i)] for i in range(5)] == [0, 0, 1, 1, 2] and got[("t", 9)] == 0


def test_batches_over_ranges_are_those_of_the_whole(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    sizes = {s: r.choice([5, 300, 700, 1500, 9000], n).tolist() for s, n in (("hot", 400), ("few", 3), (None, 30))}
    for a, b in ((0, 1), (7, 8), (30, 400)):
        state = pack.packed(sizes["hot"][:a])[1]
        assert pack.after(state, *pack.summary(sizes["hot"][a:b])) == pack.packed(sizes["hot"][:b])[1]
    df = spark.createDataFrame([(s, i, x) for s, v in sizes.items() for i, x in enumerate(v)], "s string, i long, n long").repartition(5)
    got = {(x.s, x.i): x.batch for x in pack.request_batches(df, "s", "i", F.col("n")).collect()}
    assert got == {(s, i): b for s, v in sizes.items() for i, b in enumerate(pack.pack_sizes(v))}


def test_places_over_ranges(spark):
    from pyspark.sql import functions as F

    from scriptorium.operators.places import placed

    values = [i // 3 for i in range(900)] + [None] * 5
    rows = placed(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), F.asc_nulls_last("v")).collect()
    assert [x.v for x in sorted(rows, key=lambda x: x._i)] == values and sorted(x._i for x in rows) == list(range(905))
    assert {x._n for x in rows} == {905} and len({x._range for x in rows}) > 1


def test_regrouped_texts_of_a_group_over_many_partitions(spark):
    from scriptorium.operators import chunk

    rows = [("hot", i, f"{i} " + "x" * (i % 50)) for i in range(900)] + [(None, 1, "a"), (None, 2, "b")]
    want = {}
    for s, _, t in rows:
        if s not in want or len(want[s]) < 600:
            want[s] = f"{want[s]}\n{t}" if s in want else t
    df = spark.createDataFrame(rows, "s string, i long, text string").repartition(9)
    out = chunk.regroup(df, ["s"], "i", "text", 600)
    assert {x.s: x.text for x in out.collect()} == want
    assert "_part" in out._jdf.queryExecution().optimizedPlan().toString()


def test_exemplars(spark):
    r = np.random.default_rng(1)
    rows = [(s, i, int(r.integers(0, 9)), int(r.integers(0, 9)), None if i % 11 == 0 else f"{'tT'[i % 2]}{r.integers(0, 12)}", ["spoken", "written"][int(r.random() < p)]) for s, p in (("s", 0.3), ("t", 0.05), (None, 0.5)) for i in range(200)]
    rows += [("one", 1, 5, 9, "a", "spoken"), ("two", 1, 5, 0, "a", "spoken"), ("two", 2, None, 0, "a", "spoken")]
    got = {}
    for q in sorted(pack.pick_exemplars(spark.createDataFrame(rows, "s string, id long, style int, asked int, topic string, mode string").repartition(5), "s", "id").collect(), key=lambda q: q.place):
        got.setdefault(q.s, []).append(q.id)
    assert set(got) == {"s", "t", None, "two"}
    for subject, ids in got.items():
        # by the definition: a row in order is chosen if and only if it fits to those chosen before it
        order = sorted((x for x in rows if x[0] == subject and x[2] is not None and x[3] <= 4), key=lambda x: (-x[2], x[1]))
        taken = []
        for x in order:
            topic = [(y[4] or "misc").lower() for y in taken]
            ahead = sum(y[5] == x[5] for y in taken) - sum(y[5] != x[5] for y in taken)
            if len(taken) < 12 and topic.count((x[4] or "misc").lower()) < 2 and ahead < 4:
                taken.append(x)
        assert ids == [x[1] for x in taken]


def test_caller_supplied_functions(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    assert sorted(r[0] for r in df.select(udfs.token_counter(lambda t: len(t.split()))("t")).collect()) == [0, 0, 3]
    v = [np.array(r[0]) for r in df.select(udfs.test_embedding("t")).collect()]
    assert all(len(x) == 384 and abs(np.linalg.norm(x) - 1) < 1e-5 for x in v) and np.allclose(v[1], v[2])
    assert np.allclose(v[0], udfs.hashed_vector("a b c"), atol=1e-6)
    answers = udfs.completions(df.where("t <> ''"), "t", lambda prompts: [p.upper() for p in prompts]).collect()
    assert [tuple(r) for r in answers] == [("a b c", "A B C")]


def test_intermediate_folders_are_deleted(spark):
    from pathlib import Path

    from scriptorium import session

    session.forget(spark)
    df = session.materialise(spark.range(5), "kept")
    folder = Path(df.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
    assert df.count() == 5 and folder.exists()
    assert session.forget(spark) == 1 and not folder.exists()
