import duckdb
import numpy as np

from scriptorium.llm import nearest as nn

SF = "/root/testdata/sf0.01"


def test_chi_square():
    assert abs(nn.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def test_equals_sql(spark):
    got = [tuple(r) for r in nn.op9_nearest(spark, SF).collect()]
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(got) == sorted(con.sql(nn.ORACLE).fetchall())


def test_recall_over_many_blocks(spark):
    r = np.random.default_rng(1)
    x = (r.standard_normal((60, 24))[r.integers(0, 60, 6000)] + 0.3 * r.standard_normal((6000, 24))).astype(np.float64)
    ids = np.arange(6000)
    hit = total = 0
    for part in np.array_split(np.arange(6000), 3):
        found = nn.search(ids[part], x[part], ids[::100], x[::100], 10)
        by = {}
        for q, i, _ in found:
            by.setdefault(100 * q, set()).add(i)
        for q in ids[::100]:
            d = nn.distances(x[part], x[q])
            true = [i for _, i in sorted(zip(d, part)) if i != q][:10]
            hit += len(by[q] & set(true))
            total += 10
    assert hit / total >= 0.99


def test_odd_vectors_ties_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.0, 2.0]), (100, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (200, [0.0, 1.0])]
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in nn.nearest(df, "vec_id", "embedding", df.where("vec_id % 100 = 0"), 2).drop("query_key").collect())
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2), (200, 1, 8), (200, 2, 0)]
    assert abs(got[3][3] - 2**0.5) < 1e-15
    assert nn.nearest(df.limit(0), "vec_id", "embedding", df, 3).count() == 0


def test_smallest_ids_of_many_equal_vectors():
    r = np.random.default_rng(5)
    x = r.standard_normal((1000, 24))
    x[300:800] = x[300]
    ids = r.permutation(1000)
    same = ids[300:800]
    for q in (int(same.max()), int(same.min())):
        found = nn.search(ids, x, np.array([q]), x[300:301], 10)
        assert found == [(0, i, 0.0) for i in sorted(set(same.tolist()) - {q})[:10]]


def test_cells():
    r = np.random.default_rng(4)
    points = r.standard_normal((4000, nn.DIMS))
    points[:900] = points[0]
    cells = nn.Cells.fit(points, 40)
    home = cells.home(points)
    assert len(cells.low) == 40 and set(home) == set(range(40))
    assert (points >= cells.low[home]).all() and (points <= cells.high[home]).all()
    assert all(cells.bounds(p)[h] == 0 for p, h in zip(points[::50], home[::50]))
    assert nn.Cells.fit(points[:900], 9).home(points).max() == 0  # equal points stay together


def test_cells_leave_the_result_as_it_is(spark, monkeypatch):
    r = np.random.default_rng(6)
    centres = r.standard_normal((30, 16)) * 4
    rows = [(i, (centres[i % 30] + 0.3 * r.standard_normal(16)).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[100][1]) for i in range(300)] + [(6000 + i, r.standard_normal(3).tolist()) for i in range(150)] + [(7000, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    ask = df.where("vec_id % 50 = 0")
    whole = sorted(map(tuple, nn.nearest(df, "vec_id", "embedding", ask, 10).collect()))
    monkeypatch.setattr(nn, "CELL_ROWS", 100)
    monkeypatch.setattr(nn, "SAMPLE_ROWS", 1500)
    monkeypatch.setattr(nn, "BLOCK_ROWS", 60)
    monkeypatch.setattr(nn, "QUERY_ROWS", 4)
    got = sorted(map(tuple, nn.nearest(df, "vec_id", "embedding", ask, 10).collect()))
    assert len(got) == len(whole) and len(set(got) & set(whole)) >= 0.99 * len(whole)


def test_many_blocks_and_portions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK_ROWS", 70)
    monkeypatch.setattr(nn, "QUERY_ROWS", 9)
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 12)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(0, x[0].tolist()), (0, x[0].tolist()), (0, x[5].tolist()), (7, x[7].tolist())]  # repeated queries and candidates
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = nn.nearest(df, "vec_id", "embedding", df.where("vec_id % 20 = 0"), 5).collect()
    got = sorted((f.query_id, f.query_key, f.rank, f.id, f.score) for f in found)
    assert len({(q, k) for q, k, *_ in got}) == 31  # 30 ids, one of them with two vectors
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    want = {}
    for i, v in {(i, tuple(v)) for i, v in rows if i % 20 == 0}:
        other = ids != i
        want.setdefault(i, []).append(sorted(zip(nn.distances(vectors[other], np.array(v)).tolist(), ids[other].tolist()))[:5])
    for q, key in {(q, k) for q, k, *_ in got}:
        own = [(d, i) for a, b, _, i, d in got if (a, b) == (q, key)]
        assert own in want[q] and [n for a, b, n, *_ in got if (a, b) == (q, key)] == [1, 2, 3, 4, 5]
