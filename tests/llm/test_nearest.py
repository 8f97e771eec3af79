import numpy as np
import pytest
from pyspark.sql import functions as F

from msgshield.llm import nearest

SF = "/root/testdata/sf0.01"


def brute(ids, x, queries, k=5):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in queries:
        s = u @ u[ids.index(q)]
        out[q] = [i for _, i in sorted((-round(v, 12), i) for v, i in zip(s, ids) if i != q)][:k]
    return out


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in nearest.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    data = table.collect()
    ids, x = [r.vec_id for r in data], np.array([r.embedding for r in data], np.float64)
    want = brute(ids, x, [i for i in ids if i % 50 == 0])
    assert set(got) == set(want)
    hits = sum(len({r.vec_id for r in got[q]} & set(w)) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, rs in got.items():
        assert [r.rank for r in rs] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        for r in rs:
            a, b = x[ids.index(q)], x[ids.index(r.vec_id)]
            assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-14)


def test_walk_is_by_summed_distance():
    rng = np.random.default_rng(0)
    one, two, counts = rng.random(7), rng.random(5), rng.integers(0, 4, (7, 5))
    cells = nearest.walk(one, two, counts, 10 ** 9)
    want = sorted((one[i] + two[j], i, j) for i in range(7) for j in range(5) if counts[i, j])
    assert cells == [(i, j) for _, i, j in want]
    some = nearest.walk(one, two, counts, 6)
    assert some == cells[:len(some)] and sum(counts[c] for c in some) >= 6 > sum(counts[c] for c in some[:-1])


def test_hot_vectors_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    data += [(i, [1.0] * 8) for i in range(300, 600)]                 # one vector, a third of all rows and more
    data += [(600, None), (601, [0.0] * 8), (602, [1.0] * 7 + [float("nan")]), (603, [1.0] * 7 + [float("inf")]),
             (604, [1.0] * 7 + [None]), (605, []), (606, [1.0] * 3), (None, [2.0] * 8), (650, [2.0] * 8), (7, data[7][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    rows = nearest.search(df, F.col("vec_id") % 50 == 0, visit=1.0, block_rows=64, portion=3).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    ok = {i: v for i, v in data if i is not None and v and len(v) == 8 and None not in v
          and np.isfinite(v).all() and any(v)}
    ids = sorted(ok)
    want = brute(ids, np.array([ok[i] for i in ids]), [i for i in ids if i % 50 == 0])
    assert got == want
    assert got[300] == [301, 302, 303, 304, 305] and got[650] == [300, 301, 302, 303, 304]


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], schema)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest.search(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.0)]


def test_one_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.5, 0.25]), (1, [1.0, 0.01, 0.5, 0.25]), (1, [-5.0, 3.0, 0.5, 0.25]),
            (2, [-5.0, 3.0, 0.5, 0.25]), (3, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, round(r.score, 3)) for r in nearest.search(df, F.col("vec_id") == 0, visit=1.0).collect()}
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 3)
    assert got == {(i, cos(rows[0][1], v)) for i, v in rows[1:]}


def test_scaled_copies_tie_by_id(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=6)
    data = [(1000 - i, (base * 2.0 ** (i % 40)).tolist()) for i in range(400)]
    data += [(2000 + i, rng.normal(size=6).tolist()) for i in range(200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(7)
    rows = nearest.search(df, F.col("vec_id") == 1000, visit=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [601, 602, 603, 604, 605]
