import math

import numpy as np
import pytest

from stallwise.llm import neighbours, queries


def brute(rows, asked, k=10):
    """``query -> [(distance, id)]`` over sound rows, by the definition."""

    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    rows = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and ok(v)]
    return {q: sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, v in rows if i != q and len(v) == len(w))[:k] for q, w in rows if q in asked}


def found(df):
    out = {}
    for x in df.orderBy("query_id", "rank").collect():
        assert x["rank"] == len(out.setdefault(x["query_id"], [])) + 1
        out[x["query_id"]].append((x["score"], x["vec_id"]))
    return out


@pytest.mark.parametrize("size", [100, 8192])
def test_recall(spark, size):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(x["vec_id"], x["embedding"]) for x in e.collect()]
    got = found(neighbours.nearest(e.repartition(3), e.filter("vec_id % 20 = 0"), size=size))
    want = brute(rows, {i for i, _ in rows if i % 20 == 0})
    assert got.keys() == want.keys() and all(len(x) == 10 and x == sorted(x) for x in got.values())
    exact = {(q, i): d for q in want for d, i in brute(rows, {q}, len(rows))[q]}
    assert all(d == pytest.approx(exact[q, i], abs=1e-12) for q, x in got.items() for d, i in x)
    assert sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want) >= 0.95 * 10 * len(want)


def test_windows_leave_far_vectors_alone():
    """Groups far from the query never reach the threshold, so they are not verified."""
    rng = np.random.default_rng(3)
    near, far = rng.normal(size=(50, 32)), rng.normal(size=(2000, 32)) + 40 * rng.choice([-1, 1], size=(2000, 1)) * rng.normal(size=(2000, 32))
    vectors = np.vstack([near, far])
    values = neighbours.directions(64, 32, 7) @ vectors.T
    order = np.argsort(values, axis=1)
    shard = neighbours.Shard(np.arange(len(vectors)), vectors, np.take_along_axis(values, order, axis=1), order, 1.25)
    at, distance = shard.search(vectors[0], values[:, 0], 0, 10, neighbours.threshold(64))
    best = at[np.argsort(distance)[:10]]
    want = np.argsort(((vectors - vectors[0]) ** 2).sum(axis=1))[1:11]
    assert set(best) == set(want) and len(at) < 300 and 0 not in at


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [math.cos(i), math.sin(i), i / 9]) for i in range(1, 30)] + [(0, [1.0, 0.0, 0.0]), (100, [0.5, 0.5, 0.0])]
    rows += [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 0.0]), (204, [nan, 1.0, 0.0]), (205, [inf, 1.0, 0.0]), (300, [1.0, 2.0]), (301, [2.0, 2.0]), (None, [1.0, 0.0, 0.0])]
    rows += [(50, rows[3][1]), (51, rows[3][1]), (400, [1e150, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(3)
    got = found(neighbours.nearest(df, df.filter("vec_id % 100 = 0")))
    want = brute(rows, {0, 100, 300, 400})
    assert got == want and len(got[300]) == 1 and len(got[0]) == 10
    assert found(neighbours.nearest(df.limit(0), df)) == {} and found(neighbours.nearest(df, df.limit(0))) == {}
    one = df.filter("vec_id = 1")
    assert found(neighbours.nearest(one, one)) == {}


def test_repeated_rows_and_ties(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(7, [1.0, 2.0]), (60, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = found(neighbours.nearest(df, df.filter("vec_id = 20 or vec_id = 7"), k=9, size=16))
    assert got[20] == [(0.0, i) for i in (0, 1, 2, 3, 4, 5, 6, 7, 7)] and [i for _, i in got[7]][0] == 0 and len(got[7]) == 9


def test_query(spark):
    got = queries.queries()["op13_neighbours"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert got.count() > 0
