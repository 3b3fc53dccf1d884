import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stallwise.llm import queries, resampling

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = {i: i + 32 for i in range(65, 91)}


def brute(docs, target, percent=5, buckets=10_000, least=20):
    """``(id, n_words, n_features, weight, score, rank)`` by the definition, one gram at a time."""

    def read(text):
        w = TERM.findall((text or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    found = [(i, *read(t)) for i, t in docs]
    s, t = collections.Counter(b for x in found for b in x[2]), collections.Counter(b for x in target for b in read(x)[1])
    big, goal = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (goal + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, grams in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in grams)
        rows.append([i, n, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in rows if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[5] = k + 1
    return [tuple(x) for x in rows]


def order(x):
    return [(v is None, v or 0) for v in x]


def drawn(docs, target, **how):
    columns = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    return sorted((tuple(x) for x in resampling.resample(docs, target, **how).select(*columns).collect()), key=order)


@pytest.mark.parametrize("block, shard", [(2_000, 3_000), (1 << 25, 1 << 24)])
def test_scores_and_ranks(spark, block, shard):
    d = "/root/testdata/sf0.001"
    docs, target = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = brute([(x["doc_id"], x["text"]) for x in docs.collect()], [x["text"] for x in target.collect()])
    assert drawn(docs, target, block_bytes=block, shard_bytes=shard) == sorted(want, key=order)
    assert sum(x[5] is not None for x in want) == 5 * sum(x[1] >= 20 for x in want) // 100 > 0


def test_odd_rows(spark):
    long = "Ä b, c　d-e F9 " * 30_000
    rows = [(1, None), (2, ""), (3, "..."), (4, "one"), (None, "one two"), (None, "a b c " * 9), (5, "a b c " * 9), (5, "a b c " * 9), (5, "b c d " * 9), (6, long), (7, "z" * 70_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, weight int, rank string").repartition(3, "text")
    target = ["b c d e", None, "", "B  C"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 60, 100):
        got = drawn(docs, goal, percent=percent, block_bytes=300)
        want = sorted(brute(rows, target, percent), key=order)
        assert got == want
    assert drawn(docs, goal.limit(0)) == sorted(brute(rows, []), key=order)
    assert drawn(docs.limit(0), goal) == [] and drawn(docs.limit(0), goal.limit(0)) == []


def test_other_names_and_ids(spark):
    docs = spark.createDataFrame([("a", "x y z"), ("b", "y z x")], "name string, body string")
    got = resampling.resample(docs, spark.createDataFrame([("x y",)], "item string"), percent=50, least_words=3, id_col="name", text_col="body", target_col="item")
    assert sorted(x["rank"] or 0 for x in got.collect()) == [0, 1]


def test_rows_that_change_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} x y") for i in range(20)], "doc_id long, text string").coalesce(1)
    seen = []
    real = resampling._encoded
    monkeypatch.setattr(resampling, "_encoded", lambda size: seen.append(size) or real(40))
    with pytest.raises(Exception, match="same blocks twice"):
        resampling.resample(docs, docs.select("text"), block_bytes=1 << 20).collect()


def test_query(spark):
    got = queries.queries()["op11_importance_resampling"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and dict(got.dtypes) == dict.fromkeys(got.columns, "bigint")
    assert got.filter(F.col("rank").isNotNull()).agg(F.max("rank") - F.count("*")).first()[0] == 0
