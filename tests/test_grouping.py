import math

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stallwise.operators import grouping, reduction


def matrix(found):
    keys, terms = sorted({x["k"] for x in found}), sorted({x["term"] for x in found})
    out = np.zeros((len(keys), len(terms)))
    for x in found:
        out[keys.index(x["k"]), terms.index(x["term"])] = x["w"]
    return keys, out


@pytest.fixture(scope="module")
def found(spark):
    rng = np.random.default_rng(2)
    topics = [[f"t{i}_{j}" for j in range(25)] for i in range(6)]
    rows = [(i, [str(w) for w in rng.choice(topics[i % 6], 5)] + [f"x{rng.integers(200)}"]) for i in range(400)]
    frame = spark.createDataFrame(rows, "k long, tokens array<string>").repartition(5)
    return reduction.weights(frame, "k", "tokens").cache()


def test_weights(spark):
    rows = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "c"]), (3, ["b", "once"]), (4, ["c"])], "k int, terms array<string>")
    got = {(x["k"], x["term"]): x["w"] for x in reduction.weights(rows, "k", "terms", max_df=0.5).collect()}
    idf = math.log(5 / 3) + 1
    a, b = (1 + math.log(2)) * idf, idf
    assert got[1, "a"] == pytest.approx(a / math.hypot(a, b)) and got[3, "b"] == 1 and (3, "once") not in got and len(got) == 6


def test_singular_values_and_rows(spark, found):
    """Within a thousandth of an exact decomposition, and the projections of the rows span the same space."""
    keys, a = matrix(found.collect())
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    reduced, values = reduction.truncated_svd(found, "k", 20)
    assert np.abs(values / s[:20] - 1).max() < 1e-3
    rows = {x["k"]: x["reduced"] for x in reduced.collect()}
    r = np.array([rows[k] for k in keys])
    exact = u[:, :6] * s[:6]  # the topics stand out; within them the spectrum is flat
    assert np.abs(r[:, :6] @ r[:, :6].T - exact @ exact.T).max() < 0.02


def test_a_matrix_of_low_rank(spark):
    rows = spark.createDataFrame([(i, t, 1.0) for i in range(30) for t in (f"t{i % 3}",)], "k long, term string, w double")
    reduced, values = reduction.truncated_svd(rows, "k", 20)
    assert values == pytest.approx([math.sqrt(10)] * 3) and {len(x["reduced"]) for x in reduced.collect()} == {3}


def test_batches_cost_what_full_passes_do(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 8)) + 6 * rng.normal(size=8) for _ in range(12)])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "k long, v array<double>").repartition(4)
    groups, centres = grouping.batch_kmeans(rows, "k", "v", 12, most=2500)
    full = KMeans(k=12, seed=1, maxIter=50).fit(rows.select(array_to_vector("v").alias("features"))).summary.trainingCost
    cost = groups.agg(F.sum("cost")).first()[0]
    assert groups.count() == len(x) and len(centres) == 12 and cost <= 1.02 * full


def test_groups_of_titles(spark):
    names = ["apple iphone black case", "samsung galaxy tab lite", "bosch drill hammer set"]
    rows = [(f"{j}-{i}", f"{n} {i}") for j, n in enumerate(names) for i in range(20)] + [("short", "two words"), ("odd", "never seen before"), ("none", None)]
    ads = spark.createDataFrame([(k, t, 1) for k, t in rows], "ad_url string, title string, w int")
    got = {x["ad_url"]: (x["cluster_id"], x["cluster_label"]) for x in grouping.title_groups(ads, most=3).collect()}
    assert set(got) == {k for k, _ in rows} - {"short", "none"} and got["odd"] == (-1, None)
    groups = [{got[f"{j}-{i}"][0] for i in range(20)} for j in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert "iphone" in got["0-1"][1] and "drill" in got["2-1"][1]
    few = {x["ad_url"]: tuple(x)[1:] for x in grouping.title_groups(ads.filter("ad_url in ('odd', '0-1')")).collect()}
    assert few["odd"] == (0, "never · seen · before") and grouping.title_groups(ads.limit(0)).count() == 0
    alone = spark.createDataFrame([(str(i), f"a{i} b{i} c{i}") for i in range(9)], "ad_url string, title string")
    assert {tuple(x)[1:] for x in grouping.title_groups(alone).collect()} == {(-1, None)}


def test_copies_weigh_as_so_many_rows(spark):
    """A row with copies has the weights, singular values and projections of as many rows of its own."""
    rng = np.random.default_rng(4)
    rows = [(i, [f"t{j}" for j in rng.integers(0, 12, 4)], int(rng.integers(1, 6))) for i in range(60)]
    once = spark.createDataFrame(rows, "k long, terms array<string>, copies long")
    each = spark.createDataFrame([(100 * k + i, t) for k, t, n in rows for i in range(n)], "k long, terms array<string>")
    a, b = reduction.weights(once, "k", "terms", copies="copies").cache(), reduction.weights(each, "k", "terms").cache()
    want = {(x["k"] // 100, x["term"]): x["w"] for x in b.collect()}
    assert {(x["k"], x["term"]): x["w"] for x in a.collect()} == pytest.approx(want) and set(a.columns) == {"k", "term", "w", "copies"}
    found, values = reduction.truncated_svd(a, "k", 12, copies="copies")
    exact = np.linalg.svd(matrix(b.collect())[1], compute_uv=False)
    assert values == pytest.approx(exact[: len(values)]) and len(values) == np.sum(exact > 1e-5)
    keys, m = matrix(a.collect())
    got = {x["k"]: x["reduced"] for x in found.collect()}
    r = np.array([got[k] for k in keys])
    assert r @ r.T == pytest.approx(m @ m.T, abs=1e-6)
    assert {x["k"]: x["copies"] for x in found.collect()} == {k: n for k, _, n in rows}


def test_weighted_batches_cost_what_full_passes_do(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(200, 8)) + 6 * rng.normal(size=8) for _ in range(12)])
    n = rng.integers(1, 40, len(x))
    rows = spark.createDataFrame([(i, v, int(c)) for i, (v, c) in enumerate(zip(x.tolist(), n))], "k long, v array<double>, n long").repartition(4)
    groups, _ = grouping.batch_kmeans(rows, "k", "v", 12, copies="n")
    full = KMeans(k=12, seed=1, maxIter=50, weightCol="n").fit(rows.select("n", array_to_vector("v").alias("features"))).summary.trainingCost
    assert groups.agg(F.sum(F.col("cost") * F.col("n"))).first()[0] <= 1.02 * full


def test_no_centre_is_left_without_rows():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 3))
    for seed in range(5):
        centres, _ = grouping.fit_batches(x, 60, seed, times=np.where(np.arange(90) < 5, 10_000, 1))
        assert len(np.unique(grouping._distances(x, centres).argmin(axis=1))) == 60


def test_every_row_counts_in_the_fit(spark):
    """More rows than a part has: what is rare or far among them has its share in the centres, which are the means of their rows."""
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(300, 6)) + 8 * rng.normal(size=6) for _ in range(10)] + [np.full((1, 6), 500.0), np.full((1, 6), -500.0)])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "k long, v array<double>").repartition(4)
    groups, centres = grouping.batch_kmeans(rows, "k", "v", 12, most=200, passes=60)
    of = {r["k"]: r["cluster_id"] for r in groups.collect()}
    assert len(of) == len(x) and len(set(of.values())) == 12 and len(centres) == 12
    by = np.array([of[i] for i in range(len(x))])
    assert max(np.abs(x[by == c].mean(axis=0) - centres[c]).max() for c in range(12)) < 0.3


def test_copies_of_a_title_cost_a_grouping(spark, monkeypatch):
    """Tables between the steps have a row for each different title, whatever the number of listings."""
    kept, real = {}, grouping.written
    monkeypatch.setattr(grouping, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    rows = [(f"{j}-{i}", f"{a} {b} case") for i in range(50) for j, (a, b) in enumerate((a, b) for a in ("red", "blue", "old") for b in ("iphone", "drill"))]
    ads = spark.createDataFrame(rows, "ad_url string, title string")
    got = grouping.title_groups(ads, most=3)
    assert got.count() == len(rows) == got.select("ad_url").distinct().count() and {x["cluster_id"] for x in got.collect()} == {0, 1, 2}
    by_title = got.join(ads, "ad_url").groupBy("title").agg(F.count_distinct("cluster_id").alias("n"))
    assert by_title.filter("n <> 1").isEmpty()
    assert kept["titles"].count() == 6 == kept["unit"].count() and kept["weights"].count() < 40


def test_sizes_come_from_the_different_titles(spark, tmp_path):
    """Sizes add up copies; the listings aren't met again."""
    rows = [(i, f"Brand#{i % 3}", f"{a} {b}", "NEW") for i, (a, b) in enumerate((a, b) for _ in range(20) for a in ("red", "hot") for b in ("ring", "bolt"))]
    odd = [(900, "solo", "only here", "once"), (901, "solo2", "never again", "more"), (902, "short", None, None), (903, None, None, None)]
    spark.createDataFrame(rows + odd, "p_partkey long, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = entry.queries()["title_cluster_sizes"](spark, str(tmp_path))
    got = found.first()
    assert (got["n_titles"], got["n_without"]) == (82, 2) and 0 < got["n_groups"] <= 12
    assert not any(str(tmp_path) in f for f in found.inputFiles())
