import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.operators import cells, similarity


@pytest.fixture(scope="module")
def grouped(spark):
    """Groups of vectors with copies and odd rows among them."""
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(40, 16)) * 4
    rows = [(i, (middles[i % 40] + rng.normal(size=16)).tolist()) for i in range(1600)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)] + [(3000, [0.0] * 16), (3001, None), (3002, [1.0, None]), (None, rows[0][1]), (3003, [1.0, 2.0]), (3004, [2.0, 1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def test_recall_with_few_cells(grouped):
    asked = grouped.filter("vec_id % 20 = 0")
    index = cells.Index(grouped)
    assert len(index.centres) >= 80 and index.probes <= len(index.centres) / 4
    exact = {(x["query"], x["vec_id"]) for x in similarity.nearest_each(grouped, asked, 10).collect()}
    found = {(x["query"], x["vec_id"]) for x in index.search(asked, 10).collect()}
    assert len(found & exact) >= 0.9 * len(exact) and {q for q, _ in found} == {q for q, _ in exact}
    whole = {(x["query"], x["vec_id"]) for x in index.search(asked, 10, all_cells=True).collect()}
    assert len(whole & exact) >= 0.999 * len(exact)


def test_earlier_duplicates(grouped):
    exact = {x["vec_id"]: x for x in similarity.nearest_earlier(grouped, 0.3).collect()}
    found = {x["vec_id"]: x for x in cells.duplicates(grouped, 0.3).collect()}
    assert all(found[2000 + i]["duplicate_of"] == 7 and found[2000 + i]["distance"] == 0 for i in range(300)) and found[3004]["duplicate_of"] == 3003
    same = sum(k in found and found[k]["duplicate_of"] == x["duplicate_of"] for k, x in exact.items())
    assert same >= 0.9 * len(exact) and all(abs(x["distance"] - exact[k]["distance"]) < 1e-5 for k, x in found.items() if k in exact and x["duplicate_of"] == exact[k]["duplicate_of"])


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    exact = {(x["vec_id"], x["duplicate_of"]) for x in similarity.nearest_earlier(rows, 0.6).collect()}
    found = {(x["vec_id"], x["duplicate_of"]) for x in cells.duplicates(rows, 0.6).collect()}
    assert len(found & exact) >= 0.9 * len(exact) > 0


def test_empty_and_tiny(spark, grouped):
    assert cells.duplicates(grouped.limit(0), 0.5).count() == 0
    few = grouped.filter("vec_id in (1, 2, 41)")
    assert sorted(x["vec_id"] for x in cells.Index(few).search(few.filter("vec_id = 1"), 5).collect()) == [2, 41]
    assert cells.Index(few).search(few, 2).agg(F.max("rank")).first()[0] == 2


def test_vectors_are_scaled_as_matrices_and_dealt_out(spark, grouped):
    """Lengths come from whole batches, not from a function for each number, and one file's rows are in many tasks."""
    found = cells.units(grouped, "vec_id", "embedding", digits=9)
    assert "transform(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {x["id"]: x["unit"] for x in found.collect()}
    want = {x["vec_id"]: np.array(x["embedding"]) for x in grouped.filter("vec_id is not null and embedding is not null and vec_id not in (3000, 3002)").collect()}
    assert set(got) == set(want) and all(np.abs(np.array(got[k]) - v / np.linalg.norm(v)).max() < 1e-8 for k, v in want.items())
    index = cells.Index(grouped.coalesce(1))
    assert index.rows.select(F.input_file_name()).distinct().count() > 1
    close = index.search(grouped.filter("vec_id < 60"), 3, least=0.9)
    whole = index.search(grouped.filter("vec_id < 60"), 3).filter("similarity >= 0.9")
    assert {(x["query"], x["vec_id"]) for x in close.filter("similarity >= 0.9").collect()} == {(x["query"], x["vec_id"]) for x in whole.collect()}
