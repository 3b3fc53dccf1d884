"""Work that grows with the input only: equal results by brute force, and plans or figures that would show the older, larger work."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

import __spark_entry__ as entry
from stallwise.functions import text
from stallwise.operators import filters, pricing, reduction, similarity
from stallwise.sources import cards
from stallwise.streaming import ordered


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_retail_matches_by_equality(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "pro", "128gb", "5g", "max"])
    texts = lambda n, most: [" ".join(word() for _ in range(rng.randint(1, most))) for _ in range(n)]
    models, titles = [(rng.choice("xy"), t) for t in texts(40, 3)], [(rng.choice("XY"), t, float(p)) for p, t in enumerate(texts(60, 7), 1)]
    ads = spark.createDataFrame(models, "brand string, model string")
    retail = spark.createDataFrame(titles, "brand string, title string, price_mkd double")
    found = pricing.retail_matches(ads, retail)
    pairs = ads.distinct().join(retail.withColumn("brand", F.lower("brand")), "brand").filter(pricing.matches(pricing.model_tokens(F.col("model")), pricing.model_tokens(F.col("title"))))
    want = {tuple(x) for x in pairs.groupBy("brand", "model").agg(F.min("price_mkd"), F.count("*")).collect()}
    assert want and {tuple(x) for x in found.collect()} == want
    joins = [x for x in plan(found).splitlines() if "Join Inner" in x]
    assert any("tokens" in x for x in joins)  # not a brand's models with all its titles


def test_nearest_in_block_by_matrices(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], rng.choice([1, 2, 2, 2, None])) for i in range(150)] + [(200, [0.0] * 3, 2), (201, None, 2), (202, [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    at = df.filter("label is not null and embedding is not null and vec_id < 200")
    pairs = at.alias("a").join(at.alias("b"), F.expr("a.label = b.label and b.vec_id < a.vec_id"))
    pairs = pairs.select(F.col("a.vec_id"), F.col("b.vec_id").alias("other"), F.round(1 - similarity.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("d")).filter("d <= 0.2")
    want = {(x[0], x[1][1], x[1][0]) for x in pairs.groupBy("vec_id").agg(F.min(F.struct("d", "other"))).collect()}
    for size in (7, 512):
        found = similarity.nearest_in_block(df.repartition(3), "label", 0.2, size=size)
        assert want and {tuple(x) for x in found.collect()} == want
        assert "zip_with" not in plan(found).lower()  # pairs meet in packs, not one by one


def test_pages_of_one_part_are_dealt_out(spark):
    pages = spark.range(40).select("id", F.lit("<ul><li><a href='/p/1'>Phone 999</a></li></ul>").alias("html")).coalesce(1)
    found = cards.read_cards(pages, F.lit("s"), F.lit("https://a.example"), "a.example")
    assert found.count() == 40 and found.select(F.spark_partition_id()).distinct().count() > 1


def test_pairs_of_suppliers_are_dealt_out(spark, tmp_path):
    rows = [(i, f" Name  {i % 40}" if i % 9 else None, i % 2) for i in range(300)]
    suppliers = spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int")
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    found = entry.queries()["title_gate"](spark, str(tmp_path))
    other = suppliers.toDF("b", "name_b", "nation")
    pairs = suppliers.join(other, F.expr("s_nationkey = nation and s_suppkey < b"))
    want = {(x[0], x[1], x[2]) for x in pairs.select("s_suppkey", "b", text.sellers_match(F.col("s_name"), F.col("name_b"))).collect()}
    assert {(x["a"], x["b"], x["same_seller"]) for x in found.collect()} == want
    per = [x["count"] for x in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) > 50 and max(per) < len(want) / 10  # two nations, many tasks


def test_similar_takes_its_rows_out_of_a_list(spark):
    rng = random.Random(8)
    schema = "ad_url string, ad_type string, cluster_id int, posted_date date, scraped_at timestamp"
    rows = [(f"u{i % 90}", rng.choice(["product", "service"]), rng.choice([1, 2, None]), None, None) for i in range(100)] + [("alone", "product", 7, None, None)]
    ads = spark.createDataFrame(rows, schema)
    found = filters.similar(ads.filter("ad_url not in ('u1', 'u2', 'u3', 'u4', 'u5', 'u6', 'u7', 'u8', 'u9', 'u0')"))
    newest = {c: sorted(r[0] for r in rows if r[1] == "product" and r[2] == c and r[0] not in {f"u{i}" for i in range(10)})[:7] for c in (1, 2, 7)}
    want = {(r[0], u, k) for r in rows if r[2] and r[0] not in {f"u{i}" for i in range(10)} for k, u in enumerate([u for u in newest[r[2]] if u != r[0]][:6], 1)}
    assert {tuple(x) for x in found.collect()} == want
    # Rows that share a key are one listing with both lists, as the window by ad_url had it.
    twice = spark.createDataFrame([("a", "service", 1, None, None), ("a", "service", 1, None, None), ("b", "product", 1, None, None), ("c", "product", 1, None, None)], schema)
    assert sorted(tuple(x) for x in filters.similar(twice).filter("ad_url = 'a'").collect()) == [("a", "b", 1), ("a", "b", 2), ("a", "c", 3), ("a", "c", 4)]
    assert "windowspecdefinition(ad_url" not in plan(found)


def test_weights_of_one_part_are_dealt_out(spark):
    rows = spark.range(2000).coalesce(1).select(F.col("id").alias("k"), F.array(F.lit("all"), F.concat(F.lit("t"), F.col("id") % 7), F.lit("all"), F.lit(None)).alias("terms"))
    found = reduction.weights(rows, "k", "terms", max_df=1.0)
    assert found.groupBy("k").agg(F.sum(F.col("w") * F.col("w")).alias("s")).filter("abs(s - 1) > 1e-9").count() == 0 and found.count() == 4000
    assert "Aggregate [k" not in plan(found).replace("_", "")  # a row's terms are counted in the row


def test_copies_of_a_title_are_compared_once(spark):
    titles = ["apple iphone 16 128gb black", "apple iphone 16 128gb blacks", "samsung galaxy tab nine", "two words"]
    rows = [(f"u{k:02d}{i}", t, 100.0, "xy"[k % 2]) for k in range(12) for i, t in enumerate(titles)]
    ads = spark.createDataFrame(rows, "ad_url string, title string, price_eur double, source string")
    links = {(x["t1"], x["t2"]) for x in similarity.alike_titles(ads, 0.75).collect()}
    assert similarity.alike_titles(ads, 0.75).count() == len(links) == 5
    found = {(x[0], x[1]) for x in similarity.duplicates(ads, 0.75, side="source").collect()}
    assert found == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] != b[3] and (a[1], b[1]) in links}


def test_candidates_meet_as_matrices(spark, monkeypatch):
    """Equal to brute force where a gram's titles are many packs; candidates aren't rows."""
    rng = random.Random(9)
    words = ["red", "reds", "iphone", "iphones", "galaxy", "case", "cases", "max16", "max17", "pro"]
    titles = sorted({" ".join(rng.choices(words, k=4)) for _ in range(150)})
    ads = spark.createDataFrame([(f"u{i:03d}", t) for i, t in enumerate(titles)], "ad_url string, title string")
    plans, real = {}, similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: (plans.update({name: plan(df)}), real(df, name))[1])
    monkeypatch.setattr(similarity, "MET", 16, raising=False)
    found = {(x["t1"], x["t2"]): x["s"] for x in similarity.alike_titles(ads, 0.7).collect()}
    weights = similarity.tf_idf(ads, "ad_url", "title")
    w = {}
    for x in weights.collect():
        w.setdefault(x["ad_url"], {})[x["gram"]] = x["w"]
    pairs = ads.toDF("a", "t1").crossJoin(ads.toDF("b", "t2")).filter(text.titles_fit(F.col("t1"), F.col("t2"))).collect()
    scores = {(x["t1"], x["t2"]): sum(v * w[x["b"]].get(g, 0) for g, v in w[x["a"]].items()) for x in pairs}
    want = {k: s for k, s in scores.items() if s >= 0.7}
    assert len(want) > 2 * len(titles) and set(found) == set(want) and all(abs(found[k] - s) < 1e-9 for k, s in want.items())
    assert "FlatMapGroupsInArrow" in plans["scored"]


def test_pairs_of_listings_are_not_joined_again(spark):
    """Pairs grow with the square of copies: what is told of both listings comes with them, and listings of one site don't meet."""
    rows = [(f"u{k:02d}{i}", t, 100.0, "xyz"[k % 3], f" Ann  {k % 2}" if k % 5 else None) for k in range(12) for i, t in enumerate(["apple iphone 16 128gb servis", "samsung galaxy tab nine"])]
    ads = spark.createDataFrame(rows, "ad_url string, title string, price_eur double, source string, seller_name string")
    found = similarity.find_duplicates(ads)
    want = {(a[0], b[0], bool(a[4] and a[4] == b[4]), "servis" in a[1]) for a in rows for b in rows if a[0] < b[0] and a[3] != b[3] and a[1] == b[1]}
    assert {(x["ad_url_1"], x["ad_url_2"], x["same_seller"], x["is_service"]) for x in found.collect()} == want
    last = next(x for x in plan(found).splitlines() if "Join" in x)
    assert "band" in last and "source_2" in last and "price_eur" in last


def test_streams_keep_state_by_bucket(spark, tmp_path):
    source = spark.readStream.schema("k string, at timestamp").parquet(f"file://{tmp_path}")
    found = ordered.marked_within(source, ["k"], "at", timedelta(days=1), "1 hour")
    assert "bucket_" in found._jdf.queryExecution().analyzed().toString()
