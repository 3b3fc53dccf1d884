import collections
import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stallwise.functions import prices, records, text
from stallwise.operators import analytics, classify, filters, merge, pricing, ranges, similarity
from stallwise.plans import catalog
from stallwise.sources import listings as sources
from stallwise.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(spark, rows, schema, *columns):
    return [tuple(x) for x in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("2.000 €", ("2000", "EUR", 2000.0, 123000.0, None)), ("24.999 ден", ("24999", "MKD", 406.49, 24999.0, None)), ("1.234,50 €", ("1234.5", "EUR", 1234.5, 75921.75, None)),
    ("100 USD", ("100", None, None, None, None)), ("По Договор", (None, None, None, None, "По Договор")), ("1,2,3 €", (None, None, None, None, "1,2,3 €")), (None, (None,) * 5), ("", (None,) * 5),
])
def test_prices(spark, raw, want):
    assert tuple(one(spark, prices.parse_price(F.lit(raw).cast("string")))) == want


@pytest.mark.parametrize("posted, scraped, want", [
    ("Денес 10:30", "2026-01-01 00:00:00", (2026, 1, 1)), ("Вчера 10:30", "2026-01-01 00:00:00", (2025, 12, 31)), ("01 авг. 10:30", "2026-03-05 00:00:00", (2025, 8, 1)),
    ("29 фев. 10:00", "2026-03-05 00:00:00", None), ("мај 12 2015 02:22", "2026-03-05 00:00:00", (2015, 5, 12)), ("foo", "2026-03-05 00:00:00", None), (None, "2026-03-05 00:00:00", None),
])
def test_posted_dates(spark, posted, scraped, want):
    got = one(spark, prices.posted_date(F.lit(posted).cast("string"), F.lit(scraped).cast("timestamp")))
    assert got == (want and datetime.date(*want))


@pytest.mark.parametrize("title, description, want", [
    ("Барам iPhone 12", "", "wanted"), ("Сервис за телефони", "", "service"), ("Laptop HP", "servis i popravka", "service"), ("Laptop HP", "servis", "product"), (None, None, "product"),
])
def test_ad_types(spark, title, description, want):
    assert one(spark, classify.ad_type(F.lit(title).cast("string"), F.lit(description).cast("string"))) == want


def test_duplicate_gates(spark):
    close = lambda a, b: one(spark, prices.prices_close(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert [close(100, 85), close(100, 84), close(0, 10), close(None, 10)] == [True, False, False, False]
    sellers = lambda a, b: one(spark, text.sellers_match(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert [sellers("Petar", "Petar Petrovski"), sellers("A", None)] == [True, False]
    fit = lambda a, b: one(spark, text.titles_fit(F.lit(a), F.lit(b)))
    assert not fit("two words", "two words") and not fit("samsung s3 case", "samsung a8 case") and fit("samsung big case", "samsung a8 case")


@pytest.mark.parametrize("model, title, want", [
    ("iphone 16", "apple iphone 16 128gb black", True), ("iphone 16", "apple iphone 16 pro max 256gb natural", False), ("x6", "poco x6c 128gb", False), ("galaxy a26 5g", "galaxy a26 128gb", True), ("", "x", False),
])
def test_model_matches(spark, model, title, want):
    assert one(spark, pricing.matches(pricing.model_tokens(F.lit(model)), pricing.model_tokens(F.lit(title)))) is want


def test_variants_and_deals(spark):
    several = lambda m, t: one(spark, pricing.names_variants(F.lit(m), F.lit(t)))
    assert several("iphone 16", "iPhone 16, 16 Pro i 16 Pro Max") and not several("iphone 16", "iPhone 16 128GB") and not several("galaxy", "galaxy pro")
    deal = lambda r, c: one(spark, prices.is_deal(F.lit(r), F.lit(c).cast("string")))
    assert [deal(0.10, "Used"), deal(0.0999, "Used"), deal(0.95, "New"), deal(0.9501, "New"), deal(0.65, None)] == [True, False, True, False, True]


def test_corrected_prices(spark):
    fix = lambda p, s, c: one(spark, prices.corrected(F.lit(p).cast("double"), F.lit(s).cast("double"), F.lit(c)))
    assert [fix(300, 300, "EUR"), fix(200, 100, "MKD"), fix(50, 100, "MKD"), fix(None, 100, "MKD"), fix(5, None, "MKD")] == [18450, 200, 50, 100, 5]


def test_quartile_trimming(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 100)] + [("b", float(x)) for x in (*range(1, 8), 1000)] + [("c", 1.0), ("c", 2.0)]
    out = {x["k"]: x for x in analytics.trimmed(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert (out["a"]["q1"], out["a"]["q3"], out["a"]["greatest"], out["a"]["middle"]) == (1, 100, 100, 5)
    assert (out["b"]["n"], out["b"]["q1"], out["b"]["q3"], out["b"]["total"], out["b"]["m"], out["b"]["middle"]) == (8, 2, 7, 28, 7, 8)
    assert out["c"]["n"] == 2


def test_exact_rounding(spark):
    mean = lambda total, n, digits: one(spark, analytics.rounded(F.lit(total).cast("decimal(38,6)"), F.lit(n), digits))
    assert [mean("3914.13", 2, 2), mean("2.03", 2, 2), mean("0.25", 1, 1), mean("1", 3, 2)] == [1957.07, 1.02, 0.3, 0.33]
    assert one(spark, analytics.percent(F.lit(1).cast("long"), F.lit(2000).cast("long"))) == 0.1


def test_responses(spark):
    parse = lambda x: one(spark, records.typed(records.fields_of(F.lit(x).cast("string"))))
    found = parse('```json\n{"specs": {"brand": "Apple", "ram": "8", "gpu": " ", "stated_price_amount": "300 EVRA", "stated_price_currency": " eur "}')
    assert (found["brand"], found["specs"], found["stated_price_amount"], found["stated_price_currency"], found["is_electronics"], found["delivery_available"]) == ("Apple", {"ram": "8"}, 300, "EUR", True, False)
    whole = parse('{"brand": "", "phone": "070", "seller_type": "private", "note": "{", "stated_price_amount": 5, "stated_price_currency": "USD", "is_electronics": false, "delivery_available": true, "specs": {"brand": "x"}}')
    assert (whole["brand"], whole["phone"], whole["seller_type"], whole["stated_price_amount"], whole["stated_price_currency"]) == (None, "070", "private", None, None)
    assert (whole["is_electronics"], whole["delivery_available"]) == (False, True)
    assert all(v is None for k, v in parse("no json").asDict().items() if k not in ("is_electronics", "delivery_available"))
    noted = one(spark, records.parsed(F.lit('{"seller_notes": "with charger"}'), F.lit("phone"), F.lit(None).cast("string")))
    assert noted["seller_notes"] is None
    number = lambda x: one(spark, prices.to_number(F.lit(x)))
    assert number("1.500,00") is None and number("300 EVRA") == 300
    note = lambda n, t: one(spark, text.verified_note(F.lit(n), F.lit(t), text.ACCESSORIES))
    assert note("with box", "со кутија") == "with box" and note("with charger", "nothing") is None


def test_known_runs(spark):
    flags = [True] * 49 + [False] + [True] * 60
    rows = spark.createDataFrame([("s", i + 1, f) for i, f in enumerate(flags)], "source string, seq int, known boolean")
    assert ranges.until_known_run(rows, "source", "seq", "known").agg(F.max("seq")).first()[0] == 100


def test_known_runs_over_borders(spark):
    """A hot group over many partitions, groups of a row, runs that cross borders, ties, nulls: as a walk over the rows finds it."""
    rng = random.Random(4)
    rows = [("hot", i, rng.random() < 0.8) for i in range(400)] + [(f"g{i % 23}", i, rng.random() < 0.7) for i in range(300)] + [(None, i, True) for i in range(9)]
    rows += [("ties", i // 3, rng.choice([True, True, None])) for i in range(60)] + [("all", i, True) for i in range(100)]
    frame = spark.createDataFrame([(g, o, k, "x") for g, o, k in rows], "source string, seq int, known boolean, part string").repartition(5)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for run in (1, 4, 12, 60):
                got = collections.Counter((x["source"], x["seq"]) for x in ranges.until_known_run(frame.filter("source <> 'ties' or source is null"), "source", "seq", "known", run).collect())
                want = collections.Counter()
                for group in {g for g, _, _ in rows} - {"ties"}:
                    streak = 0
                    for _, o, k in sorted(x for x in rows if x[0] == group):
                        want[group, o] += 1
                        streak = streak + 1 if k else 0
                        if streak == run:
                            break
                assert got == want
            ties = ranges.until_known_run(frame.filter("source = 'ties'"), "source", "seq", "known", 1).collect()
            stop = min(o for g, o, k in rows if g == "ties" and k)
            assert max(x["seq"] for x in ties) == stop and len(ties) == 3 * (stop + 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert ranges.until_known_run(frame.limit(0), "source", "seq", "known").columns == frame.columns


def test_known_run_stream(spark, tmp_path):
    for k, flags in enumerate(([True] * 3, [True] * 3, [True] * 2)):
        spark.createDataFrame([("s", 10 * k + i, f) for i, f in enumerate(flags)], "source string, seq int, known boolean").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    stream = spark.readStream.schema("source string, seq int, known boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    got = []
    ingest.start(ingest.known_run_stop(stream, "source", "seq", "known", 5), lambda b, _: got.extend(b.collect()), f"file://{tmp_path}/c").awaitTermination()
    assert [x["source"] for x in got] == ["s"]


def test_merging(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", "n")], "k int, v string, w string")
    assert sorted(map(tuple, merge.upsert(old, new, "k", ["v"]).collect())) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]
    assert sorted(map(tuple, merge.insert_if_absent(old, new, "k").collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "n")]


def test_title_similarity(spark):
    rows = [("a1", "apple iphone 16 128gb black", 100.0, "x"), ("b1", "apple iphone 16 128gb blacks", 98.0, "y"), ("b2", "apple iphone 16 128gb black", 50.0, "y"), ("b3", "samsung galaxy tab nine", 100.0, "y"), ("a2", "apple iphone 16 128gb black", 100.0, "x")]
    docs = spark.createDataFrame(rows, "ad_url string, title string, price_eur double, source string")
    got = similarity.duplicates(docs, 0.75, side="source").collect()
    weights = {}
    for x in similarity.tf_idf(docs, "ad_url", "title").collect():
        weights.setdefault(x["ad_url"], {})[x["gram"]] = x["w"]
    assert all(math.isclose(sum(w * w for w in v.values()), 1) for v in weights.values())
    assert sorted((x[0], x[1]) for x in got) == [("a1", "b1"), ("a2", "b1")]
    score = sum(w * weights["b1"].get(g, 0) for g, w in weights["a1"].items())
    assert got[0]["similarity_score"] == pytest.approx(score, abs=1e-4)


def test_nearest_earlier_of_all_rows(spark):
    spread = [[math.cos(i * 0.7), math.sin(i * 0.7), 0.1 * (i % 7)] for i in range(60)]
    rows = [(i, [float(x) for x in v], i % 5) for i, v in enumerate(spread)]
    rows += [(60, [0.0, 0.0, 0.0], 0), (61, None, 0), (62, [1.0, None, 0.0], 0), (63, [1.0, 0.0], 0), (64, rows[3][1], 9), (65, rows[3][1], 8), (None, [1.0, 0.0, 0.0], 0), (66, [2.0, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = set()
    whole = [(i, v) for i, v, _ in rows if i is not None and v and None not in v and any(v)]
    for i, v in whole:
        near = [(round(1 - sum(x * y for x, y in zip(v, w)) / math.sqrt(sum(x * x for x in v) * sum(x * x for x in w)), 6) + 0.0, j) for j, w in whole if j < i and len(w) == len(v)]
        if near and min(near)[0] <= 0.05:
            want.add((i, min(near)[1], min(near)[0]))
    assert {(64, 3, 0.0), (65, 3, 0.0), (66, 63, 0.0)} <= want
    for size in (7, 2048):  # blocks don't change the result
        got = [tuple(x) for x in similarity.nearest_earlier(df.repartition(3), 0.05, size=size).collect()]
        assert len(got) == len(want) and set(got) == want


def test_reference_prices_of_the_whole_catalogue(spark):
    assert entry.queries()["reference_price_all"](spark, SF).filter("price_vs_new_ratio is not null and reference_source <> 'retail'").count() == 0
    assert "%" not in catalog.oracle_sql()["reference_price_all"].split("FROM part ")[-1].split(" GROUP BY")[0]
    rows = [("a", "x1", "Used", 1000.0), ("b", "x1", "New", 2000.0), ("c", "x1", "New", 3000.0), ("d", "y2", "Used", 500.0), ("e", "y2", "New", 2000.0)]
    ads = spark.createDataFrame([(u, "product", "Acme", m, m, c, p) for u, m, c, p in rows], "ad_url string, ad_type string, brand string, model string, title string, condition string, price_mkd double")
    retail = spark.createDataFrame([("acme", "y2", 800.0)], "brand string, title string, price_mkd double")
    got = {x["ad_url"]: (x["reference_source"], x["reference_new_price_mkd"], x["reference_sample_size"]) for x in pricing.reference_prices(ads, retail).collect()}
    assert got == {"a": ("marketplace", 2500.0, 2), "b": (None,) * 3, "c": (None,) * 3, "d": ("retail", 800.0, 1), "e": ("retail", 800.0, 1)}


def test_nearest_of_each_query(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i // 4)]) for i in range(40)] + [(40, None), (41, [1.0])], "vec_id long, embedding array<double>")
    vectors = {x[0]: x[1] for x in rows.limit(40).collect()}
    cos = lambda v, w: round(sum(x * y for x, y in zip(v, w)) / math.hypot(*v) / math.hypot(*w), 6)
    want = {q: sorted((-cos(vectors[q], v), i) for i, v in vectors.items() if i != q)[:5] for q in (0, 20)}
    for size in (6, 2048):
        got = similarity.nearest_each(rows, rows.filter("vec_id % 20 = 0"), 5, size=size).orderBy("query", "rank").collect()
        assert {q: [(-x["similarity"], x["vec_id"]) for x in got if x["query"] == q] for q in (0, 20)} == want and len(got) == 10


def test_small_functions(spark):
    get = lambda c: one(spark, c)
    lit = lambda x: F.lit(x).cast("string")
    assert [get(text.is_service(lit(x))) for x in ("Servis za laptopi", "Откуп телефони", "laptop", None)] == [True, True, False, False]
    assert get(text.migrated_description(lit("a \U0001f600\r\n\n\n\nb  c"))) == "a \n\nb c"
    assert get(records.shown_notes(lit("Со кутија"), lit("Продавам со кутија."))) is None and get(records.shown_notes(lit("box"), lit(None))) == "box"
    assert get(records.embedding_input(lit("a"), lit(None))) == "a. "
    assert get(records.joined_nodes(F.array(lit(" a "), lit(""), lit("b")))) == "a\nb"
    assert get(records.first_of(F.create_map(lit("x"), lit(" "), lit("y"), lit("v")), "x", "z", "y")) == "v"
    assert get(records.json_or(lit("oops"), "array<string>", F.array().cast("array<string>"))) == [] and get(records.json_or(lit('["a"]'), "array<string>", F.array().cast("array<string>"))) == ["a"]
    assert [get(prices.zoned(lit(x))) for x in ("2026-01-02T03:04:05", "2026-01-02T03:04:05Z", "2026-01-02T03:04:05+01:00")] == ["2026-01-02T03:04:05+00:00", "2026-01-02T03:04:05Z", "2026-01-02T03:04:05+01:00"]
    assert [get(prices.iso_date(lit(x))) for x in ("2026-01-02T10", "02.01.2026", "2026-13-40", None)] == [datetime.date(2026, 1, 2), None, None, None]
    assert [values(spark, [(p,)], "price_eur double", filters.price_preset())[0][0] for p in (None, 0.0, 50.0, 50.5, 500.0, 5000.0)] == [None, 1, 1, 2, 3, 5]
    chat = lambda *m: get(records.valid_chat(F.array(*[F.struct(lit("user").alias("role"), lit(x).alias("content")) for x in m])))
    assert [chat("hi"), chat("x" * 501), chat(*["a"] * 21)] == [200, 400, 400]


def test_price_events_and_notices(spark):
    schema = "url string, price double, at int"
    stored = spark.createDataFrame([("a", 5.0, 1), ("b", 7.0, 1), ("c", None, 1)], schema)
    scraped = spark.createDataFrame([("a", 5.0, 2), ("b", 8.0, 2), ("b", 9.0, 3), ("c", 1.0, 2), ("d", 2.0, 2), ("e", None, 2), ("a", None, 1)], schema)
    new, history = merge.price_events(stored, scraped, "url", "price", "at")
    assert sorted(x["url"] for x in new.collect()) == ["d", "e"]
    assert sorted(map(tuple, history.collect())) == [("b", 9.0, 3), ("c", 1.0, 2), ("d", 2.0, 2)]
    told = {x["url"]: (x["n_prices"], x["least_price"]) for x in merge.with_history(stored, history, "url").collect()}
    assert told == {"a": (0, None), "b": (1, 9.0), "c": (1, 1.0)}
    assert sorted((x["url"], x["known"]) for x in merge.marked_known(scraped, stored, "url").filter("at = 2").collect()) == [("a", True), ("b", True), ("c", True), ("d", False), ("e", False)]
    rows = spark.createDataFrame([("g", True, False), ("g", False, True), ("h", False, False)], "g string, new boolean, odd boolean")
    assert [tuple(x) for x in merge.notices(rows, "g", "new", "odd").collect()] == [("g", 1, 1)]
    details = spark.createDataFrame([("a", 1.0, 9), ("a", 2.0, 8), ("b", None, 3)], schema)
    for parts in (1, 4):
        got = merge.with_detail(stored, details.repartition(parts), "url").collect()
        assert sorted(map(tuple, got)) == [("a", 2.0, 8), ("b", 7.0, 3), ("c", None, 1)]


def test_duplicates_of_both_kinds(spark):
    rows = [
        ("a", "Se prodava apple iphone 16 128 gb black", 100.0, "x", "Ana"), ("b", "apple iphone 16 128gb black", 86.0, "y", "Bo"), ("c", "apple iphone 16 128gb black", 60.0, "y", "Bo"),
        ("d", "apple iphone 16 128gb black", 90.0, "y", "Bo P."), ("e", "servis apple iphone 16 128gb black", 95.0, "x", "Ana"), ("f", None, 95.0, "x", "Ana"), ("g", "apple iphone 15 128gb black", 99.0, "x", "Ana"),
    ]
    ads = spark.createDataFrame(rows, "ad_url string, title string, price_eur double, source string, seller_name string")
    cross = {(x[0], x[1]): (x["match_type"], x["same_seller"], x["is_service"]) for x in similarity.find_duplicates(ads).collect()}
    assert cross[("a", "b")] == ("cross_site", False, False) and ("a", "d") in cross and ("a", "c") not in cross and ("b", "d") not in cross and ("a", "g") not in cross
    assert all(v[2] == ("e" in k) for k, v in cross.items())
    same = [(x[0], x[1], x["same_seller"]) for x in similarity.find_duplicates(ads, "same_site").collect()]
    assert ("b", "d", True) in same and all({x[0], x[1]} != {"b", "c"} for x in same)
    wide = spark.createDataFrame([("a", "apple iphone 16 black", 100.0, "x"), ("b", "apple iphone 16 black", 61.0, "y")], "ad_url string, title string, price_eur double, source string")
    assert similarity.duplicates(wide, 0.85, side="source", tolerance=0.4).count() == 1


def test_cards():
    page = """<ul><li><a href="/p/1"><img src=x>Samsung Galaxy S23 64GB 24.999 ден</a></li><li><a href="/p/1">again 500</a></li><li><a href="/about">About</a></li>
    <li><a href="https://other.example/x">Foreign 999</a></li><li><a href="/p/2">Phone 32.999 28.500</a></li></ul>"""
    got = sources.cards(page, "https://shop.example/list", "shop.example")
    assert [(c["source_url"], c["title"], c["price"]) for c in got] == [("https://shop.example/p/1", "Samsung Galaxy S23 64GB", 24999.0), ("https://shop.example/p/2", "Phone 32.999 28.500", 28500.0)]
    assert sources.card_price("Гаранција 24 месеци, испорака за 3 дена") is None and sources.card_title("iPhone 15 Pro Редовна цена 89.999") == "iPhone 15 Pro"
    assert sources.card_brand("Lenovo ThinkPad T14") == "LENOVO" and sources.card_brand("") is None


def test_pages_of_numbers():
    assert filters.page_numbers(1, 9) == [1, 2, 3] and filters.page_numbers(5, 6) == [3, 4, 5, 6]


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "key string, price double, ts timestamp")
    assert merge.price_changes(rows, "key", "price", "ts").count() == 0 and analytics.trimmed(rows, "key", "price").count() == 0


def _norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(out.columns) == sorted(names) and _norm(out.collect(), out.columns) == _norm(want.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() == 24
