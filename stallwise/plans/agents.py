"""Queries of the batch steps around listings: parsed responses, duplicates, price events, migration, chat, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices, records, text
from ..operators import analytics, classify, filters, merge, similarity
from ..sources import listings as sources
from .catalog import register
from .fixture import ADS_SQL, ads, table


@register("parsed_responses", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS brand, p_name AS model, CASE WHEN p_partkey % 4 = 1 THEN 'with box' END AS seller_notes,
  '070' || p_partkey AS phone, p_partkey % 2 = 0 AS delivery_available, p_partkey % 7 <> 0 AS is_electronics, CASE WHEN p_partkey % 3 <> 2 AND p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE) END AS stated_price_amount,
  CASE WHEN p_partkey % 3 <> 2 AND p_partkey % 11 <> 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'EUR' ELSE 'MKD' END END AS stated_price_currency, p_type AS spec_type, 1 AS n_specs FROM part""")
def parsed_responses(spark, d):
    """A parser's response for every part: fenced, with fields nested in specs, a brace short, odd currencies, amounts of 0, unsaid accessories."""
    key = F.col("p_partkey")
    quoted = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    currency = F.when(key % 3 == 0, " eur ").when(key % 3 == 1, "MKD").otherwise("USD")
    amount = F.when(key % 11 == 0, F.lit("0")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" ден")))
    common = F.concat(
        F.lit('"model": '), quoted(F.col("p_name")), F.lit(', "phone": "070'), key.cast("string"), F.lit('", "delivery_available": '), (key % 2 == 0).cast("string"),
        F.lit(', "is_electronics": '), (key % 7 != 0).cast("string"), F.lit(', "brand": '), F.when(key % 5 == 0, '""').otherwise(quoted(F.col("p_brand"))),
        F.lit(', "seller_notes": "with box", "stated_price_amount": "'), amount, F.lit('", "stated_price_currency": "'), currency, F.lit('"'),
    )
    specs = F.concat(F.lit('"specs": {"type": '), quoted(F.col("p_type")), F.lit(', "gpu": " "'))
    nested, flat = F.concat(F.lit("{"), specs, F.lit(", "), common, F.lit("}")), F.concat(F.lit("{"), specs, F.lit("}, "), common, F.lit("}"))
    raw = F.when(key % 4 == 0, F.concat(F.lit("```json\n"), flat, F.lit("\n```"))).when(key % 4 == 1, flat).otherwise(nested)
    found = records.parsed(F.col("raw"), F.lit("phone"), F.when(key % 4 == 1, "со кутија"))
    rows = table(spark, d, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", found.alias("f"))
    names = ("brand", "model", "seller_notes", "phone", "delivery_available", "is_electronics", "stated_price_amount", "stated_price_currency")
    return rows.select("p_partkey", *[f"f.{x}" for x in names], F.try_element_at("f.specs", F.lit("type")).alias("spec_type"), F.size("f.specs").alias("n_specs"))


PARTS = """a AS (SELECT CAST(p_partkey AS VARCHAR) AS ad_url, lower(p_brand || ' ' || p_name || ' ' || p_type) AS t, p_retailprice AS price, CASE WHEN p_partkey % 2 = 0 THEN 'site_a' ELSE 'site_b' END AS source,
  'seller ' || (p_partkey % 3) AS seller, p_partkey % 10 = 0 AS service FROM part)"""


def _pairs(kind: str) -> str:
    """TF-IDF cosine of titles over character 3- and 4-grams of padded words, every pair of a band of prices scored."""
    of, least = ("''", 0.85) if kind == "cross_site" else ("source", 0.95)
    side = "x.source <> y.source" if kind == "cross_site" else "x.source = y.source AND x.seller = y.seller"
    return f"""WITH {PARTS}, b AS (SELECT ad_url, {of} AS g, price, source, seller, service, regexp_replace(CASE WHEN service THEN t || ' servis' ELSE t END, '[ ]+', ' ', 'g') AS t,
    list_distinct(regexp_extract_all(t, '(?:^|[^a-z0-9_])([a-z]{{0,2}}[0-9]+[a-z]{{0,2}})', 1)) AS k FROM a), w AS (SELECT ad_url, g, ' ' || unnest(string_split(t, ' ')) || ' ' AS w FROM b), c AS (SELECT ad_url, g, substr(w, i, n) AS gram, count(*) AS tf FROM
    (SELECT ad_url, g, w, n, unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) AS i FROM w, (VALUES (3), (4)) v(n) WHERE n = 3 OR length(w) >= 4) GROUP BY ALL),
  n AS (SELECT g, count(*) AS n FROM b GROUP BY g), df AS (SELECT g, gram, count(*) AS df FROM c GROUP BY ALL),
  r AS (SELECT ad_url, gram, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM c JOIN df USING (g, gram) JOIN n USING (g)),
  l AS (SELECT ad_url, sqrt(sum(w * w)) AS l FROM r GROUP BY ad_url), u AS MATERIALIZED (SELECT ad_url, gram, w / l AS w FROM r JOIN l USING (ad_url)),
  p AS MATERIALIZED (SELECT x.ad_url AS one, y.ad_url AS two, x.seller = y.seller AS same_seller, x.service OR y.service AS is_service FROM b x JOIN b y ON x.ad_url < y.ad_url AND {side}
    AND least(x.price, y.price) >= 0.85 * greatest(x.price, y.price) AND length(x.t) * 1.0 / length(y.t) BETWEEN 0.55 AND 1 / 0.55
    AND (len(x.k) = 0 OR len(y.k) = 0 OR list_has_any(x.k, y.k))),
  h AS MATERIALIZED (SELECT p.*, gram, w FROM p JOIN u ON ad_url = one),
  s AS (SELECT one, two, same_seller, is_service, sum(h.w * j.w) AS s FROM h JOIN u j ON j.ad_url = two AND h.gram = j.gram GROUP BY ALL HAVING sum(h.w * j.w) >= {least})
  SELECT one AS ad_url_1, two AS ad_url_2, round(s, 4) AS similarity_score, '{kind}' AS match_type, same_seller, is_service FROM s"""


def _titled(spark, d):
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        key.cast("string").alias("ad_url"), F.concat_ws(" ", F.lit("Itno"), "p_brand", "p_name", "p_type", F.when(key % 10 == 0, "servis")).alias("title"), F.col("p_retailprice").alias("price_eur"),
        F.when(key % 2 == 0, "site_a").otherwise("site_b").alias("source"), F.concat(F.lit("Seller  "), (key % 3).cast("string")).alias("seller_name"),
    )


@register("duplicates_cross_site", _pairs("cross_site"))
def duplicates_cross_site(spark, d):
    return similarity.find_duplicates(_titled(spark, d))


@register("duplicates_same_site", _pairs("same_site"))
def duplicates_same_site(spark, d):
    return similarity.find_duplicates(_titled(spark, d), "same_site")


@register("price_events", """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_extendedprice DESC) AS p FROM lineitem) WHERE p = 1),
  o AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN l_extendedprice ELSE p_retailprice END AS old FROM part LEFT JOIN l ON l_partkey = p_partkey WHERE p_partkey % 3 <> 0)
  SELECT l_partkey AS key, l_extendedprice AS price, l_shipdate AS recorded_at FROM l LEFT JOIN o ON l_partkey = p_partkey WHERE p_partkey IS NULL OR old IS NULL OR old <> l_extendedprice""")
def price_events(spark, d):
    """Entries of the price history for a scrape against stored rows, of which some have the price already."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_shipdate")
    latest = merge.last_wins(rows, ["l_partkey"], "l_shipdate", "l_extendedprice").withColumnsRenamed({"l_extendedprice": "last"})
    old = F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).when(F.col("p_partkey") % 2 == 0, F.col("last")).otherwise(F.col("p_retailprice"))
    parts = table(spark, d, "part").filter("p_partkey % 3 <> 0").join(latest, F.col("l_partkey") == F.col("p_partkey"), "left")
    stored = parts.select(F.col("p_partkey").alias("l_partkey"), old.alias("l_extendedprice"))
    return merge.price_events(stored, rows, "l_partkey", "l_extendedprice", "l_shipdate")[1]


@register("migrated_rows", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS scraped_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS posted_date,
  CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 2 END AS n_images, o_orderstatus || chr(10) || chr(10) || o_orderpriority AS description FROM orders""")
def migrated_rows(spark, d):
    """All rows of an older store brought up: zones added, dates guarded, JSON read or empty, descriptions cleaned."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(key % 2 == 0, day).otherwise(F.concat(day, F.lit("+00:00")))
    images = F.when(key % 4 == 0, "[oops").otherwise('["a.jpg", "b.jpg"]')
    said = F.concat("o_orderstatus", F.lit(" \U0001f600\r\n\n\n\n"), "o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", prices.zoned(stamp).alias("scraped_at"), prices.iso_date(F.when(key % 3 == 0, "вчера").otherwise(day)).alias("posted_date"),
        F.size(records.json_or(images, "array<string>", F.array().cast("array<string>"))).alias("n_images"), F.regexp_replace(text.migrated_description(said), " \n", "\n").alias("description"),
    )


TITLES = """t AS (SELECT p_partkey, p_size, lower(p_name || ' a' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_type END) AS t, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE length(p_type) - length(replace(p_type, ' ', '')) + 1 END
  + length(p_name) - length(replace(p_name, ' ', '')) + 2 AS n FROM part)"""


@register("titles_fit", f"""WITH {TITLES} SELECT a.p_partkey AS a, b.p_partkey AS b, a.n >= 3 AND b.n >= 3 AND least(length(a.t), length(b.t)) / greatest(length(a.t), length(b.t)) >= 0.55 AND a.p_size = b.p_size AS fit
  FROM t a JOIN t b ON a.p_partkey < b.p_partkey AND b.p_partkey <= a.p_partkey + 20""")
def titles_fit(spark, d):
    """The gate of duplicate search over neighbouring parts' titles."""
    title = F.lower(F.concat("p_name", F.lit(" a"), "p_size", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "p_type"))))
    rows = table(spark, d, "part").select("p_partkey", title.alias("t"))
    near = rows.withColumn("at", F.explode(F.sequence(F.col("p_partkey") + 1, F.col("p_partkey") + 20))).select(F.col("p_partkey").alias("a"), F.col("t").alias("u"), "at")
    return near.join(rows, F.col("at") == F.col("p_partkey")).select("a", F.col("p_partkey").alias("b"), text.titles_fit(F.col("u"), F.col("t")).alias("fit"))


@register("ad_types", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'wanted' WHEN 1 THEN 'service' WHEN 2 THEN 'service' WHEN 3 THEN 'wanted' ELSE 'product' END AS ad_type FROM part""")
def ad_types(spark, d):
    """The classifier with its own word lists, over titles and descriptions that hold some of them."""
    key = F.col("p_partkey") % 6
    title = F.when(key == 0, F.concat(F.lit("Барам "), "p_name")).when(key == 1, F.concat("p_name", F.lit(" СЕРВИС"))).when(key == 3, F.concat("p_name", F.lit(", looking for"))).otherwise(F.col("p_name"))
    said = F.when(key == 2, "поправка и инсталација").when(key == 4, "поправка, поправка").when(key == 5, "без услуги")
    return table(spark, d, "part").select("p_partkey", classify.ad_type(title, said).alias("ad_type"))


@register("product_cards", """SELECT p_partkey, 'https://shop.example/p/' || p_partkey AS source_url, upper(split_part(p_brand, ' ', 1)) AS brand, CAST(p_size + 100 AS DOUBLE) * 1000 AS price FROM part WHERE p_partkey % 4 <> 0""")
def product_cards(spark, d):
    """Cards of pages made of the parts, a card each; some lead elsewhere."""
    key = F.col("p_partkey")
    link = F.concat(F.when(key % 4 == 0, "https://other.example").otherwise(""), F.lit("/p/"), key.cast("string"))
    amount = F.concat((F.col("p_size") + 100).cast("string"), F.lit(".000 ден"))
    card = F.concat(F.lit("<ul><li><a href='/about'>About</a></li><li><a href='"), link, F.lit("'><img src=x>"), "p_brand", F.lit(" "), "p_type", F.lit(" "), amount, F.lit("</a></li></ul>"))
    pages = table(spark, d, "part").select(F.lit("https://shop.example/list").alias("url"), card.alias("html"))
    found = sources.read_cards(pages, "shop.example")
    return found.select(F.regexp_extract("source_url", r"(\d+)$", 1).cast("long").alias("p_partkey"), "source_url", "brand", "price")


@register("price_presets", f"WITH {ADS_SQL} SELECT CASE WHEN price_eur <= 50 THEN 1 WHEN price_eur <= 200 THEN 2 WHEN price_eur <= 500 THEN 3 WHEN price_eur <= 1000 THEN 4 WHEN price_eur > 1000 THEN 5 END AS preset, count(*) AS n FROM ads GROUP BY 1")
def price_presets(spark, d):
    return ads(spark, d).groupBy(filters.price_preset().alias("preset")).agg(F.count("*").alias("n"))


@register("chosen_brands_top", f"WITH {ADS_SQL} SELECT brand, count(*) AS n FROM ads WHERE brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34', 'Brand#45') GROUP BY brand ORDER BY n DESC, brand LIMIT 3")
def chosen_brands_top(spark, d):
    """A chart's first bars, of the brands that are chosen."""
    rows = filters.of_brands(ads(spark, d), ["Brand#11", "Brand#12", "Brand#23", "Brand#34", "Brand#45"])
    return filters.top(rows.groupBy("brand").agg(F.count("*").alias("n")), "n", 3)


@register("originals_odd", """SELECT count(*) AS n, min(event_id) AS first FROM events WHERE event_id % 7 <> 0 AND value >= 10 AND value <= 400 AND value > 90""")
def originals_odd(spark, d):
    rows = table(spark, d, "events").withColumns({"is_duplicate": F.col("event_id") % 7 == 0, "is_anomaly": F.col("value") > 90, "price_eur": F.col("value")})
    return filters.originals(rows, anomalies_only=True, least=10, most=400).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@register("recent_activity", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_activity(spark, d):
    return filters.recent(table(spark, d, "events"), 50, "ts").select("event_id", "user_id")


@register("notices", "SELECT event_type, count(*) FILTER (event_id % 1000 = 1) AS n_new, count(*) FILTER (value > 99) AS n_odd FROM events GROUP BY 1 HAVING count(*) FILTER (event_id % 1000 = 1) > 0 OR count(*) FILTER (value > 99) > 0")
def notices(spark, d):
    rows = table(spark, d, "events").withColumns({"new": F.col("event_id") % 1000 == 1, "odd": F.coalesce(F.col("value") > 99, F.lit(False))})
    return merge.notices(rows, "event_type", "new", "odd")


@register("known_rows", "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS known FROM orders")
def known_rows(spark, d):
    known = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.marked_known(table(spark, d, "orders").select("o_orderkey"), known, "o_orderkey")


@register("price_ranges_by_row", "SELECT p_partkey, count(l_partkey) AS n_prices, min(l_extendedprice) AS least_price, max(l_extendedprice) AS greatest_price FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def price_ranges_by_row(spark, d):
    history = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_extendedprice").alias("price"))
    return merge.with_history(table(spark, d, "part").select("p_partkey"), history, "p_partkey")


@register("chat_status", "SELECT conv_id, CASE WHEN count(*) BETWEEN 1 AND 20 AND max(length(text)) <= 500 THEN 200 ELSE 400 END AS status FROM conversations GROUP BY conv_id")
def chat_status(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    return rows.select("conv_id", records.valid_chat(F.col("messages")).alias("status"))


@register("types_resorted", f"WITH {ADS_SQL} SELECT ad_type, count(*) AS count, (count(*) * 2000 + total) // (total * 2) / 10.0::DOUBLE AS pct FROM ads, (SELECT count(*) AS total FROM ads) GROUP BY ad_type, total ORDER BY count DESC, ad_type LIMIT 2")
def types_resorted(spark, d):
    return filters.top(analytics.type_shares(ads(spark, d)), "count", 2, "ad_type")
