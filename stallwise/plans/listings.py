"""Queries over listings: lists, pages, counts and analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices, records, text
from ..operators import analytics, classify, filters, merge, pricing, ranges, similarity
from .catalog import oracle_sql, register
from .fixture import ADS_SQL, ads, table

TODAY = "1998-09-01"
LIST = ("ad_url", "title", "source", "category", "condition", "price_eur", "posted_date", "good_price_deal")
SHOWN = "(is_electronics IS NULL OR is_electronics) AND (is_active IS NULL OR is_active)"
NEWEST = "posted_date DESC NULLS LAST, scraped_at DESC, ad_url"


def _list(where: str, order: str, offset: int = 0) -> str:
    return f"WITH {ADS_SQL} SELECT {', '.join(LIST)} FROM ads WHERE {SHOWN} AND {where} ORDER BY {order} LIMIT 24 OFFSET {offset}"


@register("ads_list_newest", _list("true", NEWEST))
def ads_list_newest(spark, d):
    return filters.page(filters.listing(ads(spark, d))).select(*LIST)


@register("ads_list_price_asc", _list("source = 'site_a' AND price_eur >= 0 AND price_eur <= 900", "price_eur ASC NULLS LAST, ad_url", 24))
def ads_list_price_asc(spark, d):
    return filters.page(filters.listing(ads(spark, d), source="site_a", category="", min_price=0, max_price=900), 2, "price_asc").select(*LIST)


@register("ads_list_price_desc", _list("good_price_deal AND condition = 'Used - Good' AND title ILIKE '%a%'", "price_eur DESC NULLS LAST, ad_url"))
def ads_list_price_desc(spark, d):
    return filters.page(filters.listing(ads(spark, d), condition="Used - Good", q="A", good_deal_only=True), 1, "price_desc").select(*LIST)


@register("ads_page_meta", f"WITH {ADS_SQL} SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 24.0)) AS BIGINT) AS pages FROM ads WHERE {SHOWN} AND ad_type = 'product'")
def ads_page_meta(spark, d):
    return filters.page_meta(filters.listing(ads(spark, d), ad_type="product"))


@register("ads_suggest", f"WITH {ADS_SQL} SELECT ad_url, title, price_eur, ad_url || '/1.jpg' AS image FROM ads WHERE (is_electronics IS NULL OR is_electronics) AND title ILIKE '%an%' ORDER BY {NEWEST} LIMIT 8")
def ads_suggest(spark, d):
    rows = ads(spark, d).filter(filters.unless_false("is_electronics") & F.col("title").ilike("%an%")).orderBy(*filters.order()).limit(8)
    return rows.select("ad_url", "title", "price_eur", records.first_image(F.array(F.concat("ad_url", F.lit("/1.jpg")))).alias("image"))


@register("ads_batch_ordered", f"WITH {ADS_SQL}, k AS (SELECT ad_url AS u, CAST(row_number() OVER (ORDER BY ad_url DESC) - 1 AS INT) AS pos FROM ads ORDER BY ad_url DESC LIMIT 30) SELECT pos, ad_url, title, price_eur FROM ads JOIN k ON ad_url = u")
def ads_batch_ordered(spark, d):
    rows = ads(spark, d)
    last = rows.select("ad_url").orderBy(F.desc("ad_url")).limit(30).agg(F.sort_array(F.collect_list("ad_url"), False).alias("urls"))
    listed = last.select(records.comma_list(F.concat_ws(",", "urls")).alias("urls"))
    keys = listed.select(F.posexplode("urls").alias("pos", "ad_url"))
    return filters.in_order(rows, keys).select("pos", "ad_url", "title", "price_eur")


@register("ads_stats", f"""WITH {ADS_SQL} SELECT count(*) FILTER (e) AS total, count(*) FILTER (e AND ad_type = 'product') AS products, count(*) FILTER (e AND ad_type = 'service') AS services,
  count(*) FILTER (e AND ad_type = 'wanted') AS wanted, count(*) FILTER (e AND source = 'site_a') AS site_a, count(*) FILTER (e AND source = 'site_b') AS site_b,
  count(*) FILTER (good_price_deal) AS good_deals, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicates
  FROM (SELECT *, is_electronics IS NULL OR is_electronics AS e FROM ads)""")
def ads_stats(spark, d):
    pairs = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")
    return analytics.stats(ads(spark, d), pairs)


@register("pipeline_status", f"""WITH {ADS_SQL}, c AS (SELECT count(*) AS total, count(ad_type) AS classified, count(llm_parsed_at) AS parsed, count(cluster_id) AS clustered, count(posted_date) AS dated,
  count(price_eur) AS priced, count(brand) AS branded, count(*) FILTER (good_price_deal) AS deals, count(DISTINCT cluster_id) AS clusters FROM ads)
  SELECT *, classified * 100 // total AS classified_pct, parsed * 100 // total AS parsed_pct, clustered * 100 // total AS clustered_pct FROM c""")
def pipeline_status(spark, d):
    return analytics.pipeline_status(ads(spark, d))


@register("categories_top", f"WITH {ADS_SQL} SELECT category, count(*) AS count FROM ads WHERE coalesce(category, '') <> '' GROUP BY category ORDER BY count DESC, category LIMIT 40")
def categories_top(spark, d):
    return analytics.categories(ads(spark, d))


def _trimmed_sql(rows: str, key: str, value: str) -> str:
    """Quartile trimming in SQL over ``rows`` (columns key and value), as chained CTEs up to ``st``."""
    return f"""r AS ({rows}), o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM r),
  q AS (SELECT {key}, any_value(n) AS n, max({value}) FILTER (rn = greatest(1, n // 4)) AS q1, max({value}) FILTER (rn = least(n, 3 * n // 4 + 1)) AS q3 FROM o GROUP BY {key}),
  i AS (SELECT r.{key}, {value}, n, q1, q3, {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM r JOIN q USING ({key})),
  s AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY {key})   >= 3 AS enough FROM i),
  u AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS rn, count(*) OVER (PARTITION BY {key}) AS m FROM s WHERE ok OR NOT enough),
  st AS (SELECT {key}, any_value(n) AS n, any_value(q1) AS q1, any_value(q3) AS q3, any_value(m) AS m, sum(CAST({value} AS DECIMAL(20, 6))) AS total, min({value}) AS least, max({value}) AS greatest,
    CAST(max({value}) FILTER (rn = (m + 1) // 2) AS DECIMAL(20, 6)) + CAST(max({value}) FILTER (rn = m // 2 + 1) AS DECIMAL(20, 6)) AS middle FROM u GROUP BY {key})"""


def _rounded(total: str, count: str, digits: int) -> str:
    """A mean rounded half up in whole millionths, as ``analytics.rounded`` does."""
    unit = 10 ** (6 - digits)
    return f"(CAST({total} * 1000000 AS HUGEINT) * 2 + CAST({count} AS HUGEINT) * {unit}) // (CAST({count} AS HUGEINT) * {2 * unit}) / {10**digits}.0::DOUBLE"


NAMED = "coalesce(trim(brand), '') <> ''"
PLAUSIBLE = "CASE WHEN reference_new_price_mkd IS NOT NULL THEN price_vs_new_ratio >= 0.10 ELSE price_eur >= 24.39 END"
LABELS = """l AS (SELECT brand_key, brand FROM (SELECT lower(trim(brand)) AS brand_key, trim(brand) AS brand, row_number() OVER (PARTITION BY lower(trim(brand)) ORDER BY count(*) DESC, min(ad_url)) AS p
  FROM base GROUP BY lower(trim(brand)), trim(brand)) WHERE p = 1)"""


def _brands(where: str) -> str:
    rows = "SELECT lower(trim(brand)) AS brand_key, price_eur FROM base"
    return f"""WITH {ADS_SQL}, base AS (SELECT * FROM ads WHERE ad_type = 'product' AND price_eur > 0 AND {PLAUSIBLE} AND {NAMED} AND {where}), {LABELS}, {_trimmed_sql(rows, 'brand_key', 'price_eur')}
  SELECT brand, n AS count, {_rounded('total', 'm', 2)} AS avg_price, {_rounded('middle', '2', 2)} AS median_price, round(least, 2) AS min_price, round(greatest, 2) AS max_price, round(q1, 2) AS q1, round(q3, 2) AS q3
  FROM st JOIN l USING (brand_key) WHERE n >= 3"""


@register("brand_price_stats", _brands("true"))
def brand_price_stats(spark, d):
    return analytics.brand_prices(ads(spark, d))


@register("brand_price_stats_by_source", _brands("source = 'site_b'"))
def brand_price_stats_by_source(spark, d):
    return analytics.brand_prices(ads(spark, d), "site_b")


@register("brand_label_mode", f"WITH {ADS_SQL}, base AS (SELECT * FROM ads WHERE {NAMED}), {LABELS} SELECT * FROM l")
def brand_label_mode(spark, d):
    return analytics.brand_labels(ads(spark, d))


@register("good_deal_share", f"""WITH {ADS_SQL}, base AS (SELECT * FROM ads WHERE ad_type = 'product' AND price_vs_new_ratio IS NOT NULL AND {NAMED}), {LABELS}
  SELECT brand, total, deals, (deals * 2000 + total) // (total * 2) / 10.0::DOUBLE AS pct FROM (SELECT lower(trim(brand)) AS brand_key, count(*) AS total, count(*) FILTER (good_price_deal) AS deals FROM base GROUP BY 1 HAVING count(*) >= 10) JOIN l USING (brand_key)""")
def good_deal_share(spark, d):
    return analytics.deal_share(ads(spark, d))


@register("monthly_trend_pivot", f"""WITH {ADS_SQL} SELECT strftime(posted_date, '%Y-%m') AS month, count(*) FILTER (source = 'site_a') AS site_a, count(*) FILTER (source = 'site_b') AS site_b, count(*) AS total
  FROM ads WHERE posted_date >= date_trunc('month', DATE '{TODAY}') - INTERVAL 11 MONTH GROUP BY 1""")
def monthly_trend_pivot(spark, d):
    return analytics.monthly(ads(spark, d), TODAY, ("site_a", "site_b"))


@register("depreciation_by_condition", f"""WITH {ADS_SQL}, {_trimmed_sql("SELECT condition, price_vs_new_ratio * 100 AS pct FROM ads WHERE ad_type = 'product' AND price_vs_new_ratio >= 0.10 AND condition <> 'mint'", 'condition', 'pct')}
  SELECT condition, n AS count, {_rounded('total', 'm', 1)} AS avg_pct, {_rounded('middle', '2', 1)} AS median_pct FROM st WHERE n >= 3""")
def depreciation_by_condition(spark, d):
    return analytics.depreciation(ads(spark, d))


@register("source_brand_compare", f"""WITH {ADS_SQL}, c AS (SELECT lower(trim(brand)) AS brand_key, source, count(*) AS n FROM ads WHERE {NAMED} GROUP BY 1, 2),
  a AS (SELECT brand_key, n AS count_one FROM c WHERE source = 'site_a'), b AS (SELECT brand_key, n AS count_other FROM c WHERE source = 'site_b') SELECT brand_key, count_one, count_other FROM a FULL JOIN b USING (brand_key)""")
def source_brand_compare(spark, d):
    return analytics.compare_sources(ads(spark, d), "site_a", "site_b")


@register("type_shares", f"WITH {ADS_SQL} SELECT ad_type, count, (count * 2000 + total) // (total * 2) / 10.0::DOUBLE AS pct FROM (SELECT ad_type, count(*) AS count, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM ads GROUP BY ad_type)")
def type_shares(spark, d):
    return analytics.type_shares(ads(spark, d))


@register("similar_in_cluster", f"""WITH {ADS_SQL}, t AS (SELECT ad_url AS similar_url, cluster_id AS c, row_number() OVER (PARTITION BY cluster_id ORDER BY {NEWEST}) AS place FROM ads WHERE ad_type = 'product' AND cluster_id IS NOT NULL)
  SELECT ad_url, similar_url, CAST(rank AS INT) AS rank FROM (SELECT ad_url, similar_url, row_number() OVER (PARTITION BY ad_url ORDER BY place) AS rank FROM ads JOIN t ON cluster_id = c WHERE place <= 7 AND ad_url <> similar_url) WHERE rank <= 6""")
def similar_in_cluster(spark, d):
    return filters.similar(ads(spark, d))


@register("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 1000")
def keyset_page(spark, d):
    return filters.keyset(table(spark, d, "orders"), "o_orderkey", 1000, 1000).select("o_orderkey", "o_totalprice")


@register("keyset_composite_page", f"WITH {ADS_SQL} SELECT ad_url, posted_date, scraped_at FROM ads WHERE posted_date < DATE '1996-03-01' OR posted_date IS NULL OR (posted_date = DATE '1996-03-01' AND scraped_at = TIMESTAMP '1996-03-01' AND ad_url > '3') ORDER BY posted_date DESC NULLS LAST, scraped_at DESC, ad_url LIMIT 1000")
def keyset_composite_page(spark, d):
    """The page after a cursor in the middle of the rows that share its day and time."""
    day = F.lit("1996-03-01").cast("date")
    return filters.keyset_newest(ads(spark, d), day, F.lit("1996-03-01").cast("timestamp_ntz"), "3", 1000).select("ad_url", "posted_date", "scraped_at")


@register("keyset_null_tail", f"WITH {ADS_SQL} SELECT ad_url, scraped_at FROM ads WHERE posted_date IS NULL AND (scraped_at < TIMESTAMP '1996-03-01' OR (scraped_at = TIMESTAMP '1996-03-01' AND ad_url > '3')) ORDER BY scraped_at DESC, ad_url LIMIT 500")
def keyset_null_tail(spark, d):
    """The page after a cursor among the rows without a day."""
    return filters.keyset_newest(ads(spark, d), None, F.lit("1996-03-01").cast("timestamp_ntz"), "3", 500).select("ad_url", "scraped_at")


@register("offset_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 250")
def offset_page(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(250).limit(100).select("o_orderkey", "o_orderdate")


@register("round_robin_queue", f"WITH {ADS_SQL} SELECT ad_url, source, turn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY {NEWEST}) AS INT) AS turn FROM ads) ORDER BY turn, source LIMIT 200")
def round_robin_queue(spark, d):
    return filters.round_robin(ads(spark, d), 200).select("ad_url", "source", "turn")


@register("work_queue_filters", f"""WITH {ADS_SQL} SELECT count(*) FILTER (llm_parsed_at IS NULL) AS pending, count(*) FILTER (llm_parsed_at IS NOT NULL) AS reparse, count(*) FILTER (condition = 'mint') AS fix_condition,
  count(*) FILTER (llm_parsed_at IS NOT NULL AND is_electronics IS NULL) AS electronics_backlog, count(*) FILTER (llm_parsed_at IS NOT NULL AND brand IS NULL AND ad_type <> 'service') AS null_brand FROM ads""")
def work_queue_filters(spark, d):
    kinds = ("pending", "reparse", "fix_condition", "electronics_backlog", "null_brand")
    return ads(spark, d).agg(*[F.count_if(filters.work_queue(k, analytics.CONDITIONS)).alias(k) for k in kinds])


@register("overpriced_badges", f"WITH {ADS_SQL} SELECT ad_url, CAST(round(price_vs_new_ratio * 100) AS BIGINT) AS pct, NOT good_price_deal AND coalesce(price_vs_new_ratio > 1, false) AS overpriced FROM ads WHERE price_vs_new_ratio IS NOT NULL")
def overpriced_badges(spark, d):
    rows = ads(spark, d).filter("price_vs_new_ratio is not null")
    return rows.select("ad_url", F.round(F.col("price_vs_new_ratio") * 100).cast("long").alias("pct"), filters.overpriced().alias("overpriced"))


@register("insert_if_absent", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def insert_if_absent(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = rows.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return merge.insert_if_absent(rows.filter("o_orderkey % 3 <> 0"), new, "o_orderkey", order="o_custkey")


@register("upsert_partial", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderstatus END AS o_orderstatus
  FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0""")
def upsert_partial(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = rows.filter("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit(None).cast("string"))
    return merge.upsert(rows.filter("o_orderkey % 3 <> 0"), new, "o_orderkey", ["o_orderstatus"])


@register("price_change_history", """SELECT event_id, user_id, value FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT *, floor(value / 20) AS v FROM events WHERE value IS NOT NULL)) WHERE b IS NULL OR b <> v""")
def price_change_history(spark, d):
    rows = table(spark, d, "events").withColumn("v", F.floor(F.col("value") / 20))
    return merge.price_changes(rows, "user_id", "v", "ts", "event_id").select("event_id", "user_id", "value")


@register("known_url_antijoin", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01')")
def known_url_antijoin(spark, d):
    known = table(spark, d, "lineitem").filter("l_shipdate >= '1995-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.unknown(table(spark, d, "orders"), known, "o_orderkey").select("o_orderkey")


@register("null_date_semijoin", f"WITH {ADS_SQL} SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT split_part(ad_url, '-', 1) FROM ads WHERE posted_date IS NULL)")
def null_date_semijoin(spark, d):
    undated = ads(spark, d).filter("posted_date is null").select(F.split_part("ad_url", F.lit("-"), F.lit(1)).cast("long").alias("o_orderkey"))
    return table(spark, d, "orders").join(undated, "o_orderkey", "left_semi").select("o_orderkey", "o_orderdate")


@register("backfill_missing", f"WITH {ADS_SQL} SELECT ad_url, coalesce(brand, CASE WHEN ad_type = 'product' THEN 'found' END) AS brand FROM ads")
def backfill_missing(spark, d):
    rows = ads(spark, d).select("ad_url", "brand", "ad_type")
    found = rows.filter("ad_type = 'product'").select("ad_url", F.lit("found").alias("brand"))
    return merge.fill_missing(rows, found, "ad_url", "brand").select("ad_url", "brand")


@register("listing_with_detail", f"WITH {ADS_SQL} SELECT ad_url, CASE WHEN ad_type = 'wanted' THEN coalesce(category, title) ELSE title END AS title, price_eur FROM ads")
def listing_with_detail(spark, d):
    rows = ads(spark, d)
    detail = rows.filter("ad_type = 'wanted'").select("ad_url", F.col("category").alias("title"))
    return merge.with_detail(rows.select("ad_url", "title", "price_eur"), detail, "ad_url")


@register("consecutive_known_stop", """WITH e AS (SELECT event_type, event_id, value < 60 AS known FROM events), i AS (SELECT *, sum(CASE WHEN known THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY event_id) AS isl FROM e),
  s AS (SELECT *, sum(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, isl ORDER BY event_id) AS streak FROM i), t AS (SELECT event_type, min(event_id) FILTER (streak >= 5) AS stop FROM s GROUP BY event_type)
  SELECT event_type, event_id, known FROM e JOIN t USING (event_type) WHERE stop IS NULL OR event_id <= stop""")
def consecutive_known_stop(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", (F.col("value") < 60).alias("known"))
    return ranges.until_known_run(rows, "event_type", "event_id", "known", 5)


def _wins(order: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey {order}, l_suppkey {order}) AS p FROM lineitem) WHERE p = 1"


@register("dedup_first_wins", _wins("ASC"))
def dedup_first_wins(spark, d):
    return merge.first_wins(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey")


@register("dedup_last_wins", _wins("DESC"))
def dedup_last_wins(spark, d):
    return merge.last_wins(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey")


@register("pair_keep_max", "SELECT l_partkey, l_suppkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def pair_keep_max(spark, d):
    return merge.keep_max(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_extendedprice")


@register("sources_union_difference", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def sources_union_difference(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    both = merge.evolve(orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")), customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("k")))
    return both.distinct().join(customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k")), "k", "left_anti")


@register("zscore_anomaly", """WITH g AS (SELECT p_type, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice - m) / s, 3) + 0.0 AS z, abs((l_extendedprice - m) / s) >= 2.5 AS is_anomaly
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN g USING (p_type) WHERE n >= 5 AND s > 0""")
def zscore_anomaly(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return analytics.z_scores(rows, "p_type", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "z", "is_anomaly")


COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@register("knn_topk", f"""WITH s AS (SELECT a.vec_id, round({COSINE}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id <> 0),
  t AS (SELECT * FROM s ORDER BY similarity DESC, vec_id LIMIT 10) SELECT vec_id, similarity, CAST(row_number() OVER (ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM t""")
def knn_topk(spark, d):
    rows = table(spark, d, "embeddings")
    return similarity.nearest(rows, rows.filter("vec_id = 0"), 10)


@register("knn_topk_all", f"""WITH s AS (SELECT b.vec_id AS query, a.vec_id, round({COSINE}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM s) WHERE rank <= 10""")
def knn_topk_all(spark, d):
    rows = table(spark, d, "embeddings")
    return similarity.nearest_each(rows, rows.filter("vec_id % 20 = 0"), 10)


@register("knn_top1_dup", f"""WITH s AS (SELECT a.vec_id, b.vec_id AS other, round(1 - {COSINE}, 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id)
  SELECT vec_id, other AS duplicate_of, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) AS p FROM s WHERE distance <= 0.6) WHERE p = 1""")
def knn_top1_dup(spark, d):
    return similarity.nearest_in_block(table(spark, d, "embeddings"), "label", 0.6)


@register("knn_top1_dup_all", f"""WITH s AS (SELECT a.vec_id, b.vec_id AS other, round(1 - {COSINE}, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id)
  SELECT vec_id, other AS duplicate_of, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) AS p FROM s WHERE distance <= 0.6) WHERE p = 1""")
def knn_top1_dup_all(spark, d):
    return similarity.nearest_earlier(table(spark, d, "embeddings"), 0.6)


@register("reference_price", f"""WITH {ADS_SQL}, rows AS (SELECT *, lower(trim(brand)) AS bk, lower(trim(model)) AS mk FROM ads WHERE ad_type = 'product' AND brand IS NOT NULL AND price_mkd IS NOT NULL),
  rt AS (SELECT lower(trim(p_brand)) AS bk, lower(trim(p_name)) AS mk, min(p_retailprice) * 61.5 AS rp, CAST(count(*) AS INT) AS rn FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2),
  mp AS (SELECT bk, mk, median(price_mkd) AS mp, CAST(count(*) AS INT) AS mn FROM rows WHERE condition = 'New' AND price_mkd >= 1500 GROUP BY 1, 2 HAVING count(*) >= 2),
  j AS (SELECT rows.*, CASE WHEN price_mkd > 0 THEN CASE WHEN rp IS NOT NULL THEN 'retail' WHEN mp IS NOT NULL AND condition <> 'New' THEN 'marketplace' END END AS src, rp, rn, mp, mn FROM rows LEFT JOIN rt USING (bk, mk) LEFT JOIN mp USING (bk, mk)),
  k AS (SELECT *, CASE src WHEN 'retail' THEN rp WHEN 'marketplace' THEN mp END AS ref, CASE src WHEN 'retail' THEN rn WHEN 'marketplace' THEN mn END AS cnt FROM j)
  SELECT ad_url, CAST(round(CAST(ref AS DECIMAL(20, 6)), 2) AS DOUBLE) AS reference_new_price_mkd, cnt AS reference_sample_size, src AS reference_source, round(price_mkd / ref, 4) AS price_vs_new_ratio,
    coalesce(round(price_mkd / ref, 4) >= 0.10 AND round(price_mkd / ref, 4) <= CASE condition WHEN 'New' THEN 0.95 WHEN 'Used - Like New' THEN 0.80 WHEN 'Used - Good' THEN 0.68 WHEN 'Used - Fair' THEN 0.55 WHEN 'For parts' THEN 0.35 ELSE 0.65 END, false) AS good_price_deal FROM k""")
def reference_price(spark, d):
    retail = table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("title"), (F.col("p_retailprice") * 61.5).alias("price_mkd"))
    return pricing.reference_prices(ads(spark, d), retail)


@register("reference_price_all", oracle_sql()["reference_price"].replace(" WHERE p_partkey % 3 = 0", ""))
def reference_price_all(spark, d):
    """Reference prices with all parts as the retail catalogue."""
    retail = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("title"), (F.col("p_retailprice") * 61.5).alias("price_mkd"))
    return pricing.reference_prices(ads(spark, d), retail)


@register("price_correction", f"""WITH {ADS_SQL}, s AS (SELECT ad_url, price_mkd AS p, CASE WHEN cluster_id % 2 = 0 THEN floor(reference_new_price_mkd) * 61.5 ELSE floor(reference_new_price_mkd) * 30 END AS said FROM ads)
  SELECT ad_url, CASE WHEN said IS NULL OR said <= 0 THEN p WHEN p IS NULL OR p / said < 0.5 OR p / said > 2.0 THEN said ELSE p END AS price_mkd FROM s""")
def price_correction(spark, d):
    even = F.col("cluster_id") % 2 == 0
    stated = F.floor("reference_new_price_mkd").cast("double") * F.when(even, 1).otherwise(30)
    return ads(spark, d).select("ad_url", prices.corrected(F.col("price_mkd"), stated, F.when(even, "EUR").otherwise("MKD")).alias("price_mkd"))


@register("parse_price", """SELECT o_orderkey, CAST(v AS VARCHAR) AS price_amount, CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'MKD' END AS currency,
  CASE o_orderkey % 3 WHEN 0 THEN round(CAST(v AS DOUBLE), 2) WHEN 1 THEN round(v / 61.5, 2) END AS price_eur, CASE o_orderkey % 3 WHEN 0 THEN round(v * CAST(61.5 AS DOUBLE), 2) WHEN 1 THEN round(CAST(v AS DOUBLE), 2) END AS price_mkd,
  CASE WHEN v IS NULL THEN 'call' END AS price_note FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS v, o_orderkey % 5 = 0 AS bad FROM orders) WHERE NOT bad
  UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, 'call' FROM orders WHERE o_orderkey % 5 = 0""")
def parse_price(spark, d):
    whole = F.format_number(F.floor("o_totalprice"), 0)
    shown = F.concat(F.replace(whole, F.lit(","), F.lit(".")), F.when(F.col("o_orderkey") % 3 == 0, " €").when(F.col("o_orderkey") % 3 == 1, " ден").otherwise(" USD"))
    raw = F.when(F.col("o_orderkey") % 5 == 0, "call").otherwise(shown)
    return table(spark, d, "orders").select("o_orderkey", prices.parse_price(raw).alias("p")).select("o_orderkey", "p.*")


@register("posted_date_resolve", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) - 1 WHEN 2 THEN make_date(CASE WHEN month(o_orderdate) < 8 OR (month(o_orderdate) = 8 AND day(o_orderdate) < 1) THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END, 8, 1) ELSE DATE '2015-05-12' END AS posted FROM orders""")
def posted_date_resolve(spark, d):
    kind = F.col("o_orderkey") % 4
    raw = F.when(kind == 0, "Денес 10:30").when(kind == 1, "Вчера 09:05").when(kind == 2, "01 авг. 10:30").otherwise("мај 12 2015 02:22")
    return table(spark, d, "orders").select("o_orderkey", prices.posted_date(raw, F.col("o_orderdate")).alias("posted"))


@register("clean_text", r"""SELECT doc_id, trim(regexp_replace(text, '[\s]+', ' ', 'g')) AS title, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS description_md5 FROM documents""")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_title(F.col("text")).alias("title"), F.md5(text.clean_description(F.col("text")).cast("binary")).alias("description_md5"))


@register("model_numbers", r"""SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(t), '\d+(gb|tb|mb)', ' ', 'g'), '\b[a-z]{0,2}\d+[a-z]{0,2}\b'))), ',') AS numbers FROM (SELECT p_partkey, p_brand || ' A' || p_size || ' 128GB ' || p_type AS t FROM part)""")
def model_numbers(spark, d):
    title = F.concat("p_brand", F.lit(" A"), "p_size", F.lit(" 128GB "), "p_type")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.model_numbers(title), ",").alias("numbers"))


@register("title_gate", """SELECT a.s_suppkey AS a, b.s_suppkey AS b, lower(trim(a.s_name)) = lower(trim(b.s_name)) OR starts_with(lower(trim(a.s_name)), lower(trim(b.s_name))) OR starts_with(lower(trim(b.s_name)), lower(trim(a.s_name))) AS same_seller,
  least(length(a.s_name), length(b.s_name)) / greatest(length(a.s_name), length(b.s_name)) >= 0.95 AS alike FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def title_gate(spark, d):
    """Every two suppliers of a nation through the gate; a nation's pairs are dealt out over the tasks, and names are cleaned once a supplier."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", text.seller_name(F.col("s_name")).alias("name"), F.length("s_name").alias("n"))
    side = 16
    mine, cells = F.pmod(F.xxhash64("s_suppkey"), F.lit(side)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    left = rows.withColumn("row", mine).withColumn("column", cells)
    right = rows.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("nation"), F.col("name").alias("name_b"), F.col("n").alias("n_b"), mine.alias("column_b")).withColumn("row_b", cells)
    same = (F.col("s_nationkey") == F.col("nation")) & (F.col("row") == F.col("row_b")) & (F.col("column") == F.col("column_b")) & (F.col("s_suppkey") < F.col("b"))
    # Numbers given, so that few suppliers, who make many pairs, aren't put back into few tasks.
    left, right = left.repartition(side * side, "s_nationkey", "row", "column"), right.repartition(side * side, "nation", "row_b", "column_b")
    pairs = left.join(right.hint("shuffle_hash"), same)
    alike = F.least("n", "n_b") / F.greatest("n", "n_b") >= 0.95
    return pairs.select(F.col("s_suppkey").alias("a"), "b", text.names_match(F.col("name"), F.col("name_b")).alias("same_seller"), alike.alias("alike"))


def _word(p: str) -> str:
    return f"regexp_matches(t, '(^|[^a-z0-9_]){p}([^a-z0-9_]|$)')"


@register("classify_text", f"""WITH d AS (SELECT doc_id, regexp_replace(lower(trim(text)), '[^\\x00-\\x7F]', 'q', 'g') AS t FROM documents)
  SELECT doc_id, CASE WHEN regexp_matches(t, '^(the|in)([^a-z0-9_]|$)') THEN 'wanted' WHEN CAST({_word('and')} AS INT) + CAST({_word('from')} AS INT) + CAST({_word('was')} AS INT) >= 2 THEN 'service' ELSE 'product' END AS ad_type FROM d""")
def classify_text(spark, d):
    bare = F.regexp_replace("text", r"[^\x00-\x7F]", "q")
    kind = classify.ad_type(bare, bare, starts=("the", "in"), wanted=("@@",), strong=("@@",), service=("and", "from", "was"))
    return table(spark, d, "documents").select("doc_id", kind.alias("ad_type"))


@register("json_specs_map", "SELECT event_id, to_json(props) IS NOT NULL AS ok, len(json_keys(props)) AS n FROM events")
def json_specs_map(spark, d):
    found = records.fields_of(F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", "")))
    return table(spark, d, "events").select("event_id", F.lit(True).alias("ok"), F.size(F.map_keys(found["fields"])).cast("long").alias("n"))


@register("chat_validate", "SELECT conv_id, count(*) AS messages, max(length(text)) AS longest, count(*) BETWEEN 1 AND 20 AND max(length(text)) <= 500 AS valid FROM conversations GROUP BY conv_id")
def chat_validate(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max(F.length("text")).cast("long").alias("longest"))
    return rows.withColumn("valid", F.col("messages").between(1, 20) & (F.col("longest") <= 500))


@register("chat_prompt", f"WITH {ADS_SQL} SELECT ad_url, concat_ws(chr(10), 'Title: ' || nullif(title, ''), 'Brand: ' || nullif(brand, ''), 'Category: ' || nullif(category, ''), 'Condition: ' || condition) AS prompt FROM ads")
def chat_prompt(spark, d):
    facts = [(k, F.col(c)) for k, c in (("Title", "title"), ("Brand", "brand"), ("Category", "category"), ("Condition", "condition"))]
    return ads(spark, d).select("ad_url", records.prompt(*facts).alias("prompt"))


@register("page_url_param", r"SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, CASE WHEN regexp_matches(url, '[?&]page=\d*') THEN regexp_replace(url, '([?&])page=\d*', '\1page=7') ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=7' END AS next_url, CASE WHEN contains(url, 'blog.') THEN 'blog.' WHEN contains(url, 'www.') THEN 'www.' END AS site FROM pages")
def page_url_param(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", text.url_param(url, "page").alias("page"), text.with_page(url, "page", F.lit(7)).alias("next_url"), text.infer_source(F.lit(None).cast("string"), url, ("blog.", "www.")).alias("site")
    )
