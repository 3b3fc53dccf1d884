"""Queries of field functions, sources and sinks, over rows made of the parts so that every branch comes up."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import prices, records, text
from ..operators import merge, pricing, ranges
from ..sources import listings as sources
from ..sources import keyed, stored
from .catalog import register
from .fixture import table
from .models import _folder

def _key():
    return F.col("p_partkey")


def _one_of(*values: str | None):
    """One of the values by the part's key."""
    return F.get(F.array(*[F.lit(v) for v in values]), (_key() % len(values)).cast("int"))


def _case(values: tuple[str | None, ...]) -> str:
    return f"(CASE p_partkey % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END)"


KINDS = {"Се продава": "sale", "SELL now": "sale", "Купувам": "buy", "want to buy": "buy", "Се разменува": "trade", "Trade in": "trade", "Друго": "Друго", None: None}
SELLERS = {"Приватен": "private", "Private person": "private", "Компанија": "company", "my COMPANY": "company", "shop": "shop"}


@register("listing_labels", f"""SELECT p_partkey, {_case(tuple(KINDS.values()))} AS kind, {_case(tuple(SELLERS.values()))} AS seller,
  CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey AS INT) END AS page, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey AS INT) + 5 END AS pages,
  CASE p_partkey % 3 WHEN 0 THEN 'https://cdn.example/' || p_partkey || '.jpg' WHEN 1 THEN 'http://a.example/b.png' END AS image,
  CASE WHEN p_partkey % 10 <= 1 THEN 'today' WHEN p_partkey % 10 = 2 THEN 'yesterday' WHEN p_partkey % 10 <= 7 THEN (p_partkey % 10 - 1) || ' days ago' ELSE CAST(DATE '2024-03-10' - CAST(p_partkey % 10 - 1 AS INT) AS VARCHAR) END AS age FROM part""")
def listing_labels(spark, d):
    """Kinds of listing and seller, page numbers, addresses in style sheets, and how long ago a day is."""
    css = F.when(_key() % 3 == 0, F.concat(F.lit("background: url('//cdn.example/"), _key().cast("string"), F.lit(".jpg?w=1')"))).when(_key() % 3 == 1, "url(http://a.example/b.png)").otherwise("none")
    page = text.page_of(F.when(_key() % 4 != 0, F.concat(F.lit("Страна "), _key().cast("string"), F.lit(" од "), (_key() + 5).cast("string"))).otherwise("one page"))
    today = F.lit("2024-03-10").cast("date")
    return table(spark, d, "part").select(
        "p_partkey", text.listing_type(_one_of(*KINDS)).alias("kind"), text.seller_type(_one_of(*SELLERS)).alias("seller"), page["page"].alias("page"), page["pages"].alias("pages"),
        text.css_url(css).alias("image"), prices.age_label(F.date_sub(today, (_key() % 10 - 1).cast("int")), today).alias("age"),
    )


@register("truncated_texts", r"""WITH h AS (SELECT doc_id, text, left(text, 600) AS head, length(regexp_extract(left(text, 600), '^(.*) [^ ]*$', 1, 's')) AS kept FROM documents)
  SELECT doc_id, CASE WHEN length(text) <= 600 THEN text WHEN contains(head, ' ') AND kept > 360 THEN left(head, kept) || '…' ELSE head || '…' END AS text FROM h""")
def truncated_texts(spark, d):
    """Every document cut at the last blank of its first 600 characters."""
    return table(spark, d, "documents").select("doc_id", text.truncate_words(F.col("text")).alias("text"))


@register("listing_texts", """SELECT p_partkey, p_name || chr(10) || 'Other' AS description, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS notes, p_name || '. ' || CASE WHEN p_partkey % 3 <> 0 THEN p_type ELSE '' END AS embedded,
  p_brand AS brand, p_name AS type, 2 AS n_specs, 'a' || chr(10) || p_type AS nodes, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS first FROM part""")
def listing_texts(spark, d):
    """Descriptions without lines of specs, notes that say something new, embedding inputs, specs from labels and values, joined text nodes, values by label."""
    type_ = F.col("p_type")
    specs = F.create_map(F.lit("type"), type_, F.lit("size"), F.concat(F.lit("size "), F.col("p_size").cast("string")))
    description = F.concat_ws("\n", "p_name", F.concat(F.lit(" "), F.upper(type_), F.lit(" ")), F.lit("Other"))
    labels = F.array(*[F.lit(x) for x in ("Brand:", " Type : ", "Empty", "Type", "same", "")])
    named = records.labelled(labels, F.array("p_brand", type_, F.lit(" "), "p_name", F.lit("Same"), F.lit("x")))
    values = F.create_map(F.lit("x"), F.lit(" "), F.lit("y"), F.when(_key() % 2 == 0, F.col("p_name")).otherwise(F.lit(None)), F.lit("w"), type_)
    return table(spark, d, "part").select(
        "p_partkey", records.without_spec_lines(description, specs).alias("description"), records.shown_notes(F.when(_key() % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit(" "), F.upper(type_))), type_).alias("notes"),
        records.embedding_input(F.col("p_name"), F.when(_key() % 3 != 0, type_)).alias("embedded"), named["brand"].alias("brand"), named["type"].alias("type"), F.size(named).alias("n_specs"),
        records.joined_nodes(F.array(F.lit(" a "), F.lit(""), type_, F.lit(" "))).alias("nodes"), records.first_of(values, "x", "z", "y", "w").alias("first"),
    )


@register("reference_matches", """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 4 <> 1 THEN floor(p_retailprice) * 2 END AS reference, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 4 <> 1 THEN 1 END AS n FROM part""")
def reference_matches(spark, d):
    """Models in catalogue titles that name more than them: a network generation that the title lacks, storage after it, a variant that is another model; and listings of several variants."""
    several = _key() % 5 == 0
    number = _key().cast("string")
    brand = F.concat(F.lit("Acme"), (_key() % 200).cast("string"))
    model = F.when(several, F.concat(F.lit("galaxy "), (_key() % 90 + 10).cast("string"))).otherwise(F.concat(F.lit("Galaxy a"), number, F.lit(" 5G")))
    title = F.when(several, F.concat(model, F.lit(", "), (_key() % 90 + 10).cast("string"), F.lit(" Pro i "), (_key() % 90 + 10).cast("string"), F.lit(" Pro Max"))).otherwise(model)
    parts = table(spark, d, "part")
    ads = parts.select(_key().cast("string").alias("ad_url"), F.lit("product").alias("ad_type"), brand.alias("brand"), model.alias("model"), title.alias("title"), F.lit("Used").alias("condition"), F.floor("p_retailprice").cast("double").alias("price_mkd"))
    price = F.floor("p_retailprice").cast("double")
    exact = parts.filter(_key() % 4 != 1).select(F.upper(brand).alias("brand"), F.concat(brand, F.lit(" galaxy a"), number, F.lit(" 128GB black")).alias("title"), (price * 2).alias("price_mkd"))
    other = parts.select(brand.alias("brand"), F.concat(F.lit("galaxy a"), number, F.lit(" ultra 256gb")).alias("title"), (price / 2).alias("price_mkd"))
    longer = parts.select(brand.alias("brand"), F.concat(F.lit("galaxy a"), number, F.lit("c 64gb")).alias("title"), (price / 3).alias("price_mkd"))
    found = pricing.reference_prices(ads, exact.union(other).union(longer))
    return found.select(F.col("ad_url").cast("long").alias("p_partkey"), F.col("reference_new_price_mkd").alias("reference"), F.col("reference_sample_size").alias("n"))


@register("json_lines_again", "SELECT p_partkey, p_name, p_retailprice FROM part")
def json_lines_again(spark, d):
    """The parts written as JSON lines and read back, from among blank and cut-off lines."""
    folder = _folder(spark)
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    sources.write_json_lines(rows, folder)
    rows.select(F.when(_key() % 2 == 0, "").otherwise(F.concat(F.lit('{"p_partkey": '), _key().cast("string"), F.lit(', "p_na')))).write.mode("append").text(folder)
    return sources.read_json_lines(spark, folder, rows.schema)


@register("retail_catalogue", "SELECT 'https://shop.example/' || p_partkey AS url, 'shop' AS source, split_part(p_brand, ' ', 1) AS brand, p_brand || ' ' || p_name AS title, p_retailprice AS price_mkd, p_retailprice + 100 AS original_price_mkd FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0")
def retail_catalogue(spark, d):
    """The parts as pages of a catalogue's nested JSON, some without a price or a handle."""
    price = F.when(_key() % 3 != 0, F.struct(F.col("p_retailprice").alias("calculated_amount"), (F.col("p_retailprice") + 100).alias("original_amount")))
    product = F.struct(F.when(_key() % 7 != 0, _key().cast("string")).alias("handle"), F.concat_ws(" ", "p_brand", "p_name").alias("title"), F.array(F.struct(price.alias("calculated_price"))).alias("variants"))
    pages = table(spark, d, "part").groupBy((_key() % 50).alias("page")).agg(F.to_json(F.struct(F.collect_list(product).alias("products"))).alias("body"))
    return sources.read_retail(pages, "shop", "https://shop.example/")


@register("evolved_rows", "SELECT p_partkey AS k, p_name AS name, p_size AS size, NULL::VARCHAR AS segment FROM part UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def evolved_rows(spark, d):
    """Rows of two schemas in one: each lacks a column of the other's."""
    parts = table(spark, d, "part").select(_key().alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return merge.evolve(parts, table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))


@register("repriced_rows", """WITH s AS (SELECT l_partkey AS k, arg_max(l_extendedprice, (l_shipdate, l_extendedprice)) AS price FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1)
  SELECT p_partkey AS k, coalesce(s.price, p_retailprice) AS price FROM part LEFT JOIN s ON k = p_partkey""")
def repriced_rows(spark, d):
    """The parts with the price of their last scrape, where one was seen."""
    scraped = table(spark, d, "lineitem").filter("l_partkey % 2 = 0").select(F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("at"))
    return merge.repriced(table(spark, d, "part").select(_key().alias("k"), F.col("p_retailprice").alias("price")), scraped, "k", "price", "at")


@register("replaced_partitions", "SELECT p_partkey, CASE WHEN p_size % 10 IN (3, 7) THEN upper(p_name) ELSE p_name END AS p_name, CAST(p_size % 10 AS INT) AS band FROM part WHERE p_size % 10 <> 5")
def replaced_partitions(spark, d):
    """A stored table of ten partitions of which two are written anew and one is deleted before it would be."""
    path = f"{_folder(spark)}/stored"
    rows = table(spark, d, "part").select("p_partkey", "p_name", (F.col("p_size") % 10).cast("int").alias("band"))
    stored.replace_partitions(rows, path, "band")
    fresh = spark.read.schema(rows.schema).parquet(path).filter("band in (3, 7)").withColumn("p_name", F.upper("p_name"))
    stored.replace_partitions(fresh, path, "band", gone=[5])
    return spark.read.schema(rows.schema).parquet(path)


@register("keyed_upserts", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE 0.0 END AS price FROM part WHERE p_partkey >= 10 AND p_partkey % 3 <> 1")
def keyed_upserts(spark, d):
    """The parts upserted into a keyed table in batches, half of them again with a price, and read back page by page from a key on."""
    keyed.register(spark)
    path = f"{_local(spark)}/{uuid.uuid4().hex}.db"
    keyed.create(path, "parts", "p_partkey INTEGER PRIMARY KEY, p_name TEXT NOT NULL, price REAL")
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))
    for some in (rows.withColumn("price", F.lit(0.0)), rows.filter("p_partkey % 2 = 0")):
        some.repartition(4, "p_partkey").write.format("keyed_table").options(path=path, table="parts", key="p_partkey", page=200).mode("append").save()
    found = spark.read.format("keyed_table").options(path=path, table="parts", key="p_partkey", page=300).load()
    return found.filter((F.col("p_partkey") >= 10) & (F.col("p_partkey") % 3 != 1))


def _local(spark) -> str:
    """The shared folder, which must be a mounted one here: a database is a file that tasks open."""
    folder = ranges.shared_folder(spark)
    if not folder.startswith(("file:", "/")):
        raise ValueError("a keyed table needs a shared folder that is mounted")
    path = folder.removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path
