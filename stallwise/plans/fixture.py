"""The driver's tables seen as listings, once as a DataFrame and once as SQL from the same column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cut, not rounded: both engines cut doubles alike, but round ties differently.
PRICE = "(floor(l_extendedprice / l_quantity * 100) / 100)"
RATIO = f"(floor({PRICE} / p_retailprice * 10000) / 10000)"
CONDITION = (
    "case when l_discount < 0.015 then 'New' when l_discount < 0.035 then 'Used - Like New' when l_discount < 0.055 then 'Used - Good' "
    "when l_discount < 0.075 then 'Used - Fair' when l_discount < 0.085 then 'Used' when l_discount < 0.095 then 'For parts' else 'mint' end"
)
CAP = (
    "case when l_discount < 0.015 then 0.95 when l_discount < 0.035 then 0.80 when l_discount < 0.055 then 0.68 when l_discount < 0.075 then 0.55 "
    "when l_discount < 0.085 then 0.65 when l_discount < 0.095 then 0.35 else 0.65 end"
)
#: Nulls are put in by key, so that both engines have the same ones.
COLUMNS = {
    "ad_url": "concat_ws('-', cast(l_orderkey as varchar(20)), cast(l_linenumber as varchar(20)), cast(l_partkey as varchar(20)), cast(l_suppkey as varchar(20)))",
    "title": "p_name",
    "description": "concat(p_type, ' ', p_brand)",
    "source": "case when l_linestatus = 'O' then 'site_a' else 'site_b' end",
    "category": "case when l_partkey % 17 = 0 then null when l_partkey % 19 = 0 then '' else p_type end",
    "brand": "case when l_partkey % 13 = 0 then null when l_partkey % 11 = 0 then lower(p_brand) when l_partkey % 7 = 0 then concat(p_brand, ' ') else p_brand end",
    "model": "p_name",
    "condition": CONDITION,
    "ad_type": "case when l_returnflag = 'N' then 'product' when l_returnflag = 'R' then 'service' else 'wanted' end",
    "price_eur": f"case when l_orderkey % 7 = 0 then null else {PRICE} end",
    "price_mkd": f"case when l_orderkey % 7 = 0 then null else floor({PRICE} * 6150) / 100 end",
    "reference_new_price_mkd": "case when l_partkey % 5 = 0 then null else p_retailprice end",
    "price_vs_new_ratio": f"case when l_partkey % 5 = 0 or l_orderkey % 7 = 0 then null else {RATIO} end",
    "good_price_deal": f"case when l_partkey % 5 = 0 or l_orderkey % 7 = 0 then false else {RATIO} >= 0.10 and {RATIO} <= {CAP} end",
    "is_electronics": "case when l_tax < 0.005 then null when l_tax < 0.065 then true else false end",
    "is_active": "case when l_suppkey % 5 = 0 then null when l_suppkey % 5 = 1 then false else true end",
    "posted_date": "case when l_orderkey % 19 = 0 then null else cast(l_shipdate as date) end",
    "scraped_at": "l_shipdate",
    "llm_parsed_at": "case when l_linenumber % 3 = 0 then null else l_shipdate end",
    "seller_name": "s_name",
    "cluster_id": "case when p_size % 9 = 0 then null else p_size end",
}

ADS_SQL = (
    "ads AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items())
    + " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as listings.  Whether a side is broadcast is left to the optimizer, by its size."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()])
