"""Listing filters, orders, pages and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 24


def unless_false(name: str) -> Column:
    """A tri-state flag: unknown passes."""
    return F.col(name).isNull() | F.col(name)


def listing(
    ads: DataFrame, *, source: str | None = None, category: str | None = None, condition: str | None = None, ad_type: str | None = None,
    min_price: float | None = None, max_price: float | None = None, q: str | None = None, good_deal_only: bool = False,
) -> DataFrame:
    """Listings for the list page.  Empty strings mean no filter; a price bound of 0 is a bound; % and _ in q are wildcards."""
    out = ads.filter(unless_false("is_electronics") & unless_false("is_active"))
    for name, value in (("source", source), ("category", category), ("condition", condition), ("ad_type", ad_type)):
        if value:
            out = out.filter(F.col(name) == value)
    if min_price is not None:
        out = out.filter(F.col("price_eur") >= min_price)
    if max_price is not None:
        out = out.filter(F.col("price_eur") <= max_price)
    if q:
        out = out.filter(F.col("title").ilike(f"%{q}%"))
    return out.filter("good_price_deal") if good_deal_only else out


def order(sort: str = "newest") -> list[Column]:
    """Nulls are last either way; any other name means newest; the key breaks ties."""
    key = F.col("ad_url").asc()
    if sort == "price_asc":
        return [F.col("price_eur").asc_nulls_last(), key]
    if sort == "price_desc":
        return [F.col("price_eur").desc_nulls_last(), key]
    return [F.col("posted_date").desc_nulls_last(), F.col("scraped_at").desc_nulls_first(), key]


def page(ads: DataFrame, number: int = 1, sort: str = "newest", size: int = PAGE) -> DataFrame:
    return ads.orderBy(*order(sort)).offset((number - 1) * size).limit(size)


def page_meta(ads: DataFrame, size: int = PAGE) -> DataFrame:
    return ads.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def page_numbers(number: int, pages: int) -> list[int]:
    return list(range(max(1, number - 2), min(pages, number + 2) + 1))


def keyset(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The page of rows that follow a key."""
    return rows.filter(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def keyset_newest(rows: DataFrame, posted, scraped, last, size: int, day: str = "posted_date", time: str = "scraped_at", key: str = "ad_url") -> DataFrame:
    """The page after (day, time, key), newest first, keys rising among equal ones; the rows without a day follow the others.

    The key makes the order total, so no row tied with the page's last one is lost.
    """
    d, t, k = F.col(day), F.col(time), F.col(key)
    after = (t < F.lit(scraped)) | ((t == F.lit(scraped)) & (k > F.lit(last)))
    later = d.isNull() & after if posted is None else (d < F.lit(posted)) | ((d == F.lit(posted)) & after) | d.isNull()
    return rows.filter(later).orderBy(d.desc_nulls_last(), t.desc(), k).limit(size)


def in_order(ads: DataFrame, keys: DataFrame, key: str = "ad_url") -> DataFrame:
    """The rows of a list of keys (``pos, key``), in the list's order; keys without a row go."""
    return ads.join(keys, key).orderBy("pos")


def similar(ads: DataFrame, limit: int = 6, cluster: str = "cluster_id") -> DataFrame:
    """For every listing the newest products of its cluster but itself; ``rank`` from 1.

    Only a cluster's newest ``limit + 1`` can be anyone's, so those go to each listing as one list, out of which its own six are taken in the row.
    Rows that share an ``ad_url`` are one listing with all their lists.
    """
    products = ads.filter((F.col("ad_type") == "product") & F.col(cluster).isNotNull())
    w = Window.partitionBy(cluster).orderBy(*order())
    top = products.select(cluster, "ad_url", F.row_number().over(w).alias("place"), "posted_date", "scraped_at").filter(F.col("place") <= limit + 1)
    lists = top.groupBy(F.col(cluster).alias("of")).agg(F.collect_list(F.struct("place", "ad_url")).alias("list"))
    each = ads.filter(F.col(cluster).isNotNull()).groupBy("ad_url").agg(F.collect_list(cluster).alias("of_"))
    # One cluster each, but for rows that share an ad_url.
    one = each.filter(F.size("of_") == 1).select("ad_url", F.col("of_")[0].alias("of")).join(lists, "of").select("ad_url", "list")
    several = each.filter(F.size("of_") > 1).select("ad_url", F.explode("of_").alias("of")).join(lists, "of").groupBy("ad_url").agg(F.flatten(F.collect_list("list")).alias("list"))
    others = F.filter(F.sort_array("list"), lambda x: x["ad_url"] != F.col("ad_url"))
    found = one.unionByName(several).select("ad_url", F.posexplode(F.slice(others, 1, limit)))
    return found.select("ad_url", F.col("col.ad_url").alias("similar_url"), (F.col("pos") + 1).alias("rank"))


def work_queue(kind: str, canonical: tuple[str, ...] = ()) -> Column:
    """The predicate of one of the queues of listings to be worked on; they exclude each other by design."""
    parsed, electronics = F.col("llm_parsed_at"), F.col("is_electronics")
    return {
        "pending": parsed.isNull(),
        "reparse": parsed.isNotNull(),
        "fix_condition": F.col("condition").isNotNull() & ~F.col("condition").isin(*canonical),
        "electronics_backlog": parsed.isNotNull() & electronics.isNull(),
        "null_brand": parsed.isNotNull() & F.col("brand").isNull() & F.coalesce(F.col("ad_type") != "service", F.lit(False)),
    }[kind]


def round_robin(ads: DataFrame, limit: int, by: str = "source") -> DataFrame:
    """Rows of each source in turn, newest first; a source that runs out leaves its turns to the others."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order()))
    return ads.withColumn("turn", place).filter(F.col("turn") <= limit).orderBy("turn", by).limit(limit)


# The price ranges that the list offers, in EUR.
PRICE_PRESETS = ((None, 50), (50, 200), (200, 500), (500, 1000), (1000, None))


def price_preset(price: str = "price_eur", presets: tuple = PRICE_PRESETS) -> Column:
    """The number, from 1, of the first price range that has the price, bounds included; null without a price."""
    found = F.lit(None).cast("int")
    for n, (low, high) in reversed(list(enumerate(presets, 1))):
        inside = F.lit(True) if low is None else F.col(price) >= low
        found = F.when(inside if high is None else inside & (F.col(price) <= high), n).otherwise(found)
    return F.when(F.col(price).isNotNull(), found)


def of_brands(rows: DataFrame, brands: list[str], column: str = "brand") -> DataFrame:
    """The rows of some brands; of none, all."""
    return rows.filter(F.col(column).isin(*brands)) if brands else rows


def top(rows: DataFrame, by: str, limit: int, name: str = "brand") -> DataFrame:
    """The first rows of a chart, by a column falling, names rising among equal ones."""
    return rows.orderBy(F.desc_nulls_last(by), name).limit(limit)


def originals(rows: DataFrame, *, anomalies_only: bool = False, category: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """Listings that duplicate no other one, by category and price, or only those with an odd price."""
    out = rows.filter(~F.col("is_duplicate"))
    out = out.filter("is_anomaly") if anomalies_only else out
    out = out.filter(F.col("category") == category) if category else out
    out = out.filter(F.col("price_eur") >= least) if least is not None else out
    return out.filter(F.col("price_eur") <= most) if most is not None else out


def recent(log: DataFrame, limit: int, time: str = "created_at", key: str = "event_id") -> DataFrame:
    """The newest entries of an activity log."""
    return log.orderBy(F.desc(time), F.desc(key)).limit(limit)


def overpriced(ratio: str = "price_vs_new_ratio", deal: str = "good_price_deal") -> Column:
    return F.coalesce(~F.col(deal) & (F.col(ratio) > 1), F.lit(False))
