"""Aggregates over listings.  Sums are taken in decimals, so no digit depends on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import unless_false

LEAST_PRICE_EUR = 24.39
# The conditions from new to worn, in the order that charts show them.
CONDITIONS = ("New", "Used - Like New", "Used - Good", "Used - Fair", "Used", "For parts")


def rounded(total: Column, count: Column, digits: int) -> Column:
    """The mean ``total / count`` of a sum that isn't negative, rounded half up at ``digits`` places exactly, in whole millionths."""
    unit = 10 ** (6 - digits)
    doubled, by = F.floor(total.cast("decimal(38,6)") * 1_000_000).cast("decimal(38,0)") * 2, count.cast("decimal(20,0)") * unit
    return F.call_function("div", doubled + by, by * 2) / F.lit(float(10**digits))


def percent(part: Column, whole: Column) -> Column:
    """How many percent, rounded half up at one place exactly."""
    return F.call_function("div", part * 2000 + whole, whole * 2) / F.lit(10.0)


def stats(ads: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The dashboard's counts in one pass: all but the deals are of listings that may be electronics."""
    e = unless_false("is_electronics")
    counts = ads.agg(
        F.count_if(e).alias("total"), F.count_if(e & (F.col("ad_type") == "product")).alias("products"), F.count_if(e & (F.col("ad_type") == "service")).alias("services"),
        F.count_if(e & (F.col("ad_type") == "wanted")).alias("wanted"), F.count_if(e & (F.col("source") == "site_a")).alias("site_a"),
        F.count_if(e & (F.col("source") == "site_b")).alias("site_b"), F.count_if("good_price_deal").alias("good_deals"),
    )
    return counts.crossJoin(duplicates.agg(F.count("*").alias("duplicates")))  # one row each


def pipeline_status(ads: DataFrame) -> DataFrame:
    """How far the batch steps have come, in counts and whole percent."""
    counts = ads.agg(
        F.count("*").alias("total"), F.count("ad_type").alias("classified"), F.count("llm_parsed_at").alias("parsed"), F.count("cluster_id").alias("clustered"),
        F.count("posted_date").alias("dated"), F.count("price_eur").alias("priced"), F.count("brand").alias("branded"), F.count_if("good_price_deal").alias("deals"),
        F.count_distinct("cluster_id").alias("clusters"),
    )
    percent = [F.coalesce(F.floor(F.try_divide(F.col(c) * 100, F.col("total"))), F.lit(0)).cast("long").alias(f"{c}_pct") for c in ("classified", "parsed", "clustered")]
    return counts.select("*", *percent)


def categories(ads: DataFrame, limit: int = 40) -> DataFrame:
    named = ads.filter(F.coalesce(F.col("category"), F.lit("")) != "")
    return named.groupBy("category").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "category").limit(limit)


def brand_key() -> Column:
    return F.lower(F.trim("brand"))


def _labels(spelled: DataFrame) -> DataFrame:
    """``brand_key, brand`` from spellings with how often (``n``) and where first they come."""
    spelled = spelled.groupBy("brand_key", "brand").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = F.row_number().over(Window.partitionBy("brand_key").orderBy(F.desc("n"), "first"))
    return spelled.withColumn("place", best).filter("place = 1").select("brand_key", "brand")


def _spelled(ads: DataFrame, *by: str, **sums: Column) -> DataFrame:
    """Listings with a brand, counted by its key and spelling and other columns: what both figures and labels are taken from, so that listings are read once."""
    named = ads.filter(F.coalesce(F.trim("brand"), F.lit("")) != "")
    more = [c.alias(k) for k, c in sums.items()]
    return named.groupBy(brand_key().alias("brand_key"), F.trim("brand").alias("brand"), *by).agg(F.count("*").alias("n"), F.min("ad_url").alias("first"), *more)


def brand_labels(ads: DataFrame) -> DataFrame:
    """``brand_key, brand``: each brand's most frequent spelling, of equal ones that of the first listing."""
    return _labels(_spelled(ads))


def plausible() -> Column:
    """With a reference, a ratio of a tenth at least; without, a price that isn't a placeholder."""
    return F.when(F.col("reference_new_price_mkd").isNotNull(), F.col("price_vs_new_ratio") >= 0.10).otherwise(F.col("price_eur") >= LEAST_PRICE_EUR)


def trimmed(rows: DataFrame, key: str, value: str, count: str | None = None) -> DataFrame:
    """Per key: ``n, q1, q3`` of all values; of those within 1.5 quartile ranges, ``m`` of them, their ``total``, the ``middle`` two's sum, least and greatest.

    Quartiles are values by place, q1 at max(0, n // 4 - 1), q3 at min(n - 1, 3n // 4) from 0.  With
    fewer than three values inside, all count.  A row counts ``count`` times.  Values are first counted by (key, value), so
    a key's window sorts its distinct values, not its rows.
    """
    cells = rows.groupBy(key, value).agg((F.sum(count) if count else F.count("*")).alias("rows_"))
    w = Window.partitionBy(key)
    cells = cells.withColumns({"n": F.sum("rows_").over(w), "upto": F.sum("rows_").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))})
    first, third = F.greatest(F.lit(1), F.floor(F.col("n") / 4)), F.least(F.col("n"), F.floor(3 * F.col("n") / 4) + 1)
    cells = cells.withColumns({
        "q1": F.min(F.when(F.col("upto") >= first, F.col(value))).over(w),
        "q3": F.min(F.when(F.col("upto") >= third, F.col(value))).over(w),
    })
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    cells = cells.withColumn("inside", F.col(value).between(F.col("q1") - spread, F.col("q3") + spread))
    cells = cells.withColumn("some", F.sum(F.when(F.col("inside"), F.col("rows_")).otherwise(0)).over(w) >= 3)
    used = cells.withColumn("rows_", F.when(F.col("inside") | ~F.col("some"), F.col("rows_")).otherwise(0)).withColumn("before", F.coalesce(F.sum("rows_").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = used.withColumn("m", F.sum("rows_").over(w))
    # The middle places of the used values; one value, or the mean of two.
    low, high = F.floor((F.col("m") - 1) / 2), F.floor(F.col("m") / 2)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (F.col("before") + F.col("rows_") > place), F.col(value)))

    live = F.col("rows_") > 0
    return used.groupBy(key).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.first("m").alias("m"),
        F.sum(F.col(value).cast("decimal(20,6)") * F.col("rows_")).cast("decimal(38,6)").alias("total"),
        F.min(F.when(live, F.col(value))).alias("least"), F.max(F.when(live, F.col(value))).alias("greatest"),
        (at(low).cast("decimal(20,6)") + at(high).cast("decimal(20,6)")).alias("middle"),
    )


def brand_prices(ads: DataFrame, source: str | None = None, least: int = 3) -> DataFrame:
    rows = ads.filter((F.col("ad_type") == "product") & (F.col("price_eur") > 0) & plausible() & (F.coalesce(F.trim("brand"), F.lit("")) != ""))
    rows = rows.filter(F.col("source") == source) if source else rows
    cells = _spelled(rows, "price_eur")
    found = trimmed(cells, "brand_key", "price_eur", "n").filter(F.col("n") >= least)
    named = found.join(_labels(cells), "brand_key")
    shown = {"min_price": "least", "max_price": "greatest", "q1": "q1", "q3": "q3"}
    means = [rounded(F.col("total"), F.col("m"), 2).alias("avg_price"), rounded(F.col("middle"), F.lit(2), 2).alias("median_price")]
    return named.select("brand", F.col("n").alias("count"), *means, *[F.round(c, 2).alias(k) for k, c in shown.items()]).orderBy(F.desc("count"), "brand")


def deal_share(ads: DataFrame, least: int = 10) -> DataFrame:
    rows = ads.filter((F.col("ad_type") == "product") & F.col("price_vs_new_ratio").isNotNull() & (F.coalesce(F.trim("brand"), F.lit("")) != ""))
    cells = _spelled(rows, deals=F.count_if("good_price_deal"))
    shares = cells.groupBy("brand_key").agg(F.sum("n").alias("total"), F.sum("deals").alias("deals")).filter(F.col("total") >= least)
    out = shares.join(_labels(cells), "brand_key").withColumn("pct", percent(F.col("deals"), F.col("total")))
    return out.select("brand", "total", "deals", "pct").orderBy(F.desc("pct"), "brand")


def monthly(ads: DataFrame, today: str, sources: tuple[str, ...], months: int = 12) -> DataFrame:
    """Listings by month and source over the last calendar months."""
    since = F.add_months(F.trunc(F.lit(today).cast("date"), "MM"), 1 - months)
    rows = ads.filter(F.col("posted_date") >= since).groupBy(F.date_format("posted_date", "yyyy-MM").alias("month"))
    return rows.agg(*[F.count_if(F.col("source") == s).alias(s) for s in sources], F.count("*").alias("total")).orderBy("month")


def depreciation(ads: DataFrame, least: int = 3) -> DataFrame:
    """Percent of the new price that listings of each condition ask."""
    rows = ads.filter((F.col("ad_type") == "product") & (F.col("price_vs_new_ratio") >= 0.10) & F.col("condition").isin(*CONDITIONS))
    found = trimmed(rows.select("condition", (F.col("price_vs_new_ratio") * 100).alias("pct")), "condition", "pct").filter(F.col("n") >= least)
    place = F.array_position(F.array(*map(F.lit, CONDITIONS)), F.col("condition"))
    return found.select("condition", F.col("n").alias("count"), rounded(F.col("total"), F.col("m"), 1).alias("avg_pct"), rounded(F.col("middle"), F.lit(2), 1).alias("median_pct")).orderBy(place)


def compare_sources(ads: DataFrame, one: str, other: str) -> DataFrame:
    """Brands' counts on two sources side by side, brands of either; null where a source has none.  One pass, one shuffle."""
    rows = ads.filter(F.col("source").isin(one, other) & (F.coalesce(F.trim("brand"), F.lit("")) != ""))
    counts = [F.nullif(F.count_if(F.col("source") == s), F.lit(0)).alias(name) for s, name in ((one, "count_one"), (other, "count_other"))]
    return rows.groupBy(brand_key().alias("brand_key")).agg(*counts)


def type_shares(ads: DataFrame) -> DataFrame:
    counts = ads.groupBy("ad_type").agg(F.count("*").alias("count"))  # a few types, so one window over them
    return counts.withColumn("pct", percent(F.col("count"), F.sum("count").over(Window.partitionBy())))


def z_scores(rows: DataFrame, group: str, value: str, least: int = 5, threshold: float = 2.5) -> DataFrame:
    """Adds ``z`` and ``is_anomaly``: rows of groups too small or without spread have neither.

    A group's moments come from one aggregation and are joined back, so no group's rows meet in a task.
    """
    known = rows.filter(F.col(value).isNotNull())
    moments = known.groupBy(group).agg(F.avg(value).alias("mean_"), F.stddev_pop(value).alias("std_"), F.count("*").alias("n_"))
    moments = moments.filter((F.col("n_") >= least) & (F.col("std_") > 0))
    z = (F.col(value) - F.col("mean_")) / F.col("std_")
    return known.join(moments, group).withColumns({"z": F.round(z, 3) + 0.0, "is_anomaly": F.abs(z) >= threshold}).drop("mean_", "std_", "n_")
