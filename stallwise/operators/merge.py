"""Merging of new and changed rows by key, duplicates by key, and gaps in known rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return _one(rows, keys, [F.col(c).asc_nulls_last() for c in order])


def last_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return _one(rows, keys, [F.col(c).desc_nulls_last() for c in order])


def _one(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key; Spark keeps only each task's first rows of a key before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place_", place).filter("place_ = 1").drop("place_")


def keep_max(pairs: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The greatest score of each key."""
    return pairs.groupBy(*keys).agg(F.max(score).alias(score))


def unknown(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return new.join(known.select(key), key, "left_anti")


def insert_if_absent(old: DataFrame, new: DataFrame, key: str, fallback: str | None = None, order: str | None = None) -> DataFrame:
    """Old rows and the first new row of each key that they lack; rows without a key go."""
    if fallback:
        new = new.withColumn(key, F.coalesce(key, fallback))
    new = new.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    # Without an order the least row as a whole is first, so that reruns agree.
    new = _one(new, [key], [F.col(order).asc_nulls_last()] if order else [F.to_json(F.struct(*sorted(new.columns)))])
    return old.unionByName(unknown(new, old, key).select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, supplied: list[str]) -> DataFrame:
    """Old rows with the supplied columns of new rows written over theirs, nulls too, and the new keys' rows."""
    told = new.select(F.col(key).alias("key_"), *[F.col(c).alias(f"{c}_new") for c in supplied])
    out = old.join(told, F.col(key) == F.col("key_"), "full")
    columns = {c: F.when(F.col("key_").isNotNull(), F.col(f"{c}_new")).otherwise(F.col(c)) for c in supplied}
    return out.withColumns({key: F.coalesce(key, "key_"), **columns}).select(*old.columns)


def fill_missing(rows: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """Backfill of one column: only rows that lack it, only where a value was found."""
    told = found.select(F.col(key).alias("key_"), F.col(column).alias("value_")).groupBy("key_").agg(F.min("value_").alias("value_"))
    return rows.join(told, F.col(key) == F.col("key_"), "left").withColumn(column, F.coalesce(column, "value_")).drop("key_", "value_")


def with_detail(listing: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Listing rows whose columns are overridden by those of a detail page that aren't null; of repeated details the least row's."""
    own = [c for c in detail.columns if c != key]
    told = _one(detail, [key], [F.to_json(F.struct(*sorted(own)))]).select(F.col(key).alias("key_"), *[F.col(c).alias(f"{c}_detail") for c in own])
    out = listing.join(told, F.col(key) == F.col("key_"), "left")
    return out.select(key, *[F.coalesce(f"{c}_detail", c).alias(c) if c in own else c for c in listing.columns if c != key])


def price_changes(rows: DataFrame, key: str, price: str, *order: str) -> DataFrame:
    """The price history of a log: each key's first price and every price that differs from the one before it."""
    w = Window.partitionBy(key).orderBy(*order)
    known = rows.filter(F.col(price).isNotNull()).withColumn("before", F.lag(price).over(w))
    return known.filter(F.col("before").isNull() | (F.col("before") != F.col(price)))


def price_events(stored: DataFrame, scraped: DataFrame, key: str, price: str, time: str) -> tuple[DataFrame, DataFrame]:
    """(new rows, entries ``key, price, recorded_at`` for the price history) of a scrape against the stored rows.

    The last row of a key counts.  A new key's first price is an entry, and so is a known key's price that differs from
    the stored one; a missing price is none.
    """
    latest = last_wins(scraped, [key], time, price)
    known = stored.select(F.col(key).alias("key_"), F.col(price).alias("old_"))
    told = latest.join(known, F.col(key) == F.col("key_"), "left")
    changed = F.col("key_").isNull() | F.coalesce(F.col(price) != F.col("old_"), F.col("old_").isNull())
    history = told.filter(F.col(price).isNotNull() & changed).select(F.col(key).alias("key"), F.col(price).alias("price"), F.col(time).alias("recorded_at"))
    return told.filter(F.col("key_").isNull()).select(*latest.columns), history


def repriced(stored: DataFrame, scraped: DataFrame, key: str, price: str, time: str) -> DataFrame:
    """The stored rows with their last scraped price where one was seen; scraped rows without a price change nothing, other columns stay."""
    latest = last_wins(scraped.filter(F.col(price).isNotNull()), [key], time, price).select(F.col(key).alias("key_"), F.col(price).alias("new_"))
    return stored.join(latest, F.col(key) == F.col("key_"), "left").withColumn(price, F.coalesce("new_", price)).select(*stored.columns)


def with_history(rows: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Each row's number of price entries, and the least and greatest price of them; rows without one stay."""
    entries = history.groupBy(F.col("key").alias("key_")).agg(F.count("*").alias("n_prices"), F.min("price").alias("least_price"), F.max("price").alias("greatest_price"))
    out = rows.join(entries, F.col(key) == F.col("key_"), "left").drop("key_")
    return out.withColumn("n_prices", F.coalesce("n_prices", F.lit(0)))


def marked_known(new: DataFrame, known: DataFrame, key: str, name: str = "known") -> DataFrame:
    """Whether each row's key is among the known ones."""
    told = known.select(F.col(key).alias("key_")).distinct()
    return new.join(told, F.col(key) == F.col("key_"), "left").withColumn(name, F.col("key_").isNotNull()).drop("key_")


def notices(rows: DataFrame, group: str, new: str, odd: str) -> DataFrame:
    """The groups that have something to tell of: ``group, n_new, n_odd``, one of them above 0."""
    counts = rows.groupBy(group).agg(F.count_if(new).alias("n_new"), F.count_if(odd).alias("n_odd"))
    return counts.filter("n_new > 0 or n_odd > 0")


def evolve(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other, allowMissingColumns=True)
