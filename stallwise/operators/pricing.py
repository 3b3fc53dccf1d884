"""Reference prices for a listing's model when new: from a retail catalogue, else from new listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import is_deal
from ..functions.text import norm, words

# Words that make a model name another variant, and the shapes of storage and network tokens.
VARIANTS = ("pro", "pro+", "max", "plus", "ultra", "mini", "lite", "fe", "se", "note", "air", "5g", "4g")
STORAGE, NETWORK = r"^\d+(/\d+)?(gb|tb)$", r"^[345]g$"
LEAST_PRICE_MKD = 1500


def model_tokens(c: Column) -> Column:
    """A name's tokens without network generations."""
    return F.filter(words(norm(c)), lambda t: ~t.rlike(NETWORK))


def matches(model: Column, title: Column) -> Column:
    """Whether a title's tokens have the model's in a row, with a storage token or the end before any variant word."""
    n, m = F.size(model), F.size(title)

    def accepted(start: Column) -> Column:
        tail = F.slice(title, start + n + 1, F.greatest(m, F.lit(1)))
        variant = F.array_position(F.transform(tail, lambda t: t.isin(*VARIANTS)), True)
        storage = F.array_position(F.transform(tail, lambda t: t.rlike(STORAGE)), True)
        return (F.slice(title, start + 1, n) == model) & ((variant == 0) | ((storage > 0) & (storage < variant)))

    starts = F.sequence(F.lit(0), F.greatest(m - n, F.lit(0)))
    return (n > 0) & (m >= n) & F.exists(starts, accepted)


def names_variants(model: Column, title: Column) -> Column:
    """Whether a title names the model's number with two different runs of variant words, as price lists do."""
    anchor = F.try_element_at(F.filter(words(norm(model)), lambda t: t.rlike(r"^\d{1,3}$")), F.lit(-1))
    tokens = F.filter(F.split(F.regexp_replace(norm(title), r"(?U)[^\w+]+", " "), " "), lambda t: t != "")
    # Each token's run: the variant words from the next token to the first other one.
    state = F.aggregate(
        F.concat(tokens, F.array(F.lit(""))),
        F.struct(F.lit(False).alias("open"), F.lit("").alias("run"), F.array().cast("array<string>").alias("runs")),
        lambda s, t: F.struct(
            F.when(t == anchor, True).otherwise(s["open"] & t.isin(*VARIANTS)).alias("open"),
            F.when(s["open"] & t.isin(*VARIANTS), F.concat(s["run"], F.lit(" "), t)).otherwise("").alias("run"),
            F.when(s["open"] & ~t.isin(*VARIANTS), F.array_union(s["runs"], F.array(s["run"]))).otherwise(s["runs"]).alias("runs"),
        ),
    )
    return F.coalesce(try_at_least_two(anchor, state["runs"]), F.lit(False))


def try_at_least_two(anchor: Column, runs: Column) -> Column:
    return anchor.isNotNull() & (F.size(runs) >= 2)


def named_models(title: Column, sizes: Column) -> Column:
    """The runs of a title's tokens that ``matches`` takes as a model, of the given sizes, each once."""
    m = F.size(title)
    variant, storage = (F.transform(title, f) for f in (lambda t: t.isin(*VARIANTS), lambda t: t.rlike(STORAGE)))

    def run(start: Column, n: Column) -> Column:
        after = (start + n + 1, F.greatest(m, F.lit(1)))
        first, kept = F.array_position(F.slice(variant, *after), True), F.array_position(F.slice(storage, *after), True)
        return F.when((first == 0) | ((kept > 0) & (kept < first)), F.slice(title, start + 1, n))

    def of(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), m - n), lambda start: run(start, n))

    runs = F.flatten(F.transform(F.filter(sizes, lambda n: (n > 0) & (n <= m)), of))
    return F.array_distinct(F.filter(runs, lambda r: r.isNotNull()))


def retail_matches(ads: DataFrame, retail: DataFrame) -> DataFrame:
    """``ad_url, retail_price, retail_n``: the least price and the number of catalogue entries for each listing's model.

    A catalogue title is spelled out once as the runs of tokens that it names, of the sizes that models have, and those are added up before they
    meet the models of their brand by equality; no model is held against the titles of its whole brand.
    """
    catalogue = retail.filter((F.col("price_mkd") > 0) & (norm(F.col("brand")) != "") & (norm(F.col("title")) != ""))
    catalogue = catalogue.select(norm(F.col("brand")).alias("brand_key"), model_tokens(F.col("title")).alias("title_tokens"), "price_mkd")
    models = ads.select(norm(F.col("brand")).alias("brand_key"), norm(F.col("model")).alias("model_key")).distinct().withColumn("tokens", model_tokens(F.col("model_key")))
    sizes = models.agg(F.collect_set(F.size("tokens")).alias("sizes"))
    runs = catalogue.crossJoin(F.broadcast(sizes)).select("brand_key", F.explode(named_models(F.col("title_tokens"), F.col("sizes"))).alias("tokens"), "price_mkd")
    prices = runs.groupBy("brand_key", "tokens").agg(F.min("price_mkd").alias("retail_price"), F.count("*").cast("int").alias("retail_n"))
    return models.join(prices, ["brand_key", "tokens"]).select("brand_key", "model_key", "retail_price", "retail_n")


def market_prices(ads: DataFrame, least: int = 2) -> DataFrame:
    """The median price of new listings of each brand and model, where there are enough."""
    new = ads.filter((F.col("condition") == "New") & (F.col("price_mkd") >= LEAST_PRICE_MKD))
    found = new.groupBy(norm(F.col("brand")).alias("brand_key"), norm(F.col("model")).alias("model_key"))
    return found.agg(F.median("price_mkd").alias("market_price"), F.count("*").cast("int").alias("market_n")).filter(F.col("market_n") >= least)


def reference_prices(ads: DataFrame, retail: DataFrame) -> DataFrame:
    """Each priced product's reference: ``reference_new_price_mkd, reference_sample_size, reference_source, price_vs_new_ratio, good_price_deal``."""
    rows = ads.filter((F.col("ad_type") == "product") & F.col("brand").isNotNull() & F.col("model").isNotNull() & F.col("price_mkd").isNotNull())
    keyed = rows.withColumns({"brand_key": norm(F.col("brand")), "model_key": norm(F.col("model")), "several": names_variants(F.col("model"), F.col("title"))})
    keys = ["brand_key", "model_key"]
    out = keyed.join(retail_matches(rows, retail), keys, "left").join(market_prices(rows), keys, "left")
    by_retail = ~F.col("several") & F.col("retail_price").isNotNull()
    by_market = ~F.col("several") & F.col("retail_price").isNull() & F.col("market_price").isNotNull() & ~F.col("condition").eqNullSafe("New")
    usable = F.col("price_mkd") > 0
    price = F.when(usable & by_retail, F.col("retail_price")).when(usable & by_market, F.col("market_price"))
    ratio = F.round(F.col("price_mkd") / price, 4)
    return out.select(
        "ad_url", F.round(price.cast("decimal(20,6)"), 2).cast("double").alias("reference_new_price_mkd"), F.when(usable & by_retail, F.col("retail_n")).when(usable & by_market, F.col("market_n")).alias("reference_sample_size"),
        F.when(usable & by_retail, "retail").when(usable & by_market, "marketplace").alias("reference_source"), ratio.alias("price_vs_new_ratio"),
        is_deal(ratio, F.col("condition")).alias("good_price_deal"),
    )
