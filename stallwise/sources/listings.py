"""Sources and sinks of listings: JSON lines, nested retail catalogues, JDBC, HTML pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ADS


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = ADS) -> DataFrame:
    """Rows of JSON lines files; blank and malformed lines go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 8, **options: str) -> DataFrame:
    """A database table; with an integer key in ranges of it, read in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def write_jdbc(rows: DataFrame, url: str, name: str, batch: int = 500, **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=name, batchsize=batch, **options).mode("append").save()


CATALOGUE = T.StructType().add("products", T.ArrayType(
    T.StructType().add("handle", "string").add("title", "string").add("variants", T.ArrayType(
        T.StructType().add("calculated_price", T.StructType().add("calculated_amount", "double").add("original_amount", "double"))
    ))
))


def read_retail(responses: DataFrame, source: str, base_url: str, column: str = "body") -> DataFrame:
    """Retail prices from catalogue API pages in a text column: the first variant's price; products without one or without a handle go."""
    item = F.explode(F.from_json(column, CATALOGUE)["products"]).alias("p")
    price = F.get(F.col("p.variants"), F.lit(0))["calculated_price"]
    rows = responses.select(item).select(
        F.concat(F.lit(base_url), F.col("p.handle")).alias("url"), F.lit(source).alias("source"), F.split(F.trim("p.title"), " ")[0].alias("brand"), F.col("p.title").alias("title"),
        price["calculated_amount"].alias("price_mkd"), price["original_amount"].alias("original_price_mkd"),
    )
    return rows.filter(F.col("url").isNotNull() & F.col("price_mkd").isNotNull())


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_HREF = re.compile(r"href\s*=\s*[\"']?([^\"'\s>]+)", re.I)
_NUMBER = re.compile(r"(?<!\d)\d{1,3}(?:[. ]\d{3})+(?!\d)|\d+")
# Words from which on a card's text is about its price, and the longest title.
_PRICE_TAIL = re.compile(r"\s*(?:редовна цена|клуб цена|цена)\b.*$|\s*\d[\d.,]*\s*(?:ден|мкд|mkd|eur|€)\.?.*$", re.I)
LONGEST_TITLE, LEAST_PRICE = 140, 100


def card_price(text: str) -> float | None:
    """The least number from 100 on in a text whose commas are dropped; dots and blanks group thousands."""
    found = [float(re.sub("[. ]", "", n)) for n in _NUMBER.findall(text.replace(",", ""))]
    return min((n for n in found if n >= LEAST_PRICE), default=None)


def card_title(text: str) -> str:
    return _PRICE_TAIL.sub("", " ".join(text.replace("\xa0", " ").split()))[:LONGEST_TITLE].strip()


def card_brand(title: str) -> str | None:
    return title.split()[0].upper() if title.split() else None


def cards(page: str, base_url: str, domain: str, skip: tuple[str, ...] = ()) -> list[dict]:
    """The product cards of a page: list items, articles and divs without such blocks inside, with a link on
    the domain and an image or a price; the first card of a link stays."""
    blocks = re.findall(r"<(li|article|div)\b[^>]*>((?:(?!<(?:li|article|div)\b).)*?)</\1\s*>", page, re.S | re.I)
    out, seen = [], set()
    for _, inner in blocks:
        text = " ".join(html.unescape(_TAG.sub(" ", inner)).split())
        price = card_price(text)
        link = next((urljoin(base_url, html.unescape(h)) for h in _HREF.findall(inner)), None)
        if not link or not (price or re.search(r"<img\b", inner, re.I)) or not (urlsplit(link).hostname or "").endswith(domain) or any(s in link for s in skip) or link in seen:
            continue
        seen.add(link)
        title = card_title(text)
        if title:
            out.append({"source_url": link, "title": title, "description": text[:500], "brand": card_brand(title), "price": price})
    return out


def read_cards(pages: DataFrame, domain: str, url: str = "url", body: str = "html") -> DataFrame:
    """A row per product card of every page."""
    schema = "source_url string, title string, description string, brand string, price double"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("source_url", pa.string()), ("title", pa.string()), ("description", pa.string()), ("brand", pa.string()), ("price", pa.float64())])
        for batch in batches:
            rows = [c for u, h in zip(batch[url].to_pylist(), batch[body].to_pylist()) for c in cards(h or "", u or "", domain)]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return pages.select(url, body).mapInArrow(found, schema)
