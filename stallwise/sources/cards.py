"""Product cards of HTML pages, as a table function over a small tree of elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .listings import LONGEST_TITLE, card_price

# What may be a card or a title, and from where on a title is about its price.
CARD_CLASSES = frozenset(("product", "product-item", "product-list-item", "item"))
CARD_TAGS = frozenset(("article", "li"))
CARD_PARTS = ("product", "ad", "oglas")
TITLE_CLASSES = frozenset(("title", "product-title", "name", "ad-title"))
TITLE_TAGS = frozenset(("h1", "h2", "h3", "h4"))
TITLE_ENDS = (
    r"(?:club|клуб)\s*(?:price|цена).*$",
    r"(?:regular|редовна)\s*(?:price|цена).*$",
    r"\s+\d{1,3}(?:[.\s]\d{3})*\s*(?:ден|den|mkd|€|eur).*$",
)
LEAST_TEXT, LEAST_TITLE, LONGEST_DESCRIPTION = 8, 3, 500
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

SCHEMA = "source string, source_url string, title string, description string, brand string, price double, currency string, image_url string"


class Element:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def below(self) -> Iterator[Element]:
        """All elements inside, in the page's order."""
        waiting = [iter(self.children)]
        while waiting:
            child = next(waiting[-1], None)
            if child is None:
                waiting.pop()
            elif isinstance(child, Element):
                yield child
                waiting.append(iter(child.children))

    def text(self) -> str:
        parts, waiting = [], [iter(self.children)]
        while waiting:
            child = next(waiting[-1], None)
            if child is None:
                waiting.pop()
            elif isinstance(child, str):
                parts.append(child)
            else:
                waiting.append(iter(child.children))
        return " ".join(" ".join(parts).split())

    @property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = self.open = Element("#page", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        made = Element(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(made)
        if tag not in VOID:
            self.open = made

    def handle_endtag(self, tag: str) -> None:
        at = self.open
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.open = at.parent

    def handle_data(self, data: str) -> None:
        if self.open.tag not in ("script", "style"):
            self.open.children.append(data)


def tree(page: str) -> Element:
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return reader.root


def may_be_card(x: Element) -> bool:
    """Blocks of products and listings by tag or class, and the parts of a grid."""
    held = x.attributes.get("class", "")
    if x.tag in CARD_TAGS or not CARD_CLASSES.isdisjoint(x.classes):
        return True
    in_grid = x.parent is not None and x.parent.tag == "div" and "grid" in x.parent.attributes.get("class", "")
    return x.tag == "div" and (in_grid or any(p in held for p in CARD_PARTS))


def clean_title(title: str) -> str:
    """A title up to where it is about the price, at most 140 characters."""
    for end in TITLE_ENDS:
        title = re.sub(end, "", title, flags=re.I).strip()
    return title[:LONGEST_TITLE]


def guess_brand(title: str) -> str | None:
    """The first word in capitals, without marks; null if there is none."""
    first = re.sub(r"[^\w-]", "", title.split()[0]) if title.split() else ""
    return first.upper() or None


def _link(inside: list[Element], hint: str | None) -> Element | None:
    """The link with the hint in it, else one around an image, else any."""
    links = [x for x in inside if x.tag == "a" and "href" in x.attributes]
    hinted = [x for x in links if hint and hint in x.attributes["href"]]
    pictured = [x for x in links if any(y.tag == "img" for y in x.below())] if not hinted else []
    return next(iter(hinted or pictured or links), None)


def cards(page: str, source: str, base_url: str, domain: str, hint: str | None = None, skip: list[str] | tuple[str, ...] = (), currency: str = "MKD") -> Iterator[tuple]:
    """The product cards of a page, one a link: a block with a link, and an image or a number or price in it.

    The link must hold the domain and none of ``skip``.  The title is that of a title's element, else an image's text, else the link's.
    """
    seen = set()
    for x in tree(page).below():
        if not may_be_card(x):
            continue
        inside = list(x.below())
        link = _link(inside, hint)
        if link is None:
            continue
        text, images = x.text(), [y for y in inside if y.tag == "img"]
        if len(text) < LEAST_TEXT or not (images or re.search(r"\d", text) or any("price" in y.attributes.get("class", "") or "cena" in y.classes for y in inside)):
            continue
        url = link.attributes["href"]
        url = base_url.rstrip("/") + url if url.startswith("/") else url
        if not url or domain not in url or any(s in url for s in skip) or url in seen:
            continue
        seen.add(url)
        named = next((y for y in inside if y.tag in TITLE_TAGS or not TITLE_CLASSES.isdisjoint(y.classes)), None)
        spoken = next((y.attributes["alt"] for y in images if "alt" in y.attributes), "")
        title = clean_title(" ".join((named.text() if named is not None else spoken or link.text()).split()))
        if len(title) < LEAST_TITLE:
            continue
        shown = next((y.attributes for y in images if "src" in y.attributes or "data-src" in y.attributes), {})
        image = shown.get("src") or shown.get("data-src") or ""
        image = base_url.rstrip("/") + image if image.startswith("/") else image
        yield source, url, title, text[:LONGEST_DESCRIPTION], guess_brand(title), card_price(text), currency, image or None


@F.udtf(returnType=SCHEMA)
class CardsOf:
    """``cards`` as a table function: a page without cards, or none, has no row."""

    def eval(self, page: str, source: str, base_url: str, domain: str, hint: str, skip: list, currency: str):  # noqa: ANN201
        yield from cards(page or "", source, base_url, domain, hint, skip or [], currency)


def read_cards(pages: DataFrame, source: Column, base_url: Column, domain: str, hint: str | None = None, skip: tuple[str, ...] = (), currency: str = "MKD", body: str = "html") -> DataFrame:
    """Each page's columns with each of its cards'; pages are dealt out first, as a small file, or one that pages are made from, is a single task's."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = pages.withColumns({"source_": source, "base_": base_url}).repartition(max(parts, pages.sparkSession.sparkContext.defaultParallelism))
    skipped = F.array(*[F.lit(s) for s in skip]).cast("array<string>")
    found = CardsOf(F.col(body).outer(), F.col("source_").outer(), F.col("base_").outer(), F.lit(domain), F.lit(hint).cast("string"), skipped, F.lit(currency))
    return at.lateralJoin(found).drop("source_", "base_")
