"""JSON, map and array functions for parsed listings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prices import to_number
from .text import ACCESSORIES, verified_note

# The fields of a parser's response beside specs, and the conditions of the catalogue.
FIELDS = (
    "condition", "brand", "model", "seller_notes", "phone", "delivery_available", "seller_type", "is_electronics", "stated_price_amount", "stated_price_currency",
)
CONDITIONS = ("New", "Used - Like New", "Used - Good", "Used - Fair", "Used", "For parts")


def _with(c: Column, use) -> Column:
    """``use`` of a column that is computed once, however often it is named."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def bare_json(raw: Column) -> Column:
    """JSON text without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?U)^```(?:json)?\s*", ""), r"(?U)\s*```$", ""))


def closed_json(bare: Column) -> Column:
    """JSON text with the closing braces that are missing at its end."""
    missing = F.length(F.replace(bare, F.lit("{"), F.lit("{{"))) - F.length(F.replace(bare, F.lit("}"), F.lit("}}")))
    return F.concat(bare, F.repeat(F.lit("}"), F.greatest(missing, F.lit(0))))


def fields_of(raw: Column) -> Column:
    """A response's top-level fields and its specs as maps; null if it isn't a JSON object even with its braces closed.

    Fields that are nested in specs come up if absent at the top; blank specs go.
    """
    kind, none = "map<string,string>", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def parted(top: Column, specs: Column) -> Column:
        up = F.map_filter(specs, lambda k, _: k.isin(*FIELDS) & ~F.map_contains_key(top, k))
        down = F.map_filter(specs, lambda k, v: ~(k.isin(*FIELDS) & ~F.map_contains_key(top, k)) & (F.coalesce(F.trim(v), F.lit("")) != ""))
        return F.struct(F.map_concat(F.map_filter(top, lambda k, _: k != "specs"), up).alias("fields"), down.alias("specs"))

    def read(top: Column) -> Column:
        specs = F.coalesce(F.from_json(F.try_element_at(top, F.lit("specs")), kind), none)
        return F.when(top.isNotNull(), _with(specs, lambda x: parted(top, x)))

    return _with(bare_json(raw), lambda x: _with(F.coalesce(F.from_json(x, kind), F.from_json(closed_json(x), kind)), read))


def typed(found: Column) -> Column:
    """The struct of typed fields with their defaults: empty texts are null, no delivery, electronics.

    A stated price needs an amount above 0 and a currency, EUR or MKD; without either both are null.
    """

    def read(f: Column) -> Column:
        def field(name: str) -> Column:
            return F.nullif(F.try_element_at(f["fields"], F.lit(name)), F.lit(""))

        amount, currency = to_number(field("stated_price_amount")), F.upper(F.trim(field("stated_price_currency")))
        stated = F.coalesce((amount > 0) & currency.isin("EUR", "MKD"), F.lit(False))
        return F.struct(
            *[field(x).alias(x) for x in ("condition", "brand", "model", "seller_notes", "phone", "seller_type")],
            F.coalesce(field("delivery_available").try_cast("boolean"), F.lit(False)).alias("delivery_available"),
            F.coalesce(field("is_electronics").try_cast("boolean"), F.lit(True)).alias("is_electronics"),
            F.when(stated, amount).alias("stated_price_amount"), F.when(stated, currency).alias("stated_price_currency"), f["specs"].alias("specs"),
        )

    return _with(found, read)


def parsed(raw: Column, title: Column, description: Column, claims: dict[str, tuple[str, ...]] = ACCESSORIES) -> Column:
    """The typed fields of a response; notes that claim an accessory which neither title nor description names go."""
    said = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    return _with(typed(fields_of(raw)), lambda x: x.withField("seller_notes", verified_note(x["seller_notes"], said, claims)))


def merged_condition(current: Column, new: Column) -> Column:
    """A condition of the catalogue is never overwritten."""
    return F.when(current.isin(*CONDITIONS), current).otherwise(F.coalesce(new, current))


def filled(m: Column) -> Column:
    """A map's entries whose values aren't blank."""
    return F.map_filter(m, lambda _, v: F.coalesce(F.trim(v), F.lit("")) != "")


def labelled(keys: Column, values: Column) -> Column:
    """A map from label and value lists: colons at labels' ends go, as do empty and repeated pairs; the last of equal labels stays."""
    pairs = F.arrays_zip(F.transform(keys, lambda k: F.lower(F.trim(F.regexp_replace(k, r":\s*$", "")))).alias("k"), F.transform(values, lambda x: F.trim(x)).alias("v"))
    kept = F.filter(pairs, lambda p: (F.coalesce(p["k"], F.lit("")) != "") & (F.coalesce(p["v"], F.lit("")) != "") & (F.lower(p["v"]) != p["k"]))
    last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def first_image(images: Column) -> Column:
    return F.get(images, F.lit(0))


def without_spec_lines(description: Column, specs: Column) -> Column:
    """A description without lines that only repeat a spec's value."""
    values = F.transform(F.map_values(specs), lambda v: F.lower(F.trim(v)))
    lines = F.filter(F.split(description, "\n"), lambda x: ~F.array_contains(values, F.lower(F.trim(x))))
    return F.array_join(lines, "\n")


def shown_notes(notes: Column, description: Column) -> Column:
    """Notes, unless the description already says them."""
    same = F.lower(F.coalesce(description, F.lit(""))).contains(F.lower(F.trim(notes)))
    return F.when(~same & (F.trim(notes) != ""), notes)


def embedding_input(title: Column, description: Column) -> Column:
    """What a listing is embedded as: "title. description", a missing description being empty."""
    return F.concat(title, F.lit(". "), F.coalesce(description, F.lit("")))


def joined_nodes(nodes: Column) -> Column:
    """Text nodes without blanks around them, the empty ones left out, as lines."""
    return F.array_join(F.filter(F.transform(nodes, lambda x: F.trim(x)), lambda x: x != ""), "\n")


def first_of(m: Column, *labels: str) -> Column:
    """A map's value under the first of some labels that has one."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(m, F.lit(x))), F.lit("")) for x in labels])


def json_or(raw: Column, kind: str, fallback: Column) -> Column:
    """A JSON text as a value of the type; the fallback if it is null or no such JSON."""
    return F.coalesce(F.from_json(raw, kind), fallback)


def valid_chat(messages: Column, most: int = 20, longest: int = 500, available: Column | None = None, answered: Column | None = None) -> Column:
    """The status of a chat request, an array of structs ``role, content``.

    503 if the service isn't ``available``; 400 without messages (null or empty), with too many, or one too long; 502 if it wasn't ``answered``; else 200.
    """
    n = F.coalesce(F.size(messages), F.lit(0))
    wrong = (n < 1) | (n > most) | F.coalesce(F.exists(messages, lambda m: F.length(m["content"]) > longest), F.lit(False))
    status = F.when(wrong, 400) if available is None else F.when(~available, 503).when(wrong, 400)
    return (status if answered is None else status.when(~answered, 502)).otherwise(200)


def prompt(*facts: tuple[str, Column]) -> Column:
    """Lines "label: value" for the facts there are."""
    return F.concat_ws("\n", *[F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in facts])


# How a listing's facts are told to the assistant.
FACTS = {"title": "Наслов", "description": "Опис", "condition": "Состојба", "brand": "Бренд", "model": "Модел", "location": "Локација", "seller_notes": "Забелешки од продавачот"}
NO_FACTS = "(нема дополнителни податоци)"
RETAIL, MARKET = "Setec.mk", "друг оглас за нов истиот модел"
INSTRUCTIONS = (
    "Помагаш на купувач да процени еден оглас за електроника.\nКористи ги само податоците подолу; не додавај ништо свое.\nАко нешто го нема во нив, кажи дека не знаеш.\n"
    "Технички детали пренесувај неутрално; предност или мана е само она што продавачот така го навел.\nОдговарај кратко, на македонски."
)


def _number(c: Column) -> Column:
    """A double as text: with a decimal at least, never with an exponent up to 10^18."""
    return F.when(F.abs(c) < 1e7, c.cast("string")).otherwise(F.regexp_replace(c.cast("decimal(24,4)").cast("string"), r"(\.\d+?)0+$", "$1"))


def listing_prompt(instructions: str = INSTRUCTIONS, retail: str = "setec") -> Column:
    """The assistant's instructions and a listing's facts, those there are, from its columns.

    Prices stand in both currencies where both are known; a reference price says where it is from and how many percent of it the listing asks, rounded half to even.
    """
    told = {k: F.when(F.coalesce(F.col(k), F.lit("")) != "", F.concat(F.lit(f"{v}: "), F.col(k))) for k, v in FACTS.items()}
    euros, denars = F.col("price_eur"), F.col("price_mkd")
    price = F.when(euros.isNotNull(), F.concat(F.lit("Цена: "), _number(euros), F.lit(" EUR"), F.coalesce(F.concat(F.lit(" ("), _number(denars), F.lit(" МКД)")), F.lit(""))))
    pairs = F.transform(F.map_entries("specs"), lambda x: F.concat(F.lit("'"), x["key"], F.lit("': "), F.coalesce(F.concat(F.lit("'"), x["value"], F.lit("'")), F.lit("None"))))
    specs = F.when(F.size("specs") > 0, F.concat(F.lit("Спецификации: {"), F.array_join(pairs, ", "), F.lit("}")))
    new, ratio = F.col("reference_new_price_mkd"), F.col("price_vs_new_ratio")
    source = F.when(F.col("reference_source") == retail, RETAIL).otherwise(MARKET)
    share = F.coalesce(F.concat(F.lit(" Овој оглас чини "), F.bround(ratio * 100).cast("long").cast("string"), F.lit("% од таа цена.")), F.lit(""))
    reference = F.when(new != 0, F.concat(F.lit("Споредбена цена на нов уред: "), _number(new), F.lit(" МКД (споредено со "), source, F.lit(")."), share))
    facts = F.concat_ws("\n", told["title"], told["description"], price, *[told[k] for k in ("condition", "brand", "model", "location", "seller_notes")], specs, reference)
    return F.concat(F.lit(f"{instructions}\n\nПодатоци за огласот:\n"), F.coalesce(F.nullif(facts, F.lit("")), F.lit(NO_FACTS)))
