"""Text functions as Column expressions.  Unicode classes are always on: (?U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges of pictographs that titles lose.
EMOJI = r"[\x{1F300}-\x{1FFFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{20000}-\x{2FA1F}]+"

# Selling phrases that duplicate search takes out of titles, in this order, as raw substrings.
DEDUP_NOISE = (
    "se prodava", "prodavam", "prodava", "za prodazba", "prodazba", "itno", "hitno", "kako nov", "kako nova", "kako novo", "zachuvan", "zacuvan",
    "zachuvana", "zacuvana", "polovno", "koristeno", "koristena", "novo", "nova", "nov", "for sale", "brand new", "like new", "used",
    "се продава", "продавам", "итно", "како ново", "како нов", "како нова", "зачуван", "зачувана", "користено", "користена", "ново", "нова", "нов",
)
# The same for grouping.
CLUSTER_NOISE = (
    "se prodava", "prodavam", "itno", "hitno", "kako nov", "kako nova", "zachuvan", "zacuvan", "polovno", "koristeno", "novo", "nov", "nova",
    "for sale", "like new", "used", "brand new", "се продава", "продавам", "итно", "како нов", "како ново", "зачуван", "користено", "ново", "нов",
)
# Accessories that a note may claim, and how a text may name them.
ACCESSORIES = {
    "cable": ("кабел", "kabel", "kabl", "kabli", "cable"),
    "charger": ("полнач", "polnac", "пуњач", "punjac", "karikues", "charger", "адаптер", "adapter"),
    "box": ("кутија", "kutija", "kuti", "box"),
    "earphones": ("слушалки", "слушалќи", "slusalki", "slusalice", "kufje", "earphones", "headphones"),
    "screen protector": ("фолија", "folija", "стакло", "staklo", "xham", "screen protector", "tempered glass"),
}


def squeeze(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_emoji(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, EMOJI, ""))


def clean_title(c: Column) -> Column:
    return strip_emoji(squeeze(c))


def clean_description(c: Column) -> Column:
    """Newlines as LF, runs of blanks and tabs as one blank, at most one empty line, none at the ends."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "")


def norm(c: Column) -> Column:
    """Lower case without blanks around; null is empty."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def without(c: Column, phrases: tuple[str, ...]) -> Column:
    """Take phrases out as raw substrings, one after the other, blanks in their place."""
    for p in phrases:
        c = F.replace(c, F.lit(p), F.lit(" "))
    return c


def dedup_title(c: Column, noise: tuple[str, ...] = DEDUP_NOISE) -> Column:
    """Titles as duplicate search compares them: noise out, "256 gb" joined."""
    c = without(F.lower(F.coalesce(c, F.lit(""))), noise)
    return squeeze(F.regexp_replace(c, r"(\d+)\s*(gb|tb|mb)", "$1$2"))


def cluster_title(c: Column, noise: tuple[str, ...] = CLUSTER_NOISE) -> Column:
    """Titles as grouping compares them: noise and punctuation out."""
    c = F.regexp_replace(without(F.lower(F.coalesce(c, F.lit(""))), noise), r"(\d+)\s*(gb|tb|mb)", "$1$2")
    return squeeze(F.regexp_replace(c, r"(?U)[^\w\s]", " "))


def model_numbers(c: Column) -> Column:
    """Distinct model numbers of a title: digits with up to two letters on either side, sizes left out."""
    bare = F.regexp_replace(F.lower(c), r"\d+(gb|tb|mb)", " ")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?U)(\b[a-z]{0,2}\d+[a-z]{0,2}\b)"), F.lit(1))))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def titles_fit(a: Column, b: Column, least_words: int = 3, least_ratio: float = 0.55) -> Column:
    """Whether two normalised titles may name the same thing: long enough, alike in length, no conflicting model numbers."""
    short, long_ = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    m, n = model_numbers(a), model_numbers(b)
    return (
        (F.size(words(a)) >= least_words) & (F.size(words(b)) >= least_words) & (F.try_divide(short, long_) >= least_ratio)
        & ((F.size(m) == 0) | (F.size(n) == 0) | F.arrays_overlap(m, n))
    )


def seller_name(c: Column) -> Column:
    """A seller's name as it is compared; of none, empty."""
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def names_match(a: Column, b: Column) -> Column:
    """Both there, and equal or one the other's start, of names as ``seller_name`` gives them."""
    return (a != "") & (b != "") & (F.startswith(a, b) | F.startswith(b, a))


def sellers_match(a: Column, b: Column) -> Column:
    """Both named, and equal or one the other's start."""
    return names_match(seller_name(a), seller_name(b))


# What titles of services hold, as raw substrings.
SERVICE_WORDS = ("otkup", "откуп", "servis", "сервис", "remont", "ремонт", "popravka", "поправка", "servisiranje", "сервисирање")


def is_service(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(low.rlike("|".join(SERVICE_WORDS)), F.lit(False))


def migrated_description(c: Column) -> Column:
    """Descriptions as the migration cleans them: without pictographs too."""
    return strip_emoji(clean_description(c))


def listing_type(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(low.contains("продава") | low.contains("sell"), "sale").when(low.contains("купува") | low.contains("buy"), "buy")
        .when(low.contains("разменува") | low.contains("trade"), "trade").otherwise(c)
    )


def seller_type(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("приват") | low.contains("private"), "private").when(low.contains("компан") | low.contains("company"), "company").otherwise(c)


def infer_source(source: Column, url: Column, known: tuple[str, ...]) -> Column:
    """The source given, else the first known one that the URL names."""
    return F.coalesce(source, *[F.when(url.contains(k), F.lit(k)) for k in known])


def truncate_words(c: Column, length: int = 600, least: float = 0.6) -> Column:
    """At most ``length`` characters, cut at the last blank if that keeps more than a share of them."""
    head = F.left(c, F.lit(length))
    at = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", head) > 0) & (at > length * least), F.left(head, at)).otherwise(head)
    return F.when(F.length(c) <= length, c).otherwise(F.concat(cut, F.lit("…")))


def url_param(url: Column, name: str) -> Column:
    return F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)


def with_page(url: Column, name: str, page: Column) -> Column:
    """The URL with its page parameter set."""
    has, value = url.rlike(rf"[?&]{name}=\d*"), F.concat(F.lit(f"{name}="), page.cast("string"))
    fresh = F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), value)
    return F.when(has, F.regexp_replace(url, F.lit(rf"(?<=[?&]){name}=\d*"), value)).otherwise(fresh)


def css_url(c: Column) -> Column:
    """The address in a CSS url(...), with a scheme and without its query."""
    found = F.regexp_extract(c, r"url\(['\"]?([^'\")]+)['\"]?\)", 1)
    full = F.when(F.startswith(found, F.lit("//")), F.concat(F.lit("https:"), found)).otherwise(found)
    return F.nullif(F.regexp_replace(full, r"\?.*$", ""), F.lit(""))


def page_of(c: Column) -> Column:
    """(page, pages) of a text like "page 3 of 17"."""
    pattern = r"(\d+)\D+(\d+)"
    return F.struct(F.regexp_extract(c, pattern, 1).try_cast("int").alias("page"), F.regexp_extract(c, pattern, 2).try_cast("int").alias("pages"))


def verified_note(note: Column, text: Column, claims: dict[str, tuple[str, ...]]) -> Column:
    """The note, or null if it claims something that no synonym in the text bears out."""
    wrong = F.lit(False)
    for synonyms in claims.values():
        pattern = "|".join(synonyms)
        wrong = wrong | (F.lower(note).rlike(pattern) & ~F.lower(F.coalesce(text, F.lit(""))).rlike(pattern))
    return F.when(~wrong, note)
