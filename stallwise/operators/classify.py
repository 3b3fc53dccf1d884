"""Whether a listing offers a product or a service, or wants something."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# How titles that want something start, phrases of such titles, and words of services.
WANTED_STARTS = (
    "барам", "baram", "тражам", "trazam", "купувам", "kupuvam", "побарувам", "pobaruvam", "sakam da kupam", "сакам да купам", "looking for", "wanted",
    "kupu[ji]em", "tra[zž]im",
)
WANTED = (
    "барам", "baram", "тражам", "trazam", "купувам", "kupuvam", "побарувам", "pobaruvam", "looking for", "wanted to buy", "sakam da kupam", "сакам да купам",
)
SERVICE = (
    "сервис", "servis", "servisiranje", "сервисирање", "поправка", "popravka", "ремонт", "remont", "поправување", "popravuvanje",
    "отклучување", "otklucuvanje", "unlock", "отклучи", "инсталација", "instalacija", "installation", "reinstalacija", "форматирање", "formatiranje",
    "otkup", "откуп", "откупувам", "otkupuvam", "следачи", "sledaci", "followers", "pratilci", "likes", "претплатници", "subscribers", "views", "pregledi",
    "glasovi", "гласови", "votes", "услуга", "usluga", "услуги", "uslugi", "изнајмување", "iznajmuvanje", "rental", "rent", "под наем",
    "рекламирање", "reklamiranje", "advertising", "promotion", "дизајн", "dizajn", "design", "printing", "печатење", "transport", "транспорт", "dostava",
    "достава на", "osiguruvanje", "осигурување", "insurance", "data recovery", "обнова на", "враќање на податоци",
)
SERVICE_TITLE = (
    "сервис", "servis", "поправка", "popravka", "ремонт", "remont", "otkup", "откуп", "unlock", "следачи", "followers", "услуга", "изнајмување", "rental",
)


def whole(phrases: tuple[str, ...]) -> str:
    return r"(?U)\b(?:%s)\b" % "|".join(map(re.escape, phrases))


def ad_type(
    title: Column, description: Column, starts: tuple[str, ...] = WANTED_STARTS, wanted: tuple[str, ...] = WANTED,
    strong: tuple[str, ...] = SERVICE_TITLE, service: tuple[str, ...] = SERVICE,
) -> Column:
    """wanted or service by the title, service by two different words in the description, else product."""
    t, d = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (title, description))
    hits = sum((F.when(d.rlike(whole((p,))), 1).otherwise(0) for p in service), F.lit(0))
    return (
        F.when(t.rlike(r"(?U)^(?:%s)\b" % "|".join(starts)) | t.rlike(whole(wanted)), "wanted").when(t.rlike(whole(strong)) | (hits >= 2), "service").otherwise("product")
    )
