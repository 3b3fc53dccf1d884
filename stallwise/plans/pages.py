"""Queries of product cards and of what the assistant is told, over pages and listings made of the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from ..sources import cards
from .catalog import register
from .fixture import table

#: A page a part: a card with a hinted link, its copy, one whose link is around an image, one with a plain link, a foreign one, a skipped one, and no card.
PAGE = """<html><body><nav><li><a href="/home">Home</a></li></nav><main><div class="grid"><div class="product-item"><a href="/about/{k}">x</a><a href="/oglas/{k}"><img src="/i/{k}.jpg" alt="Alt"></a>
<h3 class="title">{b} {t}&nbsp;24.999 ден</h3><span class="price">Редовна цена 32.999 ден. Клуб цена {s}.500 ден.</span></div><div class="cell"><a href="/oglas/{k}"><img src="/x.jpg">again for 999 ден</a></div>
<ul><li><a href="/plain/{k}">Plain one</a><a href="/pic/{k}"><img data-src="/d/{k}.png" alt="{t} pic"></a> nothing more</li></ul><article><a href="/only/{k}">{t} only</a> for 150 </article>
<div class="item"><a href="https://evil.example/oglas/1"><img src="/y.jpg" alt="Fake"></a>9.999 ден</div><div class="item"><a href="/skip/{k}"><img src="/z.jpg">Not this one 500</a></div>
<div class="item"><a href="/kontakt">Write to us for more</a></div></div></main></body></html>"""

CARDS_SQL = r"""WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_type AS t, p_size + 10 AS s FROM part)
  SELECT k, 'shop' AS source, 'https://www.test.mk/oglas/' || k AS source_url, b || ' ' || t AS title, upper(replace(split_part(b, ' ', 1), '#', '')) AS brand, CAST(least(24999, s * 1000 + 500) AS DOUBLE) AS price, 'MKD' AS currency, 'https://www.test.mk/i/' || k || '.jpg' AS image_url FROM p
  UNION ALL SELECT k, 'shop', 'https://www.test.mk/pic/' || k, t || ' pic', upper(regexp_replace(split_part(t, ' ', 1), '[^\w-]', '', 'g')), NULL, 'MKD', 'https://www.test.mk/d/' || k || '.png' FROM p
  UNION ALL SELECT k, 'shop', 'https://www.test.mk/only/' || k, t || ' only', upper(regexp_replace(split_part(t, ' ', 1), '[^\w-]', '', 'g')), 150.0, 'MKD', NULL FROM p"""


@register("card_cases", CARDS_SQL)
def card_cases(spark, d):
    """The cards of a page made for every part, which has every kind of card and of what is none."""
    page = F.lit(PAGE)
    for name, value in (("k", F.col("p_partkey").cast("string")), ("b", F.col("p_brand")), ("t", F.col("p_type")), ("s", (F.col("p_size") + 10).cast("string"))):
        page = F.replace(page, F.lit(f"{{{name}}}"), value)
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("k"), page.alias("html"))
    found = cards.read_cards(pages, F.lit("shop"), F.lit("https://www.test.mk/"), "test.mk", hint="/oglas", skip=("/skip/",))
    return found.select("k", "source", "source_url", "title", "brand", "price", "currency", "image_url")


def _quoted(x: str) -> str:
    return x.replace("'", "''")


PROMPT_SQL = f"""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 7 <> 0 THEN p_type END AS description, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS brand,
  CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN floor(p_retailprice) END AS eur, CASE WHEN p_partkey % 2 = 0 THEN floor(p_retailprice) * 61.5 END AS mkd, CASE WHEN p_partkey % 4 = 1 AND p_partkey % 7 <> 0 THEN p_size END AS ram,
  CASE WHEN p_partkey % 7 <> 0 THEN CASE p_partkey % 4 WHEN 0 THEN 50000.0 WHEN 1 THEN 0.0 WHEN 2 THEN 12345678.5 END END AS new, CASE WHEN p_partkey % 8 <> 0 THEN p_size / 80.0 END AS ratio, CASE WHEN p_partkey % 3 = 1 THEN 'setec' ELSE 'marketplace' END AS source FROM part),
  f AS (SELECT k, concat_ws(chr(10), 'Наслов: ' || title, 'Опис: ' || nullif(description, ''), 'Цена: ' || eur::DOUBLE || ' EUR' || coalesce(' (' || mkd::DOUBLE || ' МКД)', ''), 'Бренд: ' || brand, 'Спецификации: {{''ram'': ''' || ram || '''}}',
  CASE WHEN new <> 0 THEN 'Споредбена цена на нов уред: ' || new::DOUBLE || ' МКД (споредено со ' || CASE source WHEN 'setec' THEN '{records.RETAIL}' ELSE '{records.MARKET}' END || ').' || coalesce(' Овој оглас чини ' || round_even(ratio::DOUBLE * 100, 0)::BIGINT || '% од таа цена.', '') END) AS facts FROM p)
  SELECT k, '{_quoted(records.INSTRUCTIONS)}' || chr(10) || chr(10) || 'Податоци за огласот:' || chr(10) || coalesce(nullif(facts, ''), '{records.NO_FACTS}') AS prompt FROM f"""


@register("chat_prompt_whole", PROMPT_SQL)
def chat_prompt_whole(spark, d):
    """What the assistant is told of every part as a listing: all facts, some, or none; prices in one currency or two; references from a shop or a listing."""
    key, some = F.col("p_partkey"), F.col("p_partkey") % 7 != 0
    blank = F.lit(None).cast("string")
    rows = table(spark, d, "part").select(
        key.alias("k"), F.when(some, F.col("p_name")).alias("title"), F.when(key % 3 == 0, "").when(some, F.col("p_type")).alias("description"), F.when(some, F.col("p_brand")).alias("brand"),
        F.when((key % 5 != 0) & some, F.floor("p_retailprice").cast("double")).alias("price_eur"), F.when(key % 2 == 0, F.floor("p_retailprice") * F.lit(61.5)).alias("price_mkd"),
        F.when((key % 4 == 1) & some, F.create_map(F.lit("ram"), F.col("p_size").cast("string"))).alias("specs"), *[blank.alias(c) for c in ("condition", "model", "location", "seller_notes")],
        F.when(some, F.when(key % 4 == 0, 50000.0).when(key % 4 == 1, 0.0).when(key % 4 == 2, 12345678.5)).alias("reference_new_price_mkd"), F.when(key % 8 != 0, F.col("p_size") / 80.0).alias("price_vs_new_ratio"),
        F.when(key % 3 == 1, "setec").otherwise("marketplace").alias("reference_source"),
    )
    return rows.select("k", records.listing_prompt().alias("prompt"))


@register("chat_statuses", """WITH c AS (SELECT conv_id, count(*) AS n, max(length(text)) AS longest FROM conversations GROUP BY conv_id)
  SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN 503 WHEN conv_id % 5 = 0 OR conv_id % 7 = 0 OR n > 20 OR longest > 500 THEN 400 WHEN conv_id % 3 = 0 THEN 502 ELSE 200 END AS status FROM c""")
def chat_statuses(spark, d):
    """A request a conversation: some while the service is off, some with null or no messages, some that get no answer."""
    key = F.col("conv_id")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    asked = F.when(key % 5 == 0, F.lit(None)).when(key % 7 == 0, F.slice("messages", 1, 0)).otherwise(F.col("messages"))
    return rows.select("conv_id", records.valid_chat(asked, available=key % 11 != 0, answered=key % 3 != 0).alias("status"))
