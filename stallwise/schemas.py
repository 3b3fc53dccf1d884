"""Schemas of the listing data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


ADS = _struct(
    ad_url=_S, title=_S, description=_S, price=_S, currency=_S, price_eur=_D, price_mkd=_D, price_note=_S, location=_S,
    images=T.ArrayType(_S), category=_S, condition=_S, source=_S, scraped_at=T.TimestampType(), posted_date=T.DateType(),
    seller_name=_S, seller_type=_S, phone=_S, specs=T.MapType(_S, _S), delivery_available=_B, seller_notes=_S,
    is_electronics=_B, is_active=_B, ad_type=_S, listing_type=_S, brand=_S, model=_S, cluster_id=_I, cluster_label=_S,
    reference_new_price_mkd=_D, reference_sample_size=_I, reference_source=_S, price_vs_new_ratio=_D, good_price_deal=_B,
    llm_parsed_at=T.TimestampType(),
)
DUPLICATES = _struct(ad_url_1=_S, ad_url_2=_S, similarity_score=_D, match_type=_S, same_seller=_B, is_service=_B)
RETAIL_PRICES = _struct(url=_S, source=_S, brand=_S, title=_S, price_mkd=_D, original_price_mkd=_D, scraped_at=T.TimestampType())
PRICE_HISTORY = _struct(key=_S, price=_D, recorded_at=T.TimestampType())
AGENT_LOGS = _struct(agent=_S, message=_S, target=_S, level=_S, created_at=T.TimestampType())
PARSED_AD = _struct(
    specs=T.MapType(_S, _S), brand=_S, model=_S, condition=_S, seller_notes=_S, price_amount=_S, price_currency=_S, delivery_available=_B, is_electronics=_B
)
CHAT_MESSAGE = _struct(role=_S, content=_S)
