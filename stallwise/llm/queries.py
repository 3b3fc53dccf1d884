"""The ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, fingerprints, langid, lexical, licenses, mixing, neardup, neighbours, packing, quality, resampling, sharding, wrappers
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards whose row counts differ by one at most."""
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, and whether it is kept."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document so that sources meet targets of 150% of all words."""
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized, in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near duplicates: five-word shingles, similarity 0.85."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in ZIP packages, read back by range."""
    out = archives.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases, and the licenses whose notices it quotes."""
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.drop("spans")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and its likeness to an edited text's and the next document's."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, by a wrapper inferred from its host's pages."""
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's likeness to the benchmark's distribution of n-grams, and its rank in a draw of 5%."""
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each benchmark item."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all vectors to every hundredth one."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter("vec_id % 100 = 0"), k=10)


QUERIES = (op1_sharding, op2_zip_archives, op3_license_scan, op4_fingerprints, op5_packing, op6_language_id, op7_html_extraction, op8_near_dedup, op9_mixing, op10_quality_rules, op11_importance_resampling, op12_lexical_search, op13_neighbours)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_zip_archives": archives.ORACLE_SQL, "op10_quality_rules": quality.ORACLE_SQL, "op11_importance_resampling": resampling.ORACLE_SQL, "op12_lexical_search": lexical.ORACLE_SQL}
