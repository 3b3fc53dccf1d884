"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as parquet and
read back as the next one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm import langid, mixing, neardup, packing, quality
from stallwise.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that fail the quality rules, and documents that fail or lose too much; n_chars follows the text."""
    kept = quality.accepted(docs.select(*COLUMNS))
    return kept.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set each document's language to the predicted one; documents without a language go."""
    model = langid.fit(docs)
    guessed = langid.predict(docs.select(*COLUMNS), model).filter(F.col("lang_pred") != langid.UNKNOWN)
    return guessed.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: similarity 0.8 or more over five-word shingles.

    It is the row with the smallest id, null ids last, and the smallest hash of the text among those; of rows
    that share id and text, one stays.  A text without words is in no group: those with a null id all stay.
    """
    # Ids may be null or repeated, so rows are told apart by id and text.
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("hash"))
    docs = docs.withColumn("key", key)
    kept = neardup.near_duplicates(docs, percent=80, id_col="key").filter("kept").groupBy(F.col("doc_id").alias("key"), "n_shingles").agg(F.count("*").alias("copies"))
    each = (F.col("copies") == 1) | (F.col("key.last") & (F.col("n_shingles") == 0))
    alone = docs.join(kept.filter(each).select("key"), "key", "left_semi")
    repeated = docs.join(kept.filter(~each).select("key"), "key", "left_semi").dropDuplicates(["key"])
    return alone.unionByName(repeated).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their targets."""
    rated = mixing.mix(docs.select(*COLUMNS), weights=(5, 2, 1), share=1.5, cap=2, whole=True).filter("copies > 0")
    return rated.select("document", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [("quality_rules", clean), ("language_id", identify), ("near_dedup", dedup), ("mixing", mix), ("packing", pack)]

#: Language models, sketches and token ids are beyond SQL; tests/llm/test_pipeline.py has brute-force checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
