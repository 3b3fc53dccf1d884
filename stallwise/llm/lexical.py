"""Ranked lexical search: an inverted index in shards of documents, and MaxScore within each shard.

The index has one row for each shard, a block of documents with the postings of all its terms.  A shard takes an item's
lists by falling upper bound.  Once the lists that are left can't lift a document to the k-th score by themselves they are
non-essential: they are only probed, for the documents that may still reach that score.  The shards' best k meet in a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, small_batches
from .resampling import _packed, _unpacked
from .terms import terms, text_blocks

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, as ``terms.terms`` takes them."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """The inverted index of whole texts, a row a shard of about ``block_bytes`` of text: ``ids, lengths, terms, dfs, places, tfs, n_docs, n_terms``.

    ``places`` are the documents of each term's postings, ``dfs`` of them, term by term and rising; ``lengths`` counts
    each document's terms.
    """
    rows = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in text_blocks(batches, block_bytes):
            at, words, bounds = terms(raws)
            n = np.diff(bounds)
            found, tfs = np.unique(at * len(raws) + np.repeat(np.arange(len(raws)), n), return_counts=True)
            dfs = np.bincount(found // len(raws), minlength=len(words)).astype(np.int32)
            yield pa.record_batch({
                "ids": _listed(ids), "lengths": [_packed(n)], "terms": _listed(words.cast(pa.string())), "dfs": _listed(pa.array(dfs)),
                "places": [_packed((found % len(raws)).astype(np.int32))], "tfs": [_packed(tfs.astype(np.int32))], "n_docs": pa.array([int((n > 0).sum())], pa.int64()), "n_terms": pa.array([len(at)], pa.int64()),
            })
        give_back()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(indexed, f"ids array<{kind}>, lengths binary, terms array<string>, dfs array<int>, places binary, tfs binary, n_docs long, n_terms long")


def _listed(x: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def maxscore(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the k best, with their whole scores: all above 0 that reach ``floor`` and the k-th score of these lists.

    A list is (rising documents, what each gains, the most of it).
    """
    lists = sorted(lists, key=lambda x: -x[2])
    rest = [0]
    for x in reversed(lists):
        rest.append(rest[-1] + x[2])
    rest.reverse()
    score, least, i = np.zeros(n_docs, dtype=np.int64), max(1, floor), 0
    while i < len(lists) and rest[i] >= least:  # a document in none of the lists before may still qualify
        places, gains, _ = lists[i]
        score[places] += gains
        i += 1
        if n_docs > k:
            least = max(least, int(np.partition(score, -k)[-k]))
    able = np.flatnonzero((score > 0) & (score + rest[i] >= least))
    for j in range(i, len(lists)):
        places, gains, _ = lists[j]
        at = np.minimum(np.searchsorted(places, able), len(places) - 1)
        hit = places[at] == able
        score[able[hit]] += gains[at[hit]]
        if len(able) > k:
            least = max(least, int(np.partition(score[able], -k)[-k]))
        able = able[score[able] + rest[j + 1] >= least]
    able = able[score[able] >= least]
    return able, score[able]


def search(shards: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", pack: int = 50_000) -> DataFrame:
    """The k best documents for each item among all shards: ``item_id, rank, doc_id, score``, equal scores by the smaller id.

    N documents have a term, L terms in all; a document's m is 10 + (90 n N) div L for its n terms; a term in df documents weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))); a score adds up w * ((10**9 tf) div (1000 tf + 8 m)) over an item's distinct terms, in 64-bit integers.

    Items meet the shards in packs of about ``pack`` terms; Spark broadcasts them only where they are small by its own check.  ``shards``
    is read three times and should be a written table.

    Defined cases: a null text or one without terms gets no rows; rows with one item id are one item, with the terms of all of them, null ids too; null document ids come last
    among ties, and rows with equal ids are rows of their own; texts of any length are worked on whole; empty tables give
    an empty result; other columns are ignored.
    """
    whole = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = whole["docs"], max(1, whole["terms"])
    asked = items.select(F.col(item_col).alias("item"), F.explode(terms_of(F.col(text_col))).alias("term")).distinct()
    counted = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    known = counted.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = asked.join(known.withColumn("w", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))), "term")
    packs = -(-asked.count() // pack) or 1
    packed = weighed.groupBy(F.pmod(F.xxhash64("item"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("item", "term", "w")).alias("asked")).select("asked")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict = {}
        for batch in batches:
            for i in range(len(batch)):
                yield from _answered({c: batch[c][i] for c in batch.schema.names}, n_docs, n_terms, k, floors)
        give_back()

    kinds = [x.schema[c].dataType for x, c in ((asked, "item"), (shards, "ids"))]
    pairs = small_batches(shards.select("ids", "lengths", "terms", "dfs", "places", "tfs")).crossJoin(packed)
    best = pairs.mapInArrow(found, f"item_id {kinds[0].simpleString()}, doc_id {kinds[1].elementType.simpleString()}, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _answered(row: dict[str, pa.Scalar], n_docs: int, n_terms: int, k: int, floors: dict) -> Iterator[pa.RecordBatch]:
    """A shard's best documents for a pack of items; ``floors`` has each item's k-th best score of the task's shards so far."""
    lengths, places, tfs = (_unpacked(row[c].as_py(), t) for c, t in (("lengths", np.int64), ("places", np.int32), ("tfs", np.int32)))
    m = 10 + (90 * lengths * n_docs) // n_terms
    asked, ids = row["asked"].values, row["ids"].values
    items, words, weights = (asked.field(c) for c in ("item", "term", "w"))
    at = pc.index_in(words, value_set=row["terms"].values)
    ends = np.cumsum(row["dfs"].values.to_numpy())
    lists, wanted = {}, {}
    for item, term, w in zip(items.to_pylist(), at.to_pylist(), weights.to_pylist()):
        if term is None or w <= 0:
            continue
        if term not in lists:
            where = slice(ends[term - 1] if term else 0, ends[term])
            tf = tfs[where].astype(np.int64)
            gains = w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[places[where]]))
            lists[term] = places[where], gains, int(gains.max())
        wanted.setdefault(item, []).append(lists[term])
    out: list[tuple] = []
    for item, mine in wanted.items():
        best = floors.setdefault(item, [])
        able, scores = maxscore(mine, len(lengths), k, best[-1] if len(best) == k else 0)
        rows = sorted(zip((-scores).tolist(), ids.take(pa.array(able)).to_pylist()), key=lambda x: (x[0], x[1] is None, x[1]))[:k]
        floors[item] = sorted([*best, *(-x[0] for x in rows)], reverse=True)[:k]
        out += [(item, doc, -score) for score, doc in rows]
    if out:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (items.type, ids.type, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``search`` over an index written for it."""
    scratch = Scratch(docs.sparkSession)
    return search(scratch.write(index(docs), "index"), items, k)


ORACLE_SQL = r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL), docs AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS big, sum(n)::BIGINT AS total FROM docs), dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * big + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM dfs, whole),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN docs USING (doc_id), whole GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""
