"""Importance resampling towards a target's distribution of word n-grams, by a dictionary of distinct strings.

The corpus is worked on in blocks of texts.  A block's distinct n-grams, with their counts, go to the
dictionary's shards: there the strings of all blocks are counted, every distinct string is hashed to its bucket
once, and the buckets' totals give each bucket's gain.  A shard answers each block with the buckets of the strings
that it sent, in their order, and a block adds the gains up over its documents' n-grams.

A block's strings are sorted and travel compressed, about 5 bytes each on the given tables.  Shards grow in number with the text, so
that one holds about ``SHARD_BYTES`` of it; a string of any frequency comes once from a block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, free_shuffles, give_back, mix, small_batches
from .terms import terms, text_blocks

BLOCK_BYTES, SHARD_BYTES = 8 << 20, 6 << 20


def _packed(x: np.ndarray | memoryview) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x) if isinstance(x, np.ndarray) else x)


def _unpacked(x: bytes, kind: type | None = None) -> np.ndarray | bytes:
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if kind is None else np.frombuffer(raw, dtype=kind)


class _Grams:
    """A block's distinct runs of 1 to 3 terms, in an order that follows from the block's terms alone."""

    def __init__(self, at: np.ndarray, size: int, bounds: np.ndarray, counted: bool = False):
        """``at``: the block's terms as places among its ``size`` sorted distinct ones.  Grams are ``counted``, or else known by place for ``sums``."""
        text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        self.size = size
        self.two, self.three = np.flatnonzero(text[1:] == text[:-1]), np.flatnonzero(text[2:] == text[:-2])
        del text
        self.pairs, pair = np.unique(at[self.two] * size + at[self.two + 1], return_inverse=True)
        pair_at = np.zeros(len(at), dtype=np.int32)
        pair_at[self.two] = pair
        triples = pair_at[self.three] * np.int64(size) + at[self.three + 2]
        if counted:
            self.triples, threes = np.unique(triples, return_counts=True)
            self.counts = np.concatenate([np.bincount(at, minlength=size), np.bincount(pair, minlength=len(self.pairs)), threes])
        else:
            self.triples, triple = np.unique(triples, return_inverse=True)
            self.at, self.pair, self.triple = at, pair.astype(np.int32), triple.astype(np.int32)

    def dealt(self, marks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The grams by shard, and their shards; a gram's shard goes by its first two terms, so it holds a pair with all the triples that begin so."""
        marks = marks.astype(np.uint64)
        with np.errstate(over="ignore"):
            pairs = mix(marks[self.pairs // self.size] * np.uint64(0x9E3779B97F4A7C15) + marks[self.pairs % self.size])
            of = np.concatenate([mix(marks), pairs, pairs[self.triples // self.size]]) % np.uint64(n)
        of = of.astype(np.int16 if n < 1 << 15 else np.int64)
        order = np.argsort(of, kind="stable")
        return order, of[order]

    def lines(self, words: pa.BinaryArray) -> tuple[pa.BinaryArray, pa.BinaryArray]:
        """The terms, and the pairs as terms joined by a blank, each ended by a line break."""
        ended = pc.binary_join_element_wise(words, pa.scalar(b"\n"), b"")
        return ended, pc.binary_join_element_wise(words.take(pa.array(self.pairs // self.size)), ended.take(pa.array(self.pairs % self.size)), b" ")

    def sums(self, gains: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The sum of a number for each gram over the grams of each text."""
        each = gains[self.at].astype(np.int64)
        each[self.two] += gains[self.size + self.pair]
        each[self.three] += gains[self.size + len(self.pairs) + self.triple]
        total = np.concatenate([[0], np.cumsum(each)])
        return total[bounds[1:]] - total[bounds[:-1]]


def _read(raws: list[bytes]) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray, str]:
    """A block's terms as places among its sorted distinct ones, these, its texts' bounds, and a mark of its content."""
    at, words, bounds = terms(raws)
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    mark = hashlib.md5(np.ascontiguousarray(bounds))
    for raw in raws:
        mark.update(raw)
    return rank[at], words.take(pa.array(order)), bounds, mark.hexdigest()


def _bytes(n: np.ndarray) -> bytes:
    """Counts, mostly small ones, packed as bytes; those from 255 on follow whole."""
    return _packed(np.concatenate([np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype(np.int64).view(np.uint8)]))


def _counts(packed: bytes, size: int) -> np.ndarray:
    raw = _unpacked(packed, np.uint8)
    n = raw[:size].astype(np.int64)
    n[n == 255] = raw[size:].copy().view(np.int64)
    return n


def _text(lines: pa.BinaryArray) -> bytes:
    ends = np.frombuffer(lines.buffers()[1], dtype=np.int32)
    return _packed(memoryview(lines.buffers()[2])[: ends[len(lines)]])


def _strings(packed: bytes) -> pa.BinaryArray:
    """The lines of a text without their breaks."""
    raw = np.frombuffer(_unpacked(packed), dtype=np.uint8)
    broken = raw == 10
    at = np.flatnonzero(broken)
    offsets = np.concatenate([[0], at - np.arange(len(at))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~broken])])


def _marks(words: pa.BinaryArray) -> np.ndarray:
    """A number for each term, by which grams are dealt to shards."""
    return np.array([zlib.crc32(x) for x in words.to_pylist()], dtype=np.uint32)


def _messages(shards: int, target: bool, block_bytes: int):
    """Blocks to ``block, shard, target, ones, pairs, thirds, following, counts``: what a block tells each shard of the dictionary.

    A triple is sent as its third term: ``following`` has how many triples begin with each pair.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raws in text_blocks(batches, block_bytes):
            at, words, bounds, block = _read(raws)
            if not len(at):
                continue
            grams = _Grams(at, len(words), bounds, counted=True)
            size, pairs, triples, counts = grams.size, len(grams.pairs), grams.triples, grams.counts
            order, of = grams.dealt(_marks(words), shards)
            ones, twos = grams.lines(words)
            following = np.diff(np.searchsorted(triples, np.arange(pairs + 1) * size))
            del at, grams, words
            cuts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                mine = order[a:b]
                first, second = np.searchsorted(mine, [size, size + pairs])
                two = mine[first:second] - size
                yield pa.record_batch({
                    "block": [block], "shard": pa.array([of[a]], pa.int64()), "target": [target], "ones": [_text(ones.take(pa.array(mine[:first])))], "pairs": [_text(twos.take(pa.array(two)))],
                    "thirds": [_text(ones.take(pa.array(triples[mine[second:] - size - pairs] % size)))], "following": [_bytes(following[two])], "counts": [_bytes(counts[mine])],
                })
            del ones, twos, triples, counts, order, of
        give_back()

    return told


def _dictionary(buckets: int):
    """A shard's messages to ``block, shard, answer, totals, target``: the buckets of each block's grams in order, and all grams' counts by bucket."""
    small = np.uint16 if buckets <= 1 << 16 else np.uint32

    def counted(messages: pa.Table) -> pa.Table:
        parts, counts, lengths = [], [], []
        for x in messages.select(["ones", "pairs", "thirds", "following", "counts"]).to_pylist():
            pairs = _strings(x["pairs"])
            heads = pairs.take(pa.array(np.repeat(np.arange(len(pairs)), _counts(x["following"], len(pairs)))))
            mine = [_strings(x["ones"]), pairs, pc.binary_join_element_wise(heads, _strings(x["thirds"]), b" ")]
            lengths.append(sum(map(len, mine)))
            counts.append(_counts(x["counts"], lengths[-1]))
            parts += mine
        encoded = pa.chunked_array(parts).dictionary_encode()
        at, found = np.concatenate([x.indices.to_numpy() for x in encoded.chunks]), encoded.chunk(0).dictionary  # all chunks share one
        del parts, mine, pairs, heads, encoded
        raw, ends = found.buffers()[2].to_pybytes(), np.frombuffer(found.buffers()[1], dtype=np.int32)[: len(found) + 1].tolist()
        of = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])), dtype=np.int64, count=len(ends) - 1) % buckets
        del raw, found
        ends = np.cumsum(lengths)
        shard, target = messages["shard"][0].as_py(), messages["target"].to_pylist()
        rows = []
        totals = {kind: np.zeros(len(of), dtype=np.int64) for kind in set(target)}
        for block, goal, n, end in zip(messages["block"].to_pylist(), target, counts, ends):
            mine = at[end - len(n) : end]  # a block has a string once
            totals[goal][mine] += n
            if not goal:
                rows.append((block, shard, _packed(of[mine].astype(small)), None, goal))
        for goal, each in totals.items():
            sums = np.zeros(buckets, dtype=np.int64)
            np.add.at(sums, of, each)
            rows.append((None, shard, None, sums.tolist(), goal))
        give_back()
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["block", "shard", "answer", "totals", "target"])

    return counted


def bucket_gains(totals: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    size = len(totals)
    s, t = totals.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def _encoded(block_bytes: int):
    """Blocks to ``block, ids, bounds, at, marks``: their documents' ids and terms, and the terms' marks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in text_blocks(batches, block_bytes):
            at, words, bounds, block = _read(raws)
            yield pa.record_batch({
                "block": [block], "ids": pa.ListArray.from_arrays(pa.array([0, len(raws)], pa.int32()), ids), "bounds": [_packed(bounds)],
                "at": [_packed(at.astype(np.int32))], "marks": [_packed(_marks(words))],
            })
        give_back()

    return read


def _weighed(shards: int, gains: np.ndarray):
    """A block's documents and the dictionary's answers to ``id, n_words, n_features, weight``."""
    small = np.uint16 if len(gains) <= 1 << 16 else np.uint32

    def joined(rows: pa.Table) -> pa.Table:
        told = rows.filter(pc.is_valid(rows["answer"]))
        answers = dict(zip(told["shard"].to_pylist(), told["answer"].to_pylist()))  # blocks of equal content get equal answers
        out = [pa.table({"id": pa.array([], rows.schema.field("ids").type.value_type), **{c: pa.array([], pa.int64()) for c in ("n_words", "n_features", "weight")}})]
        for row in rows.filter(pc.is_null(rows["answer"])).select(["ids", "bounds", "at", "marks"]).to_batches():
            for i in range(len(row)):
                bounds, at, marks = (_unpacked(row[c][i].as_py(), kind) for c, kind in (("bounds", np.int64), ("at", np.int32), ("marks", np.uint32)))
                n, weight = np.diff(bounds), np.zeros(len(bounds) - 1, dtype=np.int64)
                if len(at):
                    grams = _Grams(at.astype(np.int64), len(marks), bounds)
                    order, of = grams.dealt(marks, shards)
                    wanted = np.unique(of).tolist()
                    if any(k not in answers for k in wanted):
                        raise RuntimeError("the documents didn't come in the same blocks twice: write them to a table first")
                    gain = np.empty(len(of), dtype=np.int64)
                    gain[order] = gains[np.concatenate([_unpacked(answers[k], small) for k in wanted])]
                    weight = grams.sums(gain, bounds)
                out.append(pa.table({"id": row["ids"][i].values, "n_words": n, "n_features": n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0), "weight": weight}))
        return pa.concat_tables(out)

    return joined


def gumbel(id_col: str, seed: str) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h being the first 8 hex digits of sha256 of ``seed:id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, buckets: int = 10_000, least_words: int = 20, seed: str = "42",
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Draw ``percent`` of the documents, without replacement, by how much likelier their n-grams are in ``target``.

    Returns ``doc_id, n_words, n_features, weight, score, rank`` for every row: features are runs of 1 to 3 terms with
    repeats, weight adds up their buckets' gains, score is weight plus Gumbel noise of the id, and rank counts the drawn rows from 1, best
    first, ties to the smaller id (null for the others).  Of the N documents with ``least_words`` terms, floor(percent N / 100) are drawn.

    ``docs`` is read twice, once for the dictionary and once for the scores; the rows must come in the same order and parts, as
    those of files do, else the run ends with an error.

    Defined cases: a null text has no terms (weight 0); a null id counts as an empty string in the noise and comes last among ties; rows with equal
    ids are rows of their own, and wholly equal rows are interchangeable; a text of any length is worked on whole, in one
    block; an empty corpus gives an empty result, an empty target gains from its own smoothing alone; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    wanted = target.select(F.lit(None).cast("int").alias("id"), F.col(target_col).alias("text"))
    size = sum(x.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for x in (rows, wanted))
    shards = -(-size // shard_bytes) or 1
    schema = "block string, shard long, target boolean, ones binary, pairs binary, thirds binary, following binary, counts binary"
    told = rows.mapInArrow(_messages(shards, False, block_bytes), schema).unionByName(wanted.mapInArrow(_messages(shards, True, block_bytes), schema))
    answered = told.groupBy("shard").applyInArrow(_dictionary(buckets), "block string, shard long, answer binary, totals array<long>, target boolean")
    dictionary = scratch.write(answered, "dictionary")
    sums = dictionary.filter("block is null").select("target", F.posexplode("totals").alias("bucket", "n")).groupBy("target", "bucket").agg(F.sum("n").alias("n"))
    totals = np.zeros((2, buckets), dtype=np.int64)
    for x in sums.collect():  # two numbers a bucket at most
        totals[int(x["target"]), x["bucket"]] = x["n"]
    free_shuffles(docs.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    encoded = rows.mapInArrow(_encoded(block_bytes), f"block string, ids array<{kind}>, bounds binary, at binary, marks binary")
    both = encoded.unionByName(dictionary.filter("block is not null and answer is not null").select("block", "shard", "answer"), allowMissingColumns=True)
    weighed = both.groupBy("block").applyInArrow(_weighed(shards, bucket_gains(*totals)), f"id {kind}, n_words long, n_features long, weight long")
    scored = scratch.write(weighed.withColumn("score", F.col("weight") + gumbel("id", seed)), "scored")
    return _drawn(scored, percent, least_words).withColumnRenamed("id", "doc_id")


def _drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """The rows with the rank of those drawn: range-partitioned by score, a row's rank is its partition's offset and its place there."""
    able = scored.filter(F.col("n_words") >= least_words).withColumn("tie", F.monotonically_increasing_id())
    order = [F.desc("score"), F.col("id").asc_nulls_last(), "tie"]
    partitions = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    able = cut(able.repartitionByRange(partitions, *order).sortWithinPartitions(*order).drop("tie")).withColumn("part", F.spark_partition_id())
    sizes = {x["part"]: x["count"] for x in able.groupBy("part").count().collect()}  # a number a partition
    drawn, offsets, n = percent * sum(sizes.values()) // 100, {}, 0
    for part in sorted(sizes):
        offsets[part] = n
        n += sizes[part]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if len(batch):
                place = offsets[batch["part"][0].as_py()] + seen + np.arange(1, len(batch) + 1)
                seen += len(batch)
                yield batch.drop_columns("part").append_column("rank", pa.array(place, mask=place > drawn))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema)
    ranked = able.mapInArrow(placed, f"{kinds}, rank long")
    return ranked.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


#: The query's rows in DuckDB SQL, which has no CRC-32: it is taken byte by byte from a table that follows from the polynomial.
ORACLE_SQL = r"""WITH crcs AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
words AS (SELECT doc_id, 0 AS goal, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT NULL, 1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
grams AS (SELECT doc_id, goal, unnest(flatten([w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) AS gram FROM words),
counts AS (SELECT doc_id, goal, gram, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT gram, sum(n) FILTER (goal = 0) AS s, sum(n) FILTER (goal = 1) AS t FROM counts GROUP BY gram),
hashed AS (SELECT gram, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(encode(gram))) // 2), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM totals, crcs),
sums AS (SELECT bucket, coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums),
weights AS (SELECT doc_id, sum(n * gain) AS weight FROM counts JOIN hashed USING (gram) JOIN gains USING (bucket) WHERE goal = 0 GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE goal = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, (n + greatest(n - 1, 0) + greatest(n - 2, 0))::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN n >= 20 AND place <= 5 * (SELECT count(*) FROM scored WHERE n >= 20) // 100 THEN place END AS rank FROM placed"""
