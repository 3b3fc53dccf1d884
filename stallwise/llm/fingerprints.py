"""Document fingerprints by context-triggered piecewise hashing.

A hash rolling over the last few bytes cuts a text into chunks wherever its value
meets a block size; each chunk gives one character of a signature.  A fingerprint holds
the signatures for a block size and its double, so that texts whose lengths differ up to
about twofold still compare.  Likeness is one less the edit distance of signatures
of a common block size, over the longer one's length.

Everything is computed over blocks of whole texts at once: rolling hashes by shifted
sums, chunk hashes by one segmented sum, edit distances for many pairs by bit-parallel
steps over 64-bit words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, numbers, small_batches, written

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
WINDOW, LONGEST, LEAST_BLOCK = 7, 64, 3
_BYTE, _PLACE = numbers(23, 256), numbers(29, 4096)
_SLIDE = numbers(31, WINDOW)


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each window of bytes that ends at a place; shorter windows at the start."""
    out = np.zeros(len(data), dtype=np.uint64)
    term = _BYTE[data]
    for k in range(min(WINDOW, len(data))):
        out[k:] += term[: len(data) - k] * _SLIDE[k]
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def _signature(data: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> bytes:
    """One character per chunk; ``ends`` are the chunks' last places, ascending, the text's last among them."""
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.concatenate([[-1], ends])))
    sums = np.add.reduceat(marks * _PLACE[place & 4095] + (place >> 12).astype(np.uint64), starts)
    return ALPHABET[(mix(sums) >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprint(raw: bytes) -> tuple[int, bytes, bytes]:
    """(block size, signature at it, signature at its double) of a text's bytes; an empty text has empty ones.

    The block size starts at the least for which the text is expected to give at most
    64 chunks and halves while it gives fewer than 32.  Signatures are cut to 64
    characters by joining the chunks past the 63rd.
    """
    if not raw:
        return LEAST_BLOCK, b"", b""
    data = np.frombuffer(raw, dtype=np.uint8)
    with np.errstate(over="ignore"):
        hashes, marks = rolling(data), _BYTE[data]
        block = LEAST_BLOCK
        while block * LONGEST < len(data):
            block *= 2
        last = len(data) - 1

        def ends(size: int) -> np.ndarray:
            at = np.flatnonzero(hashes % np.uint32(size) == size - 1)
            at = at[at < last][: LONGEST - 1]
            return np.append(at, last)

        at = ends(block)
        while block > LEAST_BLOCK and len(at) < LONGEST // 2:
            block //= 2
            at = ends(block)
        return block, _signature(data, at, marks), _signature(data, ends(2 * block), marks)


def text_of(print_: tuple[int, bytes, bytes]) -> str:
    return f"{print_[0]}:{print_[1].decode()}:{print_[2].decode()}"


def distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Edit distances of pairs of signatures of up to 64 characters, all pairs at once, bit-parallel."""
    n = len(left)
    m = np.array([len(x) for x in left], dtype=np.int64)
    table = np.zeros((n, 256), dtype=np.uint64)
    for k in range(max(map(len, left), default=0)):
        rows = np.flatnonzero(m > k)
        table[rows, [left[i][k] for i in rows]] |= np.uint64(1 << k)
    one, zero = np.uint64(1), np.uint64(0)
    top = np.where(m > 0, one << np.maximum(m - 1, 0).astype(np.uint64), zero)
    pv, mv, score = np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64), np.zeros(n, dtype=np.uint64), m.copy()
    sizes = np.array([len(x) for x in right], dtype=np.int64)
    padded = np.zeros((n, max(sizes, default=0)), dtype=np.uint8)
    for i, x in enumerate(right):
        padded[i, : len(x)] = np.frombuffer(x, dtype=np.uint8)
    every = np.arange(n)
    with np.errstate(over="ignore"):
        for k in range(padded.shape[1]):
            eq = table[every, padded[:, k]]
            live = sizes > k
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += np.where(live, ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0), 0)
            ph, mh = (ph << one) | one, mh << one
            pv, mv = np.where(live, mh | ~(xv | ph), pv), np.where(live, ph & xv, mv)
    return np.where(m > 0, score, sizes)


def likeness(pairs: list[tuple[tuple[int, bytes, bytes], tuple[int, bytes, bytes]]]) -> np.ndarray:
    """How alike the fingerprints of each pair are, 0 to 1.

    Block sizes are compatible if equal or one double the other; the best of the common
    ones counts.  Two empty texts are alike; an empty and another are not.
    """
    out, left, right, where = np.zeros(len(pairs)), [], [], []
    for i, ((a, a1, a2), (b, b1, b2)) in enumerate(pairs):
        if not a1 or not b1:
            out[i] = a1 == b1
            continue
        for x, y in ((a1, b1), (a2, b2)) if a == b else ((a2, b1),) if b == 2 * a else ((a1, b2),) if a == 2 * b else ():
            left.append(x)
            right.append(y)
            where.append(i)
    if where:
        longest = np.array([max(len(x), len(y)) for x, y in zip(left, right)])
        np.maximum.at(out, where, 1 - distances(left, right) / longest)
    return out


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by the first as many code points of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


class _Row:
    __slots__ = ("doc_id", "print", "text")

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.print = fingerprint(text.encode("utf-8", "surrogatepass"))


def _compared(rows: list[_Row]) -> list[tuple]:
    """The results of all rows but the last, each against the one after it."""
    pairs, out = [], []
    for row, following in zip(rows, rows[1:]):
        raw = edited(row.text, following.text).encode("utf-8", "surrogatepass")
        changed = fingerprint(raw)
        pairs += [(row.print, changed), (row.print, following.print)]
        out.append((row.doc_id, len(row.text), hashlib.sha256(raw).hexdigest(), text_of(row.print), text_of(changed)))
    near = likeness(pairs).tolist()
    return [(*x, near[2 * i], near[2 * i + 1]) for i, x in enumerate(out)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every row's whole text, and the text with its last half overwritten by the next row's start.

    Rows follow each other by falling id, the first after the last.  Returns ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``: the
    edited text keeps all but its last floor(n_chars / 2) code points, replaced by the
    next text's first as many, or all; near_edited is the likeness of the two fingerprints,
    near_next that to the next row's.

    The texts are range-partitioned by id and walked in order, one batch in memory at a
    time.  A partition's last row needs the next one's first: those two rows a
    partition are kept with the results and joined by the partitions' numbers.

    Defined cases: a null text is an empty one, whose fingerprint has empty signatures; null
    ids come last; rows with equal ids are ordered by a hash of the text, and wholly equal rows are
    interchangeable; a single row follows itself; an empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # Equal rows are told apart by where they were read, so that a range bound may fall between them.
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").desc_nulls_last(), "tie", "place"]
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("doc_id", "text")
    result = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in result.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch_of(ids: pa.Array, found: list[tuple], edges: list[tuple] | None) -> pa.RecordBatch:
        columns = [ids, *(pa.array([x[k + 1] for x in found], t) for k, t in enumerate(types))]
        if edges is None:
            return pa.RecordBatch.from_arrays(columns, names=names)
        extra = [pa.array([x[k] for x in edges], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, "run", "edge", "text"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, blank = TaskContext.get().partitionId(), None, (None,) * 7
        for batch in batches:
            if not len(batch):
                continue
            kind_ = batch["doc_id"].type
            fresh = [_Row(*x) for x in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())]
            if last is None:  # the partition's first row, for the partition before
                yield batch_of(batch["doc_id"].slice(0, 1), [blank], [(run, 0, fresh[0].text)])
                rows_ = fresh
            else:
                rows_ = [last, *fresh]
            found = _compared(rows_)
            yield batch_of(pa.array([x[0] for x in found], kind_), found, [(run, None, None)] * len(found))
            last = rows_[-1]
        if last is not None:
            yield batch_of(pa.array([last.doc_id], kind_), [blank], [(run, 1, last.text)])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            triples = zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["following"].to_pylist())
            found = [_compared([_Row(i, t), _Row(None, f)])[0] for i, t, f in triples]
            yield batch_of(batch["doc_id"], found, None)

    done = written(small_batches(rows).mapInArrow(walked, f"{result}, run int, edge int, text string"), "fingerprints")
    inner = done.filter(F.col("edge").isNull()).select(*names)
    firsts = done.filter("edge = 0").select(F.col("run").alias("start"), F.col("text").alias("following"))
    # Partitions' numbers alone meet in one place; their texts are joined by number, the first partition's after the last's.
    runs = firsts.select("start")
    turns = runs.select(F.col("start").alias("run"), F.lead("start").over(Window.orderBy("start")).alias("next"), F.min("start").over(Window.partitionBy()).alias("least"))
    turns = turns.select("run", F.coalesce("next", "least").alias("start"))
    edges = done.filter("edge = 1").select("doc_id", "run", "text").join(turns, "run").join(firsts, "start").select("doc_id", "text", "following")
    return inner.unionByName(edges.mapInArrow(finished, result))
