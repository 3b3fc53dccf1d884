"""Best-fit packing of documents into token sequences by hierarchical residual packing.

Each partition packs its own pieces best-fit, largest first.  Bins that are nearly full
are done; the others become items of their fill, met by those of other partitions in
a tree of ever fewer tasks, each packing best-fit again.  A piece's sequence and
offset follow from a chain of (item -> bin, offset) maps, one a round, so no bin's
members are ever gathered.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: The byte-level vocabularies' own pattern of what is encoded apart; fixed.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with a run of white space this long go to the tokenizer itself: the faster encoder's stack ends at some.
LONG_SPACE = 10_000


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if it prints, else those from 256 on in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, the same as the tokenizer's.

    Where a vocabulary file is byte-level BPE without more to it, and its merges make ids in order, the rank of a merge is its
    id, which is what the faster encoder of ``tiktoken`` goes by; other files, and texts that name
    an added token or have very long white space, go to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.path = path
        self.added = [x["content"] for x in described["added_tokens"]]
        self.space = re.compile(rf"\s{{{LONG_SPACE}}}")
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=self._ranks(described["model"]), special_tokens={}) if self._plain(described) else None

    @staticmethod
    @functools.cache
    def of(path: str) -> Encoder:
        """The process's encoder of a file, which later tasks in it use again."""
        return Encoder(path)

    @functools.cached_property
    def tokenizer(self) -> tokenizers.Tokenizer:
        return tokenizers.Tokenizer.from_file(self.path)

    def _ranks(self, model: dict) -> dict[bytes, int]:
        byte = _bytes_of_letters()
        return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}

    @staticmethod
    def _plain(described: dict) -> bool:
        model, before = described["model"], described["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return False
        if described["normalizer"] or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        return all(a < b for a, b in pairwise([255, *made]))

    def encode(self, text: str) -> bytes:
        odd = any(x in text for x in self.added) or (len(text) >= LONG_SPACE and self.space.search(text))
        if self.fast is None or odd:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, CRC-32) of a document's ids; only the first piece may be short of the capacity."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    bounds = [0, *range(first, n + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset there, and the fill of its bin.

    Open bins are stacked by residual; a bit mask of residuals with an open bin gives the
    smallest one that an item fits into.
    """
    bins, offsets, fills = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fitting = mask >> n
        if fitting:
            residual = n + (fitting & -fitting).bit_length() - 1
            b = stacks[residual].pop()
            if not stacks[residual]:
                mask &= ~(1 << residual)
        else:
            b, residual = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if residual > n:
            stacks[residual - n].append(b)
            mask |= 1 << (residual - n)
    return bins, offsets, np.array(fills, dtype=np.int64)[bins] if len(fills) else bins


def _packer(length: str, capacity: int, round_: int):
    """Packs a partition's rows by their column ``length``; adds bin, offset and fill."""

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        bins, offsets, fills = best_fit(rows[length].to_numpy(), capacity)
        # A task's number is the same when it is run again, so its bins keep their ids.
        bins += (round_ << 58) + (TaskContext.get().partitionId() << 32)
        for name, x in (("bin", bins), ("at", offsets), ("fill", fills)):
            rows = rows.append_column(name, pa.array(x))
        yield from rows.to_batches()

    return pack_partition


def pack_items(items: DataFrame, capacity: int, length: str = "length", slack: int = 8, fan_in: int = 8, per_task: int = 200_000) -> DataFrame:
    """Pack rows of at most ``capacity`` into bins; adds ``sequence_id`` and ``offset`` (long).

    Bins with up to ``slack`` of their capacity left are done at once.  The others merge
    ``fan_in`` tasks to one, as long as a task gets no more than ``per_task`` items; where that
    bound holds the tasks apart, rounds go on until one saves less than a bin in a thousand.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    packed = cut(items.mapInArrow(_packer(length, capacity, 0), f"{schema}, bin long, at long, fill long"))
    tasks, round_, maps = packed.rdd.getNumPartitions(), 0, []
    under = packed
    while True:
        under = under.filter((F.col("at") == 0) & (F.col("fill") < capacity - slack)).select(F.col("bin").alias("item"), F.col("fill").alias("size"))
        n = under.count()
        least = -(-n // per_task)
        if n < 2 or (round_ and tasks == 1):
            break
        before, tasks, round_ = tasks, max(1, least, -(-tasks // fan_in)), round_ + 1
        under = cut(under.repartition(tasks).mapInArrow(_packer("size", capacity, round_), "item long, size long, bin long, at long, fill long"))
        maps.append(under.select("item", F.col("bin").alias("to"), F.col("at").alias("shift")))
        if before == tasks and under.filter(F.col("at") > 0).count() * 1000 < n:
            break
    out = packed.drop("fill")
    for step in maps:  # a bin that was done has no entry and keeps its id
        out = out.join(step, out["bin"] == step["item"], "left")
        out = out.withColumns({"bin": F.coalesce("to", "bin"), "at": F.col("at") + F.coalesce("shift", F.lit(0))}).drop("item", "to", "shift")
    return out.withColumnsRenamed({"bin": "sequence_id", "at": "offset"})


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``capacity`` tokens.

    ``vocabulary`` is the path of a byte-level BPE file for the tokenizers library.  A
    document's ids are its text's, then ``end_id``.  Longer ones are cut into pieces of
    ``capacity``, of which the first may be shorter; all others stay whole.  Returns a row per
    piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Defined cases: a null text is an empty one, a piece of just ``end_id``; a null id stays
    null; repeated rows are packed each; an empty table gives an empty result; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for batch in (whole.slice(k, 1000) for k in range(0, len(whole), 1000)):
                where, found = [], []
                for i, text in enumerate(batch["text"].to_pylist()):
                    cuts = pieces_of(encoder.encode(text) + end, capacity)
                    where += [i] * len(cuts)
                    found += cuts
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(where, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = small_batches(rows).mapInArrow(tokenized, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return pack_items(pieces, capacity, **how)
