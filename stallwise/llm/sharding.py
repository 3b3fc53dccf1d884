"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring; a key belongs to the arc that
ends at the next point clockwise.  A shard takes at most its capacity: keys beyond
it go on clockwise to the next point whose shard has room.  Home keys come first,
so exactly the natural overload of each shard moves, and no more.

Only the ring is ever on the driver: counts of at most ``shards * vnodes`` arcs and
one number per partition.  The rows are range-partitioned by their place on the
ring, so a row's global place is its partition's offset plus its place there, and
each arc's split between shards is an interval of such places.  No window, no
group: a hot arc or a thousand equal keys are cut anywhere.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbers


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points of the ring (signed 64-bit) and the shard of each.

    Shard ``s`` has the same points whatever the number of shards, so a grown ring
    only adds points.
    """
    points = np.concatenate([numbers(s + 1, vnodes) for s in range(shards)]).view(np.int64)
    owners = np.repeat(np.arange(shards, dtype=np.int64), vnodes)
    order = np.lexsort((owners, points))
    return points[order], owners[order]


def capacities(rows: int, shards: int, load_factor: float) -> list[int]:
    """Rows each shard may hold.

    A factor of 1 gives capacities that add up to ``rows`` and differ by one at
    most, so every shard ends full; larger factors trade balance for fewer moves.
    """
    if load_factor < 1:
        raise ValueError("load_factor is 1 at least")
    if load_factor == 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [int(-(-rows * load_factor // shards))] * shards


def place_arcs(counts: np.ndarray, owners: np.ndarray, room: list[int]) -> list[tuple[int, int]]:
    """Split each arc's keys between shards: (rows, shard) intervals in ring order.

    ``counts[i]`` keys lie on the arc that ends at point ``i``.
    """
    n, room = len(owners), list(room)
    splits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    over = [0] * n
    for i, shard in enumerate(owners):
        home = min(int(counts[i]), room[shard])
        room[shard] -= home
        if home:
            splits[i].append((home, int(shard)))
        over[i] = int(counts[i]) - home
    following = list(range(1, n)) + [0]

    def with_room(i: int) -> int:
        """The next point clockwise, after ``i``, whose shard has room; the path is shortened."""
        path, j = [i], following[i]
        while room[owners[j]] == 0:
            path.append(j)
            j = following[j]
        for k in path:
            following[k] = j
        return j

    for i in range(n):
        while over[i]:
            j = with_room(i)
            some = min(over[i], room[owners[j]])
            room[owners[j]] -= some
            over[i] -= some
            splits[i].append((some, int(owners[j])))
    return [x for split in splits for x in split]


def shard(
    docs: DataFrame, shards: int = 40, vnodes: int = 128, load_factor: float = 1.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Place every row of ``docs`` in one of ``shards`` shards.

    Returns ``doc_id, size, text_crc32, shard, slot``: size is the text's UTF-8
    bytes plus 16, text_crc32 its unsigned CRC-32, slot counts a shard's rows from 0
    without gaps.  With the default load factor, shards' row counts differ by one at
    most.  The result depends on the rows alone, not on their layout.

    Defined cases: a null text counts as no bytes (size 16, CRC 0); a null id is a key
    of its own; rows with equal ids lie side by side on the ring, ordered by CRC and size;
    wholly equal rows are interchangeable, and each is placed; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col)).alias("pos"),
    )
    # Wholly equal rows are told apart by where they were read, so that a range bound may fall between them.
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = ["pos", "doc_id", "text_crc32", "size", "tie"]
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).drop("tie"))
    points, owners = ring(shards, vnodes)

    def arc_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arcs = np.searchsorted(points, batch["pos"].to_numpy(), side="left") % len(points)
            found, n = np.unique(arcs, return_counts=True)
            yield pa.record_batch({"part": np.full(len(found), batch["part"][0].as_py() if len(batch) else 0, dtype=np.int32), "arc": found, "n": n})

    at = rows.withColumn("part", F.spark_partition_id())
    counted = at.select("pos", "part").mapInArrow(arc_counts, "part int, arc long, n long").groupBy("part", "arc").agg(F.sum("n").alias("n")).collect()
    arcs = np.zeros(len(points), dtype=np.int64)
    sizes = np.zeros(max((x["part"] for x in counted), default=0) + 2, dtype=np.int64)
    for x in counted:  # at most partitions + arcs entries
        arcs[x["arc"]] += x["n"]
        sizes[x["part"] + 1] += x["n"]
    offsets = np.cumsum(sizes)
    # Places run in order of position; keys past the last point belong to the first arc and come last.
    past = sum(x["n"] for x in counted if x["arc"] == 0) - _first_arc_head(rows, points, arcs[0])
    splits = place_arcs(arcs, owners, capacities(int(arcs.sum()), shards, load_factor))
    starts, homes, slots = _intervals(splits, arcs, past, shards)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if not len(batch):
                continue
            place = offsets[batch["part"][0].as_py()] + seen + np.arange(len(batch))
            seen += len(batch)
            k = np.searchsorted(starts, place, side="right") - 1
            new = [pa.array(homes[k].astype(np.int32)), pa.array(slots[k] + place - starts[k])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["size"], batch["text_crc32"], *new], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return at.select("doc_id", "size", "text_crc32", "part").mapInArrow(placed, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")


def _first_arc_head(rows: DataFrame, points: np.ndarray, first: int) -> int:
    """How many of the first arc's keys lie before its point; the others lie past the last point."""
    if not first:
        return 0
    return rows.filter(F.col("pos") <= int(points[0])).count()


def _intervals(splits: list[tuple[int, int]], arcs: np.ndarray, past: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the intervals of global places, with the shard and the first slot of each.

    The first arc wraps round the ring: its last ``past`` keys come at the end.
    """
    first, taken, i = [], 0, 0
    while taken < arcs[0]:  # the splits of the first arc come first
        first.append(splits[i])
        taken += splits[i][0]
        i += 1
    head, tail, left = [], [], int(arcs[0]) - past
    for n, s in first:
        cut_at = min(n, left)
        left -= cut_at
        if cut_at:
            head.append((cut_at, s))
        if n - cut_at:
            tail.append((n - cut_at, s))
    used, starts, homes, slots, place = [0] * shards, [0], [0], [0], 0
    for n, s in head + splits[i:] + tail:
        starts.append(place)
        homes.append(s)
        slots.append(used[s])
        used[s] += n
        place += n
    return (np.array(x, dtype=np.int64) for x in (starts, homes, slots))


def owner_of(points: np.ndarray, owners: np.ndarray, position: int) -> int:
    """The shard that owns a place on the ring, before loads are bounded."""
    return int(owners[bisect_left(points, position) % len(points)])
