import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stallwise.llm import sharding


def placed(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, Size int")
    return [tuple(x) for x in sharding.shard(docs.repartition(3), **how).collect()]


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 500])
def test_counts_slots_and_digests(spark, n):
    rows = [(i, f"täxt {i % 7} " * (i % 50), "x", 1) for i in range(n)]
    out = placed(spark, rows, shards=40)
    assert sorted(x[0] for x in out) == list(range(n))
    by = Counter(x[3] for x in out)
    loads = [by[s] for s in range(40)]
    assert sum(loads) == n and max(loads) - min(loads) <= 1
    slots = defaultdict(list)
    for _, _, _, shard, slot in out:
        slots[shard].append(slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    texts = {i: t for i, t, *_ in rows}
    assert all(size == len(texts[i].encode()) + 16 and crc == zlib.crc32(texts[i].encode()) for i, size, crc, *_ in out)


def test_nulls_and_repeated_rows(spark):
    rows = [(None, None, None, None)] * 3 + [(7, "", "a", 1)] * 50 + [(7, "b", "a", 1), (2**62 + 1, "é", None, 2)]
    out = placed(spark, rows, shards=5)
    assert len(out) == len(rows)
    assert Counter(x[0] for x in out) == Counter(x[0] for x in rows)
    assert sorted(Counter(x[3] for x in out).values()) == [11] * 5
    assert {x[1:3] for x in out if x[0] is None} == {(16, 0)}


def test_layout_does_not_matter(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text")
    one = sorted(sharding.shard(docs.repartition(7)).collect())
    assert one == sorted(sharding.shard(docs.repartition(2)).collect())


def brute(positions, points, owners, room):
    """Keys one by one: home keys in ring order, then the others clockwise to the first shard with room."""
    room, homes, late = list(room), {}, []
    arc = {p: int(np.searchsorted(points, p)) % len(points) for p in positions}
    # the keys past the last point precede the first arc's other keys in place order only at the end
    order = sorted(positions, key=lambda p: (arc[p], p))
    for p in order:
        s = owners[arc[p]]
        if room[s]:
            room[s] -= 1
            homes[p] = s
        else:
            late.append(p)
    for p in late:
        j = (arc[p] + 1) % len(points)
        while not room[owners[j]]:
            j = (j + 1) % len(points)
        room[owners[j]] -= 1
        homes[p] = owners[j]
    return homes


@pytest.mark.parametrize("factor", [1.0, 1.25])
def test_against_one_key_at_a_time(spark, factor):
    rows = [(i, "", "", 0) for i in range(400)]
    out = placed(spark, rows, shards=6, vnodes=8, load_factor=factor)
    pos = {x.id: x.p for x in spark.range(400).selectExpr("id", "xxhash64(id) p").collect()}
    points, owners = sharding.ring(6, 8)
    want = brute(list(pos.values()), points, owners, sharding.capacities(400, 6, factor))
    assert Counter(x[3] for x in out) == Counter(want.values())
    assert {x[0]: x[3] for x in out} == {i: want[p] for i, p in pos.items()}


def test_only_overload_moves():
    points, owners = sharding.ring(10, 16)
    counts = np.random.default_rng(1).integers(0, 40, len(points))
    natural = np.bincount(owners, weights=counts, minlength=10)
    room = sharding.capacities(int(counts.sum()), 10, 1.1)
    moved, i = 0, 0
    splits = sharding.place_arcs(counts, owners, room)
    for n, s in zip(counts, owners):
        while n:
            k, to = splits[i]
            moved += k * (to != s)
            n -= k
            i += 1
    assert moved == sum(max(0, x - r) for x, r in zip(natural, room))


def test_a_grown_ring_only_adds_points():
    a, b = sharding.ring(10, 16), sharding.ring(11, 16)
    assert set(zip(*a)) < set(zip(*b)) and len(b[0]) == len(a[0]) + 16
