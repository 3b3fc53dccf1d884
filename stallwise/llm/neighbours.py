"""Approximate nearest neighbours by collision counting: single projections kept as sorted arrays, windows around the query that widen.

A vector is projected on ``projections`` random directions.  Two vectors at a distance of R or less lie within R of each other on one of
them with a chance of p = P(|N(0, 1)| <= 1) = 0.68 at least, so they collide on about p of all.  For R rising by ``growth``, a query's windows
of half-width R collect collisions from the sorted arrays, each level only what the last one hadn't; a vector with
``threshold`` collisions is verified, by its true distance.  A shard's search ends when its k-th verified distance is at most R.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back

#: The chance that two vectors at a distance of R lie within R on a random direction.
NEAR = math.erf(1 / math.sqrt(2))


def threshold(projections: int, slack: float = 2.0) -> int:
    """Collisions that make a candidate: ``slack`` standard deviations below what a vector at the distance R expects, so about 2% of those are missed."""
    return max(1, math.floor(projections * NEAR - slack * math.sqrt(projections * NEAR * (1 - NEAR))))


def directions(projections: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((projections, dim))


def sound(vector: str) -> Column:
    """Whether a vector takes part: it has components, all of them finite and not all of them 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """A task's vectors as matrices of up to ``size`` rows, those of one length together."""
    held: dict[int, list] = {}

    def whole(dim: int) -> tuple[pa.Array, np.ndarray]:
        ids, flat = zip(*held.pop(dim))
        return pa.concat_arrays(ids), np.concatenate(flat).reshape(-1, dim)

    for batch in batches:
        lengths = np.diff(batch["vector"].offsets.to_numpy())
        for dim in np.unique(lengths).tolist():
            mine = batch.filter(pa.array(lengths == dim))
            while len(mine):
                room = size - sum(len(x[0]) for x in held.get(dim, []))
                some = mine.slice(0, room)
                held.setdefault(dim, []).append((some["id"], _vectors(some["vector"])))
                mine = mine.slice(room)
                if len(some) == room:
                    yield whole(dim)
    for dim in list(held):
        yield whole(dim)


def index(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", projections: int = 64, size: int = 8192, seed: int = 7) -> DataFrame:
    """Every sound vector in shards of up to ``size``: ``ids, dim, vectors, sorted, places``, a row a shard.

    ``sorted`` has the shard's values on each direction, rising, and ``places`` whose they are.  Nothing is fitted; directions come from the seed.
    """
    kind = rows.schema[key].dataType.simpleString()

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _blocks(batches, size):
            values = directions(projections, vectors.shape[1], seed) @ vectors.T
            places = np.argsort(values, axis=1, kind="stable").astype(np.int32)
            yield pa.record_batch({
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "dim": pa.array([vectors.shape[1]], pa.int32()), "vectors": [vectors.tobytes()],
                "sorted": [np.take_along_axis(values, places, axis=1).tobytes()], "places": [places.tobytes()],
            })
        give_back()

    return _kept(rows, key, vector).mapInArrow(indexed, f"ids array<{kind}>, dim int, vectors binary, sorted binary, places binary")


def _kept(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull() & sound(vector)).select(F.col(key).alias("id"), F.col(vector).alias("vector"))


class Shard:
    """A shard's vectors and sorted arrays, with what a search of it needs."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, values: np.ndarray, places: np.ndarray, growth: float):
        self.ids, self.vectors, self.values, self.places = ids, vectors, values, places
        # The first windows are a small part of the values' spread; the last ones hold everything.
        spread = float(values.std(axis=1).mean()) or 1.0
        reach = max(2.0, float((values[:, -1] - values[:, 0]).max()) / spread)
        self.radii = spread / 8 * growth ** np.arange(math.ceil(math.log(8 * reach, growth)) + 1)

    def search(self, q: np.ndarray, at: np.ndarray, own, k: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the verified vectors, all that may be among the k nearest; ``at`` is the query on each direction."""
        n = len(self.ids)
        low = np.array([np.searchsorted(v, x - self.radii, side="left") for v, x in zip(self.values, at)])
        high = np.array([np.searchsorted(v, x + self.radii, side="right") for v, x in zip(self.values, at)])
        hits, seen = np.zeros(n, dtype=np.int64), self.ids == own
        found, distances = [], []
        start = low[:, 0]
        before = (start, start)
        for level, radius in enumerate(self.radii):
            left, right = low[:, level], high[:, level]
            fresh = [p[a:b] for p, a, b in zip(self.places, left, before[0]) if a < b] + [p[a:b] for p, a, b in zip(self.places, before[1], right) if a < b]
            before = (left, right)
            if fresh:
                hits += np.bincount(np.concatenate(fresh), minlength=n)
            new = np.flatnonzero((hits >= needed) & ~seen) if level + 1 < len(self.radii) else np.flatnonzero(~seen)
            if len(new):
                seen[new] = True
                found.append(new)
                distances.append(np.sqrt(((self.vectors[new] - q) ** 2).sum(axis=1)))
                every = np.concatenate(distances)
                if len(every) >= k and np.partition(every, k - 1)[k - 1] <= radius:
                    break
        return (np.concatenate(found), np.concatenate(distances)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0))


def search(
    shards: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", projections: int = 64, slack: float = 2.0, growth: float = 1.25, seed: int = 7, pack: int = 512
) -> DataFrame:
    """The k nearest vectors found for each query: ``query_id, rank, vec_id, score``, score being the Euclidean distance in doubles, ties to the smaller id.

    Queries meet the shards in packs of up to ``pack``, and a shard's k nearest of a query go on to a window.  ``projections`` and ``seed`` are those of the index.

    Defined cases: null, empty and zero vectors and those with null or non-finite components take no part, nor do rows without an id; a query's candidates
    are the rows with other ids and as many components; rows with equal ids are candidates of their own, and queries with equal ids are one query, whose answers
    are the nearest of all of them; empty tables give an empty result; other columns are ignored.
    """
    needed = threshold(projections, slack)
    kind = queries.schema[key].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _blocks(batches, pack):
            yield pa.record_batch({"asked": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "asked_dim": pa.array([vectors.shape[1]], pa.int32()), "asked_vectors": [vectors.tobytes()]})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, dim = batch["ids"][i].values, batch["dim"][i].as_py()
                if batch["asked_dim"][i].as_py() != dim:
                    continue
                own = ids.to_numpy(zero_copy_only=False)
                flat, values, places = (np.frombuffer(batch[c][i].as_py(), dtype=t) for c, t in (("vectors", np.float64), ("sorted", np.float64), ("places", np.int32)))
                shard = Shard(own, flat.reshape(-1, dim), values.reshape(projections, -1), places.reshape(projections, -1), growth)
                asked, q = batch["asked"][i].values, np.frombuffer(batch["asked_vectors"][i].as_py(), dtype=np.float64).reshape(-1, dim)
                at = (directions(projections, dim, seed) @ q.T).T
                for j, name in enumerate(asked.to_numpy(zero_copy_only=False)):
                    near, distance = shard.search(q[j], at[j], name, k, needed)
                    best = np.lexsort((own[near], distance))[:k]
                    if len(best):
                        yield pa.RecordBatch.from_arrays([asked.take(pa.array(np.full(len(best), j))), ids.take(pa.array(near[best])), pa.array(distance[best])], names=["query_id", "vec_id", "score"])
        give_back()

    packs = _kept(queries, key, vector).mapInArrow(packed, f"asked array<{kind}>, asked_dim int, asked_vectors binary")
    pairs = shards.crossJoin(packs)  # a join on ``dim`` would bring the shards, whose lengths are mostly one, to one task
    best = pairs.mapInArrow(found, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", **how) -> DataFrame:
    """``search`` over an index written for it."""
    parts = {c: how.pop(c) for c in ("size",) if c in how}
    built = {c: how[c] for c in ("projections", "seed") if c in how}
    shards = Scratch(rows.sparkSession).write(index(rows, key, vector, **parts, **built), "index")
    return search(shards.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), queries, k, key, vector, **how)
