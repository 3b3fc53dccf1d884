"""Nearest neighbours by an index of cells: every row is in the cell of its nearest centre, a query looks into the cells nearest to it.

Centres are fitted on a bounded sample.  How many cells a query looks into is chosen on that sample too, so that the wanted share of true neighbours lies in
them; what is in those cells is compared exactly.  ``similarity.nearest_each`` and ``nearest_earlier`` are the exact ways, which compare everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grouping import batch_kmeans
from .ranges import small_batches, written

#: The most cells and sampled rows; rows compared at once.
CELLS, SAMPLE, ASKED, PACK = 1024, 20_000, 200, 2048


def units(rows: DataFrame, key: str, vector: str, digits: int | None = None) -> DataFrame:
    """``id, unit, size``: vectors of length 1, rounded if asked; rows without a key, a whole vector or a direction go."""
    kind = rows.schema[key].dataType.simpleString()
    at = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, flat = np.diff(batch["v"].offsets.to_numpy()), batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            of = np.repeat(np.arange(len(batch)), size)
            with np.errstate(all="ignore"):
                length = np.sqrt(np.bincount(of, weights=flat * flat, minlength=len(batch)))
                live = (length > 0) & np.isfinite(length)
                unit = (flat / length[of])[live[of]]
            unit = unit if digits is None else np.round(unit, digits) + 0.0
            ends = pa.array(np.concatenate([[0], np.cumsum(size[live])]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(live)), pa.ListArray.from_arrays(ends, pa.array(unit)), pa.array(size[live], pa.int32())], names=["id", "unit", "size"])

    return at.mapInArrow(scaled, f"id {kind}, unit array<double>, size int")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows over all tasks, as Spark would leave them in a few that are small in bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The least number of cells in which a query finds that share of its k nearest, counted over some of a sample.

    Neighbours in the whole table are nearer than those in a sample, so there it finds more.
    """
    asked = sample[:ASKED]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    of = (sample @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
    ranks = np.argsort(np.argsort(-(asked @ centres.T - (centres * centres).sum(axis=1) / 2), axis=1), axis=1)
    needed = np.sort(ranks[np.arange(len(asked))[:, None], of[best]].ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1 if len(needed) else len(centres)


class Index:
    """The rows with their cells, written, and what a search needs to know."""

    def __init__(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, recall: float = 0.95, seed: int = 42):
        self.kind = rows.schema[key].dataType.simpleString()
        at = written(dealt(units(rows, key, vector)), "units")
        sizes = at.groupBy("size").count().orderBy(F.desc("count"), "size").first()
        self.size, n = (sizes["size"], sizes["count"]) if sizes else (0, 0)
        # Vectors of other lengths than most are in one cell of their length.
        main = at.filter(F.col("size") == self.size)
        self.centres, self.probes = np.zeros((1, max(1, self.size))), 1
        if n > 4 * k:
            place, chance = F.xxhash64("id", F.lit(seed)), min(1.0, 1.05 * SAMPLE / n)
            fit = main.filter(F.pmod(place, F.lit(1_000_003)) < chance * 1_000_003).orderBy(place, "id").limit(SAMPLE)
            _, self.centres = batch_kmeans(written(fit, "sample"), "id", "unit", min(CELLS, math.ceil(2 * math.sqrt(n))), starts=2, most=SAMPLE, seed=seed, passes=0)
            some = main.select("unit").orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, 5000)).collect()
            self.probes = probes(np.array([x["unit"] for x in some]), self.centres, k, recall)
        self.rows = written(self.placed(at, 1), "cells")

    def placed(self, at: DataFrame, cells: int) -> DataFrame:
        """The rows with the nearest cells to each, nearest first."""
        centres, size = self.centres, self.size

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                usual = batch["size"].to_numpy() == size
                of = np.zeros((len(batch), min(cells, len(centres))), dtype=np.int32)
                if usual.any():
                    far = (centres * centres).sum(axis=1) / 2 - batch["unit"].filter(pa.array(usual)).flatten().to_numpy().reshape(-1, size) @ centres.T
                    first = np.argpartition(far, cells - 1, axis=1)[:, :cells] if cells < len(centres) else np.tile(np.arange(len(centres)), (len(far), 1))
                    of[usual] = np.take_along_axis(first, np.argsort(np.take_along_axis(far, first, axis=1), axis=1), axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * of.shape[1], pa.int32()), pa.array(of.ravel()))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["unit"], batch["size"], lists], names=["id", "unit", "size", "cells"])

        return small_batches(at).mapInArrow(found, f"id {self.kind}, unit array<double>, size int, cells array<int>")

    def shelves(self) -> DataFrame:
        """``size, cell, shelf, of``: shelves of about ``PACK`` rows; small cells share one, a large one has ``of`` of them from ``shelf`` on."""
        counts = self.rows.groupBy("size", F.col("cells")[0].alias("cell")).count()
        upto = F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select("size", "cell", F.floor(upto / PACK).cast("int").alias("shelf"), F.ceil(F.col("count") / PACK).cast("int").alias("of"))

    def search(self, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", earlier: bool = False, all_cells: bool = False, least: float = -2.0) -> DataFrame:
        """``query, key, similarity, rank``: the k most alike rows found for each query, ties by the smallest key; ``earlier``: with smaller keys only; ``least``: as alike as that.

        ``all_cells`` is the exact way.  A pack of queries of neighbouring cells meets the shelves in which any of them looks into a cell, and a query is
        compared with the rows of its own cells there; a vector is in one pack and on one shelf, however many cells are looked into.
        """
        asked = self.placed(dealt(units(queries, key, vector)), len(self.centres) if all_cells else self.probes)
        shelves = written(self.shelves(), "shelves")
        # The cells that a pack's queries look into are on these shelves, of all sizes of vectors.
        held = shelves.select("size", "cell", F.explode(F.sequence(F.col("shelf"), F.col("shelf") + F.col("of") - 1)).alias("shelf")).groupBy("size", "shelf").agg(F.collect_set("cell").alias("held"))
        packs = _packed(asked, shelves)
        wanted = packs.select("size", "ids", "flat", "cells", F.array_distinct(F.flatten("cells")).alias("wanted"))
        stock = _packed(self.rows, shelves).join(F.broadcast(held), ["size", "shelf"]).select(F.col("size").alias("size2"), F.col("ids").alias("ids2"), F.col("flat").alias("flat2"), F.col("cells").alias("cells2"), "held")
        # Each part meets each; parts grow with the packs, so none is large.
        parts = max(1, min(shelves.agg(F.sum("of")).first()[0] or 1, max(12, -(-self.rows.count() // (64 * PACK)))))
        met = (F.col("size") == F.col("size2")) & F.arrays_overlap("wanted", "held")
        pairs = small_batches(wanted.repartition(parts)).crossJoin(stock.repartition(parts)).filter(met).select("ids", "flat", "cells", "ids2", "flat2", F.flatten("cells2").alias("cells2"))
        kind, n_cells = self.kind, len(self.centres)

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for mine, flat, looks, theirs, flat2, of in zip(*(batch[c] for c in ("ids", "flat", "cells", "ids2", "flat2", "cells2"))):
                    a, b = mine.values.to_numpy(zero_copy_only=False), theirs.values.to_numpy(zero_copy_only=False)
                    looked = np.zeros((len(a), n_cells), dtype=bool)
                    looked[np.arange(len(a))[:, None], looks.values.flatten().to_numpy().reshape(len(a), -1)] = True
                    at_cell = of.values.to_numpy()
                    u, w = (x.values.to_numpy(zero_copy_only=False).reshape(n, -1) for x, n in ((flat, len(a)), (flat2, len(b))))
                    parts = []
                    for cell in np.unique(at_cell):  # a cell's rows meet the queries that look into it
                        there, asking = np.flatnonzero(at_cell == cell), np.flatnonzero(looked[:, cell])
                        for i in range(0, len(asking), 512):
                            some = asking[i : i + 512]
                            names, near = a[some, None], u[some] @ w[there].T
                            near[(b[there] >= names) if earlier else (b[there] == names)] = -np.inf
                            kth = near.max(axis=1, initial=-np.inf)[:, None] if k == 1 else np.partition(near, -k, axis=1)[:, -k, None] if len(there) > k else -2
                            # Ties after the rounding are at most one unit of it below the k-th.
                            of_query, at = np.nonzero((near >= np.maximum(kth, least) - 2e-6) & (near > -np.inf))
                            parts.append((some[of_query], there[at], np.round(near[of_query, at], 6) + 0.0))
                    if not parts:
                        continue
                    of_query, at, alike = (np.concatenate(x) for x in zip(*parts))
                    order = np.lexsort((b[at], -alike, of_query))
                    of_query, at, alike = of_query[order], at[order], alike[order]
                    best = np.arange(len(at)) - np.searchsorted(of_query, of_query) < k
                    if best.any():
                        yield pa.RecordBatch.from_arrays([mine.values.take(pa.array(of_query[best])), theirs.values.take(pa.array(at[best])), pa.array(alike[best])], names=["query", key, "similarity"])

        found = pairs.mapInArrow(compared, f"query {kind}, {key} {kind}, similarity double")
        order = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _packed(rows: DataFrame, shelves: DataFrame) -> DataFrame:
    """``size, shelf, ids, flat, cells``: about ``PACK`` rows of neighbouring cells to a row, or rows of cells that have no shelf."""
    home = F.col("cells")[0]
    at = rows.withColumn("cell", home).join(F.broadcast(shelves), ["size", "cell"], "left").withColumn("shelf", F.coalesce(F.col("shelf") + F.pmod(F.xxhash64("id"), F.col("of")), -1 - F.pmod(F.xxhash64("id"), F.lit(64))))
    packs = at.groupBy("size", "shelf").agg(F.sort_array(F.collect_list(F.struct("id", "unit", "cells"))).alias("p"))
    return packs.select("size", "shelf", F.col("p.id").alias("ids"), F.flatten("p.unit").alias("flat"), F.col("p.cells").alias("cells"))


def duplicates(rows: DataFrame, max_distance: float, key: str = "vec_id", vector: str = "embedding", recall: float = 0.95) -> DataFrame:
    """Each row's nearest row with a smaller key within a distance, as the index finds it: ``key, duplicate_of, distance``.

    Equal directions go as one: their least key stands for them in the index and answers for the others, so copies, however many, cost a grouping.
    """
    at = written(units(rows, key, vector, digits=9).select("id", "unit"), "rounded")
    named = written(at.groupBy("unit").agg(F.min("id").alias("first"), F.count("*").alias("n")), "firsts")
    copies = at.join(named.filter("n > 1"), "unit").filter(F.col("id") != F.col("first")).select(F.col("id").alias(key), F.col("first").alias("duplicate_of"), F.lit(0.0).alias("distance"))
    firsts = named.select(F.col("first").alias(key), F.col("unit").alias(vector))
    found = Index(firsts, key, vector, k=1, recall=recall).search(firsts, 1, key, vector, earlier=True, least=1 - max_distance)
    near = found.select(F.col("query").alias(key), F.col(key).alias("duplicate_of"), (F.round(1 - F.col("similarity"), 6) + F.lit(0.0)).alias("distance"))
    return near.filter(F.col("distance") <= max_distance).unionByName(copies)
