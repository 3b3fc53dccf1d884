"""Groups of similar listings: weighted title words, reduced dimensions, k-means by small batches, labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cluster_title, words
from .ranges import written
from .reduction import truncated_svd, weights

#: The most titles that a task cleans, on average.
TITLES = 20_000


def title_terms(tokens: Column) -> Column:
    """The words of a title and its pairs of words that follow each other."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))
    return F.when(F.size(tokens) > 1, F.concat(tokens, pairs)).otherwise(tokens)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0)


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """First centres, each drawn by the squared distance from those before it, the best of a few draws."""
    centres = [x[rng.integers(len(x))]]
    near = _distances(x, np.array(centres))[:, 0]
    for _ in range(1, k):
        total = near.sum()
        drawn = rng.choice(len(x), size=2 + int(np.log(k)), p=near / total) if total > 0 else rng.integers(len(x), size=1)
        each = np.minimum(near[None, :], _distances(x[drawn], x))
        best = each.sum(axis=1).argmin()
        centres.append(x[drawn[best]])
        near = each[best]
    return np.array(centres)


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy().astype(np.float64, copy=False).reshape(len(column), -1)


def fit_batches(x: np.ndarray, k: int, seed: int, batch: int = 2000, passes: int = 100, patience: int = 10, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Centres by batches of rows: each moves towards its rows of a batch by the share that they are of all it has had.

    Ends when the smoothed cost of a batch hasn't improved for ``patience`` batches; gives the centres and their cost on the rows.
    A row is drawn, and counts in the cost, as often as ``times`` says.
    """
    rng = np.random.default_rng(seed)
    times = np.ones(len(x)) if times is None else times
    upto = np.cumsum(times) / times.sum()
    some = x[rng.permutation(len(x))[: 3 * batch]]
    if times.max() > times.min():  # and as many whatever their copies, so that there are k to choose from
        some = x[np.unique(np.concatenate([np.searchsorted(upto, rng.random(3 * batch), side="right").clip(max=len(x) - 1), rng.permutation(len(x))[: max(k, 3 * batch)]]))]
    centres, had = _spread(some, k, rng), np.zeros(k)
    best, smooth, idle = np.inf, None, 0
    for _ in range(max(1, passes * len(x) // batch)):
        some = x[np.searchsorted(upto, rng.random(min(batch, len(x))), side="right").clip(max=len(x) - 1)]
        distance = _distances(some, centres)
        of = distance.argmin(axis=1)
        n = np.bincount(of, minlength=k)
        sums = (of[None, :] == np.arange(k)[:, None]).astype(np.float64) @ some
        had += n
        live = n > 0
        centres[live] += (sums[live] - n[live, None] * centres[live]) / had[live, None]
        cost, share = distance[np.arange(len(some)), of].mean(), min(1.0, 2 * batch / (len(x) + 1))
        smooth = cost if smooth is None else smooth + share * (cost - smooth)
        best, idle = (smooth, 0) if smooth < best else (best, idle + 1)
        if idle >= patience:
            break
        starved = had < 0.01 * had.max()
        if starved.any() and idle == 0:  # centres that hardly any row goes to start again elsewhere
            centres[starved] = some[rng.choice(len(some), size=int(starved.sum()), replace=len(some) < starved.sum())]
            had[starved] = had[~starved].min() if (~starved).any() else 0
    for _ in range(k):  # a centre that no row is nearest to goes to the row farthest from its own
        distance = _distances(x, centres)
        near, empty = distance.min(axis=1), np.setdiff1d(np.arange(k), distance.argmin(axis=1))
        if not len(empty) or near.max() < 1e-12:
            break
        centres[empty[0]] = x[near.argmax()]
    return centres, float(_distances(x, centres).min(axis=1) @ times)


def _centres(at: DataFrame, k: int, starts: int, most: int, seed: int) -> np.ndarray:
    """Centres of all rows of ``place_, vector_, times_``: parts of about ``most`` rows fit ``k`` each, those centres, with their rows' number, are fitted in turn."""

    def fitted(group: pa.Table) -> pa.Table:
        order = np.argsort(group["place_"].to_numpy(), kind="stable")
        x, times = _vectors(group["vector_"])[order], group["times_"].to_numpy()[order]
        part, first = group["part_"][0].as_py(), group["start_"][0].as_py()
        centres, cost = min((fit_batches(x, min(k, len(x)), seed + start, times=times) for start in range(first, starts, spread)), key=lambda found: found[1])
        had = np.bincount(_distances(x, centres).argmin(axis=1), weights=times, minlength=len(centres))
        return pa.table({"part_": [part], "cost": [cost], "centres": [centres.tolist()], "had": [had.tolist()]})

    while True:
        parts = max(1, -(-at.count() // max(most, 2 * k)))
        spread = starts if parts < starts else 1  # starts are tasks of their own where there are few parts
        each = at.withColumn("part_", F.pmod(F.xxhash64("place_", F.lit(seed)), F.lit(parts))).crossJoin(at.sparkSession.range(spread).withColumnRenamed("id", "start_"))
        # By range, as few parts and starts would otherwise meet in one task.
        found = each.repartitionByRange(parts * spread, "part_", "start_").groupBy("part_", "start_").applyInArrow(fitted, "part_ long, cost double, centres array<array<double>>, had array<double>")
        if parts == 1:
            return np.array(found.orderBy("cost").first()["centres"])
        best = found.groupBy("part_").agg(F.min_by(F.arrays_zip("centres", "had"), "cost").alias("best")).select("part_", F.posexplode("best").alias("n", "c"))
        at = written(best.filter("c.had > 0").select(F.xxhash64("part_", "n").alias("place_"), F.col("c.centres").alias("vector_"), F.col("c.had").alias("times_")), "centres")


def _moved(at: DataFrame, centres: np.ndarray, passes: int) -> np.ndarray:
    """Centres after passes over all rows of ``vector_, times_``: each goes to its rows' mean while the cost falls by a thousandth, one without rows to the row farthest from its own."""
    k, last = len(centres), np.inf

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, centres.shape[1] + 2))
        for batch in batches:
            if len(batch):
                x, times = _vectors(batch["vector_"]), batch["times_"].to_numpy()
                distance = _distances(x, centres)
                told = np.hstack([x, np.ones((len(x), 1)), distance.min(axis=1)[:, None]]) * times[:, None]
                total += (distance.argmin(axis=1)[None, :] == np.arange(k)[:, None]).astype(np.float64) @ told
        yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["place", "value"])

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.record_batch([batch["vector_"], pa.array(_distances(_vectors(batch["vector_"]), centres).min(axis=1))], names=["vector_", "far"])

    for step in range(passes + k + 1):
        total = np.zeros((k, centres.shape[1] + 2))
        for place, value in at.mapInArrow(summed, "place int, value double").groupBy("place").agg(F.sum("value")).collect():
            total.flat[place] = value
        had, cost = total[:, -2], total[:, -1].sum()
        empty = np.flatnonzero(had == 0)
        if len(empty):
            rows = at.mapInArrow(farthest, "vector_ array<double>, far double").filter("far >= 1e-12").groupBy("vector_").agg(F.max("far").alias("far")).orderBy(F.desc("far"), "vector_").limit(len(empty)).collect()
            if not rows:
                break
            centres = centres.copy()
            centres[empty[: len(rows)]] = [x["vector_"] for x in rows]
        elif step >= passes or cost >= last * 0.999:
            break
        else:
            last, centres = cost, total[:, :-2] / had[:, None]
    return centres


def batch_kmeans(rows: DataFrame, key: str, vector: str, k: int, starts: int = 5, most: int = 50_000, seed: int = 42, copies: str | None = None, passes: int = 20) -> tuple[DataFrame, np.ndarray]:
    """``key, cluster_id, cost`` (squared distance) of every row, and the centres, which all rows fit.

    Rows are dealt by hash into parts of about ``most``, each fitted by batches in ``starts`` ways, of which the one of least cost wins; the parts' centres are fitted
    in the same way until they are one part.  Then up to ``passes`` passes over all rows move the centres to the means of their rows.
    A row counts as often as its column ``copies`` says, if that is given; the column is then in the result.
    """
    some = rows.filter(F.col(vector).isNotNull()).select(F.xxhash64(F.col(key), F.lit(seed)).alias("place_"), F.col(vector).alias("vector_"), (F.col(copies) if copies else F.lit(1)).cast("double").alias("times_"))
    centres, kept = _centres(some, k, starts, most, seed), [copies] if copies else []
    centres = _moved(some.select("vector_", "times_"), centres, passes)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                distance = _distances(_vectors(batch[vector]), centres)
                told = [pa.array(distance.argmin(axis=1).astype(np.int32)), pa.array(distance.min(axis=1))]
                yield pa.record_batch([batch[key], *told, *[batch[c] for c in kept]], names=[key, "cluster_id", "cost", *kept])

    schema = ", ".join([f"{key} {rows.schema[key].dataType.simpleString()}, cluster_id int, cost double", *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept]])
    return rows.filter(F.col(vector).isNotNull()).select(key, vector, *kept).mapInArrow(assigned, schema), centres


def _units(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector isn't 0, with vectors of length 1."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _vectors(batch[vector])
                length = np.sqrt((x * x).sum(axis=1))
                live = length > 0
                x = x[live] / length[live, None]
                ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                batch = batch.filter(pa.array(live))
                yield pa.record_batch([pa.ListArray.from_arrays(ends, pa.array(x.ravel())) if c == vector else batch[c] for c in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(scaled, rows.schema)


def text_groups(ads: DataFrame, key: str = "ad_url", title: str = "title", most: int = 150, dimensions: int = 100, seed: int = 42) -> DataFrame:
    """``title_, copies, cluster_id, cluster_label`` of each different title of three words or more; a label has up to four of a group's weightiest words and pairs.

    Equal titles are one, with their number as its weight in all counts, sums and draws, so copies cost a grouping.
    All words and pairs of two listings or more, up to nine tenths of them, count.  Titles without any of those are the group -1, which has no label.
    Fewer than six listings are one group, and each is labelled by its own words.
    """
    each = ads.groupBy(F.col(title).alias("title_")).agg(F.min(key).alias("key_"), F.count("*").alias("copies"))
    each = written(each, "each")  # cut here, as Spark would clean titles before it groups them
    parts = max(1, -(-each.count() // TITLES))
    rows = each.repartition(parts, "title_").withColumn("tokens", words(cluster_title(F.col("title_")))).filter(F.size("tokens") >= 3)
    rows = written(rows.withColumn("terms", title_terms(F.col("tokens"))), "titles")
    n = rows.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    if n < 6:  # less than two groups of three
        return rows.select("title_", "copies", F.lit(0).alias("cluster_id"), F.array_join("tokens", " · ").alias("cluster_label"))
    found = written(weights(rows, "key_", "terms", copies="copies"), "weights")
    if found.isEmpty():
        return rows.select("title_", "copies", F.lit(-1).alias("cluster_id"), F.lit(None).cast("string").alias("cluster_label"))
    reduced, _ = truncated_svd(found, "key_", dimensions, seed=seed, copies="copies")
    unit = written(_units(reduced, "reduced"), "unit")
    groups, _ = batch_kmeans(unit, "key_", "reduced", min(most, n // 3), seed=seed, copies="copies")
    groups = written(groups.select("key_", "cluster_id"), "groups")
    terms = found.join(groups, "key_").groupBy("cluster_id", "term").agg(F.sum(F.col("w") * F.col("copies")).alias("w"))
    top = terms.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("w"), "term"))).filter("place <= 4")
    names = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), lambda x: F.length(x) > 2)
    labels = top.groupBy("cluster_id").agg(F.array_join(names, " · ").alias("cluster_label"))
    out = rows.select("title_", "copies", "key_").join(groups, "key_", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    return out.join(labels, "cluster_id", "left").select("title_", "copies", "cluster_id", "cluster_label")


def title_groups(ads: DataFrame, key: str = "ad_url", title: str = "title", most: int = 150, dimensions: int = 100, seed: int = 42) -> DataFrame:
    """``key, cluster_id, cluster_label`` of titles of three words or more, by ``text_groups``."""
    found = text_groups(ads, key, title, most, dimensions, seed)
    return ads.select(key, F.col(title).alias("title_")).join(found, "title_").select(key, "cluster_id", "cluster_label")


def vector_groups(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 20, least: int = 10, seed: int = 42) -> DataFrame:
    """K-means over vectors, a group for 15 rows, 2 to ``most``; too few rows have none."""
    n = rows.count()
    if n < least:
        return rows.select(key, F.lit(None).cast("int").alias("cluster_id"))
    at = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=min(most, max(2, n // 15)), seed=seed, predictionCol="cluster_id").fit(at).transform(at).select(key, "cluster_id")


def group_sizes(groups: DataFrame, k: int) -> DataFrame:
    """Least, greatest, mean and median size, empty groups included."""
    sizes = groups.groupBy("cluster_id").agg(F.count("*").alias("n"))
    every = groups.sparkSession.range(k).withColumn("cluster_id", F.col("id").cast("int")).join(sizes, "cluster_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.agg(F.min("n").alias("least"), F.max("n").alias("greatest"), F.avg("n").alias("mean"), F.median("n").alias("median"))
