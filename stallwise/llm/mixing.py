"""Mixing sources to target token counts by entropy balancing.

Every document gets a rate: how often the mix repeats it on average.  Among all
rates that meet each source's target, the chosen ones are closest in relative
entropy to repeating each document once, within a cap.  The convex dual has one
multiplier per source, and a document's rate is its exponential tilt
``min(cap, exp(multiplier * size / mean size of the source))``.  Newton steps solve
the dual; each sums over a table of (source, size, count) cells, never over the
documents.  Only the rounding has a source's cells, one for each different size, in one task.
Rates are rounded into whole
copies so that each source's total stays within about a small document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_shuffles

WORD_GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """How many runs of other than white space a text has; a null text has none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, WORD_GAP))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Each source's target from ``source, size``: ``source, source_size, target``.

    Sources in order of code points, null last, weigh ``weights``, repeating, and
    share ``share`` times all sizes; none gets over ``cap`` times its own size, and what it
    would get beyond goes to the others by weight, until none is above.

    That is water-filling: with sources by their ceiling over weight, rising, the
    first k are at their ceiling for the k at which the rest's common level is below
    the next ceiling.  One row per source goes through these windows, nothing else.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    at = sizes.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
    full = Window.orderBy(F.col("ceiling") / F.col("weight"), F.encode(F.coalesce("source", F.lit("")), "utf-8"), F.col("source").isNull())
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    at = at.withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(float(share)),
        "full_before": F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)),
        "weight_from": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    at = at.withColumn("level", F.greatest(F.lit(0.0), F.col("total") - F.col("full_before")) / F.col("weight_from"))
    at = at.withColumn("open", F.col("level") * F.col("weight") < F.col("ceiling"))
    # The level of the first source below its ceiling holds for all after it.
    at = at.withColumn("common", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("ceiling") / F.col("weight"))).over(everything))
    target = F.when(F.col("common").isNull(), F.col("ceiling")).otherwise(F.least(F.col("ceiling"), F.col("common") * F.col("weight")))
    return at.select("source", "source_size", target.alias("target"))


def solve(cells: DataFrame, goals: DataFrame, cap: float, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Each source's multiplier: ``source, source_size, target, mean, multiplier`` by safeguarded Newton steps.

    ``cells`` has ``source, size, n``.  The dual's gradient is the target less the
    tokens that the rates give, its curvature their second moment over the documents below the
    cap.  Both come from one aggregation a step.  A bracket keeps each step where the
    gradient changes sign; a step outside it is halved.  Sources whose target is at
    the cap need no step (multiplier null: every rate is the cap).  Sources that haven't met their
    target within ``steps`` are an error.
    """
    means = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    at = goals.join(means, F.equal_null(goals["source"], means["source"])).select(goals["*"], means["mean"])
    at = at.withColumns({
        "multiplier": F.lit(0.0),
        "low": F.lit(None).cast("double"),
        "high": F.lit(None).cast("double"),
        "done": (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)) | (F.col("source_size") == 0),
    })
    at = cut(at)
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        open_ = at.filter(~F.col("done"))
        tilt = F.exp(F.least(F.col("multiplier") * x, F.lit(700.0)))
        joined = cells.withColumnRenamed("source", "s").join(open_, F.equal_null(F.col("s"), F.col("source")))
        sums = joined.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * F.least(F.lit(float(cap)), tilt)).alias("tokens"),
            F.sum(F.when(tilt < cap, F.col("n") * F.col("size") * x * tilt).otherwise(0.0)).alias("curvature"),
        ).withColumnRenamed("source", "s")
        at = at.join(sums, F.equal_null(F.col("source"), F.col("s")), "left").drop("s")
        short = F.col("target") - F.col("tokens")
        at = at.withColumns({
            "low": F.when(short > 0, F.col("multiplier")).otherwise(F.col("low")),
            "high": F.when(short < 0, F.col("multiplier")).otherwise(F.col("high")),
        })
        newton = F.col("multiplier") + short / F.when(F.col("curvature") > 0, F.col("curvature"))
        inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        halved = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        met = F.abs(short) <= F.col("target") * tolerance + 1e-6
        at = at.withColumns({
            "multiplier": F.when(F.col("done") | met, F.col("multiplier")).when(inside, newton).otherwise(halved),
            "done": F.col("done") | met,
        }).drop("tokens", "curvature")
        at = cut(at)
        if at.filter(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"the multipliers haven't converged in {steps} steps")
    at_cap = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    return at.select("source", "source_size", "target", "mean", F.when(~at_cap, F.col("multiplier")).alias("multiplier"))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    bands: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    whole: bool = False,
) -> DataFrame:
    """Whole copies of every document so that sources meet their target sizes.

    Returns ``doc_id, source, size, source_size, target, rate, copies, taken`` for every row, and with
    ``whole`` the row itself as a struct ``document``; ``size`` is the text's words unless
    given, ``taken`` is copies times size.  Copies are the rate rounded up or down for cells of
    equally large documents of a source: a cell's copies carry the error of the larger cells
    before it, so a source's total misses its target by about half its smallest
    documents.  Within a cell, a hash of the id says which documents get the copy more; reruns agree.

    Defined cases: a null text has size 0; size 0 documents are taken once and add
    nothing; a null source is a source of its own; repeated rows are documents of their own;
    an empty table gives an empty result; other columns are ignored.
    """
    size = (words(F.col(text_col)) if size is None else size).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("s"), size.alias("z"), *[F.struct("*").alias("document")] * whole)
    # A cell's documents fall in fixed bands by hash, so that a cell of any size can be joined and ranked in parts.
    rows = rows.withColumn("h", F.xxhash64("doc_id", "s", "z")).withColumn("b", F.pmod(F.shiftrightunsigned("h", 17), F.lit(bands)).cast("int"))
    if not whole:
        rows = cut(rows)
    counted = rows.groupBy(F.col("s").alias("source"), F.col("z").alias("size"), F.col("b").alias("band")).agg(F.count("*").alias("k"))
    counted = cut(counted) if whole else counted
    cells = cut(counted.groupBy("source", "size").agg(F.sum("k").alias("n")))
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = cut(targets(totals, weights, share, cap))
    found = solve(cells, goals, cap)
    free_shuffles(docs.sparkSession)
    rate = F.when(F.col("multiplier").isNull(), F.lit(float(cap))).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(700.0))))
    )
    rated = cells.withColumnRenamed("source", "s").join(found, F.equal_null(F.col("s"), F.col("source"))).drop("s")
    rated = rated.withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate))
    quotas = cut(_quotas(counted, _rounded(rated, cap)))
    # Joined by band, so that the documents of one large cell spread over tasks.
    out = rows.join(quotas, F.equal_null("s", "source") & (F.col("z") == F.col("size")) & (F.col("b") == F.col("band")))
    even = out.filter((F.col("quota") == 0) | (F.col("quota") == F.col("k"))).withColumn("more", F.col("quota") > 0)
    ranked = F.row_number().over(Window.partitionBy("source", "size", "band").orderBy("h", "doc_id"))
    part = out.filter((F.col("quota") > 0) & (F.col("quota") < F.col("k"))).withColumn("more", ranked <= F.col("quota"))
    result = even.unionByName(part).withColumn("copies", F.col("base") + F.col("more").cast("long"))
    result = result.withColumn("taken", F.col("copies") * F.col("size"))
    return result.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken", *["document"] * whole)


def _rounded(rated: DataFrame, cap: int) -> DataFrame:
    """Whole copies for each cell: ``base`` for every document and one more for ``extra`` of them.

    A source's cells go from the largest size to the smallest, in order of size; each
    cell takes the whole number of copies nearest to its own share plus what the
    cells before it are short of.  Each depends on the one before, so one task walks a source's
    cells.  They number its distinct sizes, at most its longest document's, whatever its documents:
    about 100 bytes each, a million of them if it has documents of every size up to a million words.
    """
    import pandas as pd

    def carry(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False)
        short, base, extra = 0.0, [], []
        for size, n, rate in zip(cells["size"], cells["n"], cells["rate"]):
            if size == 0:
                total = int(n)
            else:
                want = n * rate + short / size
                total = int(min(max(round(want), 0), n * cap))
                short += (n * rate - total) * size
            base.append(total // n)
            extra.append(total % n)
        return cells.assign(base=base, extra=extra)

    kinds = {f.name: f.dataType.simpleString() for f in rated.schema}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", base long, extra long"
    return rated.groupBy("source").applyInPandas(carry, schema)


def _quotas(banded: DataFrame, copies: DataFrame) -> DataFrame:
    """``copies`` for each band of each cell, with ``k`` documents of which ``quota`` get one copy more.

    Whole bands before a cell's deciding one get it, whole bands after it don't; only
    the deciding band's documents need a rank.  A cell has at most as many rows here as there are bands.
    """
    cells = copies.withColumnsRenamed({"source": "s", "size": "z"})
    at = banded.join(cells, F.equal_null(F.col("source"), F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    upto = F.sum("k").over(Window.partitionBy("source", "size").orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return at.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("k"), F.col("extra") - upto + F.col("k"))))
