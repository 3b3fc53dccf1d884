"""Streaming ingest: normalise, drop known listings, upsert in micro-batches, stop at runs of known ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import clean_description, clean_title
from ..operators.merge import first_wins, unknown


def normalised(rows: DataFrame) -> DataFrame:
    """Titles and descriptions cleaned, blank places null; works on batches and streams."""
    return rows.withColumns({"title": clean_title(F.col("title")), "description": clean_description(F.col("description")), "location": F.nullif(F.trim("location"), F.lit(""))})


def new_listings(rows: DataFrame, key: str = "ad_url", time: str = "scraped_at", lookback: str = "30 days") -> DataFrame:
    """A stream without listings seen within the lookback; state older than it is dropped."""
    return rows.withWatermark(time, lookback).dropDuplicatesWithinWatermark([key])


def start(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run a stream into ``sink`` micro-batch by micro-batch; restarts go on where the checkpoint says.

    The sink must write a batch again without harm, as upserts by key do.
    """
    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def new_rows_sink(folder: str, key: str, time: str, stored: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch's rows that nothing before it has, below ``folder`` as ``batch=N``.

    Known are the keys of ``stored`` and of earlier batches' rows; of a batch's rows with one key the earliest counts, and rows without a key go.
    A batch that is run again after a restart overwrites its own folder and doesn't look at it or at later ones, so
    it comes out the same.  Only keys of older rows are read, nothing older is written again.
    """

    def sink(batch: DataFrame, number: int) -> None:
        fresh = first_wins(batch.filter(F.col(key).isNotNull()), [key], time)
        if stored is not None:
            fresh = unknown(fresh, stored, key)
        if number:
            # By folder, not by a filter on all of them: a batch cut off half way may have left something unreadable.
            earlier = batch.sparkSession.read.schema(batch.schema).parquet(*[f"{folder}/batch={n}" for n in range(number)])
            fresh = unknown(fresh, earlier, key)
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink


def known_run_stop(rows: DataFrame, group: str, order: str, known: str, run: int = 50) -> DataFrame:
    """``group, last``: emitted once, when a group has had ``run`` known rows in a row.

    The state is a group's current streak and whether it has stopped.  Rows of a micro-batch go by ``order``.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, stopped = state.get if state.exists else (0, False)
        batch = pd.concat(list(parts)).sort_values(order)
        for seen, place in zip(batch[known], batch[order]):
            streak = streak + 1 if seen else 0
            if streak >= run and not stopped:
                stopped = True
                yield pd.DataFrame({group: [key[0]], "last": [place]})
        state.update((int(streak), bool(stopped)))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(group).applyInPandasWithState(
        step, f"{group} {kinds[group]}, last {kinds[order]}", "streak long, stopped boolean", "append", GroupStateTimeout.NoTimeout
    )
