"""Keyed streams that go by event time: a key's rows are held until the watermark has passed them, then taken in order.

What comes out doesn't depend on how rows arrive or on how they are cut into micro-batches, as long as none is later than the
``delay``; Spark drops those that are.  A key's state is its rows within the delay and one small tuple, which a
timer drops once it can't matter any more; keys are dealt out to buckets, whose states are kept together.  State and timers live in the checkpoint, so a restart goes on where the stream stopped.

The state store must be RocksDB's (``rocksdb``).  Times are microseconds since 1970 inside, whatever the session's zone.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Gets a key's state and its next row; gives the next state, and a tuple to emit or None.
Step = Callable[[tuple | None, dict], tuple[tuple | None, tuple | None]]

MICROS = "micros_"


def rocksdb(spark: SparkSession) -> None:
    """Have the session's streams keep their state in RocksDB, as state of several kinds with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Takes the rows of each key of a bucket in order of time and of ``order``; ``until`` tells up to when a key's state matters.

    A bucket's rows and its keys' states are read and written at once: a call to the state server costs as much as many rows, so there are a few a bucket and none a key.
    """

    def __init__(self, schema: T.StructType, keys: list[str], order: list[str], out: list[str], step: Step, until: Callable[[tuple], int | None]):
        self.schema, self.keys, self.out, self.order, self.step, self.until = schema, keys, out, order, step, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.state = handle.getValueState("states", "states binary")

    def wake(self, micros: int) -> None:
        """A timer for the first millisecond after a time."""
        self.handle.registerTimer(micros // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh = [tuple(x[c] for c in self.schema.names) for x in rows]
        self.held.appendList(fresh)
        self.wake(min(x[-1] for x in fresh))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [dict(zip(self.schema.names, x)) for x in self.held.get()]
        due = sorted((x for x in rows if x[MICROS] <= passed), key=lambda x: (x[MICROS], *[(x[c] is not None, x[c]) for c in self.order]))
        stored = self.state.get()
        states, emitted = pickle.loads(bytes(stored[0])) if stored is not None else {}, []
        for row in due:
            name = tuple(row[c] for c in self.keys)
            state, told = self.step(states.get(name), row)
            if state is not None:
                states[name] = tuple(state)
            if told is not None:
                emitted.append(Row(**dict(zip(self.out, told))))
        rest = [x for x in rows if x[MICROS] > passed]
        if due and rest:
            self.held.put([tuple(x[c] for c in self.schema.names) for x in rest])
            self.wake(min(x[MICROS] for x in rest))
        elif due:
            self.held.clear()
        ends = {k: self.until(s) for k, s in states.items()}
        gone = [k for k, last in ends.items() if last is not None and last <= passed]
        for k in gone:
            del states[k]
        if not states:
            if stored is not None:
                self.state.clear()
        elif due or gone:
            self.state.update((pickle.dumps(states),))
            lasts = [ends[k] for k in states if ends[k] is not None]
            if lasts:
                self.wake(min(lasts))
        return iter(emitted)

    def close(self) -> None:
        pass


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


#: Buckets of keys: more of them are smaller states, each written whole when one of its keys has rows, and more calls.
BUCKETS = 512


def _run(rows: DataFrame, keys: list[str], time: str, delay: str, out: T.StructType, order: list[str], step: Step, until: Callable) -> DataFrame:
    rows = rows.filter(F.col(time).isNotNull()).withWatermark(time, delay).withColumn(MICROS, F.unix_micros(time))
    held = T.StructType([f for f in rows.schema.fields if f.name != time])
    return rows.withColumn("bucket_", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).groupBy("bucket_").transformWithState(InOrder(held, keys, order, out.names, step, until), out, "append", "eventTime")


def price_history(rows: DataFrame, keys: list[str], price: str, time: str, delay: str, *order: str, forget: timedelta | None = None) -> DataFrame:
    """A stream of ``*keys, price, recorded_at``: each key's first price, and every price that differs from the one before it.

    Rows of one time go by ``order``; rows without a price or a time say nothing.  With ``forget``, a key that had no price for longer
    than that is a new one, and its state goes; without, one price a key is kept for good.
    """
    gap = None if forget is None else _micros(forget)

    def step(state: tuple | None, row: dict) -> tuple[tuple | None, tuple | None]:
        if row[price] is None:
            return state, None
        told = state is None or state[0] != row[price] or (gap is not None and row[MICROS] - state[1] > gap)
        return (row[price], row[MICROS]), (*[row[c] for c in keys], row[price], row[MICROS]) if told else None

    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([*[T.StructField(c, kinds[c]) for c in keys], T.StructField("price", kinds[price]), T.StructField("recorded_at", T.LongType())])
    found = _run(rows, keys, time, delay, out, list(order), step, lambda s: None if gap is None else s[1] + gap)
    return found.withColumn("recorded_at", F.timestamp_micros("recorded_at"))


def marked_within(rows: DataFrame, keys: list[str], time: str, lookback: timedelta, delay: str, *order: str) -> DataFrame:
    """The stream's rows with ``known``: whether the key's last new row lies within the lookback before.

    A known row doesn't prolong the lookback, so a key comes back as new once its last new row is older.  The state is the
    time of that row, and goes with the lookback: what a micro-batch costs follows from its rows and the keys of the lookback in their buckets, however long the stream runs.
    """
    names, span = rows.columns, _micros(lookback)

    def step(state: tuple | None, row: dict) -> tuple[tuple | None, tuple | None]:
        known = state is not None and row[MICROS] - state[0] <= span
        return state if known else (row[MICROS],), (*[row[MICROS if c == time else c] for c in names], known)

    out = T.StructType([*[T.StructField(f.name, T.LongType() if f.name == time else f.dataType) for f in rows.schema.fields], T.StructField("known", T.BooleanType())])
    found = _run(rows, keys, time, delay, out, list(order), step, lambda s: s[0] + span)
    return found.withColumn(time, F.timestamp_micros(time))
