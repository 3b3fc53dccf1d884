import random
import shutil
from datetime import timedelta

from pyspark.sql import functions as F

from stallwise.streaming import ingest, ordered

SCHEMA = "ad_url string, title string, description string, location string, scraped_at timestamp"


def add(spark, folder, rows):
    frame = spark.createDataFrame(rows, "ad_url string, title string, description string, location string, at string")
    frame.selectExpr("ad_url", "title", "description", "location", "cast(at as timestamp) as scraped_at").coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp, stored):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp}/in")
    sink = ingest.new_rows_sink(f"file://{tmp}/out", "ad_url", "scraped_at", stored)
    ingest.start(ingest.normalised(stream), sink, f"file://{tmp}/checkpoint").awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"file://{tmp}/out").select("ad_url", "title", "location", "batch").collect()))


def test_chain_goes_on_after_restarts(spark, tmp_path):
    stored = spark.createDataFrame([("old",)], "ad_url string")
    add(spark, f"{tmp_path}/in", [
        ("a", " \U0001f600 One  two ", None, " ", "2026-01-02 00:00:00"), ("a", "first", "x", "y", "2026-01-01 00:00:00"),
        ("old", "t", None, None, "2026-01-01 00:00:00"), (None, "t", None, None, "2026-01-01 00:00:00"), ("b", " \U0001f600 One  two ", None, " ", "2026-01-03 00:00:00"),
    ])
    first = [("a", "first", "y", 0), ("b", "One two", None, 0)]
    assert run(spark, tmp_path, stored) == first
    assert run(spark, tmp_path, stored) == first  # nothing new: no batch
    add(spark, f"{tmp_path}/in", [("a", "again", None, None, "2025-01-01 00:00:00"), ("c", "C", None, None, "2026-02-01 00:00:00"), ("old", "t", None, None, "2026-03-01 00:00:00")])
    both = [*first, ("c", "C", None, 1)]
    assert run(spark, tmp_path, stored) == both
    # A crash after the write and before the commit: the batch runs again, to the same rows.
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "checkpoint" / name).unlink(missing_ok=True)
    assert run(spark, tmp_path, stored) == both
    # A crash in the middle of the write.
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "checkpoint" / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out" / "batch=1")
    (tmp_path / "out" / "batch=1").mkdir()
    (tmp_path / "out" / "batch=1" / "part-0.parquet").write_bytes(b"cut off")
    assert run(spark, tmp_path, stored) == both
    add(spark, f"{tmp_path}/in", [("c", "again", None, None, "2026-02-02 00:00:00")])
    assert run(spark, tmp_path, stored) == both


KEYED = "k string, price double, at timestamp, seq long"


def feed(spark, tmp, number, rows):
    frame = spark.createDataFrame([(k, p, s, i) for k, p, s, i in rows], "k string, price double, s double, seq long")
    frame.select("k", "price", F.timestamp_seconds(F.col("s")).alias("at"), "seq").coalesce(1).write.parquet(f"{tmp}/in/{number}")


def work_off(spark, tmp, stream):
    ordered.rocksdb(spark)
    source = spark.readStream.schema(KEYED).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")
    query = ingest.start(stream(source), lambda b, n: b.write.mode("overwrite").parquet(f"{tmp}/out/batch={n}"), f"file://{tmp}/checkpoint")
    query.awaitTermination()
    return query


def micros(frame, *columns):
    return sorted((tuple(x) for x in frame.select(*columns).collect()), key=str)


def test_price_history_whatever_the_arrival(spark, tmp_path):
    """Late rows, ties, equal prices, missing ones, a key forgotten, and a restart after each part: as a walk in order of time."""
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice([1.0, 2.0, None, 3.0]), float(rng.randrange(0, 4000)), i) for i in range(120)]
    rows += [("d", 5.0, 10.0, 900), ("d", 5.0, 10.0, 901), ("d", 5.0, 3000.0, 902), ("e", None, 5.0, 903), (None, 1.0, 7.0, 904), (None, 1.0, 9.0, 905)]
    arrival = sorted(rows, key=lambda x: x[2] + rng.choice([0, 0, 90]))
    stream = lambda s: ordered.price_history(s, ["k"], "price", "at", "100 seconds", "seq", forget=timedelta(seconds=1000))
    for n, part in enumerate((arrival[:40], arrival[40:41], arrival[41:])):
        feed(spark, tmp_path, n, part)
        work_off(spark, tmp_path, stream)
    early = spark.read.parquet(f"{tmp_path}/out").count()
    feed(spark, tmp_path, 3, [("end", None, 1e6, 1)])
    feed(spark, tmp_path, 4, [("a", 9.0, 50.0, 999)])  # later than the delay
    work_off(spark, tmp_path, stream)
    want, state = [], {}
    for k, p, s, _ in sorted((x for x in rows if x[1] is not None), key=lambda x: (x[2], x[3])):
        if k not in state or state[k][0] != p or s - state[k][1] > 1000:
            want.append((k, p, int(s * 1e6)))
        state[k] = (p, s)
    got = micros(spark.read.parquet(f"{tmp_path}/out"), "k", "price", F.unix_micros("recorded_at"))
    assert got == sorted(want, key=str) and early < len(want) and ("d", 5.0, 3_000_000_000) in want


def test_known_within_the_lookback(spark, tmp_path):
    """A key is known until its last new row is older than the lookback; then it comes back, and its state had gone meanwhile."""
    day = 86_400.0
    rows = [("a", None, 0.0, 0), ("a", None, 1 * day, 1), ("a", None, 3 * day, 2), ("a", None, 3 * day + 1, 3), ("b", None, 2 * day, 4), ("a", None, 6 * day, 5), ("b", None, 9 * day, 6), ("a", None, 9 * day, 7)]
    stream = lambda s: ordered.marked_within(s, ["k"], "at", timedelta(days=3), "1 hour", "seq")
    for n, row in enumerate(sorted(rows, key=lambda x: x[2])):
        feed(spark, tmp_path, n, [(*row[:2], row[2] + 100 * day, row[3])])
    feed(spark, tmp_path, 99, [("end", None, 140 * day, 99)])
    query = work_off(spark, tmp_path, stream)
    got = dict(micros(spark.read.parquet(f"{tmp_path}/out").filter("seq < 99"), "seq", "known"))
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False}
    # What is left is the closing row, not the keys of the whole stream.
    assert query.lastProgress["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) - query.lastProgress["stateOperators"][0]["customMetrics"].get("numDeletedTimers", 0) <= 1
