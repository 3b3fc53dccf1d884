"""Streams replayed from the driver's tables: rows that arrive late, a restart in the middle, and a closing row."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import activity, ingest, ordered
from .catalog import register
from .fixture import table
from .models import _folder

DELAY = "3 hours"


def replayed(rows: DataFrame, stream: Callable[[DataFrame], DataFrame], time: str, late: str = "false", parts: int = 4) -> DataFrame:
    """What a stream of the rows has written once it is over.

    The rows arrive in so many parts by time; those with ``late`` arrive two hours after their time.  The stream is stopped in the
    middle and goes on from its checkpoint; a last row without keys, of a time far ahead, lets it finish.  Each micro-batch overwrites its own folder.
    """
    spark = rows.sparkSession
    ordered.rocksdb(spark)
    folder = _folder(spark)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    told = stream(source)
    arrival = F.unix_micros(time) + F.when(F.expr(late), F.lit(2 * 3_600_000_000)).otherwise(F.lit(0))
    span = rows.agg(F.min(arrival), F.max(arrival), F.max(time)).first()
    if span[0] is None:
        return spark.createDataFrame([], told.schema)
    step = (span[1] - span[0]) // parts + 1
    rows.withColumn("part", F.floor((arrival - span[0]) / step)).write.partitionBy("part").parquet(f"{folder}/parts")
    closing = spark.range(1).select(*[(F.lit(span[2]) + F.expr("interval 400 days") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    for k in range(parts + 1):
        some = spark.read.schema(rows.schema).parquet(f"{folder}/parts/part={k}") if k < parts else closing
        some.coalesce(1).write.parquet(f"{folder}/in/{k}")
        if k in (parts // 2 - 1, parts - 1, parts):  # what has arrived so far is worked off; then the stream starts again
            ingest.start(told, sink, f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{folder}/out").select(*told.columns)


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(F.col("value") / 20).alias("price"), F.col("ts").cast("timestamp").alias("ts"))


@register("stream_price_history", """WITH e AS (SELECT user_id, event_type, ts, event_id, CAST(floor(value / 20) AS BIGINT) AS price FROM events),
  b AS (SELECT *, lag(price) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM e) SELECT user_id, event_type, price, ts AS recorded_at FROM b WHERE before IS NULL OR before <> price""")
def stream_price_history(spark, d):
    """Each user and type's prices as they change, from a stream in which every fifth row is two hours late and that restarts twice."""
    found = replayed(events(spark, d), lambda s: ordered.price_history(s, ["user_id", "event_type"], "price", "ts", DELAY, "event_id"), "ts", "event_id % 5 = 0")
    return found.withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))


KNOWN_SQL = """k AS (SELECT user_id, event_type, list_transform(list_reduce(list([{'t': ts, 'i': event_id}] ORDER BY ts, event_id),
  lambda a, x: CASE WHEN x[1].t > a[-1].t + INTERVAL 5 DAY THEN a || x ELSE a END), lambda x: x.i) AS news FROM events GROUP BY ALL),
  marked AS (SELECT event_id, user_id, event_type, ts, NOT list_contains(news, event_id) AS known FROM events JOIN k USING (user_id, event_type))"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).drop("price")
    return replayed(rows, lambda s: ordered.marked_within(s, ["user_id", "event_type"], "ts", timedelta(days=5), DELAY, "event_id"), "ts", "event_id % 5 = 0")


@register("stream_known_keys", f"WITH {KNOWN_SQL} SELECT * FROM marked")
def stream_known_keys(spark, d):
    """Whether each event's user and type had a new row within five days before; keys come back as new once theirs is older."""
    return _marked(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("stream_known_stop", f"""WITH {KNOWN_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - row_number() OVER (PARTITION BY event_type, known ORDER BY ts, event_id) AS island FROM marked),
  s AS (SELECT *, count(*) OVER (PARTITION BY event_type, known, island ORDER BY ts, event_id) AS streak FROM n) SELECT event_type, min(epoch_us(ts)) AS last FROM s WHERE known AND streak >= 6 GROUP BY event_type""")
def stream_known_stop(spark, d):
    """The chain of both: events marked by a stream over five days, then where each type's scrape stops, after six known ones in a row."""
    marked, folder = _marked(spark, d), _folder(spark)
    marked.select("event_type", F.unix_micros("ts").alias("place"), "known").write.parquet(f"{folder}/marked")
    stream = spark.readStream.schema("event_type string, place long, known boolean").parquet(f"{folder}/marked")
    stops = ingest.known_run_stop(stream, "event_type", "place", "known", 6)
    ingest.start(stops, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/stops/batch={n}"), f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("event_type string, last long").parquet(f"{folder}/stops").select("event_type", "last")


@register("activity_feed", """SELECT 'ingest' AS agent, 'info' AS level, 'started' AS message UNION ALL SELECT 'ingest', 'info', count(*) || ' rows' FROM events UNION ALL SELECT 'ingest', 'info', 'finished'
  UNION ALL SELECT 'broken', 'info', 'started' UNION ALL SELECT 'broken', 'error', 'failed'""")
def activity_feed(spark, d):
    """What the activity log has of two streams over the events, one of which fails in its first micro-batch."""
    folder = _folder(spark)
    log = activity.ActivityLog(spark, f"{folder}/log")
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d).select("event_id", "user_id")
        for name, rows in (("ingest", stream), ("broken", stream.withColumn("user_id", F.raise_error(F.lit("broken on purpose"))))):
            query = rows.writeStream.queryName(name).format("parquet").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start(f"{folder}/{name}")
            try:
                query.awaitTermination()
            except StreamingQueryException:
                if name != "broken":
                    raise
        activity.wait_for_ends(spark, f"{folder}/log", 2)
    finally:
        spark.streams.removeListener(log)
    return activity.entries(spark, f"{folder}/log").select("agent", "level", "message")
