"""An activity log of streams: a listener writes each run's start, progress and end to files that batches and streams can read."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..schemas import AGENT_LOGS

INFO, ERROR = "info", "error"


class ActivityLog(StreamingQueryListener):
    """Writes a line for a query's start, each micro-batch that had rows, and its end, to ``folder``; queries without a name are left out.

    A line is a file of its own, moved to its place when it is whole, so a stream never reads half of one.  Micro-batches come with the query's rate, not with its rows.
    """

    def __init__(self, spark: SparkSession, folder: str, target: str | None = None):
        self.spark, self.folder, self.target, self.names = spark, folder, target, {}

    def add(self, agent: str, message: str, level: str = INFO) -> None:
        line = {"agent": agent, "message": message, "target": self.target, "level": level, "created_at": datetime.now(timezone.utc).isoformat()}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        name = uuid.uuid4().hex
        draft, final = (jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{x}") for x in (f"_{name}", f"{name}.json"))
        files = final.getFileSystem(conf)
        out = files.create(draft)
        out.write(bytearray((json.dumps(line, ensure_ascii=False) + "\n").encode()))
        out.close()
        files.rename(draft, final)

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        if event.name:
            self.names[str(event.runId)] = event.name
            self.add(event.name, "started")

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        if event.progress.name and event.progress.numInputRows:
            self.add(event.progress.name, f"{event.progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        name = self.names.pop(str(event.runId), None)
        if name:
            self.add(name, "failed" if event.exception else "finished", ERROR if event.exception else INFO)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(AGENT_LOGS).json(folder)


def wait_for_ends(spark: SparkSession, folder: str, n: int, seconds: float = 60) -> None:
    """Wait until ``n`` runs have ended in the log: listeners hear of it a little after the run's end."""
    until = time.monotonic() + seconds
    while entries(spark, folder).filter(F.col("message").isin("failed", "finished")).count() < n:
        if time.monotonic() > until:
            raise TimeoutError("a run's end hasn't come to the activity log")
        time.sleep(0.2)
