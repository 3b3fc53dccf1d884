"""Helpers shared by the corpus operators: reading tables, cutting lineage, 64-bit mixing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session that has none (local tests) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='stallwise-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame of small rows; partitions and their order stay as they are.

    Spark removes the files once the frame is no longer used, where the session
    sets ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Arrow batches to Python end after the row that reaches so many bytes.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The frame itself, after bounding the bytes of its session's Arrow batches, whose rows are whole texts of any length.

    Spark's own bound of 64 MB is met several times over in a task: in the JVM, in the worker, as Python's
    strings and on the way back.  A session's smaller bound stays.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return a worker's free memory to the system: Spark keeps idle workers, which otherwise stay as large as they ever were."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other libraries have none
    if trim:
        trim(0)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver look for shuffles and broadcasts that nothing refers to any more, so that executors drop their files and blocks now and not whenever the driver's memory fills.

    Every stage broadcasts its tasks, so work of many small stages would otherwise fill executors with what is long done.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """A run's folder of intermediate tables below the shared one; what is left of it goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/stallwise/{uuid.uuid4().hex}"
        self._files(self.folder, "deleteOnExit")

    def _files(self, path: str, call: str, *how) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        getattr(at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), call)(at, *how)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a frame as parquet and read it back, which also cuts its lineage."""
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing lazy refers to any more."""
        for name in names:
            self._files(f"{self.folder}/{name}", "delete", True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as parquet to a run's folder of its own and read it back."""
    return Scratch(df.sparkSession).write(df, name)


def fresh(taken: list[str], name: str) -> str:
    """A column name that no input column has, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers for a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))
