"""Stored tables of which only the partitions that change are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, by: str, gone: list | tuple = ()) -> None:
    """Overwrite the partitions of ``by`` that the rows have, and delete those of the values in ``gone``; the files of all others stay as they are.

    The rows may come from the table itself: they are checkpointed before anything is deleted.  Spark puts new partitions in their places when all tasks have
    ended, so a job that fails leaves the table as it was.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir():
        rows = rows.checkpoint()
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for value in gone:
        name = spark.range(1).select(F.lit(value).cast(rows.schema[by].dataType).cast("string")).first()[0]
        at = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={name}")
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
