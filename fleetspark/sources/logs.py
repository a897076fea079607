"""Log tables: one partition per day, ordered by time, rows expire after 30 days."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Days a log row is kept, and how often a stream flushes.
RETENTION_DAYS = 30
FLUSH_INTERVAL = "7500 milliseconds"


def write_log(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Add rows ``(event_date, event_time, ..)`` to a log table.

    The rows are split by ranges of date and time.  A day that holds much of
    the data is so written by several tasks, each with an unbroken stretch of
    time, and the files carry narrow time statistics.
    """
    (
        df.repartitionByRange("event_date", "event_time")
        .sortWithinPartitions("event_date", "event_time")
        .write.mode(mode)
        .partitionBy("event_date")
        .parquet(folder)
    )


def compact_log(spark: SparkSession, landing: str, folder: str, days: list[datetime.date] | None = None) -> None:
    """Take the small files that flushes leave in a landing table to the log table, whole days at a time.

    The days of the landing table, or those named, are replaced in the log
    table by time-sorted files; other days are not touched.  Running it again
    writes the same days anew.
    """
    rows = spark.read.parquet(landing)
    if days is not None:
        rows = rows.filter(F.col("event_date").isin(days))
    (
        rows.repartitionByRange("event_date", "event_time")
        .sortWithinPartitions("event_date", "event_time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(folder)
    )


def expire_log(spark: SparkSession, folder: str, now: datetime.date, ttl_days: int = RETENTION_DAYS) -> list[datetime.date]:
    """Remove the partitions whose days have expired; returns those days.

    Only names of partitions are read.  Rows without a date are kept.  Running
    it again finds nothing.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = []
    for entry in hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop(folder)):
        name, _, value = entry.getPath().getName().partition("=")
        if name != "event_date" or value == "__HIVE_DEFAULT_PARTITION__":
            continue
        day = datetime.date.fromisoformat(value)
        if day + datetime.timedelta(days=ttl_days) <= now:
            path = entry.getPath()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            gone.append(day)
    return sorted(gone)


def is_retained(now: datetime.date, ttl_days: int = RETENTION_DAYS) -> Column:
    """A row lives until its date plus the retention.

    Written on the bare partition column against a literal, so whole days are
    pruned before any file is opened.
    """
    return F.col("event_date") > F.lit(now - datetime.timedelta(days=ttl_days))


def read_retained(spark: SparkSession, folder: str, now: datetime.date, ttl_days: int = RETENTION_DAYS) -> DataFrame:
    return spark.read.parquet(folder).filter(is_retained(now, ttl_days))


def expired_days(spark: SparkSession, folder: str, now: datetime.date, ttl_days: int = RETENTION_DAYS) -> DataFrame:
    """The partitions to be removed, as a plan table."""
    return spark.read.parquet(folder).filter(~is_retained(now, ttl_days)).select("event_date").distinct()
