"""The reactive side of the fleet as Structured Streaming jobs.

What is known of a key lies in the engine's state store (RocksDB); the
processors say how long.  A job appends what changed to a table of Parquet
files, exactly once by the sink's own log.  The table of keys is the newest
row of each key in it; rows of a key are ordered by the event they tell of, so
the order in which batches wrote them does not matter.

Events may come late by ``lateness``; those that come later than that are
dropped by the engine, which counts them in the query's progress.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from fleetspark.operators import changes, reconcile
from fleetspark.sources import logs
from fleetspark.streaming import processors

LATENESS = "1 hour"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events as a stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _time(micros: str) -> Column:
    """Microseconds since 1970 as a time without a zone."""
    return F.expr(f"{_EPOCH} + INTERVAL '0.000001' SECOND * {micros}")


def _run(stream: DataFrame, processor: StatefulProcessor, table: str, checkpoint: str, lateness: str, available_now: bool) -> StreamingQuery:
    """Events through a processor; columns ``at`` and ``event_time`` are their time as a number and for the watermark."""
    spark = stream.sparkSession
    timed = stream.withColumn("at", F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, ts)")).drop("ts")
    timed = timed.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", lateness)
    changed = timed.groupBy("key").transformWithState(processor, processor.OUTPUT, "Append", "EventTime")
    writer = changed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    # a query takes its settings along when it starts; the session's stay as they are
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start(table)
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _newest(spark: SparkSession, table: str, schema: str, *order: str) -> DataFrame:
    """The newest row of each key; no rows before the first batch."""
    try:
        rows = spark.read.schema(schema).parquet(table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    rest = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select("key", "_row.*")


# Latest state of each key ------------------------------------------------------


def _states(stream: DataFrame, ownership: DataFrame | None, children: DataFrame | None) -> DataFrame:
    events = stream if ownership is None else reconcile.map_to_owner(stream, ownership)
    events = events.select("key", "kind", "ts", "event_id", "phase")
    if children is None:
        return events.withColumn("has_child", F.lit(False))
    parents = changes.parents_left(children).withColumn("_child", F.lit(True))
    return events.join(parents, "key", "left").select(*events.columns, F.coalesce("_child", F.lit(False)).alias("has_child"))


def coalesce_changes(
    stream: DataFrame, table: str, checkpoint: str, ownership: DataFrame | None = None, lateness: str = LATENESS, available_now: bool = True
) -> StreamingQuery:
    """Events of a key are folded to its latest state; events of owned objects count for the owner.

    Only present keys, and deleted ones within the lateness, have state.
    """
    return _run(_states(stream, ownership, None), processors.Latest(), table, checkpoint, lateness, available_now)


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    """The last event of each key."""
    rows = _newest(spark, table, processors.Latest.OUTPUT, "at", "event_id", "purged")
    return rows.select("key", "kind", _time("at").alias("ts"), "event_id", "phase")


# Phase tracking -----------------------------------------------------------------


def track_phase(stream: DataFrame, table: str, checkpoint: str, lateness: str = LATENESS, available_now: bool = True) -> StreamingQuery:
    """Transition times that move on a change of phase only, carried over batches."""
    events = stream.select("key", "ts", "event_id", "phase")
    return _run(events, processors.Phases(), table, checkpoint, lateness, available_now)


def read_transitions(spark: SparkSession, table: str) -> DataFrame:
    rows = _newest(spark, table, processors.Phases.OUTPUT, "seen")
    return rows.select("key", "phase", _time("last_transition_at").alias("last_transition"), "transitions", _time("last_seen_at").alias("last_seen"))


# Requeue ------------------------------------------------------------------------


def requeue_backlog(stream: DataFrame, table: str, checkpoint: str, lateness: str = LATENESS, available_now: bool = True) -> StreamingQuery:
    """Keys that are not ready stay in the queue and are tried again at growing intervals."""
    events = stream.select("key", "kind", "ts", "event_id", "phase")
    return _run(events, processors.Retries(), table, checkpoint, lateness, available_now)


def read_queue(spark: SparkSession, table: str) -> DataFrame:
    """The waiting keys, with tries made until the watermark and the time of the next; NULL once they are used up."""
    rows = _newest(spark, table, processors.Retries.OUTPUT, "at", "event_id", "tries")
    rows = rows.select("key", "kind", _time("at").alias("ts"), "event_id", "phase", "tries", _time("due_at").alias("due"))
    return changes.backlog(rows)


# Deletion in two steps ------------------------------------------------------------


def soft_delete(
    stream: DataFrame, table: str, checkpoint: str, children: DataFrame | None = None, lateness: str = LATENESS, available_now: bool = True
) -> StreamingQuery:
    """Deleted keys become tombstones; a key that comes back loses its tombstone.

    The tombstone of a key without a child is purged from the state once no
    earlier event can come any more.
    """
    return _run(_states(stream, None, children), processors.Latest(), table, checkpoint, lateness, available_now)


def read_tombstones(spark: SparkSession, table: str) -> DataFrame:
    """Deleted keys, and whether no child kept them from being purged."""
    rows = _newest(spark, table, processors.Latest.OUTPUT, "at", "event_id", "purged").where("kind = 'DELETED'")
    return rows.select("key", _time("at").alias("deleted_at"), "event_id", (~F.col("has_child")).alias("purge"))


# Log sink ---------------------------------------------------------------------------


def log_sink(stream: DataFrame, landing: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Log rows flushed at a fixed interval to a landing table by day; ``logs.compact_log`` takes them to the log table."""
    writer = stream.writeStream.format("parquet").partitionBy("event_date").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": logs.FLUSH_INTERVAL}
    return writer.trigger(**trigger).start(landing)
