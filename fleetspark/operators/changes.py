"""Change feeds: ``(key, kind, ts, event_id, phase)``, kind ADDED, MODIFIED or DELETED.

These are the batch forms; the streams in ``fleetspark.streaming`` apply the
same functions to each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The phase in which a key needs no further pass; the tries of a key
# that is not ready, each this many seconds times its number after the one before.
READY_PHASE = 2
RETRY_SECONDS = 5
RETRY_TRIES = 10


def latest_per_key(events: DataFrame) -> DataFrame:
    """The last event of each key; ties in time go to the later event."""
    rest = [c for c in events.columns if c != "key"]
    last = F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("_last")
    return events.groupBy("key").agg(last).select("key", "_last.*")


def present(latest: DataFrame) -> DataFrame:
    """Keys that still exist."""
    return latest.filter("kind <> 'DELETED'")


def backlog(latest: DataFrame, ready: Column | None = None) -> DataFrame:
    """Existing keys that are not ready and have to be looked at again."""
    ready = F.col("phase") == READY_PHASE if ready is None else ready
    return present(latest).filter(~ready)


def retry_queue(latest: DataFrame, now: Column) -> DataFrame:
    """The backlog with the tries made until now and when the next is due; NULL once the tries are used up.

    The delays before a try add up; a key without a time counts from 1970.
    """
    seconds = F.transform(F.sequence(F.lit(1), F.lit(RETRY_TRIES)), lambda n: (n * (n + 1) * (RETRY_SECONDS / 2)).cast("int"))
    since = F.coalesce("ts", F.lit("1970-01-01").cast("timestamp_ntz"))
    due = F.transform(seconds, lambda s: since + F.make_dt_interval(secs=s))
    out = backlog(latest).withColumn("_due", due).withColumn("tries", F.size(F.filter("_due", lambda d: d <= now)))
    return out.withColumn("due", F.get("_due", F.col("tries"))).drop("_due")


def parents_left(children: DataFrame) -> DataFrame:
    """Keys that have a child which is not gone."""
    return children.groupBy("key").agg(F.bool_or(~F.col("gone")).alias("_left")).filter("_left").select("key")


def tombstones(latest: DataFrame, children: DataFrame) -> DataFrame:
    """Deleted keys; a key may be purged once all its children, rows (key, gone), are gone."""
    parents = parents_left(children).withColumn("_child", F.lit(True))
    return (
        latest.filter("kind = 'DELETED'")
        .select("key", F.col("ts").alias("deleted_at"), "event_id")
        .join(parents, "key", "left")
        .select("key", "deleted_at", "event_id", F.col("_child").isNull().alias("purge"))
    )


def phase_segments(events: DataFrame) -> DataFrame:
    """Phase changes within each hour of each key, folded to one row per hour.

    Ordering a whole key would put a hot key into one task.  So a key is cut
    into hours: changes inside an hour are found there, and only the first and
    last phase of each hour go on to the comparison across hours.
    """
    hour = [F.to_date("ts").alias("day"), F.hour("ts").alias("hour")]
    inside = Window.partitionBy("key", "day", "hour").orderBy("ts", "event_id")
    lagged = events.select("key", *hour, "ts", "event_id", "phase").withColumn("_before", F.lag("phase").over(inside))
    at = F.struct("ts", "event_id")
    changed = F.col("_before").isNotNull() & (F.col("phase") != F.col("_before"))
    return lagged.groupBy("key", "day", "hour").agg(
        F.min_by("phase", at).alias("first_phase"),
        F.min("ts").alias("first_ts"),
        F.max_by("phase", at).alias("last_phase"),
        F.max("ts").alias("last_ts"),
        F.count_if(changed).alias("changes"),
        F.max(F.when(changed, F.col("ts"))).alias("changed_ts"),
    )


def join_segments(segments: DataFrame) -> DataFrame:
    """Phase, time of the last transition and number of transitions per key."""
    across = Window.partitionBy("key").orderBy("day", "hour")
    stitched = segments.withColumn("_before", F.lag("last_phase").over(across))
    opens = ~F.col("first_phase").eqNullSafe(F.col("_before"))
    place = F.struct("day", "hour")
    return stitched.groupBy("key").agg(
        F.max_by("last_phase", place).alias("phase"),
        F.max(F.greatest("changed_ts", F.when(opens, F.col("first_ts")))).alias("last_transition"),
        F.sum(F.col("changes") + opens.cast("int")).alias("transitions"),
        F.max("last_ts").alias("last_seen"),
    )


def phase_transitions(events: DataFrame) -> DataFrame:
    """When each key last changed its phase; an observation that repeats the phase moves nothing."""
    return join_segments(phase_segments(events))


def continue_transitions(before: DataFrame, events: DataFrame) -> DataFrame:
    """Transitions of the keys in a new batch of events, carried on from their former state.

    ``before`` holds earlier results per key; it joins in as a segment that
    lies before all hours of the batch.
    """
    fresh = phase_segments(events)
    known = before.join(events.select("key").distinct(), "key", "left_semi")
    carried = known.select(
        "key",
        F.lit("0001-01-01").cast("date").alias("day"),
        F.lit(0).alias("hour"),
        F.col("phase").alias("first_phase"),
        F.lit(None).cast(fresh.schema["first_ts"].dataType).alias("first_ts"),
        F.col("phase").alias("last_phase"),
        F.col("last_seen").alias("last_ts"),
        (F.col("transitions") - 1).alias("changes"),
        F.col("last_transition").alias("changed_ts"),
    )
    return join_segments(fresh.unionByName(carried))
