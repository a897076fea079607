"""Phases, health and states from observed set status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = ["cluster", "shard", "ordinal"]


def reached_generation() -> Column:
    return (
        (F.col("observed_generation") == F.col("generation"))
        & (F.col("ready") == F.col("replicas"))
        & (F.col("current_replicas") == F.col("replicas"))
        & (F.col("updated_replicas") == F.col("replicas"))
        & (F.col("current_revision") == F.col("update_revision"))
    )


def replica_phase(observed: DataFrame) -> DataFrame:
    """Phase and state of each observed replica; scaling comes before upgrading."""
    phase = (
        F.when(F.col("ready") != 1, "Scale")
        .when(F.col("upgrading"), "Upgrade")
        .when(reached_generation() & (F.col("prev_state") == "NotSync"), "Ready")
        .otherwise("Normal")
    )
    return (
        observed.withColumn("phase", phase)
        .withColumn("state", F.when(F.col("ready") != 1, "NotSync").otherwise(F.col("prev_state")))
        .withColumn("counts_ready", F.col("phase") == "Normal")
    )


def shard_phase(shards: DataFrame, observed: DataFrame) -> DataFrame:
    """New shards and shards with an unexpected number of replicas are scaling."""
    seen = observed.groupBy("cluster", "shard").agg(F.count(F.lit(1)).cast("int").alias("observed_count"))
    settled = F.coalesce(F.col("observed_count") == F.col("replica_count"), F.lit(False))
    return shards.join(seen, ["cluster", "shard"], "left").select(
        "inst",
        "cluster",
        "shard",
        "replica_count",
        F.coalesce("observed_count", F.lit(0)).alias("observed_count"),
        F.col("observed_count").isNull().alias("is_new"),
        F.when(settled, "Normal").otherwise("Scale").alias("phase"),
        settled.alias("healthy"),
    )


def health_rollup(clusters: DataFrame, phases: DataFrame) -> DataFrame:
    """Installation health: all replicas of all shards of all clusters are Normal.

    Nothing to check counts as healthy, at every level.
    """
    by_shard = phases.groupBy("cluster", "shard").agg(F.bool_and(F.col("phase") == "Normal").alias("healthy"))
    by_cluster = by_shard.groupBy("cluster").agg(
        F.bool_and("healthy").alias("healthy"),
        F.count(F.lit(1)).alias("shards"),
        F.count_if("healthy").alias("healthy_shards"),
    )
    all_healthy = F.coalesce(F.col("healthy"), F.lit(True))
    return (
        clusters.select("inst", "cluster")
        .join(by_cluster, "cluster", "left")
        .groupBy("inst")
        .agg(
            F.bool_and(all_healthy).alias("healthy"),
            F.count(F.lit(1)).alias("clusters"),
            F.count_if(all_healthy).alias("healthy_clusters"),
            F.coalesce(F.sum("shards"), F.lit(0)).alias("shards"),
            F.coalesce(F.sum("healthy_shards"), F.lit(0)).alias("healthy_shards"),
        )
    )


def status_of(replicas: DataFrame, phases: DataFrame) -> DataFrame:
    """Status of each replica by its place; NULL where none is recorded."""
    return replicas.join(phases.select(*PLACE, "phase", "state"), PLACE, "left")


def status_by_name(replicas: DataFrame, phases: DataFrame) -> DataFrame:
    """Status by replica name alone; if clusters share a name, the first cluster counts."""
    first = phases.groupBy("replica_name").agg(F.min_by(F.struct("phase", "state"), F.struct(*PLACE)).alias("_first"))
    return replicas.join(first, "replica_name", "left").select(*replicas.columns, "_first.*")


def previous_state(observed: DataFrame) -> DataFrame:
    """State of the replica with the ordinal before; none for ordinal 0 and across gaps.

    A join on the ordinal, not a lag: a lag would jump over a gap.
    """
    before = observed.select("cluster", "shard", (F.col("ordinal") + 1).alias("ordinal"), F.col("prev_state").alias("before"))
    return observed.select(*PLACE, "prev_state").join(before, PLACE, "left")


def installation_state(
    counts: DataFrame, desired: DataFrame, phases: DataFrame, deleting: DataFrame, sync_in_pass: bool = True
) -> DataFrame:
    """Completed if every wanted replica is ready, Terminating while deleting, else InProgress.

    A replica in phase Ready gets its schema in the same pass and then counts
    as ready; ``sync_in_pass=False`` leaves that out.
    """
    live = phases.select(*PLACE, "phase")
    is_ready = (F.col("phase") == "Normal") | ((F.col("phase") == "Ready") & F.lit(sync_in_pass))
    ready = (
        desired.select("inst", *PLACE).join(live, PLACE).groupBy("inst").agg(F.count_if(is_ready).alias("ready"))
    )
    gone = deleting.select("inst", F.lit(True).alias("_deleting"))
    total = F.coalesce(F.col("replicas"), F.lit(0))
    state = (
        F.when(F.col("_deleting"), "Terminating")
        .when(F.coalesce("ready", F.lit(0)) == total, "Completed")
        .otherwise("InProgress")
    )
    return (
        counts.join(ready, "inst", "left")
        .join(gone, "inst", "left")
        .select("inst", total.alias("total"), F.coalesce("ready", F.lit(0)).alias("ready"), state.alias("state"))
    )
