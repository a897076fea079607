"""Reconcile the whole fleet and roll the result up to one status row per installation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.operators import reconcile, status

PLACE = ["cluster", "shard", "ordinal"]


def fleet_status(
    installations: DataFrame, clusters: DataFrame, desired: DataFrame, observed: DataFrame, deleting: DataFrame
) -> DataFrame:
    """Counters, health and state per installation.

    Desired and observed replicas meet in one full outer join, and everything
    else is folded from its rows: replicas to shards, shards to clusters, then
    clusters to installations.  So each input is shuffled once.

    A shard of the layout is healthy if exactly its wanted replicas are there
    and all are Normal; shards that are only observed do not count.
    """
    wanted = desired.select(
        *PLACE, F.lit(True).alias("_wanted"), reconcile.applied_snapshot(reconcile.SPEC).alias("snapshot")
    )
    seen = status.replica_phase(observed).select(*PLACE, F.lit(True).alias("_seen"), "phase", "last_applied")
    changed = ~F.col("snapshot").eqNullSafe(F.col("last_applied"))
    both = wanted.join(seen, PLACE, "full_outer")
    wanted_here, seen_here = F.col("_wanted").isNotNull(), F.col("_seen").isNotNull()
    normal = F.col("phase") == "Normal"
    by_shard = both.groupBy("cluster", "shard").agg(
        F.count_if(wanted_here).alias("total"),
        F.count_if(wanted_here & seen_here & F.col("phase").isin("Normal", "Ready")).alias("ready"),
        F.count_if(wanted_here & ~seen_here).alias("added"),
        F.count_if(wanted_here & seen_here & changed).alias("updated"),
        F.count_if(~wanted_here).alias("deleted"),
        (~F.bool_or(wanted_here) | F.bool_and(wanted_here & seen_here & F.coalesce(normal, F.lit(False)))).alias("healthy"),
    )
    counters = ["total", "ready", "added", "updated", "deleted"]
    by_cluster = by_shard.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in counters], F.bool_and("healthy").alias("healthy"))
    idle = F.col("paused")
    rows = (
        clusters.select("inst", "cluster", "paused")
        .join(by_cluster, "cluster", "left")
        .select(
            "inst",
            F.lit(1).alias("clusters"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "ready")],
            *[F.when(idle, 0).otherwise(F.coalesce(c, F.lit(0))).alias(c) for c in ("added", "updated", "deleted")],
            F.coalesce("healthy", F.lit(True)).alias("healthy"),
        )
        .groupBy("inst")
        .agg(
            F.sum("clusters").alias("clusters"),
            *[F.sum(c).alias(c) for c in counters],
            F.bool_and("healthy").alias("healthy"),
        )
    )
    gone = deleting.select("inst", F.lit(True).alias("_deleting"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    state = (
        F.when(F.col("_deleting"), "Terminating")
        .when(F.coalesce("ready", F.lit(0)) == F.coalesce("total", F.lit(0)), "Completed")
        .otherwise("InProgress")
    )
    return (
        installations.select("inst")
        .join(rows, "inst", "left")
        .join(gone, "inst", "left")
        .select("inst", zero("clusters"), *[zero(c) for c in counters], F.coalesce("healthy", F.lit(True)).alias("healthy"), state.alias("state"))
    )
