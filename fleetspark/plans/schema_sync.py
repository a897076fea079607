"""Schema plans: what a new replica has to create and a removed one has to drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.functions import text
from fleetspark.operators import catalog as cat

# Order of the statements of one replica.
REPLICA_DATABASES, REPLICA_TABLES, DISTRIBUTED_DATABASES, LOCAL_TABLES, DISTRIBUTED_TABLES = range(1, 6)


def _offered(rows: DataFrame, *keys: str) -> DataFrame:
    """Each distinct row with the least and greatest host that offers it.

    A host that is to be filled may take a row unless it is the only one to
    offer it, which these two values tell.  So the hosts are folded away before
    the rows fan out to the new replicas.
    """
    return rows.groupBy(*keys).agg(F.min("host").alias("_least"), F.max("host").alias("_greatest"))


def _from_another_host(least: str, greatest: str):
    return (F.col(least) != F.col("host")) | (F.col(greatest) != F.col("host"))


def schema_sync_plan(hosts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Statements for every replica that is Ready but not yet in sync.

    ``hosts`` is ``(host, cluster, shard, ordinal, replicas_count, available,
    phase, state)``.  Databases and tables come from the Normal replicas of the
    same shard; distributed tables and the tables behind them from all other
    hosts of the cluster.
    """
    place = ["cluster", "shard", "ordinal"]
    targets = hosts.filter("phase = 'Ready' AND state <> 'Sync'")

    shard_targets = targets.filter("replicas_count > 1").select(*place, "host")
    shard_sources = hosts.filter("phase = 'Normal' AND available").select("host", "cluster", "shard")
    shard_rows = (
        catalog.filter("database <> 'system'")
        .join(shard_sources, "host")
        .select("cluster", "shard", "database", "name", "create_table_query")
        .distinct()
    )
    replica_databases = shard_rows.select(
        "cluster",
        "shard",
        F.lit(REPLICA_DATABASES).alias("step"),
        F.col("database").alias("name"),
        text.create_database(F.col("database")).alias("statement"),
    )
    replica_tables = shard_rows.filter("create_table_query <> '' AND name NOT LIKE '.inner.%'").select(
        "cluster",
        "shard",
        F.lit(REPLICA_TABLES).alias("step"),
        "name",
        text.if_not_exists(F.col("create_table_query")).alias("statement"),
    )
    from_shard = shard_targets.join(replica_databases.unionByName(replica_tables).distinct(), ["cluster", "shard"])

    rows = catalog.join(hosts.filter("available").select("host", "cluster"), "host")
    distributed = rows.filter("engine = 'Distributed'")
    target_names = distributed.select(
        "host",
        "cluster",
        text.target_database(F.col("engine_full")).alias("database"),
        text.target_table(F.col("engine_full")).alias("name"),
    )
    databases = _offered(
        distributed.select("host", "cluster", "database").unionByName(target_names.select("host", "cluster", "database")),
        "cluster",
        "database",
    ).filter("database <> ''")
    cluster_databases = databases.select(
        "cluster",
        F.lit(DISTRIBUTED_DATABASES).alias("step"),
        F.col("database").alias("name"),
        text.create_database(F.col("database")).alias("statement"),
        "_least",
        "_greatest",
        F.col("_least").alias("_table_least"),
        F.col("_greatest").alias("_table_greatest"),
    )
    pointed_at = _offered(target_names, "cluster", "database", "name")
    stored = (
        _offered(rows.filter("create_table_query <> ''"), "cluster", "database", "name", "create_table_query")
        .withColumnRenamed("_least", "_table_least")
        .withColumnRenamed("_greatest", "_table_greatest")
    )
    local = pointed_at.join(stored, ["cluster", "database", "name"]).withColumn("step", F.lit(LOCAL_TABLES))
    own = (
        _offered(distributed, "cluster", "database", "name", "create_table_query")
        .withColumn("_table_least", F.col("_least"))
        .withColumn("_table_greatest", F.col("_greatest"))
        .withColumn("step", F.lit(DISTRIBUTED_TABLES))
    )
    cluster_tables = local.unionByName(own).select(
        "cluster",
        "step",
        F.concat_ws(".", "database", "name").alias("name"),
        text.if_not_exists(F.col("create_table_query")).alias("statement"),
        "_least",
        "_greatest",
        "_table_least",
        "_table_greatest",
    )
    from_cluster = (
        targets.select(*place, "host")
        .join(cluster_databases.unionByName(cluster_tables), "cluster")
        .filter(_from_another_host("_least", "_greatest") & _from_another_host("_table_least", "_table_greatest"))
    )
    # A statement that is both local and distributed keeps its earlier place.
    return (
        from_shard.select(*place, "step", "name", "statement")
        .unionByName(
            from_cluster.groupBy(*place, "name", "statement")
            .agg(F.min("step").alias("step"))
            .select(*place, "step", "name", "statement")
        )
        .orderBy(*place, "step", "name", "statement")
    )


def drop_table_plan(removed_hosts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Replicated tables to drop on each removed host before its set goes away."""
    return cat.drop_ddl(catalog.join(removed_hosts.select("host"), "host", "left_semi"), "host")
