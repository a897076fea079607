"""DDL derived from the system catalogs of many hosts.

A catalog is a DataFrame ``(host, database, name, engine, engine_full,
create_table_query)`` of strings; the source has no NULLs, so NULL counts as ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.functions import text

CATALOG_COLUMNS = ["database", "name", "engine", "engine_full", "create_table_query"]


def read_catalogs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of catalog dumps; a dump that has gone missing is skipped, not an error."""
    return spark.read.option("ignoreMissingFiles", True).parquet(*paths)


#: Hosts whose catalogs share a partition of the stored catalog.
HOSTS_PER_GROUP = 64


def _host_group() -> Column:
    return F.expr(f"host div {HOSTS_PER_GROUP}").alias("host_group")


def store_catalog(catalog: DataFrame, folder: str) -> None:
    """Write catalogs by groups of neighbouring hosts, sorted by host, so that a plan for few hosts reads few files."""
    keys = ["host_group", "host"]
    rows = catalog.select("*", _host_group()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.write.partitionBy("host_group").parquet(folder)


def read_hosts(spark: SparkSession, folder: str, hosts: DataFrame) -> DataFrame:
    """Stored catalog rows of the hosts in a table with a column host.

    The join is on the partition column too: which groups are read is known
    from the hosts when the plan runs (dynamic partition pruning).
    """
    wanted = hosts.select("host", _host_group()).distinct()
    return spark.read.parquet(folder).join(wanted, ["host_group", "host"], "left_semi").drop("host_group")


def scan_catalog(catalog: DataFrame, hosts: DataFrame) -> DataFrame:
    """Catalog rows of the listed hosts, leaving out those that cannot be reached.

    ``hosts`` is ``(host, available)``.  Equal rows of different hosts are kept.
    """
    reachable = hosts.filter("available").select("host")
    blank_nulls = {name: "" for name in CATALOG_COLUMNS if name in catalog.columns}
    return catalog.join(reachable, "host", "left_semi").fillna(blank_nulls)


def first_available(rows: DataFrame, endpoints: DataFrame, group: str, priority: str, ok: str) -> DataFrame:
    """Rows of the first endpoint of each group that answers.

    ``endpoints`` has one row per endpoint; ``rows`` carries group and priority.
    A group without an answering endpoint gives no rows.
    """
    chosen = endpoints.filter(ok).groupBy(group).agg(F.min(priority).alias(priority))
    return rows.join(chosen, [group, priority], "left_semi")


def unanswered_groups(endpoints: DataFrame, group: str, ok: str) -> DataFrame:
    """Groups all of whose endpoints failed: the only case that is an error."""
    return endpoints.groupBy(group).agg(F.bool_or(ok).alias("_any")).filter("NOT _any").select(group)


def database_ddl(catalog: DataFrame) -> DataFrame:
    # The statement must name the database: the source dialect resolves
    # ``name`` to the alias, Spark would take the table's own column.
    return (
        catalog.filter("database <> 'system'")
        .select(F.col("database").alias("name"), text.create_database(F.col("database")).alias("statement"))
        .distinct()
    )


def _visible_tables() -> Column:
    return F.expr("database <> 'system' AND create_table_query <> '' AND name NOT LIKE '.inner.%'")


def table_ddl(catalog: DataFrame) -> DataFrame:
    return (
        catalog.filter(_visible_tables())
        .select("name", text.if_not_exists(F.col("create_table_query")).alias("statement"))
        .distinct()
    )


def drop_ddl(catalog: DataFrame, *keys: str) -> DataFrame:
    return (
        catalog.filter("engine LIKE 'Replicated%'")
        .select(*keys, "name", text.drop_table(F.col("database"), F.col("name")).alias("statement"))
        .distinct()
    )


def _distributed(catalog: DataFrame) -> DataFrame:
    return catalog.filter("engine = 'Distributed'")


def distributed_targets(catalog: DataFrame) -> DataFrame:
    """The (database, name) pairs that distributed tables point at."""
    return (
        _distributed(catalog)
        .select(
            text.target_database(F.col("engine_full")).alias("database"),
            text.target_table(F.col("engine_full")).alias("name"),
        )
        .distinct()
    )


def distributed_database_ddl(catalog: DataFrame) -> DataFrame:
    """Databases of distributed tables and of the tables behind them."""
    both = F.array("database", text.target_database(F.col("engine_full")))
    return (
        _distributed(catalog)
        .select(F.explode(both).alias("name"))
        .filter("name <> ''")
        .distinct()
        .select("name", text.create_database(F.col("name")).alias("statement"))
    )


def distributed_local_tables(catalog: DataFrame) -> DataFrame:
    """Tables behind distributed tables, with their stored statement.

    Both sides are made distinct before the join, so a table that lives on
    every host meets its target once.
    """
    local = catalog.filter("create_table_query <> ''").select("database", "name", "create_table_query").distinct()
    return distributed_targets(catalog).join(local, ["database", "name"])


def qualified_ddl(tables: DataFrame, order: int) -> DataFrame:
    return tables.select(
        F.concat_ws(".", "database", "name").alias("name"),
        text.if_not_exists(F.col("create_table_query")).alias("statement"),
        F.lit(order).alias("ord"),
    )


def distributed_ddl(catalog: DataFrame) -> DataFrame:
    """One row per statement; the local tables (1) come before the distributed ones (2)."""
    distributed = _distributed(catalog).select("database", "name", "create_table_query")
    both = qualified_ddl(distributed, 2).unionByName(qualified_ddl(distributed_local_tables(catalog), 1))
    return both.groupBy("name", "statement").agg(F.min("ord").alias("ord")).orderBy("ord", "name", "statement")


def exclude_self(members: DataFrame, new_hosts: DataFrame) -> DataFrame:
    """Sources per new host: the other members of its cluster.

    A cluster of one host gives nothing to copy from.  ``members`` is
    ``(cluster, host)``, ``new_hosts`` the same for hosts to be filled.
    """
    sources = members.select("cluster", F.col("host").alias("source"))
    return new_hosts.select("cluster", "host").join(sources, "cluster").filter("source <> host")


def readiness(members: DataFrame, cluster: str) -> DataFrame:
    """Whether each host knows itself as a local member of the named cluster."""
    known = F.count_if((F.col("cluster") == cluster) & F.col("is_local")) > 0
    return members.groupBy("host").agg(known.alias("ready"))


def assert_ready(members: DataFrame, cluster: str) -> DataFrame:
    """The strict form: the job fails if a host is not ready."""
    checked = readiness(members, cluster).withColumn(
        "_check", F.assert_true("ready", F.concat(F.lit("host not ready: "), F.col("host").cast("string")))
    )
    return checked.filter("_check IS NULL").drop("_check")


def pending_statements(statements: DataFrame, ledger: DataFrame, keys: list[str], max_tries: int = 10) -> DataFrame:
    """Statements still to be run on each host.

    Those that succeeded are left out, and those that used up their tries.
    A table the host was refused with code 253 is attached instead of created.
    """
    done = ledger.filter("ok").select(*keys)
    tried = ledger.filter("NOT ok").select(*keys, "code", "attempts")
    return (
        statements.filter("statement <> ''")
        .join(done, keys, "left_anti")
        .join(tried, keys, "left")
        .withColumn("attempts", F.coalesce("attempts", F.lit(0)))
        .filter(F.col("attempts") < max_tries)
        .withColumn("statement", text.attach_on_conflict(F.col("statement"), F.coalesce("code", F.lit(0))))
        .drop("code")
    )
