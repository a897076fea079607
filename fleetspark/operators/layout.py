"""Topology: from requested counts to one row per shard and per replica.

A layout has one row per cluster with ``inst``, ``cluster``,
``installation_name``, ``cluster_name``, ``shards_raw`` and ``replicas_raw``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions import names, text
from fleetspark.session import materialize

# Fixed value: name of the cluster given to an installation that declares none.
DEFAULT_CLUSTER = "cluster"


def at_least_one(count: Column) -> Column:
    return F.greatest(F.coalesce(count, F.lit(0)), F.lit(1)).cast("int")


def layout_defaults(layout: DataFrame, installations: DataFrame) -> DataFrame:
    """Counts of zero become one; an installation without clusters gets one by default."""
    full = installations.select("inst").join(
        layout.select("inst", F.col("cluster").cast("string").alias("cluster"), "shards_raw", "replicas_raw"), "inst", "left"
    )
    return full.select(
        "inst",
        F.coalesce("cluster", F.lit(DEFAULT_CLUSTER)).alias("cluster"),
        at_least_one(F.col("shards_raw")).alias("shards"),
        at_least_one(F.col("replicas_raw")).alias("replicas"),
        F.col("cluster").isNull().alias("defaulted"),
    )


def expand_shards(layout: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """One row per shard.

    ``declared`` is ``(cluster, shard_name)``: shards named in the spec.  They
    are all kept; generated ones fill up from the declared count to the wanted
    count.  A generated name that is also declared gives one shard.
    """
    counted = layout.withColumn("shards", at_least_one(F.col("shards_raw"))).withColumn(
        "replicas_count", at_least_one(F.col("replicas_raw"))
    )
    keep = ["inst", "cluster", "installation_name", "cluster_name", "replicas_count"]
    keep += [c for c in ("internal_raw",) if c in layout.columns]
    if declared is None:
        start = counted.withColumn("_start", F.lit(0))
    else:
        present = declared.groupBy("cluster").agg(F.count_distinct("shard_name").cast("int").alias("_start"))
        start = counted.join(present, "cluster", "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    # sequence(0, -1) counts down, so the empty case is guarded.
    indexes = F.when(F.col("_start") < F.col("shards"), F.expr("sequence(_start, shards - 1)"))
    generated = start.select(*keep, F.explode(indexes).alias("shard")).withColumn(
        "shard_name", names.shard_name(F.col("installation_name"), F.col("cluster_name"), F.col("shard"))
    )
    if declared is None:
        return generated
    own = (
        declared.select("cluster", "shard_name")
        .distinct()
        .join(counted.select(*keep), "cluster")
        .withColumn("shard", names.last_ordinal(F.col("shard_name")))
    )
    columns = [*keep, "shard", "shard_name"]
    extra = generated.join(own.select("cluster", "shard_name"), ["cluster", "shard_name"], "left_anti")
    return own.select(*columns).unionByName(extra.select(*columns))


def slots_per_shard(slots: DataFrame) -> DataFrame:
    """Slots of deleted replicas as ``(shard_name, ordinal)``, each once.

    A slot belongs to the shard whose name and a dash it starts with.  Matching
    by substring would hand a slot of shard 10 to shard 1 as well, and would be
    a join without a key.
    """
    return slots.select(
        names.name_prefix(F.col("slot")).alias("shard_name"), names.last_ordinal(F.col("slot")).alias("ordinal")
    ).distinct()


def allocate_ordinals(shards: DataFrame, slots: DataFrame) -> DataFrame:
    """Each shard with its replica count and the ordinals given out.

    With n slots in a shard of c replicas, the c - n smallest ordinals that are
    no slot are used; if n >= c the slots are ignored.  Only slots below c can
    matter for the choice, so the array per shard never outgrows c.
    """
    wanted = shards.select("shard_name", "replicas_count")
    used = (
        slots_per_shard(slots)
        .join(wanted, "shard_name")
        .groupBy("shard_name")
        .agg(
            F.count(F.lit(1)).cast("int").alias("_slots"),
            F.collect_list(
                F.when((F.col("ordinal") >= 0) & (F.col("ordinal") < F.col("replicas_count")), F.col("ordinal"))
            ).alias("_taken"),
        )
    )
    honoured = F.coalesce(F.col("_slots"), F.lit(0)) < F.col("replicas_count")
    taken = F.when(honoured & F.col("_taken").isNotNull(), F.col("_taken")).otherwise(F.array().cast("array<int>"))
    count = F.col("replicas_count") - F.when(honoured, F.coalesce(F.col("_slots"), F.lit(0))).otherwise(0)
    free = F.array_except(F.expr("sequence(0, replicas_count - 1)"), taken)
    return (
        shards.join(used, "shard_name", "left")
        .withColumn("replica_count", count.cast("int"))
        .withColumn("ordinals", F.slice(free, F.lit(1), F.col("replica_count")))
        .drop("_slots", "_taken")
    )


def internal_replication(shards: DataFrame) -> DataFrame:
    """The flag of a shard; without a readable value it is on from two replicas."""
    raw = F.col("internal_raw") if "internal_raw" in shards.columns else F.lit("")
    return shards.withColumn(
        "internal_replication", text.flag_text(F.coalesce(raw, F.lit("")), F.col("replica_count") > 1)
    )


def allocate_replicas(layout: DataFrame, slots: DataFrame, declared_shards: DataFrame | None = None) -> DataFrame:
    """One row per replica with its names."""
    shards = internal_replication(allocate_ordinals(expand_shards(layout, declared_shards), slots))
    return shards.select(
        "inst",
        "cluster",
        "installation_name",
        "cluster_name",
        "shard",
        "shard_name",
        "replica_count",
        "internal_replication",
        F.explode("ordinals").alias("ordinal"),
    ).withColumn("replica_name", names.replica_name(F.col("shard_name"), F.col("ordinal")))


def keep_declared_replicas(shards: DataFrame, declared: DataFrame) -> DataFrame:
    """Replicas of shards some of whose replicas are declared by name.

    ``declared`` is ``(shard_name, replica_name)``.  Declared replicas count
    toward the wanted number and generated ones fill the rest in order.  If
    more are declared than wanted, those with no generated name are removed.
    """
    count = declared.groupBy("shard_name").agg(F.count_distinct("replica_name").cast("int").alias("_declared"))
    with_count = shards.join(count, "shard_name", "left").withColumn("_declared", F.coalesce("_declared", F.lit(0)))
    generated = with_count.select(
        "shard_name", "replica_count", "_declared", F.posexplode("ordinals").alias("_at", "ordinal")
    ).withColumn("replica_name", names.replica_name(F.col("shard_name"), F.col("ordinal")))
    filled = generated.filter(F.col("_at") >= F.col("_declared")).select("shard_name", "replica_name")
    named = declared.select("shard_name", "replica_name").distinct()
    crowded = with_count.filter(F.col("_declared") > F.col("replica_count")).select("shard_name")
    kept = named.join(crowded, "shard_name", "left_anti").unionByName(
        named.join(crowded, "shard_name", "left_semi").join(
            generated.select("shard_name", "replica_name"), ["shard_name", "replica_name"], "left_semi"
        )
    )
    return kept.unionByName(filled).distinct()


def previous_layout(layout: DataFrame) -> DataFrame:
    return layout.withColumn("shards_raw", F.col("prev_shards")).withColumn("replicas_raw", F.col("prev_replicas"))


def replica_names(replicas: DataFrame, namespaces: DataFrame) -> DataFrame:
    """All generated names of a replica."""
    full = replicas.join(namespaces.select("inst", "namespace"), "inst")
    return full.select(
        "inst",
        "cluster",
        "shard_name",
        "replica_name",
        names.pod_name(F.col("replica_name"), F.lit(0)).alias("pod_name"),
        names.volume_name(F.lit("data"), names.pod_name(F.col("replica_name"), F.lit(0))).alias("data_volume"),
        names.host_address(F.col("replica_name"), F.col("namespace")).alias("address"),
        names.fill_pattern(
            names.REPLICA_CONFIG_NAME, di=F.col("inst"), replica=F.col("replica_name")
        ).alias("config_name"),
        names.fill_pattern(names.HOST_REGEXP, di=F.col("inst"), namespace=F.col("namespace")).alias("host_regexp"),
    )


def replica_macros(replicas: DataFrame) -> DataFrame:
    """Macro values of each replica, one row per macro."""
    pairs = {
        "installation": F.col("inst").cast("string"),
        f"{names.ALL_SHARDED}-shard": F.lit("0"),
        "cluster": F.col("cluster").cast("string"),
        "shard": names.last_ordinal(F.col("shard_name")).cast("string"),
        "replica": F.col("replica_name"),
    }
    macros = F.array(*[F.struct(F.lit(k).alias("macro"), v.alias("value")) for k, v in pairs.items()])
    return replicas.select("replica_name", F.inline(macros))


def topology_counts(replicas: DataFrame) -> DataFrame:
    """Clusters, shards and replicas per installation, exact.

    Shards are folded first, so the distinct counts work on far fewer rows.
    """
    shards = replicas.groupBy("inst", "cluster", "shard_name").agg(F.count(F.lit(1)).alias("replicas"))
    clusters = shards.groupBy("inst", "cluster").agg(
        F.count(F.lit(1)).alias("shards"), F.sum("replicas").alias("replicas")
    )
    return clusters.groupBy("inst").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("shards").alias("shards"), F.sum("replicas").alias("replicas")
    )


def split_owners(rows: DataFrame, owner: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of owners with at most that many rows, dealt out by owner, and rows of the others, None if there are none.

    What is made of the first part per owner needs no further exchange; only
    owners of bounded size are given to one task whole.  The number of tasks
    follows the number of rows, as what is made of them may be much larger.
    rows is read twice.
    """
    counts = materialize(rows.groupBy(*owner).agg(F.count(F.lit(1)).alias("_rows")), "owner-rows")
    total, longest = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 * most)))
    if longest <= most:
        return rows.repartition(tasks, *owner), None
    large = counts.filter(F.col("_rows") > most).select(*owner)
    return rows.join(large, owner, "left_anti").repartition(tasks, *owner), rows.join(large, owner, "left_semi")


def prefix_sums(rows: DataFrame, owner: list[str], order: list[str], size: str, name: str) -> DataFrame:
    """rows with the sum of the sizes before each within its owner, in the given order.

    The rows are sorted in ranges over all owners, so an owner of any size is
    spread over tasks.  A range sums within itself; what an owner has in
    earlier ranges is added from the ranges' sums, at most one per owner and
    range.
    """
    sorted_rows = rows.repartitionByRange(*owner, *order).sortWithinPartitions(*owner, *order)
    parts = materialize(sorted_rows.withColumn("_part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy(*owner, "_part").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*owner).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    up_to = Window.partitionBy(*owner, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(size).over(up_to), F.lit(0))
    return parts.withColumn("_inside", inside).join(starts, [*owner, "_part"]).select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))


def numbered(rows: DataFrame, owner: str, order: list[str], name: str) -> DataFrame:
    """Distinct rows (owner, order..) with their dense number from 1 within the owner, in the given order."""
    distinct = rows.select(owner, *order).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return prefix_sums(distinct, [owner], order, "_one", name).drop("_one").withColumn(name, F.col(name) + 1)


def routing_topology(replicas: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Routing entries: the user's clusters, one shard of all replicas, and each replica its own shard.

    A shard is named rather than numbered, so no total order per installation
    is needed (``numbered`` gives numbers).  Weights are a column of the
    replicas or a table ``(shard_name, weight)``; only positive ones show.
    """
    columns = ["inst", "routing_cluster", "routing_shard", "internal_replication", "weight", "host"]
    user = replicas
    if weights is None and "weight" in replicas.columns:
        user = user.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")))
    elif weights is None:
        user = user.withColumn("weight", F.lit(None).cast("int"))
    else:
        user = user.join(weights, "shard_name", "left").withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")))
    user = user.select(
        "inst",
        F.col("cluster").cast("string").alias("routing_cluster"),
        F.col("shard_name").alias("routing_shard"),
        "internal_replication",
        "weight",
        F.col("replica_name").alias("host"),
    )
    every = replicas.select("inst", F.col("replica_name").alias("host")).distinct()
    generated = F.array(
        F.struct(
            F.lit(names.ALL_REPLICATED).alias("routing_cluster"),
            F.lit("all").alias("routing_shard"),
            F.lit("true").alias("internal_replication"),
        ),
        F.struct(
            F.lit(names.ALL_SHARDED).alias("routing_cluster"),
            F.col("host").alias("routing_shard"),
            F.lit("false").alias("internal_replication"),
        ),
    )
    auto = every.select("inst", "host", F.inline(generated)).withColumn("weight", F.lit(None).cast("int"))
    return user.select(*columns).unionByName(auto.select(*columns))
