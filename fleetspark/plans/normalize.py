"""The normalised fleet: every replica with what templates, defaults and layers give it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.operators.settings import merge_override


def template_defaults(own: DataFrame, resolved: DataFrame) -> DataFrame:
    """Claim template name and size per installation: templates in order, the installation's own last."""
    layers = resolved.select(
        "inst", F.lit(0).alias("layer"), "ord",
        F.col("template_storage_class").alias("data_claim"), F.col("template_size").alias("claim_size"),
    ).unionByName(
        own.select("inst", F.lit(1).alias("layer"), F.lit(0).cast("bigint").alias("ord"), "data_claim", "claim_size")
    )
    present = {"data_claim": F.col("data_claim") != "", "claim_size": F.col("claim_size") > 0}
    return merge_override(layers, ["inst"], present, ["layer", "ord"])


def normalized_replicas(replicas: DataFrame, defaults: DataFrame, inherited: DataFrame, nodes: DataFrame, users: DataFrame) -> DataFrame:
    """One row per replica with its claim defaults and the number of settings and files it inherits.

    ``nodes`` are the coordination nodes of clusters and ``users`` the users'
    settings of installations, whose paths begin with the user; each is folded
    to its owner before it meets the replicas.
    """
    per_cluster = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("nodes"), F.min_by("host", "ord").alias("first_node"))
    user = F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1)))
    per_inst = users.groupBy(F.col("owner").alias("inst")).agg(F.count_distinct(user).alias("users"))
    counted = inherited.groupBy("replica_name").agg(
        F.count_if(F.col("kind") == "files").alias("files"), F.count_if(F.col("kind") == "settings").alias("settings")
    )
    return (
        replicas.join(counted, "replica_name", "left")
        .join(defaults.join(per_inst, "inst", "full_outer"), "inst", "left")
        .join(per_cluster, "cluster", "left")
        .select(
            "inst",
            "cluster",
            "shard_name",
            "replica_name",
            "internal_replication",
            F.coalesce("data_claim", F.lit("")).alias("data_claim"),
            F.coalesce("claim_size", F.lit(0)).alias("claim_size"),
            F.coalesce("files", F.lit(0)).alias("files"),
            F.coalesce("settings", F.lit(0)).alias("settings"),
            F.coalesce("users", F.lit(0)).alias("users"),
            F.coalesce("nodes", F.lit(0)).alias("nodes"),
            F.coalesce("first_node", F.lit("")).alias("first_node"),
        )
    )


# Only what has changed ----------------------------------------------------------


def dependencies(references: DataFrame) -> DataFrame:
    """The installations that depend on a template's name: rows (kind, id, inst), indexed from the template's side.

    A reference depends on its own name and on that name in the installation's
    namespace, also while there is no such template: one that comes counts too.
    """
    either = F.explode(F.array(F.concat_ws("/", "namespace", "name"), F.concat_ws("/", "own_namespace", "name")))
    named = references.select(F.lit("template").alias("kind"), either.alias("id"), "inst")
    own = references.select("inst").distinct().select(F.lit("installation").alias("kind"), F.col("inst").cast("string").alias("id"), "inst")
    return named.distinct().unionByName(own)


def affected(changes: DataFrame, index: DataFrame) -> DataFrame:
    """Installations that depend on changed objects, rows (kind, id); a changed installation also without references."""
    own = changes.filter("kind = 'installation'").select(F.col("id").cast("bigint").alias("inst"))
    return index.join(changes.select("kind", "id").distinct(), ["kind", "id"]).select("inst").unionByName(own).distinct()


def renormalized(previous: DataFrame, touched: DataFrame, recompute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The former result with the rows of the touched installations made anew.

    ``recompute`` gets the touched installations and reads only what belongs to
    them; the result equals a full run on the changed inputs.
    """
    return previous.join(touched, "inst", "left_anti").unionByName(recompute(touched))
