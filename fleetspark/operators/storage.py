"""Storage claims, volumes and mounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions import names
from fleetspark.functions.quantities import quantity_bytes, size_change

# Least size of a data and of a log volume.
DATA_FLOOR = "1Gi"
LOG_FLOOR = "100Mi"


def class_lookup(classes: DataFrame) -> DataFrame:
    """Storage classes by name; the empty name leads to the default class.

    Of several default classes the first by name counts.  With none there is no
    row for the empty name, which the caller sees as an unknown class.
    """
    default = (
        classes.filter("is_default")
        .groupBy(F.lit("").alias("class"))
        .agg(F.min_by("allow_expansion", "class").alias("allow_expansion"))
    )
    return classes.select("class", "allow_expansion").unionByName(default)


def claim_validation(initial: DataFrame, updated: DataFrame, classes: DataFrame, check_class: bool = True) -> DataFrame:
    """A verdict on each updated claim.

    ``initial`` and ``updated`` are ``(object, claim, class, size)``.  New
    claims, smaller sizes and sizes that are no quantity are refused; a larger
    size needs a class that allows expansion; without an old size the new one
    is accepted.
    """
    before = initial.select("object", "claim", quantity_bytes(F.col("size")).alias("old_bytes"), F.lit(True).alias("_known"))
    after = updated.select("object", "claim", "class", quantity_bytes(F.col("size")).alias("new_bytes"))
    joined = after.join(before, ["object", "claim"], "left")
    change = size_change(F.col("old_bytes"), F.col("new_bytes"))
    if check_class:
        joined = joined.withColumn("class", F.coalesce("class", F.lit(""))).join(class_lookup(classes), "class", "left")
        grown = (
            F.when(F.col("allow_expansion").isNull(), "no storage class")
            .when(~F.col("allow_expansion"), "class forbids expansion")
            .otherwise("grow")
        )
    else:
        grown = F.lit("grow")
    verdict = (
        F.when(F.col("_known").isNull(), "new claim")
        .when(F.col("new_bytes").isNull(), "no quantity")
        .when(change > 0, grown)
        .when(change < 0, "decrease")
        .otherwise("accepted")
    )
    return joined.select("object", "claim", "old_bytes", "new_bytes", verdict.alias("verdict"))


def expected_volumes(claims: DataFrame, pods: Column) -> DataFrame:
    """Names of the volumes a set has: one per claim and pod ordinal."""
    ordinals = F.when(pods > 0, F.sequence(F.lit(0), pods - 1))
    return claims.withColumn("_ordinal", F.explode(ordinals)).select(
        "*",
        names.volume_name(F.col("claim"), names.pod_name(F.col("object").cast("string"), F.col("_ordinal"))).alias("volume"),
    ).drop("_ordinal")


def volume_resize_plan(
    actual: DataFrame, expected: DataFrame, volumes: DataFrame, pods: Column, classes: DataFrame, check_class: bool = True
) -> DataFrame:
    """Existing volumes that have to grow to what their claim now asks for.

    A set is left alone as a whole if ``claim_validation`` refuses one of its
    claims.  Volumes follow the claims of the actual set; a claim or volume that
    is missing is skipped.  ``recreate`` marks sets one of whose claims grew.
    """
    refused = claim_validation(actual, expected, classes, check_class).filter(~F.col("verdict").isin("accepted", "grow"))
    expected = expected.join(refused.select("object"), "object", "left_anti")
    old = actual.select("object", "claim", quantity_bytes(F.col("size")).alias("_old_claim"))
    new = expected.select("object", "claim", F.col("size").alias("new_size"), quantity_bytes(F.col("size")).alias("new_bytes"))
    claims = old.join(new, ["object", "claim"]).withColumn(
        "_grew", size_change(F.col("_old_claim"), F.col("new_bytes")) > 0
    )
    recreate = claims.groupBy("object").agg(F.bool_or("_grew").alias("recreate"))
    existing = volumes.select("object", "volume", F.col("size").alias("old_size"), quantity_bytes(F.col("size")).alias("old_bytes"))
    return (
        expected_volumes(claims, pods)
        .join(existing, ["object", "volume"])
        .filter(size_change(F.col("old_bytes"), F.col("new_bytes")) > 0)
        .join(recreate, "object")
        .select("object", "claim", "volume", "old_size", "new_size", "recreate")
    )


def orphan_volumes(volumes: DataFrame, actual: DataFrame, expected: DataFrame, pods: Column) -> DataFrame:
    """Volumes that neither the actual nor the expected sets account for."""
    claims = actual.select("object", "claim").unionByName(expected.select("object", "claim")).distinct()
    keep = expected_volumes(claims, pods).select("object", "volume")
    return volumes.join(keep, ["object", "volume"], "left_anti")


def resolve_mounts(mounts: DataFrame, sets: DataFrame, claims: list[str], data_path: str, log_path: str) -> DataFrame:
    """Claims, mounts and side containers of each set: ``(set, item, name, path)``.

    A mount whose name is a known claim attaches that claim.  The default data
    claim, then the default log claim are mounted at their fixed paths, unless
    the claim is unknown or its name or path is taken.  A known log claim adds
    a side container.

    What a set has mounted is folded to a few flags, so a set with very many
    mounts costs no more than one row.
    """
    known = lambda c: F.coalesce(c.isin(claims), F.lit(False))
    defaults = sets.select("set", "data_claim", "log_claim")
    declared = mounts.select("set", "mount", "path").distinct()
    explicit = declared.filter(known(F.col("mount"))).select(
        "set", F.lit("claim").alias("item"), F.col("mount").alias("name"), F.lit("").alias("path")
    )

    taken = (
        declared.join(defaults, "set")
        .groupBy("set")
        .agg(
            F.bool_or((F.col("mount") == F.col("data_claim")) | (F.col("path") == data_path)).alias("_data_taken"),
            F.bool_or((F.col("mount") == F.col("log_claim")) | (F.col("path") == log_path)).alias("_log_taken"),
        )
    )
    facts = defaults.join(taken, "set", "left")
    data = known(F.col("data_claim")) & ~F.coalesce("_data_taken", F.lit(False))
    same = data & ((F.col("data_claim") == F.col("log_claim")) | F.lit(data_path == log_path))
    log = known(F.col("log_claim")) & ~F.coalesce("_log_taken", F.lit(False)) & ~same
    item = lambda kind, name, path: F.struct(F.lit(kind).alias("item"), name.alias("name"), F.lit(path).alias("path"))
    items = F.array(
        F.when(data, item("claim", F.col("data_claim"), "")),
        F.when(data, item("mount", F.col("data_claim"), data_path)),
        F.when(log, item("claim", F.col("log_claim"), "")),
        F.when(log, item("mount", F.col("log_claim"), log_path)),
        F.when(known(F.col("log_claim")), item("container", F.lit("log"), "")),
    )
    added = facts.select("set", F.inline(F.filter(items, lambda i: i.isNotNull())))
    return explicit.unionByName(added).distinct()


def storage_floor(installations: DataFrame, claim_templates: DataFrame) -> DataFrame:
    """Errors of default data and log templates that are missing or too small.

    ``claim_templates`` is ``(inst, claim, size)``; the first of a name counts
    (``ord``).  Without any template the rule does not apply.
    """
    first = claim_templates.groupBy("inst", "claim").agg(F.min_by("size", "ord").alias("size"))
    declared = first.groupBy("inst").agg(F.lit(True).alias("_declared"))
    wanted = F.array(
        F.struct(F.lit("data").alias("volume"), F.col("data_claim").alias("claim"), F.lit(DATA_FLOOR).alias("floor")),
        F.struct(F.lit("log").alias("volume"), F.col("log_claim").alias("claim"), F.lit(LOG_FLOOR).alias("floor")),
    )
    checked = (
        installations.select("inst", F.inline(wanted))
        .filter("claim <> ''")
        .join(declared, "inst")
        .join(first, ["inst", "claim"], "left")
    )
    missing = F.col("size").isNull()
    small = F.coalesce(quantity_bytes(F.col("size")), F.lit(0)) < quantity_bytes(F.col("floor"))
    return checked.filter(missing | small).select(
        "inst",
        F.when(missing, F.format_string("%s volume %s is not declared", "volume", "claim"))
        .otherwise(F.format_string("%s volume is below %s", "volume", "floor"))
        .alias("error"),
    )


def no_scale_in(old: DataFrame, new: DataFrame, claim_templates: DataFrame) -> DataFrame:
    """Errors of installations that lose clusters, shards or replicas.

    ``old`` and ``new`` are ``(inst, cluster, shards, replicas)`` as written in
    the specs.  Checked only where claim templates exist.
    """
    before = old.select("inst", "cluster", F.col("shards").alias("_s"), F.col("replicas").alias("_r"), F.lit(1).alias("_old"))
    after = new.select("inst", "cluster", "shards", "replicas", F.lit(1).alias("_new"))
    smaller = F.col("_new").isNotNull() & ((F.col("shards") < F.col("_s")) | (F.col("replicas") < F.col("_r")))
    folded = (
        before.join(after, ["inst", "cluster"], "full_outer")
        .groupBy("inst")
        .agg(
            F.count("_old").alias("_olds"),
            F.count("_new").alias("_news"),
            F.count_if(F.coalesce(smaller, F.lit(False))).alias("_smaller"),
        )
        .join(claim_templates.select("inst").distinct(), "inst", "left_semi")
    )
    errors = F.array(
        F.when(F.col("_news") < F.col("_olds"), "clusters are removed"),
        F.when(F.col("_smaller") > 0, "shards or replicas are removed"),
    )
    return folded.select("inst", F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("error"))


def no_claim_shrink(old: DataFrame, new: DataFrame) -> DataFrame:
    """Errors of claim templates that become smaller: ``(inst, claim, size, ord)``, first of a name."""
    first = lambda df, alias: df.groupBy("inst", "claim").agg(quantity_bytes(F.min_by("size", "ord")).alias(alias))
    shrunk = first(old, "_old").join(first(new, "_new"), ["inst", "claim"])
    return (
        shrunk.filter(size_change(F.col("_old"), F.col("_new")) < 0)
        .select("inst", F.lit("a claim becomes smaller").alias("error"))
        .distinct()
    )


def collect_errors(installations: DataFrame, errors: DataFrame) -> DataFrame:
    """All errors of an installation in one row.

    Messages are made distinct first; each rule has a fixed set of messages per
    installation, so the list stays short.
    """
    gathered = (
        errors.distinct()
        .groupBy("inst")
        .agg(F.array_sort(F.collect_list("error")).alias("_errors"))
        .select("inst", F.size("_errors").alias("error_count"), F.array_join("_errors", "; ").alias("errors"))
    )
    return (
        installations.select("inst")
        .join(gathered, "inst", "left")
        .select(
            "inst",
            F.col("error_count").isNull().alias("accepted"),
            F.coalesce("error_count", F.lit(0)).alias("error_count"),
            F.coalesce("errors", F.lit("")).alias("errors"),
        )
    )
