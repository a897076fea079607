"""Desired against observed state: the plan tables of a fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions import names
from fleetspark.functions.text import split_namespaces

PLACE = ["cluster", "shard", "ordinal"]
SPEC = ["image", "replicas", "strategy"]

# Fixed value: an operator that runs here watches all namespaces.
SYSTEM_NAMESPACE = "kube-system"


def applied_snapshot(columns: list[str]) -> Column:
    """The applied spec as JSON, columns in a fixed order so equal specs are equal text."""
    return F.to_json(F.struct(*columns))


# Fixed value: the annotation that holds the last applied spec.
SNAPSHOT_ANNOTATION = "last-applied-configuration"


def same_annotations(new: Column, old: Column) -> Column:
    """Equal annotations, leaving the snapshot itself aside; none and an empty map are the same."""
    entries = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: k != SNAPSHOT_ANNOTATION)))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return entries(F.coalesce(new, none)) == entries(F.coalesce(old, none))


def reconcile(desired: DataFrame, observed: DataFrame, keys: list[str], changed: Column, *carry: str) -> DataFrame:
    """Add, Update, Delete or None per key.

    ``changed`` is evaluated on the joined row; both sides bring their own
    column names.  The join is on unique keys, so no key can be hot.
    """
    left = desired.withColumn("_wanted", F.lit(True))
    right = observed.withColumn("_seen", F.lit(True))
    action = (
        F.when(F.col("_seen").isNull(), "Add")
        .when(F.col("_wanted").isNull(), "Delete")
        .when(changed, "Update")
        .otherwise("None")
    )
    return left.join(right, keys, "full_outer").select(*keys, action.alias("action"), *carry)


def reconcile_plan(desired: DataFrame, observed: DataFrame, clusters: DataFrame) -> DataFrame:
    """Actions per replica with the new snapshot.

    ``desired`` carries the spec columns, ``observed`` the ``last_applied``
    JSON, and both may carry ``annotations``.  The test is against what was
    last applied, not against the live object; without a snapshot the replica
    counts as changed.  ``clusters`` is ``(inst, cluster, paused)``: paused
    clusters contribute nothing.
    """
    active = clusters.filter("NOT paused").select("inst", "cluster")
    wanted = desired.withColumn("snapshot", applied_snapshot(SPEC))
    changed = ~F.col("snapshot").eqNullSafe(F.col("last_applied"))
    if "annotations" in desired.columns and "annotations" in observed.columns:
        wanted = wanted.select(*PLACE, "snapshot", F.col("annotations").alias("_new_annotations"))
        seen = observed.select(*PLACE, "last_applied", F.col("annotations").alias("_old_annotations"))
        changed = changed | ~same_annotations(F.col("_new_annotations"), F.col("_old_annotations"))
    else:
        wanted, seen = wanted.select(*PLACE, "snapshot"), observed.select(*PLACE, "last_applied")
    plan = reconcile(wanted, seen, PLACE, changed, "snapshot")
    return plan.join(active, "cluster").select("inst", *PLACE, "action", "snapshot")


def action_counts(plan: DataFrame, phases: DataFrame, clusters: DataFrame) -> DataFrame:
    """Added, updated, deleted and ready replicas per installation, in one pass over each input."""
    planned = plan.select("inst", "action", F.lit(0).alias("_ready"))
    ready = (
        phases.filter("counts_ready")
        .select("cluster")
        .join(clusters.select("inst", "cluster"), "cluster")
        .select("inst", F.lit("").alias("action"), F.lit(1).alias("_ready"))
    )
    count = lambda name: F.count_if(F.col("action") == name)
    return (
        planned.unionByName(ready)
        .groupBy("inst")
        .agg(
            count("Add").alias("added"),
            count("Update").alias("updated"),
            count("Delete").alias("deleted"),
            F.sum("_ready").alias("ready"),
        )
    )


def action_events(plan: DataFrame, name: Column, failed: Column | None = None) -> DataFrame:
    """A Normal or Warning event for each action taken."""
    failed = F.lit(False) if failed is None else failed
    reason = F.when(F.col("action") == "Add", "Created").when(F.col("action") == "Update", "Update").otherwise("Deleted")
    verb = F.when(F.col("action") == "Add", "Created").when(F.col("action") == "Update", "Updated").otherwise("Deleted")
    return plan.filter("action <> 'None'").select(
        "inst",
        F.when(failed, "Warning").otherwise("Normal").alias("type"),
        reason.alias("reason"),
        F.format_string('%s set "%s"%s', verb, name, F.when(failed, " failed").otherwise("")).alias("message"),
    )


def upsert_plan(desired: DataFrame, current: DataFrame, keys: list[str], update: bool) -> DataFrame:
    """Create what is absent; what is there is kept in a first pass and overwritten in an update pass."""
    there = current.select(*keys).distinct().withColumn("_there", F.lit(True))
    action = F.when(F.col("_there").isNull(), "create").otherwise("update" if update else "keep")
    return desired.join(there, keys, "left").withColumn("action", action).drop("_there")


def surplus_replicas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replicas of the former spec that the new one lacks.

    ``guarded`` tells whether the shard is still there and has become smaller;
    the plan that follows the reference takes only those rows.
    """
    place = ["inst", "cluster", "shard", "ordinal"]
    side = lambda df, was, now: df.select(*place, F.lit(was).alias("_old"), F.lit(now).alias("_new"))
    both = side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy(*place).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    shards = both.groupBy("cluster", "shard").agg(F.sum("_old").alias("_olds"), F.sum("_new").alias("_news"))
    return (
        both.filter("_old = 1 AND _new = 0")
        .join(shards, ["cluster", "shard"])
        .select(*place, F.expr("_news > 0 AND _olds > _news").alias("guarded"))
    )


def merge_update(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """The row written on an update.

    Spec columns come from the new object; the last-seen stamp stays.  An
    object without a controller owner also takes owner and label from the new
    one and counts as changed.
    """
    new = desired.select(
        *PLACE,
        *[F.col(c).alias(f"new_{c}") for c in SPEC],
        F.col("owner").alias("new_owner"),
        F.col("label").alias("new_label"),
        applied_snapshot(SPEC).alias("snapshot"),
    )
    orphan = F.col("owner").isNull()
    changed = ~F.col("snapshot").eqNullSafe(F.col("last_applied"))
    return (
        new.join(observed.select(*PLACE, "last_applied", "last_seen", "owner", "label"), PLACE)
        .filter(changed | orphan)
        .select(
            *PLACE,
            *[F.col(f"new_{c}").alias(c) for c in SPEC],
            "last_seen",
            F.when(orphan, F.col("new_owner")).otherwise(F.col("owner")).alias("owner"),
            F.when(orphan, F.col("new_label")).otherwise(F.col("label")).alias("label"),
            orphan.alias("adopted"),
        )
    )


def diff_columns(a: DataFrame, b: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """Field-level difference of two tables: one row per key and differing column."""
    compared = [c for c in a.columns if c in b.columns and c not in keys and c not in ignore]
    left = a.select(*keys, *[F.col(c).cast("string").alias(f"_a_{c}") for c in compared], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).cast("string").alias(f"_b_{c}") for c in compared], F.lit(True).alias("_in_b"))
    fields = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(f"_a_{c}").alias("old"), F.col(f"_b_{c}").alias("new")) for c in compared]
    )
    differs = F.filter(fields, lambda f: ~f["old"].eqNullSafe(f["new"]))
    return left.join(right, keys, "full_outer").select(
        *keys,
        F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").otherwise("changed").alias("change"),
        F.inline(differs),
    )


def unseen_versions(new: DataFrame, seen: DataFrame) -> DataFrame:
    """Objects not yet known in this version."""
    return new.join(seen, ["namespace", "name", "version"], "left_anti")


def watched_namespaces(df: DataFrame, namespaces: list[str] | None) -> DataFrame:
    """Rows of the watched namespaces; an empty list watches all."""
    return df.filter(F.col("namespace").isin(namespaces)) if namespaces else df


def watch_list(own: str, single: str = "", listed: str = "", configured: list[str] | None = None) -> list[str]:
    """The namespaces to watch.

    A list from the environment comes before a single name from there, and that
    before the configuration.  With none, an operator in the system namespace
    watches all and any other one its own namespace.
    """
    if listed:
        chosen = split_namespaces(listed)
    elif single:
        chosen = [single]
    else:
        chosen = list(configured or [])
    return chosen or ([] if own == SYSTEM_NAMESPACE else [own])


def feed_namespace(namespaces: list[str] | None) -> str:
    """The namespace a feed is limited to: one listed namespace, otherwise all ('')."""
    return namespaces[0] if namespaces and len(namespaces) == 1 else ""


def match_labels(objects: DataFrame, selectors: DataFrame) -> DataFrame:
    """Pairs of selector and object where the object carries every label of the selector.

    Both sides are joined on one label pair only: for each selector the pair
    that the fewest objects of the namespace carry.  Its other labels are then
    checked on the candidates.  So a label all objects share costs nothing.
    ``objects`` has ``namespace`` and ``labels``; ``selectors`` ``selector``,
    ``namespace`` and ``match`` (maps).
    """
    pairs = objects.select("namespace", F.explode("labels").alias("_key", "_value"))
    wanted = selectors.select("selector", "namespace", "match", F.explode("match").alias("_key", "_value"))
    at = ["namespace", "_key", "_value"]
    counts = pairs.join(wanted.select(*at).distinct(), at, "left_semi").groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        wanted.join(counts, at)
        .groupBy("selector", "namespace")
        .agg(F.min(F.struct("_n", "_key", "_value")).alias("_pair"))
        .join(selectors, ["selector", "namespace"])
        .select("selector", "namespace", "match", "_pair._key", "_pair._value")
    )
    candidates = objects.select("*", F.explode("labels").alias("_key", "_value")).join(rarest, at)
    holds_all = F.forall(F.map_entries("match"), lambda e: F.element_at("labels", e["key"]).eqNullSafe(e["value"]))
    matched = candidates.filter(holds_all).drop("_key", "_value", "match")
    anything = selectors.filter(F.size("match") == 0).select("selector", "namespace")
    return matched.unionByName(objects.join(anything, "namespace").select(*matched.columns))


def object_counts(matched: DataFrame, expected: DataFrame) -> DataFrame:
    """Objects per selector and kind against the expected numbers."""
    found = matched.groupBy("selector", "kind").agg(F.count(F.lit(1)).alias("found"))
    return expected.join(found, ["selector", "kind"], "left").select(
        "selector",
        "kind",
        "expected",
        F.coalesce("found", F.lit(0)).alias("found"),
        (F.coalesce("found", F.lit(0)) == F.col("expected")).alias("ok"),
    )


def desired_objects(replicas: DataFrame, service_prefix: str = "svc-") -> DataFrame:
    """Objects an installation should have: three per replica, two common configurations, one service."""
    named = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"))
    replica = F.col("replica_name")
    per_replica = F.array(
        named("set", replica),
        named("service", replica),
        named("config", names.fill_pattern(names.REPLICA_CONFIG_NAME, di=F.col("inst"), replica=replica)),
    )
    common = F.array(
        named("service", F.concat(F.lit(service_prefix), F.col("inst").cast("string"))),
        named("config", names.fill_pattern(names.COMMON_CONFIG_NAME, di=F.col("inst"))),
        named("config", names.fill_pattern(names.COMMON_USERS_NAME, di=F.col("inst"))),
    )
    own = replicas.select("inst", F.inline(per_replica))
    return own.unionByName(replicas.select("inst").distinct().select("inst", F.inline(common)))


# Steps of a removal, in order.
DROP_TABLES, DELETE_SET, DELETE_VOLUMES, DELETE_CONFIG, DELETE_SERVICE, DELETE_COMMON, DELETE_ENTRY = range(1, 8)


def _step(step: int, kind: str, name: Column) -> Column:
    return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), name.cast("string").alias("name"))


def cascade_delete_plan(deleted: DataFrame, replicas: DataFrame, reclaim: DataFrame, service_prefix: str = "svc-") -> DataFrame:
    """Ordered removal of deleted installations, replica by replica, then their common objects.

    ``reclaim`` is ``(cluster, reclaim_delete)``; volumes go only where it is set.
    """
    replica = F.col("replica_name")
    per_replica = F.array(
        _step(DROP_TABLES, "tables", replica),
        _step(DELETE_SET, "set", replica),
        F.when(F.col("reclaim_delete"), _step(DELETE_VOLUMES, "volumes", replica)),
        _step(DELETE_CONFIG, "config", names.fill_pattern(names.REPLICA_CONFIG_NAME, di=F.col("inst"), replica=replica)),
        _step(DELETE_SERVICE, "service", replica),
    )
    common = F.array(
        _step(DELETE_COMMON, "config", names.fill_pattern(names.COMMON_CONFIG_NAME, di=F.col("inst"))),
        _step(DELETE_COMMON, "config", names.fill_pattern(names.COMMON_USERS_NAME, di=F.col("inst"))),
        _step(DELETE_ENTRY, "service", F.concat(F.lit(service_prefix), F.col("inst").cast("string"))),
    )
    going = deleted.select("inst")
    steps = (
        replicas.join(going, "inst", "left_semi")
        .join(reclaim, "cluster")
        .select("inst", "cluster", "shard", "ordinal", F.inline(F.filter(per_replica, lambda s: s.isNotNull())))
    )
    nowhere = [F.lit(None).cast(t).alias(c) for c, t in replicas.select("cluster", "shard", "ordinal").dtypes]
    return steps.unionByName(going.select("inst", *nowhere, F.inline(common)))


def map_to_owner(events: DataFrame, ownership: DataFrame) -> DataFrame:
    """Events of owned objects become events of the owner; own events keep their key.

    ``events`` has ``key`` and ``object`` (NULL for own events); ``ownership``
    is ``(object, owner)``.  Objects without an owner are no event at all.
    """
    owned = events.filter("object IS NOT NULL").join(ownership, "object").withColumn("key", F.col("owner"))
    return events.filter("object IS NULL").drop("object").unionByName(owned.select(*[c for c in events.columns if c != "object"]))


