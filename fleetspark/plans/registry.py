"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetspark.functions import hashes, names, text
from fleetspark.operators import catalog as cat
from fleetspark.operators import changes, documents, layout, nested, reconcile, settings, status, storage, templates
from fleetspark.plans import admission, config_documents, normalize, schema_sync
from fleetspark.plans import fleet_status as status_plan
from fleetspark.session import fresh_dir, materialize, tune
from fleetspark.sources import fleet_tables as fx
from fleetspark.sources import logs, settings_json
from fleetspark.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark), sf_dir.rstrip("/"))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    QUERIES[query.__name__] = run
    return query


# Catalogs and DDL -------------------------------------------------------------


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    return cat.scan_catalog(fx.catalog_tables(spark, sf), fx.hosts(spark, sf))


@register
def catalog_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _scanned(spark, sf).select("host", *cat.CATALOG_COLUMNS)


@register
def first_available_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    places = fx.hosts(spark, sf)
    rows = fx.catalog_tables(spark, sf).join(places.select("host", "cluster"), "host")
    chosen = cat.first_available(rows, places, "cluster", "host", "available")
    return chosen.select("cluster", "host", "database", "name")


@register
def replica_database_ddl(spark: SparkSession, sf: str) -> DataFrame:
    return cat.database_ddl(_scanned(spark, sf))


@register
def replica_table_ddl(spark: SparkSession, sf: str) -> DataFrame:
    return cat.table_ddl(_scanned(spark, sf))


@register
def distributed_database_ddl(spark: SparkSession, sf: str) -> DataFrame:
    return cat.distributed_database_ddl(_scanned(spark, sf))


@register
def distributed_local_tables(spark: SparkSession, sf: str) -> DataFrame:
    return cat.distributed_local_tables(_scanned(spark, sf))


@register
def distributed_ddl(spark: SparkSession, sf: str) -> DataFrame:
    return cat.distributed_ddl(_scanned(spark, sf))


@register
def schema_sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    catalog = materialize(fx.catalog_tables(spark, sf), "catalog")
    return schema_sync.schema_sync_plan(fx.hosts(spark, sf), catalog)


@register
def drop_table_plan(spark: SparkSession, sf: str) -> DataFrame:
    removed = fx.hosts(spark, sf).filter("phase = 'Scale'")
    return schema_sync.drop_table_plan(removed, fx.catalog_tables(spark, sf))


@register
def catalog_of_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of the hosts that are being scaled, from the catalogs stored by host."""
    folder = fresh_dir(spark, "catalog-by-host")
    cat.store_catalog(fx.catalog_tables(spark, sf), folder)
    return cat.read_hosts(spark, folder, fx.hosts(spark, sf).filter("phase = 'Scale'")).select("host", "database", "name", "engine")


@register
def surplus_drop_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What has to be dropped on each replica that a smaller shard leaves out: number of tables, first and last statement.

    Every replica is a host of its own, with the tables of one of the given
    catalogs; a catalog's statements are folded before they meet the replicas.
    """
    hosts = fx.table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    gone = surplus_replicas(spark, sf).filter("guarded").drop("guarded")
    gone = gone.withColumn("host", F.pmod(F.expr("cluster * 12 + shard * 4 + ordinal"), hosts))
    statements = schema_sync.drop_table_plan(gone.select("host").distinct(), fx.catalog_tables(spark, sf))
    folded = statements.groupBy("host").agg(F.count(F.lit(1)).alias("tables"), F.min("statement").alias("first"), F.max("statement").alias("last"))
    return gone.join(folded, "host").select("inst", "cluster", "shard", "ordinal", "tables", "first", "last")


@register
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    return cat.readiness(fx.cluster_members(spark, sf), "all-sharded")


@register
def pending_statements(spark: SparkSession, sf: str) -> DataFrame:
    statements = fx.catalog_tables(spark, sf).select(
        "host", "part", "name", text.if_not_exists(F.col("create_table_query")).alias("statement")
    )
    pending = cat.pending_statements(statements, fx.statement_ledger(spark, sf), ["host", "part"])
    return pending.select("host", "part", "name", "statement", "attempts")


# Topology ---------------------------------------------------------------------


def _replicas(spark: SparkSession, sf: str) -> DataFrame:
    return layout.allocate_replicas(fx.fleet_layout(spark, sf), fx.delete_slots(spark, sf))


def _desired(spark: SparkSession, sf: str) -> DataFrame:
    """Replicas with the spec they should run."""
    return _replicas(spark, sf).select(
        "inst",
        "cluster",
        "shard",
        "ordinal",
        "replica_name",
        ((F.col("cluster") + F.col("shard") + F.col("ordinal")) % 2).cast("int").alias("image"),
        F.lit(1).alias("replicas"),
        F.lit("RollingUpdate").alias("strategy"),
        F.concat(F.lit("owner-"), "cluster").alias("owner"),
        F.lit("desired").alias("label"),
    )


@register
def layout_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return layout.layout_defaults(fx.fleet_layout(spark, sf), fx.installation_keys(spark, sf))


@register
def slot_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = fx.delete_slots(spark, sf).select("slot", names.last_ordinal(F.col("slot")).alias("ordinal"))
    return parsed.groupBy("ordinal").agg(
        F.count(F.lit(1)).alias("slots"), F.count_distinct("slot").alias("distinct_slots")
    )


@register
def allocate_replicas(spark: SparkSession, sf: str) -> DataFrame:
    return _replicas(spark, sf).drop("installation_name", "cluster_name")


@register
def replica_names(spark: SparkSession, sf: str) -> DataFrame:
    return layout.replica_names(_replicas(spark, sf), fx.installations(spark, sf))


@register
def replica_macros(spark: SparkSession, sf: str) -> DataFrame:
    return layout.replica_macros(_replicas(spark, sf))


@register
def topology_counts(spark: SparkSession, sf: str) -> DataFrame:
    return layout.topology_counts(_replicas(spark, sf))


@register
def routing_topology(spark: SparkSession, sf: str) -> DataFrame:
    return layout.routing_topology(materialize(_weighted(_replicas(spark, sf)), "replicas"))


def _weighted(replicas: DataFrame) -> DataFrame:
    return replicas.withColumn("weight", (F.col("cluster") % 3).cast("int"))


@register
def surplus_replicas(spark: SparkSession, sf: str) -> DataFrame:
    place = ["inst", "cluster", "shard", "ordinal"]
    before = layout.previous_layout(fx.fleet_layout(spark, sf))
    no_slots = spark.createDataFrame([], "cluster bigint, slot string")
    old = layout.allocate_replicas(before, no_slots).select(*place)
    new = _replicas(spark, sf).select(*place)
    return reconcile.surplus_replicas(materialize(old, "old-replicas"), materialize(new, "new-replicas"))


@register
def shard_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The number of each replica as a shard of its own, counted over its installation."""
    return layout.numbered(_replicas(spark, sf), "inst", ["replica_name"], "shard_number")


# Reconciliation ---------------------------------------------------------------


def _specs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Desired and last applied specs of the orders as JSON, with lists of containers in different orders."""
    lines = (
        fx.table(spark, sf, "lineitem")
        .select(F.col("l_orderkey").alias("object"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey")
        .repartition("object")
        .groupBy("object", "line")
        .agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    )
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("object"), "o_orderpriority")

    def spec(rows: DataFrame, image: str, ports: Column, replicas: str, order: str) -> DataFrame:
        container = F.struct(F.concat(F.lit("c"), "line").alias("name"), F.expr(f"concat('i', {image})").alias("image"), ports.alias("ports"))
        listed = rows.groupBy("object").agg(F.sort_array(F.collect_list(F.struct(F.expr(order).alias("at"), container.alias("c")))).alias("list"))
        template = F.struct(F.col("o_orderpriority").alias("priority"), F.transform("list", lambda e: e["c"]).alias("containers"))
        body = F.struct(F.expr(replicas).alias("replicas"), F.struct(F.col("object").alias("resourceVersion")).alias("metadata"), template.alias("template"))
        return listed.join(orders, "object").select("object", F.to_json(body).alias("spec"))

    two, one = F.array(F.col("supp") % 4, F.col("supp") % 3), F.array(F.col("supp") % 4)
    new = spec(lines, "part % 5", two, "object % 4 + 1", "-line")
    old = spec(lines.filter("part % 7 <> 0"), "part % 4", one, "object % 3 + 1", "line")
    return new, old


@register
def spec_differences(spark: SparkSession, sf: str) -> DataFrame:
    """What has changed in each object's nested spec since it was applied, by path."""
    new, old = _specs(spark, sf)
    return nested.nested_differences(new, old, ["object"], "spec")


@register
def tree_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Installations, clusters, shards and replicas whose desired image is not the live one, from the roots down."""
    inst = fx.fleet_layout(spark, sf).select("cluster", "inst")
    digest = F.sha1(F.col("image").cast("string")).alias("digest")
    place = ["inst", "cluster", "shard", "ordinal"]
    new = _desired(spark, sf).select(*place, digest)
    old = fx.observed_replicas(spark, sf).join(inst, "cluster").select(*place, digest)
    trees = [nested.digest_tree(materialize(side, "leaves")) for side in (new, old)]
    return nested.tree_differences(*trees)




@register
def reconcile_plan(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.reconcile_plan(_desired(spark, sf), fx.observed_replicas(spark, sf), fx.fleet_layout(spark, sf))


@register
def action_counts(spark: SparkSession, sf: str) -> DataFrame:
    phases = status.replica_phase(fx.observed_replicas(spark, sf))
    return reconcile.action_counts(reconcile_plan(spark, sf), phases, fx.fleet_layout(spark, sf))


@register
def action_events(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("-", "cluster", F.lit("cluster"), "shard", "ordinal")
    return reconcile.action_events(reconcile_plan(spark, sf), name, failed=F.expr("cluster % 11 = 0"))


@register
def upsert_plan(spark: SparkSession, sf: str) -> DataFrame:
    desired = _desired(spark, sf).select(*reconcile.PLACE, "image")
    current = fx.observed_replicas(spark, sf)
    first = reconcile.upsert_plan(desired, current, reconcile.PLACE, update=False).withColumn("pass", F.lit(1))
    second = reconcile.upsert_plan(desired, current, reconcile.PLACE, update=True).withColumn("pass", F.lit(2))
    return first.unionByName(second)


@register
def merge_update(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.merge_update(_desired(spark, sf), fx.observed_replicas(spark, sf))


@register
def cascade_delete_plan(spark: SparkSession, sf: str) -> DataFrame:
    reclaim = fx.fleet_layout(spark, sf).select("cluster", "reclaim_delete")
    return reconcile.cascade_delete_plan(fx.deleted_installations(spark, sf), _replicas(spark, sf), reclaim)


@register
def desired_objects(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.desired_objects(materialize(_replicas(spark, sf), "replicas"))


@register
def owner_events(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.change_feed(spark, sf).select(
        "key", "kind", "event_id", F.when(F.col("kind") != "ADDED", F.col("event_id")).alias("object")
    )
    ownership = fx.fleet_layout(spark, sf).select(F.col("cluster").alias("object"), F.col("inst").alias("owner"))
    return reconcile.map_to_owner(events, ownership)


@register
def unseen_versions(spark: SparkSession, sf: str) -> DataFrame:
    new = fx.change_feed(spark, sf).select(
        F.concat(F.lit("ns-"), F.col("key") % 5).alias("namespace"), F.col("key").cast("string").alias("name"), "version"
    )
    return reconcile.unseen_versions(new, new.filter("version % 3 = 0"))


@register
def watched_filter(spark: SparkSession, sf: str) -> DataFrame:
    watched = text.split_namespaces("NATION_1:NATION_3,,NATION_7")
    return reconcile.watched_namespaces(fx.installations(spark, sf), watched).select("inst", "namespace")


@register
def label_select(spark: SparkSession, sf: str) -> DataFrame:
    matched = reconcile.match_labels(fx.objects(spark, sf), fx.selectors(spark, sf))
    return matched.select("selector", "namespace", "kind", "name").orderBy("selector", "name")


@register
def object_counts(spark: SparkSession, sf: str) -> DataFrame:
    chosen = fx.selectors(spark, sf)
    kinds = F.array(F.lit("set"), F.lit("service"), F.lit("config"))
    expected = chosen.select("selector", F.explode(kinds).alias("kind"), (F.col("selector") % 4).alias("expected"))
    return reconcile.object_counts(reconcile.match_labels(fx.objects(spark, sf), chosen), expected)


@register
def diff_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.claims(spark, sf)
    old = rows.filter("old_size IS NOT NULL").select("object", "claim", "class", F.col("old_size").alias("size"), "line")
    moved = F.when(F.expr("line % 3 = 0"), F.lit("class-new")).otherwise(F.col("class"))
    new = rows.select(
        "object", "claim", moved.alias("class"), F.col("new_size").alias("size"), (F.col("line") + 1).alias("line")
    )
    return reconcile.diff_columns(old, new, ["object", "claim"], ignore=("line",))


# Status -----------------------------------------------------------------------


@register
def replica_phase(spark: SparkSession, sf: str) -> DataFrame:
    phases = status.replica_phase(fx.observed_replicas(spark, sf))
    return phases.select("cluster", "shard", "ordinal", "phase", "state", "counts_ready")


@register
def replica_status(spark: SparkSession, sf: str) -> DataFrame:
    phases = status.replica_phase(fx.observed_replicas(spark, sf))
    return status.status_of(_replicas(spark, sf).select("inst", *reconcile.PLACE, "replica_name"), phases)


@register
def replica_status_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Status by names that several clusters share."""
    short = F.concat_ws("-", F.col("cluster") % 50, "shard", "ordinal").alias("replica_name")
    phases = status.replica_phase(fx.observed_replicas(spark, sf)).select(*reconcile.PLACE, "phase", "state", short)
    return status.status_by_name(_replicas(spark, sf).select("inst", *reconcile.PLACE, short), phases)


@register
def declared_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Every sixth cluster names one of its shards itself."""
    clusters = fx.fleet_layout(spark, sf)
    declared = clusters.filter("cluster % 6 = 0").select(
        "cluster", F.concat("installation_name", F.lit("-cluster-"), F.col("cluster") % 4).alias("shard_name")
    )
    return layout.expand_shards(clusters, declared).select("inst", "cluster", "shard", "shard_name")


@register
def annotated_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The plan where a change of annotations alone is a change; the snapshot's own does not count."""
    team = lambda more: F.create_map(F.lit("team"), ((F.col("cluster") + more) % 5).cast("string"))
    own = F.create_map(F.lit(reconcile.SNAPSHOT_ANNOTATION), F.lit("x"))
    desired = _desired(spark, sf).withColumn("annotations", team(F.lit(0)))
    moved = F.map_concat(team(F.when(F.col("generation") > 5, 1).otherwise(0)), own)
    observed = fx.observed_replicas(spark, sf).withColumn("annotations", F.when(F.col("ordinal") != 3, moved))
    return reconcile.reconcile_plan(desired, observed, fx.fleet_layout(spark, sf))


@register
def shard_phase(spark: SparkSession, sf: str) -> DataFrame:
    shards = layout.allocate_ordinals(layout.expand_shards(fx.fleet_layout(spark, sf)), fx.delete_slots(spark, sf))
    return status.shard_phase(shards, fx.observed_replicas(spark, sf))


@register
def health_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return status.health_rollup(fx.fleet_layout(spark, sf), status.replica_phase(fx.observed_replicas(spark, sf)))


@register
def previous_state(spark: SparkSession, sf: str) -> DataFrame:
    return status.previous_state(fx.observed_replicas(spark, sf))


@register
def installation_state(spark: SparkSession, sf: str) -> DataFrame:
    desired = materialize(_desired(spark, sf), "desired")
    counts = fx.installation_keys(spark, sf).join(layout.topology_counts(desired_names(desired)), "inst", "left")
    phases = status.replica_phase(fx.observed_replicas(spark, sf))
    return status.installation_state(counts, desired, phases, fx.deleted_installations(spark, sf))


def desired_names(desired: DataFrame) -> DataFrame:
    return desired.withColumn("shard_name", F.col("shard"))


@register
def fleet_status(spark: SparkSession, sf: str) -> DataFrame:
    return status_plan.fleet_status(
        fx.installation_keys(spark, sf),
        fx.fleet_layout(spark, sf),
        _desired(spark, sf),
        fx.observed_replicas(spark, sf),
        fx.deleted_installations(spark, sf),
    )


# Settings ---------------------------------------------------------------------


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    """Settings with the vector as one text column."""
    return df.select(*columns, "is_scalar", "scalar", F.array_join("vector", ",").alias("vector"))


def _effective(spark: SparkSession, sf: str) -> DataFrame:
    return settings.effective_settings(fx.settings_layers(spark, sf))


def _user_settings(spark: SparkSession, sf: str) -> DataFrame:
    regexp = names.fill_pattern(names.HOST_REGEXP, di=F.col("inst"), namespace=F.col("namespace"))
    owners = fx.installations(spark, sf).select(F.col("inst").alias("owner"), regexp.alias("host_regexp"))
    merged = settings.effective_settings(fx.user_settings(spark, sf)).drop("seq")
    return settings.user_defaults(materialize(merged, "user-settings"), owners)


@register
def ingest_settings(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(settings_json.ingest_settings(fx.settings_json(spark, sf), "settings"), "owner", "seq", "path")


@register
def merge_settings(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(settings.merge_fill(fx.settings_layers(spark, sf)), "owner", "path", "seq")


@register
def normalize_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(_effective(spark, sf), "owner", "path", "seq")


@register
def settings_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = settings.filter_sections(_effective(spark, sf), None, ["USERS"], include_unspecified=True)
    return _joined(kept, "owner", "path", "section")


def _override_fields() -> dict[str, Column]:
    return {"scalar": F.col("scalar").isNotNull() & ~F.col("scalar").isin("", "_removed_"), "timeout": F.col("timeout") > 0}


def _with_timeout(spark: SparkSession, sf: str) -> DataFrame:
    return fx.settings_layers(spark, sf).withColumn("timeout", (F.col("num") / 10).cast("int"))


@register
def merge_override(spark: SparkSession, sf: str) -> DataFrame:
    return settings.merge_override(_with_timeout(spark, sf), ["owner", "path"], _override_fields(), ["layer", "seq"])


@register
def effective_config(spark: SparkSession, sf: str) -> DataFrame:
    configs = _with_timeout(spark, sf).select(
        "owner",
        "seq",
        "scalar",
        "timeout",
        (F.col("layer") > 0).alias("is_custom"),
        F.when(F.col("layer") > 0, F.concat(F.lit("cr-"), F.col("seq") % 10)).otherwise("").alias("name"),
    )
    defaults = {"scalar": "default", "timeout": 300}
    return settings.fold_configs(configs, ["owner"], _override_fields(), defaults)


@register
def merge_where(spark: SparkSession, sf: str) -> DataFrame:
    rows = settings.normalize_paths(fx.settings_layers(spark, sf), ["owner", "layer"])
    accept = text.path_section(F.col("path")) == "HOST"
    return _joined(settings.merge_accepted(rows, accept), "owner", "path", "seq")


def _inherited(spark: SparkSession, sf: str, replicas: DataFrame | None = None) -> DataFrame:
    """Layer 0 belongs to the installation, 1 to its first cluster, 2 to that cluster's first shard.

    Every seventh row of layer 2 belongs to the first replica of that shard.
    """
    replicas = materialize(_replicas(spark, sf), "replicas") if replicas is None else replicas
    rows = fx.settings_layers(spark, sf).withColumn("kind", F.expr("CASE WHEN seq % 2 = 0 THEN 'files' ELSE 'settings' END"))
    level = F.expr("CASE WHEN layer < 2 THEN layer WHEN seq % 7 = 0 THEN 3 ELSE 2 END")
    merged = settings.normalize_paths(rows.withColumn("level", level), ["owner", "level", "kind"])
    first = fx.fleet_layout(spark, sf).groupBy("inst").agg(F.min("cluster").alias("cluster"))
    placed = merged.withColumnRenamed("owner", "inst")
    at_first = placed.join(first, "inst").withColumn("shard_name", F.concat("cluster", F.lit("-cluster-0")))
    first_replica = replicas.filter("shard = 0").groupBy("shard_name").agg(F.min_by("replica_name", "ordinal").alias("replica_name"))
    return settings.inherit_settings(
        replicas,
        placed.filter("level = 0"),
        at_first.filter("level = 1"),
        at_first.filter("level = 2"),
        at_first.filter("level = 3").join(first_replica, "shard_name"),
    )


@register
def inherit_settings(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(_inherited(spark, sf), "replica_name", "kind", "path")


@register
def user_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(_user_settings(spark, sf), "owner", "path")


@register
def section_files(spark: SparkSession, sf: str) -> DataFrame:
    return settings.section_files(_effective(spark, sf), "COMMON", include_unspecified=True)


@register
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return settings.fingerprint(_effective(spark, sf))


@register
def sorted_settings(spark: SparkSession, sf: str) -> DataFrame:
    return settings.sorted_settings(_effective(spark, sf))


@register
def bool_settings_tally(spark: SparkSession, sf: str) -> DataFrame:
    return settings.bool_tally(_effective(spark, sf))


@register
def port_inventory(spark: SparkSession, sf: str) -> DataFrame:
    owners = fx.installation_keys(spark, sf).select(F.col("inst").alias("owner"))
    ports = {"tcp_port": "COMMON/f0", "http_port": "COMMON/f1", "interserver_http_port": "HOST/f2"}
    return settings.port_inventory(owners, _effective(spark, sf), ports)


# Templates --------------------------------------------------------------------


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return _resolve(fx.template_references(spark, sf), fx.templates(spark, sf))


def _resolve(references: DataFrame, all_templates: DataFrame) -> DataFrame:
    known = templates.registered(all_templates)
    return templates.resolve_templates(references, known, known)


@register
def resolve_templates(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("inst", "ord", "name", "source", "template_ord", "template_size")


@register
def merge_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return templates.merge_nodes(fx.nodes(spark, sf))


@register
def inherit_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every installation names two nodes; every fourth cluster has one of its own."""
    declared = F.array(
        F.struct(F.lit(0).alias("ord"), F.concat(F.lit("zk-"), "namespace").alias("host"), F.lit(None).cast("int").alias("port")),
        F.struct(F.lit(1).alias("ord"), F.concat(F.lit("zk-"), F.col("inst") % 3).alias("host"), F.lit(2180).alias("port")),
    )
    installation = fx.installations(spark, sf).select("inst", "namespace", F.inline(declared)).drop("namespace")
    clusters = fx.fleet_layout(spark, sf).select("inst", "cluster")
    own = clusters.filter("cluster % 4 = 0").select(
        "cluster", F.lit(0).alias("ord"), F.concat(F.lit("own-"), F.col("cluster") % 5).alias("host"), F.lit(2182).alias("port")
    )
    return templates.inherit_nodes(clusters, own, installation)


@register
def merge_templates(spark: SparkSession, sf: str) -> DataFrame:
    present = {"size": F.col("size") > 0, "storage_class": F.col("storage_class") != ""}
    return templates.merge_templates(fx.templates(spark, sf).withColumnRenamed("namespace", "owner"), present)


def _normalized(spark: SparkSession, sf: str, all_templates: DataFrame, raised: Column, touched: DataFrame | None = None) -> DataFrame:
    """The whole chain for all installations, or for those touched; the own claims of some are raised."""
    only = (lambda df, key="inst": df) if touched is None else (lambda df, key="inst": df.join(touched.withColumnRenamed("inst", key), key, "left_semi"))
    own = only(fx.installation_keys(spark, sf)).select(
        "inst",
        F.expr("CASE WHEN inst % 4 = 0 THEN 'own-data' ELSE '' END").alias("data_claim"),
        (F.expr("CAST(inst % 3 AS INT)") + raised.cast("int")).alias("claim_size"),
    )
    defaults = normalize.template_defaults(own, _resolve(only(fx.template_references(spark, sf)), all_templates))
    fleet = only(fx.fleet_layout(spark, sf))
    replicas = materialize(layout.allocate_replicas(fleet, fx.delete_slots(spark, sf).join(fleet.select("cluster"), "cluster", "left_semi")), "replicas")
    users = only(_user_settings(spark, sf), "owner")
    return normalize.normalized_replicas(replicas, defaults, _inherited(spark, sf, replicas), inherit_nodes(spark, sf), users)


@register
def normalized_replicas(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf, fx.templates(spark, sf), F.lit(False))


@register
def renormalized_replicas(spark: SparkSession, sf: str) -> DataFrame:
    """The fleet after some templates have grown, come or gone and some installations want more, from the former result."""
    before = fx.templates(spark, sf)
    grown, turned = F.expr("ord % 11 = 0"), F.expr("ord % 23 = 0")
    after = before.withColumns({"size": F.col("size") + grown.cast("int"), "retired": F.col("retired") != turned})
    raised = F.expr("inst % 17 = 0")
    changed = before.filter(grown | turned).select(F.lit("template").alias("kind"), F.concat_ws("/", "namespace", "name").alias("id"))
    changed = changed.unionByName(fx.installation_keys(spark, sf).filter(raised).select(F.lit("installation").alias("kind"), F.col("inst").cast("string").alias("id")))
    index = materialize(normalize.dependencies(fx.template_references(spark, sf)), "dependencies")
    touched = materialize(normalize.affected(changed, index), "touched")
    previous = materialize(_normalized(spark, sf, before, F.lit(False)), "normalized")
    return normalize.renormalized(previous, touched, lambda only: _normalized(spark, sf, after, raised, only))


# Documents --------------------------------------------------------------------


@register
def render_document(spark: SparkSession, sf: str) -> DataFrame:
    """Each owner's settings and user settings as one document, with nested and hidden nodes."""
    rows = _effective(spark, sf)
    deeper = rows.filter("seq % 3 = 0").withColumn("path", F.concat("path", F.lit("/x-1")))
    every = rows.unionByName(deeper).drop("seq").unionByName(_user_settings(spark, sf))
    return documents.render_document(materialize(every, "settings"), ["owner"])


@register
def routing_document(spark: SparkSession, sf: str) -> DataFrame:
    return documents.routing_document(routing_topology(spark, sf))


@register
def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The routing documents as text, in chunks of 4096 characters.

    The replicas are dealt out by installation, so the lines, many times as
    large, are made where their text is.  A replica has about 17 lines.
    """
    replicas = materialize(_weighted(_replicas(spark, sf)), "replicas")
    short, long = layout.split_owners(replicas, ["inst"], documents.WHOLE_ROWS // 16)
    lines = lambda rows: documents.routing_document(layout.routing_topology(rows))
    texts = documents.document_texts(lines(short), ["inst"], 4096, whole=True)
    return texts if long is None else texts.unionByName(documents.document_texts(lines(long), ["inst"], 4096))


@register
def coordination_document(spark: SparkSession, sf: str) -> DataFrame:
    options = fx.nodes(spark, sf).groupBy("owner").agg(
        (F.max("ord") % 3 * 1000).alias("session_timeout_ms"),
        (F.max("ord") % 2 * 500).alias("operation_timeout_ms"),
        F.min("host").alias("root"),
        F.lit("").alias("identity"),
    )
    return documents.coordination_document(templates.merge_nodes(fx.nodes(spark, sf)), options)


@register
def config_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(_effective(spark, sf).drop("seq"), "settings")
    replicas = materialize(_weighted(_replicas(spark, sf)), "replicas")
    nodes = inherit_nodes(spark, sf).withColumnRenamed("cluster", "owner")
    options = fx.fleet_layout(spark, sf).select(
        F.col("cluster").alias("owner"),
        F.expr("cluster % 3 * 1000").alias("session_timeout_ms"),
        F.expr("cluster % 2 * 500").alias("operation_timeout_ms"),
        F.expr("CASE WHEN cluster % 5 = 0 THEN '' ELSE concat('/c', cluster % 5) END").alias("root"),
        F.lit("").alias("identity"),
    )
    region = fx.table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("content"))
    extra = region.select(
        F.when(F.col("r_regionkey") == 0, "f3").otherwise(F.concat(F.lit("r"), "r_regionkey", F.lit(".xml"))).alias("file"),
        "content",
    )
    return config_documents.config_files(
        common_settings=rows.filter("path NOT LIKE 'users.d/%'"),
        files=rows,
        users=materialize(_user_settings(spark, sf), "users"),
        quotas=rows.filter("path LIKE 'misc/%'"),
        profiles=rows.filter("path NOT LIKE '%/%'"),
        routing=materialize(layout.routing_topology(replicas), "routing"),
        replicas=replicas,
        replica_settings=materialize(_inherited(spark, sf, replicas), "replica-settings"),
        coordination=documents.coordination_document(nodes, options).withColumnRenamed("owner", "cluster"),
        extra={"common": extra, "users": extra.filter("file <> 'r2.xml'"), "host": extra.filter("file = 'f3'")},
    )


# Storage ----------------------------------------------------------------------


def _old_and_new(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    old = claims.filter("old_size IS NOT NULL").withColumn("size", F.col("old_size"))
    return old, claims.withColumn("size", F.col("new_size"))


@register
def claim_validation(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _old_and_new(fx.claims(spark, sf))
    return storage.claim_validation(old, new, fx.storage_classes(spark, sf))


@register
def volume_resize_plan(spark: SparkSession, sf: str) -> DataFrame:
    claims = materialize(fx.claims(spark, sf), "claims")
    old, new = _old_and_new(claims)
    return storage.volume_resize_plan(old, new, fx.volumes(claims), F.lit(2), fx.storage_classes(spark, sf))


@register
def orphan_volumes(spark: SparkSession, sf: str) -> DataFrame:
    claims = materialize(fx.claims(spark, sf), "claims")
    old, new = _old_and_new(claims)
    return storage.orphan_volumes(fx.volumes(claims), old, new, pods=F.lit(2))


@register
def resolve_mounts(spark: SparkSession, sf: str) -> DataFrame:
    known = ["data", "log", "extra"]
    return storage.resolve_mounts(fx.mounts(spark, sf), fx.mount_sets(spark, sf), known, "/data", "/log")


@register
def admission_report(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters come and go by order key; claim templates are those of an installation's orders."""
    clusters = fx.fleet_layout(spark, sf)
    new = clusters.filter("cluster % 11 <> 0").select(
        "inst", "cluster", F.col("shards_raw").alias("shards"), F.col("replicas_raw").alias("replicas")
    )
    old = clusters.filter("cluster % 13 <> 0").select(
        "inst", "cluster", F.col("prev_shards").alias("shards"), F.col("prev_replicas").alias("replicas")
    )
    owner = clusters.select("inst", F.col("cluster").alias("object"))

    def of_installation(claims: DataFrame) -> DataFrame:
        return claims.join(owner, "object").select("inst", "claim", "size", F.col("object").alias("ord"))

    installations = fx.installation_keys(spark, sf).select(
        "inst", F.lit("data2").alias("data_claim"), F.expr("CASE WHEN inst % 4 = 0 THEN '' ELSE 'log9' END").alias("log_claim")
    ).withColumn("log_claim", F.expr("CASE WHEN inst % 2 = 0 THEN log_claim ELSE 'log1' END"))
    old_claims, new_claims = _old_and_new(materialize(fx.claims(spark, sf), "claims"))
    return admission.admission_report(
        installations, old, new, of_installation(old_claims), of_installation(new_claims), strict=True
    )


# Logs and text ----------------------------------------------------------------

LOG_NOW = datetime.date(2024, 2, 10)


@register
def log_retention(spark: SparkSession, sf: str) -> DataFrame:
    return fx.log_rows(spark, sf).filter(logs.is_retained(LOG_NOW))


@register
def log_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """The days of a written log table that are past their time."""
    folder = fresh_dir(spark, "log")
    logs.write_log(fx.log_rows(spark, sf), folder)
    return logs.expired_days(spark, folder, LOG_NOW)


@register
def short_id_collisions(spark: SparkSession, sf: str) -> DataFrame:
    ids = fx.installations(spark, sf).select("inst_name").distinct().select(
        hashes.short_id(F.col("inst_name"), 3).alias("short_id")
    )
    return ids.groupBy("short_id").agg(F.count(F.lit(1)).alias("names")).filter("names > 1")


@register
def bucket_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return fx.installations(spark, sf).groupBy(hashes.bucket(F.col("inst_name"), 16).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@register
def masked_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    user = F.expr("CASE inst % 3 WHEN 0 THEN '' ELSE concat('u', inst % 10) END")
    password = F.expr("CASE inst % 3 WHEN 2 THEN concat('p', inst) ELSE '' END")
    url = text.endpoint(user, password, F.concat(F.lit("host-"), F.col("inst") % 50), F.lit(8123))
    return (
        fx.installations(spark, sf)
        .groupBy("namespace", text.masked_endpoint(url).alias("endpoint"))
        .agg(F.count(F.lit(1)).alias("installations"), F.max(url).alias("last_url"))
    )


# Change feed --------------------------------------------------------------------


def _children(spark: SparkSession, sf: str) -> DataFrame:
    """The clusters of each installation; one in eight is still there."""
    return fx.fleet_layout(spark, sf).select(F.col("inst").alias("key"), F.expr("cluster % 8 <> 0").alias("gone"))


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    return fx.change_feed(spark, sf).select("key", "kind", "ts", "event_id", "phase")


@register
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return changes.present(changes.latest_per_key(_feed(spark, sf)))


@register
def phase_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return changes.phase_transitions(_feed(spark, sf))


@register
def backlog(spark: SparkSession, sf: str) -> DataFrame:
    return changes.backlog(changes.latest_per_key(_feed(spark, sf)))


@register
def tombstones(spark: SparkSession, sf: str) -> DataFrame:
    return changes.tombstones(changes.latest_per_key(_feed(spark, sf)), _children(spark, sf))


# Streams: the events arrive in several parts, each taken by a run that goes on from the
# state of the one before; then the table of keys is read.


ARRIVALS = 2
#: Events of the last day before a border, one in four, arrive after it.
LATE = datetime.timedelta(days=1)


def _arrivals(spark: SparkSession, sf: str) -> list[DataFrame]:
    """All events in spans of time of equal length, some of them late; those without a time come first."""
    events = fx.table(spark, sf, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    part = F.lit(0)
    if low is not None:
        due = F.when(F.expr("event_id % 4 = 1"), F.col("ts") + F.make_dt_interval(days=F.lit(LATE.days))).otherwise(F.col("ts"))
        for k in range(1, ARRIVALS):
            border = F.lit(str(low + (high - low) * k / ARRIVALS)).cast("timestamp_ntz")
            part = F.when(due >= border, k).otherwise(part)
    return [events.filter(part == k) for k in range(ARRIVALS)]


def _streamed(spark: SparkSession, sf: str, name: str, start: Callable[[DataFrame, str, str], StreamingQuery]) -> str:
    """The table that a stream keeps; each event is written once to the folder it watches."""
    source, table = fresh_dir(spark, "arrived"), fresh_dir(spark, name)
    for k, part in enumerate(_arrivals(spark, sf)):
        part.write.parquet(f"{source}/part={k}")
        stream = feeds.read_events(spark, f"{source}/*", fx.SCHEMAS["events"], files_per_trigger=2**31 - 1)
        start(stream, f"{table}/rows", f"{table}/checkpoint").awaitTermination()
    return f"{table}/rows"


_LATENESS = {"lateness": f"{LATE.days} days"}


@register
def stream_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    table = _streamed(spark, sf, "latest", lambda events, rows, at: feeds.coalesce_changes(fx.change_columns(events), rows, at, **_LATENESS))
    return changes.present(feeds.read_latest(spark, table))


@register
def stream_phase_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.read_transitions(spark, _streamed(spark, sf, "phases", lambda events, rows, at: feeds.track_phase(fx.change_columns(events), rows, at, **_LATENESS)))


@register
def stream_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """The queue with its tries as of the watermark, a day before the last event."""
    return feeds.read_queue(spark, _streamed(spark, sf, "backlog", lambda events, rows, at: feeds.requeue_backlog(fx.change_columns(events), rows, at, **_LATENESS)))


@register
def retry_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The queue with its tries as of noon of 30 January 2024."""
    return changes.retry_queue(changes.latest_per_key(_feed(spark, sf)), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@register
def stream_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    children = _children(spark, sf)
    table = _streamed(spark, sf, "tombstones", lambda events, rows, at: feeds.soft_delete(fx.change_columns(events), rows, at, children, **_LATENESS))
    return feeds.read_tombstones(spark, table)


def _landed(spark: SparkSession, sf: str) -> str:
    """The log table compacted from what a stream has flushed."""
    landing = _streamed(spark, sf, "log", lambda events, rows, at: feeds.log_sink(fx.log_columns(events), rows, at, available_now=True))
    folder = fresh_dir(spark, "log-table")
    logs.compact_log(spark, landing, folder)
    return folder


@register
def stream_log_sink(spark: SparkSession, sf: str) -> DataFrame:
    return logs.read_retained(spark, _landed(spark, sf), LOG_NOW).select("event_id", "event_date", "event_time", "value")


@register
def log_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """What each day holds after flushing, compaction and removal of expired days."""
    folder = _landed(spark, sf)
    logs.expire_log(spark, folder, LOG_NOW)
    rows = spark.read.parquet(folder)
    return rows.groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))
