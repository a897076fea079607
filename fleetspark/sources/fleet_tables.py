"""Fleet-shaped inputs derived from the given tables (see FIXTURES.md, part 3).

Each function reads only the columns it needs, so the scans stay narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



# Named schemas spare the job that would read them from the files.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _int(text: str) -> Column:
    return F.expr(text).cast("int")


def _text(*parts: str) -> Column:
    return F.concat(*[F.expr(part).cast("string") for part in parts])


# F1 -------------------------------------------------------------------------


def fleet_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cluster: requested and previous shard and replica counts."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("inst"),
        F.col("o_orderkey").alias("cluster"),
        _text("o_orderkey").alias("installation_name"),
        F.lit("cluster").alias("cluster_name"),
        _int("o_orderkey % 3").alias("shards_raw"),
        _int("(o_orderkey div 3) % 4").alias("replicas_raw"),
        _int("(o_orderkey div 7) % 3").alias("prev_shards"),
        _int("(o_orderkey div 5) % 4").alias("prev_replicas"),
        F.expr("CASE o_orderkey % 13 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Off' ELSE '' END").alias("internal_raw"),
        (F.col("o_orderpriority") == "5-LOW").alias("paused"),
        (F.col("o_orderstatus") == "F").alias("reclaim_delete"),
    )


def installations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per installation with its namespace."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("namespace"))
    return (
        table(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("inst"), F.col("c_name").alias("inst_name"), "c_nationkey", "c_acctbal")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("inst", "inst_name", "namespace", "c_acctbal")
    )


def installation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The installations alone, for plans that need no namespace."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("inst"))


def deleted_installations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("inst"))


# F2 -------------------------------------------------------------------------


def delete_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .filter("l_returnflag = 'R'")
        .select(
            F.col("l_orderkey").alias("cluster"),
            F.when(F.expr("l_partkey % 50 = 0"), _text("'bad-'", "l_orderkey"))
            .when(F.expr("l_partkey % 50 = 1"), _text("l_orderkey", "'-cluster-'", "l_linenumber % 3", "'-x'"))
            .otherwise(_text("l_orderkey", "'-cluster-'", "l_linenumber % 3", "'-'", "l_suppkey % 4"))
            .alias("slot"),
        )
    )


# F3 -------------------------------------------------------------------------


def observed_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per live replica with its set status and the last applied spec.

    The applied spec is missing for every 17th cluster; a replica of first
    generation has no controller owner.
    """
    grouped = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_orderkey").alias("cluster"),
            _int("l_linenumber % 3").alias("shard"),
            _int("l_suppkey % 4").alias("ordinal"),
        )
        .agg(
            F.max((F.col("l_linestatus") == "O").cast("int")).alias("ready"),
            F.max("l_linenumber").alias("generation"),
            F.min("l_linenumber").alias("observed_generation"),
            F.bool_or(F.col("l_returnflag") == "A").alias("_first_flag"),
            (F.max("l_partkey") % 2).cast("int").alias("image"),
            F.max("l_shipdate").alias("last_seen"),
        )
    )
    applied = F.to_json(F.struct("image", F.lit(1).alias("replicas"), F.lit("RollingUpdate").alias("strategy")))
    return grouped.select(
        "cluster",
        "shard",
        "ordinal",
        "ready",
        F.lit(1).alias("replicas"),
        F.lit(1).alias("current_replicas"),
        F.lit(1).alias("updated_replicas"),
        "generation",
        "observed_generation",
        F.lit("r1").alias("current_revision"),
        F.lit("r1").alias("update_revision"),
        F.when(F.col("_first_flag"), "Sync").otherwise("NotSync").alias("prev_state"),
        F.lit(False).alias("upgrading"),
        "image",
        "last_seen",
        F.when(F.col("cluster") % 17 != 0, applied).alias("last_applied"),
        F.when(F.col("generation") > 1, F.concat(F.lit("owner-"), F.col("cluster"))).alias("owner"),
        F.lit("live").alias("label"),
    )


# F4 -------------------------------------------------------------------------


def _settings_columns(path: Column) -> list[Column]:
    scalar = F.expr(
        "CASE event_id % 13 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' WHEN 2 THEN '_removed_' "
        "ELSE get_json_object(props, '$.k') END"
    )
    return [
        F.col("user_id").alias("owner"),
        _int("event_id % 3").alias("layer"),
        F.col("event_id").alias("seq"),
        path.alias("path"),
        F.expr("event_id % 5 <> 0").alias("is_scalar"),
        F.when(F.expr("event_id % 5 <> 0"), scalar).alias("scalar"),
        F.when(F.expr("event_id % 5 = 0"), F.array(scalar, _text("event_id % 10"))).alias("vector"),
        F.col("value").alias("num"),
    ]


def settings_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per raw setting of an owner, with its layer and order."""
    prefix = (
        "CASE event_type WHEN 'click' THEN 'COMMON//' WHEN 'view' THEN '/config.d/' WHEN 'error' THEN 'users.d/' "
        "WHEN 'purchase' THEN 'HOST/' ELSE CASE WHEN event_id % 2 = 0 THEN 'misc/' ELSE '' END END"
    )
    path = _text(prefix, "'f'", "event_id % 7", "CASE WHEN event_id % 11 = 0 THEN '/' ELSE '' END")
    return table(spark, sf_dir, "events").select(*_settings_columns(path))


def user_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = "CASE WHEN event_id % 4 = 0 THEN 'default' ELSE concat('u', event_id % 4) END"
    key = (
        "CASE event_type WHEN 'click' THEN 'password' WHEN 'view' THEN 'profile' WHEN 'error' THEN 'quota' "
        "WHEN 'purchase' THEN 'networks//ip' ELSE 'password_sha256_hex' END"
    )
    return table(spark, sf_dir, "events").select(*_settings_columns(_text(user, "'/'", key)))


def settings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object of dynamic settings per event."""
    body = F.concat(
        F.lit('{"k": '), F.get_json_object("props", "$.k"),
        F.lit(', "value": '), F.format_string("%.3f", F.col("value") - 50),
        F.lit(', "flag": '), F.expr("CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END"),
        F.lit(', "list": ["'), F.col("event_type"),
        F.lit('", 1.5, null, {"a": 1}, '), F.get_json_object("props", "$.k"),
        F.lit('], "none": null, "nested": {"a": 1}, "empty": [], "kind": "'), F.col("event_type"),
        F.lit('"}'),
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), body.alias("settings")
    )


# F5 -------------------------------------------------------------------------


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per host: place in the topology, availability and status."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("host"),
        F.expr("s_suppkey div 12").alias("cluster"),
        _int("(s_suppkey div 4) % 3").alias("shard"),
        _int("s_suppkey % 4").alias("ordinal"),
        F.lit(4).alias("replicas_count"),
        (F.col("s_acctbal") >= 1000).alias("available"),
        F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'Ready' WHEN s_acctbal >= 1000 THEN 'Normal' ELSE 'Scale' END").alias("phase"),
        F.expr("CASE WHEN s_suppkey % 5 <> 0 AND s_acctbal >= 1000 THEN 'Sync' ELSE 'NotSync' END").alias("state"),
    )


def _catalog_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("p_brand", r"#(\d+)$", 1)
    database = F.when(number == "1", "system").otherwise(F.concat(F.lit("db"), number))
    name = F.concat(
        F.when(F.col("p_type") == "STANDARD", ".inner.").otherwise(""),
        F.translate("p_name", " ", "_"),
        F.lit("_"),
        F.col("p_size"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", database.alias("database"), name.alias("name"))


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (host, table) of the fleet's system catalogs."""
    parts = _catalog_parts(spark, sf_dir)
    count = table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    target = parts.select(
        F.pmod(F.col("p_partkey") - 1, count).alias("p_partkey"),
        F.col("database").alias("target_database"),
        F.col("name").alias("target_name"),
    )
    quote = F.expr("CASE WHEN p_partkey % 2 = 0 THEN '''' ELSE '' END")
    engine = F.expr(
        "CASE p_type WHEN 'PROMO' THEN 'Distributed' WHEN 'SMALL' THEN 'ReplicatedMergeTree' "
        "WHEN 'MEDIUM' THEN 'ReplicatedSummingMergeTree' WHEN 'LARGE' THEN 'MergeTree' "
        "WHEN 'ECONOMY' THEN 'View' ELSE 'MaterializedView' END"
    )
    kind = F.expr("CASE p_type WHEN 'ECONOMY' THEN 'VIEW' WHEN 'STANDARD' THEN 'MATERIALIZED VIEW' ELSE 'TABLE' END")
    tables = parts.join(target, "p_partkey").select(
        "p_partkey",
        "database",
        "name",
        engine.alias("engine"),
        F.when(
            F.col("p_type") == "PROMO",
            F.concat(F.lit("Distributed(all, "), quote, "target_database", quote, F.lit(", "), "target_name", F.lit(", rand())")),
        ).otherwise("MergeTree()").alias("engine_full"),
        F.when(F.expr("p_partkey % 17 = 0"), "")
        .otherwise(F.concat(F.lit("CREATE "), kind, F.lit(" "), "database", F.lit("."), "name", F.lit(" (x Int8)")))
        .alias("create_table_query"),
    )
    placed = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("host"), F.col("l_partkey").alias("p_partkey")
    ).distinct()
    return placed.join(tables, "p_partkey").select(
        "host", F.col("p_partkey").alias("part"), "database", "name", "engine", "engine_full", "create_table_query"
    )


def statement_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each statement per host: success, last error code and number of tries."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("host"), F.col("l_partkey").alias("part"))
        .distinct()
        .select(
            "host",
            "part",
            F.expr("(part + host) % 5 >= 2").alias("ok"),
            F.expr("CASE WHEN (part + host) % 5 = 0 THEN 253 ELSE 0 END").alias("code"),
            _int("(part + 3 * host) % 12").alias("attempts"),
        )
    )


# F6 -------------------------------------------------------------------------


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per claim of an object: class, old size (absent for new claims), new size."""
    grouped = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("l_suppkey").alias("class_key"),
            F.min("l_quantity").cast("bigint").alias("size"),
            (F.min("l_partkey") % 4).cast("int").alias("k"),
        )
    )
    new_size = F.expr("size + CASE k WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END")

    def quantity(size: Column) -> Column:
        return (
            F.when(F.expr("class_key % 4 = 1"), F.concat(size * 1024, F.lit("Mi")))
            .when(F.expr("class_key % 4 = 3"), F.concat(size * 1000, F.lit("M")))
            .otherwise(F.concat(size, F.lit("Gi")))
        )

    return grouped.select(
        F.col("l_orderkey").alias("object"),
        F.concat(F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 'data' ELSE 'log' END"), "l_linenumber").alias("claim"),
        F.expr("CASE WHEN class_key % 10 = 0 THEN '' ELSE concat('class-', class_key) END").alias("class"),
        F.when(F.col("k") != 3, quantity(F.col("size"))).alias("old_size"),
        quantity(new_size).alias("new_size"),
        F.col("l_linenumber").alias("line"),
    )


def storage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("class-"), "s_suppkey").alias("class"),
        (F.col("s_acctbal") >= 1000).alias("allow_expansion"),
        (F.col("s_suppkey") == 0).alias("is_default"),
    )


def volumes(claimed: DataFrame) -> DataFrame:
    """Existing volumes of claims, named claim-set-ordinal; ordinal 2 belongs to a former, larger set."""
    return claimed.filter("old_size IS NOT NULL").select(
        "object",
        F.concat_ws("-", "claim", F.col("object").cast("string"), F.expr("line % 3").cast("string")).alias("volume"),
        F.col("old_size").alias("size"),
    )


# F7 -------------------------------------------------------------------------


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_columns(table(spark, sf_dir, "events"))


def change_columns(events: DataFrame) -> DataFrame:
    """Change events of an events table, batch or stream."""
    return events.select(
        F.col("user_id").alias("key"),
        F.expr("CASE event_type WHEN 'signup' THEN 'ADDED' WHEN 'error' THEN 'DELETED' ELSE 'MODIFIED' END").alias("kind"),
        "ts",
        "event_id",
        F.expr("CAST(get_json_object(props, '$.k') AS INT) % 3").alias("phase"),
        F.col("event_id").alias("version"),
    )


# F8 -------------------------------------------------------------------------


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_columns(table(spark, sf_dir, "events"))


def log_columns(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.to_date("ts").alias("event_date"), F.col("ts").alias("event_time"), "value")


# F9 -------------------------------------------------------------------------


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        F.col("p_brand").alias("namespace"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("size"),
        F.when(F.expr("p_partkey % 3 <> 0"), F.col("p_type")).otherwise("").alias("storage_class"),
        F.expr("p_partkey % 29 = 0").alias("retired"),
    )


def template_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template references of installations, in order; every fifth names a wrong namespace."""
    part = table(spark, sf_dir, "part")
    count = part.agg(F.count(F.lit(1))).scalar()
    refs = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("inst"),
        F.col("o_orderkey").alias("ord"),
        (F.col("o_orderkey") % count).alias("p_partkey"),
        F.expr("concat('Brand#', 1 + o_custkey % 25)").alias("own_namespace"),
    )
    return refs.join(part.select("p_partkey", "p_name", "p_brand"), "p_partkey").select(
        "inst",
        "ord",
        "own_namespace",
        F.when(F.expr("ord % 5 = 0"), "elsewhere").otherwise(F.col("p_brand")).alias("namespace"),
        F.col("p_name").alias("name"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordination nodes of an owner, in order of declaration; the port may be unset."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("owner"),
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("host"),
        F.expr("CASE WHEN p_size % 3 <> 0 THEN 2181 + p_size % 2 END").cast("int").alias("port"),
    )


# F10 ------------------------------------------------------------------------


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    namespace = installations(spark, sf_dir).select(F.col("inst").alias("o_custkey"), "namespace")
    return orders.join(namespace, "o_custkey").select(
        F.col("o_orderkey").alias("object"),
        "namespace",
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'set' WHEN 'O' THEN 'service' ELSE 'config' END").alias("kind"),
        F.concat(F.lit("object-"), "o_orderkey").alias("name"),
        F.create_map(
            F.lit("instance"), F.col("o_custkey").cast("string"), F.lit("priority"), F.col("o_orderpriority")
        ).alias("labels"),
    )


def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label selectors: each names an instance, every second one a priority too."""
    priority = F.expr("CASE WHEN inst % 2 = 0 THEN '1-URGENT' END")
    instance = F.col("inst").cast("string")
    return installations(spark, sf_dir).select(
        F.col("inst").alias("selector"),
        "namespace",
        F.when(priority.isNull(), F.create_map(F.lit("instance"), instance))
        .otherwise(F.create_map(F.lit("instance"), instance, F.lit("priority"), priority))
        .alias("match"),
    )


# F11, F12 -------------------------------------------------------------------


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("host"),
        F.expr(
            "CASE l_returnflag WHEN 'A' THEN 'all-sharded' WHEN 'N' THEN 'all-replicated' ELSE 'cluster' END"
        ).alias("cluster"),
        (F.col("l_linestatus") == "F").alias("is_local"),
    )


def mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("set"),
        F.expr("CASE l_partkey % 5 WHEN 0 THEN 'data' WHEN 1 THEN 'log' WHEN 2 THEN 'extra' ELSE 'tmp' END").alias("mount"),
        F.expr("CASE l_suppkey % 3 WHEN 0 THEN '/data' WHEN 1 THEN '/log' ELSE '/x' END").alias("path"),
    )


def mount_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets with the names of their default data and log claims; some name an unknown claim."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("set"),
        F.lit("data").alias("data_claim"),
        F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'archive' WHEN 1 THEN '' ELSE 'log' END").alias("log_claim"),
    )
