"""Physical plans: what must not be in any of them, and what must be in some."""

import pytest

from fleetspark.plans.registry import QUERIES

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroupsInPandas"]


def plan_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_no_product_and_no_python(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert not [word for word in FORBIDDEN if word in plan]


def test_scans_read_only_what_is_needed(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "readiness")
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_linestatus:string>" in plan
    plan = plan_of(spark, sf_dir, "slot_parse")
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in plan


def test_few_hosts_read_few_files(spark, tmp_path):
    from fleetspark.operators import catalog

    rows = spark.range(6400).selectExpr("id % 1280 AS host", "concat('t', id) AS name")
    catalog.store_catalog(rows, str(tmp_path / "catalog"))
    hosts = spark.range(1280).selectExpr("id AS host", "id % 640 = 7 AS picked").filter("picked")
    df = catalog.read_hosts(spark, str(tmp_path / "catalog"), hosts)
    assert sorted(r.host for r in df.collect()) == [7] * 5 + [647] * 5
    scans = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line]
    assert "dynamicpruning" in scans[0]


@pytest.fixture()
def no_broadcast(spark):
    """Plans as they are where no side is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["schema_sync_plan", "label_select", "claim_validation", "inherit_settings", "resolve_templates", "reconcile_plan"])
def test_without_any_broadcast(spark, sf_dir, no_broadcast, name):
    plan = plan_of(spark, sf_dir, name)
    assert "Broadcast" not in plan and "CartesianProduct" not in plan


def test_hot_join_keys_are_split(spark):
    """One key holds most rows: the join on it runs in more tasks than there are partitions."""
    from pyspark.sql import functions as F

    from fleetspark.operators import templates

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        spread = F.when(F.col("id") % 3 == 0, F.col("id") % 500).otherwise(0)
        refs = spark.range(0, 200_000, 1, 8).select(
            F.col("id").alias("ord"), F.col("id").alias("inst"), F.lit("own").alias("own_namespace"),
            F.lit("ns").alias("namespace"), F.concat(F.lit("t"), spread).alias("name"),
        )
        registry = spark.range(500).select(F.lit("ns").alias("namespace"), F.concat(F.lit("t"), "id").alias("name"), F.col("id").alias("size"))
        found = templates.resolve_templates(refs, registry, registry)
        assert found.count() == 200_000
        df = templates.resolve_templates(refs, registry, registry)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan or "isSkewJoin=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
