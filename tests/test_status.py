"""Golden cases of fleet health and of refused volume changes."""

from pyspark.sql import functions as F

from fleetspark.operators import storage
from fleetspark.plans import fleet_status

OBSERVED = (
    "cluster long, shard int, ordinal int, ready int, replicas int, current_replicas int, updated_replicas int, generation int, "
    "observed_generation int, current_revision string, update_revision string, upgrading boolean, prev_state string, last_applied string"
)


def health(spark, wanted, seen):
    """(total, added, deleted, healthy, state) of one installation with one cluster."""
    desired = spark.createDataFrame([(1, 1, s, o, 0, 1, "RollingUpdate") for s, o in wanted], "inst long, cluster long, shard int, ordinal int, image int, replicas int, strategy string")
    observed = spark.createDataFrame([(1, s, o, ready, 1, 1, 1, 1, 1, "a", "a", False, "Sync", None) for s, o, ready in seen], OBSERVED)
    row = fleet_status.fleet_status(
        spark.createDataFrame([(1,)], "inst long"), spark.createDataFrame([(1, 1, False)], "inst long, cluster long, paused boolean"),
        desired, observed, spark.createDataFrame([], "inst long"),
    ).first()
    return row.total, row.added, row.deleted, row.healthy, row.state


def test_health_needs_the_wanted_replicas_and_no_others(spark):
    four = [(0, 0), (0, 1), (1, 0), (1, 1)]
    up = [(s, o, 1) for s, o in four]
    assert health(spark, four, up) == (4, 0, 0, True, "Completed")
    assert health(spark, four, [(0, 0, 0), *up[1:]]) == (4, 0, 0, False, "InProgress")  # one set unavailable
    assert health(spark, four, up[:1]) == (4, 3, 0, False, "InProgress")  # scale out
    assert health(spark, four[:2], [*up[:2], (0, 2, 1)]) == (2, 0, 1, False, "Completed")  # a surplus replica
    assert health(spark, four[:2], up) == (2, 0, 2, True, "Completed")  # a shard beyond the layout
    assert health(spark, [], []) == (0, 0, 0, True, "Completed")


def resized(spark, actual, expected):
    """Objects whose volumes are to grow."""
    schema = "object long, claim string, class string, size string"
    volumes = spark.createDataFrame([(r[0], f"{r[1]}-{r[0]}-0", r[3]) for r in actual], "object long, volume string, size string")
    classes = spark.createDataFrame([("fast", True, True), ("fixed", False, False)], "class string, allow_expansion boolean, is_default boolean")
    plan = storage.volume_resize_plan(spark.createDataFrame(actual, schema), spark.createDataFrame(expected, schema), volumes, F.lit(1), classes)
    return sorted((r.object, r.claim) for r in plan.collect())


def test_one_refused_claim_stops_its_set(spark):
    old = [(i, c, k, "1Gi") for i in range(1, 7) for c, k in (("data", "fast"), ("log", "fixed"))]
    new = [
        (1, "data", "fast", "2Gi"), (1, "log", "fixed", "1Gi"),
        (2, "data", "fast", "2Gi"), (2, "log", "fixed", "2Gi"),  # the class forbids it
        (3, "data", "fast", "2Gi"), (3, "log", "fixed", "512Mi"),  # smaller
        (4, "data", "fast", "2Gi"), (4, "extra", "fast", "1Gi"),  # new
        (5, "data", "none", "2Gi"), (5, "log", "fixed", "1Gi"),  # no such class
        (6, "data", "", "2Gi"), (6, "log", "fixed", "much"),  # no quantity
    ]
    assert resized(spark, old, new) == [(1, "data")]
    assert resized(spark, old, [(6, "data", "", "1Ei")]) == [(6, "data")]
