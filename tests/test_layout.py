import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import layout, reconcile, status

LAYOUT = "inst bigint, cluster bigint, installation_name string, cluster_name string, shards_raw int, replicas_raw int"
SLOTS = "cluster bigint, slot string"


def fleet(spark, *clusters):
    return spark.createDataFrame([(i, i, f"i{i}", "cluster", s, r) for i, (s, r) in enumerate(clusters)], LAYOUT)


def slots(spark, *names):
    return spark.createDataFrame([(0, n) for n in names], SLOTS)


def replicas(spark, clusters, *names):
    return layout.allocate_replicas(fleet(spark, *clusters), slots(spark, *names))


def named(df):
    return sorted(r.replica_name for r in df.select("replica_name").collect())


def test_two_by_two(spark):
    made = replicas(spark, [(2, 2)])
    assert named(made) == ["i0-cluster-0-0", "i0-cluster-0-1", "i0-cluster-1-0", "i0-cluster-1-1"]
    assert [tuple(r) for r in layout.topology_counts(made).collect()] == [(0, 1, 2, 4)]


@pytest.mark.parametrize(
    ("shape", "counts"),
    [
        ((2, 2), {"set": 4, "service": 5, "config": 6}),
        ((2, 1), {"set": 2, "service": 3, "config": 4}),
        ((1, 1), {"set": 1, "service": 2, "config": 3}),
    ],
)
def test_objects_of_an_installation(spark, shape, counts):
    found = reconcile.desired_objects(replicas(spark, [shape])).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in found} == counts


def test_zero_counts_become_one(spark):
    assert named(replicas(spark, [(0, 0)])) == ["i0-cluster-0-0"]


@pytest.mark.parametrize(
    ("count", "deleted", "left", "total"),
    [
        (2, [0], ["i0-cluster-0-1"], 3),
        (3, [0, 2], ["i0-cluster-0-1"], 4),
        (2, [0, 1], ["i0-cluster-0-0", "i0-cluster-0-1"], 4),
        (2, [0, 1, 2], ["i0-cluster-0-0", "i0-cluster-0-1"], 4),
        (2, [], ["i0-cluster-0-0", "i0-cluster-0-1"], 4),
        (2, [7], ["i0-cluster-0-0"], 3),
    ],
)
def test_deleted_slots(spark, count, deleted, left, total):
    made = replicas(spark, [(2, count)], *[f"i0-cluster-0-{d}" for d in deleted])
    names = named(made)
    assert [n for n in names if n.startswith("i0-cluster-0-")] == left
    assert len(names) == total


def test_slots_do_not_leak_to_a_shard_with_a_shorter_name(spark):
    made = replicas(spark, [(11, 2)], "i0-cluster-10-0")
    assert "i0-cluster-1-0" in named(made) and "i0-cluster-10-0" not in named(made)


def test_ordinals_against_brute_force(spark):
    rng = random.Random(7)
    sizes = [(1, rng.randint(1, 9)) for _ in range(60)]
    taken = {i: {rng.randint(0, 11) for _ in range(rng.randint(0, 8))} for i in range(60)}
    made = replicas(spark, sizes, *[f"i{i}-cluster-0-{o}" for i, os in taken.items() for o in os for _ in range(2)])
    expected = []
    for i, (_, count) in enumerate(sizes):
        skip = taken[i] if len(taken[i]) < count else set()
        free = [o for o in range(100) if o not in skip][: count - len(skip)]
        expected += [f"i{i}-cluster-0-{o}" for o in free]
    assert named(made) == sorted(expected)


def test_declared_shards_are_kept(spark):
    declared = spark.createDataFrame([(0, "own-shard"), (0, "i0-cluster-1"), (1, "a"), (1, "b")], "cluster bigint, shard_name string")
    made = layout.expand_shards(fleet(spark, (3, 1), (1, 1)), declared)
    got = sorted((r.cluster, r.shard_name) for r in made.collect())
    assert got == [(0, "i0-cluster-1"), (0, "i0-cluster-2"), (0, "own-shard"), (1, "a"), (1, "b")]


def test_declared_replicas(spark):
    shards = layout.allocate_ordinals(layout.expand_shards(fleet(spark, (1, 2), (1, 1))), slots(spark))
    declared = spark.createDataFrame(
        [("i0-cluster-0", "mine"), ("i1-cluster-0", "extra"), ("i1-cluster-0", "i1-cluster-0-0")], "shard_name string, replica_name string"
    )
    got = sorted(r.replica_name for r in layout.keep_declared_replicas(shards, declared).collect())
    assert got == ["i0-cluster-0-1", "i1-cluster-0-0", "mine"]


def test_internal_replication(spark):
    rows = [(0, 0, "i0", "cluster", 1, n, raw) for n, raw in ((1, ""), (2, ""), (2, "Off"), (1, "yes"))]
    df = spark.createDataFrame(rows, LAYOUT + ", internal_raw string")
    shards = layout.internal_replication(df.withColumn("replica_count", F.col("replicas_raw")))
    assert [r.internal_replication for r in shards.collect()] == ["false", "true", "false", "true"]


def observed(spark, rows):
    full = [(c, s, o, ready, 1, 1, 1, gen, 1, "r", "r", state, False) for c, s, o, ready, gen, state in rows]
    return spark.createDataFrame(
        full,
        "cluster bigint, shard int, ordinal int, ready int, replicas int, current_replicas int, updated_replicas int, "
        "generation int, observed_generation int, current_revision string, update_revision string, prev_state string, upgrading boolean",
    )


def state(spark, clusters, live):
    wanted = replicas(spark, clusters)
    nobody = spark.createDataFrame([], "inst bigint")
    done = status.installation_state(
        layout.topology_counts(wanted).select("inst", "replicas"), wanted, status.replica_phase(observed(spark, live)), nobody
    )
    return [(r.total, r.ready, r.state) for r in done.collect()]


def test_completed_when_all_are_ready(spark):
    live = [(0, s, o, 1, 1, "Sync") for s in (0, 1) for o in (0, 1)]
    assert state(spark, [(2, 2)], live) == [(4, 4, "Completed")]


def test_one_set_unavailable(spark):
    live = [(0, s, o, int((s, o) != (1, 1)), 1, "Sync") for s in (0, 1) for o in (0, 1)]
    assert state(spark, [(2, 2)], live) == [(4, 3, "InProgress")]


def test_scale_out(spark):
    assert state(spark, [(2, 2)], [(0, 0, 0, 1, 1, "Sync")]) == [(4, 1, "InProgress")]


def test_phases(spark):
    rows = [(0, 0, 0, 0, 1, "Sync"), (0, 0, 1, 1, 1, "NotSync"), (0, 0, 2, 1, 2, "NotSync"), (0, 0, 3, 1, 1, "Sync")]
    got = {r.ordinal: (r.phase, r.state) for r in status.replica_phase(observed(spark, rows)).collect()}
    assert got == {0: ("Scale", "NotSync"), 1: ("Ready", "NotSync"), 2: ("Normal", "NotSync"), 3: ("Normal", "Sync")}


def test_empty_installation_is_healthy(spark):
    clusters = spark.createDataFrame([(1, 10), (2, 20)], "inst bigint, cluster bigint")
    phases = status.replica_phase(observed(spark, [(20, 0, 0, 0, 1, "Sync")]))
    got = {r.inst: (r.healthy, r.shards) for r in status.health_rollup(clusters, phases).collect()}
    assert got == {1: (True, 0), 2: (False, 1)}


def test_surplus_guard(spark):
    place = "inst bigint, cluster bigint, shard int, ordinal int"
    old = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 0, 1), (0, 0, 1, 0), (0, 0, 2, 0)], place)
    new = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 1)], place)
    got = {(r.shard, r.ordinal): r.guarded for r in reconcile.surplus_replicas(old, new).collect()}
    assert got == {(0, 1): True, (1, 0): False, (2, 0): False}


def test_reconcile_without_snapshot_counts_as_changed(spark):
    spec = "cluster bigint, shard int, ordinal int, image int, replicas int, strategy string"
    want = spark.createDataFrame([(0, 0, o, 1, 1, "RollingUpdate") for o in range(4)] + [(1, 0, 0, 1, 1, "RollingUpdate")], spec)
    same = '{"image":1,"replicas":1,"strategy":"RollingUpdate"}'
    seen = spark.createDataFrame(
        [(0, 0, 0, same), (0, 0, 1, None), (0, 0, 2, same.replace("1,", "2,", 1)), (0, 0, 9, same)],
        "cluster bigint, shard int, ordinal int, last_applied string",
    )
    clusters = spark.createDataFrame([(0, 0, False), (1, 1, True)], "inst bigint, cluster bigint, paused boolean")
    got = {r.ordinal: r.action for r in reconcile.reconcile_plan(want, seen, clusters).collect()}
    assert got == {0: "None", 1: "Update", 2: "Update", 3: "Add", 9: "Delete"}


def test_labels_against_brute_force(spark):
    rng = random.Random(3)
    label = lambda: {k: rng.choice("ab") for k in rng.sample(["app", "x", "y", "z"], rng.randint(0, 4))}
    objects = [(i, rng.choice(["n1", "n2"]), {**label(), "managed": "yes"}) for i in range(80)]
    selectors = [(i, rng.choice(["n1", "n2", "n3"]), label()) for i in range(25)] + [(98, "n1", {}), (99, "n1", {"managed": "yes"}), (97, "n1", {"no": "where"})]
    expected = sorted(
        (s, o) for s, sn, sm in selectors for o, on, om in objects if sn == on and all(om.get(k) == v for k, v in sm.items())
    )
    got = reconcile.match_labels(
        spark.createDataFrame(objects, "object int, namespace string, labels map<string,string>"),
        spark.createDataFrame(selectors, "selector int, namespace string, match map<string,string>"),
    )
    assert sorted((r.selector, r.object) for r in got.collect()) == expected


def test_annotations_are_compared_without_the_snapshot(spark):
    spec = "cluster bigint, shard int, ordinal int, image int, replicas int, strategy string, annotations map<string,string>"
    want = [(0, 0, o, 1, 1, "RollingUpdate", a) for o, a in enumerate([{"a": "1", "b": "2"}, {"a": "1"}, {}, None])]
    same = '{"image":1,"replicas":1,"strategy":"RollingUpdate"}'
    own = {reconcile.SNAPSHOT_ANNOTATION: same}
    seen = [(0, 0, o, same, a) for o, a in enumerate([{"b": "2", "a": "1", **own}, {"a": "2"}, {"a": "1", **own}, own])]
    clusters = spark.createDataFrame([(0, 0, False)], "inst bigint, cluster bigint, paused boolean")
    plan = reconcile.reconcile_plan(
        spark.createDataFrame(want, spec),
        spark.createDataFrame(seen, "cluster bigint, shard int, ordinal int, last_applied string, annotations map<string,string>"),
        clusters,
    )
    assert {r.ordinal: r.action for r in plan.collect()} == {0: "None", 1: "Update", 2: "Update", 3: "None"}


def test_status_by_name(spark):
    phases = spark.createDataFrame(
        [(2, 0, 0, "r", "Scale", "NotSync"), (1, 0, 0, "r", "Normal", "Sync"), (1, 0, 1, "s", "Ready", "NotSync")],
        "cluster int, shard int, ordinal int, replica_name string, phase string, state string",
    )
    names = spark.createDataFrame([("r",), ("s",), ("t",)], "replica_name string")
    got = {r.replica_name: (r.phase, r.state) for r in status.status_by_name(names, phases).collect()}
    assert got == {"r": ("Normal", "Sync"), "s": ("Ready", "NotSync"), "t": (None, None)}


def test_watch_list():
    assert reconcile.watch_list("ns", single="a", listed="b:c,", configured=["d"]) == ["b", "c"]
    assert reconcile.watch_list("ns", single="a", configured=["d"]) == ["a"]
    assert reconcile.watch_list("ns", configured=["d"]) == ["d"]
    assert reconcile.watch_list("ns") == ["ns"]
    assert reconcile.watch_list("kube-system") == []


def test_feed_namespace():
    assert reconcile.feed_namespace(["a"]) == "a"
    assert reconcile.feed_namespace(["a", "b"]) == "" == reconcile.feed_namespace([])
