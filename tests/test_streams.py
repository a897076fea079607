import datetime
import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import catalog, changes
from fleetspark.plans import registry
from fleetspark.sources import fleet_tables as fx
from fleetspark.sources import logs
from fleetspark.streaming import feeds

FEED = "key BIGINT, kind STRING, ts TIMESTAMP_NTZ, event_id BIGINT, phase INT"


def events(seed=1, n=600):
    """A third of the events belong to one key."""
    rng = random.Random(seed)
    at = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at += datetime.timedelta(minutes=rng.choice([0, 1, 7, 90]))
        key = 0 if rng.random() < 0.34 else rng.randint(1, 20)
        rows.append((key, rng.choice(["ADDED", "MODIFIED", "MODIFIED", "DELETED"]), at, i, rng.randint(0, 2)))
    return rows


def transitions(rows):
    done = {}
    for key, _, ts, _, phase in sorted(rows, key=lambda r: (r[2], r[3])):
        before = done.get(key)
        if before is None or before[0] != phase:
            done[key] = (phase, ts, (before[2] if before else 0) + 1, ts)
        else:
            done[key] = (phase, before[1], before[2], ts)
    return done


def queue_files(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FEED).coalesce(1).write.parquet(f"{folder}/part{i}")
    return feeds.read_events(spark, f"{folder}/*", FEED, files_per_trigger=1)


def state_keys(spark, checkpoint, name):
    """Keys that have a value in a processor's state."""
    rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return sorted(r[0] for r in rows.selectExpr("key.key").distinct().collect())


def test_queue_that_empties_fills_and_empties(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    ready = changes.READY_PHASE
    feed = [[(1, "ADDED", at, 0, 1)], [(1, "MODIFIED", at, 1, ready)], [(2, "ADDED", at, 2, 1)], [(2, "MODIFIED", at, 3, ready), (3, "ADDED", at, 4, ready)]]
    waiting = []
    for k in range(1, 5):
        stream = queue_files(spark, tmp_path / f"in{k}", feed[:k])
        table = str(tmp_path / f"table{k}")
        feeds.requeue_backlog(stream, table, str(tmp_path / f"checkpoint{k}")).awaitTermination()
        waiting.append(sorted(r.key for r in feeds.read_queue(spark, table).collect()))
    assert waiting == [[1], [], [2], []]


def test_queue_that_is_always_empty_and_stream_without_batch(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    stream = queue_files(spark, tmp_path / "in", [[(1, "ADDED", at, 0, changes.READY_PHASE)], [(2, "ADDED", at, 1, changes.READY_PHASE)]])
    table = str(tmp_path / "table")
    assert feeds.read_queue(spark, table).count() == 0 and feeds.read_latest(spark, table).count() == 0
    feeds.requeue_backlog(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
    assert feeds.read_queue(spark, table).count() == 0


def test_tries_follow_the_watermark(spark, tmp_path):
    """Tries at 5, 15, 30 .. 275 seconds; the clock is another key's events."""
    start = datetime.datetime(2024, 1, 1)
    seconds = [0, 4, 5, 16, 29, 274, 275, 900]
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for k, s in enumerate(seconds):
        clock = [(9, "MODIFIED", start + datetime.timedelta(seconds=s), 100 + k, changes.READY_PHASE)]
        spark.createDataFrame(([(1, "ADDED", start, 0, 1)] if k == 0 else []) + clock, FEED).coalesce(1).write.parquet(f"{folder}/part{k}")
        stream = feeds.read_events(spark, f"{folder}/*", FEED)
        feeds.requeue_backlog(stream, table, checkpoint, lateness="0 seconds").awaitTermination()
        now = start + datetime.timedelta(seconds=s)
        [row] = feeds.read_queue(spark, table).collect()
        assert row.tries == sum(5 * n * (n + 1) // 2 <= s for n in range(1, 11))
        assert row.due == (None if row.tries == 10 else start + datetime.timedelta(seconds=5 * (row.tries + 1) * (row.tries + 2) // 2))
        latest = changes.latest_per_key(spark.read.schema(FEED).parquet(f"{folder}/*"))
        twin = changes.retry_queue(latest, F.lit(str(now)).cast("timestamp_ntz")).collect()
        assert [(r.key, r.tries, r.due) for r in twin] == [(1, row.tries, row.due)]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_late_and_untimed_events_in_any_batch(spark, tmp_path, parts):
    """Events are dealt to batches at random and arrive within the lateness."""
    rng = random.Random(parts)
    rows = [(k, kind, None if rng.random() < 0.1 else ts, i, phase) for k, kind, ts, i, phase in events(seed=parts, n=200)]
    dealt = [[] for _ in range(parts)]
    for row in rows:
        rng.choice(dealt).append(row)
    whole = spark.createDataFrame(rows, FEED)
    twins = {"track_phase": (feeds.read_transitions, changes.phase_transitions(whole)), "coalesce_changes": (feeds.read_latest, changes.latest_per_key(whole))}
    for name, (read, twin) in twins.items():
        stream = queue_files(spark, tmp_path / name, dealt)
        table = str(tmp_path / f"{name}-table")
        getattr(feeds, name)(stream, table, str(tmp_path / f"{name}-at"), lateness="60 days").awaitTermination()
        assert sorted(map(str, read(spark, table).select(*twin.columns).collect())) == sorted(map(str, twin.collect()))


def test_purged_keys_leave_no_state(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    hour = datetime.timedelta(hours=1)
    first = [(1, "ADDED", day, 0, 0), (2, "ADDED", day, 1, 0), (1, "DELETED", day + hour, 2, 0), (2, "DELETED", day + hour, 3, 0), (3, "DELETED", None, 4, 0)]
    later = [(9, "ADDED", day + 30 * hour, 5, 0)]
    back = [(1, "ADDED", day + 31 * hour, 6, 1)]
    children = spark.createDataFrame([(2, False), (2, True), (1, True)], "key bigint, gone boolean")
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "at")
    feeds.soft_delete(queue_files(spark, tmp_path / "in", [first, later, back]), table, checkpoint, children).awaitTermination()
    assert state_keys(spark, checkpoint, "last") == [1, 2, 9]  # 2 has a child, 1 came back
    assert sorted((r.key, r.purge) for r in feeds.read_tombstones(spark, table).collect()) == [(2, False), (3, True)]
    assert sorted(r.key for r in changes.present(feeds.read_latest(spark, table)).collect()) == [1, 9]


def as_dict(df):
    return {r.key: (r.phase, r.last_transition, r.transitions, r.last_seen) for r in df.collect()}


def test_transitions_against_brute_force(spark):
    rows = events()
    assert as_dict(changes.phase_transitions(spark.createDataFrame(rows, FEED))) == transitions(rows)


@pytest.fixture()
def batches(spark, tmp_path):
    """The feed cut into four files, taken one per batch."""
    rows = events(seed=9)
    at = tmp_path / "in"
    for i in range(4):
        part = spark.createDataFrame(rows[i * 150 : (i + 1) * 150], FEED)
        part.coalesce(1).write.mode("append").parquet(str(at / f"part{i}"))
    stream = feeds.read_events(spark, str(at / "*"), FEED, files_per_trigger=1)

    class Batches(tuple):
        folder = at

    return Batches((rows, stream, str(tmp_path / "table"), str(tmp_path / "checkpoint")))


def test_phase_stream_over_batches(spark, batches):
    """Late by less than the lateness in every batch; a restart goes on from the state."""
    rows, stream, table, checkpoint = batches
    query = feeds.track_phase(stream, table, checkpoint)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 4
    assert as_dict(feeds.read_transitions(spark, table)) == transitions(rows)
    more = [(k, "MODIFIED", rows[-1][2] + datetime.timedelta(minutes=k), 10_000 + k, k % 3) for k in range(25)]
    spark.createDataFrame(more, FEED).coalesce(1).write.parquet(f"{batches.folder}/part9")
    feeds.track_phase(stream, table, checkpoint).awaitTermination()
    assert as_dict(feeds.read_transitions(spark, table)) == transitions(rows + more)
    feeds.track_phase(stream, table, checkpoint).awaitTermination()
    assert as_dict(feeds.read_transitions(spark, table)) == transitions(rows + more)


def test_latest_stream_over_batches(spark, batches):
    rows, stream, table, checkpoint = batches
    feeds.coalesce_changes(stream, table, checkpoint).awaitTermination()
    last = {}
    for row in sorted(rows, key=lambda r: (r[2], r[3])):
        last[row[0]] = row
    got = {r.key: tuple(r) for r in feeds.read_latest(spark, table).collect()}
    assert got == last


def test_backlog_stream_over_batches(spark, batches):
    rows, stream, table, checkpoint = batches
    feeds.requeue_backlog(stream, table, checkpoint).awaitTermination()
    latest = changes.latest_per_key(spark.createDataFrame(rows, FEED))
    passed = F.lit(str(max(r[2] for r in rows) - datetime.timedelta(hours=1))).cast("timestamp_ntz")
    whole = changes.retry_queue(latest, passed)
    assert sorted(feeds.read_queue(spark, table).select(*whole.columns).collect()) == sorted(whole.collect())


def test_tombstones(spark, batches):
    rows, stream, table, checkpoint = batches
    children = spark.createDataFrame([(k, k % 2 == 1) for k in range(21)], "key bigint, gone boolean")
    feeds.soft_delete(stream, table, checkpoint, children).awaitTermination()
    whole = changes.tombstones(changes.latest_per_key(spark.createDataFrame(rows, FEED)), children)
    got = feeds.read_tombstones(spark, table)
    assert sorted(got.collect()) == sorted(whole.collect())
    assert {r.key for r in got.collect() if r.purge} == {r.key for r in got.collect() if r.key % 2}


def test_owned_objects_in_a_stream(spark, tmp_path):
    schema = FEED + ", object BIGINT"
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, "ADDED", at, 0, 0, None), (77, "MODIFIED", at, 1, 1, 5), (78, "MODIFIED", at, 2, 2, 6)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    ownership = spark.createDataFrame([(5, 1)], "object bigint, owner bigint")
    stream = feeds.read_events(spark, str(tmp_path / "in"), schema)
    feeds.coalesce_changes(stream, str(tmp_path / "t"), str(tmp_path / "c"), ownership).awaitTermination()
    assert [(r.key, r.event_id) for r in feeds.read_latest(spark, str(tmp_path / "t")).collect()] == [(1, 1)]


def test_log_table(spark, tmp_path):
    folder = str(tmp_path / "log")
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(hours=7 * i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id int, event_time timestamp_ntz").withColumn("event_date", F.to_date("event_time"))
    logs.write_log(df, folder)
    now = datetime.date(2024, 2, 10)
    kept = logs.read_retained(spark, folder, now)
    assert {r.event_id for r in kept.collect()} == {i for i, t in rows if t.date() + datetime.timedelta(days=30) > now}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "event_date#" in plan
    assert logs.expired_days(spark, folder, now).count() == 11


def test_flushes_are_compacted_and_days_expire(spark, tmp_path):
    schema = "event_id int, event_time timestamp_ntz"
    landing, folder = str(tmp_path / "landing"), str(tmp_path / "log")
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(hours=7 * (i * 37 % 100))) for i in range(100)]
    for k in range(5):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = feeds.read_events(spark, f"{tmp_path}/in/*", schema, 1).withColumn("event_date", F.to_date("event_time"))
    feeds.log_sink(stream, landing, str(tmp_path / "at"), available_now=True).awaitTermination()
    logs.compact_log(spark, landing, folder)
    per_day = lambda path: spark.read.parquet(path).select("event_date", F.input_file_name().alias("file")).distinct().groupBy("event_date").count().collect()
    assert max(r["count"] for r in per_day(landing)) > 1 == max(r["count"] for r in per_day(folder))
    rows_of = lambda: sorted(tuple(r) for r in spark.read.parquet(folder).select("event_id", "event_time").collect())
    assert rows_of() == sorted(rows)
    for file in spark.read.parquet(folder).select(F.input_file_name().alias("f")).distinct().collect():
        times = [r.event_time for r in spark.read.parquet(file.f).collect()]
        assert times == sorted(times)
    logs.compact_log(spark, landing, folder, [datetime.date(2024, 1, 3)])
    assert rows_of() == sorted(rows)
    now = datetime.date(2024, 2, 10)
    gone = logs.expire_log(spark, folder, now)
    assert gone == [datetime.date(2024, 1, d) for d in range(1, 12)]
    assert rows_of() == sorted(r for r in rows if r[1].date() not in gone)
    assert logs.expire_log(spark, folder, now) == [] and logs.expired_days(spark, folder, now).count() == 0


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    folder = str(tmp_path / "log")
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(seconds=i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "event_id int, event_time timestamp_ntz").withColumn("event_date", F.to_date("event_time"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        logs.write_log(df, folder)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spark.read.parquet(folder).select(F.input_file_name()).distinct().count() > 1


CATALOG = "host int, database string, name string, engine string, engine_full string, create_table_query string"


def test_registered_streams_keep_all_events_in_order(spark, tmp_path):
    """Events of two months, some without a time."""
    rng = random.Random(5)
    rows = [
        (i, None if i % 50 == 7 else datetime.datetime(2024, 1, 20) + datetime.timedelta(hours=i), rng.randint(0, 5), rng.choice(["signup", "error", "click"]), 1.0, f'{{"k": {rng.randint(0, 2)}}}')
        for i in range(600)
    ]
    spark.createDataFrame(rows, fx.SCHEMAS["events"]).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    arrived = [part.select("ts", "event_id").collect() for part in registry._arrivals(spark, str(tmp_path))]
    assert sorted((str(r.ts), r.event_id) for part in arrived for r in part) == sorted((str(r[1]), r[0]) for r in rows) and all(arrived)
    assert any(max(r.ts for r in a if r.ts) > min(r.ts for r in b if r.ts) for a, b in zip(arrived, arrived[1:]))  # some come late
    for name in ("latest_state", "phase_transitions"):
        want, got = (registry.QUERIES[q](spark, str(tmp_path)) for q in (name, f"stream_{name}"))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_first_available(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 1, "d")], "g int, p int, v string")
    ends = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "g int, p int, ok boolean")
    assert sorted(r.v for r in catalog.first_available(rows, ends, "g", "p", "ok").collect()) == ["b", "c"]
    assert [r.g for r in catalog.unanswered_groups(ends, "g", "ok").collect()] == [2]


def test_readiness_assertion(spark):
    good = spark.createDataFrame([(1, "all-sharded", True)], "host int, cluster string, is_local boolean")
    assert catalog.assert_ready(good, "all-sharded").count() == 1
    bad = spark.createDataFrame([(1, "all-sharded", False)], "host int, cluster string, is_local boolean")
    with pytest.raises(Exception, match="host not ready"):
        catalog.assert_ready(bad, "all-sharded").collect()


def test_sources_exclude_the_new_host(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 9)], "cluster int, host int")
    new = spark.createDataFrame([(1, 2), (2, 9)], "cluster int, host int")
    assert sorted((r.host, r.source) for r in catalog.exclude_self(members, new).collect()) == [(2, 1), (2, 3)]


def test_catalog_dumps_are_united(spark, tmp_path):
    for i in (1, 2):
        spark.createDataFrame([(i, "d", "t", None, "", "")], CATALOG).write.parquet(str(tmp_path / str(i)))
    both = catalog.read_catalogs(spark, [str(tmp_path / "1"), str(tmp_path / "2")])
    hosts = spark.createDataFrame([(1, True), (2, False)], "host int, available boolean")
    assert [(r.host, r.engine) for r in catalog.scan_catalog(both, hosts).collect()] == [(1, "")]
