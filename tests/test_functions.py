import pytest
from pyspark.sql import functions as F

from fleetspark.functions import hashes, names, quantities, text


def values(spark, expression, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c")).alias("v")).collect()]


def test_first_create_only(spark):
    assert values(
        spark, text.if_not_exists, "CREATE TABLE a AS CREATE TABLE b", "CREATE MATERIALIZED VIEW v", "DROP x", "-- \nCREATE VIEW w"
    ) == [
        "CREATE TABLE IF NOT EXISTS a AS CREATE TABLE b",
        "CREATE MATERIALIZED VIEW IF NOT EXISTS v",
        "DROP x",
        "-- \nCREATE VIEW IF NOT EXISTS w",
    ]


def test_distributed_targets(spark):
    rows = ["Distributed('all', 'd1', 't1', rand())", "Distributed(all, d1, t1)", "MergeTree()"]
    assert values(spark, text.target_database, *rows) == ["d1", "d1", ""]
    assert values(spark, text.target_table, *rows) == ["t1", "t1", ""]


def test_number_text(spark):
    assert values(spark, text.number_text, "1.5", "2", "2.0005", "-1.5", "0.25", "-3", "1e3") == [
        "1.500000", "2", "2", "-1", "0.250000", "-3", "1000",
    ]


def test_flags(spark):
    words = ["Yes", "OFF", "enabled", "0", "maybe", ""]
    assert values(spark, lambda c: text.flag_text(c, True), *words) == ["true", "false", "true", "false", "true", "true"]
    assert values(spark, lambda c: text.flag_text(c, False, "1", "0"), *words) == ["1", "0", "1", "0", "0", "0"]


def test_paths(spark):
    rows = ["a//b///c////", "/a", "a/b", "//", "conf.D/x", "Users/y", "misc/z", "f"]
    assert values(spark, text.normalize_path, *rows)[:4] == ["a/b/c", "a", "a/b", ""]
    assert values(spark, text.path_section, *rows[4:]) == ["HOST", "USERS", "unknown", "none"]


def test_int_or_zero(spark):
    assert values(spark, text.int_or_zero, "9000", "x", "+5", "-1", "1.5", None) == [9000, 0, 5, -1, 0, 0]


def test_endpoints(spark):
    df = spark.createDataFrame([("", ""), ("u", ""), ("u", "p"), ("", "p")], "u string, p string")
    url = text.endpoint(F.col("u"), F.col("p"), F.lit("h"), F.lit(8123))
    got = [tuple(r) for r in df.select(url, text.masked_endpoint(url)).collect()]
    masked = "http://***:***@h:8123/"
    assert got == [("http://h:8123/", masked), ("http://u@h:8123/", masked), ("http://u:p@h:8123/", masked), ("http://:p@h:8123/", masked)]


def test_namespace_list():
    assert text.split_namespaces("a:b,,c:") == ["a", "b", "c"]
    assert text.split_namespaces("") == []


def test_attach_replaces_every_hit(spark):
    df = spark.createDataFrame([("CREATE TABLE a CREATE TABLE b", 253), ("CREATE TABLE a", 1), ("CREATE VIEW a", 253)], "s string, c int")
    got = [r[0] for r in df.select(text.attach_on_conflict(F.col("s"), F.col("c"))).collect()]
    assert got == ["ATTACH TABLE a ATTACH TABLE b", "CREATE TABLE a", "CREATE VIEW a"]


def test_last_ordinal(spark):
    rows = ["a-b-0-12", "a-b-x", "a-b", "a", "", "a-b-"]
    assert values(spark, names.last_ordinal, *rows) == [12, 0, -1, -1, -1, 0]


def test_pattern_is_filled_in_one_pass(spark):
    fill = lambda c: names.fill_pattern("di-{di}-{replica}-{other}", di=c, replica=F.lit("{di}"))
    assert values(spark, fill, "x") == ["di-x-{di}-{other}"]
    fixed = names.fill_pattern(names.COMMON_CONFIG_NAME, di=F.lit("test-installation"))
    assert values(spark, lambda c: fixed, "x") == ["di-test-installation-common-configd"]


def test_hashes(spark):
    import hashlib

    def fnv(data: bytes) -> int:
        h = 2166136261
        for b in data:
            h = ((h ^ b) * 16777619) % 2**32
        return h

    rows = ["a", "", "grüße", "日本語 text", "x" * 500]
    assert values(spark, hashes.fnv1a, *rows) == [fnv(r.encode()) for r in rows]
    assert fnv(b"a") == 3826002220
    digest = hashlib.sha1(b"a").hexdigest()
    assert values(spark, lambda c: hashes.short_id(c, 6), "a") == [digest[-6:]]
    assert values(spark, lambda c: hashes.short_id(c, 0), "a") == [digest]
    assert values(spark, hashes.password_digest, "qwerty") == [hashlib.sha256(b"qwerty").hexdigest()]


@pytest.mark.parametrize(
    ("size", "expected"),
    [("1Gi", 2**30), ("100Mi", 100 * 2**20), ("100M", 10**8), ("5", 5), ("1.5Ki", 1536), ("0.1k", 100), ("x", None), ("1Xi", None), (None, None)],
)
def test_quantities(spark, size, expected):
    assert values(spark, quantities.quantity_bytes, size) == [expected]


def test_size_change(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (0, 1), (1, 0), (None, 1)], "o bigint, n bigint")
    got = [r[0] for r in df.select(quantities.size_change(F.col("o"), F.col("n"))).collect()]
    assert got == [1, -1, 0, 0, 0, 0]


@pytest.mark.parametrize(
    "size, expected",
    [
        ("1Ei", 2**60), ("1E", 10**18), ("500m", 1), ("1500m", 2), ("1e3", 1000), ("2.5E2", 250), ("+1Gi", 2**30), (".5k", 500), ("-3", -3),
        ("10000Pi", 2**63 - 1), ("9e99", 2**63 - 1), ("-9e99", -(2**63 - 1)), ("1e3k", None), ("Gi", None), ("", None), ("1Xi", None), (None, None),
    ],
)
def test_quantities_of_all_forms(spark, size, expected):
    assert values(spark, quantities.quantity_bytes, size) == [expected]


def test_numbers_beyond_64_bits_are_written_out(spark):
    assert values(spark, lambda c: text.number_text(c.cast("double")), "1e30", "-1e20", None) == ["1" + "0" * 30, "-100000000000000000000", None]


def test_settings_that_are_no_json(spark):
    from fleetspark.sources import settings_json

    rows = spark.createDataFrame([(1, '{"a": 1e30, "b": "x"}'), (2, '{"a": '), (3, None), (4, "")], "id int, body string")
    assert sorted(tuple(r)[:2] for r in settings_json.ingest_settings(rows, "body").collect()) == [(1, "a"), (1, "b")]
    assert sorted(r.id for r in settings_json.malformed_settings(rows, "body").collect()) == [2, 4]
