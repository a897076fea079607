"""Nested differences, trees of digests, distributed numbers and incremental normalisation against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import documents, layout, nested
from fleetspark.plans import normalize


def flat(value, path=""):
    if isinstance(value, dict) and value:
        return {p: v for k, x in value.items() for p, v in flat(x, f"{path}.{k}" if path else k).items()}
    if isinstance(value, list) and value:
        out, seen = {}, {}
        for at, item in enumerate(value):
            name = item.get("name") if isinstance(item, dict) else None
            label = str(at)
            if name is not None:
                seen[name] = seen.get(name, 0) + 1
                label = f"name={name}" + (f"#{seen[name]}" if seen[name] > 1 else "")
            out |= flat(item, f"{path}[{label}]")
        return out
    if isinstance(value, (dict, list)):
        return {path: "{}" if isinstance(value, dict) else "[]"}
    return {path: None if value is None else json.dumps(value) if isinstance(value, bool) else str(value)}


def random_spec(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < 0.35:
        return {k: random_spec(rng, depth + 1) for k in rng.sample("abcde", rng.randint(0, 4))}
    if depth < 4 and kind < 0.6:
        items = [random_spec(rng, depth + 1) for _ in range(rng.randint(0, 4))]
        return [{"name": rng.choice("xyz"), **i} if isinstance(i, dict) else i for i in items]
    return rng.choice([1, 2, "p", "q", "", True, None, 1.5])


def test_flattened_objects(spark):
    rng = random.Random(1)
    specs = {i: {"spec": random_spec(rng), "metadata": {"resourceVersion": i}} for i in range(120)}
    rows = [(i, json.dumps(s)) for i, s in specs.items()] + [(1000, None), (1001, "{broken"), (1002, "7"), (1003, "[]")]
    got = {(r.id, r.path): r.value for r in nested.flatten_json(spark.createDataFrame(rows, "id int, spec string"), ["id"], "spec").collect()}
    want = {(i, p): v for i, s in specs.items() for p, v in flat(s).items()} | {(1002, ""): "7", (1003, ""): "[]"}
    assert got == want


def test_nested_differences(spark):
    rng = random.Random(2)
    new = {i: {"spec": random_spec(rng), "metadata": {"resourceVersion": 1}} for i in range(60)}
    old = {i: {"spec": random_spec(rng) if i % 2 else new[i]["spec"], "metadata": {"resourceVersion": 2}} for i in range(10, 60)} | {99: {"a": 1}}
    frame = lambda specs: spark.createDataFrame([(i, json.dumps(s)) for i, s in specs.items()], "id int, spec string")
    got = {(r.id, r.path): (r.change, r.old, r.new) for r in nested.nested_differences(frame(new), frame(old), ["id"], "spec").collect()}
    want = {}
    for i in new.keys() | old.keys():
        a, b = flat(new[i]) if i in new else {}, flat(old[i]) if i in old else {}
        for path in a.keys() | b.keys():
            if path != "metadata.resourceVersion" and (path not in a or path not in b or a[path] != b[path]):
                want[i, path] = ("changed" if path in a and path in b else "added" if path in a else "removed", b.get(path), a.get(path))
    assert got == want


def test_items_are_compared_by_name_not_by_place(spark):
    frame = lambda items: spark.createDataFrame([(1, json.dumps({"items": items}))], "id int, spec string")
    left, right = [{"name": "a", "v": 1}, {"name": "b", "v": 2}], [{"name": "b", "v": 2}, {"name": "a", "v": 3}]
    assert [tuple(r) for r in nested.nested_differences(frame(left), frame(right), ["id"], "spec").collect()] == [(1, "items[name=a].v", "changed", "3", "1")]
    assert nested.nested_differences(frame(left), frame(left), ["id"], "spec").count() == 0


def joined(spark, new, old):
    """The leaves of both sides, joined by path, in plain Python."""
    want = []
    for i in new.keys() | old.keys():
        a, b = ([(p, v) for spec in side.get(i, []) for p, v in spec] for side in (new, old))
        want += [(i, p, "changed", w, v) for p, v in a for q, w in b if p == q and v != w]
        want += [(i, p, "added", None, v) for p, v in a if p not in {q for q, _ in b}]
        want += [(i, p, "removed", v, None) for p, v in b if p not in {q for q, _ in a}]
    return sorted(want, key=str)


def test_paths_that_are_written_alike(spark):
    """A path with several meanings has the leaves of all; deep specs take more than one pass."""
    deep = lambda v: json.dumps({"a": [{"name": "x", "b": [[[[[[{"c": v}]]]]]]}, {"name": "x", "b": v}]})
    at = "a[name=x].b" + "[0]" * 6 + ".c"
    cases = {
        1: ('{"a.b": 1, "a": {"b": 2}, "k": {"p.q": 5}}', [("a.b", "1"), ("a.b", "2"), ("k.p.q", "5")], '{"a": {"b": 1}, "k": {"p.q": 6}}', [("a.b", "1"), ("k.p.q", "6")]),
        2: ('{"l": [{"name": "x#2", "v": 1}, {"name": "x", "v": 2}, {"name": "x", "v": 3}]}', [("l[name=x#2].name", "x#2"), ("l[name=x#2].v", "1"), ("l[name=x].name", "x"), ("l[name=x].v", "2"), ("l[name=x#2].name", "x"), ("l[name=x#2].v", "3")], "{}", [("", "{}")]),
        3: ('{"": {"a": 1}, "a": 2}', [("a", "1"), ("a", "2")], '{"a": 2}', [("a", "2")]),
        4: (deep(1), [("a[name=x].name", "x"), (at, "1"), ("a[name=x#2].name", "x"), ("a[name=x#2].b", "1")], deep(2), [("a[name=x].name", "x"), (at, "2"), ("a[name=x#2].name", "x"), ("a[name=x#2].b", "2")]),
        5: ('{"a": {"b": 1}}', [("a.b", "1")], '{"a": [1]}', [("a[0]", "1")]),
        6: ('{"a": "1", "b": null}', [("a", "1"), ("b", None)], '{"a": 1, "b": {}}', [("a", "1"), ("b", "{}")]),
    }
    frame = lambda at: spark.createDataFrame([(i, c[at]) for i, c in cases.items()], "id int, spec string")
    got = [tuple(r) for r in nested.nested_differences(frame(0), frame(2), ["id"], "spec").collect()]
    assert sorted(got, key=str) == joined(spark, {i: [c[1]] for i, c in cases.items()}, {i: [c[3]] for i, c in cases.items()})


def test_objects_that_come_twice(spark):
    """A key's leaves of either side are joined by path, as often as they come; keys without a value meet none."""
    frame = lambda rows: spark.createDataFrame(rows, "id int, spec string")
    new, old = frame([(1, '{"a": 1}'), (1, '{"a": 2}'), (2, "{broken"), (None, '{"n": 1}')]), frame([(1, '{"a": 1}'), (2, '{"z": 0}'), (None, '{"n": 2}')])
    got = [tuple(r) for r in nested.nested_differences(new, old, ["id"], "spec").collect()]
    want = [(1, "a", "changed", "1", "2"), (2, "z", "removed", "0", None), (None, "n", "added", None, "1"), (None, "n", "removed", "2", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_leaves_are_not_exchanged(spark, sf_dir):
    """Both objects are unfolded within their row; the result is what one pass has stored."""
    from fleetspark.plans.registry import QUERIES

    plan = QUERIES["spec_differences"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("FileScan") == 1


def leaves(spark, rows):
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], "inst int, cluster int, shard int, ordinal int, digest string")


def test_tree_differences(spark):
    rng = random.Random(3)
    place = lambda: (rng.randint(0, 5), rng.randint(0, 3), rng.randint(0, 2), rng.randint(0, 2))
    old = {place(): rng.choice("ab") for _ in range(150)}
    new = {k: v if k[0] < 3 else rng.choice("ab") for k, v in old.items() if k[0] < 3 or rng.random() < 0.9} | {(9, 0, 0, 0): "a"}
    got = {tuple(r) for r in nested.tree_differences(nested.digest_tree(leaves(spark, new)), nested.digest_tree(leaves(spark, old))).collect()}
    want = set()
    for depth, level in enumerate(nested.LEVELS, 1):
        a, b = {}, {}
        for side, rows in ((a, new), (b, old)):
            for k, v in rows.items():
                side.setdefault(k[:depth], {})[k] = v
        for node in a.keys() | b.keys():
            if a.get(node) != b.get(node):
                change = "changed" if node in a and node in b else "added" if node in a else "removed"
                want.add((level, *node, *[None] * (4 - depth), change))
    assert got == want and not any(n[1] in (0, 1, 2) for n in got)
    same = nested.digest_tree(leaves(spark, old))
    assert nested.tree_differences(same, nested.digest_tree(leaves(spark, old))).count() == 0


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_numbers_over_ranges(spark, partitions):
    """One owner has most of the rows."""
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 9), rng.randint(0, 500)) for _ in range(1500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in layout.numbered(spark.createDataFrame(rows, "owner int, v int"), "owner", ["v"], "number").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = []
    for owner in {o for o, _ in rows}:
        want += [(owner, v, n) for n, v in enumerate(sorted({v for o, v in rows if o == owner}), 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("chunk", [1, 50, 10_000])
def test_texts_of_documents_in_chunks(spark, chunk):
    rng = random.Random(5)
    rows = [(o, f"{i:04d}", "x" * rng.randint(0, 90) + "é") for o in (1, 1, 1, 2) for i in range(rng.randint(1, 200))]
    rows = sorted({(o, p): (o, p, line) for o, p, line in rows}.values())
    got = documents.document_texts(spark.createDataFrame(rows, "owner int, pos string, line string"), ["owner"], chunk).collect()
    for owner in (1, 2):
        mine = sorted((r for r in got if r.owner == owner), key=lambda r: r.chunk)
        whole = "".join(f"{line}\n" for o, _, line in rows if o == owner)
        assert "".join(r.text for r in mine) == whole
        assert all(whole[r.start : r.start + len(r.text)] == r.text and r.start // chunk == r.chunk for r in mine)


def test_long_documents_are_spread_and_short_ones_whole(spark, monkeypatch):
    """Documents on both sides of the limit, one line said twice, and lines without an owner."""
    monkeypatch.setattr(documents, "WHOLE_ROWS", 40)
    rng = random.Random(6)
    rows = [(o, f"{i:04d}", "x" * rng.randint(0, 30)) for o, n in ((1, 300), (2, 40), (3, 41), (4, 1), (None, 90)) for i in range(n)]
    got = documents.document_texts(spark.createDataFrame([*rows, rows[7]], "owner int, pos string, line string"), ["owner"], 100).collect()
    assert {r.owner for r in got} == {1, 2, 3, 4}
    for owner in (1, 2, 3, 4):
        whole = "".join(f"{line}\n" for o, _, line in sorted([r for r in [*rows, rows[7]] if r[0] == owner]))
        mine = sorted((r for r in got if r.owner == owner), key=lambda r: r.chunk)
        assert "".join(r.text for r in mine) == whole and all(whole[r.start : r.start + len(r.text)] == r.text and r.start // 100 == r.chunk for r in mine)


def test_lines_of_routing_documents_do_not_move(spark, sf_dir):
    """Only the replicas are exchanged: no exchange lies above the lines made of them."""
    from fleetspark.plans.registry import QUERIES

    plan = QUERIES["document_texts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    above = plan[: max(at for at, line in enumerate(plan) if "Generate inline" in line)]
    exchanges = [line for line in above if "Exchange" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges)


def test_who_depends_on_a_template(spark):
    references = spark.createDataFrame(
        [(1, "n", "a", "own"), (2, "n", "b", "own"), (3, "m", "a", "n"), (3, "m", "z", "n")], "inst bigint, namespace string, name string, own_namespace string"
    )
    index = normalize.dependencies(references)
    touched = lambda *changes: sorted(r.inst for r in normalize.affected(spark.createDataFrame(list(changes), "kind string, id string"), index).collect())
    assert touched(("template", "n/a")) == [1, 3] and touched(("template", "n/a"), ("template", "own/b")) == [1, 2, 3]
    assert touched(("template", "x/y")) == [] and touched(("installation", "2"), ("installation", "7")) == [2, 7]
    previous = spark.createDataFrame([(1, "old"), (2, "old")], "inst bigint, v string")
    only = spark.createDataFrame([(2,), (3,)], "inst bigint")
    out = normalize.renormalized(previous, only, lambda t: t.withColumn("v", F.lit("new")))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "old"), (2, "new"), (3, "new")]
