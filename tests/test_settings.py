import random

from pyspark.sql import functions as F

from fleetspark.operators import documents, settings, storage, templates
from fleetspark.plans import admission, config_documents
from fleetspark.sources import files, settings_json

LAYERS = "owner int, layer int, seq bigint, path string, is_scalar boolean, scalar string, vector array<string>"
ROWS = "owner int, path string, is_scalar boolean, scalar string, vector array<string>"


def scalars(spark, *rows):
    return spark.createDataFrame([(o, layer, i, p, True, v, None) for i, (o, layer, p, v) in enumerate(rows)], LAYERS)


def as_rows(spark, owner, values):
    rows = [(owner, p, not isinstance(v, list), None if isinstance(v, list) else v, v if isinstance(v, list) else None) for p, v in values.items()]
    return spark.createDataFrame(rows, ROWS)


def plain(df):
    return {r.path: (r.scalar if r.is_scalar else r.vector) for r in df.collect()}


def test_a_template_setting_beats_the_own_setting(spark):
    layers = scalars(spark, (1, 2, "a", "own"), (1, 0, "a", "first template"), (1, 1, "a", "second"), (1, 2, "b", "own"))
    assert plain(settings.merge_fill(layers)) == {"a": "first template", "b": "own"}


def test_the_last_non_empty_name_wins(spark):
    df = spark.createDataFrame([(1, 0, "t0", 5), (1, 1, "t1", 0), (1, 2, "", 0)], "owner int, layer int, name string, timeout int")
    present = {"name": F.col("name") != "", "timeout": F.col("timeout") > 0}
    assert [tuple(r) for r in settings.merge_override(df, ["owner"], present, ["layer"]).collect()] == [(1, "t1", 5)]


def test_an_unclean_path_overwrites_the_clean_one(spark):
    rows = scalars(spark, (1, 0, "/a//b/", "old unclean"), (1, 0, "a/b/", "new unclean"), (1, 0, "a/b", "clean"))
    assert plain(settings.normalize_paths(rows)) == {"a/b": "new unclean"}


def test_merge_where(spark):
    base = as_rows(spark, 1, {"HOST/a": "base", "x": "base"})
    source = as_rows(spark, 1, {"HOST/a": "source", "x": "source", "HOST/b": "source"})
    got = settings.merge_where(base, source, F.col("path").startswith("HOST/"))
    assert plain(got) == {"HOST/a": "source", "HOST/b": "source", "x": "base"}


def test_user_defaults(spark):
    users = as_rows(spark, 1, {
        "test/password": "qwerty", "test/networks/ip": ["127.0.0.1/32", "192.168.74.1/24"], "test/profile": "test_profile",
        "test/quota": "test_quota", "bare/profile": "p", "default/password": "", "single": "x",
    })
    owners = spark.createDataFrame([(1, "re"), (2, "re2")], "owner int, host_regexp string")
    done = settings.user_defaults(users, owners)
    import hashlib

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert plain(done.filter("owner = 1")) == {
        "single": "x",
        "test/profile": "test_profile",
        "test/quota": "test_quota",
        "test/networks/ip": ["127.0.0.1/32", "192.168.74.1/24"],
        "test/networks/host_regexp": "re",
        "test/password_sha256_hex": digest("qwerty"),
        "bare/profile": "p",
        "bare/quota": "default",
        "bare/networks/ip": ["::/0"],
        "bare/networks/host_regexp": "re",
        "bare/password_sha256_hex": digest("default"),
        "default/password": "",
        "default/profile": "default",
        "default/quota": "default",
        "default/networks/ip": ["::/0"],
        "default/networks/host_regexp": "re",
    }
    assert set(plain(done.filter("owner = 2"))) == {"default/profile", "default/quota", "default/networks/ip", "default/networks/host_regexp"}
    removed = settings.user_defaults(as_rows(spark, 1, {"default/password": "x"}), owners)
    assert plain(removed.filter("owner = 1"))["default/password"] == "_removed_"


def text_of(df):
    return "\n".join(r.line for r in df.orderBy("pos").collect())


def test_document(spark):
    rows = as_rows(spark, 1, {
        "test/networks/ip": ["a", "b"], "test/password": "_removed_", "test-2/x": "1", "test": "hides all below",
        "top": "<raw>", "deep/er/a": "1", "deep-x/y": "2", "deep/er-b": "3", "deep/z": "4",
    })
    shown = rows.filter("path <> 'test'")
    assert text_of(documents.render_document(shown, ["owner"], root="r")) == "\n".join(
        [
            "<r>",
            "    <deep-x>", "        <y>2</y>", "    </deep-x>",
            "    <deep>", "        <er-b>3</er-b>", "        <er>", "            <a>1</a>", "        </er>", "        <z>4</z>", "    </deep>",
            "    <test-2>", "        <x>1</x>", "    </test-2>",
            "    <test>", "        <networks>", "            <ip>a</ip>", "            <ip>b</ip>", "        </networks>",
            '        <password remove="1"></password>', "    </test>",
            "    <top><raw></top>",
            "</r>",
        ]
    )
    hidden = text_of(documents.render_document(rows, ["owner"], root="r"))
    assert "    <test>hides all below</test>\n    <test-2>" in hidden and "networks" not in hidden


def test_document_against_a_tree(spark):
    """Random paths against a plain tree that keeps children in order of first appearance."""
    rng = random.Random(5)
    part = lambda: rng.choice(["a", "a-b", "a.b", "ab", "b", "a-", "Z"])
    data = {"/".join(part() for _ in range(rng.randint(1, 4))): str(i) for i in range(60)}

    def write(node, depth, out):
        for tag, child in node["children"].items():
            if child["value"] is not None:
                out.append(" " * 4 * depth + f"<{tag}>{child['value']}</{tag}>")
            else:
                out.append(" " * 4 * depth + f"<{tag}>")
                write(child, depth + 1, out)
                out.append(" " * 4 * depth + f"</{tag}>")

    tree = {"children": {}, "value": None}
    for path in sorted(data):
        node = tree
        for tag in path.split("/"):
            node = node["children"].setdefault(tag, {"children": {}, "value": None})
        node["value"] = data[path]
    lines = ["<r>"]
    write(tree, 1, lines)
    lines.append("</r>")
    assert text_of(documents.render_document(as_rows(spark, 1, data), ["owner"], root="r")) == "\n".join(lines)


def test_file_counts_of_a_configured_installation(spark):
    """Eight common files and five users files, as extra files come to four and two."""
    from fleetspark.operators import layout

    fleet = spark.createDataFrame(
        [(1, 1, "i1", "cluster", 2, 2)],
        "inst int, cluster bigint, installation_name string, cluster_name string, shards_raw int, replicas_raw int",
    )
    replicas = layout.allocate_replicas(fleet, spark.createDataFrame([], "cluster bigint, slot string"))
    own_files = as_rows(spark, 1, {"COMMON/dict1.xml": "d", "COMMON/source1.csv": "s", "HOST/users_prefixed_1.file": "h"})
    host = replicas.select("replica_name").join(own_files.drop("owner").withColumn("kind", F.lit("files")))
    extra = spark.createDataFrame([(f"0{i}.xml", "c") for i in range(4)], "file string, content string")
    nodes = spark.createDataFrame([(1, 0, "zk01.svc.cluster.local", 2180)], "owner bigint, ord int, host string, port int")
    options = spark.createDataFrame([], "owner bigint, session_timeout_ms int, operation_timeout_ms int, root string, identity string")
    done = config_documents.config_files(
        coordination=documents.coordination_document(nodes, options).withColumnRenamed("owner", "cluster"),
        common_settings=as_rows(spark, 1, {"compression/case/method": "zstd", "disable_internal_dns_cache": "1"}),
        files=own_files,
        users=as_rows(spark, 1, {"test/password": "qwerty"}),
        quotas=as_rows(spark, 1, {"test_quota/interval/duration": "3600"}),
        profiles=as_rows(spark, 1, {"readonly/readonly": "1"}),
        routing=layout.routing_topology(replicas),
        replicas=replicas,
        replica_settings=host,
        extra={"common": extra, "users": extra.filter("file < '02'"), "host": extra.filter("file < '00'")},
    )
    found = {(r.scope, r.owner): r.n for r in done.groupBy("scope", "owner").agg(F.count_distinct("file").alias("n")).collect()}
    assert found.pop(("common", "1")) + found.pop(("common", "*")) == 8
    assert found.pop(("users", "1")) + found.pop(("users", "*")) == 5
    # macros, coordination and the own HOST file
    assert found == {("host", f"i1-cluster-{s}-{o}"): 3 for s in (0, 1) for o in (0, 1)}
    zookeeper = text_of(done.filter("owner = 'i1-cluster-0-1' AND file = 'generated-zookeeper.xml'"))
    assert zookeeper.split("\n") == [
        "<yandex>", "    <zookeeper>", "        <node>", "            <host>zk01.svc.cluster.local</host>",
        "            <port>2180</port>", "        </node>", "    </zookeeper>", "</yandex>",
    ]
    written = done.filter("owner = 'i1-cluster-1-0' AND file = 'generated-macros.xml'")
    assert text_of(written).split("\n")[2:7] == [
        "        <installation>1</installation>",
        "        <all-sharded-shard>0</all-sharded-shard>",
        "        <cluster>1</cluster>",
        "        <shard>1</shard>",
        "        <replica>i1-cluster-1-0</replica>",
    ]


def test_own_files_replace_generated_ones(spark):
    lines = spark.createDataFrame([(1, "0", "a"), (1, "1", "b"), (2, "0", "a")], "owner int, pos string, line string")
    own = spark.createDataFrame([(1, "g", "own")], "owner int, file string, content string")
    parts = [documents.generated_file(lines, lines, "owner", "g"), documents.whole_files(own, "owner")]
    got = sorted((r.owner, r.line) for r in documents.assemble_files(parts, "owner").collect())
    assert got == [(1, "own"), (2, "a")]


def test_only_files_that_can_share_a_name_are_compared(spark):
    """Contributions of other names are not asked for their files; of three that claim a name the last has it."""
    lines = spark.createDataFrame([(1, "0", "a"), (2, "0", "b"), (None, "0", "n")], "owner int, pos string, line string")
    broken = lines.select("owner", F.raise_error(F.lit("not to be read")).cast("string").alias("file"))
    named = lambda name, files=None: documents.Contribution(lines.withColumn("file", F.lit(name)), files or lines.select("owner", F.lit(name).alias("file")), frozenset([name]))
    own = spark.createDataFrame([(1, "g", "own"), (2, "other", "own"), (None, "g", "own")], "owner int, file string, content string")
    last = spark.createDataFrame([(1, "g", "last"), (2, "h", "last")], "owner int, file string, content string")
    got = documents.assemble_files([named("g", broken), named("h", broken)], "owner").collect()
    assert len(got) == 6
    got = documents.assemble_files([named("g", broken), named("h", broken), documents.whole_files(own, "owner"), documents.whole_files(last, "owner")], "owner").collect()
    want = [(1, "g", "last"), (2, "g", "b"), (None, "g", "n"), (None, "g", "own"), (1, "h", "a"), (2, "h", "last"), (None, "h", "n"), (2, "other", "own")]
    assert sorted(((r.owner, r.file, r.line) for r in got), key=str) == sorted(want, key=str)


def test_written_documents_come_back_in_order(spark, tmp_path):
    rows = as_rows(spark, 1, {f"a/k{i:03d}": str(i) for i in range(200)})
    documents.write_documents(documents.render_document(rows, ["owner"]), ["owner"], str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 204


def test_ingest(spark):
    doc = '{"a": 1, "b": 1.5, "c": -1.5, "d": true, "e": null, "f": {"x": 1}, "g": [], "h": ["p", 2, null, [1]], "i": [null], "j": "", "k": 12345678901}'
    rows = settings_json.ingest_settings(spark.createDataFrame([(1, doc), (2, "{}")], "owner int, s string"), "s")
    assert plain(rows) == {"a": "1", "b": "1.500000", "c": "-1", "d": "true", "h": ["p", "2"], "j": "", "k": "12345678901"}


def test_scan_files(spark, tmp_path):
    for name, content in {"a.xml": "<a/>", "B.XML": "b\nc", "c.xml.example": "x", "d.xml": "", "readme": "r", "e.yaml": "e"}.items():
        (tmp_path / name).write_text(content)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.xml").write_text("no")
    got = {r.file: r.content for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.xml": "<a/>", "B.XML": "b\nc"}
    assert [r.file for r in files.scan_files(spark, str(tmp_path), files.TEMPLATE_EXTENSIONS).collect()] == ["e.yaml"]
    assert files.scan_files(spark, str(tmp_path / "missing")).count() == 0


def test_fingerprint_ignores_order_and_sees_changes(spark):
    digest = lambda values: settings.fingerprint(as_rows(spark, 1, values)).first().fingerprint
    assert digest({"a": "1", "b": ["x", "y"]}) == digest({"b": ["x", "y"], "a": "1"})
    assert digest({"a": "1"}) != digest({"a": "2"}) != digest({"a2": ""})


TEMPLATES = "ord int, namespace string, name string, size int, retired boolean"


def test_templates(spark):
    registry = spark.createDataFrame(
        [(1, "default", "tp1", 5, False), (2, "default", "tp1", 6, False), (0, "default", "tp1", 9, True), (3, "default", "tp2", 7, False)], TEMPLATES
    )
    fetched = templates.registered(spark.createDataFrame([(4, "own", "tp3", 8, False)], TEMPLATES))
    refs = spark.createDataFrame(
        [(1, i, "own", "default", n) for i, n in enumerate(["tp2", "tp1", "unknown", "tp3"])],
        "inst int, ord int, own_namespace string, namespace string, name string",
    )
    got = templates.resolve_templates(refs, templates.registered(registry), fetched).orderBy("ord").collect()
    assert [(r.name, r.template_size, r.source) for r in got] == [("tp2", 7, "registry"), ("tp1", 5, "registry"), ("tp3", 8, "own namespace")]


def test_references_are_appended_with_duplicates(spark):
    refs = spark.createDataFrame([(1, "a"), (1, "b")], "inst int, name string")
    got = templates.append_references(refs, refs.filter("name = 'a'"))
    assert [(r.layer, r.name) for r in got.orderBy("layer", "name").collect()] == [(0, "a"), (0, "b"), (1, "a")]


def test_merged_templates_of_two_lists(spark):
    names = lambda kind, n, at: [(1, at + i, f"{kind}{at + i}", "c") for i in range(n)]
    for kind, n, total in (("pod", 2, 4), ("claim", 4, 8)):
        df = spark.createDataFrame(names(kind, n, 0) + names(kind, n, n) + [(1, 99, f"{kind}0", "")], "owner int, ord int, name string, image string")
        got = templates.merge_templates(df, {"image": F.col("image") != ""})
        assert got.count() == total and got.filter(f"name = '{kind}0'").first().image == "c"


def test_nodes_are_inherited_by_clusters_without_any(spark):
    node = "ord int, host string, port int"
    clusters = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "inst int, cluster int")
    own = spark.createDataFrame([(10, 0, "own", 1)], "cluster int, " + node)
    inst = spark.createDataFrame([(1, 0, "zk", None), (1, 1, "zk", 2180), (1, 2, "zk", None)], "inst int, " + node)
    got = sorted((r.cluster, r.host, r.port) for r in templates.inherit_nodes(clusters, own, inst).collect())
    assert got == [(10, "own", 1), (11, "zk", 2180), (11, "zk", 2181)]


def test_nodes(spark):
    df = spark.createDataFrame([(1, 0, "h", None), (1, 1, "h", 2181), (1, 2, "h", 0), (1, 3, "g", 2180)], "owner int, ord int, host string, port int")
    got = [(r.ord, r.host, r.port) for r in templates.merge_nodes(df).orderBy("ord").collect()]
    assert got == [(0, "h", 2181), (1, "h", 2181), (3, "g", 2180)]


CLAIMS = "object int, claim string, class string, size string"
CLASSES = "class string, allow_expansion boolean, is_default boolean"


def verdicts(spark, old, new, classes, **options):
    rows = lambda sizes: spark.createDataFrame([(1, c, "sc", s) for c, s in sizes.items()], CLAIMS)
    done = storage.claim_validation(rows(old), rows(new), spark.createDataFrame(classes, CLASSES), **options)
    return {r.claim: r.verdict for r in done.collect()}


def test_claims(spark):
    allowed, forbidden = [("sc", True, False)], [("sc", False, False)]
    old = {"a": "1Gi", "b": "3Gi", "c": "1Gi", "d": "0"}
    new = {"a": "3Gi", "b": "1Gi", "c": "1024Mi", "d": "1Gi", "e": "1Gi"}
    expected = {"a": "grow", "b": "decrease", "c": "accepted", "d": "accepted", "e": "new claim"}
    assert verdicts(spark, old, new, allowed) == expected
    assert verdicts(spark, old, new, forbidden)["a"] == "class forbids expansion"
    assert verdicts(spark, old, new, [("other", True, False)])["a"] == "no storage class"
    assert verdicts(spark, old, new, forbidden, check_class=False) == expected


def test_default_class(spark):
    row = spark.createDataFrame([(1, "a", "", "2Gi")], CLAIMS)
    old = spark.createDataFrame([(1, "a", None, "1Gi")], CLAIMS)
    for classes, verdict in (
        ([("z", False, True), ("b", True, True)], "grow"),
        ([("z", False, True), ("b", True, False)], "class forbids expansion"),
        ([("b", True, False)], "no storage class"),
    ):
        done = storage.claim_validation(old, row, spark.createDataFrame(classes, CLASSES))
        assert [r.verdict for r in done.collect()] == [verdict]


def resized(spark, existing):
    claim = lambda size: spark.createDataFrame([(1, "c", "sc", size)], CLAIMS)
    volumes = spark.createDataFrame([(1, f"c-1-{i}", s) for i, s in existing.items()], "object int, volume string, size string")
    classes = spark.createDataFrame([("sc", True, False)], "class string, allow_expansion boolean, is_default boolean")
    plan = storage.volume_resize_plan(claim("1Gi"), claim("3Gi"), volumes, F.lit(3), classes)
    return sorted((r.volume, r.old_size, r.new_size, r.recreate) for r in plan.collect())


def test_resize(spark):
    assert resized(spark, {0: "1Gi", 1: "1Gi", 2: "1Gi"}) == [(f"c-1-{i}", "1Gi", "3Gi", True) for i in range(3)]
    assert resized(spark, {0: "3Gi", 1: "1Gi", 2: "1Gi"}) == [(f"c-1-{i}", "1Gi", "3Gi", True) for i in (1, 2)]
    assert resized(spark, {0: "1Gi", 2: "1Gi", 5: "1Gi"}) == [(f"c-1-{i}", "1Gi", "3Gi", True) for i in (0, 2)]


def test_mounts(spark):
    mounts = spark.createDataFrame([(1, "data", "/elsewhere"), (1, "tmp", "/log"), (2, "extra", "/x")], "set int, mount string, path string")
    sets = spark.createDataFrame([(1, "data", "log"), (2, "data", "log"), (3, "unknown", ""), (4, "data", "data")], "set int, data_claim string, log_claim string")
    done = storage.resolve_mounts(mounts, sets, ["data", "log", "extra"], "/data", "/log")
    assert sorted((r["set"], r["item"], r["name"], r["path"]) for r in done.collect()) == [
        (1, "claim", "data", ""), (1, "container", "log", ""),
        (2, "claim", "data", ""), (2, "claim", "extra", ""), (2, "claim", "log", ""), (2, "container", "log", ""),
        (2, "mount", "data", "/data"), (2, "mount", "log", "/log"),
        (4, "claim", "data", ""), (4, "container", "log", ""), (4, "mount", "data", "/data"),
    ]


def test_storage_floor(spark):
    insts = spark.createDataFrame([(i, "data", "log") for i in range(5)], "inst int, data_claim string, log_claim string")
    sizes = {0: ("1Gi", "100Mi"), 1: ("1Gi", "64Mi"), 2: ("500Mi", "100Mi"), 3: ("1Gi", "100M")}
    claims = spark.createDataFrame(
        [(i, c, s, 0) for i, pair in sizes.items() for c, s in zip(("data", "log"), pair)] + [(1, "log", "9Gi", 1)],
        "inst int, claim string, size string, ord int",
    )
    none = spark.createDataFrame([], "inst int, cluster int, shards int, replicas int")
    done = {r.inst: (r.accepted, r.errors) for r in admission.admission_report(insts, none, none, claims, claims, strict=True).collect()}
    assert done == {
        0: (True, ""),
        1: (False, "log volume is below 100Mi"),
        2: (False, "data volume is below 1Gi"),
        3: (False, "log volume is below 100Mi"),
        4: (True, ""),
    }


def test_scale_in_and_shrinking_claims(spark):
    layout = "inst int, cluster int, shards int, replicas int"
    old = spark.createDataFrame([(1, 1, 2, 2), (2, 1, 2, 2), (3, 1, 1, 1), (3, 2, 1, 1), (4, 1, 2, 2)], layout)
    new = spark.createDataFrame([(1, 1, 2, 1), (2, 1, 3, 2), (3, 1, 1, 1), (4, 1, 1, 1)], layout)
    claim = lambda size: spark.createDataFrame([(i, "c", size, 0) for i in (1, 2, 3)], "inst int, claim string, size string, ord int")
    insts = spark.createDataFrame([(i, "", "") for i in (1, 2, 3, 4)], "inst int, data_claim string, log_claim string")
    report = lambda strict: {r.inst: r.errors for r in admission.admission_report(insts, old, new, claim("2Gi"), claim("1Gi"), strict).collect()}
    assert report(False) == {1: "shards or replicas are removed", 2: "", 3: "clusters are removed", 4: ""}
    assert report(True)[2] == "a claim becomes smaller"
