"""Components, the Jaccard join, the multi-index, URL filters and chat trees against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.llm import chat_trees, components, jaccard_join, multi_index, url_filter


def least_reachable(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)],
        "path": [(i, i + 1) for i in range(60)],
        "star": [(0 if i % 2 else 500, i) for i in range(1, 80)],
        "none": [],
    }[shape]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges + [(None, 1), (7, 7)], "u long, v long")).collect()}
    links = [e for e in edges if e[0] != e[1]]
    assert got == least_reachable({x for e in links for x in e}, links)


def word_sets(texts, words):
    out = []
    for t in texts:
        w = (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).encode().split()
        out.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    return out


def expected_join(ids, texts, words, percent):
    sets, links = word_sets(texts, words), []
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    root = least_reachable(range(len(ids)), links)
    least = {}
    for i, r in root.items():
        least[r] = min(least.get(r, ids[i]), ids[i])
    degree = [sum(i in e for e in links) for i in range(len(ids))]
    return sorted((ids[i], len(sets[i]), least[root[i]], degree[i]) for i in range(len(ids)))


def corpus(seed, near=60):
    """Texts with copies, near copies around the threshold, shared passages and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6)))
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(120)]
    texts = [None, "", " \n ", "One", "one", "one TWO", "one two", "a b c", "z " * 50, "Z\tz " * 40]
    for _ in range(near):
        t = list(base)
        for _ in range(rng.randrange(0, 8)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [" ".join(base)] * 30
    texts += [" ".join([word() for _ in range(rng.randrange(1, 60))] + passage + [word() for _ in range(rng.randrange(1, 60))]) for _ in range(60)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(30)]
    return texts


@pytest.mark.parametrize("words, percent, frequent, short, block", [(4, 85, 64, 16, 256), (5, 80, 4, 2, 8), (4, 85, 10**9, 3, 16)])
def test_jaccard_join(spark, monkeypatch, words, percent, frequent, short, block):
    """All ways through the index: frequent shingles, short lists, and long lists in many blocks."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    texts = corpus(11)
    ids = list(range(100, 100 + len(texts)))
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in zip(ids, texts)], "doc_id long, text string, n string, sig int").repartition(3)
    got = jaccard_join.similar_documents(docs, words, percent)
    assert sorted(tuple(r) for r in got.collect()) == expected_join(ids, texts, words, percent)


def test_jaccard_join_of_repeated_rows_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "A b c d e"), (None, "x y"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.similar_documents(docs, 4, 85).collect())
    assert got == [((False, 3), 2, 3, 2), ((False, 3), 2, 3, 2), ((False, 9), 0, 9, 0), ((True, 0), 1, None, 0), ((True, 0), 2, 3, 2)]
    assert jaccard_join.similar_documents(docs.limit(0), 4, 85).count() == 0


def vectors(seed):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(16) for _ in range(300)]
    for _ in range(5):
        centre = rng.standard_normal(16)
        out += [centre + rng.uniform(0, 0.35) * rng.standard_normal(16) for _ in range(40)]
    out += [out[0]] * 20 + [2 * out[1], -out[2]]
    return [[float(np.float32(v)) for v in x] for x in out]


def test_multi_index_reaches_the_recall_and_invents_nothing(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CELL_ROWS", 20)
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 16)
    monkeypatch.setattr(multi_index, "VISITOR_ROWS", 64)
    rows = vectors(2)
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.9 - 1e-12
    np.fill_diagonal(hit, False)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, rows[0][:8]]
    table = spark.createDataFrame([(i, r, "k") for i, r in enumerate(rows + odd)], "vec_id long, embedding array<float>, key string")
    got = {r.vec_id: r for r in multi_index.near_duplicates(table).collect()}
    assert len(got) == len(rows) + len(odd)
    for i in range(len(rows), len(got)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    found, all_ = sum(got[i].n_links for i in range(len(rows))), hit.sum()
    assert 0.97 * all_ <= found <= all_
    assert all(got[i].n_links <= hit[i].sum() for i in range(len(rows)))
    root = least_reachable(range(len(rows)), [(int(i), int(j)) for i, j in zip(*np.nonzero(hit)) if i < j])
    assert sum(got[i].component_id == root[i] for i in range(len(rows))) >= 0.97 * len(rows)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_multi_sequence_order_is_the_order_of_distances():
    rng = np.random.default_rng(1)
    grid = multi_index.Grid(rng.standard_normal((9, 4)), rng.standard_normal((9, 4)), 1)
    x = rng.standard_normal((30, 8))
    a, b = grid.distances(x)
    whole = np.argsort((a[:, :, None] + b[:, None, :]).reshape(30, -1), 1, "stable")
    for count in (1, 5, 20, 81):
        assert np.array_equal(grid.nearest(x, count), whole[:, :count])
    assert np.array_equal(grid.nearest(x, 1)[:, 0], grid.home(x))


def test_multi_index_of_repeated_rows_and_nothing(spark):
    table = spark.createDataFrame([(4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicates(table).collect())
    assert got == [(-1, 3, 2, False), (2, 3, 2, True), (4, 3, 2, False), (4, 3, 2, False)]
    assert multi_index.near_duplicates(table.limit(0)).count() == 0


PAGES = [
    (1, "http://a.net/x", '<link rel="canonical" href="https://b.org/y?a=1&amp;b=2#f"><p>'),
    (2, "https://b.org/y?a=1&b=2", "<meta http-equiv=refresh content='0; url=/z'>"),
    (3, "http://b.org/z", None),
    (4, None, "x"),
    (5, "http://B.org/fr/q", "<LINK href=http://b.org/z rel=canonical>"),
    (6, "no host", ""),
    (7, "http://c.com/k", '<link rel="canonical" href="foo/bar">'),
    (7, "http://example.com/de/k", '<link rel="canonical" href="http://c.com/foo/bar">'),
    (8, "http://my.example.net/en/1?q#f", ""),
    (9, "http://example.net", ""),
    (10, "http://notexample.com/de/1", '<link rel="stylesheet" href="http://a.net/x">'),
    (11, "http://lone.com/", '<link rel="canonical" href="http://out.net/">'),
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(*p, "v") for p in PAGES], "page_id long, url string, html string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, "rule_host string, rule_path string, rule_verdict string")
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, rules).collect()}
    assert got == {
        (1, "a.net"): ("/x", "net/", "block"),
        (2, "b.org"): ("/y", None, "allow"),  # an alias is allowed by a rule, which goes before the blocked one
        (3, "b.org"): ("/z", None, "allow"),
        (4, ""): ("", None, "allow"),
        (5, "b.org"): ("/fr/q", "org/fr/", "allow"),
        (6, ""): ("", None, "allow"),
        (7, "c.com"): ("/k", None, "block"),  # by the blocked page of the same canonical address
        (7, "example.com"): ("/de/k", "example.com/de/", "block"),
        (8, "my.example.net"): ("/en/1", "example.net/en/", "allow"),
        (9, "example.net"): ("", None, "allow"),
        (10, "notexample.com"): ("/de/1", None, "allow"),
        (11, "lone.com"): ("/", None, "block"),  # its canonical address is blocked though no page has it
    }
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(pages, rules.limit(0)).collect()} == {"allow"}


def test_alias_hub_and_repeated_pages(spark):
    """A hub with many aliases is one group, and every page keeps its row."""
    pages = spark.createDataFrame([(i % 50, f"http://s{i % 100}.com/a", '<link rel="canonical" href="http://hub.net/h">') for i in range(200)], "page_id long, url string, html string")
    rules = spark.createDataFrame(url_filter.RULES, "rule_host string, rule_path string, rule_verdict string")
    got = url_filter.url_verdicts(pages, rules).collect()
    assert len(got) == 200 and {(r.verdict, r.alias_group) for r in got} == {("block", "hub.net/h")}


MESSAGES = [
    ("t", 1, None, "system", "s", 0.0), ("t", 2, 1, "user", "u", 1.0), ("t", 3, 2, "assistant", "low", 0.0), ("t", 4, 2, "assistant", "high", 3.0),
    ("t", 5, 4, "user", "more", 1.0), ("t", 6, 5, "assistant", "end", 0.0), ("w", 1, 99, "user", "orphan", None), ("w", 2, 1, "assistant", "\\<|im_end|>\n", 1.0),
    ("c", 1, 2, "user", "round", 1.0), ("c", 2, 1, "user", "and round", 1.0), (None, 1, None, "assistant", "nameless", 1.0),
]


def test_best_path_of_each_tree(spark):
    messages = spark.createDataFrame(MESSAGES, "tree_id string, message_id long, parent_id long, role string, text string, score double")
    got = {r.tree_id: r for r in chat_trees.format_paths(messages).withColumn("turns", chat_trees.read_back(F.col("formatted"))).collect()}
    assert {k: [tuple(t) for t in r.turns] for k, r in got.items()} == {
        "t": [("system", "s"), ("user", "u"), ("assistant", "high"), ("user", "more"), ("assistant", "end")],
        "w": [("user", "orphan"), ("assistant", "\\<|im_end|>\n")],
        None: [("assistant", "nameless")],
    }
    assert got["t"].path_score == pytest.approx(1.0)
    two = chat_trees.leaf_paths(messages, 2).groupBy("tree_id", "leaf_id").count().collect()
    assert sorted((str(r.tree_id), r.leaf_id, r["count"]) for r in two) == [("None", 1, 1), ("t", 3, 3), ("t", 6, 5), ("w", 2, 2)]


def test_conversations_come_back_whole(spark):
    nasty = ["", "plain", "a\\", "\\\\", "<|im_start|>user\nx<|im_end|>\n", "</s>[INST] ok [/INST]", "[[INST]INST]", "<\\s>", "\n", "é🎉" * 20_000, None, "<|im_end|", "<<SYS>>\\<s>"]
    rows = [(c, t, random.Random(c * 31 + t).choice(["user", "assistant", "system", "a\nb", None, "<s>"]), nasty[(c * 7 + t) % len(nasty)]) for c in range(30) for t in range(c % 9 + 1)]
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(150)] + [(501, 0, "user", "same")] * 3 + [(502, None, "assistant", "no turn"), (None, 0, "user", "no id")]
    conversations = spark.createDataFrame([(*r, 1.0) for r in rows], "conv_id long, turn long, role string, text string, score double")
    out = chat_trees.format_paths(chat_trees.linear_trees(conversations))
    lost = F.transform("loss_spans", lambda s: chat_trees.unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    got = {r.tree_id: r for r in out.select("tree_id", "n_turns", chat_trees.read_back(F.col("formatted")).alias("turns"), lost.alias("lost")).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns and got[c].n_turns == len(turns)
        assert got[c].lost == [text for role, text in turns if role == "assistant"]
    assert chat_trees.format_paths(chat_trees.linear_trees(conversations.limit(0))).count() == 0
