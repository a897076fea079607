"""Phrases from automata against plain counting."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fleetspark.llm import phrase_automata as automata

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                f.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return f, n


def plain_collocations(rows, least, top):
    f, n = plain_counts(rows)
    candidates = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = []
    for (lang, words), a in candidates.items():
        inside = lambda other: any(other[i : i + len(words)] == words for i in range(len(other) - len(words) + 1))
        if any(lang == g and len(w) > len(words) and inside(w) and 100 * b >= 80 * a for (g, w), b in candidates.items()):
            continue
        score, k, l, r = min((2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        out.append((lang, " ".join(words), a, l, r, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "a", "É", "日本", "x\x00y", "q r", "'s", "the"]
    fixed = ["new york city of", "a a a a a a", "the of a", "É 日本"]
    glue = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", "\x0b"]
    out = [("en", None), (None, ""), (None, " . , "), ("zz", "of"), ("en", "the of " * 2000), (None, "A b. " * 50)]
    for _ in range(n):
        parts = [rng.choice(words if rng.random() < 0.6 else fixed) + rng.choice(glue) for _ in range(rng.randint(0, 40))]
        out.append((rng.choice(["en", "de", None, "und", "la\nng"]), "".join(parts)))
    return out


@pytest.mark.parametrize(("range_words", "slice_bytes", "paths"), [(1 << 20, 1 << 21, 512), (500, 700, 512), (40, 100, 3)])
def test_against_plain_counting(spark, monkeypatch, range_words, slice_bytes, paths):
    """Also with so small slices and ranges that most prefixes go over borders."""
    monkeypatch.setattr(automata, "RANGE_WORDS", range_words)
    monkeypatch.setattr(automata, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(automata, "BORDER_PATHS", paths)
    rows = texts(1, 120) + texts(1, 40)
    docs = spark.createDataFrame([(lang, text, "p", 1) for lang, text in rows], "lang string, text string, phrase string, n int").repartition(3)
    got = sorted(tuple(r) for r in automata.collocations(docs, least=5, top=40).collect())
    assert got == plain_collocations(rows, 5, 40) and len(got) > 50


def test_counts_of_prefixes(spark, monkeypatch):
    monkeypatch.setattr(automata, "RANGE_WORDS", 300)
    rows = texts(2, 100)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    f, n = plain_counts(rows)
    got = {(r.lang, r.phrase): r.f for r in automata.phrase_counts(docs, 3).collect()}
    want = {(lang, " ".join(words)): v for (lang, words), v in f.items() if v >= 3} | {(lang, ""): v for lang, v in n.items() if v}
    assert got == want


def test_shards_give_their_paths_back():
    names = pa.array([b"de", b"en"], pa.large_binary())
    rows = [t for _, t in texts(3, 30)]
    data = "\0".join(t or "" for t in rows).encode()
    sizes = np.cumsum([0] + [len((t or "").encode()) + 1 for t in rows])
    sizes[-1] -= 1
    paths = automata.slice_paths(np.frombuffer(data, np.uint8), sizes, np.arange(len(rows)) % 2, names)

    def plain(p):
        words = [None, *p.words.to_pylist()]
        keys = zip(p.langs.take(pa.array(p.columns[0])).to_pylist(), *([words[w] for w in c] for c in p.columns[1:]), strict=True)
        total = collections.Counter()
        for key, weight in zip(keys, p.weights, strict=True):
            total[key] += int(weight)
        return total

    borders = np.sort(paths.places())[:: max(1, len(paths.weights) // 7)]
    shards = list(automata._shards(paths, borders))
    assert len(shards) > 3 and plain(automata.united([automata._paths(s) for s in shards])) == plain(paths)


def test_empty_table(spark):
    assert automata.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert automata.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).count() == 0
