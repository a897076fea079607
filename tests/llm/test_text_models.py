"""Language ID, quality rules, site quality and the flat text helpers on small inputs."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetspark.llm import flat, language_id, quality_rules, site_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ENGLISH = "the of and to in that it is was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
GERMAN = "der die das und ist nicht ein eine zu den mit von für auf sich auch als dem des im werden wurde aus bei nach wird sind oder einer kann noch über haben nur war wie aber durch zum zur schon hat mehr wenn unter dieser vor jahre zwei gegen vom können alle immer seine ihre diese großen müssen schön straße grün hören wörter küche tür fünf zwölf".split()


def said(words, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def base_counts(text):
    words = WORD.findall(text or "")
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


ODD = [None, "", " \n\t ", "a", "a a a a a", "x\nx\n x\nx", "é\u00a0ß\u2003b", "a\x0bb\x0cc\rd\x1ce", "#*$%&|<>", "\n\nq\n\n", "🎉 🎉 🎉 🎉", "y" * 70_000, "w z " * 30_000]


def test_words_and_hashes_of_a_batch():
    texts = ODD + [said(ENGLISH, 300, k) for k in range(20)]
    rows = []
    for a, b, data, offsets in flat.slices(pa.array(texts)):
        starts, ends, row = flat.words(data, offsets)
        hashes = flat.span_hashes(data, starts, ends)
        rows += [(a + r, bytes(data[s:e]).decode(), int(h)) for r, s, e, h in zip(row, starts, ends, hashes)]
    assert [(r, w) for r, w, _ in rows] == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    by_word = collections.defaultdict(set)
    for _, w, h in rows:
        by_word[w].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({min(h) for h in by_word.values()}) == len(by_word)


def test_quality_counts_match_brute_force(spark):
    texts = ODD + ["\n".join(said(ENGLISH, 7, k % 5) for k in range(30)), said(["a", "b"], 400, 1)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] * 2, "doc_id long, text string, kept int")
    model = quality_rules.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_rules.judge(docs, model).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        n, *rest = base_counts(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, *rest]
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert r.kept == (not r.base_failed)  # a model without labels keeps all else


def test_quality_rules_learn_and_are_calibrated(spark):
    good = [(i, said(ENGLISH, 120, i), 1) for i in range(120)]
    bad = [(1000 + i, said([w.upper() + "!!" for w in ENGLISH], 120, i), 0) for i in range(120)]
    rows = good + bad
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_rules.train(docs, labels)
    got = {r.doc_id: r for r in quality_rules.judge(docs, model).collect()}
    assert all(got[i].kept == bool(q) and (got[i].probability > 0.8) == bool(q) for i, _, q in rows)
    again = quality_rules.train(docs, labels)
    assert np.array_equal(model.weights, again.weights) and (model.slope, model.shift) == (again.slope, again.shift)
    empty = quality_rules.judge(docs.limit(0), model)
    assert empty.count() == 0


@pytest.fixture(scope="module")
def language_model(spark):
    rows = [(i, said(ENGLISH if i % 2 else GERMAN, 60, i), "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows + [(None, "x", "fr"), (900, None, "fr"), (901, "y", None)], "doc_id long, text string, lang string")
    return language_id.train(docs, F.lit(True))


def test_language_of_unseen_and_odd_texts(spark, language_model):
    assert language_model.languages == ["de", "en"]
    rows = [(i, said(ENGLISH if i % 2 else GERMAN, 12, 5000 + i), "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "und"), (101, "", "und"), (102, "123 #!? 45", "und"), (103, said(GERMAN, 30_000, 7), "de"), (None, "the water of the people", "en")]
    docs = spark.createDataFrame([(i, t, "zz", 0.5, True) for i, t, _ in rows + odd], "doc_id long, text string, lang string, score double, rejected boolean")
    got = {r.doc.doc_id: r for r in language_id.identify(docs, language_model).collect()}
    assert {i: got[i].lang_pred for i, _, _ in rows + odd} == {i: want for i, _, want in rows + odd}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[100].score == 0
    assert {i for i, r in got.items() if r.rejected} == {100, 101, 102}
    foreign = spark.createDataFrame([(1, "ωψξ φχθ δζλ ξψω θφδ " * 20)], "doc_id long, text string")
    assert language_id.identify(foreign, language_model).first().rejected
    assert language_id.identify(docs.limit(0), language_model).count() == 0


FRENCH = "le la les des et est une que qui dans pour pas sur avec ce il elle nous vous sont mais plus par je son ses cette tout faire comme être avoir même aussi leur bien où sans peut deux très après temps autre entre toujours jour homme femme chose monde vie encore jamais rien".split()
DUTCH = "de het een en van ik te dat die in hij zijn niet op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze want nog zal zij nu ge geen omdat iets worden toch al waren veel meer doen toen moet ben zonder kan hun dus alles onder ja eens hier wie werd altijd doch wordt wezen kunnen ons zelf tegen na reeds wil kon niets uw iemand geweest andere".split()


def test_texts_of_a_language_left_out_are_rejected(spark):
    """Dutch is of the same script and near to two of the learned languages; noise has their letters only."""
    words = {"en": ENGLISH, "de": GERMAN, "fr": FRENCH}
    docs = spark.createDataFrame([(1000 * k + i, said(w, 150, 77 * k + i), lang) for k, (lang, w) in enumerate(words.items()) for i in range(150)] + [(9000, "ναι και το νερό", "el")], "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    assert model.languages == ["de", "el", "en", "fr"]
    noise = random.Random(3)
    new = [(i, said(DUTCH, 150, i), True) for i in range(100)]
    new += [(100 + i, "".join(noise.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(800)), True) for i in range(20)]
    new += [(200 + 1000 * k + i, said(w, 150, 40_000 + 500 * k + i), False) for k, w in enumerate(words.values()) for i in range(300)]
    new += [(5000 + i, said(ENGLISH, 80, i) + " " + said(GERMAN, 75, i), False) for i in range(20)]
    new += [(6000 + i, said(FRENCH, 80, i) + " key=" + "".join(noise.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150)), False) for i in range(20)]
    got = {r.doc.doc_id: r.rejected for r in language_id.identify(spark.createDataFrame(new, "doc_id long, text string, gone boolean"), model).collect()}
    wrong = [i for i, _, gone in new if got[i] != gone]
    assert [i for i in wrong if i < 200 or i >= 5000] == [] and len(wrong) <= 2


def test_a_label_of_one_document_is_learned(spark):
    rows = [(i, said(ENGLISH, 20, i), "en") for i in range(20)] + [(100 + i, said(GERMAN, 20, i), f"l{i}") for i in range(20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(model.languages) == 21


def test_language_probabilities_sum_to_one(language_model):
    """After any context the letters of all languages and one unknown letter share the probability."""
    m = language_model
    alphabet = sorted({c for w in ENGLISH + GERMAN for c in w} | {" "})
    for context in ("th", " d", "qqx", "ü"):
        total = np.zeros(2)
        for c in [*alphabet, "ж"]:
            codes = np.array([32] + [ord(x) for x in context + c], np.uint32)
            log = []
            for k in (len(codes), len(codes) - 1):  # the last letter's share is what it adds
                h, n = m.entropies(codes[:k], np.zeros(k, np.int64), 1)
                log.append(-h[0] * n[0])
            total += np.exp(log[0] - log[1])
        assert total == pytest.approx([1, 1], abs=0.02)


def test_language_without_any_label(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    row = language_id.identify(docs, model).first()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)


def test_site_posteriors_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, f"h{min(i % 7, 3)}" if i % 11 else None, f"/p{i % 5}" if i % 3 else None, None if i % 13 == 0 else min(max(rng.gauss(0.2 + 0.2 * min(i % 7, 3), 0.1), 0.0), 1.0)) for i in range(400)]
    got = {r.doc_id: r for r in site_quality.site_posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")).collect()}
    groups = collections.defaultdict(list)
    for i, h, p, e in rows:
        if e is not None:
            groups[h or "", p or ""].append(e)
    hosts = collections.defaultdict(list)
    for (h, _), es in groups.items():
        hosts[h] += es

    def strength(gs):
        gs = [g for g in gs if g]
        n = sum(map(len, gs))
        mean = sum(map(sum, gs)) / n
        within = sum(sum((x - sum(g) / len(g)) ** 2 for x in g) for g in gs) / (n - len(gs))
        spread = (sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in gs) - (len(gs) - 1) * within) / (n - sum(len(g) ** 2 for g in gs) / n)
        return 1e6 if spread <= 0 else min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)

    everything = [e for es in hosts.values() for e in es]
    mean, kh, kp = sum(everything) / len(everything), strength(list(hosts.values())), strength(list(groups.values()))
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    for i, h, p, e in rows:
        hs, ps = list(hosts[h or ""]), list(groups[h or "", p or ""])
        if e is not None:
            hs.remove(e)
            ps.remove(e)
        host = (sum(hs) + kh * mean) / (len(hs) + kh)
        path = (sum(ps) + kp * host) / (len(ps) + kp)
        want = 1 / (1 + math.exp(-(logit(path) + (0 if e is None else logit(e) - logit(mean)))))
        assert got[i].posterior == pytest.approx(want, rel=1e-6) and got[i].kept == (got[i].posterior >= 0.5)


def test_site_quality_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, host string, path string, evidence double")
    assert site_quality.site_posteriors(empty).count() == 0
    silent = spark.createDataFrame([(1, "h", "p", None), (1, "h", "p", None)], empty.schema)
    assert [r.posterior for r in site_quality.site_posteriors(silent).collect()] == [0.5, 0.5]
    pages = spark.createDataFrame([("http://a.net/en/12.html?x",), ("https://B.org/fr/12/",), ("http://c.com/",), (None,), ("http://d.com/x/99999999999999999999",)], "url string")
    assert [tuple(r) for r in site_quality.page_sites(pages).collect()] == [(12, "a.net", "/en")]
