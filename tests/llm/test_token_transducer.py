"""Token counts by the compiled tokenizer against the tokenizers library."""

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetspark.llm import queries, spans, token_transducer

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "a", "b", "th", "ing", "the", "Hello", "WORLD", "'", "'s", "'S", "'re", "'RE", "'ll", "'ve", "'m", "'d", "'t", "'r", "'v", " ", "  ", "\n", "\r\n", "\t",
    "1", "23", "é", "é", "́", "İ", "ß", "Σ", "ς", "日本", "語", "한", "각", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>",
    "<|", "|>", "<|endoftext|≯", "≮", ".", "...", "!!", "—", "“", " ", "　", "​", "🎉", "👩‍👧", "ﬁ", "Ⅷ", "٣", "\x00", "\x1f", "\x85", "ſ", "K", "\U0001d165",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def compiled():
    return token_transducer.compile_tokenizer(PATH)


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def counted(counter, texts):
    out = []
    for at, to, data, offsets in spans.slices(pa.array(texts)):
        out += counter.tokens(data, offsets).tolist() if len(data) else [0] * (to - at)
    return out


def test_random_texts_and_every_character(compiled, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    texts += [f"{chr(p)}x'{chr(p)}s {chr(p)}" for p in range(0x30000) if not 0xD800 <= p < 0xE000]
    assert counted(token_transducer.Counter(compiled), texts) == expected(library, texts)


def test_words_of_many_letters(compiled, library, monkeypatch):
    """Random letters reach merges that prose does not; states are thrown away in between."""
    monkeypatch.setattr(token_transducer, "MAX_STATES", 2000)
    rng = random.Random(4)
    texts = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 60))) for _ in range(3000)] + ["ab" * 20_000]
    counter = token_transducer.Counter(compiled)
    assert [x for k in range(0, 3001, 300) for x in counted(counter, texts[k : k + 300])] == expected(library, texts)


def test_exactly_one_token_may_follow(compiled):
    """The rule that makes the transducer deterministic."""
    inner, rng = token_transducer.Inner(compiled), random.Random(5)
    for _ in range(300):
        word = [ord(rng.choice("theraingsou")) for _ in range(rng.randint(1, 12))]
        parts = inner.encode((*word, token_transducer.END))
        assert all(inner.may_follow(a, b) for a, b in zip([-1, *parts], parts))
        state = 0
        for symbol in word:
            fits = 0
            for place in inner.states[state]:
                node, before, _ = token_transducer._unpacked(place)
                token = inner.token[inner.child.get(node * token_transducer.SYMBOLS + symbol, 0)]
                fits += token >= 0 and inner.may_follow(before, token)
            assert fits == 1
            state, _ = inner.step(state, symbol)


@pytest.mark.parametrize("chunk", [1, 3, 128])
def test_chunk_maps_do_not_depend_on_the_chunks(monkeypatch, chunk):
    rng = np.random.default_rng(6)
    # endings are followed by the letters they announce
    parts = [[0], [1], [2], [3], [4, 3], [5, 3, 3], [6]]
    kinds = np.array([k for p in rng.integers(0, 7, 4000) for k in parts[p]], np.uint8)
    state, want = token_transducer.FRESH, []
    for kind in kinds:
        want.append(token_transducer.BEGINS[state, kind])
        state = token_transducer.TO[state, kind]
    monkeypatch.setattr(token_transducer, "CHUNK", chunk)
    assert token_transducer.word_starts(kinds).tolist() == want


def test_odd_rows(spark, library, monkeypatch):
    """Null, empty, long and repeated texts, clashing names, and texts cut at blanks."""
    monkeypatch.setattr(token_transducer, "SLICE_BYTES", 1000)
    texts = [None, "", " \n", "a", "a", "y" * 5000, "it's w z " * 3000, "<|endoftext|>" * 200, "x " + "q" * 3000 + " r" * 2000]
    rows = [(i % 4, t, "doc", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string, `a.b` int")
    got = token_transducer.token_counts(docs, PATH).select("doc.*", "n_bytes", token_transducer.F.col("n_tokens").alias("t"), "over_limit").collect()
    assert {r["a.b"]: (r.n_bytes, r.t) for r in got} == {i: (len((t or "").encode()), n) for i, (t, n) in enumerate(zip(texts, expected(library, texts)))}
    assert len(got) == len(rows) and all(r.over_limit == (r.t > 2048) for r in got)
    assert token_transducer.token_counts(docs.limit(0), PATH).count() == 0


def test_whole_table(spark, library, sf_dir):
    got = {r.doc_id: r for r in queries.op12_token_transducer(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == {d.doc_id: (len(d.text.encode()), n) for d, n in zip(docs, expected(library, [d.text for d in docs]))}


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop(0)
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_transducer.compile_tokenizer(str(tmp_path / "t.json"))
