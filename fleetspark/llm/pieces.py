"""SentencePiece models encoded and decoded by the tokenizers library.

The model file's protobuf is parsed here; from its pieces, scores and settings
the normaliser, the marker for spaces, the merges (BPE models) or scores
(unigram models) and the byte fallback are rebuilt.  No piece has a marker after
another character, so a text is encoded as its words, each a run of markers and
what follows; distinct words are encoded once per batch, many at a time, and
every word's result is compared with the reference library.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.components import share

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Distinct words that a worker keeps encoded; beyond that it starts anew.
KEPT_WORDS = 250_000
#: New words are encoded in lots of this many, as the libraries' results are large.
LOT_WORDS = 10_000
#: Bytes of text worked on at once.
SLICE_BYTES = 2 << 20


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unknown: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unknown_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), self.unknown)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 0x7F) << shift
        shift += 7
        at += 1
        if raw[at - 1] < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields, in order."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(raw, at)
        elif wire == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = struct.unpack("<d" if wire == 1 else "<f", raw[at : at + size])[0], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield tag >> 3, value


def parse_model(raw: bytes) -> Model:
    """The pieces and settings of a SentencePiece model file."""
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind, model.unknown, model.byte_fallback = trainer.get(3, UNIGRAM), trainer.get(40, 0), bool(trainer.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.remove_spaces, model.escape_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    if model.kind not in (UNIGRAM, BPE) or not model.escape_spaces:
        raise ValueError("only unigram and BPE models that escape spaces")
    if any(MARK in text.lstrip(MARK) for text, _, _ in model.pieces):
        raise ValueError("a piece has a marker after another character")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """The merges of a BPE model: the splits of each piece in two pieces, best score first."""
    place = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    out = []
    for text, (i) in place.items():
        score = model.pieces[i][1]
        for cut in range(1, len(text)):
            a, b = text[:cut], text[cut:]
            if a in place and b in place:
                out.append((-score, i, place[a], place[b], a, b))
    out.sort(key=lambda m: m[:4])
    return [(a, b) for *_, a, b in out]


def build_tokenizer(model: Model):
    """A tokenizers.Tokenizer for single words: markers first, no normaliser of its own."""
    from tokenizers import Tokenizer, models

    if model.kind == BPE:
        vocab = {text: i for i, (text, _, _) in enumerate(model.pieces)}
        bpe = models.BPE(vocab, merges(model), unk_token=model.pieces[model.unknown_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
        return Tokenizer(bpe)
    return Tokenizer(models.Unigram([(text, score) for text, score, _ in model.pieces], unk_id=model.unknown_id, byte_fallback=model.byte_fallback))


def build_normalizer(model: Model):
    """The model's character map as a tokenizers normaliser; None if it maps nothing."""
    from tokenizers import normalizers

    return normalizers.Precompiled(model.charsmap) if model.charsmap else None


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


class Coder:
    """Encodes and decodes texts with one model.

    Words are kept under their text without the first marker, or in a tuple
    where they have none.
    """

    def __init__(self, raw: bytes):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.model = parse_model(raw)
        self.tokenizer, self.normalizer = build_tokenizer(self.model), build_normalizer(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.lead = len(self.reference.encode("\n"))
        pieces = self.model.pieces
        self.text = [bytes([int(t[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else t.replace(MARK, " ").encode() for t, _, k in pieces]
        self.text[self.model.unknown_id] = " ⁇ ".encode()
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)  # ids of all words, and where each begins
        self.same, self.right = np.empty(0, bool), np.empty(0, bool)

    def normalized(self, text: str) -> str:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if self.model.remove_spaces:
            text = " ".join(part for part in text.split(" ") if part)
        if text and self.model.dummy_prefix:
            text = " " + text
        return text

    def keys(self, text: str) -> list:
        """A text's words as keys: cut before each run of spaces, spaces as markers."""
        text = self.normalized(text)
        if text.startswith(" ") and "  " not in text and MARK not in text and not text.endswith(" "):
            return text[1:].split(" ")
        parts = text.replace(" ", MARK).split(MARK)
        out, run = [(parts[0],)] if parts[0] else [], ""
        for part in parts[1:]:
            run += MARK
            if part:
                out.append(run[1:] + part)
                run = ""
        return out + ([run[1:]] if run else [])

    def learn(self) -> None:
        """Encodes the new distinct words, and compares them with the reference library.

        There each word stands behind a line feed, which is a word of its own,
        so that neither the added prefix nor the trimming of spaces touches it.
        """
        keys, self.numbers.fresh = self.numbers.fresh, []
        for at in range(0, len(keys), LOT_WORDS):
            self._learn([w[0] if isinstance(w, tuple) else MARK + w for w in keys[at : at + LOT_WORDS]])

    def _learn(self, fresh: list[str]) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
        checked = [ids[self.lead :] for ids in self.reference.encode(["\n" + w for w in fresh], num_threads=2)]
        same = [a == b for a, b in zip(encoded, checked)]
        # the tokenizers library's ids; where the libraries differ the reference decides, and the word is reported
        chosen = [a if ok else b for a, b, ok in zip(encoded, checked, same)]
        self.same = np.concatenate([self.same, np.array(same, bool)])
        self.right = np.concatenate([self.right, np.array([self.decode(ids) == w.replace(MARK, " ") for w, ids in zip(fresh, chosen)], bool)])
        size = np.fromiter(map(len, chosen), np.int64, len(chosen))
        self.flat = np.concatenate([self.flat, np.fromiter((i for ids in chosen for i in ids), np.int32, int(size.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(size)])

    def decode(self, ids) -> str:
        return b"".join([self.text[i] for i in ids]).decode("utf-8", "replace")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, and by text their number, the words on which the libraries differ, and the words that do not decode."""
        if len(self.numbers) > KEPT_WORDS:
            self.forget()
        number = self.numbers.__getitem__
        parts = []
        for text in texts:
            keys = self.keys(text) if text else []
            parts.append(np.fromiter(map(number, keys), np.int64, len(keys)))
        self.learn()
        words = np.concatenate(parts) if parts else np.empty(0, np.int64)
        size = self.starts[words + 1] - self.starts[words]
        before = np.cumsum(size) - size
        ids = self.flat[np.arange(int(size.sum())) + np.repeat(self.starts[words] - before, size)]
        cut = np.cumsum([0, *map(len, parts)])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[cut])
        return ids, total(size), total(~self.same[words]), total(~self.right[words])


class ModelFile:
    """A model file for a broadcast.  A worker's coder is made once and goes with the broadcast.

    Workers live on through later work, which a coder of the module would take
    its memory from.
    """

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def coder(self) -> Coder:
        return Coder(self.raw)

    def __getstate__(self) -> dict:
        return {"raw": self.raw}


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text.as_buffer()) if text.is_valid else 0
        if size >= SLICE_BYTES:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encoded(docs: DataFrame, model_file: str, carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: struct doc of the carried columns, ids, n_tokens, n_differ, round_trip.

    docs needs text.  n_differ counts the words whose encoding by the tokenizers
    library is not the reference library's (the reference's is then taken);
    round_trip tells that decoding the ids gives the normalised text.  Null and
    empty texts have no ids and a true round_trip.  Characters that the model
    does not know become bytes, or the unknown piece without byte fallback.
    model_file is read on the driver and sent to the tasks; its size bounds it.
    """
    with open(model_file, "rb") as f:
        raw = f.read()
    parse_model(raw)
    shared = share(docs.sparkSession, ModelFile(raw))
    carry = docs.columns if carry is None else carry

    def run(batches):
        own = shared.value.coder
        for batch in batches:
            texts = batch.column("text")
            for a, b in _stretches(texts):
                values, size, differ, lost = own.encode(texts.slice(a, b - a).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values))
                yield pa.record_batch(
                    [batch.column("doc").slice(a, b - a), ids, pa.array(size), pa.array(differ), pa.array(lost == 0)],
                    names=["doc", "ids", "n_tokens", "n_differ", "round_trip"],
                )

    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col("text").cast("string").alias("text"))
    kind = nested.schema["doc"].dataType.simpleString()
    return nested.mapInArrow(run, f"doc {kind}, ids array<int>, n_tokens long, n_differ long, round_trip boolean")


def decoded(tokens: DataFrame, model_file: str, ids_column: str = "ids") -> DataFrame:
    """tokens with a column text of the decoded ids, without the added space at the start; null ids give null."""
    with open(model_file, "rb") as f:
        raw = f.read()
    shared = share(tokens.sparkSession, ModelFile(raw))

    def run(batches):
        own = shared.value.coder
        cut = 1 if own.model.dummy_prefix else 0
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                text = None if ids is None else own.decode(ids)
                texts.append(text[cut:] if text and text.startswith(" ") else text)
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    nested = tokens.select(F.struct(*[F.col(f"`{c}`") for c in tokens.columns]).alias("row"), F.col(f"`{ids_column}`").cast("array<int>").alias("ids"))
    out = nested.mapInArrow(run, f"row {nested.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[F.col(f"row.`{c}`") for c in tokens.columns if c != "text"], "text")
