"""Collocations from weighted acyclic automata of all phrases of up to four words.

Every word of a text begins a path: its language, then up to four words of its
piece.  A slice of text is a shard.  Its paths are sorted, and the automaton is
built from them path by path: a path adds only the transitions in which it
differs from the one before, and a weight, the number of its occurrences.

The automata are cut by ranges of the paths' order and united by range: the
paths of all shards in a range are merged, their weights added.  The count of a
phrase is the weight below its prefix.  A range hands on the prefixes that are
frequent, and those that go on in other ranges, whose parts are added.  So a
frequent word or phrase is cut over ranges like any other.

The paths of the united automaton that are frequent form a table; looking up
the parts of phrases is its composition with the automaton of the cuts, done as
a join on (language, phrase), since both are given by their paths.

The order of paths is that of 63 bits made of the hashes of their words, the
first word in the highest bits.  It serves only to cut and deal; equal bits of
different paths are told apart by their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm import flat, spans
from fleetspark.session import materialize

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
NO_LANG = "und"
#: Word occurrences that a range is to hold.
RANGE_WORDS = 1 << 19
SLICE_BYTES = 1 << 20
#: Rows and paths a slice that the borders of ranges are taken from; they change no result.
BORDER_ROWS, BORDER_PATHS = 4000, 512
#: Bits of the order of paths by word.
BITS = (24, 15, 12, 12)

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False

_SHARD = "range int, langs binary, words binary, shapes binary, labels binary, weights binary"
_NODES = "lang string, phrase string, n_words int, f long"


class Paths:
    """Paths (language, words...) with weights; languages and words are numbers, word 0 ends a path."""

    def __init__(self, langs: pa.Array, words: pa.Array, columns: list[np.ndarray], weights: np.ndarray):
        self.langs, self.words, self.columns, self.weights = langs, words, columns, weights

    @cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """By number: of the languages and of the words, the end being 0."""
        return flat.mix(_hashes(self.langs) + np.uint64(1)), np.concatenate([np.zeros(1, np.uint64), _hashes(self.words)])

    def places(self, rows: np.ndarray | slice = slice(None), depth: int = DEPTH, last: bool = False) -> np.ndarray:
        """Where the paths' prefixes of depth words begin, or end, in the order that ranges are cut from."""
        salts, hashes = self.hashes
        columns = [c[rows] for c in self.columns]
        place = np.zeros(len(columns[0]), np.uint64)
        for at, bits in enumerate(BITS):
            if at < depth:
                part = hashes[columns[at + 1]]
                if at == 0:
                    part = flat.mix(part ^ salts[columns[0]])
                part = np.where(columns[at + 1] == 0, np.uint64(0), part >> np.uint64(64 - bits))
            else:
                part = np.uint64((1 << bits) - 1 if last else 0)
            place = place << np.uint64(bits) | part
        return place.astype(np.int64)

    def merged(self, order: np.ndarray) -> Paths:
        """Neighbours of the given order that are equal become one path; their weights are added."""
        columns = [c[order] for c in self.columns]
        first = np.flatnonzero(_shared(columns) < DEPTH + 1)
        weights = np.add.reduceat(self.weights[order], first) if len(first) else self.weights[:0]
        return Paths(self.langs, self.words, [c[first] for c in columns], weights)

    def alphabetic(self) -> np.ndarray:
        """An order in which equal prefixes are neighbours."""
        bits = len(self.words).bit_length()
        if DEPTH * bits + len(self.langs).bit_length() > 63:
            return np.lexsort(self.columns[::-1])
        key = self.columns[0]
        for column in self.columns[1:]:
            key = key << bits | column
        return np.argsort(key, kind="stable")


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each binary value, empty ones included."""
    data, offsets = spans.joined(words)
    out = np.zeros(len(words), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    out[some] = flat.span_hashes(data, offsets[:-1][some], offsets[1:][some])
    return out


def _shared(columns: list[np.ndarray]) -> np.ndarray:
    """How many leading labels each path shares with the one before."""
    out = np.zeros(len(columns[0]), np.int64)
    same = np.ones(max(len(out) - 1, 0), bool)
    for column in columns:
        same &= column[1:] == column[:-1]
        out[1:] += same
    return out


def slice_paths(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, names: pa.Array) -> Paths:
    """The path that begins at each word of a slice; langs are the rows' places in names."""
    inside = WORD[data]
    starts, ends = spans.runs(inside, offsets)
    codes, words = spans.encoded(flat.LOWER[data][inside], ends - starts)
    rows = np.searchsorted(offsets, starts, "right") - 1
    pieces = np.cumsum(BREAK[data])[starts] + rows if len(starts) else rows
    columns = [langs[rows], codes + 1]
    for k in range(1, DEPTH):
        after = np.zeros(len(codes), np.int64)
        if len(codes) > k:
            after[:-k] = np.where(pieces[k:] == pieces[:-k], codes[k:] + 1, 0)
        columns.append(after)
    return Paths(names, words, columns, np.ones(len(codes), np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[Paths]:
    coded = batch.column("lang").cast(pa.large_string()).cast(pa.large_binary()).dictionary_encode()
    langs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for at, to, data, offsets in spans.slices(batch.column("text"), SLICE_BYTES):
        yield slice_paths(data, offsets, langs[at:to], coded.dictionary)


def _shards(paths: Paths, borders: np.ndarray) -> Iterator[dict]:
    """The slice's automaton, cut by ranges: shapes, labels of new transitions and weights of the paths."""
    paths = paths.merged(np.argsort(paths.places(), kind="stable"))
    dealt = np.searchsorted(borders, paths.places(), "right")
    cuts = np.concatenate([np.flatnonzero(np.diff(dealt, prepend=-1)), [len(dealt)]])
    for a, b in zip(cuts, cuts[1:]):
        columns = [c[a:b] for c in paths.columns]
        shared = _shared(columns)
        length = 1 + sum((c != 0).astype(np.int64) for c in columns[1:])
        langs, columns[0] = np.unique(columns[0], return_inverse=True)
        used, numbers = np.unique(np.concatenate([np.zeros(1, np.int64), *columns[1:]]), return_inverse=True)
        columns[1:] = np.split(numbers[1:], DEPTH)
        depth, weights = np.arange(DEPTH + 1), paths.weights[a:b]
        new = (depth >= shared[:, None]) & (depth < length[:, None])
        labels = np.stack(columns, axis=1)[new]
        yield {
            "range": int(dealt[a]),
            "langs": _blob(paths.langs.take(pa.array(langs))),
            "words": _blob(paths.words.take(pa.array(used[1:] - 1))),
            "shapes": (shared << 4 | length).astype(np.uint8).tobytes(),
            "labels": labels.astype("<u2" if len(used) + len(langs) < 1 << 16 else "<u4").tobytes(),
            "weights": weights.astype("<u4" if weights.max() < 1 << 32 else "<u8").tobytes(),
        }


def _paths(shard: dict) -> Paths:
    """The paths of a shard again, in their order."""
    shapes = np.frombuffer(shard["shapes"], np.uint8).astype(np.int64)
    shared, length = shapes >> 4, shapes & 15
    depth = np.arange(DEPTH + 1)
    new = (depth >= shared[:, None]) & (depth < length[:, None])
    grid = np.zeros(new.shape, np.int64)
    grid[new] = np.frombuffer(shard["labels"], f"<u{len(shard['labels']) // int(new.sum())}")
    rows = np.arange(len(shapes))
    columns = [grid[np.maximum.accumulate(np.where(shared <= d, rows, 0)), d] for d in depth]
    weights = np.frombuffer(shard["weights"], f"<u{len(shard['weights']) // len(shapes)}").astype(np.int64)
    return Paths(_unblob(shard["langs"]), _unblob(shard["words"]), columns, weights)


def _blob(values: pa.Array) -> bytes:
    """Number of values, their sizes and their bytes."""
    data, offsets = spans.joined(values)
    return np.concatenate([[len(values)], np.diff(offsets)]).astype("<u4").tobytes() + data.tobytes()


def _unblob(raw: bytes) -> pa.Array:
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", count, 4), dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(raw[4 * count + 4 :])])


def united(shards: list[Paths]) -> Paths:
    """The union of automata, weights of equal paths added."""
    langs = pa.concat_arrays([s.langs for s in shards]).dictionary_encode()
    words = pa.concat_arrays([s.words for s in shards]).dictionary_encode()
    new_lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    new_word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    columns: list[list[np.ndarray]] = [[] for _ in range(DEPTH + 1)]
    lang_at = word_at = 0
    for shard in shards:
        own = np.concatenate([[0], new_word[word_at : word_at + len(shard.words)]])
        columns[0].append(new_lang[lang_at + shard.columns[0]])
        for at in range(1, DEPTH + 1):
            columns[at].append(own[shard.columns[at]])
        lang_at, word_at = lang_at + len(shard.langs), word_at + len(shard.words)
    whole = Paths(langs.dictionary, words.dictionary, [np.concatenate(c) for c in columns], np.concatenate([s.weights for s in shards]))
    return whole.merged(whole.alphabetic())


def prefix_counts(paths: Paths, borders: np.ndarray, least: int) -> pa.Table:
    """Prefixes with at least that weight, and those that also lie in other ranges with the weight they have here."""
    shared, out = _shared(paths.columns), []
    for depth in range(DEPTH + 1):
        first = np.flatnonzero(shared <= depth)
        f = np.add.reduceat(paths.weights, first)
        parted = np.searchsorted(borders, paths.places(first, depth), "right") != np.searchsorted(borders, paths.places(first, depth, True), "right")
        keep = (f >= least) | parted | (depth == 0)
        if depth:
            keep &= paths.columns[depth][first] != 0
        rows, f = first[keep], f[keep]
        parts = [paths.words.take(pa.array(paths.columns[at][rows] - 1)) for at in range(1, depth + 1)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if parts else pa.array([b""] * len(rows), pa.large_binary())
        lang = paths.langs.take(pa.array(paths.columns[0][rows]))
        text = lambda a: a.cast(pa.large_string()).cast(pa.string())
        out.append(pa.table([text(lang), text(phrase), pa.array(np.full(len(rows), depth, np.int32)), pa.array(f)], ["lang", "phrase", "n_words", "f"]))
    return pa.concat_tables(out)


def range_borders(texts: DataFrame) -> np.ndarray:
    """Where to cut the order of paths so that ranges hold about RANGE_WORDS each.

    Taken from about BORDER_ROWS rows and at most BORDER_PATHS places of each
    slice.  Borders decide which task counts a path, not what is counted.
    """
    rows = texts.count()
    if not rows:
        return np.empty(0, np.int64)
    fraction = min(1.0, BORDER_ROWS / rows)

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paths in _texts(batch):
                places = np.sort(paths.places())
                some = places[np.linspace(0, len(places) - 1, min(len(places), BORDER_PATHS)).astype(np.int64)] if len(places) else places
                yield pa.RecordBatch.from_arrays([pa.array([len(places)]), pa.array([some.tolist()], pa.list_(pa.int64()))], ["n", "places"])

    found = [(r.n, r.places) for r in texts.sample(fraction, 7).mapInArrow(looked_at, "n long, places array<long>").collect() if r.n]
    if not found:
        return np.empty(0, np.int64)
    places = np.concatenate([p for _, p in found])
    weight = np.concatenate([np.full(len(p), n / len(p)) for n, p in found])
    order = np.argsort(places)
    below = np.cumsum(weight[order])
    ranges = math.ceil(below[-1] / fraction / RANGE_WORDS)
    return np.unique(places[order][np.searchsorted(below, below[-1] * np.arange(1, ranges) / ranges)])


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """Rows (lang, phrase, n_words, f) of phrases of 1 to DEPTH words with f >= least.

    A row with an empty phrase and n_words 0 has the number of words of its
    language.  Null lang is ``und``; null and empty texts have no words;
    repeated rows count each time.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    borders = range_borders(texts)
    shared = texts.sparkSession.sparkContext.broadcast(borders)
    kinds = pa.schema([("range", pa.int32()), *((c, pa.binary()) for c in ("langs", "words", "shapes", "labels", "weights"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paths in _texts(batch):
                if len(paths.weights):
                    yield pa.RecordBatch.from_pylist(list(_shards(paths, shared.value)), kinds)

    def unite(shards: pa.Table) -> pa.Table:
        return prefix_counts(united([_paths(row) for row in shards.to_pylist()]), shared.value, least)

    parts = texts.mapInArrow(cut, _SHARD).groupBy("range").applyInArrow(unite, _NODES)
    return parts.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("n_words") == 0))


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score) of docs(lang, text): each language's best phrases of 2 to 4 words.

    The score of a cut is floor(2000000 a / (l + r)), the worst cut counts, of
    equal ones that with the shortest first part.  A phrase goes if a longer
    one with at least 80 percent of its count holds it.

    Null lang is ``und``, null text is empty.  Ties in score and a go by the
    phrase's bytes.  Repeated rows count each time.  Languages without a phrase
    and empty tables give no rows.  Other columns are not read.
    """
    frequent = materialize(phrase_counts(docs, least), "phrases")
    totals = frequent.where("n_words = 0").select("lang", F.col("f").alias("n"))
    known = frequent.where("n_words > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    candidates = frequent.where("n_words > 1").select("lang", "phrase", F.col("f").alias("a"), "n_words", words.alias("words"))

    part = lambda begin, length: F.array_join(F.slice("words", begin, length), " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", "n_words", "words", cut)
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide("a"), wide("l") + wide("r"))
    worst = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(worst)

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("n_words") - size + 1), lambda begin: F.array_join(F.slice("words", begin, size), " "))))
    held = candidates.where("n_words > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = scored.join(held, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * CAST(longer AS DECIMAL(20,0)) < 80 * CAST(a AS DECIMAL(20,0))")
    rows = rows.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).join(totals, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
