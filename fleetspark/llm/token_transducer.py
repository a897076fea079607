"""Token counts by transducers compiled from a tokenizer file, without encoding any text.

The tokenizer (a byte-level BPE with word ends) becomes two deterministic
transducers.

* The outer one reads classes of characters and marks where words begin.  A
  text is cut into chunks; each chunk gives a map from every state to the state
  behind it, the maps compose in a parallel prefix scan, and with its entry
  state known each chunk is read once more for its marks.
* The inner one reads the bytes of a word; each transition carries the number
  of tokens that the byte adds.  Its state holds, for each place in the word
  where a token that is still open may have begun, the token before that place
  and the tokens counted up to there.  A token may follow another if the two
  together are encoded as just these two; exactly one token that ends at a byte
  may follow the token before it.  So the state decides all that comes, states
  are finite, and they are made when a word first needs them.  All distinct
  words of a slice go through it in step.

Characters are mapped and classed by tables that are read off the tokenizers
library once, on the driver; only texts with characters that composition can
change go through its normaliser.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetspark.llm import spans

#: Bytes of text in a slice; longer texts are cut at blanks, where no state is open.
SLICE_BYTES = 1 << 21
CHUNK = 128
#: Inner states kept by a worker; beyond that it starts again with none.
MAX_STATES = 300_000

# Fixed values of the tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")

END, SYMBOLS = 256, 257
SPECIAL = 0x110000
BLANK, NUMBER, OTHER, LETTER, ENDING_1, ENDING_2, MARK = range(7)
# Outer states: nothing open, in letters, in other characters, one or two letters of an ending to come.
FRESH, LETTERS, OTHERS, ONE_MORE, TWO_MORE = range(5)


def _outer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a word begins, by state and class."""
    to, begins = np.full((5, 7), FRESH, np.uint8), np.zeros((5, 7), bool)
    opens = {NUMBER: FRESH, OTHER: OTHERS, LETTER: LETTERS, ENDING_1: ONE_MORE, ENDING_2: TWO_MORE, MARK: FRESH}
    for state in (FRESH, LETTERS, OTHERS):
        for kind, target in opens.items():
            to[state, kind], begins[state, kind] = target, True
    begins[LETTERS, LETTER] = False
    for kind in (OTHER, ENDING_1, ENDING_2):  # inside a run an apostrophe is one of its characters
        to[OTHERS, kind], begins[OTHERS, kind] = OTHERS, False
    to[ONE_MORE, LETTER], to[TWO_MORE, LETTER] = FRESH, ONE_MORE
    return to, begins


TO, BEGINS = _outer()


@dataclass
class Compiled:
    """What the workers need: tables by code point, tokens as symbols, merges."""

    lower: np.ndarray
    longer: dict[int, list[int]]
    kinds: np.ndarray
    composes: np.ndarray
    specials: list[str]
    sequences: list[tuple[int, ...]]
    merges: list[tuple[int, int, int]]


def compile_tokenizer(path: str) -> Compiled:
    """Reads a tokenizer file; ValueError if it is not of the family described above."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    _check(spec)
    import tokenizers

    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    apart = [p for p in points if p != 0x0A]  # line feeds part the characters, so that none acts on another
    joined = "\n".join(map(chr, apart))
    lower, longer = np.arange(0x110001, dtype=np.uint32), {}
    for p, out in zip(apart, tokenizers.normalizers.Lowercase().normalize_str(joined).split("\n"), strict=True):
        lower[p] = ord(out[0]) if out else p
        if len(out) != 1:
            longer[p] = [ord(c) for c in out]
    if [] in longer.values():
        raise ValueError("a character vanishes in lower case")

    whole = "".join(map(chr, points))
    kinds = np.full(0x110001, OTHER, np.uint8)
    where = np.array(points)
    for kind, pattern in ((BLANK, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        finder = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
        for _, (a, b) in finder.pre_tokenize_str(whole):
            kinds[where[a:b]] = kind
    kinds[SPECIAL] = MARK

    composes = np.zeros(0x110001, bool)
    for p, out in zip(apart, tokenizers.normalizers.NFC().normalize_str(joined).split("\n"), strict=True):
        # marks and parts of Hangul syllables may join what stands before them
        composes[p] = unicodedata.category(chr(p))[0] == "M" or 0x1100 <= p < 0x1200 or out != chr(p)

    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    shown = _shown_bytes()
    sequences: list[tuple[int, ...] | None] = [None] * (max(vocab.values()) + 1)
    for byte, char in enumerate(shown):
        sequences[vocab[char]], sequences[vocab[char + WORD_END]] = (byte,), (byte, END)
    steps = []
    for pair in merges:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        left, right, both = vocab[a], vocab[b], vocab[a + b]
        if sequences[both] is not None:
            raise ValueError(f"two ways to {a + b!r}")
        sequences[both] = sequences[left] + sequences[right]
        steps.append((left, right, both))
    return Compiled(lower, longer, kinds, composes, [t["content"] for t in spec["added_tokens"]], [s or () for s in sequences], steps)


def _check(spec: dict) -> None:
    model = spec["model"]
    steps = spec["normalizer"]["normalizers"]
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    good = (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and (split["type"], split["pattern"], split["behavior"], split["invert"]) == ("Split", {"Regex": PATTERN}, "Removed", True)
        and (level["type"], level["add_prefix_space"], level["use_regex"]) == ("ByteLevel", False, False)
        and (model["type"], model["end_of_word_suffix"]) == ("BPE", WORD_END)
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        and not any(c.isspace() for t in spec["added_tokens"] for c in t["content"])
    )
    if not good:
        raise ValueError("not a byte-level BPE with word ends of the supported family")


def _shown_bytes() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


def _packed(node: int, before: int, count: int) -> int:
    """One number for a place: the node its open token has reached, the token before it, tokens counted there less those counted now."""
    return node << 48 | before + 1 << 16 | count + 0x8000


def _unpacked(place: int) -> tuple[int, int, int]:
    return place >> 48, (place >> 16 & 0xFFFFFFFF) - 1, (place & 0xFFFF) - 0x8000


class Inner:
    """The transducer over the bytes of a word, made state by state."""

    def __init__(self, compiled: Compiled):
        self.sequences = compiled.sequences
        self.rank = {(a, b): (at, both) for at, (a, b, both) in enumerate(compiled.merges)}
        self.base = {s: token for token, s in enumerate(compiled.sequences) if len(s) == 1 or len(s) == 2 and s[1] == END}
        self.child: dict[int, int] = {}
        self.token, self.open = [-1], [True]
        for token, sequence in enumerate(compiled.sequences):
            node = 0
            for symbol in sequence:
                self.open[node] = True
                at = self.child.setdefault(node * SYMBOLS + symbol, len(self.token))
                if at == len(self.token):
                    self.token.append(-1)
                    self.open.append(False)
                node = at
            if node:
                self.token[node] = token
        self.clear()

    def clear(self) -> None:
        self.follows: dict[tuple[int, int], bool] = {}
        start = (_packed(0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self._allot(1 << 16)

    def _allot(self, size: int) -> None:
        self.keys = np.full(size, -1, np.int64)
        self.to, self.adds = np.zeros(size, np.int32), np.zeros(size, np.int8)
        self.used = 0

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the two tokens' symbols together are encoded as these two; -1 is the begin of the word."""
        known = self.follows.get((before, token))
        if known is None:
            want = [token] if before < 0 else [before, token]
            known = self.encode(sum((self.sequences[t] for t in want), ())) == want
            self.follows[before, token] = known
        return known

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        """Merges by rank, the first place before later ones."""
        parts = [self.base[(s,)] for s in symbols if s != END]
        if symbols[-1] == END:
            parts[-1] = self.base[symbols[-2:]]
        while len(parts) > 1:
            rank, at = min((self.rank.get(pair, (1 << 60, 0))[0], i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [self.rank[parts[at], parts[at + 1]][1]]
        return parts

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state behind a symbol and the tokens it adds."""
        chosen, adds, still = -1, 0, []
        for place in self.states[state]:
            node, before, count = _unpacked(place)
            node = self.child.get(node * SYMBOLS + symbol, 0)
            if not node:
                continue
            token = self.token[node]
            if chosen < 0 and token >= 0 and self.may_follow(before, token):
                chosen, adds = token, count + 1
            if self.open[node]:
                still.append((node, before, count))
        if chosen < 0:
            raise ValueError("the tokens do not cover every word")
        reached = (*(_packed(n, b, c - adds) for n, b, c in still), _packed(0, chosen, 0))
        number = self.number.setdefault(reached, len(self.states))
        if number == len(self.states):
            self.states.append(reached)
        return number, adds

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or the free slot where it belongs."""
        mask = len(self.keys) - 1
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & mask
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[slots[open_]]
            open_ = open_[(there != -1) & (there != keys[open_])]
            slots[open_] = (slots[open_] + 1) & mask
        return slots

    def _put(self, keys: np.ndarray, to: np.ndarray, adds: np.ndarray) -> None:
        """Stores new distinct keys."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            held = np.flatnonzero(self.keys != -1)
            old = self.keys[held], self.to[held], self.adds[held]
            size = len(self.keys)
            while 2 * (len(held) + len(keys)) > size // 2:
                size *= 2
            self._allot(size)
            self._put(*old)
        left = np.arange(len(keys))
        while len(left):
            slots = self._slots(keys[left])
            _, first = np.unique(slots, return_index=True)  # two keys may want one slot
            at = slots[first]
            self.keys[at], self.to[at], self.adds[at] = keys[left[first]], to[left[first]], adds[left[first]]
            left = np.delete(left, first)
        self.used += len(keys)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each word, given as bytes and offsets; all words advance in step."""
        if len(self.states) > MAX_STATES:
            self.clear()
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        lengths, begins = lengths[order], offsets[:-1][order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        live, at = len(order), 0
        while live:
            live = int(np.searchsorted(-lengths, -at, "right"))  # a word of n bytes has n + 1 symbols
            if not live:
                break
            ends = lengths[:live] == at
            symbols = np.where(ends, END, data[np.where(ends, 0, begins[:live] + at)].astype(np.int64))
            keys = state[:live] * SYMBOLS + symbols
            slots = self._slots(keys)
            missing = self.keys[slots] == -1
            if missing.any():
                new = np.unique(keys[missing])
                made = np.array([self.step(int(k) // SYMBOLS, int(k) % SYMBOLS) for k in new], np.int64)
                self._put(new, made[:, 0], made[:, 1])
                slots = self._slots(keys)
            state[:live] = self.to[slots]
            total[:live] += self.adds[slots]
            at += 1
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Flags where a word begins, by chunk maps and their prefix scan; the first character meets nothing open."""
    chunks = max(1, -(-len(kinds) // CHUNK))
    padded = np.full(chunks * CHUNK, BLANK, np.uint8)
    padded[: len(kinds)] = kinds
    by_place = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    table, marks = TO.ravel(), BEGINS.ravel()
    width = TO.shape[1]

    maps = np.repeat(np.arange(len(TO), dtype=np.uint8)[:, None], chunks, axis=1)
    for column in by_place:
        maps = table[maps * width + column]
    reach = 1
    while reach < chunks:  # each map takes in the maps of as many chunks again before it
        later, earlier = maps[:, reach:], maps[:, :-reach]
        maps = np.concatenate([maps[:, :reach], np.take_along_axis(later, earlier.astype(np.int64), axis=0)], axis=1)
        reach *= 2

    state = np.concatenate([[FRESH], maps[FRESH, :-1]]).astype(np.uint8)
    flags = np.empty((CHUNK, chunks), bool)
    for place, column in enumerate(by_place):
        cell = state * width + column
        flags[place], state = marks[cell], table[cell]
    return flags.T.reshape(-1)[: len(kinds)]


class Counter:
    """Both transducers over slices of texts."""

    def __init__(self, compiled: Compiled):
        import tokenizers

        self.compiled = compiled
        self.inner = Inner(compiled)
        self.compose = tokenizers.normalizers.NFC().normalize_str
        self.special = re.compile("|".join(re.escape(s) for s in sorted(compiled.specials, key=len, reverse=True))) if compiled.specials else None
        self.marks = [s.encode() for s in compiled.specials]

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of a slice."""
        points, rows = self._points(data, offsets)
        points, rows = self._lowered(points, rows)
        kinds = self.compiled.kinds[points]
        self._endings(points, kinds, rows)
        blanks = np.insert(kinds, rows[1:], BLANK)  # a blank behind each row closes what is open
        starts = np.delete(word_starts(blanks), rows[1:] + np.arange(1, len(rows)) - 1)
        return self._count(points, kinds, starts, rows)

    def _points(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points after composition, special strings as one mark, and the rows' offsets."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        rows = first[offsets]
        odd = self.compiled.composes[points]
        if not odd.any() and not any(m in raw for m in self.marks):
            return points, rows
        open_rows = np.add.reduceat(np.concatenate([odd, [False]]), rows[:-1]) > 0
        open_rows &= np.diff(rows) > 0
        out, lengths = [], []
        for at in range(len(rows) - 1):
            part = points[rows[at] : rows[at + 1]]
            text = raw[offsets[at] : offsets[at + 1]]
            if open_rows[at] or any(m in text for m in self.marks):
                pieces = self.special.split(text.decode("utf-8", "replace")) if self.special else [text.decode("utf-8", "replace")]
                coded = [np.frombuffer(self.compose(p).encode("utf-32-le"), np.uint32) for p in pieces]
                marked = [coded[0]]
                for piece in coded[1:]:
                    marked += [np.array([SPECIAL], np.uint32), piece]
                part = np.concatenate(marked)
            out.append(part)
            lengths.append(len(part))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(lengths)])

    def _lowered(self, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = np.flatnonzero(np.isin(points, list(self.compiled.longer))) if self.compiled.longer else []
        out = self.compiled.lower[points]
        if len(many):
            extra = [(at, p) for at in many for p in self.compiled.longer[int(points[at])][1:]]
            out = np.insert(out, [at + 1 for at, _ in extra], [p for _, p in extra])
            rows = rows + np.searchsorted(np.array([at for at, _ in extra]), rows, "left")
        return out, rows

    @staticmethod
    def _endings(points: np.ndarray, kinds: np.ndarray, rows: np.ndarray) -> None:
        """Classes of apostrophes that an ending may follow."""
        at = np.flatnonzero(points == ord("'"))
        if not len(at):
            return
        left = rows[np.searchsorted(rows, at, "right")] - at  # characters up to the row's end
        one = np.where(left > 1, points[np.minimum(at + 1, len(points) - 1)], 0)
        two = np.where(left > 2, points[np.minimum(at + 2, len(points) - 1)], 0)
        kinds[at[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = ENDING_1
        for a, b in LONG_ENDINGS:
            kinds[at[(one == ord(a)) & (two == ord(b))]] = ENDING_2

    def _count(self, points: np.ndarray, kinds: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        special = kinds == MARK
        first = np.flatnonzero(starts & ~special)
        row_of = np.searchsorted(rows, first, "right") - 1
        total = np.bincount(np.searchsorted(rows, np.flatnonzero(special), "right") - 1, minlength=len(rows) - 1).astype(np.int64)
        if len(first):
            inside = (kinds != BLANK) & ~special
            sizes = (1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)) * inside
            raw = np.frombuffer(points[inside].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            codes, words = spans.encoded(raw, np.add.reduceat(sizes, first))
            counts = self.inner.counts(*spans.joined(words))
            # sums of whole numbers below 2^53 are exact
            total += np.bincount(row_of, counts[codes], minlength=len(rows) - 1).astype(np.int64)
        return total


def _cut(text: bytes) -> list[bytes]:
    """A long text in parts that end behind a blank; a part without blanks stays whole."""
    parts, at = [], 0
    while len(text) - at > SLICE_BYTES:
        to = text.rfind(b" ", at, at + SLICE_BYTES) + 1
        if not to:
            to = text.find(b" ", at + SLICE_BYTES) + 1
        if not to:
            break
        parts.append(text[at:to])
        at = to
    return [*parts, text[at:]]


_HELD: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Rows (doc, n_bytes, n_tokens, over_limit) for docs with a column text; doc holds the other columns.

    n_tokens is what the tokenizers library gives for the whole text without
    added tokens, special strings inside the text being one token each.  Null
    and empty texts have 0 bytes and tokens.  Each row is counted by itself, so
    repeated rows and ids stay as they are; columns of any name are carried in
    the struct.  No documents give no rows.  A text is cut at blanks for
    counting; a run of more than SLICE_BYTES without a blank is one slice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compile_tokenizer(tokenizer))
    key = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = Counter(shared.value)
        counter = _HELD[key]
        for batch in batches:
            n_bytes, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, to, data, offsets in spans.slices(batch.column("text"), SLICE_BYTES):
                n_bytes[at:to] = np.diff(offsets)
                if len(data) > SLICE_BYTES:
                    for part in _cut(data.tobytes()):
                        n_tokens[at] += counter.tokens(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0]
                elif len(data):
                    n_tokens[at:to] = counter.tokens(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n_bytes), pa.array(n_tokens)], ["doc", "n_bytes", "n_tokens"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    carried = docs.select(F.struct(*rest).alias("doc") if rest else F.struct(F.lit(True).alias("row")).alias("doc"), "text")
    schema = StructType([carried.schema["doc"]]).add("n_bytes", "long").add("n_tokens", "long")
    return carried.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
