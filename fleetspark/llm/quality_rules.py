"""Quality rules: base counts and a calibrated logistic regression on hashed n-grams.

The classifier sees each text as the frequencies of its hashed words, pairs of
neighbouring words and character 4-grams.  It is trained on labelled rows (a bounded sample, see
TRAIN_DOCS), its margin is turned into a probability on rows kept out of the
training, and whole texts are scored in Arrow batches against KEEP_FROM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm import flat

#: At most so many labelled documents train and calibrate the classifier: those with the smallest hash of doc_id.
TRAIN_DOCS = 4000
#: Every fifth of them calibrates only.
CALIBRATE_EVERY = 5
#: Hash slots of words, and as many of character n-grams and of word n-grams.
SLOTS = 1 << 16
CHAR_N, WORD_N = 4, 2
ALL_SLOTS = 3 * SLOTS
#: A document is kept if its calibrated probability of good quality is at least this.
KEEP_FROM = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class QualityModel:
    weights: np.ndarray  # float32, words, then character n-grams, then word n-grams
    bias: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.shift, -30, 30)))


def _slots(data, offsets, starts, ends, word_rows, hashes):
    """(slot, row) of every word, every character n-gram and every word n-gram."""
    points, at = flat.code_points(data, offsets)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    grams, first = flat.windows(points.astype(np.uint64) + np.uint64(1), rows, CHAR_N)
    pairs, begin = flat.windows(hashes, word_rows, WORD_N)
    slot = lambda h: (h >> np.uint64(48)).astype(np.int64) % SLOTS
    return (slot(hashes), word_rows), (slot(grams) + SLOTS, rows[first]), (slot(pairs) + 2 * SLOTS, word_rows[begin])


def _scores(weights, parts, n_rows):
    """Mean weight of the words, of the character n-grams and of the word n-grams of each row, added."""
    total = np.zeros(n_rows)
    for slot, row in parts:
        n = np.bincount(row, minlength=n_rows)
        total += np.bincount(row, weights[slot], minlength=n_rows) / np.maximum(n, 1)
    return total


def _repeat_words(hashes, rows, n_rows):
    """Words that lie in a window of three words found twice or more in the row."""
    grams, at = flat.windows(hashes, rows, 3)
    if not len(at):
        return np.zeros(n_rows, np.int64)
    _, which, count = np.unique(flat.mix(grams + rows[at].astype(np.uint64) * flat.POSITION[5]), return_inverse=True, return_counts=True)
    at = at[count[which] > 1]
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[at + i] = True
    return np.bincount(rows[covered], minlength=n_rows)


def _dup_lines(data, offsets, word_starts, n_rows):
    """Lines with a word that equal an earlier line of the row."""
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:].copy()
    ends -= data[np.maximum(ends - 1, 0)] == 10
    keep = np.unique(np.searchsorted(starts, word_starts, "right") - 1)
    starts, ends = starts[keep], ends[keep]
    rows = np.searchsorted(offsets, starts, "right") - 1
    key = flat.mix(flat.span_hashes(data, starts, ends) + rows.astype(np.uint64) * flat.POSITION[5])
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return np.bincount(rows[again], minlength=n_rows)


def _counts(data, offsets):
    starts, ends, rows = flat.words(data, offsets)
    hashes = flat.span_hashes(data, starts, ends)
    n = len(offsets) - 1
    out = {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": flat.per_row(~flat.SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": flat.per_row(_SYMBOL[data], offsets),
        "n_dup_lines": _dup_lines(data, offsets, starts, n),
        "n_repeat_words": _repeat_words(hashes, rows, n),
    }
    return out, (data, offsets, starts, ends, rows, hashes)


def _features(batches):
    """Sparse features of labelled rows: doc_id, good, slots and values packed as bytes."""
    for batch in batches:
        for a, b, data, offsets in flat.slices(batch.column("text")):
            _, work = _counts(data, offsets)
            slots, values = [[] for _ in range(b - a)], [[] for _ in range(b - a)]
            for slot, row in _slots(*work):
                key, count = np.unique(row * ALL_SLOTS + slot, return_counts=True)
                of, n = key // ALL_SLOTS, np.bincount(row, minlength=b - a)
                cut = np.searchsorted(of, np.arange(b - a + 1))
                for i in range(b - a):
                    part = slice(cut[i], cut[i + 1])
                    slots[i].append((key[part] % ALL_SLOTS).astype(np.int32))
                    values[i].append((count[part] / max(n[i], 1)).astype(np.float32))
            yield pa.record_batch(
                [batch.column("doc_id").slice(a, b - a), batch.column("good").slice(a, b - a),
                 pa.array([np.concatenate(s).tobytes() for s in slots], pa.binary()), pa.array([np.concatenate(v).tobytes() for v in values], pa.binary())],
                names=["doc_id", "good", "slots", "values"],
            )


def _summed(at, values, n):
    """Sums of values(stretch) by the numbers in at, in stretches that bound the scratch memory."""
    total = np.zeros(n)
    for begin in range(0, len(at), 1 << 19):
        part = slice(begin, begin + (1 << 19))
        total += np.bincount(at[part], values(part), minlength=n)
    return total


def _fit(row, slot, value, good, fit, rounds=150):
    """Weights and bias of a ridge logistic regression by Adam over the rows of fit, and the margins of all rows."""
    # both classes weigh the same, rows that are not fitted nothing
    share = fit * np.where(good, 0.5 / max((good & fit).sum(), 1), 0.5 / max((~good & fit).sum(), 1))
    w = np.zeros(ALL_SLOTS + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        margin = _summed(row, lambda s: w[slot[s]] * value[s], len(good)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - good) * share
        grad = _summed(slot, lambda s: error[row[s]] * value[s], len(w))
        grad[-1] = error.sum()
        grad[:-1] += 1e-7 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    margin = _summed(row, lambda s: w[slot[s]] * value[s], len(good)) + w[-1]
    return w[:-1].astype(np.float32), float(w[-1]), margin


def _calibrate(margin, good, rounds=50):
    """Slope and shift of a logistic curve over the margins, by Newton's method with a weak prior."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    # the smoothed targets of Platt scaling keep the curve finite on separable rows
    y = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta -= np.clip(np.linalg.solve(hessian, x.T @ (p - y) + 1e-3 * (beta - [1.0, 0.0])), -2, 2)
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> QualityModel:
    """Fits the classifier on at most train_docs labelled documents.

    docs: (doc_id, text); labels: (doc_id, quality 0 or 1).  Labels that are
    null or disagree for a document by half and half count as bad; null ids are
    left out.  With labels of one class only (or none) the model keeps, or
    drops, everything that passes the base rules.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") > 0.5).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    )
    # at most train_docs short rows: a proven bound for the broadcast
    sample = docs.where("text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = sample.select("doc_id", "text", "good").mapInArrow(_features, "doc_id long, good boolean, slots binary, values binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.slots)))
    good = np.array([r.good for r in rows], bool)
    if not rows or good.all() or not good.any():
        return QualityModel(np.zeros(ALL_SLOTS, np.float32), 0.0, 1.0, 20.0 if not rows or good.all() else -20.0)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r["slots"]) // 4 for r in rows])
    slot = np.frombuffer(b"".join(r["slots"] for r in rows), np.int32)
    value = np.frombuffer(b"".join(r["values"] for r in rows), np.float32)
    del rows
    held = np.arange(len(good)) % CALIBRATE_EVERY == 0
    if good[held].all() or not good[held].any() or good[~held].all() or not good[~held].any():
        held = np.zeros(len(good), bool)
    weights, bias, margin = _fit(row, slot, value, good, ~held)
    on = held if held.any() else ~held
    slope, shift = _calibrate(margin[on], good[on])
    return QualityModel(weights, bias, slope, shift)


OUTPUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def judge(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per row of docs: its id and OUTPUT.

    Null and empty texts have no words and fail the base rules, as do texts of
    fewer than MIN_WORDS words and those in which over MAX_REPEAT_PERCENT of
    the words lie in repeated windows of three; they are not kept, whatever the
    classifier says.  Repeated rows are judged each on its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for batch in batches:
            for a, b, data, offsets in flat.slices(batch.column("text")):
                counts, work = _counts(data, offsets)
                p = m.probability(_scores(m.weights, _slots(*work), b - a))
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                yield pa.record_batch(
                    [batch.column("id").slice(a, b - a), *(pa.array(c.astype(np.int64)) for c in counts.values()), pa.array(failed), pa.array(~failed & (p >= keep_from)), pa.array(p)],
                    names=["id", *counts, "base_failed", "kept", "probability"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(score, f"id {kind}, {OUTPUT}").withColumnRenamed("id", id_column)
