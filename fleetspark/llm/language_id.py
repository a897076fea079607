"""Language identification by interpolated Kneser-Ney character language models.

One model per language over lower-cased letters, with everything else as one
space.  The n-grams of all languages lie in one sorted array of 64-bit hashes
per order, beside a matrix of log probabilities with a column per language; a
text's cross-entropies come from binary searches in these arrays.  The language
with the least cross-entropy per character wins.  A calibrated curve over its
lead gives the score.  For rejection a text is cut into stretches; it goes if
more than half of it is unlikelier to every language than its own texts are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.llm import flat
from fleetspark.llm.components import share

ORDER = 4
#: Each language learns from at most so many documents: those with the smallest hash of doc_id.
DOCS_PER_LANGUAGE = 1500
#: More labels than this are not languages.
MAX_LANGUAGES = 200
#: Every fifth document of the sample calibrates and is not counted.
CALIBRATE_EVERY = 5
#: Labels with fewer documents are counted whole; their language takes the widest limit of rejection of the others.
LEAST_TO_SPLIT = 2 * CALIBRATE_EVERY
#: A text's typical entropy is the median over its stretches of about STRETCH characters, each in the language that suits it
#: best.  So texts of several known languages stay, and those with names or keys in less than half of them.
STRETCH = 64
#: A text of n characters is rejected if its typical entropy lies above its language's by more than w * sqrt(1/n + 1/LONG), or
#: if its score is below MIN_SCORE.  w is the KEPT quantile over the held-out texts of the language, at least DEVIATIONS
#: standard deviations (by the quartiles), as a small sample does not show the quantile; and for texts of LONG characters at
#: most HALF_WAY to the texts of other languages.
KEPT = 0.999
DEVIATIONS = 10.0
LONG = 1000
HALF_WAY = 0.5
MIN_SCORE = 0.5
UNKNOWN = "und"

_TABLE: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Code point to lower-case letter, or to a space."""
    if not _TABLE:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x32000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(ch.lower()[0])
        _TABLE.append(table)
    return _TABLE[0]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all rows, runs of other characters as one space, and the row of each.

    Every row begins and ends with a space.
    """
    points, at = flat.code_points(data, offsets)
    n = np.diff(at)
    codes = np.full(len(points) + 2 * len(n), 32, np.uint32)
    rows = np.repeat(np.arange(len(n)), n + 2)
    codes[np.arange(len(points)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = _classes()[points]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (rows[1:] != rows[:-1])
    return codes[keep], rows[keep]


def grams(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each position, and the positions."""
    hashes, first = flat.windows(codes.astype(np.uint64) + np.uint64(1), rows, n)
    return hashes, first + n - 1


@dataclass
class LanguageModel:
    languages: list[str]
    hashes: list[np.ndarray]  # by order: sorted n-grams of all languages
    logs: list[np.ndarray]  # by order: log probability, (n-grams, languages)
    contexts: list[np.ndarray]  # by order: sorted contexts
    backoff: list[np.ndarray]  # by order: log weight of the lower order, (contexts, languages)
    unseen: float  # log probability of a letter no language has
    usual: np.ndarray  # by language: the typical entropy of its own texts
    allowed: np.ndarray  # by language: how far a text may lie above it, times what its length gives
    curve: tuple[float, float]  # the score is a logistic curve over the lead

    def entropies(self, codes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each row in each language (nan without letters), and the characters."""
        return self.measured(codes, rows, n_rows)[:2]

    def measured(self, codes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As entropies, and the excess of each row's median stretch over the usual entropy of the stretch's language."""
        width = len(self.languages)
        total = np.zeros((n_rows, width))
        order = len(self.hashes)
        hashed = [flat.windows(codes.astype(np.uint64) + np.uint64(1), rows, k) for k in range(1, order + 1)]
        # the gram of order k that ends at position i is at slot[k][i]; -1 where the row is too short
        slot = []
        for k, (_, first) in enumerate(hashed, 1):
            s = np.full(len(codes), -1)
            s[first + k - 1] = np.arange(len(first))
            slot.append(s)
        starts = np.ones(len(codes), bool)
        starts[1:] = rows[1:] != rows[:-1]
        todo = np.flatnonzero(~starts)  # the leading space is given
        given = np.zeros((len(todo), width), np.float32)
        left = np.arange(len(todo))
        for k in range(order, 0, -1):
            mine = slot[k - 1][todo[left]]
            has = mine >= 0
            found, at = _find(self.hashes[k - 1], hashed[k - 1][0][mine[has]])
            hit = np.zeros(len(left), bool)
            hit[has] = found
            given[left[hit]] += self.logs[k - 1][at[found]]
            if k > 1:
                miss = has & ~hit
                context = hashed[k - 2][0][slot[k - 2][todo[left[miss]] - 1]]
                known, where = _find(self.contexts[k - 1], context)
                given[left[miss][known]] += self.backoff[k - 1][where[known]]
            else:
                given[left[~hit]] += self.unseen
            left = left[~hit]
        n = np.bincount(rows[todo], minlength=n_rows)
        for j in range(width):
            total[:, j] = np.bincount(rows[todo], given[:, j], minlength=n_rows)
        lettered = np.bincount(rows, codes != 32, minlength=n_rows) > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = np.where(lettered[:, None], -total / n[:, None], np.nan)
        return entropy, n, self._excess(given, rows[todo], n)

    def _excess(self, given: np.ndarray, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The median over a row's stretches of their least entropy above a language's usual one; 0 for empty rows."""
        pieces = np.maximum(1, (n + STRETCH // 2) // STRETCH).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(pieces)])
        starts = np.concatenate([[0], np.cumsum(n)])[:-1]
        piece = first[rows] + (np.arange(len(rows)) - starts[rows]) * pieces[rows] // n[rows]
        size = np.maximum(np.bincount(piece, minlength=first[-1]), 1)
        least = np.full(first[-1], np.inf)
        for j in range(len(self.languages)):
            least = np.minimum(least, -np.bincount(piece, given[:, j], minlength=first[-1]) / size - self.usual[j])
        owner = np.repeat(np.arange(len(n)), pieces)
        order = np.lexsort((least, owner))
        middle = least[order][first[:-1] + (pieces - 1) // 2] if len(n) else np.empty(0)
        return np.where(n > 0, middle, 0.0)

    def decide(self, entropy: np.ndarray, n: np.ndarray, excess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: none), score and rejection of each row."""
        none = np.isnan(entropy).any(1) if len(self.languages) else np.ones(len(n), bool)
        if not len(self.languages):
            return np.full(len(n), -1), np.zeros(len(n)), none
        safe = np.where(none[:, None], 0.0, entropy)
        best = safe.argmin(1)
        lead = lead_of(safe, n)
        score = 1 / (1 + np.exp(-np.clip(self.curve[0] * lead + self.curve[1], -30, 30)))
        far = excess > self.allowed[best] * _spread(n)
        score = np.where(none, 0.0, score)
        return np.where(none, -1, best), score, none | far | (score < MIN_SCORE)


def _spread(n: np.ndarray) -> np.ndarray:
    """How much the entropy of texts of n characters varies, but for a factor."""
    return np.sqrt(1 / np.maximum(n, 1) + 1 / LONG)


def lead_of(entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far the best language is ahead, in nats per character, weighted by the length's root."""
    if entropy.shape[1] < 2:
        return np.sqrt(np.maximum(n, 1.0))
    two = np.partition(entropy, 1, axis=1)
    return (two[:, 1] - two[:, 0]) * np.sqrt(np.maximum(n, 1.0))


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return table[at] == wanted, at


def _gram_counts(batches):
    """(lang, gram, n) of the sample, summed per slice; a gram is its code points as bytes."""
    n = ORDER
    for batch in batches:
        for a, b, data, offsets in flat.slices(batch.column("text"), flat.SMALL_SLICE_BYTES):
            codes, rows = letters(data, offsets)
            lang = np.array(batch.column("lang").slice(a, b - a).to_pylist(), object)
            for name in set(lang):
                take = np.isin(rows, np.flatnonzero(lang == name))
                c, r = codes[take], rows[take]
                for k in range(2, n + 1):
                    # orders below the highest count only the beginnings of texts; the rest is derived from the highest
                    h, first = flat.windows(c.astype(np.uint64) + np.uint64(1), r, k)
                    if k < n:
                        begins = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                        keep = np.isin(first, begins)
                        h, first = h[keep], first[keep]
                    if not len(h):
                        continue
                    text = np.stack([c[first + i] for i in range(k)], 1)
                    _, one, count = np.unique(h, return_index=True, return_counts=True)
                    chars = [bytes(x) for x in text[one].astype("<u4")]
                    yield pa.record_batch([pa.array([name] * len(one)), pa.array(chars, pa.binary()), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"])


def _calibration_rows(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for a, b, data, offsets in flat.slices(batch.column("text"), flat.SMALL_SLICE_BYTES):
                codes, rows = letters(data, offsets)
                entropy, n, excess = m.measured(codes, rows, b - a)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), batch.column("lang").slice(a, b - a), pa.array(list(entropy), pa.list_(pa.float64())), pa.array(n.astype(np.int64)), pa.array(excess)],
                    names=["doc_id", "lang", "entropy", "n", "excess"],
                )

    return run


def _hash(gram: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of code points."""
    flat_codes = gram.astype(np.uint64).ravel() + np.uint64(1)
    rows = np.repeat(np.arange(len(gram)), gram.shape[1])
    return flat.windows(flat_codes, rows, gram.shape[1])[0]


def _kneser_ney(counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]], languages: list[str]):
    """The model's arrays from counts[language][order] = (n-grams as rows of code points, counts)."""
    width = len(languages)
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[None] * width for _ in range(ORDER + 1)]
    for j, name in enumerate(languages):
        top = counts[name].get(ORDER, (np.empty((0, ORDER), np.uint32), np.empty(0, np.int64)))
        levels[ORDER][j] = top
        for k in range(ORDER - 1, 0, -1):
            above = levels[k + 1][j][0]
            tails = [above[:, 1:]]
            if k in counts[name]:  # texts' beginnings have no letter before them; each counts as one
                tails.append(counts[name][k][0])
            gram, n = np.unique(np.concatenate(tails), axis=0, return_counts=True)
            levels[k][j] = (gram, n)
    letters_seen = np.unique(np.concatenate([levels[1][j][0].ravel() for j in range(width)])) if width else np.empty(0)
    uniform = 1 / (len(letters_seen) + 1)
    hashes, logs, contexts, backoff = [], [], [], []
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([levels[k][j][0] for j in range(width)]), axis=0)
        h = _hash(union)
        order = np.argsort(h)
        union, h = union[order], h[order]
        ctx = np.unique(union[:, :-1], axis=0) if k > 1 else np.empty((1, 0), np.uint32)
        ch = _hash(ctx) if k > 1 else np.zeros(1, np.uint64)
        corder = np.argsort(ch)
        ch = ch[corder]
        prob, weight = np.zeros((len(union), width)), np.ones((len(ch), width))
        union_ctx = np.searchsorted(ch, _hash(union[:, :-1])) if k > 1 else np.zeros(len(union), np.int64)
        if k > 1:
            lower = np.exp(logs[k - 2][np.searchsorted(hashes[k - 2], _hash(union[:, 1:]))].astype(np.float64))
        else:
            lower = np.full((len(union), width), uniform)
        for j in range(width):
            gram, n = levels[k][j]
            if len(gram):
                once, twice = (n == 1).sum(), (n == 2).sum()
                discount = min(max(once / (once + 2 * twice) if once + twice else 0.5, 0.1), 0.9)
                at = np.searchsorted(h, _hash(gram))
                mine = union_ctx[at]
                sums = np.bincount(mine, n, minlength=len(ch))
                kinds = np.bincount(mine, minlength=len(ch))
                seen = sums > 0
                weight[seen, j] = discount * kinds[seen] / sums[seen]
                prob[at, j] = (n - discount) / sums[mine]
            prob[:, j] += weight[union_ctx, j] * lower[:, j]
        hashes.append(h)
        logs.append(np.log(prob).astype(np.float32))
        contexts.append(ch)
        backoff.append(np.log(weight).astype(np.float32))
    # a letter of no language: what the lowest order leaves to the uniform distribution
    return hashes, logs, contexts, backoff, float(np.log(uniform * np.exp(backoff[0]).min())) if width else 0.0


def _sample(docs: DataFrame, learn: Column, per_language: int) -> DataFrame:
    """(doc_id, text, lang, calibrates) of the learned documents."""
    mark = F.xxhash64("doc_id")
    labelled = docs.where(learn & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        "doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), mark.alias("mark")
    )
    sizes = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # a share of the hash range that holds about per_language documents of each language
    span = 2**64
    limits = {r["lang"]: (2**63 - 1 if r["count"] <= per_language else -(2**63) + span * per_language // r["count"]) for r in sizes}
    chosen = F.lit(False)
    for name, limit in limits.items():
        chosen = chosen | ((F.col("lang") == name) & (F.col("mark") <= F.lit(limit)))
    rare = [r["lang"] for r in sizes if r["count"] < LEAST_TO_SPLIT]
    calibrates = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE_EVERY)) == 0) & ~F.col("lang").isin(rare)
    return labelled.where(chosen).select("doc_id", "text", "lang", calibrates.alias("calibrates"))


def train(docs: DataFrame, learn: Column, per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """Models of all non-null labels in docs (doc_id, text, lang), from the rows where learn holds.

    About per_language documents of each language are read, so the counts that
    come to the driver are bounded by their characters.  Null ids, texts and
    labels teach nothing; without any the model knows no language.  Labels too
    rare to split (LEAST_TO_SPLIT) are counted whole and take the widest limit
    of the others; without any held-out text nothing is rejected as unlikely.
    """
    spark = docs.sparkSession
    sample = _sample(docs, learn, per_language)
    counted = (
        sample.where("NOT calibrates").select("lang", "text").mapInArrow(_gram_counts, "lang string, gram binary, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toArrow()
    )
    counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    lang = np.array(counted["lang"].to_pylist(), object)
    size = np.array([len(g) for g in counted["gram"].to_pylist()]) // 4
    n = counted["n"].to_numpy()
    raw = np.array(counted["gram"].to_pylist(), object)
    for name in sorted(set(lang)):
        counts[name] = {}
        for k in range(2, ORDER + 1):
            pick = (lang == name) & (size == k)
            if pick.any():
                counts[name][k] = (np.frombuffer(b"".join(raw[pick]), "<u4").reshape(-1, k), n[pick])
    languages = list(counts)
    if not languages:
        return LanguageModel([], [], [], [], [], 0.0, np.empty(0), np.empty(0), (1.0, 0.0))
    arrays = _kneser_ney(counts, languages)
    model = LanguageModel(languages, *arrays, np.zeros(len(languages)), np.full(len(languages), np.inf), (1.0, 0.0))
    shared = share(spark, model)
    held = sample.where("calibrates").select("doc_id", "text", "lang").mapInArrow(_calibration_rows(shared), "doc_id long, lang string, entropy array<double>, n long, excess double").collect()
    held = sorted(r for r in held if r["n"] and r["lang"] in counts and not np.isnan(r["entropy"][0]))
    return _calibrated(model, held)


def _calibrated(model: LanguageModel, held: list) -> LanguageModel:
    """The model with its curve and its limits of rejection, from labelled texts that it did not count."""
    if held:
        entropy, n = np.array([r["entropy"] for r in held]), np.array([r["n"] for r in held])
        truth = np.array([model.languages.index(r["lang"]) for r in held])
        own = entropy[np.arange(len(held)), truth]
        x, right = lead_of(entropy, n), entropy.argmin(1) == truth
        y = np.where(right, (right.sum() + 1) / (right.sum() + 2), 1 / ((~right).sum() + 2))
        beta, design = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
            beta -= np.clip(np.linalg.solve(hessian, design.T @ (p - y) + 1e-2 * (beta - [1.0, 0.0])), -1, 1)
        model.curve = (max(float(beta[0]), 1e-3), float(beta[1]))
        # until the usual entropies are set, the excess is the median stretch's own entropy
        typical = np.array([r["excess"] for r in held])
        for j in range(len(model.languages)):
            mine = (truth == j) & right
            if mine.any():
                model.usual[j] = np.median(typical[mine])
                far = (typical[mine] - model.usual[j]) / _spread(n[mine])
                quarters = np.quantile(far, [0.25, 0.75])
                allowed = max(np.quantile(far, KEPT), DEVIATIONS * (quarters[1] - quarters[0]) / 1.349, 1.0)
                others = entropy[truth != j, j]
                if len(others):
                    allowed = min(allowed, HALF_WAY * max(others.mean() - model.usual[j], 0.0) / _spread(np.array([LONG]))[0])
                model.allowed[j] = allowed
        # a language without held-out texts is measured like the least predictable one; with few n-grams its model is nearly
        # uniform and would win every text that no model knows
        unset = np.isinf(model.allowed)
        if unset.any() and not unset.all():
            model.usual[unset], model.allowed[unset] = model.usual[~unset].max(), model.allowed[~unset].max()
    return model


def identify(docs: DataFrame, model: LanguageModel, carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: struct doc of the carried columns, lang_pred, score, rejected.

    docs needs text; carry names what goes along (all columns by default).
    lang_pred is ``und`` with score 0 and rejected if the text is null or has no
    letter, or if the model knows no language; equal cross-entropies take the
    first language.  A rejected text keeps its most likely language.
    """
    shared = share(docs.sparkSession, model)
    carry = docs.columns if carry is None else carry
    # a carried text goes to the tasks once
    carried = "text" in carry and dict(docs.dtypes)["text"] == "string"

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column("doc").field("text") if carried else batch.column("text")
            for a, b, data, offsets in flat.slices(texts, flat.SMALL_SLICE_BYTES):
                codes, rows = letters(data, offsets)
                if m.languages:
                    entropy, n, excess = m.measured(codes, rows, b - a)
                else:
                    entropy, n, excess = np.empty((b - a, 0)), np.zeros(b - a), np.zeros(b - a)
                best, score, rejected = m.decide(entropy, n, excess)
                yield pa.record_batch(
                    [batch.column("doc").slice(a, b - a), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)],
                    names=["doc", "lang_pred", "score", "rejected"],
                )

    doc = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc")
    nested = docs.select(doc) if carried else docs.select(doc, F.col("text").cast("string").alias("text"))
    kind = nested.schema["doc"].dataType.simpleString()
    return nested.mapInArrow(run, f"doc {kind}, lang_pred string, score double, rejected boolean")
