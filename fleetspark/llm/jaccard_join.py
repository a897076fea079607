"""Exact Jaccard similarity join of documents on word n-gram sets, with set-relation skipping.

Shingles are put in one global order: frequent ones last, otherwise by hash.
Similar sets share a shingle among their first ones (the prefix), so prefixes
make an inverted index.  Equal sets are one class.  Then

* index level: a list is cut into blocks by set size and by the shingle's position
  in the set.  At a pair's first common shingle, a set at a late position has so
  few shingles left that only a smaller set can be like it.  So blocks of late
  positions are never met by one another, nor by blocks of larger sets, and no
  block by sizes too far off.  Pairs are compared at their first common prefix
  shingle and nowhere else, and are dropped where so few prefix shingles agree
  that the rest cannot make up for it.
* answer level: inside of a block the overlaps of a set come from the overlaps
  of one similar set, its pivot: only the shingles in which the two differ are
  looked up again.

What is left is verified on whole sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fleetspark.llm import flat
from fleetspark.llm.components import checkpointed, components, share

#: A shingle seen in so many documents is frequent and goes last in the order.
FREQUENT = 64
#: Index lists of at most so many sets are paired by a join, longer ones are compared in blocks.
SHORT_LIST = 16
#: Sets per block at most, and shingles per block, which makes blocks of large sets smaller.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
#: Bits of the map that tells which sets a later scan has to bring; a full map brings more sets, never fewer.
MAP_BITS = 1 << 23
#: So many first prefix shingles of each set go to all of its long lists; the whole prefix only where they leave a pair open.
HEAD = 8
_HOT_BIT = np.int64(1 << 39)


@dataclass(frozen=True)
class Rule:
    """Two sets of shingles of n words link if 100 * intersection >= percent * union."""

    words: int
    percent: int

    def least_overlap(self, a, b):
        return -((-self.percent * (a + b)) // (100 + self.percent))

    def late(self, n: Column, position: Column) -> Column:
        """Whether a set of n shingles, of which so many lie before, has too few left for a set of its size or larger."""
        return (n - position) * (100 + self.percent) < 2 * self.percent * n

    def prefix(self, n):
        return n + ((-self.percent * n) // 100) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted by (row, hash), and the rows' offsets among them."""
    data = flat.LOWER[data]
    starts, ends, rows = flat.words(data, offsets)
    n_rows = len(offsets) - 1
    hashes = flat.span_hashes(data, starts, ends)
    grams, at = flat.windows(hashes, rows, words)
    of = rows[at]
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    for k in range(1, words):  # fewer words: the whole sequence
        short = np.flatnonzero(count == k)
        if len(short):
            total = np.full(len(short), k, np.uint64)
            for i in range(k):
                total += hashes[first[short] + i] * flat.POSITION[i]
            place = np.searchsorted(of, short)
            grams, of = np.insert(grams, place, flat.mix(total)), np.insert(of, place, short)
    cuts = np.searchsorted(of, np.arange(n_rows + 1))
    for i in np.flatnonzero(np.diff(cuts) > 1):
        grams[cuts[i] : cuts[i + 1]].sort()
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[keep], np.concatenate([[0], np.cumsum(keep)])[cuts]


def _signatures(grams: np.ndarray, cuts: np.ndarray) -> list[bytes | None]:
    """16 bytes that are equal for equal sets; null for empty sets."""
    out = []
    total = [np.concatenate([[np.uint64(0)], np.cumsum(flat.mix(grams * p))]) for p in (flat.POSITION[7], flat.POSITION[11])]
    sums = np.stack([t[cuts[1:]] - t[cuts[:-1]] for t in total], 1)
    size = np.diff(cuts)
    sums[:, 0] += size.astype(np.uint64)
    for n, s in zip(size, sums):
        out.append(s.tobytes() if n else None)
    return out


def _is_frequent(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(grams), bool)
    return frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams


def _prefixes(rule: Rule, grams: np.ndarray, cuts: np.ndarray, frequent: np.ndarray, rows: list[int]) -> dict[int, bytes]:
    """The packed prefixes of some rows in the global order: 40 bits of each shingle's hash, frequent ones last.

    The hashes are sorted, so the first shingles that are not frequent are the
    prefix; mostly a stretch of twice its length holds them.
    """
    size = np.diff(cuts)
    need = rule.prefix(size)
    look = np.minimum(size, 2 * need + 16)
    inside = np.arange(len(grams)) - np.repeat(cuts[:-1], size)
    ahead = grams[inside < np.repeat(look, size)]
    hot = _is_frequent(ahead, frequent)
    at = np.concatenate([[0], np.cumsum(look)])
    out = {}
    for i in rows:
        cold = ahead[at[i] : at[i + 1]][~hot[at[i] : at[i + 1]]][: need[i]]
        if len(cold) == need[i]:
            keys = (cold >> np.uint64(25)).astype(np.int64)
        else:
            own = grams[cuts[i] : cuts[i + 1]]
            keys = np.sort((own >> np.uint64(25)).astype(np.int64) | np.where(_is_frequent(own, frequent), _HOT_BIT, 0))[: need[i]]
        out[i] = _pack(keys)
    return out


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<i8").ravel()


def _local_counts(words: int):
    def run(batches):
        """Shingles of several documents of a stretch of the input, with how many."""
        held, rows = [], 0

        def flush():
            grams, count = np.unique(np.concatenate(held), return_counts=True)
            many = count >= 4
            return pa.record_batch([pa.array(grams[many].view(np.int64)), pa.array(count[many])], names=["gram", "n"])

        for batch in batches:
            for a, b, data, offsets in flat.slices(batch.column("text"), flat.SMALL_SLICE_BYTES):
                held.append(shingle_sets(data, offsets, words)[0])
                rows += len(held[-1])
                if rows > 3_000_000:
                    yield flush()
                    held, rows = [], 0
        if held:
            yield flush()

    return run


def frequent_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """Hashes of frequent shingles, sorted.

    Any set of shingles gives right results, as it only orders the index; this
    one has those found often both in a stretch of the input and in all.  Their
    number is bounded by the threshold, which rises with the shingles found.
    """
    found = checkpointed(texts.mapInArrow(_local_counts(words), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    least = max(FREQUENT, (found.agg(F.sum("n")).first()[0] or 0) // 200_000)
    return np.sort(found.where(F.col("n") >= least).select("gram").toArrow()["gram"].to_numpy().view(np.uint64))


def _set_rows(rule: Rule, shared):
    def run(batches):
        """(id, sig, n, prefix); the prefix only once per set and task."""
        seen: set[bytes] = set()
        for batch in batches:
            for a, b, data, offsets in flat.slices(batch.column("text"), flat.SMALL_SLICE_BYTES):
                grams, cuts = shingle_sets(data, offsets, rule.words)
                sigs = _signatures(grams, cuts)
                fresh = []
                for i, sig in enumerate(sigs):
                    if sig is not None and sig not in seen:
                        seen.add(sig)
                        fresh.append(i)
                packed = _prefixes(rule, grams, cuts, shared.value, fresh)
                prefixes = [packed.get(i) for i in range(b - a)]
                yield pa.record_batch(
                    [batch.column("id").slice(a, b - a), pa.array(sigs, pa.binary()), pa.array(np.diff(cuts)), pa.array(prefixes, pa.binary())],
                    names=["id", "sig", "n", "prefix"],
                )

    return run


def _index_rows(batches):
    for batch in batches:
        prefixes = [_unpack(p) for p in batch.column("prefix").to_pylist()]
        size = np.array([len(p) for p in prefixes])
        if len(size):
            place = np.repeat(np.arange(len(size)), size)
            yield pa.record_batch(
                [
                    pa.array(np.concatenate(prefixes)), batch.column("cid").take(pa.array(place)), batch.column("n").take(pa.array(place)),
                    pa.array(np.concatenate([np.arange(k) for k in size]).astype(np.int64)),
                ],
                names=["token", "cid", "n", "position"],
            )


def _chosen_sets(rule: Rule, shared):
    def run(batches):
        """(sig, grams) of the sets in the map, once per task."""
        seen: set[bytes] = set()
        wanted = shared.value
        for batch in batches:
            for a, b, data, offsets in flat.slices(batch.column("text"), flat.SMALL_SLICE_BYTES):
                grams, cuts = shingle_sets(data, offsets, rule.words)
                rows = []
                for i, sig in enumerate(_signatures(grams, cuts)):
                    if sig is not None and sig not in seen:
                        bit = int.from_bytes(sig[:8], "little") % MAP_BITS
                        if wanted[bit >> 3] >> (bit & 7) & 1:
                            seen.add(sig)
                            rows.append((sig, grams[cuts[i] : cuts[i + 1]].tobytes()))
                if rows:
                    yield pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["sig", "grams"])

    return run


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered left with those numbered right.

    Shingles of one set only are left out.  For the others the counts are
    summed up in bounded stretches of shingles.  A left set that is like its
    pivot, the left set before it, takes over the pivot's counts and looks up
    only the shingles in which the two differ.
    """
    used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = place[: len(left)], place[len(left) :]
    sets = [sets[i] for i in used]
    size = np.array([len(s) for s in sets])
    if not size.sum():
        return np.zeros((len(left), len(right)), np.int64)
    owner, (_, which, count) = np.repeat(np.arange(len(sets)), size), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[which] > 1
    number = np.cumsum(count > 1) - 1
    owner, which = owner[keep], number[which[keep]]
    width = int((count > 1).sum())
    out = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, width, 4096):
        part = (which >= a) & (which < a + 4096)
        has = np.zeros((len(sets), min(4096, width - a)), np.int8)
        has[owner[part], which[part] - a] = 1
        l, r = has[left], has[right]
        change = l.copy()
        change[1:] -= l[:-1]
        if np.count_nonzero(change) * 30 < change.size:  # else a matrix product is faster
            delta = np.zeros((len(left), len(right)), np.int64)
            r32 = r.astype(np.int32)
            for i in range(len(left)):
                at = np.flatnonzero(change[i])
                delta[i] = r32[:, at] @ change[i, at].astype(np.int32)
            out += np.cumsum(delta, 0)
        else:
            out += (l.astype(np.float32) @ r.astype(np.float32).T).astype(np.int64)
    return out


def _compared(rule: Rule, token: int, n: np.ndarray, prefixes: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs have to be verified at this shingle.

    Sets that begin with the same earlier shingle have been compared there.  In
    a list of many like sets these are most, so the largest such family is not
    compared with itself again.
    """
    first = np.array([p[0] for p in prefixes])
    families, count = np.unique(first[np.concatenate([left, right])], return_counts=True)
    family = families[count.argmax()]
    if family >= token:
        return _open_pairs(rule, token, n, prefixes, left, right)
    out = np.zeros((len(left), len(right)), bool)
    strangers, guests = np.flatnonzero(first[left] != family), np.flatnonzero(first[right] != family)
    inside = np.flatnonzero(first[left] == family)
    if len(strangers):
        out[strangers] = _open_pairs(rule, token, n, prefixes, left[strangers], right)
    if len(inside) and len(guests):
        out[np.ix_(inside, guests)] = _open_pairs(rule, token, n, prefixes, left[inside], right[guests])
    return out


def _open_pairs(rule: Rule, token: int, n: np.ndarray, prefixes: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    near = (100 * np.minimum.outer(n[left], n[right]) >= rule.percent * np.maximum.outer(n[left], n[right]))
    if not near.any():
        return near
    earlier = [p[: np.searchsorted(p, token)] for p in prefixes]
    near &= _common(earlier, left, right) == 0
    shared = _common(prefixes, left, right)
    last = np.array([p[-1] for p in prefixes])
    need = rule.least_overlap(n[left][:, None], n[right][None, :])
    below = np.stack([np.searchsorted(prefixes[i], last[right]) for i in left])  # of left, before the end of right
    above = np.stack([np.searchsorted(prefixes[j], last[left]) for j in right], 1)
    seen_left = np.where(last[left][:, None] <= last[right][None, :], np.array([len(prefixes[i]) - 1 for i in left])[:, None], below)
    seen_right = np.where(last[right][None, :] <= last[left][:, None], np.array([len(prefixes[j]) - 1 for j in right])[None, :], above)
    near &= shared >= seen_left - (n[left][:, None] - need)
    near &= shared >= seen_right - (n[right][None, :] - need)
    return near


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Numbers of the rows on either side of a unit; whether it is a block against itself."""
    second = table.column("second").to_numpy()
    left, right = np.flatnonzero(~second), np.flatnonzero(second)
    size_a, block_a, size_b, block_b = (table.column(c)[0] for c in ("size_a", "block_a", "size_b", "block_b"))
    return (left, left, True) if size_a == size_b and block_a == block_b else (left, right, False)


def _pairs_of(rule: Rule, table: pa.Table):
    # sets of like size and shingles side by side make good pivots
    table = table.sort_by([("n", "ascending"), ("cid", "ascending")])
    left, right, same = _sides(table)
    cid, n = table.column("cid").to_numpy(), table.column("n").to_numpy()
    prefixes = [_unpack(p) for p in table.column("prefix").to_pylist()]
    open_ = _compared(rule, int(table.column("token")[0].as_py()), n, prefixes, left, right) if len(left) and len(right) else np.zeros((len(left), len(right)), bool)
    if same:
        open_ &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    return table, cid, n, left, right, open_


def _met_first(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        """The sets of a unit that may have a pair to verify there, judged by their first prefix shingles only.

        Most pairs of like sets have met at one of these before.
        """
        left, right, same = _sides(table)
        n = table.column("n").to_numpy()
        token = table.column("token")[0].as_py()
        open_ = 100 * np.minimum.outer(n[left], n[right]) >= rule.percent * np.maximum.outer(n[left], n[right])
        if open_.any():
            heads = [_unpack(p) for p in table.column("head").to_pylist()]
            open_ &= _common([h[: np.searchsorted(h, token)] for h in heads], left, right) == 0
        if same:
            np.fill_diagonal(open_, False)
        rows = np.unique(np.concatenate([left[open_.any(1)], right[open_.any(0)]]))
        return table.take(pa.array(rows)).select(["token", "size_a", "block_a", "size_b", "block_b", "second", "cid"])

    return run


_UNIT = "token long, size_a int, block_a long, size_b int, block_b long"


def _active(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        """The sets of a unit that have a pair to verify there."""
        table, cid, n, left, right, pairs = _pairs_of(rule, table)
        rows = np.unique(np.concatenate([left[pairs.any(1)], right[pairs.any(0)]]))
        return table.take(pa.array(rows)).select(["token", "size_a", "block_a", "size_b", "block_b", "second", "cid"])

    return run


def _verified(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        """(cid, links, root): copies linked to each set in this unit, and what ties its links together."""
        table, cid, n, left, right, pairs = _pairs_of(rule, table)
        if pairs.any():
            grams = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
            both = _common(grams, left, right)
            pairs &= 100 * both >= rule.percent * (n[left][:, None] + n[right][None, :] - both)
        copies = table.column("copies").to_numpy()
        links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
        np.add.at(links, left, pairs @ copies[right])
        np.add.at(links, right, pairs.T @ copies[left])
        while pairs.any():
            low = np.where(pairs, root[right][None, :], len(cid)).min(1)
            new = root.copy()
            np.minimum.at(new, left, low)
            np.minimum.at(new, right, np.where(pairs, new[left][:, None], len(cid)).min(0))
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(links)
        return pa.table({"cid": pa.array(cid[at]), "links": pa.array(links[at]), "root": pa.array(cid[root[at]])})

    return run


def _verified_pairs(rule: Rule):
    def run(batches):
        """The pairs of short lists that link: (a, b)."""
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(c["grams_a"][i], np.uint64), np.frombuffer(c["grams_b"][i], np.uint64)
                first = np.intersect1d(_unpack(c["prefix_a"][i]), _unpack(c["prefix_b"][i]))
                if len(first) and first[0] == c["token"][i]:  # else the pair is compared in a block
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= rule.percent * (len(x) + len(y) - both):
                        keep.append(i)
            yield pa.record_batch([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


def _map_of(sigs: DataFrame) -> np.ndarray:
    """The bit map of signatures, made of sums per byte."""
    bits = sigs.mapInArrow(_bits, "at int, bit int").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 8, np.uint8)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy().astype(np.uint8)
    return out


def _bits(batches):
    for batch in batches:
        bit = np.array([int.from_bytes(s[:8], "little") % MAP_BITS for s in batch.column("sig").to_pylist()], np.int64)
        yield pa.record_batch([pa.array((bit >> 3).astype(np.int32)), pa.array((1 << (bit & 7)).astype(np.int32))], names=["at", "bit"])


def _units(index: DataFrame, rule: Rule) -> DataFrame:
    """Rows of long lists dealt to units, pairs of blocks whose sizes and positions allow a link.

    A list's sets are grouped by size; early positions of size class c have the
    code 2c, late ones 2c + 1.  Early blocks are met by the early ones of their
    code, and by those one, two and three codes on: the late ones of their size
    class, and the early and late ones of the next.
    """
    largest = F.pow(F.lit(100 / rule.percent), F.floor(F.col("code") / 2) + 1)
    rows_per_block = F.greatest(F.least(F.floor(BLOCK_SHINGLES / largest), F.lit(BLOCK_ROWS)), F.lit(min(16, BLOCK_ROWS)))
    index = index.select("token", "cid", (2 * F.col("bucket") + F.col("late").cast("int")).alias("code"))
    lists = index.groupBy("token", "code").agg(F.count("*").alias("sets")).select("token", "code", F.ceil(F.col("sets") / rows_per_block).alias("blocks"))
    rows = index.join(lists, ["token", "code"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    early, zero = F.col("code") % 2 == 0, F.lit(0).cast("long")
    each = lambda a, b: F.explode(F.sequence(a, b))
    unit = lambda df, size_a, block_a, size_b, block_b, second: df.select(
        "token", "cid", F.col(size_a).alias("size_a"), block_a.alias("block_a"), F.col(size_b).alias("size_b"), block_b.alias("block_b"), F.lit(second).alias("second")
    )
    own = rows.where(early)
    same_first = unit(own, "code", F.col("block"), "code", each(F.col("block"), F.col("blocks") - 1), False)
    same_second = unit(own.where("block > 0"), "code", each(zero, F.col("block") - 1), "code", F.col("block"), True)
    met = lists.select("token", F.col("code").alias("other"), F.col("blocks").alias("others"))
    onward = own.withColumn("step", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("other", F.col("code") + F.col("step")).join(met, ["token", "other"])
    back = rows.withColumn("step", F.explode(F.when(early, F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(3)))))
    back = back.withColumn("other", F.col("code") - F.col("step")).join(met, ["token", "other"])
    first = unit(onward, "code", F.col("block"), "other", each(zero, F.col("others") - 1), False)
    second = unit(back, "other", each(zero, F.col("others") - 1), "code", F.col("block"), True)
    return same_first.unionByName(same_second).unionByName(first).unionByName(second)


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, n_links.

    A document's set are its distinct shingles of so many lower-cased words;
    with fewer words, the whole sequence is the only one.  Null, empty and blank
    texts have empty sets and link with nothing.  Two documents link when 100 *
    intersection >= percent * union.  component_id is the smallest id reachable
    by links, n_links the number of documents linked directly.  Repeated rows
    are copies of one another; rows with a null id take part, and the least id
    that is not null names their component (null if there is none).
    """
    rule = Rule(words, percent)
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    texts = rows.select("text")
    frequent = share(spark, frequent_shingles(texts, words))
    sets = checkpointed(rows.mapInArrow(_set_rows(rule, frequent), f"id {kind}, sig binary, n long, prefix binary"))
    copies = sets.where("sig IS NOT NULL").groupBy("sig").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = checkpointed(
        sets.where("prefix IS NOT NULL").groupBy("sig").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        .join(copies, "sig").withColumn("cid", F.monotonically_increasing_id())
    )
    index = classes.select("cid", "n", "prefix").mapInArrow(_index_rows, "token long, cid long, n long, position long")
    hot = F.col("token") >= int(_HOT_BIT)
    listed = index.where(~hot).withColumn("sets", F.count("*").over(Window.partitionBy("token"))).where("sets > 1")
    bucket = F.floor(F.log("n") / float(np.log(100 / percent))).cast("int")
    listed = checkpointed(listed.unionByName(index.where(hot).withColumn("sets", F.lit(SHORT_LIST + 1).cast("long"))).withColumn("bucket", bucket))

    # long lists, in blocks
    long_ = listed.where(F.col("sets") > SHORT_LIST)
    payload = classes.select("cid", "n", "prefix", "copies")
    unit = ["token", "size_a", "block_a", "size_b", "block_b"]
    heads = classes.select("cid", "n", F.substring("prefix", 1, 5 * HEAD).alias("head"))
    met = checkpointed(
        _units(long_.select("token", "cid", "bucket", rule.late(F.col("n"), F.col("position")).alias("late")), rule).join(heads, "cid")
        .groupBy(*unit).applyInArrow(_met_first(rule), f"{_UNIT}, second boolean, cid long")
    )
    active = checkpointed(
        met.join(payload.drop("copies"), "cid").groupBy(*unit).applyInArrow(_active(rule), f"{_UNIT}, second boolean, cid long")
    )

    # short lists, by a join of at most SHORT_LIST rows a token
    short = listed.where(F.col("sets") <= SHORT_LIST).select("token", "cid", "n")
    other = short.select("token", F.col("cid").alias("b"), F.col("n").alias("n_b"))
    near = (F.least("n", "n_b") * 100) >= F.greatest("n", "n_b") * percent
    pairs = (
        short.join(other, "token").where((F.col("cid") < F.col("b")) & near)
        .groupBy(F.col("cid").alias("a"), "b").agg(F.min("token").alias("token"), F.count("*").alias("shared"))
    )
    in_long = long_.groupBy("cid").agg(F.count("*").alias("in_long"))
    facts = classes.mapInArrow(_last_tokens, "cid long, n long, size long, last long").join(in_long, "cid", "left").withColumn("in_long", F.coalesce("in_long", F.lit(0)))
    side = lambda s: facts.select(F.col("cid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "size", "last", "in_long")))
    overlap = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / float(100 + percent))
    enough = F.when(
        F.col("last_a") <= F.col("last_b"), F.col("shared") + F.col("in_long_a") >= F.col("size_a") - 1 - (F.col("n_a") - overlap)
    ).otherwise(F.col("shared") + F.col("in_long_b") >= F.col("size_b") - 1 - (F.col("n_b") - overlap))
    pairs = checkpointed(pairs.join(side("a"), "a").join(side("b"), "b").where(enough).select("a", "b", "token"))

    # the whole sets of all that is to be verified
    wanted = active.select("cid").union(pairs.select("a")).union(pairs.select("b")).distinct().join(classes, "cid")
    wanted = checkpointed(wanted.select("cid", "sig", "n", "prefix", "copies"))
    chosen = share(spark, _map_of(wanted.select("sig")))
    whole = texts.mapInArrow(_chosen_sets(rule, chosen), "sig binary, grams binary").groupBy("sig").agg(F.first("grams").alias("grams"))
    whole = checkpointed(whole.join(wanted, "sig").drop("sig"))
    blocks = active.join(whole, "cid").groupBy(*unit).applyInArrow(_verified(rule), "cid long, links long, root long")
    end = lambda s: whole.select(F.col("cid").alias(s), F.col("prefix").alias(f"prefix_{s}"), F.col("grams").alias(f"grams_{s}"))
    linked = checkpointed(pairs.join(end("a"), "a").join(end("b"), "b").mapInArrow(_verified_pairs(rule), "a long, b long"))
    blocks = checkpointed(blocks)

    size = classes.select(F.col("cid").alias("b"), "copies")
    ends = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(size, "b")
    links = ends.select(F.col("a").alias("cid"), F.col("copies").alias("links")).unionByName(blocks.select("cid", "links")).groupBy("cid").agg(F.sum("links").alias("links"))
    edges = linked.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(blocks.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    groups = components(edges).withColumnRenamed("node", "cid")
    facts = (
        classes.select("cid", "sig", "copies", "least").join(groups, "cid", "left").join(links, "cid", "left")
        .select("sig", "copies", "least", F.coalesce("component", "cid").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    named = facts.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = facts.join(named, "component").select("sig", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return sets.select("id", "sig", "n").join(facts, "sig", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _last_tokens(batches):
    for batch in batches:
        last = [int(_unpack(p[-5:])[0]) for p in batch.column("prefix").to_pylist()]
        size = [len(p) // 5 for p in batch.column("prefix").to_pylist()]
        yield pa.record_batch([batch.column("cid"), batch.column("n"), pa.array(size, pa.int64()), pa.array(last, pa.int64())], names=["cid", "n", "size", "last"])
