"""Near duplicates among embeddings by an inverted multi-index.

Unit vectors are cut in halves; each half has its own codebook, and the pairs of
nearest codewords form a product grid of cells.  Every vector lies in one cell
and visits the cells nearest to it in the order of the sum of the two halves'
squared distances (the multi-sequence order), as many as reach the target
recall at the threshold.  Candidates met in a cell are verified by their exact
cosine in double precision.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.components import checkpointed, components

MIN_COSINE = 0.9
#: Codebooks and the number of visits are fitted on at most so many vectors: those with the smallest hashes.
FIT_VECTORS = 20_000
#: Share of neighbours at exactly the threshold that the visits must reach, on PROBES sample vectors.
TARGET_RECALL = 0.995
PROBES = 1500
#: A cell's vectors are compared in blocks of about this many, with so many visitors at once.
BLOCK_ROWS, VISITOR_ROWS = 512, 4096
#: Vectors per cell that the size of the codebooks aims at, and the largest codebook.
CELL_ROWS, MAX_WORDS = 200, 1024


@dataclass
class Grid:
    """Codebooks of the two halves of vectors of one length, and the visits per vector."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        return _squares(x[:, :half], self.first), _squares(x[:, half:], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def nearest(self, x: np.ndarray, count: int) -> np.ndarray:
        """The count nearest cells of each vector, nearest first.

        The cell at ranks (r, s) of the two sorted halves comes after the
        (r+1)(s+1)-1 cells at lower ranks, so only ranks with (r+1)(s+1) <=
        count can be among the first count: these are all that is looked at.
        """
        a, b = self.distances(x)
        order_a, order_b = np.argsort(a, 1, "stable"), np.argsort(b, 1, "stable")
        r, s = np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij")
        reach = ((r + 1) * (s + 1) <= count).ravel()
        r, s = r.ravel()[reach], s.ravel()[reach]
        total = np.take_along_axis(a, order_a[:, r], 1) + np.take_along_axis(b, order_b[:, s], 1)
        pick = np.argsort(total, 1, "stable")[:, :count]
        cells = order_a[:, r] * len(self.second) + order_b[:, s]
        return np.take_along_axis(cells, pick, 1)


def _squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (words**2).sum(1)[None, :] - 2 * x @ words.T


def _codebook(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """k-means by Lloyd's rounds; empty words move to random vectors."""
    words = x[rng.permutation(len(x))[:size]].copy()
    for _ in range(12):
        near = _squares(x, words).argmin(1)
        n = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(words))])
    return words


def fit_grid(x: np.ndarray, total: int, min_cosine: float = MIN_COSINE, target: float = TARGET_RECALL) -> Grid:
    """Codebooks for total vectors from the sample x, and the visits for the target recall.

    Probes get an artificial neighbour at exactly the threshold, in the
    direction of the difference to another vector; a pair is met if either end
    visits the other's cell.  Pairs above the threshold are nearer still.
    """
    rng = np.random.default_rng(7)
    size = int(np.clip(round(np.sqrt(total / CELL_ROWS)), 1, min(MAX_WORDS, max(1, len(x) // 8))))
    half = x.shape[1] // 2
    grid = Grid(_codebook(x[:, :half], size, rng), _codebook(x[:, half:], size, rng), 1)
    if size == 1 or len(x) < 2:
        return grid
    probes = x[rng.integers(0, len(x), PROBES)]
    other = x[rng.integers(0, len(x), PROBES)] - probes + 1e-3 * rng.standard_normal(probes.shape)
    other -= (other * probes).sum(1)[:, None] * probes
    other /= np.maximum(np.linalg.norm(other, axis=1), 1e-12)[:, None]
    near = min_cosine * probes + np.sqrt(1 - min_cosine**2) * other
    rank = np.minimum(_rank(grid, probes, grid.home(near)), _rank(grid, near, grid.home(probes)))
    grid.visits = int(np.quantile(rank, target, method="higher")) + 1
    return grid


def _rank(grid: Grid, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """How many cells come before the given one of each vector."""
    a, b = grid.distances(x)
    total = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
    return (total < total[np.arange(len(x)), cell][:, None]).sum(1)


def _matrix(binary) -> np.ndarray:
    """Unit vectors in double precision from their float32 bytes."""
    x = np.frombuffer(b"".join(binary), np.float32).reshape(len(binary), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _packed(batches):
    """(id, key, dim, vector): key is a hash of the vector, null for those that link with nothing."""
    for batch in batches:
        ids, lists = batch.column("id"), batch.column("vector")
        keys, dims, raw = [], [], []
        for v in lists:
            x = None if not v.is_valid else np.array(v.values.to_numpy(zero_copy_only=False), np.float64)
            good = x is not None and len(x) > 0 and bool(np.isfinite(x).all()) and bool((x != 0).any())
            packed = (x.astype(np.float32) + np.float32(0)).tobytes() if good else None
            good = good and bool(np.isfinite(np.frombuffer(packed, np.float32)).all()) and bool(np.frombuffer(packed, np.float32).any())
            keys.append(hashlib.blake2b(packed, digest_size=16).digest() if good else None)
            dims.append(len(x) if good else None)
            raw.append(packed if good else None)
        yield pa.record_batch([ids, pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["id", "key", "dim", "vector"])


def _placed(shared):
    def run(batches):
        grids = shared.value
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), np.int64)
            home, visits = np.zeros(len(dims), np.int64), [[0]] * len(dims)
            raw = batch.column("vector").to_pylist()
            for d in set(dims):
                if d in grids:
                    at = np.flatnonzero(dims == d)
                    for part in np.array_split(at, len(at) // 2000 + 1):
                        x = _matrix([raw[i] for i in part])
                        near = grids[d].nearest(x, grids[d].visits)
                        home[part] = grids[d].home(x)
                        for i, cells in zip(part, near):
                            visits[i] = cells.tolist()
            yield pa.record_batch(
                [*(batch.column(c) for c in ("key", "dim", "vector", "copies")), pa.array(home), pa.array(visits, pa.list_(pa.int64()))],
                names=["key", "dim", "vector", "copies", "home", "visits"],
            )

    return run


def _compare(min_cosine):
    def run(table: pa.Table) -> pa.Table:
        """Links between a block of a cell's vectors and some of its visitors: (key, n, root).

        n are the links this block adds to a vector, copies counted.  A pair is
        met twice if both ends visit each other's cell; then each end counts it
        where it is the visitor, else both count it here.  root ties together
        what is linked inside of the block, so no list of pairs leaves it.
        """
        visitor = table.column("visitor").to_numpy()
        m, v = table.filter(pa.array(~visitor)), table.filter(pa.array(visitor))
        out = {"key": pa.array([], pa.binary()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.binary())}
        if not len(m) or not len(v):
            return pa.table(out)
        x, y = _matrix(v.column("vector").to_pylist()), _matrix(m.column("vector").to_pylist())
        kx, ky = np.array(v.column("key").to_pylist(), object), np.array(m.column("key").to_pylist(), object)
        hit = x @ y.T >= min_cosine
        hit &= kx[:, None] != ky[None, :]
        rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(rows):
            return pa.table(out)
        hit = hit[np.ix_(rows, cols)]
        cx, cy = v.column("copies").to_numpy()[rows], m.column("copies").to_numpy()[cols]
        homes = v.column("home").to_numpy()[rows]
        visits = m.column("visits").take(pa.array(cols)).to_pylist()
        back = np.stack([np.isin(homes, cells) for cells in visits], 1)  # the member visits the visitor's cell too
        n = np.concatenate([hit @ cy, ((hit & ~back) * cx[:, None]).sum(0)])
        label_x, label_y = np.arange(len(rows)), np.full(len(cols), len(rows))
        while True:
            label_y = np.where(hit, label_x[:, None], len(rows)).min(0)
            new = np.where(hit, label_y[None, :], len(rows)).min(1)
            if (new == label_x).all():
                break
            label_x = new
        keys = np.concatenate([kx[rows], ky[cols]])
        root = kx[rows][np.concatenate([label_x, label_y])]
        return pa.table({"key": pa.array(list(keys), pa.binary()), "n": pa.array(n.astype(np.int64)), "root": pa.array(list(root), pa.binary())})

    return run


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    n_links counts the other rows with cosine >= min_cosine, component_id is the
    smallest id reachable by links (itself included), kept tells whether that
    is the own id.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different
    lengths.  Equal vectors are compared once, as one class with a count; a
    repeated row is one more copy.  Rows with a null id take part and get the
    component of their links (null alone).

    Cells are compared in blocks of bounded size, (block of members, slice of
    visitors), so neither a full cell nor a dense group meets in one task.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    packed = rows.mapInArrow(_packed, f"id {kind}, key binary, dim int, vector binary")
    classes = checkpointed(
        packed.where("key IS NOT NULL").groupBy("key").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.count("*").alias("copies"))
    )
    totals = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    sample = classes.orderBy("key").select("dim", "vector").limit(FIT_VECTORS).collect()
    grids = {}
    for dim in totals:
        own = [bytes(r["vector"]) for r in sample if r["dim"] == dim]
        if own:
            grids[dim] = fit_grid(_matrix(own), totals[dim], min_cosine)
    place = _placed(spark.sparkContext.broadcast(grids))
    placed = checkpointed(classes.mapInArrow(place, "key binary, dim int, vector binary, copies long, home long, visits array<long>"))
    cell = ["dim", "cell"]
    members = placed.groupBy("dim", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    guests = placed.select("dim", F.explode("visits").alias("cell")).groupBy(*cell).agg(F.ceil(F.count("*") / VISITOR_ROWS).alias("slices"))
    cells = members.join(guests, cell)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n))
    lying = (
        placed.withColumn("cell", F.col("home")).join(cells, cell)
        .select(*cell, own("blocks", 0).alias("block"), each("slices").alias("slice"), F.lit(False).alias("visitor"), "key", "vector", "copies", "home", "visits")
    )
    visiting = (
        placed.select("key", "dim", "vector", "copies", "home", F.explode("visits").alias("cell")).join(cells, cell)
        .select(*cell, each("blocks").alias("block"), own("slices", 1).alias("slice"), F.lit(True).alias("visitor"), "key", "vector", "copies", "home", F.lit(None).cast("array<long>").alias("visits"))
    )
    found = checkpointed(
        lying.unionByName(visiting).groupBy(*cell, "block", "slice")
        .applyInArrow(_compare(min_cosine), "key binary, n long, root binary")
    )
    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("key").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("key"), "component")
    by_class = (
        packed.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        .join(groups, "key", "left").join(links, "key", "left")
        .select("key", "least", "copies", F.coalesce("component", "key").alias("component"), F.coalesce("n", F.lit(0)).alias("n"))
    )
    least = by_class.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = by_class.join(least, "component").select("key", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = packed.select("id", "key").join(facts, "key", "left").select(
        "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("id"), F.lit(False))).withColumnRenamed("id", id_column)
