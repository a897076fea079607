"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words and a weight schedule over the
training time 0..1.  The integral of the schedule, scaled to the target, is the
source's cumulative demand; a document whose words start at demand c is placed
at the time when the demand reaches c.  Sorting by these positions gives the
training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.components import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Target weights, dealt to the sources in order, repeating.
WEIGHTS = [1, 2, 3]
#: Weight schedules as knots (time, weight) of a piecewise linear curve over 0..1, dealt likewise.
SCHEDULES = [
    [(0.0, 1.0), (1.0, 1.0)],
    [(0.0, 3.0), (0.5, 1.0), (1.0, 1.0)],
    [(0.0, 1.0), (0.6, 1.0), (1.0, 3.0)],
]
MAX_PASSES = 3
#: Documents of a source are summed in hash buckets of about this many rows.
BUCKET_ROWS = 2048
#: A source table of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_ranks(sources: DataFrame) -> DataFrame:
    """sources with rank (from 0) by code point of source, null last; source is unique.

    The rows are range-partitioned, counted per partition and numbered inside
    each, so no task sees all sources.
    """
    parts = checkpointed(
        sources.withColumn("last", F.col("source").isNull())
        .repartitionByRange("last", F.col("source").asc())
        .withColumn("part", F.spark_partition_id())
    )
    counts = parts.groupBy("part").agg(F.count("*").alias("rows"))
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("last", F.col("source").asc())) - 1
    return parts.withColumn("inside", inside).join(before, "part").withColumn("rank", F.col("before") + F.col("inside")).drop("part", "last", "inside", "before")


def _dealt(values: list, rank: Column) -> Column:
    return F.element_at(F.array(*values), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def _segments(knots: list[tuple[float, float]]) -> Column:
    """array<struct<t0, w0, slope, before>>; before is the integral up to t0 as a share of the whole."""
    whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append(
            F.struct(F.lit(t0).alias("t0"), F.lit(w0 / whole).alias("w0"), F.lit((w1 - w0) / (t1 - t0) / whole).alias("slope"), F.lit(before).alias("before"))
        )
        before += (t1 - t0) * (w0 + w1) / 2 / whole
    return F.array(*out)


def invert_demand(share: Column, segments: Column) -> Column:
    """The time at which the cumulative demand is this share (0..1) of the target."""
    at = F.element_at(F.filter(segments, lambda s: s["before"] <= share), -1)
    need = share - at["before"]
    # need = w0 x + slope x^2 / 2, solved without cancellation
    root = F.sqrt(F.greatest(at["w0"] * at["w0"] + 2 * at["slope"] * need, F.lit(0.0)))
    return at["t0"] + F.when(need > 0, 2 * need / (at["w0"] + root)).otherwise(F.lit(0.0))


def source_targets(sizes: DataFrame, weights: list[int] = WEIGHTS, schedules: list = SCHEDULES, max_passes: int = MAX_PASSES) -> tuple[DataFrame, int]:
    """(source, source_size, n_docs) with target and segments, and the number of sources.

    Targets share the sum of all sizes by weight and stop at max_passes times
    the source's size; the excess is shared among the others until none is
    above.  The level (words per weight) only rises, so each round is one
    aggregate over the sources, of which the driver sees two numbers.
    """
    ranked = source_ranks(sizes)
    table = checkpointed(ranked.withColumn("weight", _dealt([F.lit(int(w)) for w in weights], F.col("rank")).cast("long")))
    cap = F.col("source_size") * max_passes
    total, weight, rows = table.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    total = total or 0
    left, over = total, weight or 1
    while True:
        capped = F.lit(float(left)) * F.col("weight") / F.lit(float(over)) > cap
        given, others = table.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        if (total - (given or 0), others or 1) == (left, over):
            break
        left, over = total - (given or 0), others or 1
    target = F.least(F.lit(float(left)) * F.col("weight") / F.lit(float(over)), cap.cast("double"))
    segments = _dealt([_segments(s) for s in schedules], F.col("rank"))
    return table.select("source", "source_size", "n_docs", target.alias("target"), segments.alias("segments")), rows


def curriculum(docs: DataFrame, carry: list[str] | None = None, **options) -> DataFrame:
    """Each row of docs with what the mix takes of it.

    docs: (doc_id, text, source) and any others.  Returns (doc, size,
    source_size, target, positions): doc is a struct of the columns named by
    carry (all by default), so columns of any name are safe, positions the
    ascending training times of the passes that are taken (at most max_passes,
    maybe none).

    A source's documents stand in an order by hash of doc_id (null: of the
    text), equal hashes by size; pass p of a document starts at p times the
    source's size plus the words before it, and is taken if its middle lies
    within the target.  So the words taken differ from the target by half a
    document at most, and reruns agree.  A null source is a source; null texts
    and texts without words have size 0 and words to take in no pass.

    Word sums run over (source, hash bucket); buckets hold about BUCKET_ROWS
    rows, so a source with most of the rows is spread over many tasks.
    """
    id_hash = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("doc"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"), id_hash.alias("h"),
    )
    slim = docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), id_hash.alias("h"))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    table, n_sources = source_targets(sizes, **options)
    max_passes = options.get("max_passes", MAX_PASSES)
    n_buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    table = table.select(F.struct("source").alias("key"), "source_size", "target", "segments", n_buckets.alias("n_buckets"))
    small = F.broadcast(table) if n_sources <= BROADCAST_SOURCES else table
    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") * F.col("n_buckets") / float(2**32))
    key = ["key", "bucket"]
    placed = lambda x: x.withColumn("key", F.struct("source")).join(small, "key").withColumn("bucket", bucket)
    sums = placed(slim).groupBy(*key).agg(F.sum("size").alias("bucket_size"))
    starts = sums.select(*key, (F.sum("bucket_size").over(Window.partitionBy("key").orderBy("bucket")) - F.col("bucket_size")).alias("bucket_start"))
    inside = Window.partitionBy(*key).orderBy("h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("bucket_start") + F.col("inside") - F.col("size")
    pass_start = lambda p: p * F.col("source_size") + F.col("start")
    taken = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(max_passes - 1).cast("long")), lambda p: (2 * pass_start(p) + F.col("size") <= 2 * F.col("target")) & (F.col("size") > 0))
    share = lambda p: F.least(pass_start(p) / F.col("target"), F.lit(1.0))
    return (
        placed(rows).withColumn("inside", F.sum("size").over(inside)).join(starts, key).withColumn("start", start)
        .select("doc", "size", "source_size", "target", F.transform(taken, lambda p: invert_demand(share(p), F.col("segments"))).alias("positions"))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The training set: each taken pass of each document as a row, sorted by position; columns of docs."""
    passes = curriculum(docs, **options).select("doc", F.explode("positions").alias("position"))
    return passes.orderBy("position", F.col("doc.doc_id")).select("doc.*")
