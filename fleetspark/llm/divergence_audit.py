"""Which sources of a language use words differently, by exact sums over count cells.

Terms that have the same counts on both sides of a comparison have the same
value.  So terms are grouped by their pair of counts, the value is computed
once per cell, and sums and ranks are taken over cells weighed by their number
of terms.  Only cells that can hold one of the first ranks are expanded to
terms again.  A term that is missing on one or both sides is in no table: its
share of a sum follows from the sizes, and the cells of terms that both sides
have put it right.

The terms of the texts are counted in Arrow batches; all the rest is DataFrame
operations.  The value is symmetric, so each pair of sources is summed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm import spans
from fleetspark.llm.flat import LOWER
from fleetspark.session import materialize

#: Bytes of terms: A-Z, a-z and all that is not ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
MIN_DOCS = 10
TOP_TERMS = 10
#: Distinct (group, term) rows that a task adds up before it hands them on.
HELD_ROWS = 1 << 19

_COUNTS = "lang string, term string, n_docs long, n long, sources array<string>, counts array<long>"


def _slice_counts(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group and term of each row of counts, the terms' words, occurrences and documents."""
    inside = TERM[data]
    starts, ends = spans.runs(inside, offsets)
    codes, words = spans.encoded(LOWER[data][inside], ends - starts)
    rows = np.searchsorted(offsets, starts, "right") - 1
    width = max(len(words), 1)
    in_doc, n = spans.tally(rows * width + codes)
    keys, n_docs, n = spans.tally(groups[in_doc // width] * width + in_doc % width, n)
    return keys // width, words.take(pa.array(keys % width)), n, n_docs


def _batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        pairs = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        names = batch.select(["lang", "source"]).to_pylist()
        known: dict[tuple, int] = {}
        codes = np.array([known.setdefault((r["lang"], r["source"]), len(known)) for r in names], np.int64)
        first = np.unique(codes, return_index=True)[1]
        for at, to, data, offsets in spans.slices(batch.column("text")):
            groups, words, n, n_docs = _slice_counts(data, offsets, codes[at:to])
            named = pairs.take(pa.array(first[groups]))
            table = pa.table([named.field(0), named.field(1), words.cast(pa.large_string()).cast(pa.string()), pa.array(n), pa.array(n_docs)], ["lang", "source", "term", "n", "n_docs"])
            held.append(table)
            rows += len(table)
            if rows > HELD_ROWS:
                whole = _added(held)
                if 2 * len(whole) > HELD_ROWS:
                    yield from _by_term(whole)
                    held, rows = [], 0
                else:
                    held, rows = [whole], len(whole)
    if held:
        yield from _by_term(_added(held))


def _added(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("n_docs", "sum")])
    return whole.select(["lang", "source", "term", "n_sum", "n_docs_sum"]).rename_columns(["lang", "source", "term", "n", "n_docs"])


def _by_term(counts: pa.Table) -> list[pa.RecordBatch]:
    """A row for each term of a language, with the counts of the sources seen so far in lists."""
    out = counts.group_by(["lang", "term"]).aggregate([("n_docs", "sum"), ("n", "sum"), ("source", "list"), ("n", "list")])
    out = out.select(["lang", "term", "n_docs_sum", "n_sum", "source_list", "n_list"])
    return out.rename_columns(["lang", "term", "n_docs", "n", "sources", "counts"]).to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, term, n_docs, n, sources, counts): what a task has seen of a term, its sources and their counts.

    Null lang, source and text count as ''.  Terms are runs of letters A-Z, a-z
    and of characters outside ASCII; only A-Z become lower case.
    """
    texts = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return texts.mapInArrow(_batch_counts, _COUNTS)


def share(count: Column | int, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact: numbers of any table stay below 38 digits."""
    count = F.lit(count) if isinstance(count, int) else count
    wide = lambda c: c.cast("decimal(20,0)")
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(count) + wide(F.lit(2)))
    return F.call_function("div", above, wide(total) + wide(F.lit(2)) * wide(terms)) + 1


def contrast(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so squares fit in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergences(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of docs(text, lang, source).

    Part ``pair`` has the other sources of the language by the summed contrast
    of all kept terms; part ``term`` the first TOP_TERMS terms that the source
    uses more than its language does.  Kept are terms in at least MIN_DOCS rows
    of the language.

    Null text, lang or source is ''.  Repeated rows and ids count as rows.
    Empty texts make a group without terms; a language without kept terms has
    pairs of value 0 and no terms.  Ties go to the smaller item in UTF-8 order.
    No documents give no rows.  Columns other than the three are not read.
    """
    groups = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counted = materialize(term_counts(docs), "term-counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("docs"))
    kept = materialize(kept.where(F.col("docs") >= MIN_DOCS).drop("docs"), "kept-terms")
    # rare terms go before the lists are unfolded; the join has brought each term's rows together
    each = F.explode(F.arrays_zip("sources", "counts")).alias("each")
    used = counted.select("lang", "term", "sources", "counts").join(kept, ["lang", "term"]).select("lang", "term", "lang_n", each)
    used = used.groupBy("lang", "term", "lang_n", F.col("each.sources").alias("source")).agg(F.sum("each.counts").alias("n"))
    used = materialize(used, "used-terms")
    cells = materialize(used.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("terms")), "term-cells")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    own = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"), F.sum("terms").alias("present"))
    sizes = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    sizes = materialize(sizes.na.fill(0, ["total", "present", "v", "lang_total"]), "source-sizes")
    return _pairs(used, cells, sizes).unionByName(_terms(used, cells, sizes))


def _ranked(rows: DataFrame) -> DataFrame:
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(place))


def _pairs(used: DataFrame, cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each unordered pair of sources of a language, summed over cells."""
    a = sizes.select("lang", "v", F.col("source").alias("s"), F.col("total").alias("s_total"), F.col("present").alias("s_present"))
    b = sizes.select("lang", F.col("source").alias("t"), F.col("total").alias("t_total"), F.col("present").alias("t_present"))
    pairs = a.join(b, "lang").where("s < t")
    some = F.col("v") > 0
    p = lambda n: F.when(some, share(n, F.col("s_total"), F.col("v")))
    q = lambda n: F.when(some, share(n, F.col("t_total"), F.col("v")))

    none = pairs.select("lang", "s", "t", F.coalesce((F.col("v") - F.col("s_present") - F.col("t_present")) * contrast(p(0), q(0)), F.lit(0)).alias("value"))
    alone = cells.groupBy("lang", "source", "n").agg(F.sum("terms").alias("terms"))
    in_s = pairs.join(alone.withColumnRenamed("source", "s"), ["lang", "s"]).select("lang", "s", "t", (F.col("terms") * contrast(p(F.col("n")), q(0))).alias("value"))
    in_t = pairs.join(alone.withColumnRenamed("source", "t"), ["lang", "t"]).select("lang", "s", "t", (F.col("terms") * contrast(p(0), q(F.col("n")))).alias("value"))

    left = used.select("lang", "term", F.col("source").alias("s"), F.col("n").alias("n_s"))
    right = used.select("lang", "term", F.col("source").alias("t"), F.col("n").alias("n_t"))
    both = left.join(right, ["lang", "term"]).where("s < t").groupBy("lang", "s", "t", "n_s", "n_t").agg(F.count(F.lit(1)).alias("terms"))
    more = contrast(p(F.col("n_s")), q(F.col("n_t"))) - contrast(p(F.col("n_s")), q(0)) - contrast(p(0), q(F.col("n_t"))) + contrast(p(0), q(0))
    in_both = both.join(pairs, ["lang", "s", "t"]).select("lang", "s", "t", (F.col("terms") * more).alias("value"))

    parts = none.unionByName(in_s).unionByName(in_t).unionByName(in_both)
    total = parts.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
    rows = total.select("lang", "value", sides.alias("side")).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    return _ranked(rows)


def _terms(used: DataFrame, cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """The first terms of each source: cells ranked by value, then expanded."""
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    valued = cells.join(sizes, ["lang", "source"]).select("lang", "source", "n", "lang_n", "terms", p.alias("p"), q.alias("q"))
    valued = valued.where("p > q").withColumn("value", contrast(F.col("p"), F.col("q")))

    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = valued.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    values = values.withColumn("place", F.row_number().over(down)).where(F.col("place") <= TOP_TERMS)
    values = values.withColumn("before", F.sum("terms").over(down.rowsBetween(Window.unboundedPreceding, -1)))
    values = values.where(F.coalesce("before", F.lit(0)) < TOP_TERMS).select("lang", "source", "value")

    chosen = valued.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value")
    rows = used.join(chosen, ["lang", "source", "n", "lang_n"])
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return _ranked(rows).where(F.col("rank") <= TOP_TERMS)
