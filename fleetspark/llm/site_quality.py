"""Document quality with site priors: hierarchical empirical Bayes over host and path.

A document's own evidence, the probability from a classifier or its label, is
combined with what its host and its path have shown otherwise.  Hosts shrink
toward the global mean and paths toward their host, each by a strength that is
estimated from the spread between groups, so sparse sites say little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.components import checkpointed

KEEP_FROM = 0.5
#: Bounds of the prior strength, in documents.
STRENGTH = (1.0, 1e6)
_EDGE = 1e-4


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - _EDGE)), F.lit(_EDGE))
    return F.log(q / (1 - q))


def prior_strength(groups: DataFrame) -> float:
    """The strength of the common prior of groups (n, good, squares), by the method of moments.

    good and squares are the sums of the evidence and of its square.  Groups
    that differ no more than chance explains get the largest strength.
    """
    row = groups.where("n > 0").agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("squares").alias("squares"),
        F.sum(F.col("good") * F.col("good") / F.col("n")).alias("between"), F.sum(F.col("n") * F.col("n")).alias("n2"),
    ).first()
    if not row["n"] or row["groups"] < 2 or row["n"] <= row["groups"]:
        return STRENGTH[1]
    mean = row["good"] / row["n"]
    within = (row["squares"] - row["between"]) / (row["n"] - row["groups"])
    spread = (row["between"] - row["n"] * mean**2 - (row["groups"] - 1) * within) / (row["n"] - row["n2"] / row["n"])
    if spread <= 0:
        return STRENGTH[1]
    return float(min(max(mean * (1 - mean) / spread - 1, STRENGTH[0]), STRENGTH[1]))


def site_posteriors(evidence: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """evidence with host_posterior, path_posterior, posterior and kept.

    evidence: (host, path, evidence) and any others that do not clash with the
    added names.  Null hosts and paths are empty ones.  evidence is a
    probability; null says nothing: such a document is judged by its site alone
    and adds nothing to it.  Each document's site posteriors leave its own
    evidence out.  Without any evidence all posteriors are one half.

    The rows are stored once, as they are read for the sums, the strengths and
    the result.  Sums per (host, path) combine before the shuffle, and hosts are summed from
    paths, so a host with most of the rows is never gathered.
    """
    rows = checkpointed(evidence.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit(""))))
    paths = rows.groupBy("host", "path").agg(
        F.count("evidence").alias("n"), F.coalesce(F.sum("evidence"), F.lit(0.0)).alias("good"), F.coalesce(F.sum(F.col("evidence") * F.col("evidence")), F.lit(0.0)).alias("squares")
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("squares").alias("squares"))
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    mean = F.lit(good / n if n else 0.5)
    by_host, by_path = prior_strength(hosts), prior_strength(paths)
    joined = rows.join(paths.select("host", "path", F.col("n").alias("_n_path"), F.col("good").alias("_good_path")), ["host", "path"]).join(
        hosts.select("host", F.col("n").alias("_n_host"), F.col("good").alias("_good_host")), "host"
    )
    own, one = F.coalesce("evidence", F.lit(0.0)), F.col("evidence").isNotNull().cast("double")
    host = (F.col("_good_host") - own + by_host * mean) / (F.col("_n_host") - one + by_host)
    path = (F.col("_good_path") - own + by_path * F.col("host_posterior")) / (F.col("_n_path") - one + by_path)
    said = F.when(F.col("evidence").isNotNull(), _logit(F.col("evidence")) - _logit(mean)).otherwise(F.lit(0.0))
    return (
        joined.withColumn("host_posterior", host).withColumn("path_posterior", path)
        .withColumn("posterior", 1 / (1 + F.exp(-(_logit(F.col("path_posterior")) + said))))
        .withColumn("kept", F.col("posterior") >= keep_from).drop("_n_path", "_good_path", "_n_host", "_good_host")
    )


def page_sites(pages: DataFrame) -> DataFrame:
    """(doc_id, host, path) of the documents that a page's url names: its path ends with the document's number.

    path is the first step of the url's path.  Of several pages the least
    (host, path) counts.
    """
    from fleetspark.llm.url_filter import parsed

    at = pages.select(parsed(F.col("url")).alias("at")).select("at.host", "at.path")
    number = F.expr(r"try_cast(regexp_extract(path, '/([0-9]{1,18})([.]html)?/?$', 1) AS long)")
    found = at.where("host != ''").select(number.alias("doc_id"), F.struct("host", F.regexp_extract("path", r"^/[^/]*", 0).alias("path")).alias("at"))
    return found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("at").alias("at")).select("doc_id", "at.*")
