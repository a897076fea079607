"""Shared helpers: cutting lineage and distributed connected components."""

from __future__ import annotations

import tempfile

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the checkpoint folder that all executors share.

    The cluster names the folder in ``spark.checkpoint.dir``.  A local session
    without it (tests) gets a temporary one; any other session must set it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one on a local session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="llm-checkpoint-")


_OPEN: list | None = None
#: Bytes of an Arrow batch in a pipeline; a batch of 10,000 rows of long texts is held by the JVM and by the Python worker.
BATCH_BYTES = 4 << 20


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast for the tasks of an operator; in a pipeline it lives until the next stage begins."""
    shared = spark.sparkContext.broadcast(value)
    if _OPEN is not None:
        _OPEN.append(shared)
    return shared


def new_stage(spark: SparkSession) -> None:
    """Takes the broadcasts of the stage before, whose result has been written, from driver and executors.

    Their JVMs then give back the heap that it took.  From now on the session's
    Arrow batches are bounded by their bytes too.
    """
    global _OPEN
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    for shared in _OPEN or []:
        shared.destroy(blocking=True)
    _OPEN = []
    collect_garbage(spark)


def collect_garbage(spark: SparkSession) -> None:
    """A full collection in each executor, by one short task on each core.

    A JVM that has grown to its limit otherwise stays as large, beside the
    Python workers of later work.  A task that finds no free core runs on
    another executor, whose collection is then one more; no result needs it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").collect()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of the undirected edges (u, v): rows (node, component).

    component is the smallest node reachable, itself included.  Nodes are of any
    one orderable type.  Null ends, loops and repeated edges are ignored; no
    edges give no rows.

    Each round every node takes its smallest neighbour below itself as parent;
    the parents form a forest, which is contracted to its roots by pointer
    jumping, and the edges are rewritten to the roots.  Only minima per node
    are aggregated (combined before the shuffle), so a node with very many
    edges is never gathered; its rows in the joins are split by adaptive skew
    handling and vanish by distinct in the next round.
    """
    live = checkpointed(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    labels = checkpointed(live.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("component")))
    for _ in range(max_rounds):
        if live.isEmpty():
            return labels
        parent = checkpointed(live.groupBy("u").agg(F.min("v").alias("p")))
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = checkpointed(parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            parent = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        roots = parent.select(F.col("u").alias("old"), F.col("p").alias("root"))
        labels = checkpointed(
            labels.join(roots, F.col("component") == F.col("old"), "left").select("node", F.coalesce("root", "component").alias("component"))
        )
        for side in ("u", "v"):
            live = live.join(roots, F.col(side) == F.col("old"), "left").withColumn(side, F.coalesce("root", side)).select("u", "v")
        live = checkpointed(
            live.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
    raise RuntimeError("components did not settle")
