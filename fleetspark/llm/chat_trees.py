"""Chat formatting of reply trees: root-to-leaf paths, the best of them as one text each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.components import checkpointed

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that a reader of the output takes as marks; inside a role or text they are broken by a backslash.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    """Undoes escape: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees without branches.

    Each row answers the one before it by (turn, role, text), nulls first, so
    repeated turns keep all their rows.  Null role and text become empty.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        F.col("conv_id").alias("tree_id"),
        F.row_number().over(order).cast("long").alias("message_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "tree_id", "message_id",
        F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"),
        "role", "text", F.lit(1.0).alias("score"),
    )


def leaf_paths(messages: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """The best paths of each tree: rows (tree_id, leaf_id, path_score, message_id, up).

    up counts the steps from the leaf.  messages: (tree_id, message_id,
    parent_id, score), message_id unique in its tree.  A path's score is the
    mean of its messages' scores (null: 0); equal scores prefer the longer
    path, then the smaller leaf_id.  A parent that is not there makes a root;
    messages on a cycle have no root and lie on no path.

    Self-joins double the reach of each message's ancestor pointer, so depth d
    takes log2(d) rounds; the chosen leaves' paths are then filled in the same
    number of rounds, from the pointers of each round.
    """
    key = ["tree", "message_id"]
    tree = F.struct("tree_id").alias("tree")  # a struct, so that a null tree_id is a key like any other
    nodes = messages.select(tree, "message_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = nodes.select("tree", F.col("message_id").alias("parent_id"), F.lit(True).alias("there"))
    hop = checkpointed(
        nodes.join(ids, ["tree", "parent_id"], "left")
        .select("tree", "message_id", F.when(F.col("there"), F.col("parent_id")).alias("anc"), "score", F.lit(1).cast("long").alias("length"))
    )
    first, hops = hop, []
    total = hop.count()
    while not hop.where("anc IS NOT NULL").isEmpty() and 2 ** len(hops) <= max(total, 1):
        hops.append(hop)
        above = hop.select("tree", F.col("message_id").alias("anc"), F.col("anc").alias("anc2"), F.col("score").alias("more"), F.col("length").alias("further"))
        # only messages that have not reached their root take another step
        stepped = hop.where("anc IS NOT NULL").join(above, ["tree", "anc"]).select(
            "tree", "message_id", F.col("anc2").alias("anc"), (F.col("score") + F.col("more")).alias("score"), (F.col("length") + F.col("further")).alias("length")
        )
        hop = checkpointed(hop.where("anc IS NULL").unionByName(stepped))
    parents = first.where("anc IS NOT NULL").select("tree", F.col("anc").alias("message_id")).distinct()
    leaves = hop.where("anc IS NULL").join(parents, key, "left_anti").withColumn("mean", F.col("score") / F.col("length"))
    best = [F.desc("mean"), F.desc("length"), "message_id"]
    part = Window.partitionBy("tree", F.pmod(F.xxhash64("message_id"), F.lit(64))).orderBy(*best)
    whole = Window.partitionBy("tree").orderBy(*best)
    chosen = (
        leaves.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= paths_per_tree)
        .withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= paths_per_tree)
    )
    path = chosen.select("tree", F.col("message_id").alias("leaf_id"), F.col("mean").alias("path_score"), "message_id", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(hops))):
        step = hops[k].where("anc IS NOT NULL").select("tree", "message_id", "anc")
        reached = path.join(step, key).select("tree", "leaf_id", "path_score", F.col("anc").alias("message_id"), (F.col("up") + 2**k).alias("up"))
        path = checkpointed(path.unionByName(reached))
    return path.select("tree.tree_id", "leaf_id", "path_score", "message_id", "up")


def format_paths(messages: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """One row per chosen path: tree_id, leaf_id, path_score, n_turns, formatted, loss_spans.

    Each turn is written as a start mark, the role, a line feed, the text and an
    end mark; control strings inside are escaped.  loss_spans are the (start,
    length) in code points, from 1, of the assistant texts in formatted.
    """
    paths = leaf_paths(messages, paths_per_tree).select(F.struct("tree_id").alias("tree"), "leaf_id", "path_score", "message_id", "up")
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    said = messages.select(
        F.struct("tree_id").alias("tree"), "message_id", (F.col("role") == "assistant").alias("loss"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    turn = F.struct((-F.col("up")).alias("at"), "head", "body", "loss")
    turns = paths.join(said, ["tree", "message_id"]).groupBy("tree", "leaf_id", "path_score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    end = F.lit(len(END))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(1).alias("at"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + end).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")))))
            .otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return turns.select(
        "tree.tree_id", "leaf_id", "path_score", F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|im_end\|>\n"), 1, F.greatest(F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1, F.lit(0)))
    head = r"(?s)^<\|im_start\|>((?:\\.|[^\\\n]++)*+)\n(.*)$"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, head, 1)).alias("role"),
            unescape(F.regexp_extract(p, head, 2)).alias("text"),
        ),
    )
