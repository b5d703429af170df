"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder of ``spark.checkpoint.dir``; only in local mode a temporary one takes its place."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="docloom-"))
    return df.checkpoint()


#: Steps along parents within a round; each doubles what is contracted.
JUMPS = 2
#: First rounds that order nodes by themselves: enough for most inputs, whose ids are hashes.
PLAIN = 2


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``; all nodes of a component share a label.

    Contraction: every node takes its least neighbour, if that is lower, as its parent;
    parents are followed a few steps, edges are renamed to them and loops dropped.  After
    ``PLAIN`` rounds nodes are ordered by a hash that changes every round, so half of them at most stay on average
    and rounds are logarithmic whatever the shape and the ids.  Edges left after
    ``max_rounds`` are an error, never a result.  A hub is one pre-aggregated row of the minimum and a skewed join, which is
    split at run time.  Joins merge whatever their size, so that no round broadcasts through the driver.  Every round is written to the shared checkpoint folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = checkpoint(both.where("a <> b").distinct())
    labels = None
    for turn in range(max_rounds):
        if turn < PLAIN:
            least = F.least(F.min("b"), F.first("a"))
        else:
            order = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("_h"), F.col(c).alias("_id"))
            least = F.least(F.min(order("b")), F.first(order("a")))["_id"]
        parents = left.groupBy(F.col("a").alias("node")).agg(least.alias("label"))
        for _ in range(JUMPS):
            up = parents.select(F.col("node").alias("label"), F.col("label").alias("_up")).hint("merge")
            parents = parents.join(up, "label", "left").select("node", F.coalesce("_up", "label").alias("label"))
            parents = checkpoint(parents)
        step = parents.select(F.col("node").alias("_n"), F.col("label").alias("_to")).hint("merge")
        if labels is None:
            labels = parents
        else:
            moved = labels.join(step, F.col("label") == F.col("_n"), "left")
            labels = checkpoint(moved.select("node", F.coalesce("_to", "label").alias("label")))
        half = left.join(step, F.col("a") == F.col("_n")).select(F.col("_to").alias("a"), "b")
        renamed = half.join(step, F.col("b") == F.col("_n")).select("a", F.col("_to").alias("b"))
        left = checkpoint(renamed.where("a <> b").distinct())
        if left.isEmpty():
            return labels
    raise RuntimeError(f"components: edges are left after {max_rounds} rounds")
