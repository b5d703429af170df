"""Repeated harvests of a folder: what two snapshots have in common, and ids that last.

A snapshot is a table (path, sha256, size_bytes) with an id for every path.  Two of them meet in a full
outer join on the path; what is left on either side and has the same content was moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import graph, selection

STATES = ("same", "changed", "moved", "added", "gone")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, old_path, state, id, sha256, size_bytes) of every path of either snapshot.

    ``before(path, sha256, size_bytes, id)`` and ``after(path, sha256, size_bytes)`` have a row a path.
    A file that is at a new path with the content of one that is at none any more was moved; of
    several with one content the first by path are matched in order.  Files keep their id
    when they change or move; added ones are numbered on from the largest, in order of path; gone ones keep theirs in this
    result alone.
    """
    old = before.select(F.col("path").alias("old_path"), F.col("sha256").alias("old_sha"), F.col("size_bytes").alias("old_size"), "id")
    both = graph.checkpoint(old.join(after.select("path", "sha256", "size_bytes"), F.col("old_path") == F.col("path"), "full"))
    c = F.col
    met = both.where("old_path IS NOT NULL AND path IS NOT NULL").withColumn("state", F.when((c("old_sha") == c("sha256")) & (c("old_size") == c("size_bytes")), "same").otherwise("changed"))
    left = both.where("path IS NULL").select("old_path", F.col("old_sha").alias("sha256"), F.col("old_size").alias("size_bytes"), "id")
    new = both.where("old_path IS NULL").select("path", "sha256", "size_bytes")
    content = ["sha256", "size_bytes"]
    gone = selection.numbered(left, content, ["old_path"])
    come = selection.numbered(new, content, ["path"])
    pairs = graph.checkpoint(gone.join(come, [*content, "place"], "full"))
    moved = pairs.where("old_path IS NOT NULL AND path IS NOT NULL").withColumn("state", F.lit("moved"))
    lost = pairs.where("path IS NULL").withColumns({"state": F.lit("gone"), "path": c("old_path")})
    added = pairs.where("old_path IS NULL").drop("id").withColumns({"state": F.lit("added"), "_all": F.lit(0)})
    last = before.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    ids = selection.numbered(added, ["_all"], ["path"], "_n").crossJoin(F.broadcast(last)).withColumn("id", c("_n") + c("_last"))  # one row
    columns = ["path", "old_path", "state", "id", "sha256", "size_bytes"]
    out = met.select(columns)
    for part in (moved, lost, ids):
        out = out.unionByName(part.select([c(x).cast("long").alias(x) if x == "id" else c(x) for x in columns]))
    return out


def current(compared: DataFrame) -> DataFrame:
    """The snapshot after: (path, sha256, size_bytes, id), to be compared with the next one."""
    return compared.where("state <> 'gone'").select("path", "sha256", "size_bytes", "id")
