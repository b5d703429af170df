"""Structured Streaming: arriving files, event counts, sessions and first arrivals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.files import EXTENSIONS

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, root: str) -> DataFrame:
    """New files below ``root`` as a stream."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)


def ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every micro-batch to ``handle(batch, epoch)``; restarts go on from ``checkpoint``."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; works on a stream (with a watermark) and on a table."""
    source = _marked(events, "ts", late) if events.isStreaming else events
    grouped = source.groupBy(F.window("ts", window).alias("w"), "event_type")
    sums = grouped.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "events", "value")


def _marked(rows: DataFrame, column: str, late: str) -> DataFrame:
    """A stream with a watermark; a table as it is."""
    timed = rows.withColumn(column, F.col(column).cast("timestamp"))  # a watermark needs timestamps with a zone
    return timed.withWatermark(column, late) if rows.isStreaming else timed


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of a user that follow each other within ``gap``; works on a stream and on a table.

    A stream keeps the sessions that may still grow: those that end after the latest event less ``late``.
    """
    grouped = _marked(events, "ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    sums = grouped.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"), F.max("ts").alias("last"))
    return sums.select("user_id", F.col("w.start").alias("start"), "last", "events", "value")


def first_arrivals(arrivals: DataFrame, key: str = "sha256", at: str = "modificationTime", late: str = "1 hour") -> DataFrame:
    """One row for every content; works on a stream and on a table.

    A stream forgets a content ``late`` after it arrived, so its state is bounded; what
    comes again later than that is a new arrival.  Of a table's rows the earliest stays.
    """
    if arrivals.isStreaming:
        return _marked(arrivals, at, late).dropDuplicatesWithinWatermark([key])
    whole = F.struct(*[F.col(f"`{c}`") for c in arrivals.columns])
    first = arrivals.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(whole, F.struct(at, *[c for c in ("path",) if c in arrivals.columns])).alias("r")).select("r.*")
    return first.unionByName(arrivals.where(F.col(key).isNull()).limit(1))


def with_hash(files: DataFrame) -> DataFrame:
    """Files of ``watch_folder`` or of a scan with the hash of their content."""
    return files.withColumn("sha256", F.sha2("content", 256))
