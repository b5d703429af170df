"""A stored table of embeddings, addressed by the content of texts.

The table is partitioned by the first digits of the texts' SHA-256 and grows by what a run
lacks: distinct texts of the run are anti-joined with it, embedded, and appended before the
run reads them, so a run that is repeated after a loss finds what was written.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import graph


@dataclass(frozen=True)
class Stats:
    """Lookups of a run: a text that was not stored misses once, all else hits; ``stored`` are the texts after it."""

    hits: int
    misses: int
    stored: int


class EmbeddingStore:
    """Vectors of one model below ``folder``, which driver and executors share; 16 to the power of ``digits`` partitions."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[Column], Column], digits: int = 2):
        self.spark, self.folder, self.embed, self.digits = spark, folder, embed, digits
        self.kind = spark.range(0).select(embed(F.lit("")).alias("v")).schema["v"].dataType.simpleString()

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self) -> DataFrame:
        """(sha, embedding, prefix) of all stored texts."""
        schema = f"sha string, embedding {self.kind}, prefix string"
        return self.spark.read.schema(schema).parquet(self.folder) if self._exists() else self.spark.createDataFrame([], schema)

    def lookup(self, texts: DataFrame, column: str = "content") -> tuple[DataFrame, Stats]:
        """``texts`` with a column ``embedding``, and what the run found; a null text has no vector and is no lookup."""
        sha = F.sha2(column, 256)
        keyed = texts.withColumn("_sha", sha)
        asked = graph.checkpoint(keyed.where(F.col("_sha").isNotNull()).groupBy(F.col("_sha").alias("sha")).agg(F.count(F.lit(1)).alias("n")).withColumn("prefix", F.substring("sha", 1, self.digits)))
        lacking = graph.checkpoint(asked.join(self.table().select("sha", "prefix"), ["prefix", "sha"], "left_anti"))
        misses = lacking.count()
        if misses:
            fresh = keyed.select("_sha", F.col(column).alias("_text")).join(lacking.select(F.col("sha").alias("_sha")), "_sha").dropDuplicates(["_sha"])
            rows = fresh.select(F.col("_sha").alias("sha"), self.embed(F.col("_text")).alias("embedding"), F.substring("_sha", 1, self.digits).alias("prefix"))
            rows.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(self.folder)
        stored = self.table()
        found = keyed.withColumn("_prefix", F.substring("_sha", 1, self.digits)).join(
            stored.select(F.col("sha").alias("_sha"), F.col("prefix").alias("_prefix"), "embedding"), ["_prefix", "_sha"], "left"
        )
        lookups = asked.agg(F.sum("n")).first()[0] or 0
        return found.drop("_prefix", "_sha"), Stats(lookups - misses, misses, stored.count())
