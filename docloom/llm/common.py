"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract of this subpackage: space and U+0009..U+000D.
WS = r"[\x20\x09-\x0D]+"
#: A word: a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, evaluated once per row.

    A lambda variable can't be inlined by the optimizer, unlike a projected
    column that is read in several places.
    """
    return F.transform(F.array(value), body).getItem(0)


#: Elements of a block of ``prefixes``.
BLOCK = 64


def prefixes(xs: Column, zero: Column, add) -> Column:
    """Folds of what stands before each element; in blocks, so that long arrays take no quadratic time."""

    def bound(xs: Column) -> Column:
        fold = lambda part, start: F.aggregate(part, start, add)
        block = lambda b, n: F.slice(xs, (b * BLOCK + 1).cast("int"), n)
        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: fold(block(b, F.lit(BLOCK)), zero))
        heads = lambda s: F.aggregate(s, F.array(zero), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))

        def within(h: Column) -> Column:
            at = lambda i: F.floor(i / BLOCK).cast("int")
            return F.transform(xs, lambda _, i: fold(block(at(i), (i % BLOCK).cast("int")), F.get(h, at(i))))

        return let(let(sums, heads), within)

    return F.when(F.size(xs) > 0, let(xs, bound)).otherwise(F.slice(F.array(zero), 1, 0))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only in local mode, where they are one process, a temporary one takes its place.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="docloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder: its rows outlive any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    """Words of a text in order; null gives an empty array."""
    stripped = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(F.length(stripped) > 0, F.split(stripped, WS)).otherwise(
        F.array().cast("array<string>")
    )


def floats(df: DataFrame, embedding: str) -> Column:
    """The vector with floats as they are and other numbers as doubles."""
    single = df.schema[embedding].dataType.elementType.typeName() == "float"
    return F.col(embedding).cast("array<float>" if single else "array<double>")


def count_words(text: Column) -> Column:
    """Number of words (long); null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
