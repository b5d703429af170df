"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Every source has a weight and a size (words of its documents).  All of them share
``budget`` words by weight, but none may be repeated more than ``max_epochs``
times.  The excess of a capped source goes to the others by weight until no source
is above its cap.  That fixed point has a closed form: order the sources by
``cap / weight``; the capped ones are a prefix of that order.

A document is repeated ``floor(target / source size)`` times.  The rest of the
target is filled with whole documents in the order of a seeded hash: a histogram of
that hash finds the bucket where the rest is reached, and only that bucket's
documents are ordered one by one.  Reruns agree, since only ``doc_id`` and the seed
enter the hash.

Defined results: a null source is a source of its own (ordered last); a null text
has size 0; a source of size 0 gets target 0; repeated rows are documents of their
own which share their hash; a very long text counts with its size and is taken whole or
not at all; an empty table gives an empty result; other columns travel along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import checkpoint, count_words

#: Broadcast the per-source table up to so many sources; else a skew-aware join.
BROADCAST_SOURCES = 10_000
#: Buckets of the sampling hash.
BUCKETS = 4096
HASH_SPAN = 1 << 32


def unit_hash(doc_id: Column, seed: int) -> Column:
    """32 bits (long) of md5 of seed and id: equal in every engine and run."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def water_fill(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Targets of the sources of ``sizes(source, source_size)``; weights repeat in code-point order.

    Adds weight, target.  One row per source, so its windows see few rows.  The level
    that the sources from one on would share rises up to the first that is not capped and
    falls after it, so the water level is the highest one of a free source.
    """
    everything = W.partitionBy()
    ranked = sizes.withColumn(
        "_rank", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    )
    weight = F.element_at(
        F.array(*[F.lit(int(w)).cast("long") for w in weights]),
        (F.col("_rank") % len(weights) + 1).cast("int"),
    )
    order = W.orderBy(F.col("_cap") / F.col("weight"), F.col("_rank"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (
        ranked.withColumn("weight", weight)
        .withColumn("_cap", F.col("source_size") * max_epochs)
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_spent", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_left", F.sum("weight").over(onward))
        .withColumn(
            "_level", (F.col("_total") - F.col("_spent")).cast("double") / F.col("_left").cast("double")
        )
        .withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_cap"))
        .withColumn("_water", F.max(F.when(F.col("_free"), F.col("_level"))).over(everything))
    )
    target = F.when(
        F.col("_free"), F.least(F.col("_water") * F.col("weight"), F.col("_cap").cast("double"))
    ).otherwise(F.col("_cap").cast("double"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def _plan(sized: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Per source: target, whole repetitions and the last hash that gets one more."""
    bucket = F.floor(F.col("_u") / (HASH_SPAN // BUCKETS)).cast("int")
    histogram = checkpoint(
        sized.groupBy("source", bucket.alias("_bucket")).agg(F.sum("_size").alias("_words"))
    )
    sizes = histogram.groupBy("source").agg(F.sum("_words").alias("source_size"))
    ratio = F.least(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(float(max_epochs)))
    plan = (
        water_fill(sizes, weights, max_epochs)
        .withColumn("_whole", F.coalesce(F.floor(ratio), F.lit(0)).cast("long"))
        .withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
    )
    running = W.partitionBy("source").orderBy("_bucket")
    edge = (
        histogram.withColumn("_upto", F.sum("_words").over(running))
        .withColumnRenamed("source", "_s")
        .join(plan, F.col("_s").eqNullSafe(F.col("source")))
        .where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_words") < F.col("_need")))
        .select("source", F.col("_bucket").alias("_edge"), (F.col("_need") - F.col("_upto") + F.col("_words")).alias("_room"))
    )
    edge = checkpoint(edge)
    inside = (
        sized.withColumn("_bucket", bucket)
        .withColumnRenamed("source", "_s")
        .join(
            _sized_broadcast(edge),
            F.col("_s").eqNullSafe(F.col("source")) & (F.col("_bucket") == F.col("_edge")),
        )
        .groupBy("source", "_edge", "_room", "_u")
        .agg(F.sum("_size").alias("_words"))
        .withColumn("_upto", F.sum("_words").over(W.partitionBy("source").orderBy("_u")))
        .where(F.col("_upto") - F.col("_words") / 2 <= F.col("_room"))
        .groupBy("source")
        .agg(F.max("_u").alias("_last"))
    )
    start = F.col("_edge").cast("long") * (HASH_SPAN // BUCKETS) - 1
    cut = edge.withColumnRenamed("source", "_s").join(
        inside, F.col("_s").eqNullSafe(F.col("source")), "left"
    ).select("_s", F.coalesce("_last", start).alias("_cut"))
    out = plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left")
    return checkpoint(
        out.select("source", "source_size", "target", "_whole", F.coalesce("_cut", F.lit(-1)).alias("_cut"))
    )


def _sized_broadcast(sources: DataFrame) -> DataFrame:
    """Broadcast a checkpointed per-source table only while it is known to be small."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 17,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(row, mix_size, mix_source_size, mix_target, mix_reps); ``row`` is the whole input row.

    The row is one struct, so no name of the input can clash.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("source"),
        F.col(text).alias("text"),
        unit_hash(F.col(doc_id), seed).alias("u"),
    )
    sized = rows.select("source", count_words(F.col("text")).alias("_size"), F.col("u").alias("_u"))
    plan = _plan(checkpoint(sized), weights, max_epochs).select(
        F.col("source").alias("of"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "_whole", "_cut"
    )
    reps = F.col("_whole") + F.when(F.col("u") <= F.col("_cut"), 1).otherwise(0)
    return rows.join(_sized_broadcast(plan), F.col("source").eqNullSafe(F.col("of"))).select(
        "row",
        count_words(F.col("text")).alias("mix_size"),
        "mix_source_size",
        "mix_target",
        F.least(reps, F.lit(max_epochs)).cast("long").alias("mix_reps"),
    )


def repeat(mixed: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as it is taken."""
    taken = mixed.where(F.col("mix_reps") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_reps").cast("int")))).select("row.*")


def op8_mixing(docs: DataFrame) -> DataFrame:
    """The digest of the mix: one row per document."""
    mixed = mix(docs.select("doc_id", "source", "text"))
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_reps")).alias("taken"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM s),
w AS (SELECT *, [5, 2, 1][k % 3 + 1] AS weight, 3 * source_size AS cap FROM r),
l AS (SELECT *,
        CAST((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM w),
t AS (SELECT *, CASE WHEN level * weight <= cap
        THEN least((max(level) FILTER (WHERE level * weight <= cap) OVER ()) * weight, CAST(cap AS DOUBLE))
        ELSE CAST(cap AS DOUBLE) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(least(target / source_size, 3.0::DOUBLE)) AS BIGINT) END AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS need FROM p),
h AS (SELECT source, u, sum(size) AS words FROM d GROUP BY source, u),
c AS (SELECT h.source, h.u, h.words, q.need,
        sum(h.words) OVER (PARTITION BY h.source ORDER BY h.u) AS upto,
        sum(h.words) OVER (PARTITION BY h.source ORDER BY h.u // 1048576) AS bucket_upto
      FROM h JOIN q ON h.source IS NOT DISTINCT FROM q.source),
b AS (SELECT source, min(u // 1048576) FILTER (WHERE bucket_upto >= need) AS edge FROM c GROUP BY source),
x AS (SELECT c.source, max(c.u) AS cut FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
      WHERE c.need > 0 AND (c.u // 1048576 < b.edge OR (c.u // 1048576 = b.edge AND c.upto - c.words / 2.0 <= c.need)) GROUP BY c.source)
SELECT d.doc_id, d.size, q.source_size, q.target,
       CAST(d.size * least(q.whole + CASE WHEN d.u <= coalesce(x.cut, -1) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
