"""Order statistics, neighbours and samples of groups of any size, without a group in one task."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from docloom.operators import graph

#: Values of a group that are sorted at once.
SORTED = 4096
#: Buckets that a group's open range is cut into, and rounds at most.
BUCKETS = 1024
ROUNDS = 40
#: Groups whose state is broadcast; beyond, it is joined by group.
BROADCAST = 10_000


def by_group(rows: DataFrame, state: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """``rows`` with the state of their group, which may be null; ``n`` is the number of groups."""
    names = [f"_g{i}" for i in range(len(keys))]
    side = state.withColumnsRenamed(dict(zip(keys, names)))
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(x)) for k, x in zip(keys, names)])
    return rows.join(F.broadcast(side) if n <= BROADCAST else side, same).drop(*names)


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """0 to BUCKETS - 1, by where v lies from lo to hi; infinite values have buckets of their own."""
    infinite = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    apart = F.when(v == float("-inf"), 0).when(F.isnan(v), BUCKETS - 1).when(v == float("inf"), BUCKETS - 2).otherwise(1)
    width = hi - lo  # halves, where it leaves the doubles
    share = F.when(infinite(width), F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)).otherwise(F.try_divide(v - lo, width))
    return F.when(infinite(lo) | infinite(hi), apart).otherwise(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).cast("int")


def nth(rows: DataFrame, keys: Sequence[str], value: str, rank: Column) -> DataFrame:
    """(keys, nth): the value at place ``rank`` (from 0, over a column ``n``: the values of the group) in order.

    Nulls are left out.  A group of up to SORTED values is sorted; of a larger one counts by
    bucket of its range tell in which bucket the place lies, and that bucket's own least and
    largest value are the next range, until it has few values or one.  Infinite values count, and NaN
    is the largest; a place beyond the group gives no row.
    """
    keys = list(keys)
    values = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    first = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    first = first.withColumn("place", rank.cast("long")).where((F.col("place") >= 0) & (F.col("place") < F.col("n")))
    state = graph.checkpoint(first.withColumn("left", F.col("n")).select(*keys, "lo", "hi", "place", "left"))
    groups = state.count()
    wide = (F.col("left") > SORTED) & (F.col("lo") < F.col("hi"))
    for _ in range(ROUNDS):
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        inside = by_group(values, open_, keys, groups).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy(*keys, "place", _bucket(F.col("_v"), F.col("lo"), F.col("hi")).alias("_b")).agg(F.count(F.lit(1)).alias("left"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("left").over(W.partitionBy(*keys).orderBy("_b"))
        found = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("place")) & (F.col("_upto") - F.col("left") <= F.col("place")))
        cut = found.withColumn("place", F.col("place") - F.col("_upto") + F.col("left")).select(*keys, "lo", "hi", "place", "left")
        state = graph.checkpoint(state.where(~wide).unionByName(cut))
    else:
        if not state.where(wide).isEmpty():
            raise RuntimeError(f"nth: values are left after {ROUNDS} rounds")
    one = state.where("lo = hi").select(*keys, F.col("lo").alias("nth"))
    few = state.where("lo < hi")
    inside = by_group(values, few, keys, groups).where(F.col("_v").between(F.col("lo"), F.col("hi")))
    listed = inside.groupBy(*keys).agg(F.get(F.array_sort(F.collect_list("_v")), F.first("place").cast("int")).alias("nth"))
    return one.unionByName(listed)


def previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``previous``: the value of the row before within its group.

    Rows are range-partitioned by group and order, so a group of any size spreads; the row before the first
    one of a partition is the last one of an earlier partition.
    """
    sorted_ = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = graph.checkpoint(sorted_.withColumn("_part", F.spark_partition_id()))
    within = W.partitionBy("_part", *keys).orderBy(*order)
    seen = placed.withColumns({"_near": F.lag(F.struct(value)).over(within), "_last": F.lead(F.lit(True)).over(within).isNull()})
    seen = graph.checkpoint(seen)
    # one row a partition and group that meet: partitions and groups together
    ends = seen.where("_last").select(*keys, "_part", F.struct(value).alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(W.partitionBy(*keys).orderBy("_part"))).select(*keys, "_part", "_before").where("_before IS NOT NULL")
    names = {k: f"_g{i}" for i, k in enumerate(keys)}
    side = before.withColumnsRenamed(names | {"_part": "_p"})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(x)) for k, x in names.items()], F.col("_part") == F.col("_p"))
    joined = seen.join(side, same, "left")
    return joined.withColumn("previous", F.coalesce("_near", "_before")[value]).drop("_near", "_before", "_last", "_part", "_p", *names.values())


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) within their group in ``order``; ties are numbered in any order.

    Each partition of the range-partitioned rows numbers its own, on from the rows of the group in earlier ones.
    """
    sorted_ = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = graph.checkpoint(sorted_.withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(*keys).orderBy("_part")) - F.col("_rows")
    names = {k: f"_g{i}" for i, k in enumerate(keys)}
    # one row a partition and group that meet
    side = counts.withColumn("_before", before).where("_before > 0").drop("_rows").withColumnsRenamed(names | {"_part": "_p"})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(x)) for k, x in names.items()], F.col("_part") == F.col("_p"))
    own = placed.withColumn("_own", F.row_number().over(W.partitionBy("_part", *keys).orderBy(*order)))
    joined = own.join(side, same, "left").withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_own")).cast("long"))
    return joined.drop("_before", "_own", "_part", "_p", *names.values())


#: Bits of a seeded hash, and of its buckets.
HASH_BITS, BUCKET_BITS = 32, 10


def seeded(seed: int, *columns: str) -> Column:
    """HASH_BITS bits (long) of a row, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 64 - HASH_BITS)


def first_by_hash(rows: DataFrame, stratum: Sequence[str], targets: Column, order: Sequence[str], seed: int) -> DataFrame:
    """The first rows of every stratum in the order of a seeded hash, ties by ``order``; as many as ``targets``.

    ``targets`` is a Column over ``n``, the rows of the stratum.  Counts by bucket of the hash tell the bucket where
    the target is reached; rows of the buckets before it are taken, and that bucket's rows alone are ranked.
    """
    stratum = list(stratum)
    marked = rows.withColumn("_u", seeded(seed, *order)).withColumn("_b", F.shiftright("_u", HASH_BITS - BUCKET_BITS))
    counts = graph.checkpoint(marked.groupBy(*stratum, "_b").agg(F.count(F.lit(1)).alias("_c")))
    total = graph.checkpoint(counts.groupBy(*stratum).agg(F.sum("_c").alias("n")).withColumn("_want", targets.cast("long")))
    upto = counts.withColumn("_upto", F.sum("_c").over(W.partitionBy(*stratum).orderBy("_b")))
    edge = by_group(upto, total, stratum, total.count()) if stratum else upto.crossJoin(F.broadcast(total))  # one row
    edge = edge.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_c") < F.col("_want")))
    edge = graph.checkpoint(edge.select(*stratum, F.col("_b").alias("_edge"), (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_room")))
    whole = graph.checkpoint(total.where(F.col("_want") > F.col("n")).select(*stratum, F.lit(1 << BUCKET_BITS).cast("long").alias("_edge"), F.lit(0).cast("long").alias("_room")))
    state = edge.unionByName(whole)
    joined = by_group(marked, state, stratum, state.count()) if stratum else marked.crossJoin(F.broadcast(state))
    sure = joined.where(F.col("_b") < F.col("_edge"))
    close = joined.where(F.col("_b") == F.col("_edge"))
    ranked = close.withColumn("_k", F.row_number().over(W.partitionBy(*stratum, "_b").orderBy("_u", *order))).where(F.col("_k") <= F.col("_room")).drop("_k")
    return sure.unionByName(ranked).select(*rows.columns)
