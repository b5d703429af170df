"""Hard negatives by distributed radix selection over integer scores.

Anchors are a stated query set, taken in blocks of a bounded size; every block meets all
rows where they lie, so rows are not shuffled.  A *window* asks for the best ``need``
rows of one anchor whose score lies between two bounds and whose label is the anchor's own, or is
not.  Its scores are counted by a digit of their distance to the upper bound: every task
adds a histogram in memory, Spark sums them, and the bucket that holds the last wanted
row is cut by the next digit, until few rows stand above its end or the digits are
spent.  Then only rows at or above the cut are gathered, at most ``need`` from a task, and
ordered.  Both steps are such windows: positives (all scores, same label), then negatives
(0.8 of the positive's score up to the score, other labels), five windows an anchor.

A task need not tell of buckets below those that hold its own first ``need`` rows: the
wanted one is never lower.  The driver holds one bucket a window of the block.

Results that are defined: rows with a null id, label or vector, or a null or non-finite
component, take no part; components beyond 64 bits become the end of that range, and so
do scores; vectors of different lengths do not meet, and a vector without components scores 0; ties go
to the smaller id; of several rows with one id the least (label, vector) is the row; no
positives, or a negative positive score (an empty window), give no rows; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import checkpoint, floats, table
from .exact import HIGH, LOW, inner, quantised

POSITIVES = 5
NEGATIVES = 5
#: A negative scores this share of its positive at least, as a fraction.
SHARE = (4, 5)
#: Bits of a digit.
DIGIT = 8
#: Numbers of the anchors of a block on average.
BLOCK = 1 << 18
#: Refining ends where a cut is met by so many rows.
GATHER = 64
#: Scores that are compared at once.
CELLS = 1 << 21


@dataclass(frozen=True)
class Anchors:
    """A block's anchors of one length."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


@dataclass(frozen=True)
class Windows:
    """Rows wanted: of anchor ``of``, scores from ``low`` to ``high``, now cut to a bucket from ``cut`` to ``top``."""

    of: np.ndarray
    tag: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    need: int
    cut: np.ndarray
    top: np.ndarray
    left: np.ndarray
    shift: np.ndarray
    done: np.ndarray

    @classmethod
    def asked(cls, of: np.ndarray, tag: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, need: int) -> Windows:
        """``tag`` is a number that comes back with the rows."""
        bits = np.array([max(1, (int(b) - int(a)).bit_length()) for a, b in zip(low, high)], int)
        n = len(of)
        return cls(of, tag, low, high, same, need, low, high, np.full(n, need), np.maximum(bits - DIGIT, 0), np.zeros(n, bool))

    def refined(self, found: list[tuple[int, int, int, int]]) -> Windows:
        """Open windows cut to the bucket of the last wanted row; ``found``: (window, bucket, rows before, rows in it)."""
        cut, top, left, shift = (x.copy() for x in (self.cut, self.top, self.left, self.shift))
        done = np.ones(len(cut), bool)  # a window of fewer rows than wanted takes them all
        for w, bucket, before, rows in found:
            top[w] = int(self.top[w]) - (bucket << int(self.shift[w]))
            cut[w] = max(int(self.cut[w]), int(top[w]) - (1 << int(self.shift[w])) + 1)
            left[w] = self.left[w] - before
            done[w] = self.shift[w] == 0 or self.need - left[w] + rows <= GATHER
            shift[w] = max(0, self.shift[w] - DIGIT)
        return replace(self, cut=cut, top=top, left=left, shift=shift, done=done)


def usable(embedding: str) -> Column:
    """The vector has finite components only."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(embedding).isNotNull() & ~bad


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: ids, labels and integer vectors of the rows that take part."""
    column = batch.column(2)
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for dim in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == dim)
        m = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(dim)).astype(float)
        good = np.isfinite(m).all(axis=1)
        if good.any():
            yield int(dim), ids[rows[good]], labels[rows[good]], quantised(m[good])


def _met(batches: Iterator[pa.RecordBatch], block: dict[int, tuple[Anchors, Windows]], last: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, window, id, score) of all rows in the buckets of the open windows; ``last``: from the cut up, of all windows."""
    for batch in batches:
        for dim, ids, labels, x in _rows(batch):
            if dim not in block:
                continue
            anchors, windows = block[dim]
            low, high = windows.cut, windows.high if last else windows.top
            where = np.flatnonzero(~windows.done | last)
            if not len(where):
                continue
            # windows of one anchor follow each other
            order = where[np.argsort(windows.of[where], kind="stable")]
            asked, begin, count = np.unique(windows.of[order], return_index=True, return_counts=True)
            least = np.minimum.reduceat(low[order], begin)
            most = np.maximum.reduceat(high[order], begin)
            step = max(1, CELLS // len(asked))
            for at in range(0, len(ids), step):
                part = slice(at, at + step)
                s = inner(anchors.vectors[asked], x[part])
                alike = anchors.labels[asked][:, None] == labels[part][None]
                met = (s >= least[:, None]) & (s <= most[:, None]) & (alike if windows.same else ~alike)
                if windows.same:
                    met &= anchors.ids[asked][:, None] != ids[part][None]
                i, j = np.nonzero(met)
                score = s[i, j]
                for k in range(int(count.max())):
                    own = np.flatnonzero(count[i] > k)
                    w = order[begin[i[own]] + k]
                    v = score[own]
                    inside = (v >= low[w]) & (v <= high[w])
                    yield dim, w[inside], ids[part][j[own[inside]]], v[inside]


def histograms(rows: DataFrame, block: dict[int, tuple[Anchors, Windows]]) -> DataFrame:
    """(dim, window, left, bucket, rows): how many scores of every open window fall in a bucket, best first."""
    size = 1 << DIGIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {dim: np.zeros(len(w.of) * size, np.int64) for dim, (_, w) in block.items()}
        for dim, w, _, score in _met(batches, block, False):
            windows = block[dim][1]
            far = windows.top[w].astype(np.uint64) - score.astype(np.uint64)
            bucket = (far >> windows.shift[w].astype(np.uint64)).astype(np.int64)
            held[dim] += np.bincount(w * size + bucket, minlength=len(held[dim]))
        for dim, counts in held.items():
            counts = counts.reshape(-1, size)
            before = np.cumsum(counts, axis=1) - counts
            left = block[dim][1].left
            i, j = np.nonzero((counts > 0) & (before < left[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(left[i], pa.int32()), pa.array(j, pa.int32()), pa.array(counts[i, j])],
                names=["dim", "window", "left", "bucket", "rows"],
            )

    return rows.mapInArrow(run, "dim int, window int, left int, bucket int, rows long")


def _last_buckets(counted: DataFrame) -> DataFrame:
    """(dim, window, bucket, before, rows): the bucket where the last wanted row of every window lies."""
    summed = counted.groupBy("dim", "window", "left", "bucket").agg(F.sum("rows").alias("rows"))
    upto = F.sum("rows").over(W.partitionBy("dim", "window").orderBy("bucket"))
    before = summed.withColumn("before", upto - F.col("rows"))
    return before.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("rows") >= F.col("left")))


def gathered(rows: DataFrame, block: dict[int, tuple[Anchors, Windows]]) -> DataFrame:
    """(anchor_id, tag, high, vec_id, score, rank): the wanted rows of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim, w, ids, score in _met(batches, block, True):
            if dim in held:
                w, ids, score = (np.concatenate([a, b]) for a, b in zip(held[dim], (w, ids, score)))
            order = np.lexsort((ids, ~score, w))  # ~ turns the order and never overflows
            w, ids, score = w[order], ids[order], score[order]
            first = np.arange(len(w)) - np.searchsorted(w, w) < block[dim][1].need
            held[dim] = w[first], ids[first], score[first]
        for dim, (w, ids, score) in held.items():
            anchors, windows = block[dim]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (anchors.ids[windows.of[w]], windows.tag[w], windows.high[w], ids, score)],
                names=["anchor_id", "tag", "high", "vec_id", "score"],
            )

    found = rows.mapInArrow(run, "anchor_id long, tag long, high long, vec_id long, score long")
    need = max((w.need for _, w in block.values()), default=0)
    best = W.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= need)


def select(rows: DataFrame, block: dict[int, tuple[Anchors, Windows]]) -> DataFrame:
    """Radix selection of all windows of a block over all ``rows(vec_id, label, v)``."""
    while not all(w.done.all() for _, w in block.values()):
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for r in _last_buckets(histograms(rows, block)).collect():  # one row a window of the block
            found.setdefault(r["dim"], []).append((r["window"], r["bucket"], r["before"], r["rows"]))
        block = {dim: (a, w.refined(found.get(dim, []))) for dim, (a, w) in block.items()}
    return gathered(rows, block)


def _positives(anchors: Anchors, reach: int) -> Windows:
    n = len(anchors.ids)
    norms = np.linalg.norm(anchors.vectors.astype(float), axis=1)
    ends = [min(HIGH, (int(own * 1.000001) + 1) * reach) for own in norms]  # no product is larger than that of the norms
    return Windows.asked(np.arange(n), np.zeros(n, np.int64), np.array([max(LOW, -e) for e in ends], np.int64), np.array(ends, np.int64), True, POSITIVES)


def _negatives(anchors: Anchors, found: list[tuple[int, int, int]]) -> Windows:
    """A window for each (anchor id, positive id, score); a negative score leaves none."""
    at = {int(a): k for k, a in enumerate(anchors.ids)}
    asked = [(at[a], p, s) for a, p, s in found if s >= 0]
    of, tag, high = (np.array([x[k] for x in asked], np.int64) for k in range(3))
    return Windows.asked(of, tag, high - high * (SHARE[1] - SHARE[0]) // SHARE[1], high, False, NEGATIVES)


def _one_row_an_id(rows: DataFrame) -> DataFrame:
    """Of several usable rows with one id the least; others are not touched."""
    good = rows.where(usable("v"))
    several = checkpoint(good.groupBy("vec_id").count().where(F.col("count") > 1).select("vec_id"))
    if several.isEmpty():
        return rows
    least = good.join(several, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return checkpoint(good.join(several, "vec_id", "left_anti").unionByName(least.select("vec_id", "r.label", "r.v")))


def _blocks(rows: DataFrame, is_anchor: Column) -> Iterator[dict[int, Anchors]]:
    """Anchors in blocks of about ``BLOCK`` numbers, dealt by a hash of the id."""
    asked = rows.where(is_anchor & usable("v"))
    numbers = asked.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    blocks = -(-numbers // BLOCK)
    for b in range(blocks):
        own: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect():
            own.setdefault(len(r["v"]), []).append((r["vec_id"], r["label"], r["v"]))
        yield {
            dim: Anchors(np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.int64), quantised(np.array([r[2] for r in some], float).reshape(len(some), dim)))
            for dim, some in own.items()
        }


def mine(df: DataFrame, is_anchor: Column) -> DataFrame:
    """Hard negatives of every row of ``df(vec_id, label, embedding)`` where ``is_anchor`` (over vec_id) holds.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    """
    rows = _one_row_an_id(
        df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), floats(df, "embedding").alias("v")
        )
    )
    longest = rows.where(usable("v")).agg(F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + F.pow(F.abs(x) * 256 + 1, F.lit(2.0))))).first()[0]
    reach = int(min((longest or 0.0) ** 0.5, 2.0**70) * 1.000001) + 1  # above the norm of any integer vector
    out = []
    for anchors in _blocks(rows, is_anchor):
        found = select(rows, {dim: (a, _positives(a, reach)) for dim, a in anchors.items()})
        own: dict[int, list[tuple[int, int, int]]] = {}
        at = {int(i): dim for dim, a in anchors.items() for i in a.ids}
        for r in found.collect():  # POSITIVES rows an anchor of the block
            own.setdefault(at[r["anchor_id"]], []).append((r["anchor_id"], r["vec_id"], r["score"]))
        out.append(select(rows, {dim: (anchors[dim], _negatives(anchors[dim], some)) for dim, some in own.items()}))
    if len(out) > 1:
        out = [checkpoint(x) for x in out]  # a plan holds one block's anchors at most
    schema = "anchor_id long, tag long, high long, vec_id long, score long, rank int"
    whole = out[0] if out else df.sparkSession.createDataFrame([], schema)
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.select(
        "anchor_id", F.col("tag").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of every id that 100 divides."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    mixed = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(mixed, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
