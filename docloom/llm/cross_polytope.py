"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) sends a
vector to the nearest signed axis: one hash.  A table concatenates as many hashes as
keep about ``BUCKET`` vectors in a bucket however many there are; the last one uses
fewer axes.  Each of ``TABLES`` tables holds every vector.  A query probes the most
promising buckets of each table; all vectors in them are candidates and are reranked by
their inner product in double precision, summed in the order of components, so scores
don't depend on how rows are dealt.

Vectors are indexed by bands: one length, and norms of a ratio of ``RATIO`` at most; a
query probes every band of its length, and within one, direction tells the inner product.
Bands of fewer than ``FEW`` vectors are put together and searched whole.  How many
buckets of a band are probed is measured, by one rule for any number of rows: ``SAMPLE``
queries are searched exactly, and as many buckets are probed as find ``TARGET`` of their
neighbours, ``PROBES`` a level at least.  A query that still has fewer than k is searched
exactly.

Buckets are dealt in *shards* of ``SHARD`` neighbouring buckets.  A vector is shuffled
once for each table, as it is stored; a query goes to a shard once, with a bit for each
bucket that it probes there.  A shard of more than ``COMPONENTS`` numbers is cut into chunks
that each of its queries visits, so a task holds a bounded part of a bucket.

Equal vectors are one entry of the index with their ``k + 1`` smallest ids (no more can
be among the nearest), and equal query vectors are searched once, so a vector that a
third of all rows share is one row.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part; vectors of different lengths are no candidates for each other; repeated rows
count once; of several different vectors with one id the one whose hash is least counts;
fewer candidates than k give fewer rows; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import checkpoint, table

TABLES = 2
#: Buckets of a table that a query visits at least, for every level of hashes.
PROBES = 8
#: Largest norm of a band over its least one.
RATIO = 1.25
#: Share of the nearest that the probes find of the sampled queries, and how many are sampled.
TARGET = 0.95
SAMPLE = 100
#: Bands of fewer vectors are searched whole, together.
FEW = 256
#: Vectors that an average bucket holds.
BUCKET = 100
#: Buckets of a shard, a multiple of 8.
SHARD = 256
#: Numbers of a shard that one task holds.
COMPONENTS = 1 << 22
#: Broadcast the table of large shards, or of equal vectors, up to so many rows; else a join by key.
BROADCAST = 100_000
#: Queries that are compared with a shard at once.
STEP = 4096
#: Combinations of axes that are compared at once in the search for the best probes.
COMPARED = 1 << 21


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n, dtype=x.dtype)


@dataclass(frozen=True)
class Hasher:
    """Seeded tables for vectors of ``dim`` components; ``axes`` of every level of a table."""

    dim: int
    axes: tuple[int, ...]
    tables: int = TABLES
    seed: int = 5

    @classmethod
    def sized(cls, dim: int, rows: int, **more) -> Hasher:
        """Levels for so many rows."""
        full = 1 << max(0, dim - 1).bit_length()
        axes, buckets = [full], 2 * full
        while rows > 1.5 * BUCKET * buckets:
            last = 1
            while last < full and buckets * 2 * last * BUCKET < rows:
                last *= 2
            axes.append(last)
            buckets *= 2 * last
        return cls(dim, tuple(axes), **more)

    @property
    def size(self) -> int:
        """Buckets of a table."""
        return int(np.prod([2 * a for a in self.axes]))

    def _rotated(self, x: np.ndarray, t: int, level: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, t, level])
        for signs in rng.choice(np.array([-1, 1], np.float32), (3, x.shape[1])):
            x = hadamard(x * signs)
        return x[:, : self.axes[level]]

    def _padded(self, v: np.ndarray) -> np.ndarray:
        x = np.zeros((len(v), self.axes[0]), np.float32)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        x[:, : self.dim] = v / np.linalg.norm(v, axis=1, keepdims=True)
        return x

    def buckets(self, v: np.ndarray) -> Iterator[np.ndarray]:
        """Per table: (rows, levels) signed axes, axis * 2 + (value < 0)."""
        x = self._padded(v)
        for t in range(self.tables):
            out = []
            for level in range(len(self.axes)):
                r = self._rotated(x, t, level)
                axis = np.abs(r).argmax(axis=1)
                out.append(axis * 2 + (r[np.arange(len(r)), axis] < 0))
            yield np.stack(out, axis=1)

    def probes(self, v: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Per table: (rows, up to n, levels), the buckets of least squared distance to the best."""
        x = self._padded(v)
        step = max(1, COMPARED // (n * min(n, 2 * self.axes[0])))
        for t in range(self.tables):
            rotated = [self._rotated(x, t, level) for level in range(len(self.axes))]
            yield np.concatenate([self._best([r[at : at + step] for r in rotated], n) for at in range(0, len(x), step)])

    @staticmethod
    def _best(rotated: list[np.ndarray], n: int) -> np.ndarray:
        cost, picks = np.zeros((len(rotated[0]), 1)), np.zeros((len(rotated[0]), 1, 0), np.int64)
        for r in rotated:
            both = np.concatenate([r, -r], axis=1)
            m = min(n, both.shape[1])  # the n best use no more of a level
            order = np.argsort(-both, axis=1)[:, :m]
            value = np.take_along_axis(both, order, 1).astype(float)
            signed = order % r.shape[1] * 2 + (order >= r.shape[1])
            more = (value[:, :1] - value) ** 2
            cost = (cost[:, :, None] + more[:, None, :]).reshape(len(r), -1)
            keep = np.argsort(cost, axis=1, kind="stable")[:, :n]
            left = np.take_along_axis(picks, (keep // m)[:, :, None], 1)
            right = np.take_along_axis(signed, keep % m, 1)[:, :, None]
            picks = np.concatenate([left, right], axis=2)
            cost = np.take_along_axis(cost, keep, 1)
        return picks


@dataclass(frozen=True)
class Band:
    """Vectors of one length and of similar norm: how they are hashed and how many buckets a query visits.

    No hasher: one bucket.
    """

    dim: int
    hasher: Hasher | None = None
    visits: int = 1


def _codes(levels: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    """The bucket of a table as one integer."""
    out = np.zeros(levels.shape[:-1], np.int64)
    for i, n in enumerate(axes):
        out = out * (2 * n) + levels[..., i]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _joined(df: DataFrame, side: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join with a checkpointed side table, broadcast while it is known to be small."""
    return df.join(F.broadcast(side) if side.count() <= BROADCAST else side, on, how)


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, hash, more, dim, step): vectors that take part, floats as they are and other numbers as doubles.

    (hash, more) is a 128-bit hash of the components, step tells the norm.
    """
    kind = "array<float>" if df.schema[embedding].dataType.elementType.typeName() == "float" else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]):
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                m = _matrix(part.column(1), int(dim))
                good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                m = np.ascontiguousarray(m[good]) + 0  # one zero
                top = np.abs(m).max(axis=1, keepdims=True).astype(float)
                norm = np.log(top[:, 0]) + np.log(((m / top) ** 2).sum(axis=1)) / 2
                marks = np.array([divmod(xxhash.xxh3_128_intdigest(x), 1 << 64) for x in m], np.uint64).reshape(-1, 2).view(np.int64)
                offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).filter(pa.array(good)),
                        pa.ListArray.from_arrays(offsets, pa.array(m.ravel())),
                        pa.array(marks[:, 0]),
                        pa.array(marks[:, 1]),
                        pa.array(np.full(len(m), dim), pa.int32()),
                        pa.array(np.floor(norm / math.log(RATIO) + 0.5), pa.int32()),
                    ],
                    names=["vec_id", "v", "hash", "more", "dim", "step"],
                )

    rows = df.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v"))
    return rows.mapInArrow(run, f"vec_id long, v {kind}, hash long, more long, dim int, step int")


def _once(rows: DataFrame, several: DataFrame, same: DataFrame, is_query: Column) -> DataFrame:
    """A row of every distinct vector of ``rows``, with rep, members (null: the one id) and asks.

    ``rows`` has vectors or not; those that are there once are not shuffled.
    """
    if not several.isEmpty():
        rows = _joined(rows, several, ["vec_id"], "left").where(F.coalesce("_least", "hash") == F.col("hash")).drop("_least")
    if same.isEmpty():
        return rows.withColumns({"members": F.lit(None).cast("array<bigint>"), "asks": is_query}).withColumnRenamed("vec_id", "rep")
    found = _joined(rows, same, ["hash", "more"], "left")
    alone = found.where(F.col("members").isNull()).withColumn("asks", is_query)
    first = found.where(F.col("vec_id") == F.get("members", F.lit(0)))
    return alone.unionByName(first.dropDuplicates(["vec_id"])).withColumnRenamed("vec_id", "rep")


def _repeats(facts: DataFrame, several: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(hash, more, members, asks) of the vectors that are there twice or more: their k + 1 least ids, and whether one asks."""
    rows = facts.select("vec_id", "hash", "more", is_query.alias("asks"))
    if not several.isEmpty():
        rows = _joined(rows, several, ["vec_id"], "left").where(F.coalesce("_least", "hash") == F.col("hash")).drop("_least")
    sizes = rows.groupBy("hash", "more").agg(F.count(F.lit(1)).alias("_rows"), F.max("asks").alias("asks")).where(F.col("_rows") > 1)
    sizes = checkpoint(sizes.drop("_rows"))
    few = W.partitionBy("hash", "more").orderBy("vec_id")
    ids = _joined(rows.drop("asks"), sizes, ["hash", "more"], "inner").withColumn("_n", F.dense_rank().over(few)).where(F.col("_n") <= k + 1)
    return checkpoint(ids.groupBy("hash", "more").agg(F.array_sort(F.collect_set("vec_id")).alias("members"), F.max("asks").alias("asks")))


def norm_bands(counts: dict[int, int]) -> list[tuple[list[int], int]]:
    """(steps of norm, vectors) of every band from ``counts`` by step; small ones are one band."""
    out = [([step], n) for step, n in sorted(counts.items()) if n >= FEW]
    small = [step for step, n in sorted(counts.items()) if n < FEW]
    return out + ([(small, sum(counts[s] for s in small))] if small else [])


def _by_band(batch: pa.RecordBatch, step: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    for at in range(0, batch.num_rows, step):
        some = batch.slice(at, step)
        of = some.column(2).to_numpy()
        for g in np.unique(of):
            yield int(g), some.take(pa.array(np.flatnonzero(of == g)))


def index_rows(entries: DataFrame, bands: list[Band], tables: int) -> DataFrame:
    """(t, shard, code, rep, v): every entry in every table of its band; ``t`` counts tables over all bands."""
    width = SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, part in _by_band(batch, 2000):
                n, hasher = part.num_rows, bands[g].hasher
                found = hasher.buckets(_matrix(part.column(1), hasher.dim)) if hasher else [np.zeros((n, 1), np.int64)]
                for t, levels in enumerate(found):
                    code = _codes(levels, hasher.axes if hasher else (1,))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, g * tables + t), pa.int32()), pa.array(code // width), pa.array(code), part.column(0), part.column(1)],
                        names=["t", "shard", "code", "rep", "v"],
                    )

    schema = f"t int, shard long, code long, rep long, v {entries.schema['v'].dataType.simpleString()}"
    return entries.select("rep", "v", "band").mapInArrow(run, schema)


def probe_rows(queries: DataFrame, bands: list[Band], tables: int) -> DataFrame:
    """(t, shard, probed, rep, v): every query at every shard that it probes, with a bit for each of its buckets."""
    width = SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, part in _by_band(batch, 500):
                for g, band in enumerate(bands):
                    if band.dim != bands[own].dim:
                        continue
                    hasher = band.hasher
                    sought = hasher.probes(_matrix(part.column(1), band.dim), band.visits) if hasher else [np.zeros((part.num_rows, 1, 1), np.int64)]
                    for t, picks in enumerate(sought):
                        codes = _codes(picks, hasher.axes if hasher else (1,))
                        shards = int(codes.max()) // width + 1
                        at = np.arange(len(codes))[:, None] * shards + codes // width
                        visited, where = np.unique(at, return_inverse=True)
                        bits = np.zeros((len(visited), width), bool)
                        bits[where.ravel(), codes.ravel() % width] = True
                        taken = part.take(pa.array(visited // shards))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(bits), g * tables + t), pa.int32()),
                                pa.array(visited % shards),
                                pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary()),
                                taken.column(0),
                                taken.column(1),
                            ],
                            names=["t", "shard", "probed", "rep", "v"],
                        )

    schema = f"t int, shard long, probed binary, rep long, v {queries.schema['v'].dataType.simpleString()}"
    return queries.select("rep", "v", "band").mapInArrow(run, schema)


def _sampled(entries: DataFrame, queries: DataFrame, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the sampled queries; of every exact neighbour its query's place, band and vector."""
    rows = queries.select("v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    asked = np.array([r["v"] for r in rows], float).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_numpy()
            if not len(reps):
                continue
            scores = asked @ _matrix(batch.column(1), dim).astype(float).T
            n = min(k, len(reps))
            best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(asked)), n), pa.int32()),
                    pa.array(reps[best].ravel(), pa.int64()),
                    pa.array(np.take_along_axis(scores, best, 1).ravel(), pa.float64()),
                ],
                names=["q", "rep", "score"],
            )

    near = entries.select("rep", "v").mapInArrow(run, "q int, rep long, score double")
    near = near.withColumn("_n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("_n") <= k)
    # SAMPLE * k rows at most
    found = entries.select("rep", "band", "v").join(F.broadcast(near.select("q", "rep")), "rep").select("q", "band", "v").collect()
    return asked, np.array([r["q"] for r in found], int), np.array([r["band"] for r in found], int), np.array([r["v"] for r in found], float).reshape(-1, dim)


def visits_for(hasher: Hasher, asked: np.ndarray, of: np.ndarray, near: np.ndarray, least: int) -> int:
    """Buckets a table, ``least`` or more, that find TARGET of the vectors ``near`` of the queries ``asked[of]``."""
    least = min(least, hasher.size)
    if not len(near):
        return least
    holds = [_codes(x, hasher.axes) for x in hasher.buckets(near)]
    n = least
    while True:
        rank = np.full(len(near), hasher.size)
        for at, picks in zip(holds, hasher.probes(asked, n)):
            hit = _codes(picks, hasher.axes)[of] == at[:, None]
            rank = np.where(hit.any(axis=1), np.minimum(rank, hit.argmax(axis=1)), rank)
        need = int(np.sort(rank)[math.ceil(len(rank) * TARGET) - 1]) + 1
        if need <= n or n >= hasher.size:
            return max(least, min(need, hasher.size))
        n = min(2 * n, hasher.size)


class Shard:
    """The entries of a chunk of a shard, in order of bucket."""

    def __init__(self, codes: list[np.ndarray], reps: list[np.ndarray], vectors: list[np.ndarray], width: int):
        code, rep = np.concatenate(codes), np.concatenate(reps)
        order = np.lexsort((rep, code))
        self.rep, self.v = rep[order], np.concatenate(vectors)[order].astype(float)
        self.norm = float(np.linalg.norm(self.v, axis=1).max())
        held, self.begin = np.unique(code[order], return_index=True)
        self.end, self.held = np.append(self.begin[1:], len(code)), held % width

    def nearest(self, q: np.ndarray, bits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, rep, score): the k best of each row of ``q`` in the buckets of its ``bits``."""
        best = np.full((len(q), k), -np.inf)
        # products of a block differ from sums in order by rounding: what is this close stays
        slack = 1e-12 * np.linalg.norm(q, axis=1) * self.norm
        least = best[:, 0] - slack
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for bucket, a, b in zip(self.held, self.begin, self.end):
            rows = np.flatnonzero(bits[:, bucket])
            if not len(rows):
                continue
            s = q[rows] @ self.v[a:b].T
            near = s >= least[rows][:, None]
            some = near.any(axis=1)
            if not some.any():
                continue
            i, j = np.nonzero(near)
            found.append((rows[i], a + j, s[i, j]))
            rows = rows[some]
            both = np.concatenate([best[rows], s[some]], axis=1)
            best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            least[rows] = best[rows, 0] - slack[rows]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, j, s = (np.concatenate(x) for x in zip(*found))
        keep = s >= least[i]
        i, j = i[keep], j[keep]
        score = np.zeros(len(i))
        for d in range(q.shape[1]):  # in order, whatever the block
            score += q[i, d] * self.v[j, d]
        order = np.lexsort((self.rep[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        return i[keep], self.rep[j[keep]], score[keep]


def _rerank(pairs: DataFrame, bands: list[Band], tables: int, k: int) -> DataFrame:
    """(query, rep, score): the k best of every query in every chunk of a shard.

    ``pairs(t, shard, chunk, kind, code, probed, rep, v)`` is sorted by chunk, entries
    (kind 0) before queries (kind 1); a task holds one chunk's entries at a time.
    """
    width = SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                dim = bands[keys[a][0] // tables].dim
                if key != tuple(keys[a][:3]):
                    key, held, shard = tuple(keys[a][:3]), [], None
                if keys[a][3] == 0:
                    held.append((part.column(4).to_numpy(), part.column(6).to_numpy(), _matrix(part.column(7), dim)))
                    continue
                if not held:
                    continue
                shard = shard or Shard(*map(list, zip(*held)), width)
                for at in range(0, part.num_rows, STEP):
                    some = part.slice(at, STEP)
                    bits = np.frombuffer(b"".join(some.column(5).to_pylist()), np.uint8).reshape(some.num_rows, width // 8)
                    i, rep, score = shard.nearest(_matrix(some.column(7), dim).astype(float), np.unpackbits(bits, axis=1).astype(bool), k)
                    yield pa.RecordBatch.from_arrays([pa.array(some.column(6).to_numpy()[i]), pa.array(rep), pa.array(score)], names=["query", "rep", "score"])

    return pairs.mapInArrow(run, "query long, rep long, score double")


def _search(entries: DataFrame, queries: DataFrame, bands: list[Band], tables: int, k: int) -> DataFrame:
    """(query, rep, score): the k + 1 best entries in the buckets that every query visits."""
    index = index_rows(entries, bands, tables)
    most = max(1, COMPONENTS // max((b.dim for b in bands), default=1))
    large = index.groupBy("t", "shard").count().where(F.col("count") > most)
    large = checkpoint(large.select("t", "shard", F.ceil(F.col("count") / most).cast("int").alias("chunks")))
    asks = probe_rows(queries, bands, tables)
    if large.isEmpty():
        index, asks = (x.withColumn("chunks", F.lit(1)) for x in (index, asks))
    else:
        index, asks = (_joined(x, large, ["t", "shard"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))) for x in (index, asks))
    held = index.select(
        "t", "shard", F.pmod(F.xxhash64("rep"), "chunks").cast("int").alias("chunk"), F.lit(0).alias("kind"),
        "code", F.lit(None).cast("binary").alias("probed"), "rep", "v",
    )
    asks = asks.select(
        "t", "shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"),
        F.lit(0).cast("long").alias("code"), "probed", "rep", "v",
    )
    key = ["t", "shard", "chunk"]
    pairs = held.unionByName(asks).repartition(*key).sortWithinPartitions(*key, "kind")
    found = _rerank(pairs, bands, tables, k + 1).groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = W.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")


def _lists(found: DataFrame, same: DataFrame, k: int) -> DataFrame:
    """(query, near): the k + 1 nearest rows, ties to the smaller id."""
    if same.isEmpty():
        ids = found.select("query", "score", F.col("rep").alias("vec_id"))
    else:
        members = same.select(F.get("members", F.lit(0)).alias("rep"), "members")
        ids = _joined(found, members, ["rep"], "left").select("query", "score", F.explode(F.coalesce("members", F.array("rep"))).alias("vec_id"))
    ordered = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1)
    return ids.groupBy("query").agg(ordered.alias("near"))


def nearest(df: DataFrame, is_query: Column, k: int = 20, probes: int = PROBES, tables: int = TABLES) -> DataFrame:
    """The k nearest found of every row where ``is_query`` (a Column over vec_id) holds.

    Returns (query_id, rank, vec_id, score), nearest first, ties to the smaller id.
    """
    vectors = valid_vectors(df)
    facts = checkpoint(vectors.drop("v"))
    several = facts.groupBy("vec_id").agg(F.min("hash").alias("_least"), F.max("hash").alias("_most")).where("_least < _most")
    several = checkpoint(several.select("vec_id", "_least"))
    same = _repeats(facts, several, is_query, k)
    once = _once(facts, several, same, is_query)
    sizes = once.groupBy("dim", "step").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("members"), F.lit(1))).alias("ids")).collect()
    bands, number, ids = [], {}, {}
    for dim in sorted({r["dim"] for r in sizes}):
        ids[dim] = sum(r["ids"] for r in sizes if r["dim"] == dim)
        for of, n in norm_bands({r["step"]: r["n"] for r in sizes if r["dim"] == dim}):
            number |= {(dim, step): len(bands) for step in of}
            # several steps together are few vectors
            bands.append(Band(dim, Hasher.sized(dim, n, tables=tables) if n >= FEW and len(of) == 1 else None))

    def numbered(of: dict) -> Column:
        """The value of ``of`` for the row's length and norm; a literal of one entry a band."""
        named = F.create_map(*[F.lit(x) for (d, step), g in of.items() for x in (f"{d}:{step}", g)]) if of else F.create_map(F.lit(""), F.lit(0))
        return F.element_at(named, F.concat_ws(":", "dim", "step"))

    entries = _once(vectors, several, same, is_query).withColumn("band", numbered(number)).select("rep", "v", "dim", "band", "asks")
    queries = entries.where("asks")
    # the query rows of one vector share its search
    asked = facts.where(is_query)
    if not several.isEmpty():
        asked = _joined(asked, several, ["vec_id"], "left").where(F.coalesce("_least", "hash") == F.col("hash"))
    if same.isEmpty():
        asked = asked.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("rep"))
    else:
        asked = _joined(asked, same, ["hash", "more"], "left").select(F.col("vec_id").alias("query_id"), F.coalesce(F.get("members", F.lit(0)), "vec_id").alias("rep"))
    asked = checkpoint(asked.distinct())
    for dim in ids:
        mine = [g for g, b in enumerate(bands) if b.dim == dim and b.hasher]
        if mine:
            some = F.col("dim") == dim
            sample, of, band, near = _sampled(entries.where(some), queries.where(some), dim, k + 1)
            for g in mine:
                hasher = bands[g].hasher
                least = probes * len(hasher.axes)
                bands[g] = Band(dim, hasher, visits_for(hasher, sample, of[band == g], near[band == g], least) if len(sample) else least)
    found = _search(entries, queries, bands, tables, k)
    lists = checkpoint(_lists(found, same, k))
    enough = numbered({(d, 0): min(k + 1, n) for d, n in ids.items()})
    held = lists.select(F.col("query").alias("rep"), F.size("near").alias("_held"))
    wanted = once.where("asks").select("rep", "dim").join(held, "rep", "left").withColumn("step", F.lit(0))
    short = checkpoint(wanted.where(F.coalesce("_held", F.lit(0)) < enough).select("rep"))
    if not short.isEmpty():
        of = numbered({(d, 0): g for g, d in enumerate(ids)})
        whole = entries.withColumn("step", F.lit(0)).withColumn("band", of)
        rest = _search(whole, _joined(whole, short, ["rep"], "left_semi"), [Band(d) for d in ids], 1, k)
        lists = lists.join(short.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(_lists(rest, same, k))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    joined = asked.join(lists, asked["rep"] == lists["query"]).select("query_id", F.posexplode(others).alias("p", "x"))
    return joined.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
