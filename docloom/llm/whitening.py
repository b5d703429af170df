"""Embedding whitening from exact integer sums.

Components become integers (256 times, floored).  Every task gathers sums and
cross-products of its rows about one of them, moves them back exactly, and hands them on in
parts of 32 bits; Spark sums the parts, so nothing is rounded or overflows however many
rows there are.  ``n * X'X - S S'`` is formed in Python integers and only then becomes
double for ``eigh``; since that is exact only relative to the largest eigenvalue, the basis is
turned once more by the exact matrix and finished by Jacobi rotations, which keep small
eigenvalues to their own precision.

The fit list holds every distinct vector once.  Hashes are counted first (16 bytes a row,
combined before the shuffle); a vector whose hash is there once is used where it lies,
the others are compared whole.

Results that are defined: rows whose vector is null or holds null or non-finite entries are left out,
and so are vectors without entries; vectors of different lengths are fitted apart (the driver
holds one length squared); entries beyond 64 bits become the end of that range; repeated rows
count once in the fit and are all returned, as is a null id; a component whose eigenvalue is zero has no
whitened value (null) and takes no part in identity_error; vectors of fewer than four entries
have as many components; where trace is zero, explained is null; a deviation beyond 64 bits is
null and stands as text in deviation_large; an empty table gives an empty result; other
columns are not read by the query and travel along in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, floats, table
from .exact import objects, quantised, shifted_sums, squares

COMPONENTS = 4
#: Broadcast the hashes of repeated vectors up to so many; else a join by hash.
BROADCAST = 100_000
#: Bits of a part of a sum.
PART = 32
SWEEPS = 30
#: Fractional bits of a basis that turns the exact matrix.
FIXED = 60


def _vectors(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length: row numbers and integer vectors of the usable rows."""
    column = batch.column(at)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        m = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(dim))
        good = np.isfinite(m.astype(float)).all(axis=1)
        if good.any():
            yield rows[good], quantised(m[good])


def _hash(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    marks = np.array([divmod(xxhash.xxh3_128_intdigest(r), 1 << 64) for r in np.ascontiguousarray(x)], np.uint64).reshape(-1, 2)
    return marks[:, 0].view(np.int64), marks[:, 1].view(np.int64)


def integer_rows(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(hash, more, x) of the usable rows; x is the vector's integers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _vectors(batch, 0):
                a, b = _hash(x)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([r.tobytes() for r in x], pa.binary())], names=["hash", "more", "x"])

    return df.select(floats(df, embedding)).mapInArrow(run, "hash long, more long, x binary")


def fit_list(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(x): every distinct integer vector once."""
    rows = integer_rows(df, embedding)
    counted = rows.groupBy("hash", "more").count().where(F.col("count") > 1)
    again = checkpoint(counted.select("hash", "more", F.lit(True).alias("_again")))
    n = again.count()
    if not n:
        return rows.select("x")
    marked = rows.join(F.broadcast(again) if n <= BROADCAST else again, ["hash", "more"], "left")
    alone = marked.where(F.col("_again").isNull()).select("x")
    return alone.unionByName(marked.where("_again").select("x").distinct())


def _parts(value: int) -> Iterator[tuple[int, int]]:
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield k, sign * (value & ((1 << PART) - 1))
        value, k = value >> PART, k + 1


def scatter(vectors: DataFrame) -> DataFrame:
    """(dim, i, j, part, value): exact sums over ``vectors(x)`` in parts of 32 bits.

    i <= j: cross-products; j = -1: sums; i = j = -1: the number of vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            sizes = pc.binary_length(batch.column(0)).to_numpy() // 8
            for dim in np.unique(sizes):
                own = batch.column(0).filter(pa.array(sizes == dim))
                x = np.frombuffer(b"".join(own.to_pylist()), np.int64).reshape(-1, int(dim))
                s, c = shifted_sums(x)
                n, s0, c0 = held.get(int(dim), (0, 0, 0))
                held[int(dim)] = [n + len(x), s0 + s, c0 + c]
        out = []
        for dim, (n, s, c) in held.items():
            named = [(-1, -1, n), *((i, -1, int(v)) for i, v in enumerate(s)), *((i, j, int(c[i, j])) for i in range(dim) for j in range(i, dim))]
            out += [(dim, i, j, k, v) for i, j, value in named for k, v in _parts(value)]
        if out:
            columns = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns[:4]), pa.array(columns[4])], names=["dim", "i", "j", "part", "value"])

    found = vectors.mapInArrow(run, "dim int, i int, j int, part int, value long")
    return found.groupBy("dim", "i", "j", "part").agg(F.sum("value").alias("value"))


@dataclass(frozen=True)
class Whitening:
    """The fit of vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def explained(self) -> list[float | None]:
        return [float(e) / self.trace if self.trace > 0 else None for e in self.values]

    @property
    def weights(self) -> np.ndarray:
        """Vectors over the root of their values; a zero value has none (nan)."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.vectors / np.sqrt(self.values), np.nan)


def _integers(m: np.ndarray) -> tuple[np.ndarray, int]:
    """Doubles as integers over one power of two."""
    ratios = [[float(v).as_integer_ratio() for v in row] for row in m]
    scale = max((den for row in ratios for _, den in row), default=1)
    return np.array([[num * (scale // den) for num, den in row] for row in ratios], object).reshape(m.shape), scale


def _divided(m: np.ndarray, by: int) -> np.ndarray:
    """Python integers over one divisor, each rounded once."""
    return np.array([[int(v) / by for v in row] for row in m], float).reshape(m.shape)


def _jacobi(t: np.ndarray, q: np.ndarray) -> None:
    """Turn ``t`` diagonal and ``q`` with it, until no entry counts beside its own two values."""
    for _ in range(SWEEPS):
        small = 2.0**-52 * np.sqrt(np.outer(np.abs(np.diag(t)), np.abs(np.diag(t))))
        pairs = np.argwhere(np.triu(np.abs(t) > small, 1))
        if not len(pairs):
            return
        for i, j in pairs:
            if t[i, j] == 0:
                continue
            theta = (t[j, j] - t[i, i]) / (2 * t[i, j])
            tan = (1 if theta >= 0 else -1) / (abs(theta) + np.hypot(theta, 1)) if np.isfinite(theta) else 0.0
            cos = 1 / np.hypot(tan, 1)
            turn = np.array([[cos, tan * cos], [-tan * cos, cos]])
            kept = t[i, i] - tan * t[i, j], t[j, j] + tan * t[i, j]
            t[:, [i, j]] = t[:, [i, j]] @ turn
            t[[i, j], :] = turn.T @ t[[i, j], :]
            t[i, i], t[j, j] = kept
            t[i, j] = t[j, i] = 0.0
            q[:, [i, j]] = q[:, [i, j]] @ turn


def decompose(n: int, sums: list[int], products: np.ndarray, k: int = COMPONENTS) -> Whitening:
    """The first ``k`` components from exact sums (Python integers)."""
    s = np.array(sums, object)
    m = n * products - np.outer(s, s)  # n^2 times the covariance, exact
    _, q = np.linalg.eigh(_divided(m, n * n))
    fixed = np.array([[int(v) for v in row] for row in np.rint(q * 2.0**FIXED)], object)
    t = _divided(fixed.T.dot(m).dot(fixed), n * n << 2 * FIXED)
    _jacobi(t, q)
    q /= np.linalg.norm(q, axis=0)
    order = np.argsort(-np.diag(t), kind="stable")[:k]
    trace = int(sum(m[i, i] for i in range(len(m)))) / (n * n)
    values, vectors = np.diag(t)[order].copy(), q[:, order]
    values[values <= trace * len(m) * 2.0**-104] = 0.0
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1, 1)
    fit = Whitening(n, [int(v) for v in sums], values, vectors, trace, None)
    weights = fit.weights[:, values > 0]
    if not weights.shape[1]:
        return fit
    exact, scale = _integers(weights)
    cov = _divided(exact.T.dot(m).dot(exact), n * n * scale * scale)  # of what the weights give
    return Whitening(n, fit.sums, values, vectors, trace, float(np.abs(cov - np.eye(len(cov))).max()))


def fit(df: DataFrame, embedding: str = "embedding", k: int = COMPONENTS) -> dict[int, Whitening]:
    """The fit for every length of vector."""
    found: dict[int, dict[tuple[int, int], int]] = {}
    for r in scatter(fit_list(df, embedding)).collect():  # numbers of one length squared, whatever the rows
        own = found.setdefault(r["dim"], {})
        own[r["i"], r["j"]] = own.get((r["i"], r["j"]), 0) + (r["value"] << PART * r["part"])
    out = {}
    for dim, own in found.items():
        products = np.array([[own.get((min(i, j), max(i, j)), 0) for j in range(dim)] for i in range(dim)], object).reshape(dim, dim)
        out[dim] = decompose(own[-1, -1], [own.get((i, -1), 0) for i in range(dim)], products, k)
    return out


def _centred(x: np.ndarray, fit: Whitening) -> tuple[np.ndarray, list, list]:
    """x - S/n as doubles; exact deviations that fit 64 bits, and the text of the others."""
    s = np.array(fit.sums, object)
    reach = fit.n * np.abs(x.astype(float)).max(axis=1) + max((abs(v) for v in fit.sums), default=0)
    wide = reach >= 2.0**62
    y = np.zeros(x.shape)
    deviation, large = np.zeros(len(x), object), np.full(len(x), None)
    rows = np.flatnonzero(~wide)
    if len(rows):
        own = x[rows] * np.int64(fit.n) - s.astype(np.int64)
        y[rows] = own / fit.n
        total, good = squares(own)
        deviation[rows] = objects(total)
        for at in np.flatnonzero(~good):
            deviation[rows[at]] = sum(int(v) ** 2 for v in own[at])
    for at in np.flatnonzero(wide):
        own = [fit.n * int(v) - t for v, t in zip(x[at], fit.sums)]
        y[at] = [v / fit.n for v in own]
        deviation[at] = sum(v * v for v in own)
    for at in np.flatnonzero(deviation >= 1 << 63):
        deviation[at], large[at] = None, str(deviation[at])
    return y, list(deviation), list(large)


def whiten(df: DataFrame, fits: dict[int, Whitening], embedding: str = "embedding") -> DataFrame:
    """(row, component, n, deviation, whitened, explained, identity_error, deviation_large).

    ``row`` holds the other columns of the input; sums of a projection run in the order of
    entries, so they don't depend on how rows are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch, 1):
                own = fits[x.shape[1]]
                y, deviation, large = _centred(x, own)
                weights, k = own.weights, len(own.values)
                w = np.zeros((len(x), k))
                for d in range(x.shape[1]):
                    w += y[:, d, None] * weights[d]
                each = np.repeat(np.arange(len(rows)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows[each])),
                        pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                        pa.array(np.full(len(each), own.n), pa.int64()),
                        pa.array(deviation, pa.int64()).take(pa.array(each)),
                        pa.array(w.ravel(), pa.float64(), from_pandas=True),
                        pa.array(own.explained, pa.float64()).take(pa.array(np.tile(np.arange(k), len(rows)))),
                        pa.array([own.identity_error], pa.float64()).take(pa.array(np.zeros(len(each), int))),
                        pa.array(large, pa.string()).take(pa.array(each)),
                    ],
                    names=["row", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_large"],
                )

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != embedding]).alias("row"), floats(df, embedding).alias("v"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_large string")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Every usable vector on the first four components of all distinct ones."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = whiten(df, fit(df))
    return found.select(F.col("row.vec_id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_large")
