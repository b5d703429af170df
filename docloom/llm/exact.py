"""Exact sums of products of 64-bit integers, as products of matrices of 16-bit limbs.

A double holds sums of 2^21 products of two limbs exactly, so a product of matrices does
the work and only the few sums at the end are big integers.
"""

from __future__ import annotations

import numpy as np

#: Bits of a limb.
LIMB = 16
#: Rows that one product may sum over.
MOST = 1 << 21
HIGH, LOW = (1 << 63) - 1, -(1 << 63)


def quantised(x: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) as int64; what lies beyond its range becomes its end."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x.astype(float))
    inside = np.where(np.abs(y) < 2.0**63, y, 0).astype(np.int64)
    return np.where(y >= 2.0**63, HIGH, np.where(y < -(2.0**63), LOW, inside))


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """The limbs of int64 numbers, lowest first; the last one has the sign."""
    out, x = [], x.astype(np.int64)
    while x.size and (x.max() >= 1 << LIMB or x.min() < -(1 << LIMB)):
        out.append((x & ((1 << LIMB) - 1)).astype(float))
        x = x >> LIMB
    return [*out, x.astype(float)]


def objects(x: np.ndarray) -> np.ndarray:
    """The numbers as Python integers."""
    return x.astype(object)


def cross(x: np.ndarray) -> np.ndarray:
    """The transpose of ``x`` times ``x``, as Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), MOST):
        parts = limbs(x[at : at + MOST])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += objects((a.T @ b).astype(np.int64)) * (1 << LIMB * (i + j))
    return total


def shifted_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the rows, gathered about the first row and then moved back."""
    if int(np.abs(x.astype(float)).max(initial=0)) < 1 << 61:  # no difference leaves int64
        base, rest = x[0], x - x[0]
    else:
        base, rest = np.zeros_like(x[0]), x
    parts = limbs(rest)
    sums = sum(objects(p.sum(axis=0).astype(np.int64)) * (1 << LIMB * i) for i, p in enumerate(parts))
    base, n = objects(base), len(x)
    moved = cross(rest) + np.outer(base, sums) + np.outer(sums, base) + n * np.outer(base, base)
    return sums + n * base, moved


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of ``a`` with those of ``b`` as int64, exact; beyond its range, its end."""
    left, right = limbs(a), limbs(b)
    if len(left) == len(right) == 1:
        return (left[0] @ right[0].T).astype(np.int64)
    near = np.zeros((len(a), len(b)))
    wrapped = np.zeros((len(a), len(b)), np.uint64)  # right modulo 2^64
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            p = x @ y.T
            near += p * 2.0 ** (LIMB * (i + j))
            if LIMB * (i + j) < 64:
                wrapped += p.astype(np.int64).view(np.uint64) << np.uint64(LIMB * (i + j))
    out = np.where(near > 2.0**63, HIGH, np.where(near < -(2.0**63), LOW, wrapped.view(np.int64)))
    # near the ends the rounded sum can't tell
    for i, j in zip(*np.nonzero(np.abs(np.abs(near) - 2.0**63) < 2.0**40)):
        out[i, j] = min(HIGH, max(LOW, sum(int(p) * int(q) for p, q in zip(a[i], b[j]))))
    return out


def squares(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares of every int64 row modulo 2^64, and which of them are exact since they fit an int64."""
    near = (y.astype(float) ** 2).sum(axis=1)
    return (y * y).sum(axis=1), near < 2.0**62
