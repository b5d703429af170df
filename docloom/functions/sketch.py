"""MinHash signatures of token lists, bit-exact in 32-bit arithmetic."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HASHES = 128
EMPTY = 0xFFFFFFFF


@cache
def seeds(n: int = HASHES) -> np.ndarray:
    """Linear congruential seeds in 32 bits."""
    out, s = [], 0xDEADBEEF
    for _ in range(n):
        s = ((s * 1664525 & EMPTY) + 1013904223) & EMPTY
        out.append(s)
    return np.array(out, np.uint32)


#: Tokens that are hashed at once, and lists of one step.
TOKENS = 512
LISTS = 200


def hashes(tokens: list[str], n: int = HASHES) -> np.ndarray:
    """(tokens, n) hashes by seed of cleaned tokens; tokens of similar length are mixed at once."""
    seed = seeds(n)
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16) for t in tokens]
    out = np.empty((len(tokens), n), np.uint32)
    order = sorted(range(len(tokens)), key=lambda i: -len(units[i]))
    for at in range(0, len(order), TOKENS):
        some = order[at : at + TOKENS]
        lengths = np.array([len(units[i]) for i in some])
        padded = np.zeros((int(lengths[0]), len(some)), np.uint32)
        for k, i in enumerate(some):
            padded[: len(units[i]), k] = units[i]
        h = np.repeat((seed ^ np.uint32(0x9747B28C))[None, :], len(some), axis=0)
        left = np.searchsorted(-lengths, -np.arange(len(padded)), side="left")  # longer than the place
        for row, m in zip(padded, left):
            x = h[:m]
            x ^= row[:m, None]
            x *= np.uint32(0x5BD1E995)
            x ^= x >> np.uint32(15)
        h = (h ^ seed) * np.uint32(0xCC9E2D51)
        h ^= h >> np.uint32(13)
        out[some] = h * np.uint32(0x1B873593)
    return out


def signatures(lists: list[list[str]], n: int = HASHES) -> list[np.ndarray]:
    """Least hash by seed of the tokens of every list; equal tokens are hashed once."""
    out = []
    for at in range(0, len(lists), LISTS):
        place: dict[str, int] = {}
        of = [[place.setdefault(c, len(place)) for t in x if t is not None and (c := t.lower().strip())] for x in lists[at : at + LISTS]]
        every = hashes(list(place), n)
        out += [every[x].min(axis=0) if x else np.full(n, EMPTY, np.uint32) for x in of]
    return out


def signature(tokens: list[str], n: int = HASHES) -> np.ndarray:
    """Least hash of the tokens by seed."""
    return signatures([tokens], n)[0]


def minhash(tokens: Column, n: int = HASHES) -> Column:
    """array<bigint> of 32-bit values; an empty list gives all ones."""

    @F.pandas_udf("array<bigint>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([x.astype(np.int64) for x in signatures([[] if x is None else list(x) for x in lists], n)], dtype=object)

    return run(tokens)


def minhash_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when(F.size(a) == F.size(b), same / F.size(a)).otherwise(F.raise_error(F.lit("signatures of different length")))


def minhash_column(tokens: Column, n: int = HASHES) -> Column:
    """``minhash`` from built-in expressions alone (slower, no Python)."""

    def imul(x: Column, c: int) -> Column:
        low, high = c & 0xFFFF, c >> 16
        return (x * low + ((x * high).bitwiseAND(0xFFFF) * 65536)).bitwiseAND(EMPTY)

    def hashed(token: Column, seed: Column) -> Column:
        units = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
        start = seed.bitwiseXOR(F.lit(0x9747B28C))

        def step(h: Column, u: Column) -> Column:
            x = imul(h.bitwiseXOR(u), 0x5BD1E995)
            return x.bitwiseXOR(F.shiftrightunsigned(x, 15))

        h = imul(F.aggregate(units, start, step).bitwiseXOR(seed), 0xCC9E2D51)
        return imul(h.bitwiseXOR(F.shiftrightunsigned(h, 13)), 0x1B873593)

    clean = F.filter(F.transform(tokens, lambda t: F.trim(F.lower(t))), lambda t: t != "")
    every = F.array(*[F.lit(int(s)).cast("long") for s in seeds(n)])
    least = lambda s: F.coalesce(F.array_min(F.transform(clean, lambda t: hashed(t, s))), F.lit(EMPTY).cast("long"))
    return F.transform(every, least)
