"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and the character
1-, 2- and 3-grams are hashed into ``2**BITS`` features.  Document frequencies cover
all labelled documents outside the held-out fold.  The weights are fitted on a bounded
sample of them (``PER_LANGUAGE`` rows of a language, picked by a hash of the id) with
follow-the-regularised-leader and elastic-net penalties, and the logits are divided by a
temperature that minimises the loss on a fifth of the sample that trained nothing: on
passages of ``PASSAGE`` words of it, since whole texts are too easy to tell scores apart,
with a penalty on the temperature's distance from 1.

Only text is an input of a prediction.  Defined results: a text that is null or has no
letter is ``und`` with score 0, as is every text where nothing can be learned; a null
doc_id counts as the empty string in the fold; a very long text is one row of counts; repeated rows stay; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features.
BITS = 14
#: Bound of the sample that fits the weights: about so many rows of each language.
PER_LANGUAGE = 400
EPOCHS = 3
#: Words of the passages that calibrate, how many a text gives, and the penalty on log(temperature)^2.
PASSAGE, PASSAGES, PENALTY = 4, 3, 0.01
UND = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters(text: str | None) -> np.ndarray:
    """Code points of the text, lower-cased; runs of non-letters are one space."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of others
    return np.where(is_letter, codes, 32)[keep].astype(np.uint32)


_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def gram_counts(text: str | None, bits: int = BITS) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text, dense; null without a letter."""
    codes = letters(text)
    if not (codes != 32).any():
        return None
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
    key, total = np.zeros_like(codes), None
    for n, mix in enumerate(_MIX):
        key = (key[: len(codes) - n] * np.uint32(0x01000193)) ^ codes[n:] if n else codes.copy()
        slots = (key * mix) >> np.uint32(32 - bits)
        counts = np.bincount(slots, minlength=1 << bits)
        total = counts if total is None else total + counts
        if len(codes) <= n + 1:
            break
    return total


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    x = np.log1p(counts) * idf
    return x / (np.linalg.norm(x) or 1.0)


class FtrlSoftmax:
    """Multinomial logistic regression, follow-the-regularised-leader with elastic net."""

    def __init__(self, classes: int, features: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((classes, features)), np.zeros((classes, features))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[y] -= 1.0
        g = p[:, None] * x
        grown = self.n[:, at] + g * g
        sigma = (np.sqrt(grown) - np.sqrt(self.n[:, at])) / self.alpha
        self.z[:, at] += g - sigma * w
        self.n[:, at] = grown


def passages(text: str | None, seed: int) -> list[str]:
    """A few passages of a text, from places that depend on the seed alone."""
    words = (text or "").split()
    starts = np.random.default_rng(seed).integers(0, max(1, len(words) - PASSAGE + 1), PASSAGES)
    return [" ".join(words[s : s + PASSAGE]) for s in starts.tolist()]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least penalised loss, by golden sections of its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean()) + PENALTY * t * t

    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fold() -> F.Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def document_frequencies(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many of all rows every feature occurs, and the number of rows with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = gram_counts(text.as_py(), bits)
                if counts is not None:
                    seen += counts > 0
                    rows += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], rows), pa.int64())], names=["slot", "n"]
        )

    sums = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out, rows = np.zeros(1 << bits), 0
    for r in sums:
        if r["slot"] < 0:
            rows = r["n"]
        else:
            out[r["slot"]] = r["n"]
    return out, rows


class Model:
    """What a prediction needs: languages, idf, weights and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, heat: float, bits: int):
        self.langs, self.idf, self.weights, self.heat, self.bits = langs, idf, weights, heat, bits

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text, self.bits)
        if counts is None or not self.langs:
            return UND, 0.0
        at = np.flatnonzero(counts)
        p = softmax(self.weights[:, at] @ vector(counts[at], self.idf[at]) / self.heat)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Model of ``labelled(doc_id, text, lang)``."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(1 << bits), np.zeros((0, 1 << bits)), 1.0, bits)
    df, rows = document_frequencies(labelled, bits)
    idf = np.log((1 + rows) / (1 + df)) + 1.0
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_000))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, per_language / sizes[lang])).otherwise(share)
    picked = labelled.where(part < share * 1_000_000).select(part.alias("part"), "lang", "text")
    # ordered, so that the bound keeps the same rows in every run
    sample = picked.orderBy("part", "text").limit(2 * per_language * len(langs)).collect()
    data = []  # sparse: the driver holds a few bytes for every n-gram of the sample
    for r in sample:
        calibrates = r["part"] % 5 == 0
        for text in passages(r["text"], r["part"]) if calibrates else [r["text"]]:
            counts = gram_counts(text, bits)
            if counts is not None:
                at = np.flatnonzero(counts)
                data.append((calibrates, langs.index(r["lang"]), at.astype(np.int32), vector(counts[at], idf[at]).astype(np.float32)))
    del sample
    order = np.random.default_rng(11).permutation(len(data))
    model = FtrlSoftmax(len(langs), 1 << bits)
    for _ in range(epochs):
        for i in order:
            calibrates, y, at, x = data[i]
            if not calibrates:
                model.learn(at, x, y)
    w = model.weights()
    held = [(y, w[:, at] @ x) for calibrates, y, at, x in data if calibrates]
    heat = temperature(np.array([l for _, l in held]), np.array([y for y, _ in held])) if held else 1.0
    return Model(langs, idf, w.astype(np.float32), heat, bits)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred and score; a narrow pass."""
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(keep))],
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ],
                names=[*keep, "lang_pred", "score"],
            )

    return rows.mapInArrow(run, schema)


def accept(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """Rows whose language is recognised with at least ``min_score``, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (model.predict(t.as_py()) for t in batch.column(at))
            yield batch.filter(pa.array([lang != UND and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame) -> Model:
    """Model of the labelled documents outside the held-out fold."""
    return fit(docs.where((fold() != 2) & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))


def op3_language(docs: DataFrame) -> DataFrame:
    """Predicted language of every document."""
    held_out = predict(docs.select("doc_id", "text"), train(docs))
    return held_out.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")
