"""Embedding and completion sources, and which models fit a machine.

A model is a function: text to vector, or prompt to text.  ``http_embedder`` and
``http_completer`` make one for a local model server; tests and other servers bring their own.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from docloom.sources.files import embedding_input

#: Texts asked for at once, attempts, seconds of pause, tokens of a section, models shown.
BATCH = 10
EMBED_TRIES, EMBED_PAUSE = 3, 1.0
COMPLETE_TRIES, COMPLETE_PAUSE = 2, 2.0
SECTION_TOKENS, PATH_CHARS = 150, 80
CHARS_A_TOKEN = 4.2
MEMORY_SHARE, MODELS_SHOWN = 0.85, 10

Embedder = Callable[[str], list[float]]
Completer = Callable[[str], str]


def with_retries(call: Callable, tries: int, pause: float, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The call, tried again after a pause that grows by ``pause`` each time; the last error is raised."""

    def run(*args):
        for k in range(1, tries + 1):
            try:
                return call(*args)
            except Exception:
                if k == tries:
                    raise
                sleep(pause * k)

    return run


def _post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def http_embedder(url: str, model: str, timeout: float = 30.0) -> Embedder:
    def embed(text: str) -> list[float]:
        vector = _post(f"{url}/api/embeddings", {"model": model, "prompt": text}, timeout).get("embedding")
        if not vector:
            raise ValueError("the server returned no vector")
        return vector

    return with_retries(embed, EMBED_TRIES, EMBED_PAUSE)


def http_completer(url: str, model: str, temperature: float = 0.1, max_tokens: int | None = None, timeout: float = 120.0) -> Completer:
    options = {"temperature": temperature} | ({"num_predict": max_tokens} if max_tokens else {})

    def complete(prompt: str) -> str:
        return _post(f"{url}/api/generate", {"model": model, "prompt": prompt, "stream": False, "options": options}, timeout).get("response") or ""

    return with_retries(complete, COMPLETE_TRIES, COMPLETE_PAUSE)


def strip_fences(answer: str) -> str:
    """A model's answer without code fences."""
    return re.sub(r"```(?:json)?\s*", "", answer, flags=re.I).strip()


def parse_json(answer: str):
    return json.loads(strip_fences(answer))


def embed(df: DataFrame, column: str, model: Embedder, output: str = "embedding", batch: int = BATCH) -> DataFrame:
    """``df`` with a vector of every text of ``column``; equal texts of a batch are asked for once.

    Texts go out ``batch`` at a time, side by side.  A batch that fails leaves nulls, as null
    texts do; the job goes on.  Several tasks ask at once: a server's load is set by the
    number of partitions.
    """
    if output in df.columns:
        raise ValueError(f"the input has a column {output}")
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(batch) as pool:
            for rows in batches:
                texts = rows.column(at).to_pylist()
                distinct = list(dict.fromkeys(t for t in texts if t is not None))
                known: dict[str, list[float]] = {}
                for k in range(0, len(distinct), batch):
                    part = distinct[k : k + batch]
                    try:
                        known.update(zip(part, list(pool.map(model, part))))
                    except Exception:  # this batch stays without vectors
                        continue
                vectors = pa.array([known.get(t) for t in texts], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, vectors], names=[*rows.schema.names, output])

    return df.mapInArrow(run, schema)


def section_input(heading: Column) -> Column:
    """Struct(path, text) that a section is embedded from: its heading alone."""
    return F.struct(F.substring(heading, 1, PATH_CHARS).alias("path"), F.substring(heading, 1, int(SECTION_TOKENS * CHARS_A_TOKEN)).alias("text"))


def document_inputs(docs: DataFrame) -> DataFrame:
    """(doc_id, input) of ``docs(doc_id, headings array<string>)``."""
    return docs.select("doc_id", embedding_input(F.col("headings")).alias("input"))


def section_inputs(docs: DataFrame) -> DataFrame:
    """(doc_id, position, path, input): one row a heading."""
    rows = docs.select("doc_id", F.posexplode("headings").alias("position", "h"))
    return rows.select("doc_id", "position", section_input(F.col("h")).alias("s")).select("doc_id", "position", "s.path", F.col("s.text").alias("input"))


def fingerprint_embeddings(docs: DataFrame, model: Embedder) -> DataFrame:
    """(doc_id, embedding): one vector a document; null where the model failed."""
    return embed(document_inputs(docs), "input", model).drop("input")


def rank_models(catalog: DataFrame, gpu: bool, memory: float) -> DataFrame:
    """The first models to offer of ``catalog(id, size, min_memory, validated)``: rank, fits, recommended.

    A model fits if it needs no memory, or at most ``MEMORY_SHARE`` of a GPU's.  Recommended is the largest
    validated one that fits, else the smallest validated one.  It comes first, then those that
    fit, validated ones before others, the larger before the smaller; then the smallest validated
    one that doesn't fit.  Ties go to the smaller id; no model is shown twice.
    """
    enough = (F.col("min_memory") <= memory * MEMORY_SHARE) if gpu else F.lit(False)
    fits = (F.col("min_memory") == 0) | enough
    rows = catalog.select("id", "size", "min_memory", "validated", fits.alias("fits"))
    largest = F.when(F.col("validated") & F.col("fits"), F.struct(F.col("size").alias("s"), (-F.col("id")).alias("i")))
    smallest = F.when(F.col("validated") & ~F.col("fits"), F.struct((-F.col("size")).alias("s"), (-F.col("id")).alias("i")))
    best = rows.agg(F.max(largest).alias("fit"), F.max(smallest).alias("unfit"))
    picked = best.select((-F.coalesce("fit", "unfit")["i"]).alias("_best"), (-F.col("unfit.i")).alias("_next"))
    joined = rows.crossJoin(F.broadcast(picked))  # one row
    recommended = F.coalesce(F.col("id") == F.col("_best"), F.lit(False))
    next_ = F.coalesce(F.col("id") == F.col("_next"), F.lit(False))
    place = F.when(recommended, 0).when(F.col("fits") & F.col("validated"), 1).when(F.col("fits"), 2).when(next_, 3)
    shown = joined.select("id", "size", "fits", recommended.alias("recommended"), place.alias("_p")).where(F.col("_p").isNotNull())
    first = shown.orderBy("_p", F.desc("size"), "id").limit(MODELS_SHOWN).agg(F.sort_array(F.collect_list(F.struct("_p", (-F.col("size")).alias("_s"), "id", "size", "fits", "recommended"))).alias("l"))
    return first.select(F.posexplode("l").alias("p", "m")).select((F.col("p") + 1).alias("rank"), "m.id", "m.size", "m.fits", "m.recommended")  # ten rows
