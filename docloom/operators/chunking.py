"""Chunkers: sliding windows, sentences, packed sentences, table rows, and sampling of chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from docloom.functions import jsregex as rx
from docloom.functions import text as T

SIZE, OVERLAP, BACK = 512, 64, 30
STEP = SIZE - OVERLAP
#: Characters of a text whose windows start in one block.
BLOCK = 32 * STEP
#: The chunker's classes ask for four blanks in a row, the projection's for three.
MIRROR_BLANKS = 4
#: Fixed value: blanks that end a sentence.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])"
STRATEGY = {".pdf": "semantic", ".docx": "semantic", ".xlsx": "table_rows"}


def strategy(extension: Column) -> Column:
    out = F.lit("sliding_window")
    for ext, name in STRATEGY.items():
        out = F.when(extension == ext, name).otherwise(out)
    return out


def sliding_windows(text: Column) -> Column:
    """array<struct<start, content>> of 512 characters every 448; cuts move back to a blank.

    Places of a text are counted from its start, so windows are taken from blocks of a bounded length.
    """

    def window(start: Column, piece: Column, n: Column) -> Column:
        """The window at ``start``, of the SIZE + 1 characters from there."""
        cut = F.length(F.regexp_extract(F.substring(piece, SIZE - BACK + 1, BACK), r"(?s)^(.*[ \n\t])", 1))
        at_blank = F.substring(piece, SIZE + 1, 1).isin(" ", "\n", "\t")
        size = T.bind(cut, lambda c: F.when(start + SIZE >= n, n - start).when(at_blank | (c == 0), SIZE).otherwise(SIZE - BACK + c))
        return F.struct(start.alias("start"), F.substring(piece, F.lit(1), size).alias("content"))

    def of(n: Column) -> Column:
        def windows(b: Column) -> Column:
            starts = F.filter(F.sequence(b, F.least(n - 1, b + BLOCK - 1), F.lit(STEP)), lambda k: (k == 0) | (k - STEP + SIZE < n))
            cut = lambda block: F.transform(starts, lambda k: T.bind(F.substring(block, k - b + 1, F.lit(SIZE + 1)), lambda piece: window(k, piece, n)))
            return T.bind(F.substring(text, b + 1, F.lit(BLOCK + SIZE + 1)), cut)

        every = F.flatten(F.transform(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), windows))
        kept = F.filter(every, lambda w: ~F.regexp_like(w["content"], F.lit(rx.java(r"^\s*$"))))
        return F.when(n > 0, kept).otherwise(F.array().cast("array<struct<start:int,content:string>>"))

    return T.bind(F.length(text), of)


def sentences(text: Column) -> Column:
    """Sentences of every paragraph: cut after .!? and blanks before a capital letter."""
    paragraphs = F.transform(F.split(text, r"\n{2,}"), rx.trim)
    parts = F.flatten(F.transform(paragraphs, lambda p: F.split(p, rx.java(SENTENCE_END))))
    return F.filter(F.transform(parts, rx.trim), lambda s: s != "")


def cut_sentences(text: str) -> list[str]:
    """``sentences`` for one string."""
    cuts = (_SENTENCE_END.split(p.strip(rx.BLANKS)) for p in re.split(r"\n{2,}", text))
    return [s for s in (c.strip(rx.BLANKS) for parts in cuts for c in parts) if s]


class Packer:
    """Greedy packing of sentences, joined by a blank, into chunks of at most SIZE characters; holds one chunk."""

    def __init__(self):
        self.held = ""

    def add(self, sentence: str) -> list[str]:
        """The chunks that are full before, or with, this sentence."""
        if len(sentence) > SIZE:
            return self.close() + cut_windows(sentence)
        if self.held and len(self.held) + 1 + len(sentence) > SIZE:
            out, self.held = [self.held], sentence
            return out
        self.held = f"{self.held} {sentence}" if self.held else sentence
        return []

    def close(self) -> list[str]:
        out, self.held = [self.held] if self.held else [], ""
        return out


def pack_sentences(items: list[str]) -> list[str]:
    """Greedy packing of the sentences of a text."""
    packer = Packer()
    return [c for s in items for c in packer.add(s)] + packer.close()


def cut_windows(text: str) -> list[str]:
    """``sliding_windows`` for one string."""
    out, start = [], 0
    while start < len(text):
        end = min(start + SIZE, len(text))
        if end < len(text) and text[end] not in " \n\t":
            back = max(text.rfind(c, max(0, end - BACK), end) for c in " \n\t")
            end = back + 1 if back >= 0 else end
        if text[start:end].strip():
            out.append(text[start:end])
        if end >= len(text):
            break
        start += STEP
    return out


_TABLE_LINE = re.compile(r"\t|\||\s{3,}")
_SENTENCE_END = re.compile(rx.python(SENTENCE_END), re.ASCII)


def table_chunks(text: str) -> list[tuple[str, bool]]:
    """(chunk, is_table): runs of table lines, cut from SIZE characters on, and windows of prose."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    size = -1  # characters of the held lines, joined
    in_table = False

    def flush() -> None:
        nonlocal size
        joined = "\n".join(held)
        if in_table and held:
            out.append((joined, True))
        elif held and joined.strip():
            out.extend((w, False) for w in cut_windows(joined.strip()))
        held.clear()
        size = -1

    for line in text.split("\n"):
        is_table = bool(_TABLE_LINE.search(line)) and bool(line.strip())
        if is_table != in_table:
            flush()
            in_table = is_table
        held.append(line)
        size += len(line) + 1
        if in_table and size >= SIZE:
            flush()
    flush()
    return out


CHUNK_COLUMNS = "chunk_index int, content string, chunk_type string"


#: Documents whose chunks are made and sent at once.
ROWS = 64


def fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of (doc_id, extension, strategy, text, sentences), some documents at a time: a batch may hold 10,000."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids, exts, index, content, table = [], [], [], [], []
            for doc, ext, kind, text, items in zip(*(part.column(c).to_pylist() for c in range(5))):
                found = [(c, False) for c in pack_sentences(items)] if kind == "semantic" else table_chunks(text)
                for k, (c, t) in enumerate(found):
                    ids.append(doc)
                    exts.append(ext)
                    index.append(k)
                    content.append(c)
                    table.append(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(exts, pa.string()), pa.array(index, pa.int32()), pa.array(content, pa.string()), pa.array(table, pa.bool_())],
                names=["doc_id", "extension", "chunk_index", "content", "table"],
            )


def chunk(docs: DataFrame) -> DataFrame:
    """(doc_id, extension, chunk_index, content, chunk_type) of ``docs(doc_id, extension, text)``.

    Windows are expressions; the two folds (packing, table runs) run over Arrow batches.
    """
    named = docs.select("doc_id", "extension", F.coalesce("text", F.lit("")).alias("text"), strategy(F.col("extension")).alias("_s"))
    windows = (
        named.where("_s = 'sliding_window'")
        .select("doc_id", "extension", F.posexplode(sliding_windows(F.col("text"))).alias("chunk_index", "w"))
        .select("doc_id", "extension", "chunk_index", F.col("w.content").alias("content"), F.lit(False).alias("table"))
    )
    folds = named.where("_s <> 'sliding_window'").select(
        "doc_id", "extension", "_s", F.when(F.col("_s") != "semantic", F.col("text")).alias("text"), F.when(F.col("_s") == "semantic", sentences(F.col("text"))).alias("sentences")
    )

    folded = folds.mapInArrow(fold_batches, "doc_id long, extension string, chunk_index int, content string, table boolean")
    kind = F.when(F.col("table"), "table_row").otherwise(T.classify_block(F.col("content"), MIRROR_BLANKS))
    return windows.unionByName(folded).select("doc_id", "extension", "chunk_index", "content", kind.alias("chunk_type"))


#: Chunks to sample, per document and in all.
BUDGETS = {"fast": (30, 2_000), "normal": (200, 20_000), "full": (None, None)}


def even_sample(chunks: DataFrame, budget: str = "normal") -> DataFrame:
    """Evenly spaced chunks of every document within the budget.

    A first pass counts chunks by document; the second cap scales every document's share.
    """
    per_doc, in_all = BUDGETS[budget]
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    target = F.least(F.col("_n"), F.lit(per_doc)) if per_doc else F.col("_n")
    counts = counts.withColumn("_t", target)
    if in_all:
        total = counts.agg(F.sum("_t").alias("_total"))
        counts = counts.crossJoin(F.broadcast(total))  # one row
        scaled = F.greatest(F.lit(1), F.floor(F.col("_t") * (F.lit(float(in_all)) / F.col("_total"))))
        counts = counts.withColumn("_t", F.when(F.col("_total") > in_all, scaled).otherwise(F.col("_t"))).drop("_total")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_index")) - 1
    ranked = chunks.withColumn("_r", rank).join(counts, "doc_id")
    # r is picked iff r = floor(i * n / t) for some i, which can only be ceil(r * t / n)
    i = F.ceil(F.col("_r") * F.col("_t") / F.col("_n"))
    picked = (i < F.col("_t")) & (F.floor(i * F.col("_n") / F.col("_t")) == F.col("_r"))
    return ranked.where((F.col("_n") <= F.col("_t")) | picked).drop("_r", "_n", "_t")
