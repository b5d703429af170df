"""Line deduplication that ships hashes and bitmaps, not text.

A key is a line without white space at its ends and with A-Z lower-cased.  Every text gives
one row for each of its long keys: a 128-bit hash, the document and the places of its lines.
Rows are range-partitioned by hash and document and sorted, the largest document first, so that
a key which a third of all documents hold spreads over as many partitions as it fills.
A stream over each partition keeps the first document of a key and reports the places of the
others; the few keys that lie across partitions (two a partition at most) are counted
first and told to all.  The reported places of a document become one compressed bitmap of
the lines it keeps, which goes back to the text.

Results that are defined: a null or empty text is one empty line; a null doc_id is one document,
less than any other; rows that share a doc_id are one document when documents are counted and keep lines each for
itself; repeated rows have equal results; a key that fills many lines of the kept document stays in
all of them; a text of any length is one row's work; an empty table gives an empty result;
other columns, whatever their names, travel along in ``row``.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import WS_CHARS, checkpoint

#: Code points of a key at least.
MIN_CHARS = 40
#: Documents that hold a key at least before it is dropped.
MIN_DOCS = 5
#: Bitmaps are broadcast up to so many bytes; beyond, they are joined by document.
BROADCAST_BYTES = 8 << 20
#: Bytes of text that are cut into lines at once.
STEP = 16 << 20

KEPT = StructType([StructField("text", StringType()), StructField("dropped", LongType())])
_LINES = "hash long, more long, doc long, part long, lines int, at binary"


def _steps(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``STEP`` bytes, with their first row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, done + STEP, side="right")) - at)
        yield at, texts.slice(at, n)
        at += n


def _long_keys(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Lines of every text; row, place and key of the lines that are long enough."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    lines = split.flatten()
    wide = np.flatnonzero(pc.binary_length(lines).to_numpy(zero_copy_only=False) >= min_chars)
    keys = pc.ascii_lower(pc.utf8_trim(lines.take(pa.array(wide)), characters=WS_CHARS))
    good = np.flatnonzero(pc.utf8_length(keys).to_numpy(zero_copy_only=False) >= min_chars)
    return lengths, row[wide[good]], place[wide[good]], keys.take(pa.array(good)).cast(pa.large_binary()).to_pylist()


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hash, more, doc, part, lines, at) for every long key of ``docs(doc, part, text)``.

    ``part`` is a hash of the text, ``lines`` the number of its lines, ``at`` the places of the key as
    32-bit numbers.  Equal rows of a batch are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = pa.table({"doc": batch.column(0), "part": batch.column(1), "n": pa.array(np.arange(batch.num_rows))}).group_by(["doc", "part"]).aggregate([("n", "min")])
            batch = batch.take(once.column("n_min").combine_chunks())
            for first, texts in _steps(batch.column(2)):
                lengths, row, place, keys = _long_keys(texts, min_chars)
                if not keys:
                    continue
                marks = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
                order = np.lexsort((place, marks[:, 1], marks[:, 0], row))
                row, place, marks = row[order], place[order].astype("<i4"), marks[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (marks[1:] != marks[:-1]).any(axis=1)
                begin = np.flatnonzero(new)
                offsets = np.append(begin, len(row)).astype(np.int32) * 4
                at = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(place.tobytes())])
                own = pa.array(first + row[begin])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks[begin, 0]), pa.array(marks[begin, 1]), batch.column(0).take(own), batch.column(1).take(own), pa.array(lengths[row[begin]], pa.int32()), at],
                    names=["hash", "more", "doc", "part", "lines", "at"],
                )

    return docs.select("doc", "part", "text").mapInArrow(run, _LINES)


def _groups(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (rows, 2), documents, and where a key, or a document within it, begins; for sorted rows."""
    key = np.stack([batch.column(k).to_numpy() for k in range(2)], axis=1)
    doc = np.stack([batch.column(2).is_valid().to_numpy(zero_copy_only=False), batch.column(2).fill_null(0).to_numpy()], axis=1).astype(np.int64)
    starts = np.ones(len(key), bool)
    starts[1:] = (key[1:] != key[:-1]).any(axis=1)
    docs = starts.copy()
    docs[1:] |= (doc[1:] != doc[:-1]).any(axis=1)
    return key, doc, starts, docs


def _edges(ordered: DataFrame) -> DataFrame:
    """(hash, more, docs, known, top): keys that lie in more than one partition, with all their documents and the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, last = None, None, ()  # keys as [hash, more, documents, largest is known, largest]
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, starts, docs = _groups(batch)
            begin = np.flatnonzero(starts)
            counts = np.add.reduceat(docs.astype(np.int64), begin)
            own = lambda g: [*key[begin[g]].tolist(), int(counts[g]), *doc[begin[g]].tolist()]  # noqa: B023, E731
            if held and held[:2] == own(0)[:2]:
                held[2] += own(0)[2] - (last == tuple(doc[0]))
            else:
                first, held = first or held, own(0)
            if len(begin) > 1:
                first, held = first or held, own(-1)
            last = tuple(doc[-1])
        found = [x for x in (first, held) if x is not None]
        if found:
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["hash", "more", "docs", "known", "top"])

    ends = ordered.select("hash", "more", "doc").mapInArrow(run, "hash long, more long, docs long, known long, top long")
    summed = ends.groupBy("hash", "more").agg(F.count(F.lit(1)).alias("n"), F.sum("docs").alias("docs"), F.max(F.struct("known", "top")).alias("most"))
    return summed.where(F.col("n") > 1).select("hash", "more", "docs", "most.known", "most.top")


class _Stream:
    """First occurrences of the keys of one sorted partition."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.key: tuple | None = None
        self.keep: np.ndarray | None = None
        self.last: tuple = ()
        self.docs = 0
        self.held: list[pa.RecordBatch] = []

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows to drop, as far as they are known to be; ``batch`` has the edges' columns at its end."""
        key, doc, starts, docs = _groups(batch)
        begin = np.flatnonzero(starts)
        group = np.cumsum(starts) - 1
        counts = np.add.reduceat(docs.astype(np.int64), begin)
        keep = doc[begin].copy()
        told = batch.column(6).is_valid().to_numpy(zero_copy_only=False)[begin]
        if self.key == tuple(key[0]):
            counts[0] += self.docs - (self.last == tuple(doc[0]))
            keep[0] = self.keep
        else:
            self.held = []
        total = np.where(told, batch.column(6).fill_null(0).to_numpy()[begin], counts)
        known = np.stack([batch.column(k).fill_null(0).to_numpy()[begin] for k in (7, 8)], axis=1)
        keep = np.where(told[:, None], known, keep)
        dropped = (total >= self.min_docs)[group] & (doc != keep[group]).any(axis=1)
        out = batch.filter(pa.array(dropped))
        if total[0] >= self.min_docs:
            for rows in self.held:
                yield self._without(rows, keep[0])
            self.held = []
        yield out
        if total[-1] >= self.min_docs:
            self.held = []
        else:
            if len(begin) > 1:
                self.held = []
            self.held.append(batch.slice(int(begin[-1])))
        self.key, self.keep, self.last, self.docs = tuple(key[-1]), keep[-1], tuple(doc[-1]), int(counts[-1])

    @staticmethod
    def _without(rows: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
        return rows.filter(pa.array((_groups(rows)[1] != keep).any(axis=1)))


def repeated_lines(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, part, lines, at): places that ``min_docs`` documents share, but for those of the largest document."""
    ranged = hashes.repartitionByRange("hash", "more", F.desc_nulls_last("doc"))
    ordered = checkpoint(ranged.sortWithinPartitions("hash", "more", F.desc_nulls_last("doc"), "part"))
    edges = _edges(ordered)  # two rows a partition at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(min_docs)
        for batch in batches:
            if batch.num_rows:
                for out in stream.take(batch):
                    yield pa.RecordBatch.from_arrays([out.column(k) for k in range(2, 6)], names=["doc", "part", "lines", "at"])

    joined = ordered.join(F.broadcast(edges), ["hash", "more"], "left")
    return joined.select("hash", "more", "doc", "part", "lines", "at", "docs", "known", "top").mapInArrow(run, "doc long, part long, lines int, at binary")


@F.pandas_udf(BinaryType())
def _packed(lines: pd.Series, at: pd.Series) -> pd.Series:
    out = []
    for n, places in zip(lines, at):
        keep = np.ones(n, bool)
        keep[np.frombuffer(b"".join(places), "<i4")] = False
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pd.Series(out, dtype=object)


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, part, bitmap): a bit for every line, set where it stays, compressed; documents that lose lines only."""

    places = dropped.groupBy("doc", "part").agg(F.max("lines").alias("lines"), F.collect_list("at").alias("at"))
    return places.select("doc", "part", _packed("lines", "at").alias("bitmap"))


@F.pandas_udf(KEPT)
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.DataFrame:
    out, dropped = [], []
    for t, b in zip(text, bitmap):
        if b is None:
            out.append(None)
            dropped.append(0)
            continue
        lines = t.split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), count=len(lines)).astype(bool)
        out.append("\n".join([lines[k] for k in np.flatnonzero(keep)]))
        dropped.append(int(len(keep) - keep.sum()))
    return pd.DataFrame({"text": pd.Series(out, dtype=object), "dropped": dropped})


def deduplicate_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped): the text of the lines that stay; ``row`` holds the other columns."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
        F.col(doc_id).cast("long").alias("doc"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("part", F.xxhash64("text"))
    bitmaps = checkpoint(keep_bitmaps(repeated_lines(line_hashes(rows, min_chars), min_docs)))
    size = bitmaps.agg(F.sum(F.length("bitmap") + 64)).first()[0] or 0
    side = bitmaps.select(F.col("doc").alias("_doc"), F.col("part").alias("_part"), "bitmap")
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_part"))
    joined = rows.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, same, "left")
    kept = _kept(F.when(F.col("bitmap").isNotNull(), F.col("text")), F.col("bitmap"))
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    found = joined.select("row", "text", lines.alias("n_lines"), kept.alias("_kept"))
    return found.select("row", F.coalesce("_kept.text", "text").alias("kept_text"), "n_lines", F.col("_kept.dropped").alias("n_dropped"))


def op13_line_dedup(docs: DataFrame) -> DataFrame:
    """The digest of every document without the lines that others repeat."""
    found = deduplicate_lines(docs.select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.r, k.doc_id, k.nth, k.line, g.key IS NOT NULL AND k.doc_id <> g.top AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
