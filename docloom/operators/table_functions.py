"""The chunkers as table functions, for users of SQL.

``register(spark)`` makes them known to a session:

* ``text_chunks(text, extension)``, by row: ``FROM docs d, LATERAL text_chunks(d.text, d.extension) c``.
  A narrow pass; nothing is shuffled.
* ``text_sentences(text)``, by row: numbered sentences.
* ``packed_chunks(TABLE(...) PARTITION BY id ORDER BY n)``: packs the rows (id, n, sentence) of every partition,
  wherever the sentences come from.  It holds one chunk, however many sentences a partition has.

Null texts have no rows; a null extension is cut into windows; null and empty sentences are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from . import chunking


class TextChunks:
    """Chunks of one text by the strategy of its extension."""

    def eval(self, text: str, extension: str) -> Iterator[tuple[int, str, bool]]:
        if text is None:
            return
        kind = chunking.STRATEGY.get(extension, "sliding_window")
        if kind == "table_rows":
            found = chunking.table_chunks(text)
        else:
            cut = chunking.pack_sentences(chunking.cut_sentences(text)) if kind == "semantic" else chunking.cut_windows(text)
            found = [(c, False) for c in cut]
        for k, (content, table) in enumerate(found):
            yield k, content, table


class TextSentences:
    """Numbered sentences of one text."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunking.cut_sentences(text or ""))


class PackedChunks:
    """Packed sentences of a partition of rows (id, n, sentence), which come in order."""

    def __init__(self):
        self.packer, self.count, self.id = chunking.Packer(), 0, None

    def _rows(self, chunks: list[str]) -> Iterator[tuple[int, int, str]]:
        for content in chunks:
            yield self.id, self.count, content
            self.count += 1

    def eval(self, row: Row) -> Iterator[tuple[int, int, str]]:
        self.id = row[0]
        if row[2]:
            yield from self._rows(self.packer.add(row[2]))

    def terminate(self) -> Iterator[tuple[int, int, str]]:
        yield from self._rows(self.packer.close())


FUNCTIONS = {
    "text_chunks": (TextChunks, "chunk_index int, content string, is_table boolean"),
    "text_sentences": (TextSentences, "n int, sentence string"),
    "packed_chunks": (PackedChunks, "id long, chunk_index int, content string"),
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    for name, (made, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made, returnType=schema))
