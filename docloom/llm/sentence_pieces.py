"""SentencePiece encoding and decoding over a lattice of pieces.

The words of a text (a run of the space mark and what follows it) are encoded one by
one, which is exact: no piece of the models in use holds a mark after another
character.  A word's lattice has an edge for every substring of bounded length that is
in the piece table.  The lattice is folded from left to right; for every end position
the fold keeps the one last edge that the model's own segmentation of that prefix ends
in.  For unigram models that is the edge of best summed score (Viterbi); for byte-pair
models, whose scores are merge ranks and don't add up, it is the edge that may follow
the last edge of its own prefix, so results equal those of the reference library.

Distinct words are encoded once per Python worker (a memo bounded in bytes), in order,
so that a word's fold starts where the word before it differs; the pass over the documents is
narrow, so nothing is shuffled.  ``encode_words`` is the same lattice as joins and
aggregations for tables of distinct words.

Defined results: a null or empty text has no tokens; characters outside the table
become byte pieces; a very long text takes time in proportion to its length, also without
a blank; repeated rows stay; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

MARK = "▁"
#: Bytes that the words a worker remembers may take, about, and those of a word besides its characters.
MEMO_BYTES, WORD_BYTES = 192 << 20, 250
#: Pairs of pieces that a worker remembers.
PAIRS = 1_000_000
#: Characters of the texts that are encoded at once.
STEP = 4_000_000
#: Last characters of a piece that tell which lengths are worth a look.
TAIL = 3
#: Score of a character outside the table.
UNKNOWN = -1e4
_MARKED = re.compile(f"(?<!{MARK})(?={MARK})")


class Pieces:
    """The piece table of a model; plain data, so it travels with a task."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], is_bpe: bool = True):
        self.pieces, self.is_bpe, self.byte_ids = pieces, is_bpe, byte_ids
        special = set(byte_ids) | {0, 1, 2}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.scores = scores
        self.longest = max(map(len, self.ids), default=1)
        # merge order; single characters are there from the start
        ordered = sorted((i for i in self.ids.values() if len(pieces[i]) > 1), key=lambda i: (-scores[i], i))
        self.rank = dict.fromkeys(self.ids.values(), -1) | {i: n for n, i in enumerate(ordered)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.follows: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.held = 0
        self.short = tuple(range(TAIL - 1, 0, -1))
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) >= TAIL:
                tails.setdefault(p[-TAIL:], set(self.short)).add(len(p))
        self.by_tail = {t: tuple(sorted(n, reverse=True)) for t, n in tails.items()}
        self.raw = [
            bytes([byte_ids.index(i)]) if i in special and i in byte_ids else ("" if i in special else p).encode()
            for i, p in enumerate(pieces)
        ]

    def __getstate__(self) -> dict:
        return {"args": (self.pieces, self.scores, self.byte_ids, self.is_bpe)}

    def __setstate__(self, state: dict) -> None:
        self.__init__(*state["args"])

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a model file, on the driver."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        return cls(
            [model.id_to_piece(i) for i in range(n)],
            [model.get_score(i) for i in range(n)],
            [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
        )

    def symbols(self, word: str) -> list[int]:
        """Ids of the characters; one that is no piece is a negative symbol of its own."""
        return [self.ids.get(c, -ord(c) - 1) for c in word]

    def string(self, token: int) -> str:
        return self.pieces[token] if token >= 0 else chr(-token - 1)

    def merges(self, word: str) -> tuple[list[int], tuple[int, int] | None]:
        """Byte-pair merges, best score and then leftmost first, from a heap of neighbours:
        the tokens, and the last pair that was merged."""
        tokens, n = self.symbols(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (whole := self.ids.get(self.string(tokens[i]) + self.string(tokens[j]))) is not None:
                heappush(heap, (-self.scores[whole], i, tokens[i], tokens[j], whole))

        for i in range(n - 1):
            offer(i)
        gone, last = None, None
        while heap:
            _, i, left, right, whole = heappop(heap)
            j = after[i]
            if j >= n or tokens[i] != left or tokens[j] != right:
                continue  # one of the two has been merged since
            last = (left, right)
            tokens[i], tokens[j] = whole, gone
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in tokens if t is not gone], last

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens that a piece is merged from."""
        if token not in self.halves:
            tokens, last = self.merges(self.pieces[token])
            self.halves[token] = last if len(tokens) == 1 and last else (token, token)
        return self.halves[token]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` as neighbours when they stand side by side."""
        key = (a << 32) ^ b if a >= 0 <= b else None
        if key is None:
            return True
        if (known := self.follows.get(key)) is not None:
            return known
        limit, x, y, out = 1 << 60, a, b, True
        while True:
            whole = self.ids.get(self.string(x) + self.string(y))
            if whole is not None and self.rank[whole] < limit:
                out = False
                break
            rx, ry = self.rank[x] if x >= 0 else -1, self.rank[y] if y >= 0 else -1
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                limit, (_, x) = rx, self.split(x)
            else:
                limit, (y, _) = ry + 1, self.split(y)
        if len(self.follows) >= PAIRS:
            self.follows.clear()
        self.follows[key] = out
        return out

    def fold(self, words: list[str]) -> Iterator[list[int]]:
        """Tokens of sorted words, each by a left fold over its lattice.

        The fold of a word goes on from the prefix that it shares with the word before.
        """
        get, pieces, follows, bpe = self.ids.get, self.pieces, self.follows.get, self.is_bpe
        by_tail, short = self.by_tail, self.short
        before, last, best = "", [(0, -1)], [0.0]
        for word in words:
            if bpe and MARK * 2 in word:
                yield self.merges(word)[0]  # runs of marks hold pieces of equal rank
                continue
            n, shared = len(word), 0
            limit = min(n, len(before))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            before = word
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, n + 1):
                found, top = None, -math.inf
                # lengths, longest first, of the pieces with the same last characters
                for size in (by_tail.get(word[end - TAIL : end]) or short) if end >= TAIL else short:
                    start = end - size
                    if start < 0:
                        continue
                    piece = get(word[start:end])
                    if piece is None:
                        if size > 1:
                            continue
                        piece = -ord(word[start]) - 1
                    if not bpe:
                        score = best[start] + (self.scores[piece] if piece >= 0 else UNKNOWN)
                        if score > top:
                            top, found = score, (start, piece)
                    else:
                        left = last[start][1]
                        if start == 0 or left < 0 or piece < 0:
                            found = (start, piece)
                            break
                        known = follows((left << 32) ^ piece)
                        if self.may_follow(left, piece) if known is None else known:
                            found = (start, piece)
                            break
                last.append(found)
                best.append(top)
            out, at = [], n
            while at:
                at, piece = last[at]
                out.append(piece)
            out.reverse()
            yield out

    def word_bytes(self, tokens: list[int]) -> bytes:
        """Tokens as int32 bytes, byte pieces for those outside the table."""
        if min(tokens, default=0) < 0:
            flat: list[int] = []
            for t in tokens:
                flat += [t] if t >= 0 else [self.byte_ids[b] for b in chr(-t - 1).encode("utf-8", "replace")]
            tokens = flat
        return array("i", tokens).tobytes()

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts as int32 bytes; words that the memo lacks are folded together, in order."""
        memo, split = self.memo, []
        for text in texts:
            if not text:
                words = []
            elif "  " in text or text[0] == " " or MARK in text:  # longer runs of marks: words as they are
                words = _MARKED.split(MARK + text.replace(" ", MARK))[1:]
            else:
                words = text.replace("\n", " \n").split(" ")
            split.append(words)
        if self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        # a line's first word has no mark before it, and words with marks are whole already
        whole = {w if w[:1] in ("\n", MARK) else MARK + w: w for words in split for w in words if w not in memo}
        fresh = sorted(whole)
        for w, tokens in zip(fresh, self.fold(fresh)):
            memo[whole[w]] = self.word_bytes(tokens)
            self.held += WORD_BYTES + 4 * len(w)
        return [b"".join([memo[w] for w in words]) for words in split]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as int32 bytes."""
        return self.encode_texts([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: the first space is the one that encoding put in."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, pieces: Pieces, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with ids (array<int>), n_tokens and round_trip (decoding gives the text back)."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())).add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(keep))), 0).to_numpy().astype(np.int64)
            steps = np.cumsum(sizes) // STEP  # bounds the words and ids held at once
            for at, to in itertools.pairwise([*np.flatnonzero(np.diff(steps, prepend=-1)), batch.num_rows]):
                part = batch.slice(at, to - at)
                texts = part.column(len(keep)).to_pylist()
                coded = [np.frombuffer(c, "<i4") for c in pieces.encode_texts(texts)]
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype("<i4")
                flat = np.concatenate(coded) if coded else np.zeros(0, "<i4")
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                back = [pieces.decode(c) == (t or "").replace(MARK, " ") for c, t in zip(coded, texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i) for i in range(len(keep))],
                        pa.array([len(c) for c in coded], pa.int64()),
                        ids,
                        pa.array(back, pa.bool_()),
                    ],
                    names=[*keep, "n_tokens", "ids", "round_trip"],
                )

    return rows.mapInArrow(run, schema)


def _edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, s, e, id, piece, score): every substring of bounded length that is a piece, and every single character."""
    rows = [(p, i, float(pieces.scores[i])) for p, i in pieces.ids.items()]
    table = words.sparkSession.createDataFrame(rows, "piece string, id int, score double")
    long = F.length("word")
    spans = words.select(
        "word",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(1), long),
                    lambda s: F.transform(
                        F.sequence(F.lit(1), F.least(F.lit(pieces.longest), long - s + 1)),
                        lambda n: F.struct(s.alias("s"), (s + n).alias("e"), F.substring(F.col("word"), s, n).alias("piece")),
                    ),
                )
            )
        ).alias("x"),
    ).select("word", "x.*")
    # the model file bounds this broadcast
    known = spans.join(F.broadcast(table), "piece", "left").where(F.col("id").isNotNull() | (F.col("e") - F.col("s") == 1))
    return known.select("word", "s", "e", F.coalesce("id", -F.ascii("piece") - 1).alias("id"), "piece", F.coalesce("score", F.lit(UNKNOWN)).alias("score"))


def _allowed(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """``edges`` with prev: ids of the edges before it that the merges leave as its neighbours."""
    after = edges.select("word", F.col("e").alias("s"), F.col("id").alias("left"))
    beside = edges.select("word", "s", "id").join(after, ["word", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [pieces.may_follow(a, b) for a, b in zip(*(c.to_pylist() for c in batch.columns))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    pairs = beside.select("left", "id").distinct().mapInArrow(run, "left int, id int")
    prev = beside.join(pairs, ["left", "id"]).groupBy("word", "s", "id").agg(F.collect_set("left").alias("prev"))
    return edges.join(prev, ["word", "s", "id"], "left")


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """Lattice of distinct ``words(word)`` in relational form.

    Bounded substrings are exploded and equi-joined to the piece table; edges are grouped
    by word and folded with ``aggregate``.  Returns (word, pieces array<string>, ids, score).
    Additive scores: the best sum, the shorter last piece on ties.  Byte-pair models: every
    end keeps its longest edge whose left neighbour the merges allow; neighbours are pairs
    of edges of one word, and each distinct pair is judged once.  A group is one word's
    edges.  Words with runs of marks (see ``Pieces.fold``) are no input of this form.
    """
    edges = _edges(words, pieces)
    if pieces.is_bpe:
        edges = _allowed(edges, pieces)
    else:
        edges = edges.withColumn("prev", F.lit(None).cast("array<int>"))
    order = F.struct("e", "s", "score", "piece", "id", "prev")
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(order)).alias("edges"))
    kind = "map<int,struct<score:double,id:int,pieces:array<string>,ids:array<int>>>"
    nothing = F.struct(
        F.lit(0.0).alias("score"), F.lit(0).alias("id"), F.array().cast("array<string>").alias("pieces"), F.array().cast("array<int>").alias("ids")
    )
    start = F.create_map(F.lit(1), nothing).cast(kind)

    def step(acc, x):
        before, kept = F.try_element_at(acc, x["s"]), F.try_element_at(acc, x["e"])
        now = F.struct(
            (before["score"] + x["score"]).alias("score"),
            x["id"].alias("id"),
            F.concat(before["pieces"], F.array(x["piece"])).alias("pieces"),
            F.concat(before["ids"], F.array(x["id"])).alias("ids"),
        )
        if pieces.is_bpe:  # by end and then start: the first that is allowed is the longest
            better = kept.isNull() & ((x["s"] == 1) | F.array_contains(x["prev"], before["id"]))
        else:
            better = kept.isNull() | (now["score"] >= kept["score"])
        others = F.map_filter(acc, lambda k, _: k != x["e"])
        return F.when(F.coalesce(better, F.lit(False)), F.map_concat(others, F.create_map(x["e"], now))).otherwise(acc).cast(kind)

    best = F.element_at(F.aggregate("edges", start, step), F.length("word") + 1)
    return grouped.select("word", best["pieces"].alias("pieces"), best["ids"].alias("ids"), best["score"].alias("score"))


def default_model() -> str:
    """The public byte-pair model of the box; every function takes another path as well."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentence_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Tokens of every document, and whether decoding gives its text back."""
    return encode(docs.select("doc_id", "text"), Pieces.load(path or default_model()))
