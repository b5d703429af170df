"""Chat formatting with typed content parts.

A message is a list of typed parts.  A visitor flattens them in order: text parts are
escaped, image, audio and document parts become placeholders; every attachment is
recorded with its reference and the tokens its placeholder stands for.  The template
marks each turn::

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Inside texts ``<|`` is written ``<\\|``: one backslash goes in after ``<`` wherever
``<``, any backslashes and ``|`` follow one another, so no text can hold a control
string, and taking one backslash out restores it exactly.

Formatting is a narrow pass: one segment per turn, and a conversation is its segments
in order of turn.  Reading back streams the segments of a partition that is sorted by
conversation and turn, so memory does not grow with a conversation.  A digest over the
turns of one conversation is sequential by definition: one conversation is one task's
work (its rows are never held together).

Defined results: a null text is empty, a null role ``user``; malformed parts are text or
have default sizes (see ``parts_of`` and ``number``); a very long text is one segment; repeated rows are turns of
their own; equal turns are ordered by role and text; a null conv_id is a conversation;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
#: Placeholders by part type, and the tokens one stands for: fixed, or by size in the part.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
IMAGE_PATCH = 14
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 700
#: Largest size of a part that is believed.
MOST = 1_000_000
TRAINED_ROLES = frozenset({"assistant"})

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stays on one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


@dataclass
class Flattened:
    """What the visitor leaves: content, spans of text within it, attachments, tokens."""

    content: list[str] = field(default_factory=list)
    length: int = 0
    text_spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    placeholder_tokens: int = 0

    def add(self, piece: str) -> None:
        self.content.append(piece)
        self.length += len(piece)


def number(value, default: int) -> int:
    """A size of a part; one that is missing, no number or not in 1..MOST is the default."""
    try:
        n = int(value)
    except (TypeError, ValueError, OverflowError):
        return default
    return n if 1 <= n <= MOST else default


class PartVisitor:
    """Dispatches on the type of a part; an unknown type is kept as a document."""

    def visit(self, part: dict, out: Flattened) -> None:
        visits = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio}
        kind = part.get("type")
        visits.get(kind if isinstance(kind, str) else "", self.visit_document)(part, out)

    def visit_text(self, part: dict, out: Flattened) -> None:
        start, text = out.length, part.get("text")
        out.add(escape(text if isinstance(text, str) else "" if text is None else json.dumps(text, ensure_ascii=False)))
        out.text_spans.append((start, out.length))

    def visit_image(self, part: dict, out: Flattened) -> None:
        w, h = number(part.get("width"), IMAGE_PATCH), number(part.get("height"), IMAGE_PATCH)
        self._attach("image", part, -(-w // IMAGE_PATCH) * -(-h // IMAGE_PATCH), out)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        self._attach("audio", part, max(1, -(-number(part.get("ms"), 1) * AUDIO_TOKENS_PER_SECOND // 1000)), out)

    def visit_document(self, part: dict, out: Flattened) -> None:
        self._attach("document", part, number(part.get("pages"), 1) * DOCUMENT_TOKENS_PER_PAGE, out)

    def _attach(self, kind: str, part: dict, tokens: int, out: Flattened) -> None:
        ref = str(part.get("ref") or part.get("url") or "")
        out.attachments.append({"kind": kind, "ref": ref, "at": out.length, "tokens": tokens})
        out.placeholder_tokens += tokens
        out.add(PLACEHOLDERS[kind])


def parts_of(text: str | None, parts: str | None) -> list[dict]:
    """Typed parts of a row: the JSON list in ``parts``, or else the one text.

    What isn't JSON is a text part as it stands, a single value a list of one, and a part
    that is no object a text part.
    """
    if not parts:
        return [{"type": "text", "text": text or ""}]
    try:
        loaded = json.loads(parts)
    except (ValueError, RecursionError):
        loaded = [parts]
    loaded = loaded if isinstance(loaded, list) else [loaded]
    return [p if isinstance(p, dict) else {"type": "text", "text": p} for p in loaded]


def format_turn(role: str | None, text: str | None, parts: str | None = None) -> tuple[str, list, list, int]:
    """Segment of one turn, its loss spans within the segment, attachments, placeholder tokens."""
    role = "user" if role is None else role
    head = f"{START}{escape_role(role)}\n"
    out, visitor = Flattened(), PartVisitor()
    for part in parts_of(text, parts):
        visitor.visit(part, out)
    shift = len(head)
    loss = [(a + shift, b + shift) for a, b in out.text_spans] if role in TRAINED_ROLES else []
    for a in out.attachments:
        a["at"] += shift
    return f"{head}{''.join(out.content)}{END}\n", loss, out.attachments, out.placeholder_tokens


_SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + "\n", re.S)
_PLACEHOLDER = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))


def read_segment(segment: str) -> tuple[str, list[str]]:
    """Role and texts (unescaped, between placeholders) of a formatted turn."""
    m = _SEGMENT.fullmatch(segment)
    if not m or START in m[2] or END in m[2]:
        raise ValueError("not one formatted turn")
    return unescape_role(m[1]), [unescape(p) for p in _PLACEHOLDER.split(m[2])]


SEGMENT_SCHEMA = (
    "conv_id long, turn long, role string, segment string, loss array<struct<start:int,end:int>>, "
    "attachments array<struct<kind:string,ref:string,at:int,tokens:bigint>>, placeholder_tokens long"
)


def format_turns(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """One formatted segment per row of ``turns(conv_id, turn, role, text)``; a narrow pass.

    ``parts`` names a column of JSON lists of typed parts; where it is null the text is
    the only part.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.col("role").cast("string"),
        F.col("text").cast("string"),
        (F.col(parts) if parts else F.lit(None)).cast("string").alias("parts"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        attachment = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())])
        for batch in batches:
            done = [format_turn(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("role", "text", "parts")))]
            loss = [[{"start": a, "end": b} for a, b in x[1]] for x in done]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("turn"),
                    batch.column("role"),
                    pa.array([x[0] for x in done], pa.string()),
                    pa.array(loss, loss_type),
                    pa.array([x[2] for x in done], pa.list_(attachment)),
                    pa.array([x[3] for x in done], pa.int64()),
                ],
                names=["conv_id", "turn", "role", "segment", "loss", "attachments", "placeholder_tokens"],
            )

    return rows.mapInArrow(run, SEGMENT_SCHEMA)


DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def read_back(segments: DataFrame) -> DataFrame:
    """Digest of every conversation, from its formatted segments alone."""
    ordered = (
        segments.select("conv_id", "turn", "segment", "loss")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "segment")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        at = none
        state: list = []
        done: list[list] = []

        def close() -> None:
            if at is not none:
                n, turns, chars, loss, formatted = state
                done.append([at, n, turns.hexdigest(), chars, loss.hexdigest(), formatted])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            done.clear()
            return out

        for batch in batches:
            for conv, segment, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss"))):
                if at is none or conv != at:
                    close()
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, texts = read_segment(segment)
                state[0] += 1
                state[1].update(f"{role}\n{''.join(texts)}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    trained = unescape(segment[span["start"] : span["end"]])
                    state[2] += len(trained)
                    state[3].update(trained.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            if len(done) >= 1000:
                yield flush()
        close()
        if done:
            yield flush()

    return ordered.mapInArrow(run, DIGEST_SCHEMA)


def assemble(segments: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations, for writers that need one string each."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "segment")))
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["segment"]), "").alias("formatted"))


#: Fixed value: the text of both turns of conversation -1.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op5_chat(spark, sf_dir: str) -> DataFrame:
    """Digest of all conversations and of conversation -1, read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    return read_back(format_turns(turns.unionByName(probe)))
