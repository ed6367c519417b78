"""Chat formatting with typed content parts.

Every turn becomes one segment of text. A visitor flattens its content parts in order: text is
escaped, and an image, audio clip or document becomes a placeholder with an attachment record and
the number of tokens the placeholder expands to. Segments are made row by row, without a shuffle;
a conversation is the concatenation of its segments in turn order.

A segment is ``<|turn|>role<|body|>content<|end|>\\n``. Roles and texts are escaped: a backslash is
doubled, and one is put after the first character of any control string, so no control string is
left inside them and removing the backslashes gives back the text exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Control strings of this template and of other common ones. Fixed values.
CONTROL = re.compile(r"<\|[a-z_]+\|>|</?s>|\[/?INST\]|<</?SYS>>")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)

SEGMENT = (
    "conv_id long, turn long, role string, segment string, spans array<struct<start:int,stop:int>>, "
    "loss boolean, attachments array<struct<kind:string,ref:string,start:int,tokens:long>>, extra_tokens long"
)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@dataclass
class PartVisitor:
    """Flattens content parts into text, spans of ordinary text, attachments and token counts."""

    patch: int = 14
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 256
    text: list[str] = field(default_factory=list)
    spans: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def _put(self, piece: str) -> tuple[int, int]:
        start, self.length = self.length, self.length + len(piece)
        self.text.append(piece)
        return start, self.length

    def control(self, piece: str) -> None:
        self._put(piece)

    def visit(self, part: dict) -> None:
        """An unknown or missing type is text."""
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        start, stop = self._put(escape(part.get("text") or ""))
        if stop > start:
            self.spans.append({"start": start, "stop": stop})

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        start, _ = self._put(f"<|{kind}|>")
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "start": start, "tokens": tokens})

    def visit_image(self, part: dict) -> None:
        columns, rows = (max(1, math.ceil((part.get(side) or 0) / self.patch)) for side in ("width", "height"))
        self._attach("image", part, columns * rows)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0.0) * self.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * self.tokens_per_page)


def text_parts(conversations: DataFrame) -> DataFrame:
    """Plain rows ``conv_id, turn, role, text`` as rows with one text part (null text: empty)."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                    *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.array(part).alias("parts"),
    )


def format_turns(turns: DataFrame, **sizes) -> DataFrame:
    """One segment per row of ``conv_id, turn, role, parts``.

    ``spans`` are the places of ordinary (escaped) text inside the segment, ``loss`` says that they
    are trained on (role ``assistant``), ``attachments`` are the placeholders in order, and
    ``extra_tokens`` is the sum of what these expand to. Null roles and parts count as empty; parts
    of unknown type are text; sizes that are missing count as the smallest attachment.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                visitor = PartVisitor(**sizes)
                visitor.control(TURN + escape(row["role"] or "") + BODY)
                for part in row["parts"] or []:
                    visitor.visit(part or {})
                visitor.control(END)
                rows.append({
                    "conv_id": row["conv_id"], "turn": row["turn"], "role": row["role"], "segment": "".join(visitor.text),
                    "spans": visitor.spans, "loss": row["role"] == "assistant", "attachments": visitor.attachments,
                    "extra_tokens": sum(a["tokens"] for a in visitor.attachments),
                })
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("loss", pa.bool_()),
        ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("start", pa.int32()), ("tokens", pa.int64())]))),
        ("extra_tokens", pa.int64()),
    ])
    return turns.select("conv_id", "turn", "role", "parts").mapInArrow(segments, SEGMENT)


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment, read back from it alone (placeholders stay in the text)."""
    head, body = segment[len(TURN):-len(END)].split(BODY, 1)
    return unescape(head), unescape(body)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachments long, extra_tokens long"


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments in turn order.

    The digests run over a whole conversation by definition, so its segments pass through one task;
    they are streamed in sorted order and only the running hashes are held. Turns with equal numbers
    are ordered by segment. Rows with a null ``conv_id`` are one conversation.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None

        def row():
            turns, loss, (n, n_loss, chars, attached, extra) = state
            return {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": n_loss, "loss_sha256": loss.hexdigest(),
                    "formatted_chars": chars, "attachments": attached, "extra_tokens": extra}

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != key:
                    if state is not None:
                        rows.append(row())
                    key, state = r["conv_id"], (hashlib.sha256(), hashlib.sha256(), [0] * 5)
                turns, loss, sums = state
                role, text = read_segment(r["segment"])
                turns.update(f"{role}\n{text}\n".encode())
                sums[0] += 1
                if r["loss"]:
                    for span in r["spans"]:
                        plain = unescape(r["segment"][span["start"]:span["stop"]])
                        loss.update(plain.encode())
                        sums[1] += len(plain)
                sums[2] += len(r["segment"])
                sums[3] += len(r["attachments"])
                sums[4] += r["extra_tokens"]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in DIGEST.split(", "))])
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment").mapInArrow(digest, DIGEST)
