"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into one
string with ordered placeholders and records attachment references and the
tokens that each placeholder expands to. The template marks turns; control
strings inside roles and texts are escaped, so the output can be read back.

    <|turn|>ROLE\\n CONTENT <|end|>\\n        (without the blanks)

A backslash precedes the second character of a control string and every
backslash of a text is doubled; reading back drops one backslash of each pair.
Neighbouring text parts are escaped as one text, so that none of them ends a control
string that another begins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

TURN, END = "<|turn|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Control strings that texts must not contain as such (fixed values).
CONTROLS = [
    TURN, END, *PLACEHOLDERS.values(),
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
]

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)
_PLACE = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))
_KIND = {v: k for k, v in PLACEHOLDERS.items()}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class PartVisitor:
    """Flattens one turn. ``visit`` dispatches on a part's type; parts of unknown
    type count as text."""

    def __init__(self, role: str, learn: bool):
        self.out = [TURN, escape(role).replace("\n", "\\\n"), "\n"]
        self.size = sum(map(len, self.out))
        self.learn = learn
        self.loss: list[dict] = []
        self.texts: list[str] = []  # text parts since the last attachment
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def _put(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def _flush(self) -> None:
        start = self.size
        self._put(escape("".join(self.texts)))
        self.texts = []
        if self.learn and self.size > start:
            self.loss.append({"start": start, "end": self.size})

    def _attach(self, part: dict) -> None:
        self._flush()
        self.attachments.append({"type": part["type"], "ref": part.get("ref"), "position": self.size, "n_tokens": part.get("n_tokens") or 0})
        self._put(PLACEHOLDERS[part["type"]])

    visit_image = visit_audio = visit_document = _attach

    def done(self) -> str:
        self._flush()
        self._put(END + "\n")
        return "".join(self.out)


PART = "struct<type:string, text:string, ref:string, n_tokens:long>"
FORMATTED = (
    "conv_id long, turn long, formatted string, loss array<struct<start:long, end:long>>, "
    "attachments array<struct<type:string, ref:string, position:long, n_tokens:long>>, expanded_tokens long"
)


def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted row for each row of ``turns`` (conv_id, turn, role, parts).

    ``loss`` has the spans, in code points of ``formatted``, to learn from: the
    texts of the roles in ``learn``, a span for each run of text parts. ``attachments`` lists the placeholders in
    order with their references and positions; ``expanded_tokens`` is the number
    of tokens they stand for. Null roles are '', null or empty parts give an empty
    turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        ref_type = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("n_tokens", pa.int64())]))
        for batch in batches:
            text, loss, refs, extra = [], [], [], []
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                v = PartVisitor(role or "", role in learn)
                for part in parts or []:
                    if part is not None:
                        v.visit(part)
                text.append(v.done())
                loss.append(v.loss)
                refs.append(v.attachments)
                extra.append(sum(a["n_tokens"] for a in v.attachments))
            cols = [batch.column("conv_id"), batch.column("turn"), pa.array(text, pa.string()), pa.array(loss, loss_type), pa.array(refs, ref_type), pa.array(extra, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "turn", "formatted", "loss", "attachments", "expanded_tokens"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("parts").cast(f"array<{PART}>").alias("parts"))
    return map_arrow(rows, run, FORMATTED)


def parse_turn(formatted: str) -> tuple[str, list[tuple[str, str]]]:
    """(role, parts as (type, text or '')) of one formatted turn."""
    body = formatted[len(TURN) : -len(END) - 1]
    m = _ROLE.match(body)
    content, parts, at = body[m.end() :], [], 0
    for p in _PLACE.finditer(content):
        if p.start() > at:
            parts.append(("text", unescape(content[at : p.start()])))
        parts.append((_KIND[p[0]], ""))
        at = p.end()
    if at < len(content):
        parts.append(("text", unescape(content[at:])))
    return unescape(m[1]), parts


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of every conversation from its formatted turns alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (texts under the loss mask, unescaped) and
    formatted_chars. Turns go by turn number (null first); turns that repeat a
    number go by their formatted text. Digests are updated turn by turn, so a
    conversation of any length takes constant memory. A null conv_id is one
    conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(c, s):
            return {"conv_id": c, "n_turns": s[0], "turns_sha256": s[1].hexdigest(), "loss_chars": s[2], "loss_sha256": s[3].hexdigest(), "formatted_chars": s[4]}

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now, state = None, None
        for batch in batches:
            out = []
            for conv, text, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, parts = parse_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{''.join(t for _, t in parts)}\n".encode())
                for span in loss or []:
                    learnt = unescape(text[span["start"] : span["end"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row(now, state)], schema)

    rows = formatted.select("conv_id", "turn", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_arrow(rows, run, schema)


def text_parts(turns: DataFrame) -> DataFrame:
    """Turns with a plain text column as turns of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("n_tokens"))
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_and_read(turns: DataFrame) -> DataFrame:
    """Format plain-text conversations, write the result and read it back."""
    return read_back(materialise(format_turns(text_parts(turns)), "chat"))
