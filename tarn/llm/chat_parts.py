r"""Chat formatting with typed content parts.

A turn is a list of parts.  A visitor walks them in order and flattens each to text: text parts are escaped, image, audio
and document parts become ordered placeholders that stand for a number of model tokens and refer to an attachment.

Template, one segment a turn:   ``<|turn|>role\n`` escaped-content ``<|end|>\n``

Escaping is reversible: every backslash is doubled, and a backslash is put after the first character of every control
string, so no control string survives inside content; in a role, line feeds have a backslash too.  Reading back drops each
backslash and keeps what follows it.

Defined results: null text or null parts count as empty; a null role is the empty role; turns with a null conversation
form one conversation; equal turn numbers are ordered by role, then content; a conversation with no assistant turn has an
empty loss mask; an empty table gives no conversations.  Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of this template and of common chat formats that content must never contain.
CONTROL = ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(r"<\|turn\|>((?:\\.|[^\\\n])*)\n(.*)<\|end\|>\n", re.S)

PART = "struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"
SEGMENT = (
    "conv_id long, turn long, role string, segment string, loss_start long, loss_end long, "
    "attachments array<struct<position:long,kind:string,ref:string,n_tokens:long>>, n_media_tokens long"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Flattener:
    """Visits the parts of a turn; ``tile``, ``audio_rate`` and ``page_tokens`` say how many tokens a placeholder stands for."""

    def __init__(self, tile: int = 28, audio_rate: float = 25.0, page_tokens: int = 512) -> None:
        self.tile, self.audio_rate, self.page_tokens = tile, audio_rate, page_tokens

    def flatten(self, parts: list[dict] | None) -> tuple[str, list[dict]]:
        out, attached = [], []
        for part in parts or []:
            if part is None:
                continue
            visit = getattr(self, f"visit_{part['kind'] or 'text'}", None)
            if visit is None:
                raise ValueError(f"unknown content part: {part['kind']}")
            out.append(visit(part, attached))
        return "".join(out), attached

    def visit_text(self, part: dict, attached: list[dict]) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part: dict, attached: list[dict]) -> str:
        tiles = math.ceil((part["width"] or 0) / self.tile) * math.ceil((part["height"] or 0) / self.tile)
        return self._attach("image", part, max(1, tiles), attached)

    def visit_audio(self, part: dict, attached: list[dict]) -> str:
        return self._attach("audio", part, max(1, math.ceil((part["seconds"] or 0.0) * self.audio_rate)), attached)

    def visit_document(self, part: dict, attached: list[dict]) -> str:
        return self._attach("document", part, max(1, part["pages"] or 0) * self.page_tokens, attached)

    @staticmethod
    def _attach(kind: str, part: dict, tokens: int, attached: list[dict]) -> str:
        attached.append({"position": len(attached), "kind": kind, "ref": part["ref"], "n_tokens": tokens})
        return f"<|{kind}:{len(attached) - 1}|>"


def text_parts(column: Column | str = "text") -> Column:
    """A plain text column as a list with one text part."""
    null = F.lit(None)
    fields = [F.lit("text").alias("kind"), F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).alias("text"), null.alias("ref"), null.alias("width"), null.alias("height"), null.alias("seconds"), null.alias("pages")]
    return F.array(F.struct(*fields)).cast(f"array<{PART}>")


def format_turns(turns: DataFrame, flattener: Flattener | None = None, loss_role: str = "assistant") -> DataFrame:
    """Columns conv_id, turn, role and parts become one formatted segment for each turn, with its loss span and attachments.

    Each turn is formatted on its own, so no conversation is gathered in one place however long it is.
    """
    flat = flattener or Flattener()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                role = row["role"] or ""
                content, attached = flat.flatten(row["parts"])
                head = "<|turn|>" + escape(role).replace("\n", "\\\n") + "\n"
                learns = role == loss_role
                rows.append({"conv_id": row["conv_id"], "turn": row["turn"], "role": role, "segment": f"{head}{content}<|end|>\n", "loss_start": len(head), "loss_end": len(head) + len(content) * learns, "attachments": attached, "n_media_tokens": sum(a["n_tokens"] for a in attached)})
            schema = schema or pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", pa.list_(pa.struct([("position", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())]))), ("n_media_tokens", pa.int64())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(f"array<{PART}>")).mapInArrow(run, SEGMENT)


def read_back(segments: DataFrame) -> DataFrame:
    """Parses formatted segments again and digests each conversation: what was said, and what lies under the loss mask.

    Segments come sorted by conversation and turn, and the digests are fed turn by turn, so memory does not depend on how
    long a conversation is.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_media_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state, done = None, None, []

        def flush() -> None:
            n, turns, chars, loss, formatted, media = state
            done.append((open_id, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, media))

        def result() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_media_tokens"]
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end", "n_media_tokens")]
            for conv_id, segment, start, end, media in zip(*columns, strict=True):
                if state is None or conv_id != open_id:
                    if state is not None:
                        flush()
                    open_id, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, content = _SEGMENT.fullmatch(segment).groups()
                role, masked = unescape(role), unescape(segment[start:end])
                said = unescape(content)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(segment)
                state[5] += media
            if len(done) >= 4096:
                yield result()
                done.clear()
        if state is not None:
            flush()
        if done:
            yield result()

    parts = segments.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end", "n_media_tokens")
    content = F.substring("segment", F.col("loss_start") + 1, F.length("segment") - F.col("loss_start") - len("<|end|>\n"))
    said = F.regexp_replace(content, r"(?s)\\(.)", "$1")  # what was said, not how it is escaped, orders tied turns
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", said, "segment").mapInArrow(run, schema)
