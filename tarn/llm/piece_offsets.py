"""SentencePiece encoding and decoding that keeps track of the original bytes.

Normalisation walks the text by the longest prefix that the model's compiled character map knows (a double-array trie with
the replacements behind it; without a map every character stands for itself) and records, for every byte that it writes, where
the character or prefix that it comes from begins.  The pieces follow one another in the normalised text, so these records
project each of them to a span of the original bytes.  Where a character is written as several byte pieces, the last one
has its span and those before it are empty.

Defined results: a null text is the empty text, which has no piece but the end id; repeated rows are encoded alike; an empty
table gives no rows; only the columns in ``keep`` pass through, and they must not be named like a result.
"""

from __future__ import annotations

import codecs
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.textarrays import slices

SPACE = "▁"

codecs.register_error("each byte", lambda e: ("�" * (e.end - e.start), e.end))


class CharMap:
    """The compiled map: 4 bytes of length, the trie's 32-bit units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.first = {b for b in range(256) if self._child(self._offset(self.units[0]), b) is not None}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)

    def _child(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & (1 << 31 | 0xFF) == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:] and what stands for it."""
        base, found = self._offset(self.units[0]), None
        for end in range(at, len(data)):
            node = self._child(base, data[end])
            if node is None:
                break
            unit = self.units[node]
            base = node ^ self._offset(unit)
            if unit & 1 << 8:
                value = self.units[base] & (1 << 31) - 1
                found = end + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found


class Normaliser:
    """Normalises UTF-8 bytes; ``align`` has, for every byte written and for the end, an offset into the original bytes."""

    def __init__(self, charsmap: bytes, add_dummy_prefix: bool, remove_extra_whitespaces: bool, escape_whitespaces: bool) -> None:
        self.map = CharMap(charsmap) if charsmap else None
        self.dummy, self.squeeze = add_dummy_prefix, remove_extra_whitespaces
        self.space = SPACE.encode() if escape_whitespaces else b" "

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.map is None and not self.squeeze:
            return self._plain(data)
        return self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Every character stands for itself: no walk is needed."""
        source = np.frombuffer(data, np.uint8)
        begins = np.maximum.accumulate(np.where(source & 0xC0 != 0x80, np.arange(len(source)), 0))
        width = len(self.space)
        written = np.repeat(begins, np.where(source == 0x20, width, 1)) if width > 1 else begins
        out, lead = data.replace(b" ", self.space), np.zeros(width * self.dummy, np.int64)
        return (self.space + out if self.dummy else out), np.concatenate([lead, written, [len(data)]])

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        lead = data[at]
        if self.map is not None and lead in self.map.first and (found := self.map.longest(data, at)):
            return found
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return width, data[at : at + width]

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        at, begins, widths = 0, [], []
        out = bytearray()

        def write(text: bytes, begin: int) -> None:
            out.extend(text)
            begins.append(begin)
            widths.append(len(text))

        if self.squeeze:
            while at < len(data):
                width, text = self._prefix(data, at)
                if text != b" ":
                    break
                at += width
            if at == len(data):
                return b"", np.zeros(1, np.int64)
        if self.dummy:
            write(self.space, at)
        after_space = self.squeeze
        while at < len(data):
            width, text = self._prefix(data, at)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                write(text.replace(b" ", self.space), at)
                after_space = self.squeeze and text.endswith(b" ")
            at += width
        end = len(data)
        align = np.repeat(begins, widths)
        if self.squeeze:
            while out.endswith(self.space):
                end = int(align[len(out) - len(self.space)])
                del out[-len(self.space) :]
        return bytes(out), np.concatenate([align[: len(out)], [end]])


class Pieces:
    """Encoder and decoder for a SentencePiece model file that has byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, trained, kinds = model.normalizer_spec, model.trainer_spec, model.pieces[0].__class__
        if trained.treat_whitespace_as_suffix or not trained.byte_fallback or any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("models with space suffixes, without byte pieces or with symbols of their own are not handled")
        self.normalise = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.end = trained.eos_id
        of_kind = lambda kind: {i for i, p in enumerate(model.pieces) if p.type == kind}
        self.control, self.byte, self.unknown = of_kind(kinds.CONTROL), of_kind(kinds.BYTE), of_kind(kinds.UNKNOWN)
        written = [bytes([int(p.piece[3:5], 16)]) if i in self.byte else b"" if i in self.control else p.piece.encode() for i, p in enumerate(model.pieces)]
        self.lengths = np.array([len(w) for w in written], np.int64)
        self.texts = [trained.unk_surface.encode() if i in self.unknown else w if i in self.byte else w.replace(SPACE.encode(), b" ") for i, w in enumerate(written)]
        self.decimal = [str(i) for i in range(len(written))]
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())  # merges normalised text as it is

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids with the end id, and where each of them begins and ends in the text's UTF-8 bytes."""
        normal = [self.normalise(t.encode("utf-8")) for t in texts]
        out = []
        for found, (_, align) in zip(self.bare.encode([n.decode("utf-8") for n, _ in normal], num_threads=1), normal, strict=True):
            ids = np.array([*found, self.end], np.int64)
            ends = np.cumsum(self.lengths[ids])
            out.append((ids, align[np.concatenate([[0], ends[:-1]])], align[ends]))
        return out

    def decode(self, ids: list[int]) -> str:
        """Control ids have no text and end a run of byte pieces; one space symbol at the beginning belongs to the dummy prefix."""
        texts, at = self.texts, 0
        while at < len(ids) and ids[at] in self.control:
            at += 1
        head = []
        if self.normalise.dummy or self.normalise.squeeze:
            while at < len(ids) and ids[at] not in self.byte and ids[at] not in self.unknown:
                text = texts[ids[at]]
                head.append(text[1:] if text.startswith(b" ") else text)
                at += 1
                if head[-1] or not self.normalise.squeeze:
                    break
        out, begin = [], at
        for k in range(at, len(ids) + 1):  # bytes of one character do not go on behind a control id
            if k == len(ids) or ids[k] in self.control:
                out.append(b"".join([*head, *map(texts.__getitem__, ids[begin:k])]).decode("utf-8", "each byte"))
                head, begin = [], k
        return "".join(out)


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each model in a worker, so that its memo outlives a batch."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = True) -> DataFrame:
    """keep columns, n_tokens, ids_sha256, decoded_sha256, spans_crc32 (of begin and end of every piece as little-endian 64-bit
    integers) and, unless ``with_ids`` is off, ``ids``, ``begins`` and ``ends``."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("spans_crc32", T.LongType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("begins", "ends"))]
    schema = T.StructType([docs.schema[k] for k in keep] + fields)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for part in slices(batches, "_text"):
            rows: list[list] = [[] for _ in fields]
            for ids, begins, ends in own.encode_batch([t or "" for t in part["_text"].to_pylist()]):
                listed = ids.tolist()
                found = [
                    len(listed),
                    hashlib.sha256(" ".join(map(own.decimal.__getitem__, listed)).encode()).hexdigest(),
                    hashlib.sha256(own.decode(listed).encode("utf-8")).hexdigest(),
                    zlib.crc32(np.stack([begins, ends], 1).astype("<i8").tobytes()),
                    ids.astype(np.int32), begins, ends,
                ]
                for column, value in zip(rows, found, strict=False):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array(r, k) for r, k in zip(rows, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*part.columns[:width], *columns], [*keep, *(f.name for f in fields)])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """keep columns and the decoded text; null ids are no ids."""
    schema = T.StructType([encoded.schema[k] for k in keep] + [T.StructField("text", T.StringType())])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            texts = [own.decode(i or []) for i in batch["_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string())], [*keep, "text"])

    return encoded.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, schema)
