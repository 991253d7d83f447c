"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts each text where its low bits are zero, so equal passages of different documents fall
into equal chunks wherever they stand.  A chunk is encoded once and kept in a bounded memo of the Python worker.  Cutting
changes the tokens near a cut, so every join is repaired: the text between a safe place left of the join and a safe place
right of it is encoded anew, and the places move outward until the fresh tokens and the kept ones agree on both borders.
A place is safe where a single space stands between two characters that are not white space: the byte-level split always
begins a piece there, whatever surrounds it, so the tokens on either side cannot depend on one another.

Reuse reaches as far as one worker's memo: sharing chunks across the cluster would shuffle every text and every token,
which costs more than encoding them.

Defined results: a null text is the empty text and has no tokens; repeated rows are encoded alike; an empty table gives no
rows; only the columns in ``keep`` pass through.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.textarrays import slices

WINDOW_BITS, MEMO_BYTES = 4, 48 << 20  # the hash sees 2^4 bytes
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64)
_SAFE = re.compile(rb"(?<=[!-~\x80-\xff]) (?=[!-~])")


def cuts(data: np.ndarray, mask_bits: int = 10, least: int = 256, most: int = 8192) -> list[int]:
    """End of every chunk.  Cuts stand where the rolling hash of the last 16 bytes is zero in its low bits, no chunk but the
    last is shorter than ``least`` bytes, none is longer than ``most``, and no character is split."""
    if len(data) <= least:
        return [len(data)] if len(data) else []
    rolled = _GEAR[data]
    for step in range(WINDOW_BITS):
        width = 1 << step
        wider = rolled.copy()
        wider[width:] += rolled[:-width] << np.uint64(width)
        rolled = wider
    mark = np.uint64(((1 << mask_bits) - 1) << 20)
    wanted = np.flatnonzero((rolled & mark) == 0) + 1
    out, last = [], 0
    for at in [*wanted.tolist(), len(data)]:
        while at - last > most:
            last = _character_start(data, last + most)
            out.append(last)
        at = at if at == len(data) else _character_start(data, at)
        if at - last >= least or at == len(data) > last:
            out.append(at)
            last = at
    return out


def _character_start(data: np.ndarray, at: int) -> int:
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return at


class Codec:
    """Encoder and decoder for a vocabulary in the tokenizers library's JSON format (byte-level BPE without normaliser).

    ``encode_piece`` turns one text into ids: a fast implementation of the same merges where the vocabulary's file of
    ranks is given, else the tokenizers library itself.
    """

    def __init__(self, path: str, ranks: str | None = None, memo_bytes: int = MEMO_BYTES) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        bytes_of = {c: b for b, c in byte_alphabet().items()}
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        vocab = spec["model"]["vocab"] | added
        self.table: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.table[i] = token.encode() if token in added else bytes(bytes_of[c] for c in token)
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self.decimal = np.zeros((len(self.table), 7), np.uint8)
        for i in range(len(self.table)):
            self.decimal[i, : len(str(i)) + 1] = list(b"%d," % i)
        self.young: dict[bytes, np.ndarray] = {}  # chunks met since the last change of generations
        self.old: dict[bytes, np.ndarray] = {}
        self.memo_bytes = memo_bytes
        self.young_bytes = self.reused = self.encoded = 0
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=added)
            self.encode_piece = lambda text: fast.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            self.encode_piece = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def chunk(self, data: bytes) -> np.ndarray:
        """The chunk's ids, from the memo where it is there.  Half of the memo's bytes are for the young generation; when they
        are used up it becomes the old one, so a chunk that is met again stays and one that is not goes."""
        key = hashlib.blake2b(data, digest_size=16).digest()
        found = self.young.get(key)
        if found is not None:
            self.reused += 1
            return found
        found = self.old.get(key)
        if found is None:
            found = self.encode_piece(data.decode("utf-8"))
            self.encoded += 1
        else:
            self.reused += 1
        size = found.nbytes + 120
        if self.young_bytes + size > self.memo_bytes // 2:
            self.old, self.young, self.young_bytes = self.young, {}, 0
        if size <= self.memo_bytes // 2:
            self.young[key] = found
            self.young_bytes += size
        return found

    def encode(self, text: str) -> np.ndarray:
        data = text.encode("utf-8")
        ends = cuts(np.frombuffer(data, np.uint8))
        if not ends:
            return np.zeros(0, np.uint32)
        if len(ends) == 1:
            return self.chunk(data)
        begins = [0, *ends[:-1]]
        met: dict[int, np.ndarray] = {}  # a chunk is looked up once, by its own turn or by the repair of the join before it

        def chunk_ids(k: int) -> np.ndarray:
            if k not in met:
                met[k] = self.chunk(data[begins[k] : ends[k]])
            return met[k]

        done: list[np.ndarray] = []
        done_to = 0  # tokens in ``done`` cover data[:done_to], a safe place
        for k, (begin, end) in enumerate(zip(begins, ends, strict=True)):
            if end <= done_to:
                continue
            ids = chunk_ids(k)
            edges = begin + np.cumsum(self.lengths[ids])
            if done_to > begin:  # a repair has reached into this chunk
                at = int(np.searchsorted(edges, done_to))
                if at == len(edges) or edges[at] != done_to:
                    ids = self.encode_piece(data[done_to:end].decode("utf-8"))
                    edges = done_to + np.cumsum(self.lengths[ids])
                else:
                    ids, edges = ids[at + 1 :], edges[at + 1 :]
            if k + 1 == len(ends):
                done.append(ids)
                break
            left, kept = self._left_border(data, edges, done_to, end)
            done.append(ids[:kept])
            right = self._right_border(data, begins, ends, k + 1, chunk_ids)
            met.pop(k, None)
            done.append(self.encode_piece(data[left:right].decode("utf-8")))
            done_to = right
        return np.concatenate(done)

    def _left_border(self, data: bytes, edges: np.ndarray, floor: int, end: int) -> tuple[int, int]:
        """The last safe place in the chunk where its tokens have a border, and how many tokens stand before it."""
        width = 64
        while True:
            low = max(floor, end - width)
            for m in reversed(list(_SAFE.finditer(data, max(0, low - 1), end))):
                at = int(np.searchsorted(edges, m.start()))
                if m.start() > floor and at < len(edges) and edges[at] == m.start():
                    return m.start(), at + 1
            if low == floor:
                return floor, 0
            width *= 4

    def _right_border(self, data: bytes, begins: list[int], ends: list[int], k: int, chunk_ids: Callable[[int], np.ndarray]) -> int:
        """The first safe place after the join where the next chunk's tokens have a border; past it, those of later ones."""
        for at_chunk in range(k, len(ends)):
            begin, end = begins[at_chunk], ends[at_chunk]
            edges = None
            for m in _SAFE.finditer(data, begin, end):
                if edges is None:
                    edges = begin + np.cumsum(self.lengths[chunk_ids(at_chunk)])
                at = int(np.searchsorted(edges, m.start()))
                if m.start() > begin and at < len(edges) and edges[at] == m.start():
                    return m.start()
        return len(data)

    def decode(self, ids: np.ndarray) -> str:
        table = self.table
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")

    def decimal_text(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        flat = self.decimal[ids].reshape(-1)
        return flat[flat != 0].tobytes()[:-1]


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes bytes as printable characters: those that are printable stand for themselves, the others follow
    one another from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_codecs: dict[tuple[str, str | None], Codec] = {}


def codec(path: str, ranks: str | None = None) -> Codec:
    """One codec for each vocabulary in a worker, so that its memo outlives a batch."""
    if (path, ranks) not in _codecs:
        _codecs[path, ranks] = Codec(path, ranks)
    return _codecs[path, ranks]


def encode_documents(docs: DataFrame, path: str, ranks: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = True) -> DataFrame:
    """keep columns, n_tokens, ids_sha256, decoded_sha256 and, unless ``with_ids`` is off, the ids themselves."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([docs.schema[k] for k in keep] + fields)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, ranks)
        for part in slices(batches, "_text"):
            all_ids = [own.encode(t or "") for t in part["_text"].to_pylist()]
            columns = [
                pa.array([len(i) for i in all_ids], pa.int64()),
                pa.array([hashlib.sha256(own.decimal_text(i)).hexdigest() for i in all_ids]),
                pa.array([hashlib.sha256(own.decode(i).encode("utf-8")).hexdigest() for i in all_ids]),
            ]
            if with_ids:
                columns.append(pa.array([i.astype(np.int32) for i in all_ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*part.columns[:width], *columns], [*keep, *(f.name for f in fields)])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """keep columns and the decoded text."""
    schema = T.StructType([encoded.schema[k] for k in keep] + [T.StructField("text", T.StringType())])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(i or [], np.int64)) for i in batch["_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string())], [*keep, "text"])

    return encoded.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, schema)
