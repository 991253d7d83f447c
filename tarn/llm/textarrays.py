"""Arrow text columns as flat numpy arrays, so that per-word work is done for whole slices of a batch.

A word is a maximal run of bytes outside ASCII white space (0x20, 0x09-0x0D).  Those bytes never occur inside a
multi-byte UTF-8 character, so splitting bytes and splitting code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

BLANKS = [0x20, *range(0x09, 0x0E)]


def marking(characters: list[int]) -> bytes:
    """A table for ``Text.marked``."""
    return bytes(b in set(characters) for b in range(256))


SOLID = marking([b for b in range(256) if b not in BLANKS])


class Text(NamedTuple):
    """UTF-8 bytes of all rows and, per row, where they begin (one more entry than rows)."""

    data: np.ndarray
    offsets: np.ndarray

    def marked(self, table: bytes) -> np.ndarray:
        """Which bytes the table marks."""
        return np.frombuffer(self.data.tobytes().translate(table), bool)

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many marked bytes each row has."""
        total = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[self.offsets[1:]] - total[self.offsets[:-1]]).astype(np.int64)


class Words(NamedTuple):
    """codes: index into vocab for every word; first: per row, the index of its first word (one more than rows)."""

    codes: np.ndarray
    first: np.ndarray
    vocab: pa.Array

    def rows(self) -> np.ndarray:
        """The row of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def text_of(column: pa.Array) -> Text:
    """Null texts count as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return Text(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return Text(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])


def pieces(body: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``body`` as an Arrow binary array."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


def encoded(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def words_of(text: Text) -> Words:
    data, offsets = text
    solid = text.marked(SOLID)
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begin[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    at = np.flatnonzero(begin)
    body = np.frombuffer(data.tobytes().translate(None, bytes(BLANKS)), np.uint8)
    codes, vocab = encoded(pieces(body, np.flatnonzero(end) + 1 - at))
    return Words(codes, np.searchsorted(at, offsets), vocab)


def lines_of(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every \\n-split line: its row, a code shared by equal lines, and how many non-space bytes it has."""
    data, offsets = text
    feed = data == 10
    breaks = np.flatnonzero(feed)
    rows = len(offsets) - 1
    begins = np.concatenate([offsets[:-1], breaks + 1])
    row_of = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((begins, row_of))
    begins, row_of = begins[order], row_of[order]
    last = np.ones(len(begins), bool)
    last[:-1] = row_of[1:] != row_of[:-1]
    ends = np.empty(len(begins), np.int64)
    ends[:-1] = begins[1:] - 1
    ends[last] = offsets[1:][row_of[last]]
    codes, _ = encoded(pieces(np.frombuffer(data.tobytes().translate(None, b"\n"), np.uint8), ends - begins))
    solid = np.concatenate([[0], np.cumsum(text.marked(SOLID), dtype=np.int32)])
    return row_of, codes, solid[ends] - solid[begins]


def word_keys(vocab: pa.Array) -> list[str]:
    """Every vocabulary word lower-cased and without non-word characters at its ends ('' where none is left)."""
    return [_bare(w.decode("utf-8", "replace").lower()) for w in vocab.to_pylist()]


def _bare(word: str) -> str:
    if word.isalnum():
        return word
    first, last = 0, len(word)
    while first < last and not word[first].isalnum():
        first += 1
    while last > first and not word[last - 1].isalnum():
        last -= 1
    return word[first:last]
