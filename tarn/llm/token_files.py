"""Token-id files: encoded documents in key order, as independently decodable compressed blocks.

Documents are range-partitioned and sorted by key, tokenised, closed with an end id and packed into blocks of whole
documents, which the range coder compresses.  A block is one record of a Parquet dataset in the shared folder, written
through Spark's committer, with the keys and lengths of its documents as its index; so any store that Spark reaches will
do, and a lost executor costs its tasks only.

Words are encoded one by one: this vocabulary's normaliser and splitter never join characters across white space, so the
ids of a text are those of its words in order.  Every distinct word, or piece of a word where the splitter's cuts are
plain, goes through the tokenizers library once and is kept in a bounded memo.

Defined results: a null text is the empty text and holds the end id only; a null key sorts first; equal keys are ordered
by a hash of their texts; repeated rows are all stored; an empty table gives an empty dataset; only key and text are read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm import range_coder
from tarn.llm.bpe_chunks import byte_alphabet
from tarn.llm.storage import stored
from tarn.llm.textarrays import BLANKS, Text, slices, text_of

BLOCK_IDS, SHARD_BYTES, MEMO_UNITS, BATCH = 1 << 21, 24 << 20, 700_000, 1000
_OTHERS = re.compile(rb"[!-&(-/:-@\[-`{-~]+")

# The splitter of the word-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Kinds of bytes for that splitter: letters, digits and other characters of ASCII; words with anything else are units as they are.
LETTER, DIGIT, OTHER, WHOLE = 1, 2, 3, 4
_kind = np.full(256, WHOLE, np.uint8)
_kind[0x21:0x7F] = OTHER
_kind[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_kind[0x30:0x3A] = DIGIT
_kind[ord("'")] = WHOLE  # an apostrophe may begin a contraction, which the splitter keeps together
_kind[BLANKS] = 0
_KIND, _UPPER = _kind.tobytes(), bytes(0x41 <= b < 0x5B for b in range(256))
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")  # letters in every version of Unicode, and lower-case ones stay as they are
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONGEST = 15  # bytes of a unit that two 64-bit numbers hold beside its length


class Units(NamedTuple):
    """body: the texts without white space.  begin and size: of each unit in body.  whole: it is a word as it stands, not a
    plain piece.  first: per text, its first unit (one more than texts)."""

    body: bytes
    begin: np.ndarray
    size: np.ndarray
    whole: np.ndarray
    first: np.ndarray


def units_of(text: Text, plain: bool = True) -> Units:
    """The words of the texts, cut further where that is plain: words of printable ASCII without apostrophes and ``<|`` are
    lower-cased and cut into runs of letters, single digits and runs of other characters; all other words are one unit.
    Unless ``plain``, every word is one unit."""
    data, offsets = text
    raw = data.tobytes()
    kind = np.frombuffer(bytearray(raw.translate(_KIND)), np.uint8)
    solid = kind != 0
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    start[inner] = solid[inner]
    if not plain:
        kind[solid] = WHOLE
    elif b"<|" in raw:
        kind[:-1][(data[:-1] == ord("<")) & (data[1:] == ord("|"))] = WHOLE
    odd = np.flatnonzero(kind == WHOLE)
    lower = np.frombuffer(bytearray(raw.lower()), np.uint8)
    if len(odd):
        words = np.flatnonzero(start)
        hit = np.searchsorted(words, odd, "right") - 1
        hit = hit[np.diff(hit, prepend=-1) > 0]
        change = np.zeros(len(data) + 1, np.int8)
        change[words[hit]] += 1
        change[np.append(words, len(data))[hit + 1]] -= 1
        inside = np.cumsum(change[:-1], dtype=np.int8).view(bool)
        np.maximum(kind, inside.view(np.uint8) * np.uint8(WHOLE), out=kind, where=solid)
        upper = np.flatnonzero(inside & np.frombuffer(raw.translate(_UPPER), bool))
        lower[upper] = data[upper]
    cut = solid & (kind != WHOLE)
    cut[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    cut |= start
    end = solid.copy()
    end[:-1] &= cut[1:] | ~solid[1:]
    at = np.flatnonzero(cut)
    size = np.flatnonzero(end) + 1 - at
    return Units(lower.tobytes().translate(None, bytes(BLANKS)), np.cumsum(size) - size, size, kind[at] == WHOLE, np.searchsorted(at, offsets))


class Memo:
    """Numbers of units of up to LONGEST bytes: a table probed for many keys at once.  A key is two 64-bit numbers."""

    def __init__(self, bits: int = 21) -> None:
        self.bits, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.value = np.full(1 << bits, -1, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xFF51AFD7ED558CCD) >> self.bits).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is not known."""
        slot, open_keys, out = self._slot(low, high), np.arange(len(low)), np.full(len(low), -1, np.int32)
        while len(slot):
            value = self.value.take(slot)
            hit = (self.low.take(slot) == low) & (self.high.take(slot) == high) & (value >= 0)
            out[open_keys[hit]] = value[hit]
            more = np.flatnonzero((value >= 0) & ~hit)
            slot, open_keys, low, high = slot[more] + 1 & self.last, open_keys[more], low[more], high[more]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """Adds keys that differ from one another and are not known."""
        slot = self._slot(low, high)
        while len(slot):
            free = self.value.take(slot) < 0
            self.value[slot[free]] = value[free]
            won = free & (self.value.take(slot) == value)  # of several keys for one slot the last has it
            self.low[slot[won]], self.high[slot[won]] = low[won], high[won]
            slot, low, high, value = slot[~won] + 1 & self.last, low[~won], high[~won], value[~won]


class WordEncoder:
    """Ids of texts by way of their distinct units (see ``units_of``), each of which goes through the library once.

    A unit takes the library's own steps: its normaliser and its splitter unless the unit is plain, and its model for every
    piece.  New pieces go to the model in batches: joined by spaces, which it is told to split at, and told apart again by
    the tokens that end a word.  Words that could hold an added token are left to the library's whole encoder.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        known = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = max(known.values()) + 1
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.closes = np.zeros(self.vocabulary, bool)  # the tokens that end a word
        self.closes[[i for t, i in known.items() if suffix and t.endswith(suffix)]] = True
        self.alphabet = {b: c for b, c in byte_alphabet().items() if b != 0x20}
        # Whether the steps of ``units_of`` are those of the file: lower case, and a splitter of this very pattern.
        steps = [n["type"] for n in spec["normalizer"].get("normalizers", [])]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex")
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and pattern == SPLIT
        self._forget()

    def _forget(self) -> None:
        self.memo, self.long = Memo(), {}
        self.flat, self.begin, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.n_flat = self.n_units = 0

    def _modelled(self, joined: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces of the lines, which stand between spaces, and how many each has."""
        ids = np.array(list(itertools.chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(joined, add_special_tokens=False))), np.uint32)
        ends, total = np.flatnonzero(self.closes[ids]), sum(line.count(" ") + 1 for line in joined)
        if len(ends) == total:
            return ids, np.diff(ends, prepend=-1)
        rows = [[t.id for t in self.bare.model.tokenize(p)] for line in joined for p in line.split(" ")]  # a vocabulary without word ends
        return np.array(list(itertools.chain.from_iterable(rows)), np.uint32), np.array([len(r) for r in rows], np.int64)

    def _split(self, words: list[str]) -> tuple[list[str], list[int]]:
        """Pieces of words that are not plain, and how many each has."""
        if not words:
            return [], []
        line = " ".join(words)
        if line.split() == words:
            parts = self.normalize(line).split(" ")
        else:  # white space beyond ASCII stands inside a word
            parts = [self.normalize(w) for w in words]
        if len(parts) != len(words):
            raise ValueError("the normaliser joined or split words")
        # Latin letters alone are one piece: its UTF-8 bytes, written in the alphabet of the byte level
        latin = [self.plain and bool(_LATIN.fullmatch(p)) for p in parts]
        spelt = iter(" ".join(itertools.compress(parts, latin)).encode().decode("latin-1").translate(self.alphabet).split(" "))
        out = [[next(spelt)] if own else [piece for piece, _ in self.split(part)] for own, part in zip(latin, parts, strict=True)]
        return list(itertools.chain.from_iterable(out)), [len(o) for o in out]

    def _whole_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are not plain, and how many each has."""
        texts = [w.decode("utf-8") for w in words]
        line = " ".join(texts)
        special = [any(a in t for a in self.added) for t in texts] if any(a in line for a in self.added) else [False] * len(texts)
        found, counts = self._split([t for t, s in zip(texts, special, strict=True) if not s])
        ids, lengths = self._modelled([" ".join(found[k : k + BATCH]) for k in range(0, len(found), BATCH)]) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        borders = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *counts], dtype=np.int64)]
        if not any(special):
            return ids, np.diff(borders)
        rest = (ids[a:b] for a, b in itertools.pairwise(borders.tolist()))
        rows = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if s else next(rest) for t, s in zip(texts, special, strict=True)]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Keeps the ids of new units; the units' numbers."""
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n_units + len(lengths) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        own = slice(self.n_units, self.n_units + len(lengths))
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.begin[own], self.count[own] = self.n_flat + np.cumsum(lengths) - lengths, lengths
        self.n_flat += len(ids)
        self.n_units = own.stop
        return np.arange(own.start, own.stop)

    def _short(self, units: Units, at: np.ndarray) -> np.ndarray:
        """Numbers of units of up to LONGEST bytes."""
        padded = np.frombuffer(units.body + bytes(16), np.uint8)
        words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,))  # the 8 bytes from each place on
        begin, size = units.begin[at], units.size[at]
        low = words[begin] & _MASKS[np.minimum(size, 8)]
        high = words[begin + 8] & _MASKS[np.maximum(size - 8, 0)] | size.astype(np.uint64) << np.uint64(56)
        out = self.memo.find(low, high)
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out
        low, high = low[missing], high[missing]
        order = np.lexsort((low, high))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        new = order[fresh]
        numbers = np.empty(len(new), np.int64)
        whole = units.whole[at[missing[new]]]
        # the bytes of new units: 15 columns and a space
        spelt = np.stack([low[new], high[new] & _MASKS[7]], axis=1).astype("<u8").view(np.uint8).reshape(-1, 16)
        spelt[:, 15] = 0x20
        plain = np.flatnonzero(~whole)
        if len(plain):
            lines = [spelt[plain[k : k + BATCH]].tobytes().translate(None, b"\0")[:-1].decode("ascii") for k in range(0, len(plain), BATCH)]
            numbers[plain] = self._store(*self._modelled(lines))
        if len(odd := np.flatnonzero(whole)):
            starts, sizes = begin[missing[new[odd]]].tolist(), size[missing[new[odd]]].tolist()
            numbers[odd] = self._store(*self._whole_words([units.body[a : a + n] for a, n in zip(starts, sizes, strict=True)]))
        self.memo.add(low[new], high[new], numbers)
        out[missing[order]] = numbers[np.cumsum(fresh) - 1]
        return out

    def _longer(self, units: Units, at: np.ndarray) -> np.ndarray:
        """Numbers of longer units."""
        own = [units.body[a : a + n] for a, n in zip(units.begin[at].tolist(), units.size[at].tolist(), strict=True)]
        if new := [u for u in dict.fromkeys(own) if u not in self.long]:
            plain = [self.plain and (u.isalnum() or bool(_OTHERS.fullmatch(u))) for u in new]
            for some, ids_of in ((list(itertools.compress(new, plain)), self._plain_words), ([u for u, p in zip(new, plain, strict=True) if not p], self._whole_words)):
                if some:
                    self.long.update(zip(some, self._store(*ids_of(some)).tolist(), strict=True))
        return np.fromiter(map(self.long.__getitem__, own), np.int64, len(own))

    def _plain_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._modelled([b" ".join(words[k : k + BATCH]).decode("ascii") for k in range(0, len(words), BATCH)])

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with the end id after each text, and how many each text has."""
        units = units_of(text_of(column), self.plain)
        if self.n_units > MEMO_UNITS:
            self._forget()
        if not self.n_units:
            self._store(np.array([end], np.uint32), np.ones(1, np.int64))
            self.end = end
        elif self.end != end:
            raise ValueError("one encoder closes texts with one id")
        number = np.empty(len(units.size), np.int32)
        for long, of in ((False, self._short), (True, self._longer)):
            if len(at := np.flatnonzero((units.size > LONGEST) == long)):
                number[at] = of(units, at)
        closing = units.first[1:]
        number = np.insert(number, closing, 0)
        count = self.count[number]
        total = np.cumsum(count)
        ids = self.flat[np.repeat(self.begin[number] - (total - count).astype(np.int32), count) + np.arange(total[-1] if len(total) else 0, dtype=np.int32)]
        return ids, np.diff(total[closing + np.arange(len(closing))], prepend=0)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _index_crc32(keys: list, lengths: list[int]) -> int:
    return zlib.crc32(repr((keys, lengths)).encode())


def write_blocks(docs: DataFrame, path: str, end: int = 2, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the blocks and returns the dataset: shard, block, n_ids, keys and lengths of its documents with a checksum of
    both, and payload, which holds its own."""
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = F.col("key").asc_nulls_first(), F.col("tie")  # a key with many texts is cut between them
    ordered = source.repartitionByRange(max(1, -(-total // shard_bytes)), *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, number = encoder(path), None, 0
        ids: list[np.ndarray] = []
        keys: list = []
        lengths: list[int] = []
        size = 0

        def block() -> pa.RecordBatch:
            payload = range_coder.encode(np.concatenate(ids), max(own.vocabulary, end + 1))
            row = {"shard": [shard], "block": [number], "n_ids": [size], "keys": [keys], "lengths": [lengths], "index_crc32": [_index_crc32(keys, lengths)], "payload": [payload]}
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for part in slices(batches, "text"):
            shard = part["shard"][0].as_py()
            encoded, counts = own.encode(part["text"], end)
            at = 0
            part_keys = part["key"].to_pylist()
            for k, n in enumerate(counts.tolist()):
                if size and size + n > block_ids:
                    yield block()
                    number, size, ids, keys, lengths = number + 1, 0, [], [], []
                ids.append(encoded[at : at + n])
                keys.append(part_keys[k])
                lengths.append(n)
                size, at = size + n, at + n
        if size:
            yield block()

    made = ordered.select(F.spark_partition_id().alias("shard"), "key", "text").mapInArrow(run, "shard int, block long, n_ids long, keys array<long>, lengths array<long>, index_crc32 long, payload binary")
    return stored(made, "token-blocks")


def read_blocks(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decodes the blocks: key, start (ids of all documents before), n_tokens, ids_crc32 and, if wanted, the ids."""
    fields = "shard int, block long, key long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids = range_coder.decode(batch["payload"][k].as_py())
                own_keys, own_lengths = batch["keys"][k].as_py(), batch["lengths"][k].as_py()
                lengths = np.array(own_lengths, np.int64)
                if _index_crc32(own_keys, own_lengths) != batch["index_crc32"][k].as_py() or lengths.sum() != len(ids):
                    raise ValueError("damaged keys or lengths of a block")
                begin = np.cumsum(lengths) - lengths
                pieces = np.split(ids, begin[1:])
                n = len(lengths)
                columns = [pa.array([batch["shard"][k].as_py()] * n, pa.int32()), pa.array([batch["block"][k].as_py()] * n, pa.int64()), batch["keys"][k].values, pa.array(begin), pa.array(lengths), pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64())]
                names = ["shard", "block", "key", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int64) for p in pieces], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    decoded = blocks.select("shard", "block", "keys", "lengths", "index_crc32", "payload").mapInArrow(run, fields)
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("_n"))  # one row a shard
    shards = shards.select("shard", (F.sum("_n").over(W.orderBy("shard")) - F.col("_n")).alias("_shard_start"))
    in_shard = F.sum("n_ids").over(W.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    starts = sizes.select("shard", "block", in_shard.alias("_block_start")).join(shards, "shard")
    out = decoded.join(starts, ["shard", "block"]).withColumn("start", F.col("_shard_start") + F.col("_block_start") + F.col("inside"))
    return out.select("key", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
