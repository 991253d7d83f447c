"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles.  Equal texts form a class with one representative.  Representatives that share a
band of MinHash values are candidates; their MinHash values are compared a few at a time, a pair is dropped as soon as the
posterior probability that its similarity reaches the threshold falls below a tolerance, and the rest is verified on the
whole shingle sets (64-bit hashes).  A link is lost only by chance: a pair exactly at the threshold shares no band with a
probability of 2.9e-7, and the posterior drops it at one of its looks with 1.1e-5 (``Params.missed``).

A band bucket is never gathered in one place: it is dealt into chunks of bounded rows and bytes and every pair of chunks is a unit
of work, so a bucket that holds a large part of all rows spreads over the cluster.  A unit returns, for each of its
documents, how many links it found and the smallest document it is connected to there, not the pairs; so rows stay linear
in what came in.  A pair that shares several bands is counted in the first of them, and of buckets with the same members
only the first is worked.

Words: maximal runs outside ASCII white space, lower-cased, without non-alphanumeric characters at their ends, where
something remains.  A text of one to four words has one shingle, all of them.

Defined results: null texts and texts without words have no shingles, link to nothing and are classes of their own;
texts, not keys, are compared, so repeated rows, null keys and keys with several texts each get a row; the least key ignores
nulls; an empty table gives no rows; columns other than key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.components import components, hub_join
from tarn.llm.storage import stored
from tarn.llm.textarrays import Text, slices, text_of, word_keys, words_of

MIX, ODD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    words: int = 5
    threshold: float = 0.8
    bands: int = 21  # of this many rows: a pair at the threshold shares no band with a probability of (1 - t^rows)^bands = 2.9e-7
    rows: int = 3
    tolerance: float = 1e-6
    step: int = 8  # MinHash values compared between two looks at the posterior
    chunk: int = 512  # documents in a chunk of a bucket, in the mean
    chunk_bytes: int = 16 << 20  # of shingle hashes in a chunk, in the mean
    seed: int = 11

    @property
    def hashes(self) -> int:
        """MinHash values: those of the bands, and as many more as fill the last step."""
        return -(-self.bands * self.rows // self.step) * self.step

    def missed(self) -> tuple[float, float]:
        """Chances that a pair exactly at the threshold shares no band, and that the posterior drops it."""
        t, alive, before = self.threshold, np.ones(1), 0
        for upto, needed in self.needed():
            n = upto - before
            alive = np.convolve(alive, [comb(n, m) * t**m * (1 - t) ** (n - m) for m in range(n + 1)])
            alive[:needed] = 0
            before = upto
        return (1 - t**self.rows) ** self.bands, 1 - float(alive.sum())

    def needed(self) -> list[tuple[int, int]]:
        """(n, m): after n values a pair goes on only with m agreeing ones.

        With a uniform prior the posterior after m of n agreements is Beta(m + 1, n - m + 1), and the probability that it
        exceeds t is that of at most m successes in n + 1 trials of chance t.
        """
        out, t = [], self.threshold
        for n in range(self.step, self.hashes + 1, self.step):
            reach, m = 0.0, -1
            while reach < self.tolerance and m < n:
                m += 1
                reach += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: Text, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all rows, and per row where they begin (one more than rows)."""
    words = words_of(text)
    keys = word_keys(words.vocab)
    hashed = np.fromiter((xxhash.xxh64_intdigest(k.encode()) if k else 0 for k in keys), np.uint64, len(keys))
    full = np.fromiter(map(bool, keys), bool, len(keys))[words.codes] if len(keys) else np.zeros(0, bool)
    at = np.concatenate([[0], np.cumsum(full)])[words.first]
    value = hashed[words.codes[full]] if len(keys) else np.zeros(0, np.uint64)
    counts = np.diff(at)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    begin = np.repeat(at[:-1] - first[:-1], n) + np.arange(first[-1])
    padded = np.concatenate([value, np.zeros(size, np.uint64)])
    out = np.zeros(len(begin), np.uint64)
    short = np.repeat(counts, n)
    for j in range(size):
        word = padded[begin + j]
        if (short < size).any():
            word = np.where(j < short, word, np.uint64(j))
        out = (out + word) * ODD
    return _mixed(out), first


def minhashes(hashes: np.ndarray, first: np.ndarray, params: Params) -> np.ndarray:
    """rows x hashes, uint32; rows without shingles keep the largest value everywhere."""
    rng = np.random.default_rng(params.seed)
    a = rng.integers(1, 1 << 63, params.hashes, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, params.hashes, dtype=np.uint64)
    rows = np.flatnonzero(np.diff(first))
    out = np.full((len(first) - 1, params.hashes), 0xFFFFFFFF, np.uint32)
    if len(rows):
        for k in range(params.hashes):
            out[rows, k] = np.minimum.reduceat((hashes * a[k] + b[k]) >> np.uint64(32), first[rows])
    return out


def band_keys(signature: np.ndarray, params: Params) -> np.ndarray:
    """rows x bands; a key holds its band in the low bits, so keys of different bands differ."""
    out = np.empty((len(signature), params.bands), np.int64)
    width = np.uint64((1 << (params.bands - 1).bit_length()) - 1)
    for band in range(params.bands):
        key = np.zeros(len(signature), np.uint64)
        for r in range(params.rows):
            key = (key + signature[:, band * params.rows + r].astype(np.uint64) + np.uint64(1)) * ODD
            key ^= key >> np.uint64(31)
        out[:, band] = ((_mixed(key) & ~width) | np.uint64(band)).view(np.int64)
    return out


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), _digest(text).alias("digest"))


def sketched(source: DataFrame, params: Params) -> DataFrame:
    """One row per document: ``_id``, the digest of its text (null where it has no words), its band keys and how many shingles
    it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1 << 20):
            hashes, first = shingles(text_of(part["_text"]), params.words)
            keys = band_keys(minhashes(hashes, first, params), params)
            digest = pa.array([d if n else None for d, n in zip(part["digest"].to_pylist(), np.diff(first), strict=True)], pa.binary())
            offsets = pa.array(np.arange(0, keys.size + 1, params.bands), pa.int32())
            yield pa.RecordBatch.from_arrays([part["_id"], digest, pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))), pa.array(np.diff(first), pa.int64())], ["_id", "digest", "keys", "size"])

    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, digest binary, keys array<long>, size long")


def _loaded(texts: DataFrame, params: Params) -> DataFrame:
    """digest, and of _text the sorted distinct shingles and the MinHash values, both as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1 << 20):
            hashes, first = shingles(text_of(part["_text"]), params.words)
            signature = minhashes(hashes, first, params)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part["digest"], pa.array(sets, pa.binary()), pa.array([s.tobytes() for s in signature], pa.binary())], ["digest", "shingles", "signature"])

    return texts.select("digest", "_text").mapInArrow(run, "digest binary, shingles binary, signature binary")


def _linked(ids: tuple[bytes, ...], side: np.ndarray, sets: tuple[bytes, ...], signatures: tuple[bytes, ...], band: int, same: bool, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Links among the documents of one unit of work: per document how many, and the position of the least one connected."""
    n = len(ids)
    signature = np.frombuffer(b"".join(signatures), np.uint32).reshape(n, params.hashes)
    order = np.arange(n)
    open_pair = (order[:, None] < order[None, :]) if same else (side[:, None] < side[None, :])
    for earlier in range(band):
        own = signature[:, earlier * params.rows : (earlier + 1) * params.rows]
        packed = np.ascontiguousarray(own).view(f"V{4 * params.rows}").reshape(-1)
        code = np.unique(packed, return_inverse=True)[1]
        open_pair &= code[:, None] != code[None, :]
    i, j = np.nonzero(open_pair)
    agree, before = np.zeros(len(i), np.int64), 0
    for upto, needed in params.needed():
        agree += (signature[i, before:upto] == signature[j, before:upto]).sum(axis=1)
        alive = agree >= needed
        i, j, agree, before = i[alive], j[alive], agree[alive], upto
    degree, root = np.zeros(n, np.int64), order.copy()
    if not len(i):
        return degree, root
    used, inverse = np.unique(np.concatenate([i, j]), return_inverse=True)
    i2, j2 = inverse[: len(i)], inverse[len(i) :]
    arrays = [np.frombuffer(sets[k], np.uint64) for k in used]
    sizes = np.array([len(x) for x in arrays], np.int64)
    _, code, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(used)), sizes)
    shared = counts[code] > 1
    code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((len(used), len(used)), np.float32)
    by = np.argsort(code, kind="stable")
    code, owner = code[by], owner[by]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [low, low + 4096])
        member = np.zeros((len(used), 4096), np.float32)
        member[owner[a:b], code[a:b] - low] = 1
        common += member @ member.T
    both = common[i2, j2].astype(np.int64)
    linked = both >= params.threshold * (sizes[i2] + sizes[j2] - both) - 1e-9
    i, j = i[linked], j[linked]
    degree += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    rank = np.empty(n, np.int64)  # so that the least label is the least digest
    rank[sorted(range(n), key=ids.__getitem__)] = order
    label, position = rank.copy(), np.argsort(rank)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[position[new]])
        if (new == label).all():
            break
        label = new
    return degree, position[label]


def _worked(units: DataFrame, params: Params) -> DataFrame:
    """Works every unit; rows come sorted by unit and digest.  Only documents with links are returned."""
    names = ["bucket", "low", "high", "digest", "side", "shingles", "signature"]
    bits = (1 << (params.bands - 1).bit_length()) - 1
    kinds = {"digest": pa.binary(), "root": pa.binary(), "degree": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: dict[str, list] = {k: [] for k in kinds}

        def work() -> None:
            if len(held) < 2:
                return
            digests, side, sets, signatures = zip(*held, strict=True)
            degree, root = _linked(digests, np.array(side), sets, signatures, key[0] & bits, key[1] == key[2], params)
            for k in np.flatnonzero(degree):
                out["digest"].append(digests[k])
                out["root"].append(digests[root[k]])
                out["degree"].append(int(degree[k]))

        def result() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in kinds.items()], list(kinds))
            for values in out.values():
                values.clear()
            return made

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if row[:3] != key:
                    work()
                    key, held = row[:3], []
                if not held or held[-1][0] != row[3]:  # one row with its text came twice
                    held.append(row[3:])
            if len(out["digest"]) > 5000:
                yield result()
        work()
        if out["digest"]:
            yield result()

    return units.select(names).mapInArrow(run, "digest binary, root binary, degree long")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", params: Params | None = None) -> DataFrame:
    """One row per document: key, ``text_id`` (least key among equal texts), ``class_id`` (least key among all texts that
    links connect it to) and ``n_links`` (different texts whose similarity to it reaches the threshold)."""
    rows = _joined(docs, key, text, params or Params())
    own = F.coalesce("text_id", "_id")
    return rows.select(F.col("_id").alias(key), own.alias("text_id"), F.coalesce("class_id", own).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _joined(docs: DataFrame, key: str, text: str, params: Params) -> DataFrame:
    """One row per document: ``_id`` (its key), ``digest`` of its text (null where it has no words), ``text_id``, and where the
    text has links ``n_links``, ``class_id`` and ``first`` (the digest of the class's first text: that of the least key)."""
    source = _source(docs, key, text)
    sketch = stored(sketched(source, params), "sketch")
    texts = sketch.filter("digest is not null").groupBy("digest").agg(F.min("_id").alias("_id"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.count("*").alias("copies"))
    texts = stored(texts, "texts")
    n_texts = texts.count()
    banded = texts.select("digest", "_id", "size", F.explode("keys").alias("bucket"))
    band = F.col("bucket").bitwiseAND(F.lit((1 << (params.bands - 1).bit_length()) - 1))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y")).filter("n > 1")
    buckets = buckets.groupBy("n", "size", "x", "y").agg(F.min_by("bucket", F.struct(band, "bucket")).alias("bucket"))
    chunks = F.greatest(F.ceil(F.col("n") / params.chunk), F.ceil(F.col("size") * 8 / params.chunk_bytes)).cast("int")
    members = stored(hub_join(banded.select("digest", "_id", "bucket"), buckets.select("bucket", "n", chunks.alias("chunks")), "bucket", n_texts * params.bands), "members")
    wanted = members.select("digest", F.col("_id").alias("_wanted")).distinct()
    hashed = wanted.hint("shuffle_hash")  # the ids of members are hashed, so the texts need not be sorted
    found = source.join(hashed, (source["digest"] == hashed["digest"]) & source["_id"].eqNullSafe(hashed["_wanted"]), "left_semi")
    again = sketch.filter("digest is not null").groupBy("digest", "_id").agg(F.count("*").alias("n")).filter("n > 1")
    again = stored(again.join(wanted, (again["digest"] == wanted["digest"]) & again["_id"].eqNullSafe(wanted["_wanted"]), "left_semi").select("digest"), "repeats")
    if not again.isEmpty():  # rows equal in key and text: one of them is enough
        once = found.join(again.hint("shuffle_hash"), "digest", "left_semi").dropDuplicates(["digest"])
        found = found.join(again.hint("shuffle_hash"), "digest", "left_anti").unionByName(once)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    units = members.select("digest", "bucket", "chunks", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int").alias("side"))
    units = units.select("digest", "bucket", "side", other).select("digest", "bucket", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    dealt = units.join(_loaded(found, params), "digest").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "digest")
    links = stored(_worked(dealt, params), "links")
    degree = links.groupBy("digest").agg(F.sum("degree").alias("n_links"))
    linked = components(links.select(F.col("digest").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "digest")
    named = stored(linked.join(texts.select("digest", "_id"), "digest"), "named")
    least = named.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "digest")).alias("m"), F.count("*").alias("n"))
    least = least.select("component", "n", F.col("m._id").alias("class_id"), F.col("m.digest").alias("first"))
    classed = hub_join(named.select("digest", "component"), least, "component", named.count()).select("digest", "class_id", "first").join(degree, "digest")
    classes = stored(texts.select("digest", F.col("_id").alias("text_id"), F.col("copies").alias("n")).join(classed, "digest", "left"), "classes")
    with_words = hub_join(sketch.filter("digest is not null").select("_id", "digest"), classes, "digest", sketch.count())
    columns = ["_id", "digest", "text_id", "class_id", "first", "n_links"]
    none = sketch.filter("digest is null").select("_id", "digest", *(F.lit(None).cast(classes.schema[c].dataType).alias(c) for c in columns[2:]))
    return with_words.select(*columns).unionByName(none)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", params: Params | None = None) -> DataFrame:
    """One row of ``docs`` for each class, that of the least key, with all columns.

    A class's first row has its least key (a null key comes last) and, of several texts with that key, the least digest.
    Rows are told apart by key and text, so of a key with several texts only those that are copies go; of rows equal in both
    any one stays.  Rows whose text has no words all stay.  What goes may be much, so both sides are dealt by key and text;
    it is hashed, and the texts need not be sorted.
    """
    rows = _joined(docs, key, text, params or Params())
    stays = F.col("digest").eqNullSafe(F.coalesce("first", "digest")) & F.col("_id").eqNullSafe(F.when(F.col("first").isNull(), F.col("text_id")).otherwise(F.col("class_id")))
    judged = stored(rows.filter("digest is not null").groupBy("_id", "digest", stays.alias("stays")).agg(F.count("*").alias("n")), "verdicts")
    own = docs.withColumns({"_tarn_key": F.col(key), "_tarn_digest": _digest(text)})

    def some(of: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
        hashed = verdicts.select("_id", F.col("digest").alias("_gone")).hint("shuffle_hash")
        return of.join(hashed, of["_tarn_key"].eqNullSafe(hashed["_id"]) & (of["_tarn_digest"] == hashed["_gone"]), how)

    left, repeated = some(own, judged.filter("not stays"), "left_anti"), judged.filter("stays and n > 1")
    if not repeated.isEmpty():
        left = some(left, repeated, "left_anti").unionByName(some(left, repeated, "left_semi").dropDuplicates(["_tarn_key", "_tarn_digest"]))
    return left.drop("_tarn_key", "_tarn_digest")
