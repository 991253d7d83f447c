"""Benchmark decontamination: a BM25 index of test items, searched with every passage of the training documents.

The index is inverted: per term, the items that have it with their BM25 impact, in blocks whose largest impact is known.
Impacts are divided by the score an item gives itself, so 1 means that a passage has every term of the item and one
threshold serves short and long items.  A document is read in overlapping passages twice as long as the longest item, one
item length apart, so each copy of an item lies whole in some passage.  Block-max WAND then visits, for each passage, only
items whose upper bound reaches the threshold and returns all that do.  A hit is verified on word order: the share of the
item's word n-grams found in the passage must reach a limit for its question and for its answer separately.

Passages that no item can reach the threshold in are told apart for a whole batch at once: what the rare terms they share
with an item add, and all that its common terms could, bounds the score from above.

The items are broadcast.  They are a test set of known size: ``block_items`` at most go to one scan, a larger set is
searched in blocks of items, one scan for each.  Term frequencies, lengths and the passage width are those of all items
in every block, so what is found does not depend on how the items are cut.

Words: runs outside ASCII white space, lower-cased, without non-alphanumeric characters at their ends.

Defined results: null texts and texts without words match nothing; items without words are never found; repeated documents
and repeated items each give their own rows; an empty table on either side gives no rows; an item of one part (fewer than
two words) counts as question and answer alike; keys are of any type, and an item key named like the document key comes out
as ``item_<name>``.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tarn.llm.storage import stored
from tarn.llm.textarrays import slices, text_of, word_keys, words_of

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ANSWER = re.compile(r"(?i)\banswer\s*:")


@dataclass(frozen=True)
class Params:
    threshold: float = 0.6
    overlap: float = 0.5
    gram: int = 3
    k1: float = 1.2
    b: float = 0.75
    postings: int = 32  # in a block
    rare: float = 0.05  # share of the items up to which a term is rare
    block_items: int = 20_000


def words(text: str | None) -> list[str]:
    return [k for k in word_keys(pa.array([w.encode() for w in _WORD.findall(text or "")], pa.binary())) if k]


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: at an answer mark where there is one, else the last third of the words is the answer."""
    if m := _ANSWER.search(text):
        return words(text[: m.start()]), words(text[m.end() :])
    own = words(text)
    cut = len(own) - len(own) // 3
    return own[:cut], own[cut:]


def grams(own: list[str], size: int) -> set[tuple[str, ...]]:
    size = min(size, len(own))
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()


@dataclass(frozen=True)
class Statistics:
    """Of all items: how many, their words in all and at most, and in how many items a term is."""

    items: int
    words: int
    longest: int
    frequency: dict[str, int]


class Index:
    """terms: number of each term.  items, impacts, block_max: per term.  bound: per term, its largest impact.

    Items that are a part of a larger set come with the statistics of the whole set.
    """

    def __init__(self, items: list[tuple[object, str]], params: Params, whole: Statistics | None = None) -> None:
        self.params = params
        self.keys = [k for k, t in items]
        split = [parts(t or "") for _, t in items]
        self.grams = [(grams(q, params.gram) or grams(a, params.gram), grams(a, params.gram) or grams(q, params.gram)) for q, a in split]
        counts = [Counter(q + a) for q, a in split]
        lengths = [sum(c.values()) for c in counts]
        frequency = Counter(t for c in counts for t in c)
        whole = whole or Statistics(len(items), sum(lengths), max(lengths, default=0), frequency)
        self.longest = whole.longest
        average = max(1.0, whole.words / max(1, whole.items))
        idf = {t: log(1 + (whole.items - whole.frequency[t] + 0.5) / (whole.frequency[t] + 0.5)) for t in frequency}
        self.terms = {t: i for i, t in enumerate(frequency)}
        self.items: list[list[int]] = [[] for _ in frequency]
        self.impacts: list[list[float]] = [[] for _ in frequency]
        for i, (c, length) in enumerate(zip(counts, lengths, strict=True)):
            norm = params.k1 * (1 - params.b + params.b * length / average)
            raw = {t: idf[t] * n * (params.k1 + 1) / (n + norm) for t, n in c.items()}
            own = sum(raw.values())
            for t, v in raw.items():
                self.items[self.terms[t]].append(i)
                self.impacts[self.terms[t]].append(v / own)
        self.bound = np.array([max(v) for v in self.impacts]) if self.impacts else np.zeros(0)
        rare = np.array([len(v) <= max(2, params.rare * len(items)) for v in self.items], bool)
        self.most_common = np.zeros(len(items))  # per item, all that its common terms can add
        for t in np.flatnonzero(~rare):
            self.most_common[self.items[t]] += self.impacts[t]
        self.begin = np.concatenate([[0], np.cumsum([len(v) * r for v, r in zip(self.items, rare, strict=True)])]).astype(np.int64)
        self.rare_items = np.array([i for v, r in zip(self.items, rare, strict=True) if r for i in v], np.int64)
        self.rare_impacts = np.array([x for v, r in zip(self.impacts, rare, strict=True) if r for x in v])
        size = params.postings
        self.block_max = [[max(v[i : i + size]) for i in range(0, len(v), size)] for v in self.impacts]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score for the terms reaches the threshold, by block-max WAND."""
        size, need = self.params.postings, self.params.threshold - 1e-9
        lists = [self.items[t] for t in terms]
        at = [0] * len(terms)
        heap = [(own[0], k) for k, own in enumerate(lists)]
        heapq.heapify(heap)
        bounds = [float(self.bound[t]) for t in terms]
        rest = sum(bounds)
        out = []
        while heap and rest >= need:
            # the pivot is the first item that lists up to there could lift to the threshold
            moved, total = [], 0.0
            while heap and total < need:
                pivot, k = heapq.heappop(heap)
                moved.append(k)
                total += bounds[k]
            if total < need:
                break
            while heap and heap[0][0] == pivot:
                moved.append(heapq.heappop(heap)[1])
            shallow = 0.0
            for k in moved:
                own = lists[k]
                if own[at[k]] < pivot:
                    at[k] = _seek(own, at[k], pivot)
                if at[k] < len(own):
                    shallow += self.block_max[terms[k]][at[k] // size]
            if shallow >= need:
                found = []
                for k in moved:
                    if at[k] < len(lists[k]) and lists[k][at[k]] == pivot:
                        found.append(self.impacts[terms[k]][at[k]])
                        at[k] += 1
                score = fsum(found)  # the same in whatever order the terms are numbered
                if score >= need:
                    out.append((pivot, score))
            else:
                for k in moved:
                    if at[k] < len(lists[k]) and lists[k][at[k]] == pivot:
                        at[k] += 1
            for k in moved:
                if at[k] < len(lists[k]):
                    heapq.heappush(heap, (lists[k][at[k]], k))
                else:
                    rest -= bounds[k]
        return out

    def verified(self, item: int, own: list[str]) -> tuple[float, float]:
        """The shares of the question's and of the answer's n-grams that the passage has."""
        have: dict[int, set] = {}
        shares = []
        for wanted in self.grams[item]:
            size = len(next(iter(wanted)))
            if size not in have:
                have[size] = grams(own, size)
            shares.append(len(wanted & have[size]) / len(wanted))
        return shares[0], shares[1]


def _seek(own: list[int], at: int, wanted: int) -> int:
    from bisect import bisect_left

    return bisect_left(own, wanted, at)


def _passages(block: np.ndarray, term: np.ndarray, base: np.ndarray, index: Index) -> np.ndarray:
    """First blocks of the passages that some item may reach the threshold in.

    A passage is two neighbouring blocks of a row, or a row's only block.  For every block and item the impacts of shared
    rare terms are summed; with all that the item's common terms can add, that bounds the score from above.
    """
    items = len(index.keys)
    n = index.begin[term + 1] - index.begin[term]
    at = np.repeat(index.begin[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    cell, inverse = np.unique(np.repeat(block, n) * items + index.rare_items[at], return_inverse=True)
    own = np.bincount(inverse, index.rare_impacts[at], len(cell))
    following = np.searchsorted(cell, cell + items)
    hit = (following < len(cell)) & (cell[np.minimum(following, len(cell) - 1)] == cell + items) if len(cell) else np.zeros(0, bool)
    both = own + np.where(hit, own[np.minimum(following, max(0, len(cell) - 1))], 0)
    first, item = cell // items, cell % items
    # blocks of other rows may follow; that only loosens the bound
    reach = both + index.most_common[item] >= index.params.threshold - 1e-9
    starts = np.concatenate([first[reach], first[reach] - 1])
    loose = index.most_common >= index.params.threshold - 1e-9
    if loose.any():
        starts = np.arange(base[-1])
    starts = np.unique(starts[starts >= 0])
    rows = np.searchsorted(base, starts, "right") - 1
    last = starts == base[rows + 1] - 1
    return starts[~last | (base[rows + 1] - base[rows] == 1)]


def _hits(column: pa.Array, index: Index) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(row, item, first word of the passage, score, question and answer overlap), the best passage of each row and item."""
    plain = words_of(text_of(column))
    if not len(plain.codes) or not index.terms:
        return
    keys = word_keys(plain.vocab)
    term = np.fromiter((index.terms.get(k, -1) if k else -2 for k in keys), np.int64, len(keys))
    full = term[plain.codes] != -2
    codes, row = plain.codes[full], plain.rows()[full]
    term = term[codes]
    first = np.searchsorted(row, np.arange(len(plain.first)))
    step = index.longest
    inside = np.arange(len(codes)) - first[row]
    n_blocks = -(-np.diff(first) // step)
    base = np.concatenate([[0], np.cumsum(n_blocks)])
    block = base[row] + inside // step
    known = term >= 0
    size = len(index.bound)
    pairs = np.unique(block[known] * size + term[known])
    wanted = _passages(pairs // size, pairs % size, base, index)
    owner = np.searchsorted(base, wanted, "right") - 1
    best: dict[tuple[int, int], tuple] = {}
    for k, r in zip(wanted.tolist(), owner.tolist(), strict=True):
        low = int(first[r]) + (k - int(base[r])) * step
        high = min(int(first[r + 1]), low + 2 * step)
        terms = np.unique(term[low:high])
        found = index.search(terms[terms >= 0].tolist())
        if not found:
            continue
        own = [keys[c] for c in codes[low:high].tolist()]
        for item, score in found:
            question, answer = index.verified(item, own)
            if min(question, answer) >= index.params.overlap:
                hit = (r, item, low - int(first[r]), score, question, answer)
                if (r, item) not in best or (hit[3:], -hit[2]) > (best[r, item][3:], -best[r, item][2]):
                    best[r, item] = hit
    yield from best.values()


def _indexes(items: DataFrame, key: str, text: str, params: Params) -> Iterator[Index]:
    """One index for each block of items; only one block's texts are on the driver at a time."""
    usable = items.select(key, text).filter(F.col(text).isNotNull())
    n = usable.count()
    blocks = -(-n // params.block_items)
    in_order = lambda rows: sorted(((r[0], r[1]) for r in rows.collect()), key=repr)
    if blocks == 1:
        yield Index(in_order(usable), params)
    if blocks < 2:
        return
    block = F.pmod(F.xxhash64(key, text), F.lit(blocks))
    counted = stored(_counted(usable.select(block.alias("block"), F.col(text).alias("_text"))), "item-terms")
    total, longest = counted.filter("term is null").agg(F.sum("n"), F.max("n")).first()
    terms = counted.filter("term is not null")
    frequency = stored(terms.groupBy("term").agg(F.count("*").alias("n")), "item-frequency")
    for k in range(blocks):
        own = frequency.join(terms.filter(F.col("block") == k).select("term").distinct(), "term")
        yield Index(in_order(usable.filter(block == k)), params, Statistics(n, total, longest, {r.term: r.n for r in own.collect()}))


def _counted(items: DataFrame) -> DataFrame:
    """(block, term, n): each item's distinct terms with how often it has them, and a row without a term for its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            rows = []
            for block, text in zip(part["block"].to_pylist(), part["_text"].to_pylist(), strict=True):
                question, answer = parts(text)
                own = Counter(question + answer)
                rows += [(block, None, own.total()), *((block, t, c) for t, c in own.items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], ["block", "term", "n"])

    return items.mapInArrow(run, "block long, term string, n long")


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", params: Params | None = None) -> DataFrame:
    """One row for each document and test item it contains: key, item key, passage_start (in words), score,
    question_overlap and answer_overlap."""
    params = params or Params()
    kind = items.schema[item_key].dataType
    item_type = T.StructField(item_key if item_key != key else f"item_{item_key}", kind)
    item_kind = to_arrow_type(kind)
    numbers = [T.StructField("passage_start", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("score", "question_overlap", "answer_overlap"))]
    schema = T.StructType([docs.schema[key], item_type, *numbers])
    source = docs.select(key, F.col(text).alias("_text"))
    context = docs.sparkSession.sparkContext
    out = None
    for index in _indexes(items, item_key, item_text, params):
        shared = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "_text"):
                rows = list(_hits(part["_text"], shared.value))
                if rows:
                    r, item, start, *shares = zip(*rows, strict=True)
                    keys = [shared.value.keys[i] for i in item]
                    yield pa.RecordBatch.from_arrays([part[0].take(pa.array(r)), pa.array(keys, item_kind), pa.array(start, pa.int64()), *(pa.array(s, pa.float64()) for s in shares)], schema.names)

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", params: Params | None = None) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, with all columns, whatever their names or keys.

    A row is judged where it is read: nothing is shuffled, and each block of items filters what the one before it left.
    """
    params, at = params or Params(), docs.columns.index(text)
    context, left = docs.sparkSession.sparkContext, docs
    for index in _indexes(items, item_key, item_text, params):
        shared = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, at):
                clean = np.ones(len(part), bool)
                clean[[hit[0] for hit in _hits(part[at], shared.value)]] = False
                yield part.filter(pa.array(clean))

        left = left.mapInArrow(run, docs.schema)
    return left
