"""A persistent full-text index of weighted fields that takes additions and deletions without being built anew.

An append writes one segment: postings (a row for each term and document, with places and weights) in folders by a hash of the
term and sorted by term inside, so that a search reads its own folders and of these the row groups that hold its terms.  A
deletion writes the ids that it takes out of the segments before it.  Which segments and deletions count is one committed state
(``versions``), so a search sees an addition whole or not at all, and a merge puts one segment in the place of all.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.stemmer import stem
from tarn.operators import search
from tarn.operators.storage import shared_dir
from tarn.sources import versions

#: Places nearer than this count for the rank; at that distance a pair adds less than 1e-15.
NEAR = 100
#: Words that a worker turns into postings at once.
WORDS = 200_000


def _slices(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about WORDS words, so that what a worker holds beside a batch does not depend on how
    many rows it has or how long they are; a row alone may have more."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.list_value_length(batch[f"f{k}"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(fields))
        piece = (np.cumsum(sizes) - sizes) // WORDS
        cuts = np.append(np.flatnonzero(np.diff(piece, prepend=-1)), batch.num_rows)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)


def _postings(docs: DataFrame, key: str, fields: dict[str, str], language: str) -> DataFrame:
    """id, term, ats and weights: the places of a term in a document in ascending order, through the fields one after another,
    stop words counted but left out, and the weight letter of each place."""
    parts = [search.tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"f{k}") for k, c in enumerate(fields.values())]
    letters = "".join(fields)
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("ats", T.ArrayType(T.IntegerType())), T.StructField("weights", T.StringType())])
    stops = pa.array(search.STOP_WORDS if language == "english" else [], pa.string())
    known: dict[str, str] = {}

    def stemmed(words: list[str]) -> list[str]:
        if language != "english":
            return words
        if len(known) > 1 << 18:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = stem(w)
        return [known[w] for w in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(letters)):
            rows, words, places, field, before = [], [], [], [], np.zeros(batch.num_rows, np.int64)
            for k in range(len(letters)):
                column = batch[f"f{k}"]
                sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.cumsum(sizes) - sizes
                row = np.repeat(np.arange(len(sizes)), sizes)
                rows.append(row)
                places.append(np.arange(int(sizes.sum())) - first[row] + before[row] + 1)
                field.append(np.full(len(row), k))
                words.append(column.flatten())
                before += sizes
            text = pa.chunked_array(words).combine_chunks()
            coded = text.dictionary_encode()
            keep = ~pc.is_in(coded.dictionary, value_set=stops).to_numpy(zero_copy_only=False)
            terms, term_of = np.unique(np.array(stemmed(coded.dictionary.to_pylist()), object), return_inverse=True) if len(coded.dictionary) else (np.array([], object), np.zeros(0, np.int64))
            code = coded.indices.to_numpy()
            row, at, field = (np.concatenate(x) for x in (rows, places, field))
            use = keep[code] if len(code) else np.zeros(0, bool)
            row, at, field, code = row[use], at[use], field[use], term_of[code[use]]
            order = np.lexsort((at, code, row))
            row, at, field, code = row[order], at[order], field[order], code[order]
            starts = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(code, prepend=-1))
            offsets = pa.array(np.append(starts, len(row)), pa.int32())
            marks = np.frombuffer(letters.encode(), np.uint8)[field].tobytes().decode()
            ends = np.append(starts, len(row))[1:].tolist()
            weights = [marks[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]
            columns = [batch["id"].take(pa.array(row[starts])), pa.array(terms[code[starts]].tolist(), pa.string()), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), pa.array(weights, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "term", "ats", "weights"])

    return docs.select(F.col(key).alias("id"), *parts).mapInArrow(run, schema)


class TextIndex:
    """An index in a folder; see ``create`` and ``open``."""

    def __init__(self, spark: SparkSession, folder: str, number: int, state: dict) -> None:
        self.spark, self.folder, self.number, self.state = spark, folder, number, state

    @classmethod
    def create(cls, spark: SparkSession, folder: str, fields: dict[str, str], language: str = "english", buckets: int = 16) -> TextIndex:
        """``fields``: weight letter to column, in the order in which places are counted.  ``language``: english, or simple (words as
        they are).  ``buckets``: folders of a segment."""
        state = {"fields": list(fields.items()), "language": language, "buckets": buckets, "segments": [], "deleted": []}
        return cls(spark, folder, versions.commit(spark, folder, 0, state), state)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TextIndex:
        number, state = versions.current(spark, folder)
        if not number:
            raise FileNotFoundError(f"no index in {folder}")
        return cls(spark, folder, number, state)

    def _commit(self, **change: list) -> TextIndex:
        state = {**self.state, **change}
        return TextIndex(self.spark, self.folder, versions.commit(self.spark, self.folder, self.number, state), state)

    def _write(self, postings: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        placed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.state["buckets"])).cast("int"))
        dealt = placed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4)))  # a very frequent term lies in four files
        dealt.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        return name

    def append(self, docs: DataFrame, key: str) -> TextIndex:
        """Adds a segment.  Rows with a null key are left out; repeated keys count as they come."""
        rows = _postings(docs.filter(F.col(key).isNotNull()), key, dict(self.state["fields"]), self.state["language"])
        return self._commit(segments=[*self.state["segments"], self._write(rows)])

    def delete(self, ids: DataFrame) -> TextIndex:
        """Takes the documents of these ids (one column) out of all segments there are; later ones may bring them again."""
        name = f"deleted-{uuid.uuid4().hex}"
        ids.select(F.col(ids.columns[0]).alias("id")).filter("id is not null").distinct().write.parquet(f"{self.folder}/{name}")
        return self._commit(deleted=[*self.state["deleted"], [name, len(self.state["segments"])]])

    def merge(self) -> TextIndex:
        """One segment without what was deleted."""
        live = self.postings()
        return self._commit(segments=[self._write(live)] if live is not None else [], deleted=[])

    def postings(self, terms: tuple[str, ...] | None = None) -> DataFrame | None:
        """id, term, ats and weights of what counts, of these terms or all; nothing of an index without segments."""
        out = None
        for k, name in enumerate(self.state["segments"]):
            rows = self.spark.read.parquet(f"{self.folder}/{name}")
            if terms is not None:
                own = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.state["buckets"]))).collect()})
                rows = rows.filter(F.col("bucket").isin(own) & F.col("term").isin(*terms))
            for gone, upto in self.state["deleted"]:
                if k < upto:
                    rows = rows.join(self.spark.read.parquet(f"{self.folder}/{gone}"), "id", "left_anti")
            rows = rows.select("id", "term", "ats", "weights")
            out = rows if out is None else out.unionByName(rows)
        return out

    def terms(self, query: str) -> tuple[str, ...]:
        """The distinct terms that a query asks for, in order; stop words are none."""
        words = self.spark.range(1).select(search.tokens(F.lit(query)).alias("w")).first().w
        if self.state["language"] == "english":
            words = [stem(w) for w in words if w not in search.STOP_WORDS]
        return tuple(dict.fromkeys(words))

    def hits(self, query: str) -> tuple[DataFrame | None, int]:
        terms = self.terms(query)
        return (self.postings(terms) if terms and self.state["segments"] else None), len(terms)

    def _none(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/{self.state['segments'][0]}").schema["id"].dataType.simpleString() if self.state["segments"] else "long"
        return self.spark.createDataFrame([], f"id {schema}, rank double")

    def ranked(self, query: str) -> DataFrame:
        """id and rank of the documents that have every term of the query.

        Of one term: the sum of its places' weights, the j-th divided by j squared, the heaviest place counted whole, over pi
        squared / 6.  Of several: 1 - the product over pairs of places of different terms of (1 - the root of both weights and a
        factor that falls with their distance).  Pairs are found in windows of places, not in whole documents.
        """
        found, n = self.hits(query)
        if found is None:
            return self._none()
        weight = F.create_map(*(F.lit(x) for kv in search.WEIGHTS.items() for x in kv))
        letters = F.transform(F.split("weights", ""), lambda w: F.element_at(weight, w))
        places = found.select("id", "term", F.inline(F.arrays_zip(F.col("ats").alias("at"), F.filter(letters, lambda w: w.isNotNull()).alias("w"))))
        if n == 1:
            lists = places.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "w"))), lambda s: s["w"]).alias("ws"))
            damped = F.aggregate(F.transform("ws", lambda w, j: w / ((j + 1) * (j + 1))), F.lit(0.0), lambda s, x: s + x)
            top, first = F.array_max("ws"), F.array_position("ws", F.array_max("ws"))
            return lists.select("id", ((top + damped - top / (first * first)) / 1.64493406685).alias("rank"))
        every = found.groupBy("id").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == n).select("id")
        of = lambda t: F.struct("term", "at", "w").alias(t)
        window = (F.col("at") / NEAR).cast("int")
        one = places.select("id", window.alias("b"), of("x"))
        other = places.select("id", F.explode(F.array(window - 1, window, window + 1)).alias("b"), of("y"))
        apart = F.abs(F.col("x.at") - F.col("y.at"))
        pairs = one.join(other, ["id", "b"]).filter((F.col("x.term") < F.col("y.term")) & (apart <= NEAR) & (apart > 0))
        worth = F.sqrt(F.col("x.w") * F.col("y.w") / (1.005 + 0.05 * F.exp(apart / 1.5 - 2)))
        near = pairs.groupBy("id").agg((1 - F.exp(F.sum(F.log1p(-worth)))).alias("rank"))
        return every.join(near, "id", "left").select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"))

    def phrase(self, query: str) -> DataFrame:
        """id of the documents in which the words of the query stand one behind another, at the distances they have in it (stop
        words between them count as places); words of one stem may stand for one another."""
        words = self.spark.range(1).select(search.tokens(F.lit(query)).alias("w")).first().w
        english = self.state["language"] == "english"
        wanted = [(stem(w) if english else w, k) for k, w in enumerate(words) if not (english and w in search.STOP_WORDS)]
        if not wanted or not self.state["segments"]:
            return self._none().select("id")
        steps = self.spark.createDataFrame(wanted, "term string, step int")
        places = self.postings(tuple({t for t, _ in wanted})).select("id", "term", F.explode("ats").alias("at"))
        starts = places.join(F.broadcast(steps), "term").select("id", (F.col("at") - F.col("step")).alias("start"), "step").distinct()
        return starts.groupBy("id", "start").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("id").distinct()

    def any_of(self, queries: list[str]) -> DataFrame:
        """id of the documents that have all terms of at least one query; queries without a term are ignored."""
        out = self._none().select("id")
        for query in queries:
            found, n = self.hits(query)
            if found is not None:
                out = out.unionByName(found.groupBy("id").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == n).select("id"))
        return out.distinct()


def kept_index(docs: DataFrame, key: str, fields: dict[str, str], language: str = "english") -> TextIndex:
    """The index of a table of files, in the shared folder under a name made of these files' names, sizes and times: the first
    search builds it, later ones open it, and a table that has changed gets another."""
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    marks = []
    for name in sorted(docs.inputFiles()):
        at = path(name)
        status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        marks.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    told = repr((marks, key, list(fields.items()), docs._jdf.queryExecution().analyzed().canonicalized().toString(), language))
    folder = f"{shared_dir(spark)}/text-index-{hashlib.sha256(told.encode()).hexdigest()[:32]}"
    try:
        found = TextIndex.open(spark, folder)
    except FileNotFoundError:
        found = TextIndex.create(spark, folder, fields, language)
    return found if found.state["segments"] else found.append(docs, key)


def unified(indexes: dict[str, TextIndex], query: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """collection, id and rank over several collections: of each the page of the best, merged and cut to one page; ``total`` is
    how many match in all of them."""
    limit, offset = min(max(1, limit), 100), max(0, offset)
    order = [F.desc(F.round("rank", 9)), F.col("id")]
    out = total = None
    for name, index in indexes.items():
        found = index.ranked(query)
        head = found.orderBy(*order).offset(offset).limit(limit).select(F.lit(name).alias("collection"), F.col("id").cast("long").alias("id"), "rank")
        count = found.agg(F.count("*").alias("n"))
        out, total = (head, count) if out is None else (out.unionByName(head), total.unionByName(count))
    whole = total.agg(F.sum("n").alias("total"))
    return out.orderBy(F.desc(F.round("rank", 9)), "collection", "id").limit(limit).crossJoin(F.broadcast(whole))  # one row
