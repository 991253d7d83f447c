"""Filter interaction audit: what each filter removes in each order of application.

Texts are read once, for five failure flags; everything after that works on counts.  Rows are counted by part and flags (at
most 32 combinations a part), and SQL's CUBE over the flags and the part adds these counts up for every choice of flags.  The
row of a grouping set whose chosen flags are all false holds what survives that subset of filters, so a step of an order is
the difference of two subsets' survivors: one join of pairs of subsets serves all 120 orders.

Flag E compares whole texts by their SHA-256 against the least key of the table.  The join back to the rows is one that
Spark splits when a text has very many copies, since both sides are read from stored tables.

Defined results: a null text is the empty text (fails A; equal to other empty ones); a null part is the empty string; a null
key is smaller than none and greater than none, so its row never fails E and makes no other row fail; rows that repeat a key
count each, and equal texts of one key do not fail E through one another; of several labels of a key the greatest counts, and
a null label is 0; an empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.storage import stored
from tarn.llm.text_stats import LEAD, UPPER
from tarn.llm.textarrays import Text, marking, slices, text_of, words_of

FILTERS = "ABCDE"
SYMBOLS = marking([*b"#$%&*|"])
COUNTS = ("n", "good", "toxic")


def text_flags(text: Text) -> np.ndarray:
    """Bits 0 to 3 of every row: A under 200 words, B under half of the words distinct, C over 2% capitals, D a symbol."""
    words = words_of(text)
    n_words, size = np.diff(words.first), max(1, len(words.vocab))
    distinct = np.bincount(np.unique(words.rows().astype(np.int64) * size + words.codes) // size, minlength=len(n_words))
    upper, points = text.per_row(text.marked(UPPER)), text.per_row(text.marked(LEAD))
    fails = (n_words < 200, 100 * distinct < 50 * n_words, 100 * upper > 2 * points, text.per_row(text.marked(SYMBOLS)) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def flagged(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """_key, _part and ``bits`` (bit k: filter k fails) of every row; the text-wide flag E is bit 4."""
    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("_part", T.StringType()), T.StructField("bits", T.IntegerType()), T.StructField("_sha", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([piece["_key"], piece["_part"], pa.array(text_flags(text_of(piece["_text"])), pa.int32()), piece["_sha"]], ["_key", "_part", "bits", "_sha"])

    whole = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), whole.alias("_text"), F.unhex(F.sha2(whole, 256)).alias("_sha"))
    rows = stored(slim.select("_key", "_part", "_text", "_sha").mapInArrow(run, schema), "audit-rows")
    copies = rows.groupBy("_sha").agg(F.min("_key").alias("_least"), F.count("*").alias("_n")).filter("_n > 1 and _least is not null").drop("_n")
    later = F.coalesce(F.col("_key") > F.col("_least"), F.lit(False))
    return rows.join(stored(copies, "audit-copies"), "_sha", "left").select("_key", "_part", (F.col("bits") + F.when(later, 16).otherwise(0)).alias("bits"))


def counted(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """n, good and toxic by _part and the flags a to e."""
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
    known = stored(known.agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(f"_{c}") for c in ("quality", "toxic"))), "audit-labels")
    is_one = lambda c: F.sum(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long")
    sums = rows.join(known, "_key", "left").groupBy("_part", "bits").agg(F.count("*").alias("n"), is_one("_quality").alias("good"), is_one("_toxic").alias("toxic"))
    return sums.select("_part", *(F.col("bits").bitwiseAND(1 << k).cast("boolean").alias(f.lower()) for k, f in enumerate(FILTERS)), *COUNTS)


def subset_survivors(counts: DataFrame) -> DataFrame:
    """_part, subset (a mask of filters) and the counts of rows that fail none of it, for all 32 subsets, zeros included.

    ``grouping`` is 0 for a chosen flag.  A part and subset without an all-false row has no survivors.
    """
    flags = [f.lower() for f in FILTERS]
    chosen = sum((1 - F.grouping(f)) * (1 << k) for k, f in enumerate(flags)).cast("int")
    cube = counts.cube(*flags, "_part").agg(chosen.alias("subset"), F.grouping("_part").alias("_all"), *(F.sum(c).alias(c) for c in COUNTS))
    clear = cube.filter("_all = 0")
    for f in flags:
        clear = clear.filter(F.coalesce(~F.col(f), F.lit(True)))
    every = counts.select("_part").distinct().select("_part", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("subset"))
    found = clear.select("_part", "subset", *COUNTS)
    return every.join(found, ["_part", "subset"], "left").fillna(0, list(COUNTS))


def steps(survivors: DataFrame) -> DataFrame:
    """For each part, subset already applied and filter not in it: what the filter's step does there.

    A subset is joined with the one that has one filter more.  The first step of a filter tells how many rows fail it, the last
    one how many fail it alone.
    """
    moves = F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(1 << f).alias("bit")) for f in range(len(FILTERS))))
    before = survivors.select("*", F.inline(moves)).filter(F.col("subset").bitwiseAND(F.col("bit")) == 0)
    after = survivors.select("_part", F.col("subset").alias("after"), *(F.col(c).alias(f"{c}_after") for c in COUNTS))
    pairs = before.withColumn("after", F.col("subset") + F.col("bit")).join(after, ["_part", "after"])
    lost = [(F.col(c) - F.col(f"{c}_after")).alias(name) for c, name in zip(COUNTS, ("removed", "good_lost", "toxic_lost"), strict=True)]
    moved = pairs.select("_part", "subset", "filter", "bit", F.col("n_after").alias("kept"), *lost)
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(4 - k)) for k in range(5))), F.bit_count("subset") + 1)
    at = lambda subset: F.max(F.when(F.col("subset") == subset, F.col("removed")))
    totals = moved.groupBy("_part", "filter").agg(at(0).alias("_fails"), at(F.lit(31) - F.col("bit")).alias("unique_fails"), F.sum(F.col("removed") * orders).alias("shapley"))
    return moved.join(totals, ["_part", "filter"]).withColumn("redundant", F.col("_fails") - F.col("removed"))


def order_steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, mask of the filters before it, filter: 600 rows."""
    return [("".join(FILTERS[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in permutations(range(5)) for k in range(5)]


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row for each part, order of the five filters and step."""
    found = steps(stored(subset_survivors(counted(flagged(docs, key, text, part), labels, key)), "audit-subsets"))
    orders = docs.sparkSession.createDataFrame(order_steps(), "filter_order string, step int, subset int, filter int")
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return found.join(F.broadcast(orders), ["subset", "filter"]).select(F.col("_part").alias("part"), "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in columns))
