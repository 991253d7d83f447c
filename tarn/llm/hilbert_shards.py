"""Sharding along a Hilbert curve over several metadata dimensions, with DataFrame functions only.

Each dimension is quantised by quantiles of the whole table into 2^bits cells, the cells of a row give its index on the
curve, rows are ordered by that index and the order is cut into runs whose counts are at most one apart.  Neighbours on the
curve are near in every dimension, so a reader that filters on any of them opens few files.

No global sort: the rows of each cell are counted, which gives every cell its offset; a cell with many rows is split by a
hash of key and dimensions into groups of at most about GROUP_ROWS rows or a LEAST_GROUPS-th of the table; and a row's
place is the offset of its cell, plus that of its group in the cell, plus its rank in the group.  Only cell counts, 4,096
numbers for three dimensions of four bits, the quantile cuts and one total for each range of strings come to the driver.

Defined results: null metadata goes to cell 0; a null text has size 1 and checksum 0; repeated rows each get their own
slot, and rows equal in key and dimensions share a group; an empty table gives no rows.  Equal rows are interchangeable.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm.storage import stored

GROUP_ROWS = 50_000
LEAST_GROUPS = 512
ADDED = ("curve_index", "shard", "slot")


def string_cuts(df: DataFrame, column: str, cells: int) -> list[str]:
    """The quantile cuts of a string column over all rows, whole strings compared; at most cells - 1 of them.

    Equal strings are counted first.  Distinct ones are dealt into ranges of strings, the ranges' totals give every range its
    offset, and inside a range a running total finds the strings that a cut falls on.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranged = stored(counted.repartitionByRange(F.col("v")).withColumn("part", F.spark_partition_id()), "distinct-strings")
    totals = sorted(ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a partition
    total = sum(r.n for r in totals)
    starts = dict(zip((r.part for r in totals), [0, *accumulate(r.n for r in totals)], strict=False))
    if not total:
        return []
    offset = F.get(F.array(*(F.lit(starts.get(p, 0)).cast("long") for p in range(max(starts) + 1))), F.col("part"))
    upto = offset + F.sum("n").over(W.partitionBy("part").orderBy("v"))
    # cut k is the first string up to which there are k / cells of the rows
    last = F.floor((F.col("upto") * cells) / total).cast("int")
    first = F.floor(((F.col("upto") - F.col("n")) * cells) / total).cast("int")
    crossed = ranged.withColumn("upto", upto).filter(last > first).withColumn("k", F.explode(F.sequence(first + 1, last))).filter(F.col("k") < cells)
    return [r.v for r in crossed.select("v").distinct().orderBy("v").collect()]


def quantised(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Adds ``_q0.._qn``: how many quantile cuts of the whole table lie below the value."""
    kinds, cells = dict(df.dtypes), 1 << bits
    texts, rest = [d for d in dims if kinds[d] == "string"], [d for d in dims if kinds[d] != "string"]
    cuts = {d: string_cuts(df.select(d), d, cells) for d in texts}
    if rest:
        found = df.agg(*(F.percentile_approx(F.col(d).cast("double"), [k / cells for k in range(1, cells)], 10_000).alias(d) for d in rest)).first()
        cuts |= {d: found[d] or [] for d in rest}  # dims x (cells - 1) values

    def cell(d: str) -> Column:
        kind = "string" if d in texts else "double"
        borders = F.array(*(F.lit(c) for c in cuts[d])).cast(f"array<{kind}>")
        value = F.col(d).cast(kind)
        return F.when(value.isNull(), 0).otherwise(F.size(F.filter(borders, lambda c: c < value))).cast("long")

    return df.select("*", *(cell(d).alias(f"_q{i}") for i, d in enumerate(dims)))


def hilbert_index(axes: list[int], bits: int) -> int:
    """The place of a grid cell on the Hilbert curve.

    From the top bit of the axes down, axes are exchanged or inverted as the curve turns; then the interleaved bits are
    undone from their Gray code.
    """
    x, last = list(axes), len(axes) - 1
    for level in range(bits - 1, 0, -1):
        rest = (1 << level) - 1
        for i in range(last + 1):
            if x[i] >> level & 1:
                x[0] ^= rest
            else:
                swap = (x[0] ^ x[i]) & rest
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, last + 1):
        x[i] ^= x[i - 1]
    turn = 0
    for level in range(bits - 1, 0, -1):
        if x[last] >> level & 1:
            turn ^= (1 << level) - 1
    index = 0
    for level in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v ^ turn) >> level & 1
    return index


def curve_index(bits: int, dims: int) -> Column:
    """The index of the cell (_q0, _q1, ..): a constant array with the place of each of the 2^(bits*dims) cells."""
    mask = (1 << bits) - 1
    places = [hilbert_index([cell >> bits * i & mask for i in range(dims)], bits) for cell in range(1 << bits * dims)]
    table = F.split(F.lit(",".join(map(str, places))), ",").cast("array<long>")
    cell = sum((F.col(f"_q{i}") * (1 << bits * i) for i in range(1, dims)), F.col("_q0"))
    return F.get(table, cell.cast("int"))


def shard(df: DataFrame, key: str, dims: list[str], shards: int = 16, bits: int = 4) -> DataFrame:
    """Adds ``curve_index``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard); columns of the input
    with these names are replaced."""
    given, own = df.columns, [f"_in{k}_" for k in range(len(df.columns))]
    df, key, dims = df.toDF(*own), own[given.index(key)], [own[given.index(d)] for d in dims]
    kept = [(o, g) for o, g in zip(own, given, strict=True) if g not in ADDED]
    placed = quantised(df, dims, bits).withColumn("_h", curve_index(bits, len(dims)))
    cells = dict(placed.groupBy("_h").agg(F.count("*").alias("n")).collect())  # one row a cell at most: 2^(bits * dims)
    total, places = sum(cells.values()), 1 << bits * len(dims)
    group = max(1, min(GROUP_ROWS, -(-total // LEAST_GROUPS)))
    sizes = [cells.get(h, 0) for h in range(places)]
    starts = [0, *accumulate(sizes)][:places]
    mixed = F.xxhash64(key, *dims)  # no wide column, so that counting reads none
    rows = placed.withColumn("_mix", mixed).withColumn("_b", F.pmod("_mix", _known([max(1, -(-n // group)) for n in sizes]))).select(*df.columns, "_h", "_b", "_mix")
    counts = rows.groupBy("_h", "_b").agg(F.count("*").alias("_m"))
    inside = F.sum("_m").over(W.partitionBy("_h").orderBy("_b")) - F.col("_m")
    before = counts.select("_h", "_b", (_known(starts) + inside).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_h", "_b").orderBy("_mix", key))
    at = F.col("_before") + F.col("_rank") - 1
    out = rows.withColumn("_rank", rank).join(before, ["_h", "_b"]).withColumn("_at", at)
    place = F.expr(f"_at * {shards} div {max(1, total)}").cast("int")
    out = out.withColumn("_shard", place)
    first = F.expr(f"(cast(_shard as long) * {total} + {shards - 1}) div {shards}")
    return out.select(*(F.col(o).alias(g) for o, g in kept), F.col("_h").alias("curve_index"), F.col("_shard").alias("shard"), (F.col("_at") - first).cast("long").alias("slot"))


def write_shards(placed: DataFrame, path: str, files: int = 64) -> None:
    """Writes the shards as folders of Parquet files, each file a run of the curve: its footer's least and greatest values let
    a reader that filters on any dimension pass it over.  ``files`` ranges of the order are written by as many tasks."""
    placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _known(values: list[int]) -> Column:
    """The value for the cell ``_h``, out of a constant array."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>"), F.col("_h").cast("int"))
