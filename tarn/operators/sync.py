"""Curation-safe merging and incremental synchronisation of two sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIPELINE, CURATED, PULL, PUSH = "pipeline", "curated", "pull", "push"


def merge_field(local: Column, remote: Column, kind: str, direction: str) -> Column:
    """Pipeline fields follow the local side, curated ones the remote side, each only where it has a value; on a push the
    value of a pipeline field is the local one, on a pull a curated one is the remote one."""
    if direction not in (PULL, PUSH):
        raise ValueError(f"unknown direction: {direction}")
    return F.coalesce(local, remote) if kind == PIPELINE else F.coalesce(remote, local)


def merge_record(local: Column, remote: Column, field: str, kind: str, direction: str, local_marks: Column, remote_marks: Column) -> Column:
    """A field that the remote side asserts by hand keeps the remote value, one that the local side asserts the local one,
    any other follows the rule of its kind."""
    by_hand = lambda marks: F.coalesce(F.array_contains(marks, field), F.lit(False))
    return F.when(by_hand(remote_marks), remote).when(by_hand(local_marks), local).otherwise(merge_field(local, remote, kind, direction))


def curated_safe(field: str, new: Column, marks: Column) -> Column:
    """The new value, unless the field is marked as curated."""
    return F.when(F.coalesce(F.array_contains(marks, field), F.lit(False)), F.col(field)).otherwise(new)


def curation_marks(before: DataFrame, after: DataFrame, key: str, fields: list[str], marks: str = "curated_fields") -> DataFrame:
    """Marks after an edit: changed fields with a value are added, cleared ones go."""
    old = before.select(key, *(F.col(f).alias(f"_old_{f}") for f in fields))
    joined = after.join(old, key, "left")
    empty = lambda f: F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")
    changed = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_old_{f}")) & ~empty(f), F.lit(f)) for f in fields)))
    cleared = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_old_{f}")) & empty(f), F.lit(f)) for f in fields)))
    had = F.coalesce(F.col(marks), F.array().cast("array<string>"))
    return joined.withColumn(marks, F.array_sort(F.array_except(F.array_union(had, changed), cleared))).select(*after.columns)


def upsert(target: DataFrame, updates: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """ON CONFLICT DO UPDATE: rows of both sides by key.  ``rules`` give a column's merged value from ``old_<c>`` and
    ``new_<c>``; columns without a rule take the new value where there is one.  Updates must be distinct by key."""
    old = target.select(key, F.lit(True).alias("_old"), *(F.col(c).alias(f"old_{c}") for c in target.columns if c != key))
    new = updates.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"new_{c}") for c in target.columns if c != key))
    both = old.join(new, key, "full")
    merged = {c: F.when(F.col("_new").isNull(), F.col(f"old_{c}")).when(F.col("_old").isNull(), F.col(f"new_{c}")).otherwise(rules.get(c, F.coalesce(f"new_{c}", f"old_{c}"))) for c in target.columns if c != key}
    return both.select(key, *(v.alias(c) for c, v in merged.items()))


def longest(column: str) -> Column:
    """A rule for ``upsert``: the longer of the two values, the old one where they are equally long; nulls count as nothing."""
    old, new = F.col(f"old_{column}"), F.col(f"new_{column}")
    size = lambda c: F.coalesce(F.length(c), F.lit(-1))
    return F.when(size(new) > size(old), new).otherwise(old)


def insert_if_absent(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows to append: those whose key the target lacks, one for each key."""
    return rows.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def newer(rows: DataFrame, target: DataFrame, key: str, stamp: str, watermark: Column) -> DataFrame:
    """Rows changed after the watermark and later than what the target has."""
    have = target.select(key, F.col(stamp).alias("_have"))
    return rows.filter(F.col(stamp) > watermark).join(have, key, "left").filter(F.col("_have").isNull() | (F.col(stamp) > F.col("_have"))).drop("_have")


def changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): added, removed or changed; equal rows are left out."""
    a = old.select(key, F.lit(1).alias("_a"), F.struct(*fields).alias("_x"))
    b = new.select(key, F.lit(1).alias("_b"), F.struct(*fields).alias("_y"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_x").eqNullSafe(F.col("_y")), "changed")
    return a.join(b, key, "full").select(key, kind.alias("change")).filter("change is not null")


def guarded_replace(current: DataFrame, incoming: DataFrame, least: float = 0.5) -> DataFrame:
    """The incoming rows, unless they are fewer than this share of the current ones: then an error."""
    before, after = current.count(), incoming.count()
    if after < least * before:
        raise ValueError(f"replacement would shrink the table from {before} to {after} rows")
    return incoming


def translated(rows: DataFrame, ids: DataFrame, column: str, kind: str) -> DataFrame:
    """Foreign ids replaced by those of the other store (old_id, new_id); links without one become external."""
    mapped = rows.join(ids.select(F.col("old_id").alias(column), "new_id"), column, "left")
    out = mapped.withColumns({kind: F.when(F.col("new_id").isNull(), "external").otherwise(F.col(kind)), column: F.col("new_id")})
    return out.select(*rows.columns).dropDuplicates()


def row_counts(stores: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Per table the row counts of two stores and whether they agree."""
    out = None
    for store, tables in stores.items():
        for name, df in tables.items():
            one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(store).alias("store"), "n")
            out = one if out is None else out.unionByName(one)
    wide = out.groupBy("table").pivot("store", list(stores)).agg(F.first("n"))
    a, b = list(stores)
    return wide.withColumn("agrees", F.col(a).eqNullSafe(F.col(b)))


def quotas(sizes: DataFrame, n: str, total: int, least: int = 2) -> DataFrame:
    """Adds ``quota``: each stratum's share of ``total`` in proportion to its rows, ``least`` at least and not more than it has;
    where that is too much in all, every quota is scaled down, to one at least.  All rows where they are no more than total."""
    every = W.partitionBy()  # one row a stratum
    rows = F.sum(n).over(every)
    share = F.greatest(F.lit(least), F.least(F.floor(F.lit(total) * F.col(n) / rows + 0.5), F.col(n)))
    given = sizes.withColumns({"_share": share.cast("long"), "_rows": rows}).withColumn("_sum", F.sum("_share").over(every))
    scaled = F.when(F.col("_sum") > total, F.greatest(F.lit(1), F.floor(F.col("_share") * total / F.col("_sum")))).otherwise(F.col("_share"))
    return given.withColumn("quota", F.when(F.col("_rows") <= total, F.col(n)).otherwise(scaled).cast("long")).drop("_share", "_rows", "_sum")


def stratified(df: DataFrame, stratum: str, total: int, key: str, least: int = 2, seed: int = 42) -> DataFrame:
    """About ``total`` rows, each stratum by its quota, chosen by a seeded hash of the key."""
    quota = quotas(df.groupBy(stratum).agg(F.count("*").alias("_n")), "_n", total, least).withColumnRenamed("quota", "_quota")
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(F.xxhash64(key, F.lit(seed)), key))
    return df.withColumn("_rn", rank).join(quota.select(stratum, "_quota"), stratum).filter("_rn <= _quota").drop("_rn", "_quota")


def united_marks(local: Column, remote: Column) -> Column:
    """What both sides assert by hand, sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(local, none), F.coalesce(remote, none)))


def same_value(a: Column, b: Column) -> Column:
    """Whether two values are the same, nested ones by their parts; two nulls are."""
    return a.eqNullSafe(b)


def same_moment(at: Column, text: Column) -> Column:
    """Whether a time and a written time are the same moment, however it is written."""
    return F.coalesce(F.unix_micros(at.cast("timestamp")) == F.unix_micros(F.try_to_timestamp(text)), at.isNull() & text.isNull())


def orphans(target: DataFrame, source: DataFrame, key: str, deletable: Column) -> DataFrame:
    """The rows of the target that the source no longer has and that may go."""
    return target.filter(deletable).join(source.select(key).distinct(), key, "left_anti")


def updated(old: DataFrame, new: DataFrame, key: str, enriched: list[str]) -> DataFrame:
    """The new rows, with the enriched fields of the old rows of the same key."""
    return new.join(old.select(key, *enriched), key, "left")


def verified(refs: DataFrame, known: DataFrame, target: str, key: str) -> DataFrame:
    """Adds ``verdict``: valid where the target is known, invalid where it is not, none where there is no target."""
    have = known.select(F.col(key).alias(target), F.lit(True).alias("_known")).distinct()
    joined = refs.join(have, target, "left")
    return joined.withColumn("verdict", F.when(F.col(target).isNull(), "none").when(F.col("_known"), "valid").otherwise("invalid")).drop("_known")


def zipped_rows(batches: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Parallel arrays (one row a batch) as rows; ``columns`` names the column that each array becomes."""
    zipped = batches.select(F.explode(F.arrays_zip(*columns)).alias("z"))
    return zipped.select(*(F.col("z")[a].alias(c) for a, c in columns.items()))
