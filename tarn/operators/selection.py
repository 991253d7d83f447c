"""Predicates and projections over named things: exclusion lists, junk names, places, sort modes, worklists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that stand for no name, and how such names begin.
PLACEHOLDERS = (
    "unknown", "unspecified", "unidentified", "undetermined", "undefined", "not specified", "not mentioned", "not identified", "not given", "not stated",
    "not applicable", "not available", "none", "n/a", "na", "nil", "null", "tbd", "various", "multiple", "misc", "miscellaneous", "other", "others", "sp.",
    "spp.", "sp", "spp", "unknown species", "unknown taxa", "unspecified species", "multiple species", "various species",
)
NEGATED = r"^(not |un)(specified|mentioned|identified|determined|known|defined|stated|given|named|listed)\b"
ABSENT = r"^no (taxon|species|name|specific|particular)\b"


def junk_name(name: Column) -> Column:
    """Whether a name says nothing: null, blank, a placeholder, or a phrase around one."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (low == "") | low.isin(*PLACEHOLDERS) | low.rlike(NEGATED) | low.rlike(ABSENT)


def title_excluded(title: Column, exact: list[str], patterns: list[str]) -> Column:
    """Whether a title equals one of a list or is LIKE one of the patterns, in any case."""
    low = F.lower(title)
    return reduce(Column.__or__, (low.like(p.lower()) for p in patterns), low.isin(*[e.lower() for e in exact]))


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in a text, from the length that goes when it is taken out."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word)).cast("long")


def contains_none(text: Column, words: list[str]) -> Column:
    return reduce(Column.__and__, (occurrences(text, w) == 0 for w in words))


def inside_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """south, west, north, east; a point without coordinates is inside, since nothing speaks against it."""
    south, west, north, east = box
    return lat.isNull() | lon.isNull() | (lat.between(south, north) & lon.between(west, east))


def boxes_overlap(south: Column, west: Column, north: Column, east: Column, box: tuple[float, float, float, float]) -> Column:
    s, w, n, e = box
    return (south <= n) & (north >= s) & (west <= e) & (east >= w)


def order_of(mode: str, cited: bool, key: str = "item_id") -> list[Column]:
    """The ORDER BY of a collection for a sort mode; the citation modes need citation counts, others fall back to rank.
    Ends in the key, so that pages do not overlap."""
    rank = F.desc("rank")
    known = {
        "newest": F.desc_nulls_last("year"), "oldest": F.asc_nulls_last("year"), "title": F.asc("title"), "title-desc": F.desc("title"),
        "most-cited": F.desc_nulls_last("external") if cited else rank, "most-cited-internal": F.desc_nulls_last("internal") if cited else rank,
    }
    return [known.get(mode, rank), F.col(key)]


def unprocessed(todo: DataFrame, done: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The next rows to work on: those whose key is not among the processed ones, at most ``limit``."""
    return todo.join(done.select(key).distinct(), key, "left_anti").orderBy(*order).limit(limit)


def words_stand_in(text: Column, title: Column, positions: tuple[int, ...] = (1, 3)) -> Column:
    """Whether the words of the title at these places (from 1) stand in the text; a word that the title lacks stands anywhere."""
    words = F.split(F.lower(title), " ")
    return reduce(Column.__and__, (F.lower(text).contains(F.coalesce(F.get(words, F.lit(p - 1)), F.lit(""))) for p in positions))


def focus(counts: Column) -> Column:
    """What a map of counts by type is about: the type with more than all others together, else mixed; missing types count 0."""
    of = lambda kind: F.coalesce(F.try_element_at(counts, F.lit(kind)), F.lit(0))
    pubs, docs, stories = of("publication"), of("document"), of("story")
    return F.when(pubs > docs + stories, "research").when(docs > pubs + stories, "policy").when(stories > pubs + docs, "news").otherwise("mixed")


def strongest_first(df: DataFrame, by: list[str], order: list[Column], then: list[Column], limit: int) -> DataFrame:
    """DISTINCT ON, sorted anew: the first row of every group, of which the first ``limit`` in another order."""
    from tarn.operators.browse import first_per_group

    return first_per_group(df, by, order).orderBy(*then).limit(limit)


def parents_first(nodes: DataFrame, id: str, parent: str) -> DataFrame:
    """Adds ``level``: 0 for rows without a parent, else one more than the parent's; rows that hang on no root are left out.

    A join a level, until a level is empty.
    """
    level = nodes.filter(F.col(parent).isNull()).withColumn("level", F.lit(0))
    out, k = level, 0
    while not level.isEmpty():
        k += 1
        above = level.select(F.col(id).alias("_above"))
        level = nodes.join(above, F.col(parent) == F.col("_above"), "left_semi").withColumn("level", F.lit(k))
        out = out.unionByName(level)
    return out


def renumbered(df: DataFrame, order: list[Column], id: str = "new_id", parts: int = 64) -> DataFrame:
    """Ids 1, 2, .. in ascending order of the given values without putting all rows in one task: ranges of the order are
    numbered on their own and start where the ranges before them end.  The ranges are stored, since their borders are sampled and
    both the counts and the numbers must see the same ones."""
    from pyspark.sql import Window as W

    from tarn.operators.storage import stored

    keys = [f"_o{i}" for i in range(len(order))]
    ranged = df.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True)))
    ranged = stored(ranged.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    number = F.row_number().over(W.partitionBy("_part").orderBy(*keys))
    return ranged.withColumn("_rn", number).join(F.broadcast(starts), "_part").withColumn(id, F.col("_start") + F.col("_rn")).drop("_part", "_rn", "_start", *keys)
