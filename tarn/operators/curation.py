"""Work on collections that people curate: merges by hand, nested results put into tables, topics for what has none, coloured
nodes, rows that a collection lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import sections as S
from tarn.operators.selection import renumbered


def merged_by_hand(merges: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Tables (name: frame and its column of entity ids) pointed at what a list of merges (old_id, new_id) says; rows that are
    then equal are one.  Of several merges of one entity that into the least id counts; merges are not followed further."""
    to = merges.filter("old_id <> new_id").groupBy(F.col("old_id").alias("_old")).agg(F.min("new_id").alias("_new"))
    out = {}
    for name, (df, c) in tables.items():
        out[name] = df.join(to, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).select(*df.columns).distinct()
    return out


def numbered_statements(clusters: DataFrame, cluster: str, json: str, schema: str) -> DataFrame:
    """The statements that clusters hold as a JSON list, one row each: cluster, position from 0, fields, and ``statement_id``, which
    counts from 1 through the clusters in order.  A list that is null or no JSON has none."""
    listed = clusters.select(cluster, F.posexplode(F.from_json(F.col(json), f"array<struct<{schema}>>")).alias("position", "_s")).select(cluster, "position", "_s.*")
    return renumbered(listed, [F.col(cluster), F.col("position")], "statement_id")


def assigned_topics(items: DataFrame, having: DataFrame, key: str, text: Column, rules: list[tuple[str, str]]) -> DataFrame:
    """(key, topic) for the items that have no topic yet (``having``: key): every topic whose rule their text fits."""
    lacking = items.join(having.select(key).distinct(), key, "left_anti")
    return lacking.select(key, F.explode(S.topics(F.coalesce(text, F.lit("")), rules)).alias("topic"))


def lacking(parents: DataFrame, children: DataFrame, key: str, kind: Column) -> DataFrame:
    """The parents without a child of a kind."""
    return parents.join(children.filter(kind).select(key).distinct(), key, "left_anti")


def coloured_nodes(works: DataFrame, node: str, item: str, area: str) -> DataFrame:
    """node, works and area: the area most of the node's distinct items have, ties to the first by name; null areas count last."""
    counts = works.select(node, item, area).distinct().groupBy(node, area).agg(F.count("*").alias("n"))
    order = F.struct(F.col(area).isNull().cast("int").alias("none"), (-F.col("n")).alias("n"), F.coalesce(area, F.lit("")).alias("a"))
    return counts.groupBy(node).agg(F.sum("n").alias("works"), F.min_by(area, order).alias("area"))


def aligned(asked: DataFrame, answers: DataFrame, batch: str, ids: str, found: str) -> DataFrame:
    """(batch, position, id, answer): what a batch service gave, put to the ids it was asked for by position from 0.  Null answers
    are ids that were not found; a batch without an answer, or with fewer answers than ids, leaves the rest null."""
    both = asked.select(batch, F.col(ids).alias("_i")).join(answers.select(batch, F.col(found).alias("_f")), batch, "left")
    placed = F.transform("_i", lambda id, k: F.struct(k.alias("position"), id.alias("id"), F.try_element_at("_f", k + 1).alias("answer")))
    return both.select(batch, F.inline(placed))


def found_by_kind(rows: DataFrame, kind: str, answer: str = "answer") -> DataFrame:
    """Per kind (null: unknown) how many were asked for and how many were found."""
    return rows.groupBy(F.coalesce(kind, F.lit("unknown")).alias("kind")).agg(F.count("*").alias("checked"), F.count(answer).alias("found"))


def synthesised_summary(found: dict[str, Column], labels: dict[str, str], least: int = 20) -> Column:
    """A summary out of what was extracted from a document, or null where it would have ``least`` characters or fewer.

    ``found``: type and dates (strings), places and agencies (lists of strings), concepts (a list of name and role), works (a
    number).  Named are three places, four concepts (those of the role ``primary topic`` where there are two or more), three
    agencies of more than two letters, and how many works are cited.
    """
    some = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    listed = lambda head, names: F.when(F.size(names) > 0, F.concat(F.lit(head), F.array_join(names, ", "), F.lit(".")))
    named = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)) if labels else F.create_map().cast("map<string,string>")
    kind = F.coalesce(F.try_element_at(named, found["type"]), F.replace(found["type"], F.lit("_"), F.lit(" ")), F.lit("Document"))
    dated = F.when(F.coalesce(found["dates"], F.lit("")) != "", F.concat(F.lit(" ("), found["dates"], F.lit(")"))).otherwise("")
    first = F.slice(F.filter(found["concepts"], lambda c: c["role"] == "primary topic"), 1, 4)
    concepts = F.transform(F.when(F.size(first) >= 2, first).otherwise(F.slice(found["concepts"], 1, 4)), lambda c: c["name"])
    agencies = F.slice(F.filter(some(found["agencies"]), lambda a: F.length(a) > 2), 1, 3)
    works = F.coalesce(found["works"], F.lit(0))
    cites = F.when(works > 0, F.concat(F.lit("Cites "), works.cast("string"), F.when(works == 1, " external work.").otherwise(" external works.")))
    whole = F.concat_ws(" ", F.concat(kind, dated, F.lit(".")), listed("Covers ", F.slice(some(found["places"]), 1, 3)), listed("Topics: ", some(concepts)), listed("Agencies: ", agencies), cites)
    return F.when(F.length(whole) > least, whole)


def replaced_summary(old: Column, new: Column, short: int = 100) -> Column:
    """The new summary where there is one and the old one has fewer characters than ``short``; else the old one."""
    return F.when(new.isNotNull() & (F.length(F.coalesce(old, F.lit(""))) < short), new).otherwise(old)
