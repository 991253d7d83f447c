"""Steps whose work has to grow with the input: what they read again, what they hold, what they make on the way."""

from __future__ import annotations

import time

import pytest
from oracle import FOLDER
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import graph, linking, resolve
from tarn.plans import graph as graph_plans
from tarn.plans import network as network_plans
from tarn.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_titles_of_records_are_worked_once(spark):
    """After the stored sets no step normalises a title again; null years, orders of words and equal sets count as before."""
    columns = "id long, doi string, title string, year int"
    records = spark.createDataFrame([(1, None, "Plants of the meadow", 1990), (2, None, "of the Meadow, plants", None), (3, "10.1/A", "!", 1990), (4, None, " ", 1990), (5, None, "plants of the meadow", 1980)], columns)
    known = spark.createDataFrame([(11, None, "the meadow of plants", 1999), (12, None, "<i>Plants</i> of the meadow", 1991), (10, None, "plants of the meadow", 1991), (13, "https://doi.org/10.1/a", None, None), (14, None, "?", 1990)], columns)
    found = resolve.match_records(records, known)
    assert "regexp_replace" not in plan(found)
    assert {r.id: (r.match_id, r.confidence, r.similarity) for r in found.collect()} == {1: (10, "high", 1.0), 2: (10, "high", 1.0), 3: (13, "exact", 1.0), 4: (None, "none", None), 5: (10, "fuzzy", 1.0)}


def test_phrases_in_a_long_text(spark):
    """The work for a text grows with its words; it grew with their square.  Equal phrases, repeats and the text's end count."""
    docs = spark.createDataFrame([(2, "b a a"), (3, None), (4, "...")], "doc_id long, text string").unionByName(spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.expr("array_join(transform(sequence(1, 200000), i -> if(i % 50000 = 0, 'a', if(i % 50000 = 1, 'b', 'c'))), ' ')").alias("text")))
    phrases = spark.createDataFrame([(7, "A b"), (8, "a, B"), (9, "c a"), (10, "a"), (11, "c b"), (12, "b a a a"), (13, "b c c c"), (14, "!")], "phrase_id long, phrase string")
    began = time.monotonic()
    found = {(r.item_id, r.phrase_id): (r.places, r.first) for r in linking.phrase_counts(docs, phrases, "doc_id", "text").collect()}
    assert time.monotonic() - began < 40
    assert found == {(1, 7): (3, 50_000), (1, 8): (3, 50_000), (1, 9): (4, 49_999), (1, 10): (4, 50_000), (1, 13): (4, 1), (2, 10): (2, 2)}


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """A thousand rows of four keys are few, their 124,500 pairs are not; rows without a key are in no pair."""
    monkeypatch.setattr(graph, "DEALT", 10_000)
    rows = spark.range(1000).select("id", (F.col("id") % 4).alias("k"), F.when(F.col("id") >= 0, F.lit("x")).alias("j"))
    found = graph.equal_pairs(rows.unionByName(spark.createDataFrame([(2000, None, "x"), (2001, None, "x")], "id long, k long, j string")), ["k", "j"], "id")
    assert found.filter("a % 4 = b % 4 and a < b").distinct().count() == found.count() == 4 * 250 * 249 // 2
    assert ", 13" in plan(found)


def test_mentions_and_edges_are_dealt_by_their_number(spark, monkeypatch):
    """With four partitions given, a task's share of mentions and of edges would grow with the tables."""
    t = tables.Tables(spark, FOLDER)
    count = t("lineitem").count()
    whole = t.entity_mentions().count()
    assert "RepartitionByExpression" not in plan(t.entity_mentions())
    monkeypatch.setattr(tables, "DEALT", 500)
    assert "RepartitionByExpression [l_orderkey" in plan(t.entity_mentions()) and f", {count // 500 + 1}" in plan(t.entity_mentions())
    assert t.entity_mentions().count() == whole
    monkeypatch.setattr(graph, "DEALT", 100)
    edges = graph_plans.gra04(t)
    assert edges.rdd.getNumPartitions() > 4 and "lineitem" not in edges._jdf.queryExecution().executedPlan().toString()


def test_mentions_of_edge_families_are_read_once(spark):
    """Four families of documents come from the same mentions, three from the same pairs; each read lineitem again."""
    df = network_plans.gra06_documents(tables.Tables(spark, FOLDER))
    assert plan(df).count("Relation [l_orderkey") == 1  # for the authors


def test_first_family_has_the_pair(spark):
    """Ends in any order, loops and null ends; of a family's edges the one with most weight, then the least source."""
    edge = lambda *rows: spark.createDataFrame(rows, "source string, target string, weight double")
    found = graph.edge_families({"one": edge(("b", "a", 1.0), ("c", "c", 1.0), ("d", None, 1.0)), "two": edge(("a", "b", 9.0), ("e", "d", 2.0), ("d", "e", 2.0), ("g", "f", 3.0), ("f", "g", None), ("f", "g", 1.0))})
    assert sorted(tuple(r) for r in found.collect()) == [("one", "b", "a", 1.0), ("two", "d", "e", 2.0), ("two", "g", "f", 3.0)]
    assert found.columns == ["family", "source", "target", "weight"]


def test_titles_without_a_word_are_set_apart_once(spark):
    """Titles without a word were looked for again in every pair of parts of the two sides."""
    titles = spark.createDataFrame([(1, "Plants of the meadow"), (2, "the plants of a Meadow"), (3, "!"), (4, " "), (5, None), (6, "of the meadow, plants")], "id long, title string")
    found = resolve.title_pairs(titles, titles, 0.85)
    assert "regexp_replace" not in plan(found)
    assert sorted((r.left_id, r.right_id) for r in found.collect()) == [(1, 1), (1, 6), (2, 2), (3, 3), (3, 4), (4, 3), (4, 4), (6, 1), (6, 6)]


def test_trigrams_of_random_titles_make_few_candidates(spark):
    """Titles of random words and a common end: by single trigrams 5,000 of them made 7 million candidates, which were shuffled."""
    title = F.expr("concat(left(sha2(cast(id as string), 256), 8), ' ', left(sha2(cast(-id - 1 as string), 256), 8), ' is a title')")
    rows = spark.range(5000).select("id", X.trigrams(title).alias("tokens"))
    near = rows.filter("id < 50").select((F.col("id") + 10_000).alias("id"), F.expr("concat(filter(tokens, t -> t <> tokens[4]), array('???'))").alias("tokens"))
    sets, _, _ = resolve._distinct_sets(rows, near)
    assert sets.agg(F.min("n")).first()[0] > resolve.SHORT
    sets = sets.select("sid", "no", "tokens", "n", "sig", F.lit(True).alias("l"), F.lit(True).alias("r"))
    assert resolve.candidate_sets(sets, 0.8).count() < 1000
    found = resolve.set_similarity_join(rows, near, 0.8, strict=False)
    assert sorted((r.left_id, r.right_id) for r in found.collect()) == [(k, 10_000 + k) for k in range(50)]


@pytest.mark.parametrize("whole", [3, 1_000_000])
def test_runs_that_are_no_phrase_are_not_shuffled(spark, monkeypatch, whole):
    """Every word of every text went through the shuffle with each length of phrases; whatever the size of the phrases, it need not."""
    monkeypatch.setattr(linking, "WHOLE", whole, raising=False)
    docs = spark.createDataFrame([(1, "a b c d a b"), (2, "x a B"), (3, None)], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "a b"), (2, "d"), (3, "c d a"), (4, "A, b"), (5, "y"), (6, "q r s"), (7, "b c d e")], "phrase_id long, phrase string")
    monkeypatch.setattr(linking, "stored", lambda df, name: df.localCheckpoint())
    found, _ = linking._phrases_met(docs, phrases, "doc_id", "text")
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString() and plan(found).count("LeftSemi") == (2 if whole == 3 else 1)
    got = linking.phrase_counts(docs, phrases, "doc_id", "text").collect()
    assert {(r.item_id, r.phrase_id): (r.places, r.first) for r in got} == {(1, 1): (2, 1), (1, 4): (2, 1), (1, 2): (1, 4), (1, 3): (1, 3), (2, 1): (1, 2), (2, 4): (1, 2)}


def test_blocks_of_pairs_are_dealt_by_their_pairs(spark, monkeypatch):
    """The blocks of 600 nodes with the same items are a few kilobytes, their 179,700 pairs are not; one task made all of them."""
    monkeypatch.setattr(graph, "HUB", 50)
    members = spark.range(600).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("item"))
    found = graph.pair_counts_by_class(members, ["item"], "id", 2)
    assert found.groupBy(F.spark_partition_id()).count().count() == 4
    assert found.filter("a < b and weight = 2").distinct().count() == found.count() == 600 * 599 // 2
