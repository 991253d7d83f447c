from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import curation


def test_merges_by_hand(spark):
    """Of two merges of one entity that into the least id counts; chains are not followed; nulls stay."""
    merges = spark.createDataFrame([(3, 2), (3, 1), (2, 1), (5, 5), (None, 1)], "old_id long, new_id long")
    mentions = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, "c"), (None, "d")], "entity_id long, item string")
    got = curation.merged_by_hand(merges, {"m": (mentions, "entity_id")})["m"].collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a"), (1, "b"), (5, "c"), (None, "d")], key=str)


def test_statements_are_numbered_through_the_clusters(spark):
    rows = [(2, '[{"x": "c"}]'), (1, '[{"x": "a"}, {"x": null}]'), (3, None), (4, "no json"), (5, "[]")]
    got = curation.numbered_statements(spark.createDataFrame(rows, "k int, j string"), "k", "j", "x string").collect()
    assert sorted((r.statement_id, r.k, r.position, r.x) for r in got if r.k < 4) == [(1, 1, 0, "a"), (2, 1, 1, None), (3, 2, 0, "c")]


def test_areas_topics_and_what_is_lacking(spark):
    works = spark.createDataFrame([(1, 1, "b"), (1, 1, "b"), (1, 2, "a"), (2, 3, None), (2, 4, None), (2, 5, "z")], "node int, item int, area string")
    assert sorted(map(tuple, curation.coloured_nodes(works, "node", "item", "area").collect())) == [(1, 2, "a"), (2, 3, "z")]
    items = spark.createDataFrame([(1, "Bees and BIRDS"), (2, None), (3, "birds")], "k int, text string")
    topics = curation.assigned_topics(items, items.filter("k = 3"), "k", F.col("text"), [("bird", "birds"), (r"\bbee", "bees")])
    assert sorted(map(tuple, topics.collect())) == [(1, "bees"), (1, "birds")]
    assert [r.k for r in curation.lacking(items, items.filter("k < 3"), "k", F.col("text").isNotNull()).orderBy("k").collect()] == [2, 3]


def test_answers_by_position(spark):
    """Null answers, fewer answers than ids, a batch without an answer."""
    asked = spark.createDataFrame([(1, [10, 11, 12]), (2, [20]), (3, [])], "b int, ids array<int>")
    answers = spark.createDataFrame([(1, ["x", None])], "b int, found array<string>")
    rows = curation.aligned(asked, answers, "b", "ids", "found")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 10, "x"), (1, 1, 11, None), (1, 2, 12, None), (2, 0, 20, None)]
    counted = curation.found_by_kind(rows.withColumn("kind", F.when(F.col("b") == 1, "a")), "kind")
    assert sorted(map(tuple, counted.collect())) == [("a", 3, 1), ("unknown", 1, 0)]


def test_summaries_of_what_was_extracted(spark):
    schema = "k int, type string, dates string, places array<string>, concepts array<struct<name:string,role:string>>, agencies array<string>, works int, old string"
    p = "primary topic"
    rows = [
        (1, "mining_permit", "1990", ["A", "", None, "B", "C", "D"], [("x", p), ("y", "o"), ("z", p)], ["US", "EPA", "BLM", "NPS", "FWS"], 1, "short"),
        (2, "site_visit", "", [], [("x", p), ("y", "o"), (None, "o")], None, 3, "short"),
        (3, None, None, None, [], None, None, "short"),
        (4, "mining_permit", "1990", ["A"], [], None, None, "o" * 100),
    ]
    df = spark.createDataFrame(rows, schema)
    new = curation.synthesised_summary({c: F.col(c) for c in ("type", "dates", "places", "concepts", "agencies", "works")}, {"mining_permit": "Mining permit"})
    got = {r.k: r.s for r in df.select("k", curation.replaced_summary(F.col("old"), new).alias("s")).collect()}
    assert got == {1: "Mining permit (1990). Covers A, B, C. Topics: x, z. Agencies: EPA, BLM, NPS. Cites 1 external work.", 2: "site visit. Topics: x, y. Cites 3 external works.", 3: "short", 4: "o" * 100}
