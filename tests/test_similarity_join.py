from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tarn.operators import matching, resolve

WORDS = [f"w{k}" for k in range(40)]


def made(seed: int, rows: int, longest: int) -> list[tuple[int, list[str]]]:
    """Sets with many near pairs on both sides of a threshold, equal sets, and a few words that are almost everywhere."""
    draw, out = random.Random(seed), []
    for k in range(rows):
        if out and draw.random() < 0.6:
            tokens = list(draw.choice(out)[1])
            for _ in range(draw.randrange(3)):
                if tokens and draw.random() < 0.5:
                    tokens.pop(draw.randrange(len(tokens)))
                else:
                    tokens.append(draw.choice(WORDS))
        else:
            tokens = draw.sample(WORDS, draw.randint(1, longest))
        tokens += [w for w in ("the", "of") if draw.random() < 0.9]
        out.append((k, list(dict.fromkeys(tokens))))
    return out


def brute(left, right, t: float, strict: bool) -> dict:
    found = {}
    for i, x in left:
        for j, y in right:
            a, b = set(x or []), set(y or [])
            s = len(a & b) / len(a | b) if a and b else 0.0
            if s > t or not strict and s >= t:
                found[i, j] = s
    return found


@pytest.mark.parametrize(("t", "longest", "strict"), [(0.85, 12, True), (0.8, 36, False), (0.4, 5, True), (0.5, 3, False), (0.95, 30, True)])
def test_against_all_pairs(spark, t, longest, strict):
    left, right = [*made(1, 160, longest), (900, None), (901, [])], [*made(2, 120, longest), *made(1, 60, longest), (902, None), (903, [])]
    right = [(k, tokens) for k, (_, tokens) in enumerate(right)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, tokens array<string>")
    want = brute(left, right, t, strict)
    rows = resolve.set_similarity_join(frame(left), frame(right), t, strict).collect()
    assert len(rows) == len(want) > 30
    assert {(r.left_id, r.right_id): pytest.approx(r.similarity) for r in rows} == want
    own = resolve.set_similarity_join(frame(left), frame(left), t, strict).collect()
    assert {(r.left_id, r.right_id) for r in own} == set(brute(left, left, t, strict)) and len(own) == len({(r.left_id, r.right_id) for r in own})


def test_candidates_stay_few_with_common_words(spark):
    """Titles that share all but one word: a thousand rows of a hundred titles, whose common words are in each of them."""
    sets = spark.range(1000).select("id", F.expr("array('a', 'study', 'of', 'meadow', 'plants', 'and', 'their', 'growth', 'number', concat('n', id % 100), concat('m', id % 100))").alias("tokens"))
    distinct, own, _ = resolve._distinct_sets(sets, sets)
    assert distinct.count() == 100 and own.count() == 1000
    assert resolve.candidate_sets(distinct, 0.85).count() == 0
    assert resolve.set_similarity_join(sets, sets, 0.85).count() == 1000 * 10


def test_years_and_ties_of_records(spark):
    """Equal titles in several years, unknown years, ties, titles without a word, nulls."""
    schema = "id long, doi string, title string, year int"
    title = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    records = spark.createDataFrame([(1, None, title, 2000), (2, None, title.upper(), None), (3, "10.1/X", "other", 1990), (4, None, "!!", 2000), (5, None, None, None), (6, None, title + " mu", 2010), (7, None, title, 2030)], schema)
    existing = spark.createDataFrame([(20, "10.1/x", "a", 1), (21, None, title, 2002), (22, None, title, 2001), (23, None, title, 2001), (24, None, "??", 2000), (25, None, None, 3), (26, "https://doi.org/10.1/x", "b", 1)], schema)
    got = {r.id: (r.match_id, r.confidence) for r in resolve.match_records(records, existing).collect()}
    assert got == {1: (22, "high"), 2: (21, "high"), 3: (20, "exact"), 4: (None, "none"), 5: (None, "none"), 6: (None, "none"), 7: (21, "fuzzy")}
    assert {r.id for r in resolve.new_records(records, existing).collect()} == {5, 6, 7}
    assert {r.id for r in matching.duplicates(records, existing, 0.85, 2).filter("duplicate").collect()} == {1, 2, 3, 4}
    assert {r.id for r in matching.duplicates(records, existing, 0.85).filter("duplicate").collect()} == {1, 2, 3, 4, 6, 7}
    empty = existing.limit(0)
    assert {r.match_id for r in resolve.match_records(records, empty).collect()} == {None} and resolve.new_records(empty, existing).collect() == []


def test_frequent_tokens_after_a_rare_one_are_no_key(spark, tmp_path):
    """Titles of one frequent run of words and a rare one each: no two are similar, and the keys that they share do not grow with
    their number.  Pairs with one word more are all found."""
    run = [f"w{k}" for k in range(8)]
    rows = [(n, [*run, f"rare{n:04}"]) for n in range(400)] + [(1000 + n, [*run, f"rare{n:04}", "more"]) for n in range(0, 400, 2)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    sets, _, _ = resolve._distinct_sets(df, df)
    keyed = resolve._keyed(sets, 0.85)
    met = keyed.groupBy("key", "own", "other").count().alias("x").join(keyed.groupBy("key", F.col("own").alias("other"), F.col("other").alias("own")).count().alias("y"), ["key", "own", "other"])
    assert met.agg(F.sum(F.col("x.count") * F.col("y.count"))).first()[0] < 20 * len(rows)
    got = sorted((r.left_id, r.right_id) for r in resolve.set_similarity_join(df, df, 0.85).collect() if r.left_id < r.right_id)
    assert got == [(n, 1000 + n) for n in range(0, 400, 2)]


@pytest.mark.parametrize("few", [0, 50_000])
def test_sets_of_one_side_do_not_meet(spark, monkeypatch, few):
    """Thirty thousand sets of the left share two tokens with each other and with one set of the right.  Only the pairs with that
    one are made; those among themselves, 450 million, took minutes."""
    monkeypatch.setattr(resolve, "FEW", few, raising=False)
    left = spark.range(30_000).select("id", F.expr("array('a', 'b', concat('n', id))").alias("tokens"))
    right = spark.createDataFrame([(1, ["a", "b", "m"]), (2, ["q"])], "id long, tokens array<string>")
    sets, _, _ = resolve._distinct_sets(left, right)
    began = time.monotonic()
    assert resolve.similar_sets(sets, 0.4).count() == 30_000
    assert time.monotonic() - began < 40
