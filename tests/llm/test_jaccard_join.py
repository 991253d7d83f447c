from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import jaccard_join
from tarn.llm.components import components, hub_join

FIXTURE = "/root/testdata/sf0.001/documents.parquet"


def bare(word: str) -> str:
    return re.sub(r"^[\W_]+|[\W_]+$", "", word.lower())


def shingled(text: str | None) -> frozenset:
    own = [w for w in map(bare, re.findall(r"[^\x20\x09-\x0D]+", text or "")) if w]
    return frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])


def brute(rows: list[tuple]) -> tuple[dict, dict]:
    """class (least key) and number of links of every text."""
    texts = sorted({t for _, t in rows if shingled(t)})
    sets = [shingled(t) for t in texts]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    common = Counter((i, j) for members in by.values() for x, i in enumerate(members) for j in members[x + 1 :])
    links, parent = Counter(), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), n in common.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            links[texts[i]] += 1
            links[texts[j]] += 1
            parent[find(i)] = find(j)
    least = {}
    for key, t in rows:
        if shingled(t):
            root = find(texts.index(t))
            least[root] = min(key, least.get(root, key))
    return {t: least[find(i)] for i, t in enumerate(texts)}, links


def check(spark, rows, params=None):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_join(df, params=params).collect()
    classes, links = brute(rows)
    text = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in rows)
    for r in got:
        assert r.class_id == classes.get(text[r.doc_id], r.doc_id)
        assert r.n_links == links[text[r.doc_id]]


def test_documents_against_brute_force(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(FIXTURE).collect()])


def test_a_large_group_over_many_chunks(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for k in range(80):
        words = list(base)
        words[rng.randrange(120)] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, "one two three four five six") for k in range(50)] + [(2000, None), (2001, ""), (2002, "hello"), (2003, "Hello!")]
    check(spark, rows, jaccard_join.Params(chunk=8))


def test_empty_repeated_and_null_keys(spark):
    schema = "doc_id long, text string, digest string, class_id long"
    df = spark.createDataFrame([(1, "a b c d e f", "x", 9), (1, "a b c d e f", "x", 9), (None, "a b c d e f", "x", 9)], schema)
    assert [(r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df).collect()] == [(1, 0)] * 3
    assert jaccard_join.jaccard_join(df.limit(0)).collect() == []
    assert jaccard_join.drop_near_duplicates(df).columns == df.columns


def test_pruning_follows_the_posterior():
    limits = jaccard_join.Params().needed()
    assert [n for n, _ in limits] == [8, 16, 24, 32, 40, 48, 56, 64]
    assert all(b[1] >= a[1] for a, b in zip(limits, limits[1:], strict=False)) and limits[-1][1] < 64 * 0.8
    rng = np.random.default_rng(1)
    agree = rng.random((200_000, 64)) < 0.8
    kept = np.ones(len(agree), bool)
    for n, m in limits:
        kept &= agree[:, :n].sum(axis=1) >= m
    assert kept.mean() > 0.999


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100)}


def test_pairs_at_the_threshold_share_a_band():
    """20,000 pairs of nine shingles with eight in common; with 16 bands of 4 values, four of them in the mean share none."""
    params = jaccard_join.Params()
    assert params.missed()[0] <= params.tolerance and sum(params.missed()) < 2e-5
    rng = np.random.default_rng(7)
    drawn = rng.integers(0, 1 << 63, (20_000, 10), dtype=np.uint64)
    hashes = np.stack([drawn[:, :9], drawn[:, 1:]], axis=1).reshape(-1)
    keys = jaccard_join.band_keys(jaccard_join.minhashes(hashes, np.arange(0, len(hashes) + 1, 9), params), params)
    assert (keys[::2] == keys[1::2]).any(axis=1).all()


def test_a_key_with_a_copy_and_another_text_keeps_the_other(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "u v w x y z"), (6, "u v w x y z"), (None, "a b c d e f"), (7, None)]
    left = jaccard_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == [("1", "a b c d e f"), ("5", "u v w x y z"), ("7", "")]


def test_rows_not_keys_are_dropped(spark):
    """A key with two texts, equal rows, rows without a key, and columns named like the operator's own."""
    one = [f"w{k}" for k in range(60)]
    near, other = " ".join([*one[:-1], "new"]), " ".join(f"v{k}" for k in range(60))
    rows = [(3, " ".join(one), 1), (5, other, 2), (5, near, 3), (9, "lone text", 4), (9, "lone text", 4), (None, other, 5), (None, "words of no key", 6), (None, "words of no key", 6), (None, None, 7), (8, "", 8), (8, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int").withColumn("_id", F.lit("x"))
    left = jaccard_join.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r.digest for r in left.collect()) == [1, 2, 4, 6, 7, 8, 8]
    assert jaccard_join.drop_near_duplicates(df.limit(0)).collect() == []


def test_drop_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(FIXTURE).collect()]
    classes, _ = brute(rows)
    left = {r.doc_id for r in jaccard_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {k for k, t in rows if classes.get(t, k) == k}


def test_units_are_bounded_by_bytes_too(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(1000)]
    rows = [(k, " ".join([*base[:k], f"new{k}", *base[k:]])) for k in range(12)]
    check(spark, rows, jaccard_join.Params(chunk_bytes=20_000))


def test_hubs_are_joined_without_their_key(spark):
    """Rows of a key with more than its share are not dealt by that key."""
    left = spark.range(5000).selectExpr("if(id % 3 = 0, -1, id) as k", "id as x")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    joined = hub_join(left, right, "k", 5000)
    assert joined.count() == 5000 and joined.filter("k = -1").select("n").distinct().collect()[0].n == 1667
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1000) for k in range(1, 400)]
    assert set(dict(components(spark.createDataFrame(edges, "a long, b long")).collect()).values()) == {0}


def test_rows_that_repeat_are_worked_once(spark, monkeypatch):
    """500 rows of one key and text, and two near copies: each text comes once into a unit."""
    base = [f"word{k}" for k in range(60)]
    rows = [(1, " ".join(base))] * 500 + [(2, " ".join([*base, "more"])), (3, " ".join([*base, "other"])), (None, " ".join([*base, "none"])), (None, " ".join([*base, "none"]))]
    seen, work = [], jaccard_join._worked
    monkeypatch.setattr(jaccard_join, "_worked", lambda units, params: seen.append(units.groupBy("bucket", "low", "high", "digest").count().filter("count > 1").count()) or work(units, params))
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert seen == [0]
    assert len(got) == len(rows) and {r.n_links for r in got} == {3} and {r.class_id for r in got} == {1}
