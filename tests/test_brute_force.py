"""Operators that SQL does not express, held against plain versions."""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import FOLDER, connection
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from tarn.functions import sections
from tarn.functions import text as X
from tarn.operators import graph, search, sync, vectors
from tarn.plans.registry import QUERIES


def greedy(rows, threshold):
    """(group, key, vector) in key order within each group, by the definition."""
    out, clusters = {}, defaultdict(list)
    for group, key, v in sorted(rows, key=lambda r: (r[0], r[1])):
        v = np.array(v, float)
        own = clusters[group]
        s = [float(c @ v / (np.linalg.norm(c) * np.linalg.norm(v))) for c in own]
        if s and max(s) >= threshold:
            own[int(np.argmax(s))] += v
            out[key] = int(np.argmax(s))
        else:
            own.append(v.copy())
            out[key] = len(own) - 1
    return out


def test_greedy_clusters(spark):
    rows = connection("/root/testdata/sf0.01").execute("SELECT label, vec_id, embedding FROM embeddings").fetchall()
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    for threshold in (0.1, 0.3):
        want = greedy(rows, threshold)
        assert {r.vec_id: r.cluster for r in vectors.greedy_clusters(v, "label", threshold).collect()} == want
        assert 1 < len(set(want.values()))


def test_threshold_sweep(spark):
    rows = connection().execute("SELECT 0, vec_id, embedding FROM embeddings").fetchall()
    for r in QUERIES["vec08_threshold_sweep"](spark, FOLDER).collect():
        sizes = Counter(greedy(rows, r.threshold).values())
        assert (r.clusters, r.singles, r.largest) == (len(sizes), sum(n == 1 for n in sizes.values()), max(sizes.values()))


def test_neighbours_of_a_query_set(spark):
    v = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in v.collect()}
    unit = {k: x / np.linalg.norm(x) for k, x in rows.items()}
    got = defaultdict(list)
    for r in vectors.nearest_each(v.filter("vec_id < 9"), v, 4, -1.0).orderBy("query", "rn").collect():
        got[r["query"]].append(r.vec_id)
    for q in range(9):
        want = sorted((k for k in rows if k != q), key=lambda k: (-round(float(unit[q] @ unit[k]), 9), k))[:4]
        assert got[q] == want


def plain_labels(edges, turns):
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    label = {n: n for n in near}
    for turn in turns:
        new, gains = dict(label), False
        for n, around in near.items():
            votes = Counter()
            for m, w in around:
                votes[label[m]] += w
            best = min(votes, key=lambda c: (-votes[c], c))
            if votes[best] > votes[label[n]]:
                gains = True
                if n in turn:
                    new[n] = best
        if not gains:
            return label
        label = new
    raise AssertionError("more rounds than turns")


def test_communities_and_their_summary(spark):
    rows = QUERIES["joi06_pairs"](spark, FOLDER).collect()
    edges = [(r.a, r.b, r.weight) for r in rows]
    if len(edges) < 20:
        edges = [(a, b, 1 + (a * b) % 3) for a in range(40) for b in range(a + 1, 40) if (a // 10 == b // 10 and (a + b) % 3) or a + b == 39]
    df = spark.createDataFrame(edges, "a long, b long, weight long")
    nodes = sorted({n for e in edges for n in e[:2]})
    keyed = spark.createDataFrame([(n,) for n in nodes], "node long")
    turns = [{r.node for r in keyed.filter(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0).collect()} for k in range(40)]
    labels = graph.label_propagation(df)
    want = plain_labels(edges, turns)
    assert {r.node: r.community for r in labels.collect()} == want
    degree = Counter(n for e in edges for n in e[:2])
    names = spark.createDataFrame([(n, f"t{n % 3}", f"n{n}", degree[n]) for n in nodes], "node long, type string, name string, degree long")
    members = defaultdict(list)
    for n, c in want.items():
        members[c].append(n)
    got = {r.community: r for r in graph.community_summary(labels, names).collect()}
    assert set(got) == {c for c, m in members.items() if len(m) >= 3}
    for c, r in got.items():
        order = sorted(members[c], key=lambda n: (-degree[n], n))
        assert r.members == len(order) and r.type_counts == dict(Counter(f"t{n % 3}" for n in order))
        assert r.label == ", ".join(f"n{n}" for n in order[:8])
        assert r.diverse == ", ".join(f"n{n}" for t in range(3) for n in [n for n in order if n % 3 == t][:3])


def test_modularity(spark):
    edges = [(0, 1, 2), (1, 2, 1), (3, 4, 3), (2, 3, 1)]
    label = {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    m = sum(w for *_, w in edges)
    strength = Counter()
    for a, b, w in edges:
        strength[label[a]] += w
        strength[label[b]] += w
    want = sum(w for a, b, w in edges if label[a] == label[b]) / m - sum((s / (2 * m)) ** 2 for s in strength.values())
    got = graph.modularity(spark.createDataFrame(edges, "a long, b long, weight long"), spark.createDataFrame(list(label.items()), "node long, community long")).first()[0]
    assert got == pytest.approx(want)


def test_pairs_of_a_hub_are_those_of_the_plain_join(spark, monkeypatch):
    members = spark.createDataFrame([(1, k) for k in range(60)] + [(2, k) for k in range(5)] + [(2, 3), (None, 4), (3, None)], "item long, n long")
    plain = sorted(map(tuple, graph.pair_counts(members, ["item"], "n").collect()))
    monkeypatch.setattr(graph, "HUB", 7)
    assert sorted(map(tuple, graph.pair_counts(members, ["item"], "n").collect())) == plain and len(plain) == 60 * 59 // 2


@pytest.mark.parametrize("hub, most, at_least", [(2000, 64, 2), (7, 3, 2), (7, 64, 3), (2000, 1, 1)])
def test_pairs_by_two_items_and_by_classes(spark, monkeypatch, hub, most, at_least):
    """Few items a node and many nodes an item; nodes alike; nulls; large nodes beside small ones."""
    monkeypatch.setattr(graph, "HUB", hub)
    monkeypatch.setattr(graph, "SET", most)
    draw = random.Random(5)
    rows = [(draw.choice("xyz"), draw.randrange(25), n) for n in range(150) for _ in range(draw.randint(1, 4))]
    rows += [("x", k, n) for n in (200, 201, 202, 203) for k in range(9)] + [("x", None, 300), ("x", None, 301), ("y", None, 300), ("y", None, 301), ("x", 1, None)]
    items = {}
    for s, k, n in rows:
        if k is not None and n is not None:
            items.setdefault(n, set()).add((s, k))
    want = sorted((a, b, len(items[a] & items[b])) for a in items for b in items if a < b and len(items[a] & items[b]) >= at_least)
    members = spark.createDataFrame(rows, "s string, k long, n long")
    assert sorted(map(tuple, graph.pair_counts(members, ["s", "k"], "n", at_least).collect())) == want
    assert sorted(map(tuple, graph.pair_counts_by_class(members, ["s", "k"], "n", at_least).collect())) == want
    even, odd = members.filter("n % 2 = 0"), members.filter("n % 2 = 1")
    across = sorted((a, b, len(items[a] & items[b])) for a in items for b in items if a % 2 == 0 and b % 2 == 1 and len(items[a] & items[b]) >= at_least)
    assert sorted(map(tuple, graph.shared_counts(even, odd, ["s", "k"], "n", at_least).collect())) == across


def test_pairs_of_few_items_are_not_made_item_by_item(spark, monkeypatch):
    """300 nodes of one item have 44,850 pairs; those that share two items are three, and no more rows are counted."""
    counted = []
    summed = graph._summed
    monkeypatch.setattr(graph, "_summed", lambda met: counted.append(met[1]) or summed(met))
    rows = [(0, n) for n in range(300)] + [(1000 + n, n) for n in range(300)] + [(5000, 1), (5000, 2), (5000, 3)]
    got = graph.pair_counts(spark.createDataFrame(rows, "item long, n long"), ["item"], "n", 2).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 2), (1, 3, 2), (2, 3, 2)] and sum(counted) < 100


def test_article_text(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("html").collect()
    odd = ["<p>a&amp;lt;b</p><script>x<y</script>", "<article>one<br/>two</p>three</article> outside", "", "no tags &nbsp; &quot;q&quot;"]

    def plain(page):
        body = re.search(r"(?is)<article[^>]*>(.*?)</article>", page)
        body = body[1] if body and body[1] else page
        body = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", "", body)
        body = re.sub(r"(?i)</p>", "\n\n", re.sub(r"(?i)<br\s*/?>", "\n", body))
        body = re.sub("<[^>]*>", "", body)
        for name in ("nbsp", "lt", "gt", "quot", "#39", "rsquo", "amp"):
            body = body.replace(f"&{name};", html.unescape(f"&{name};").replace("\xa0", " "))
        return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", body)).strip(" ")

    texts = [r.html for r in pages] + odd
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, html string")
    for r in df.select("k", X.article_text(F.col("html")).alias("t")).collect():
        assert r.t == plain(texts[r.k])


def test_snippets(spark):
    texts = ["word " * 60 + "Trash, here " + "more " * 60, "trash at once", "w " * 100 + "TRASH", "short trash text", "x " * 20 + "trash " + "y " * 3]

    def plain(text):
        words = text.split()
        hits = [re.sub(r"[\W_]", "", w.lower()) == "trash" for w in words]
        first = hits.index(True) + 1
        begin = max(1, min(first - 15, len(words) - 15 + 1))
        return " ".join(f"<mark>{w}</mark>" if h else w for w, h in list(zip(words, hits, strict=True))[begin - 1 : begin + 29])

    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string")
    for r in df.select("k", search.snippet(F.col("text"), ["Trash"]).alias("s")).collect():
        assert r.s == plain(texts[r.k])
        assert min(15, len(texts[r.k].split())) <= len(r.s.split()) <= 30


def test_stratified_samples(spark):
    items = spark.createDataFrame([(k, "a" if k < 900 else "b" if k < 990 else f"c{k}") for k in range(1000)], "k long, s string")
    for total in (50, 200, 2000):
        sizes = Counter(r.s for r in items.collect())
        share = {s: max(2, min(int(total * n / 1000 + 0.5), n)) for s, n in sizes.items()}
        if sum(share.values()) > total:
            share = {s: max(1, x * total // sum(share.values())) for s, x in share.items()}
        got = sync.stratified(items, "s", total, "k")
        counts = Counter(r.s for r in got.collect())
        assert counts == {s: min(n, sizes[s]) for s, n in (share if total < 1000 else sizes).items()}
        assert sorted(r.k for r in got.collect()) == sorted(r.k for r in sync.stratified(items.repartition(7), "s", total, "k").collect())


def test_chunks_end_at_paragraphs(spark):
    """Windows cover the text, overlap as asked, and end at the last paragraph break in their last two fifths."""
    texts = ["x" * 2500, "".join(f"{'word ' * 30}\n\n" for _ in range(40)), "", None, "y" * 1000, "a" * 700 + "\n\n" + "b" * 700 + "\n\n" + "c" * 100]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    for r in df.select("k", sections.paragraph_chunks(1000, 100)(F.col("t")).alias("c"), sections.paragraph_chunks(1000, 100, 2)(F.col("t")).alias("two")).collect():
        text = texts[r.k]
        if text is None:
            assert r.c is None
            continue
        want, at = [], 0
        while True:
            end = at + 1000
            if end >= len(text):
                want.append(text[at:])
                break
            breaks = [m.start() for m in re.finditer("(?=\n\n)", text) if at + 600 < m.start() <= end]
            end = max(breaks, default=end)
            want.append(text[at:end])
            at = end - 100
        assert r.c == want and r.two == want[:2]
