from __future__ import annotations

import math
import re
from collections import Counter
from decimal import Decimal

import public_tokenizers
import pytest
from test_jaccard_join import brute as brute_classes
from test_learned import brute_spans
from test_rule_ledger import brute as brute_measures
from tokenizers import Tokenizer

import corpus_pipeline
from tarn.llm import decontaminate

SF = "/root/testdata/sf0.001"


def norm(text: str | None) -> str:
    return " ".join(decontaminate.words(text))


def test_leaks_against_whole_items(spark):
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    texts = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    whole = {(d, i.item_id) for i in items.collect() if norm(i.text) for d, t in texts if norm(i.text) in t}
    assert whole and whole <= found


def test_block_max_wand_returns_all_above_the_threshold(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    params = decontaminate.Params(threshold=0.15, postings=4)
    index = decontaminate.Index(items, params)
    for (text,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        terms = sorted({index.terms[w] for w in decontaminate.words(text) if w in index.terms})
        scores = [0.0] * len(items)
        for t in terms:
            for i, x in zip(index.items[t], index.impacts[t], strict=True):
                scores[i] += x
        want = {i for i, s in enumerate(scores) if s >= params.threshold}
        assert {i for i, _ in index.search(terms)} == want


def test_leaks_do_not_depend_on_blocks_of_items(spark):
    """Edited copies score near the threshold, which a block's own term frequencies and lengths would move."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = []
    for r in items.collect():
        own = r.text.split()
        rows += [(10 * r.item_id + k, " ".join(["so"] * 40 + [w for j, w in enumerate(own) if j % 7 < 7 - k] + ["then"] * 40)) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda n: sorted((r.doc_id, r.item_id, r.passage_start, round(r.score, 9)) for r in decontaminate.find_leaks(docs, items, params=decontaminate.Params(block_items=n)).collect())
    whole = found(20_000)
    assert any(r[3] < 0.99 for r in whole)
    assert found(9) == whole


def test_defined_leaks(spark):
    item = "what is the colour of the clear sky at noon answer: it is blue as deep water"
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " * 500 + item + " then " * 500, 0.0), (2, None, 0.0), (None, item, 0.0), (4, "what is the colour of a bird", 0.0)], "doc_id long, text string, score double")
    rows = decontaminate.find_leaks(docs, items).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in rows) == [("1", 1), ("1", 1), ("None", 1), ("None", 1)]
    assert decontaminate.find_leaks(docs, items.limit(0)).collect() == [] and decontaminate.find_leaks(docs.limit(0), items).collect() == []
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(docs, items).collect()) == ["2", "4"]


def plain_leaks(docs, items, params):
    """Every item against every passage, scored in full by its BM25 formula."""
    split = {k: decontaminate.parts(t) for k, t in items}
    counts = {k: Counter(q + a) for k, (q, a) in split.items()}
    counts = {k: c for k, c in counts.items() if c}
    frequency = Counter(t for c in counts.values() for t in c)
    n, average = len(items), max(1.0, sum(c.total() for c in counts.values()) / max(1, len(items)))
    longest = max(c.total() for c in counts.values())

    def impacts(c):
        norm = params.k1 * (1 - params.b + params.b * c.total() / average)
        return {t: math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * m * (params.k1 + 1) / (m + norm) for t, m in c.items()}

    known = {k: impacts(c) for k, c in counts.items()}
    out = {}
    for doc, text in docs:
        own = decontaminate.words(text)
        for low in range(0, max(1, len(own) - longest), longest):
            passage = own[low : low + 2 * longest]
            have = set(passage)
            for k, x in known.items():
                score = sum(v for t, v in x.items() if t in have) / sum(x.values())
                if score < params.threshold - 1e-9:
                    continue
                shares = []
                for part in split[k]:
                    wanted = decontaminate.grams(part, params.gram) or decontaminate.grams(split[k][0] or split[k][1], params.gram)
                    size = len(next(iter(wanted)))
                    shares.append(len(wanted & decontaminate.grams(passage, size)) / len(wanted))
                if min(shares) >= params.overlap:
                    out[doc, k] = max(out.get((doc, k), (0,)), (score, *shares))
    return out


def test_whole_query_against_scoring_every_pair(spark):
    """Edited copies near the threshold and parts of items, among clean documents: the same hits with the same numbers."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for k, t in items:
        own = t.split()
        for j, keep in enumerate((2, 3, 4, 6, 9)):
            docs.append((100_000 + 10 * k + j, " ".join(["so"] * (7 * j) + [w for i, w in enumerate(own) if i % keep] + ["then"] * 50)))
        docs.append((100_000 + 10 * k + 6, " ".join(own[: len(own) // 2])))
    params = decontaminate.Params()
    want = plain_leaks(docs, items, params)
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in found}
    assert got.keys() == want.keys() and any(v[0] < 0.9 for v in want.values())
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_keys_and_columns_of_any_name_and_type(spark):
    item = "what is the colour of the clear sky at noon answer: it is blue as deep water"
    items = spark.createDataFrame([(Decimal("1.5"), item)], "doc_id decimal(3,1), body string")
    docs = spark.createDataFrame([("x", item, 1, 2), ("y", "clean", 3, 4), (None, item, 5, 6)], "doc_id string, text string, score int, _text int")
    rows = decontaminate.find_leaks(docs, items, item_key="doc_id", item_text="body").collect()
    assert sorted((str(r.doc_id), r.item_doc_id) for r in rows) == [("None", Decimal("1.5")), ("x", Decimal("1.5"))]
    left = decontaminate.drop_contaminated(docs, items, item_key="doc_id", item_text="body", params=decontaminate.Params(block_items=1))
    assert left.schema == docs.schema and [tuple(r) for r in left.collect()] == [("y", "clean", 3, 4)]
    twice = items.unionByName(items.selectExpr("cast(2 as decimal(3,1)) as doc_id", "'quite another question of many words answer: and its own answer here' as body"))
    left = decontaminate.drop_contaminated(docs, twice, item_key="doc_id", item_text="body", params=decontaminate.Params(block_items=1))
    assert [r.doc_id for r in left.collect()] == ["y"]


def test_pipeline_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    def kept(text):
        m, lines = brute_measures(text), sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        upper, lower, n = len(re.findall("[A-Z]", text or "")), len(re.findall("[a-z]", text or "")), m["n_words"]
        return n >= 50 and 100 * m["n_repeat_words"] <= 50 * n and 10 * m["n_symbols"] <= n and 100 * m["n_dup_lines"] <= 40 * lines and upper <= lower and 2 * n <= m["word_chars"] <= 15 * n

    left = {k: t for k, t in docs.items() if kept(t)}
    classes, _ = brute_classes(list(left.items()))
    left = {k: t for k, t in left.items() if classes.get(t, k) == k}
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if norm(r.text)]
    left = {k: t for k, t in left.items() if not any(i in norm(t) for i in items)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(left)
    for k, t in left.items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(t)]
        out, done = [], 0
        for a, b in spans:
            if a >= done:
                out += [t[done:a], "[SECRET]"]
            done = max(done, b)
        assert list(got[k].ids) == library.encode("".join([*out, t[done:]]), add_special_tokens=False).ids


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_odd_rows_and_none(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like the operators' own."""
    good = " ".join(f"word{k} and so{k}" for k in range(60))
    long = " ".join(f"w{k}x" for k in range(150_000))
    names = ["doc_id", "text", "lang", "source", "n_chars", "n_words", "kept", "fail_bits", "digest", "_id", "_text", "score", "found", "class_id", "spans"]
    rows = [(1, good), (1, good), (None, None), (None, good), (2, ""), (3, f"{good} token=abcdef99 tail"), (4, long)]
    full = [(k, t, "en" if k else None, None, len(t) if t else None, *["own"] * (len(names) - 5)) for k, t in rows]
    df = spark.createDataFrame(full, ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).collect() == []
        out = stage(spark, df, SF)
        left[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=str) if name != "BPE encoding" else out.collect()
        if name != "BPE encoding":
            assert out.schema == df.schema
    key = lambda found: sorted(found, key=str)
    assert left["quality rules"] == key([(1, good), (1, good), (None, good), (3, rows[5][1]), (4, long)])
    assert left["n-gram Jaccard join"] == key([(1, good), (None, None), (2, ""), (4, long)])  # the third text is a near copy of the first
    assert left["benchmark decontamination"] == key(rows)
    assert left["secret scans"] == key([(k, t.replace("token=abcdef99", "[SECRET]") if t else t) for k, t in rows])
    assert sorted(r.n_tokens for r in left["BPE encoding"])[:2] == [0, 0] and len(left["BPE encoding"]) == len(rows)
