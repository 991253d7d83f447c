from __future__ import annotations

import re
from itertools import permutations

from oracle import FOLDER, assert_same

from tarn.llm import filter_audit, queries, sql

DOCS = "doc_id long, text string, source string, bits string, n string, _part string, _sha string"
LABELS = "doc_id long, quality int, toxic int, n string"


def failures(rows: list[tuple]) -> list[str]:
    least: dict[str, int] = {}
    for key, text, *_ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    found = []
    for key, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", text)), "E": key is not None and key > least[text]}
        found.append("".join(f for f in "ABCDE" if fails[f]))
    return found


def brute(rows: list[tuple], labels: list[tuple]) -> set[tuple]:
    """Applies the filters in every order to the rows themselves."""
    one = lambda c: {r[0] for r in labels if r[c] == 1 and r[0] is not None}
    good, toxic = one(1), one(2)
    fails = failures(rows)
    out, removed_by = [], {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                removed_by[part, x] = removed_by.get((part, x), 0) + len(gone)
                out.append((part, "".join(order), step + 1, len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == x for _, f in own), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)))
    return {(*o, removed_by[o[0], o[1][o[2] - 1]]) for o in out}


def made() -> tuple[list[tuple], list[tuple]]:
    fresh = lambda k: " ".join(f"w{k}x{i}" for i in range(210))
    texts = [None, "", "", fresh(1), fresh(1), fresh(1), fresh(2) + " #", "SHOUT " * 300, "word " * 250 + "$", fresh(3) + "É" * 40, fresh(4) + " " + "A" * 80, "a\x0bb\x1fc\xa0d", fresh(5), "long " * 60_000]
    rows = [(i % 11, t, [None, "", "a", "b"][i % 4], "x", "y", "z", "q") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, fresh(1), "a", "", "", "", ""), (None, fresh(5), "b", "", "", "", ""), (90, fresh(5), None, "", "", "", "")]
    labels = [(k, k % 2, int(k % 3 == 0), "n") for k in range(9)] + [(2, 1, None, "n"), (4, None, 1, "n"), (None, 1, 1, "n"), (500, 1, 1, "n")]
    return rows, labels


def test_query_against_sql(spark):
    assert_same(queries.op11_filter_audit(spark, FOLDER), sql.OP11)


def test_against_every_order_applied(spark):
    """Nulls in all columns, repeated keys and rows, equal texts under one key, clashing names, a very long text."""
    rows, labels = made()
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 3 * 600
    assert {tuple(r) for r in got} == brute(rows, labels)


def test_one_text_almost_everywhere(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 10 = 0, concat('t', id), 'same') as text", "if(id % 3 = 0, 'hot', 'rest') as source")
    found = filter_audit.audit(docs, spark.createDataFrame([], LABELS)).filter("filter_order = 'EABCD' and step = 1")
    assert {(r.part, r.kept, r.removed) for r in found.collect()} == {("hot", 167, 1500), ("rest", 334, 2999)}


def test_empty_table(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1, "n")], LABELS)
    assert filter_audit.audit(docs, labels).collect() == []
