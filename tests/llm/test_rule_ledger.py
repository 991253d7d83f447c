from __future__ import annotations

import re
from collections import Counter

from oracle import FOLDER, assert_same

from tarn.llm import queries, rule_ledger, sql

SCHEMA = "doc_id long, text string, n_words string"


def brute(text: str | None) -> dict[str, int]:
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + step for i, w in enumerate(windows) if w in often for step in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(own), "word_chars": sum(map(len, own)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def test_query_against_sql(spark):
    assert_same(queries.op4_rule_ledger(spark, FOLDER), sql.OP4)


def test_measures_against_brute_force(spark):
    texts = [None, "", " \t\n", "a", "a b c a b c", "x\nx\n\n x\nx ", "é " * 3000, "word " * 200_000, "a\x0bb\x1fc\xa0d e", "# # #\n# # #", "A B\r\nA B\r\n"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(3, "a", "clash")], SCHEMA)
    rows = rule_ledger.ledger(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = brute(texts[r.doc_id])
        assert {k: r[k] for k in want} == want


def test_ablations_agree_with_the_rows(spark):
    entries = rule_ledger.ledger(spark.read.parquet(f"{FOLDER}/documents.parquet")).cache()
    bits = [r.fail_bits for r in entries.collect()]
    policy = rule_ledger.POLICIES["v2"]
    known = {r.name: 1 << r.bit for r in rule_ledger.RULES}
    mask = sum(known[n] for n in policy.rules)
    for row in rule_ledger.ablations(entries, policy).collect():
        flag = known[row.rule]
        assert row.n_failed == sum(bool(b & flag) for b in bits)
        assert row.n_failed_alone == sum(b & mask == flag for b in bits)
        assert row.n_kept_without == sum(not b & mask & ~flag for b in bits)


def test_filter_keeps_columns_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "word number seven and more " * 3, "a"), (2, None, "b")], "doc_id long, text string, lang string")
    assert rule_ledger.filter_documents(df, rule_ledger.POLICIES["v2"]).columns == df.columns
    assert rule_ledger.ledger(df.limit(0)).collect() == []


def test_filter_with_clashing_columns(spark):
    """Every measurement, the bits and the verdict are also names of columns, which come out as they went in."""
    names = ["doc_id", "text", *rule_ledger.MEASURES, "fail_bits", "kept", "policy_version", "_text", "_0_"]
    good = " ".join(f"word{k}x" for k in range(80))
    rows = [(1, good, *["a"] * (len(names) - 2)), (1, good, *["b"] * (len(names) - 2)), (2, "short", *["c"] * (len(names) - 2)), (None, None, *[None] * (len(names) - 2))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    kept = rule_ledger.filter_documents(df, rule_ledger.POLICIES["v2"])
    assert kept.schema == df.schema and sorted(map(tuple, kept.collect())) == rows[:2]
