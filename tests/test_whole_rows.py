"""Queries that take every row, where an older one of the same kind takes a range of ids or a prefix."""

from __future__ import annotations

from oracle import FOLDER, connection

from tarn.plans.registry import QUERIES


def test_links_of_every_author(spark):
    """Every author with two items or more has a link; links of three authors cannot cover them."""
    rows = QUERIES["win05_strongest_link"](spark, FOLDER).collect()
    have = {(r.source_item, r.target_item) for r in rows}
    assert len(have) == len(rows)
    items: dict[int, set[int]] = {}
    for author, item in connection().execute("SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem").fetchall():
        items.setdefault(author, set()).add(item)
    assert len(items) > 3
    for own in items.values():
        order = sorted(own)
        assert all(pair in have for pair in zip(order[1:], order, strict=False))


def test_existing_rows_of_any_id(spark):
    con = connection()
    have = {n for (n,) in con.execute("SELECT s_nationkey FROM supplier WHERE s_acctbal < 0").fetchall()}
    want = {n for (n,) in con.execute("SELECT DISTINCT c_nationkey FROM customer").fetchall()} - have
    assert {r.id for r in QUERIES["snk05_insert_if_absent"](spark, FOLDER).collect()} == want
