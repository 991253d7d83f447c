from __future__ import annotations

import bisect
import itertools
import zlib
from collections import Counter, defaultdict

from tarn.llm import hilbert_shards, queries

SF = "/root/testdata/sf0.001"


def test_neighbours_on_the_curve_touch():
    for bits, dims in ((3, 2), (2, 3), (4, 3)):
        cells = list(itertools.product(range(1 << bits), repeat=dims))
        at = {hilbert_shards.hilbert_index(list(c), bits): c for c in cells}
        assert sorted(at) == list(range(len(cells)))
        assert all(sum(abs(x - y) for x, y in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(cells) - 1))


def test_query_keeps_the_rows_law(spark):
    rows = queries.op8_hilbert_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ends = [(min(r.curve_index for r in rows if r.shard == s), max(r.curve_index for r in rows if r.shard == s)) for s in range(16)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_nulls_ties_repeats_and_extra_columns(spark):
    data = [(None, None, None, "x")] * 40 + [(1, "a", 5, "y")] * 30 + [(k, "b", k, "z") for k in range(30)]
    df = spark.createDataFrame(data, "doc_id long, source string, n_chars long, shard_hint string")
    rows = hilbert_shards.shard(df, "doc_id", ["source", "n_chars"], shards=7).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == 100 and max(counts.values()) - min(counts.values()) <= 1
    assert len({(r.shard, r.slot) for r in rows}) == 100
    assert sorted(Counter(r.shard_hint for r in rows).items()) == [("x", 40), ("y", 30), ("z", 30)]


def test_empty_table_and_fewer_rows_than_shards(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n_chars long")
    assert hilbert_shards.shard(df, "doc_id", ["source", "n_chars"]).collect() == []
    few = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "doc_id long, source string, n_chars long")
    assert len({r.shard for r in hilbert_shards.shard(few, "doc_id", ["source", "n_chars"]).collect()}) == 2


def brute_cuts(values, cells=16):
    """Cut k is the least value up to which there are k / cells of the rows."""
    known = sorted(v for v in values if v is not None)
    return sorted({known[-(-k * len(known) // cells) - 1] for k in range(1, cells)}) if known else []


def test_query_against_brute_force(spark):
    """Sizes, checksums, cells, places on the curve, shards and slots of every row."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    dims = ["source", "n_chars", "lang"]
    cuts = {d: brute_cuts([getattr(r, d) for r in docs.values()]) for d in dims}
    cell = lambda r: [bisect.bisect_left(cuts[d], getattr(r, d)) if getattr(r, d) is not None else 0 for d in dims]
    rows = queries.op8_hilbert_shards(spark, SF).collect()
    for r in rows:
        data = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.curve_index == hilbert_shards.hilbert_index(cell(docs[r.doc_id]), 4)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve_index for r in order] == sorted(r.curve_index for r in rows)
    assert [r.shard for r in order] == [k * 16 // len(rows) for k in range(len(rows))]
    assert [r.slot for r in order] == [k - next(i for i in range(len(rows)) if i * 16 // len(rows) == k * 16 // len(rows)) for k in range(len(rows))]


def test_strings_with_a_long_common_head_are_told_apart(spark):
    urls = [f"https://one-and-the-same-host.example/path/{k:03}" for k in range(64)]
    df = spark.createDataFrame([(k * 10 + j, u) for k, u in enumerate(urls) for j in range(3)] + [(9999, None)], "doc_id long, url string")
    assert hilbert_shards.string_cuts(df, "url", 16) == brute_cuts([u for u in urls for _ in range(3)])
    rows = hilbert_shards.shard(df, "doc_id", ["url"], shards=8).collect()
    assert len({r.curve_index for r in rows}) == 16
    ends = [(min(r.url for r in rows if r.shard == s and r.url), max(r.url for r in rows if r.shard == s and r.url)) for s in range(8)]
    assert sum(a <= urls[20] <= b for a, b in ends) <= 2
    hot = spark.createDataFrame([(k, "same" if k % 3 else f"v{k}") for k in range(90)], "doc_id long, url string")
    assert hilbert_shards.string_cuts(hot, "url", 4) == brute_cuts(["same" if k % 3 else f"v{k}" for k in range(90)], 4)


def test_files_are_pruned_in_every_dimension(spark, tmp_path):
    """Of 64 files a filter on one dimension must open few; of files in key order it would open all."""
    df = spark.range(4096).selectExpr("id as doc_id", "pmod(xxhash64(id), 1000) as a", "cast(pmod(xxhash64(id, 1), 1000) as string) as b")
    placed = hilbert_shards.shard(df, "doc_id", ["a", "b"], shards=16)
    hilbert_shards.write_shards(placed, f"{tmp_path}/shards", 64)
    back = spark.read.parquet(f"{tmp_path}/shards").selectExpr("*", "input_file_name() as f").collect()
    assert len(back) == 4096 and len({r.f for r in back}) >= 60
    files = defaultdict(list)
    for r in back:
        files[r.f].append(r)
    for column, value in (("a", 500), ("b", "555")):
        opened = sum(min(getattr(r, column) for r in rows) <= value <= max(getattr(r, column) for r in rows) for rows in files.values())
        assert opened <= len(files) / 3


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(k, f"s{k}", "old", "old", "old", "kept") for k in range(20)], "doc_id long, source string, shard string, slot string, curve_index string, _h string")
    out = hilbert_shards.shard(df, "doc_id", ["source"], shards=4)
    assert out.columns == ["doc_id", "source", "_h", "curve_index", "shard", "slot"]
    assert {(r.shard, r.slot) for r in out.collect()} == {(s, k) for s in range(4) for k in range(5)} and {r._h for r in out.collect()} == {"kept"}
