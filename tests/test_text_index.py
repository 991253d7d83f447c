from __future__ import annotations

import math
import re
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from oracle import FOLDER
from pyspark.sql import functions as F

from tarn.functions import stemmer
from tarn.functions.stemmer import stem
from tarn.operators import search, text_index
from tarn.plans import searching  # noqa: F401  registers its queries
from tarn.plans.registry import QUERIES
from tarn.sources import versions

# Pairs of the stemmer's published sample vocabulary.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori
console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack
knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel
kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock
knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()

DOCS = [
    (1, "Running hills", "The runner ran over the hills and was running down"),
    (2, "A hill", "nothing else; the hill of the hills"),
    (3, None, "meadow plants on a hill, " + "filler " * 150 + "running"),
    (4, "", ""),
    (5, "Été", "the rivers: river, RIVER and rivers' river"),
    (6, None, None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, body string")


def places(rows) -> dict:
    """(id, term) to (place, weight), by the words themselves."""
    out = defaultdict(list)
    for id, *texts in rows:
        at = 0
        for text, w in zip(texts, (1.0, 0.1), strict=True):
            for word in re.findall(r"[^\W_]+", (text or "").lower()):
                at += 1
                if word not in search.STOP_WORDS:
                    out[id, stem(word)].append((at, w))
    return out


def rank(rows, terms: list[str]) -> dict:
    known, out = places(rows), {}
    for id in {r[0] for r in rows}:
        lists = [known.get((id, t)) for t in terms]
        if not all(lists):
            continue
        if len(terms) == 1:
            ws = [w for _, w in lists[0]]
            j = ws.index(max(ws))
            out[id] = (max(ws) + sum(w / (i + 1) ** 2 for i, w in enumerate(ws) if i != j)) / 1.64493406685
            continue
        left = 1.0
        for i in range(len(terms)):
            for k in range(i):
                for x, v in lists[i]:
                    for y, w in lists[k]:
                        d = abs(x - y)
                        left *= 1 - math.sqrt(v * w * (1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) if d <= 100 else 1e-30))
        out[id] = 1 - left
    return out


def check(index, rows) -> None:
    for query, terms in (("the HILLS", ["hill"]), ("running", ["run"]), ("hill running", ["hill", "run"]), ("rivers of", ["river"]), ("hills run down over", ["hill", "run"]), ("nowhere", ["nowher"])):
        want = rank(rows, terms)
        assert {r.id: r.rank for r in index.ranked(query).collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_stems_of_the_sample():
    assert [stem(w) for w in SAMPLE[::2]] == SAMPLE[1::2]
    assert [stem(w) for w in ("generously", "ties", "cries", "gas", "hoping", "hopping", "relational", "skies", "by", "")] == ["generous", "tie", "cri", "gas", "hope", "hop", "relat", "sky", "by", ""]


def test_additions_deletions_and_a_merge(spark, tmp_path):
    index = text_index.TextIndex.create(spark, str(tmp_path / "index"), {"A": "title", "D": "body"}, buckets=3)
    assert index.ranked("hill").collect() == [] and index.any_of(["hill"]).collect() == [] and index.merge().postings() is None
    index = text_index.TextIndex.open(spark, str(tmp_path / "index"))
    index = index.append(frame(spark, DOCS[:3]), "id")
    index = index.append(frame(spark, [*DOCS[3:], (None, "hill", "hill")]), "id")
    check(index, DOCS)
    gone = index.delete(spark.createDataFrame([(1,), (77,), (None,)], "x long"))
    check(gone, DOCS[1:])
    check(index, DOCS)  # an index opened before goes on with what it has seen
    again = text_index.TextIndex.open(spark, index.folder).append(frame(spark, [(1, "Hill", "new run")]), "id")
    now = [*DOCS[1:], (1, "Hill", "new run")]
    check(again, now)
    merged = again.merge()
    check(text_index.TextIndex.open(spark, index.folder), now)
    assert len(merged.state["segments"]) == 1 and merged.state["deleted"] == []
    with pytest.raises(versions.Conflict):
        index.append(frame(spark, DOCS), "id")  # another writer was faster


def test_phrases_and_alternatives(spark, tmp_path):
    index = text_index.TextIndex.create(spark, str(tmp_path / "i"), {"A": "title", "D": "body"}).append(frame(spark, DOCS), "id")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(index.phrase("plant on the hills")) == [3] and ids(index.phrase("plants hill")) == []
    assert ids(index.phrase("hill of the hill")) == [2] and ids(index.phrase("the")) == [] and ids(index.phrase("river river")) == [5]
    assert ids(index.any_of(["runs & hill", "river", "& !"])) == [1, 3, 5]
    assert index.terms("The Hills, hill & running") == ("hill", "run")


def test_kept_index_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, DOCS[:2]).write.parquet(path)
    fields = {"A": "title", "D": "body"}
    first = text_index.kept_index(spark.read.parquet(path), "id", fields)
    again = text_index.kept_index(spark.read.parquet(path), "id", fields)
    assert (first.folder, first.number) == (again.folder, again.number)
    frame(spark, DOCS[2:]).write.mode("append").parquet(path)
    check(text_index.kept_index(spark.read.parquet(path), "id", fields), DOCS)
    assert text_index.kept_index(spark.read.parquet(path).filter("id > 3"), "id", fields).folder != first.folder


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "set")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, kind string")
    marks = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "item long, note string")
    versions.replace(spark, folder, {"items": items, "marks": marks})

    def refuse(tables):
        if tables["marks"].count() < 2:
            raise ValueError("shrunk")

    broken = marks.withColumn("note", F.when(F.col("item") == 3, F.raise_error(F.lit("cut off"))).otherwise(F.col("note")))
    for tables, guard in (({"items": items.limit(0), "marks": broken}, None), ({"items": items.limit(0), "marks": marks.limit(1)}, refuse)):
        with pytest.raises(Exception, match="cut off|shrunk"):
            versions.replace(spark, folder, tables, guard)
        assert versions.current(spark, folder)[0] == 1 and versions.read(spark, folder, "items").count() == 3
    versions.rebuild_kind(spark, folder, "items", spark.createDataFrame([(3, "b"), (4, "b")], "id long, kind string"), "kind", "b", ("marks", "item", "id"))
    assert sorted(map(tuple, versions.read(spark, folder, "items").collect())) == [(1, "a"), (3, "b"), (4, "b")]
    assert sorted(map(tuple, versions.read(spark, folder, "marks").collect())) == [(1, "x"), (3, "z")]
    with pytest.raises(versions.Conflict):
        versions.commit(spark, folder, 1, {})
    assert versions.current(spark, str(tmp_path / "none")) == (0, {})
    tree = spark.createDataFrame([(10, "root", None), (11, "leaf", "root"), (12, "odd", "nowhere"), (13, "root", None)], "id long, name string, parent string")
    assert {r.id: r.parent_id for r in versions.with_parents(tree, "name", "parent").collect()} == {10: None, 11: 10, 12: None, 13: None}


def test_postings_are_made_of_bounded_pieces(monkeypatch):
    """Whatever the rows of a batch, a piece has at most one row over the bound; no row is lost and their order stays."""
    import pyarrow as pa

    monkeypatch.setattr(text_index, "WORDS", 50)
    lists = [["w"] * (k * 7 % 40) for k in range(300)] + [["w"] * 500, None, []]
    batch = pa.record_batch({"id": pa.array(range(len(lists))), "f0": pa.array(lists, pa.list_(pa.string())), "f1": pa.array([["x"]] * len(lists), pa.list_(pa.string()))})
    pieces = list(text_index._slices(iter([batch, batch.slice(0, 0)]), 2))
    assert [i for p in pieces for i in p["id"].to_pylist()] == list(range(len(lists)))
    sizes = [sum(len(x or []) + 1 for x in p["f0"].to_pylist()) for p in pieces]
    assert len(pieces) > 50 and all(s < 50 + 41 or s >= 500 for s in sizes)


def test_stems_in_sql():
    """The SQL has every step of the stemmer: endings of all steps behind roots of many shapes, and all words with forms of their own."""
    roots = ["", "b", "tr", "ay", "yy", "kn", "hop", "hopp", "fall", "plast", "relat", "gener", "communi", "arsenal", "élan", "sly", "boy", "agre", "siz", "troubl", "rat", "ox", "x1", "apolog", "humour"]
    endings = ["", *stemmer.STEP_2, *stemmer.STEP_3, *stemmer.STEP_4, *"e y s es ed ing ingly edly eed eedly ies ied sses us ll".split()]
    words = {r + a + b for r in roots for a in endings for b in endings} | {*stemmer.FORMS, *stemmer.SETTLED, *SAMPLE} - {""}
    con = duckdb.connect()
    con.register("w", pa.table({"word": sorted(words - {""})}))
    found = dict(con.execute(stemmer.stem_sql("SELECT word FROM w")).fetchall())
    assert found == {w: stem(w) for w in words - {""}}


def test_the_index_query_has_stems_and_words(spark):
    """Every word counts twice: as it stands, and unless it is a stop word by its stem."""
    own, stems = {(r.language, r.term): r for r in QUERIES["fts01_stored_index"](spark, FOLDER).collect()}, defaultdict(lambda: [0, 0, 0])
    words = [r for (language, _), r in own.items() if language == "simple"]
    for r in words:
        if r.term not in search.STOP_WORDS:
            for k, n in enumerate((r.places, r.ats, r.weights)):
                stems[stem(r.term)][k] += n
    assert {k[1]: [r.places, r.ats, r.weights] for k, r in own.items() if k[0] == "english"} == stems
    assert 0 < len(stems) < len(words) and any(r.term in search.STOP_WORDS for r in words)
