"""Readers and writers of files: what is written is read again, and odd files are read as defined."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tarn.sources import files


def test_json_arrays_of_several_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "title": "x", "extra": 2}, {"id": 2}]))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 3, "title": None}]))
    rows = files.read_json_arrays(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], "id long, title string")
    assert sorted(map(tuple, rows.collect()), key=lambda r: r[0]) == [(1, "x"), (2, None), (3, None)]


def test_csv_with_quotes_and_places(spark, tmp_path):
    (tmp_path / "g.csv").write_text('name,lat,lon,feet\n" Mount ""Old"", north",38.5,-106.9,9000\nNowhere,x,1,2\n"Two\nlines",1,nan,3\nLow, 0.5 ,2,\n')
    rows = files.places(files.read_csv(spark, str(tmp_path / "g.csv"), "name string, lat string, lon string, feet int"))
    assert sorted((r.name, r.lat, r.lon) for r in rows.collect()) == [("Low", 0.5, 2.0), ('Mount "Old", north', 38.5, -106.9)]


def test_lines_of_csv_are_read_again(spark, tmp_path):
    odd = [(1, 'a "b", c'), (2, "x\ny"), (3, None), (4, "plain")]
    spark.createDataFrame(odd, "id int, v string").select(files.csv_line("id", "v").alias("line")).coalesce(1).write.text(str(tmp_path / "out"), lineSep="\r\n")
    back = spark.read.schema("id int, v string").option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(odd)


def test_text_directories(spark, tmp_path):
    for name, text in (("a b.txt", "one\ntwo"), ("c.txt", "three"), ("d.md", "no")):
        (tmp_path / name).write_text(text)
    assert sorted(map(tuple, files.read_texts(spark, str(tmp_path)).collect())) == [("a b", "one\ntwo"), ("c", "three")]


def test_graphs_are_written_and_read(spark, tmp_path):
    nodes = spark.createDataFrame([("g", "a", "A", "part", 1), ("g", "b", "B", "part", 1), ("h", "c", "C", "item", 2)], "graph string, id string, label string, nodeType string, community long")
    edges = spark.createDataFrame([("g", "a", "b", 2.0)], "graph string, source string, target string, weight double")
    for r in files.graph_json(nodes, edges, "graph").collect():
        (tmp_path / f"{r.graph}.json").write_text(r.json)
        assert json.loads(r.json)["meta"]["edges"] == (1 if r.graph == "g" else 0)
    n, e = files.read_graphs(spark, str(tmp_path))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect())) and list(map(tuple, e.collect())) == [("g", "a", "b", 2.0)]


def test_keys_are_replaced_whole_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, kind string").write.partitionBy("kind").parquet(path)
    files.replace_keys(spark, path, spark.createDataFrame([(9, "x"), (8, "z")], "id int, kind string"), "kind")
    assert sorted((r.id, r.kind) for r in spark.read.parquet(path).collect()) == [(3, "y"), (8, "z"), (9, "x")]


def test_audit_rows_are_added(spark, tmp_path):
    path = str(tmp_path / "log")
    for action in ("pull", "push"):
        files.append_audit(path, spark.createDataFrame([(1,)], "n int"), action)
    assert sorted(r.action for r in spark.read.parquet(path).filter(F.col("logged_at").isNotNull()).collect()) == ["pull", "push"]


def test_overwritten_json(spark, tmp_path):
    path = str(tmp_path / "j")
    for rows in ([(1, "a"), (2, None)], [(3, "c")]):
        files.write_json(spark.createDataFrame(rows, "id int, v string"), path)
    assert [tuple(r) for r in spark.read.schema("id int, v string").json(path).collect()] == [(3, "c")]


def test_numbered_articles_need_a_title(spark):
    text = "Front matter\n12\n1. First one\nbody 2. not a header\n\n2.\n2. Second\nline\n"
    rows = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(files.numbered_articles(F.col("t")).alias("a")).collect()
    assert [tuple(x) for x in rows[0].a] == [(1, "First one", "body 2. not a header\n2."), (2, "Second", "line")] and rows[1].a == [] and rows[2].a is None


def test_entries_of_a_long_dump_are_whole(spark):
    """Numbers over 9,999 are entries too, blank lines go, and a long dump takes one pass over its lines."""
    n = 12_000
    text = "Preface\n" + "".join(f" {k}. Title {k}  \n\n  first {k} \n \t\n  second\n" for k in range(1, n + 1))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r.found for r in df.select("id", files.numbered_articles(F.col("text")).alias("found")).collect()}
    assert [tuple(e) for e in got[1]] == [(k, f"Title {k}", f"first {k}\n  second") for k in range(1, n + 1)]
    assert got[2] == [] and got[3] is None
