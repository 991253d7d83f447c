"""Similar titles are those of whole titles, wherever these stand in a page."""

from __future__ import annotations

from tarn.plans.registry import QUERIES


def test_titles_after_a_long_head(spark, tmp_path):
    """Titles behind 400 characters of boilerplate decide, not the boilerplate; a title longer than that counts to its end."""
    head, long = "<html><head><style>" + "x" * 500 + "</style>", " ".join(f"w{k}" for k in range(200))
    titles = ["red green blue fish", "red green blue bird", "one two three four", long, long + " end", ""]
    rows = [(k, f"http://h/{k}", f"{head}<TITLE lang='en'>{t}</TITLE></head><body>same words on every page</body></html>") for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.left_id, r.right_id): r.similarity for r in QUERIES["joi17_similar_titles"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1): 0.6, (3, 4): round(200 / 201, 6)}
