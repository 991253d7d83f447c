"""Readers and writers of files in a folder that Spark reaches: JSON arrays, CSV, text directories, listings, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_arrays(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> DataFrame:
    """Files that each hold one JSON array of objects, as rows; missing fields are null, files that do not exist are passed over."""
    return spark.read.schema(schema).option("multiLine", True).option("ignoreMissingFiles", True).json(paths)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, escape: str = '"') -> DataFrame:
    """CSV with a header, commas and line feeds inside quotes, and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", escape).option("multiLine", True).csv(path)


def places(rows: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Gazetteer rows with numbers for coordinates; rows without both are dropped, texts trimmed."""
    number = lambda c: F.expr(f"try_cast(trim({c}) AS DOUBLE)")
    texts = [F.trim(c).alias(c) for c, kind in rows.dtypes if kind == "string" and c not in (lat, lon)]
    made = rows.select(*texts, number(lat).alias(lat), number(lon).alias(lon))
    return made.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon))


def read_texts(spark: SparkSession, folder: str, suffix: str = "txt") -> DataFrame:
    """id (the file's name without suffix) and text of every file with the suffix; one file is one row."""
    files = spark.read.option("pathGlobFilter", f"*.{suffix}").text(folder, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), rf"([^/]+)\.{suffix}$", 1)
    return files.select(F.url_decode(name).alias("id"), F.col("value").alias("text"))


def listing(html: Column) -> Column:
    """The articles of a listing page: an array of url, title, day and excerpt, in order."""
    first = lambda block, pattern: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(block, pattern, 1), "<[^>]*>", "")), F.lit(""))

    def article(block: Column) -> Column:
        return F.struct(
            first(block, r'(?is)<a[^>]*\shref="([^"]+)"').alias("url"), first(block, r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>").alias("title"),
            F.to_date(F.left(first(block, r'(?is)<time[^>]*datetime="([^"]+)"'), F.lit(10))).alias("day"), first(block, r"(?is)<p[^>]*>(.*?)</p>").alias("excerpt"),
        )

    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<article[^>]*>(.*?)</article>"), 1), article)


def numbered_articles(text: Column) -> Column:
    """The entries of a dump of numbered articles (``1. Title`` at the beginning of a line, then lines of the entry): an array of
    number, title and body, in order.  A number counts only if a title follows it on the line; blank lines go."""
    header = r"^\s*(\d{1,9})\.\s+(\S.*)$"
    named = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  the value is worked once, not for each line
    end = lambda line: F.regexp_replace(line, r"\s+$", "")

    def entries(lines: Column, starts: Column) -> Column:
        def entry(at: Column, k: Column) -> Column:
            line, after = F.get(lines, at), F.coalesce(F.get(starts, k + 1), F.size(lines))
            body = F.filter(F.transform(F.slice(lines, at + 2, after - at - 1), end), lambda x: x != "")
            return F.struct(F.regexp_extract(line, header, 1).cast("int").alias("number"), F.trim(F.regexp_extract(line, header, 2)).alias("title"), F.regexp_replace(F.array_join(body, "\n"), r"^\s+", "").alias("body"))

        return F.transform(starts, entry)

    heads = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(header), i)), lambda i: i.isNotNull())
    return named(F.split(text, r"\r?\n"), lambda lines: named(heads(lines), lambda starts: entries(lines, starts)))


def read_graphs(spark: SparkSession, path: str, node: str = "id STRING, label STRING, nodeType STRING, community BIGINT", edge: str = "source STRING, target STRING, weight DOUBLE") -> tuple[DataFrame, DataFrame]:
    """Graph files, one JSON object each, as nodes and edges, both with the name of their ``graph``."""
    schema = f"nodes ARRAY<STRUCT<{', '.join(f.strip().replace(' ', ': ', 1) for f in node.split(','))}>>, edges ARRAY<STRUCT<{', '.join(f.strip().replace(' ', ': ', 1) for f in edge.split(','))}>>"
    graphs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("graph", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return graphs.select("graph", F.inline("nodes")), graphs.select("graph", F.inline("edges"))


def write_json(df: DataFrame, path: str) -> None:
    """Replaces the folder by JSON lines, one object a row; nulls are left out."""
    df.write.mode("overwrite").json(path)


def csv_field(value: Column) -> Column:
    """RFC 4180: quotes around values with commas, quotes or line breaks; quotes inside are doubled; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*columns: str) -> Column:
    return F.concat_ws(",", *(csv_field(F.col(c)) for c in columns))


def graph_json(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """One JSON object for each graph: nodes, edges and how many there are, ready to be written as text.

    A graph is one object by its format, so its nodes and edges are gathered in one row; ``by`` says which graph they are of.
    """
    fields = lambda df: F.struct(*(c for c in df.columns if c != by))
    one = lambda df, name: df.groupBy(by).agg(F.sort_array(F.collect_list(fields(df))).alias(name))
    both = one(nodes, "nodes").join(one(edges, "edges"), by, "left")
    edges_or_none = F.coalesce("edges", F.from_json(F.lit("[]"), both.schema["edges"].dataType))
    meta = F.struct(F.size("nodes").alias("nodes"), F.greatest(F.size("edges"), F.lit(0)).alias("edges"))
    return both.select(by, F.to_json(F.struct("nodes", edges_or_none.alias("edges"), meta.alias("meta"))).alias("json"))


def replace_keys(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """Deletes the rows of each key that ``rows`` has and writes those instead; other keys stay.  The table is partitioned by the
    key, and the commit puts the new partitions in place after all of them are written."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_audit(path: str, rows: DataFrame, action: str) -> None:
    """Adds rows to an audit log with the action and the time of the run."""
    rows.withColumns({"action": F.lit(action), "logged_at": F.current_timestamp()}).write.mode("append").parquet(path)
