"""Readers of question records and layout items, as set operations over parsed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.text import strip
from tallyweave.sources.json_arrays import read_records

ITEM_SCHEMA = (
    "id string, uid string, pre_text array<string>, table array<array<string>>, post_text array<string>, "
    "question string, query string, qa struct<question:string,answer:string>, q string, answer string, final string, a string"
)
LAYOUT_SCHEMA = (
    "page_idx string, type string, text string, text_level string, table_caption string, table_body string, table_footnote string"
)


def read_items(
    spark: SparkSession, path: str, schema: str = ITEM_SCHEMA, layout: str = "auto", pattern: str = "*.json"
) -> tuple[DataFrame, DataFrame]:
    """Records of JSON files, arrays or one record per line: ``(items, errors)``.

    A record that does not parse goes to ``errors`` (file_name, offset in bytes,
    the whole record) and spoils no other.  ``auto`` tells arrays from lines by a
    file's first character and reads both in splits; ``lines`` takes every
    file for lines and saves the pass that finds the items (its errors have no offset).
    """
    name = lambda c: F.regexp_extract(c, r"([^/]+)\z", 1).alias("file_name")
    if layout == "lines":
        plain = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
        records = plain.select(name(F.input_file_name()), F.lit(None).cast("long").alias("offset"), strip(F.col("value")).alias("record"))
        return _parse(records.filter("record <> ''"), schema)
    return _parse(read_records(spark, path, pattern).select(name(F.col("file_path")), "offset", "record"), schema)


def _parse(records: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    parsed = records.withColumn(
        "p", F.from_json("record", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    )
    items = parsed.filter("p IS NOT NULL AND p._bad IS NULL").select("file_name", "p.*", F.col("record").alias("raw_json")).drop("_bad")
    errors = parsed.filter("p IS NULL OR p._bad IS NOT NULL").select("file_name", "offset", "record")
    return items, errors


def _joined(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), "\n")


def question_text(pre_text: Column, table: Column, post_text: Column) -> Column:
    """Lead text, ``TABLE:`` with tab-separated rows, closing text; blank parts left out."""
    some = lambda a: F.size(F.coalesce(a, F.array())) > 0
    rows = F.array_join(F.transform(table, lambda r: F.array_join(r, "\t", "None")), "\n")
    parts = F.array(
        F.when(some(pre_text), _joined(pre_text)),
        F.when(some(table), F.concat(F.lit("TABLE:\n"), rows)),
        F.when(some(post_text), _joined(post_text)),
    )
    return strip(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (strip(p) != "")), "\n\n"))


def question_documents(items: DataFrame) -> DataFrame:
    """Add doc_text, hash, doc_id, qa_id, source_path and the coalesced question and answer."""
    given = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    read = items.withColumns(
        {
            "doc_text": question_text(F.col("pre_text"), F.col("table"), F.col("post_text")),
            "question": given("question", "query", "qa.question", "q"),
            "answer": given("answer", "final", "qa.answer", "a"),
        }
    ).filter("doc_text <> ''")
    hashed = read.withColumn("hash", F.sha2(F.col("doc_text").cast("binary"), 256))
    qa_id = F.coalesce(F.nullif("id", F.lit("")), F.nullif("uid", F.lit("")), F.left("hash", F.lit(12)))
    return hashed.withColumns({"doc_id": F.left("hash", F.lit(32)), "qa_id": qa_id}).withColumn(
        # Fixed value: the prefix of question sources.
        "source_path", F.concat_ws("::", F.lit("finqa"), "file_name", "qa_id")
    )


def question_rows(documents: DataFrame) -> DataFrame:
    """Rows of the question store; records without a question have none."""
    return documents.filter("question IS NOT NULL").select("qa_id", "doc_id", "question", "answer", "raw_json")


def captions(text: Column) -> Column:
    """Caption field of a layout item, a JSON list or a plain text, as non-blank texts."""
    listed = F.from_json(text, "array<string>")
    single = F.array(strip(text))
    return F.filter(F.coalesce(F.when(F.ltrim(text).startswith("["), listed), single, F.array().cast("array<string>")), lambda c: strip(c) != "")


def read_layout_items(spark: SparkSession, path: str) -> DataFrame:
    """Layout item lists (one JSON array per report) with their position; adds the report's folder name."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_content_list.json").text(path, wholetext=True)
    named = raw.select(F.input_file_name().alias("path"), F.from_json("value", f"array<struct<{_fields(LAYOUT_SCHEMA)}>>").alias("items"))
    rows = named.select("path", F.posexplode("items").alias("pos", "i")).select("path", "pos", "i.*")
    return rows.withColumns(
        {
            "text_level": F.col("text_level").try_cast("int"),
            "table_caption": captions(F.col("table_caption")),
            "table_footnote": captions(F.col("table_footnote")),
        }
    )


def _fields(schema: str) -> str:
    return ",".join(part.strip().replace(" ", ":", 1) for part in schema.split(","))


def layout_pages(items: DataFrame, known_types: tuple[str, ...] = ()) -> DataFrame:
    """Layout items to pages(report_id, engine, page, text_md, text_raw).

    ``items``: report_id, engine, pos, page_idx, type, text, text_level,
    table_caption, table_body, table_footnote.  Types outside a non-empty
    ``known_types`` are dropped.  A page is one output row, so its items meet.
    """
    kind = F.lower(strip(F.col("type")))
    text = strip(F.coalesce("text", F.lit("")))
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.col("text_level"), F.lit(6))), F.lit(" "), text)
    shown = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: strip(x) != "")
    caps, notes = shown(F.col("table_caption")), shown(F.col("table_footnote"))
    body = F.filter(F.array(strip(F.coalesce("table_body", F.lit("")))), lambda b: b != "")
    text_md = F.array(F.when(F.coalesce(F.col("text_level"), F.lit(0)) > 0, heading).otherwise(text))
    empty = F.array().cast("array<string>")
    md = F.when((F.col("kind") == "text") & (text != ""), text_md).when(
        F.col("kind") == "table", F.concat(F.transform(caps, lambda c: F.concat(F.lit("### "), c)), body, notes)
    )
    plain = F.when((F.col("kind") == "text") & (text != ""), F.array(text)).when(F.col("kind") == "table", F.concat(caps, notes))
    known = items.withColumns({"kind": kind, "page": F.col("page_idx").try_cast("int") + 1}).filter("page IS NOT NULL")
    if known_types:
        known = known.filter(F.col("kind").isin(*known_types))
    parts = known.select("report_id", "engine", "page", "pos", F.coalesce(md, empty).alias("md"), F.coalesce(plain, empty).alias("raw"))
    pages = (
        parts.filter(F.size("md") + F.size("raw") > 0)
        .groupBy("report_id", "engine", "page")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "md", "raw"))).alias("p"))
        .select(
            "report_id", "engine", "page",
            strip(F.array_join(F.flatten(F.transform("p", lambda x: x["md"])), "\n\n")).alias("text_md"),
            strip(F.array_join(F.flatten(F.transform("p", lambda x: x["raw"])), "\n")).alias("text_raw"),
        )
    )
    return pages.filter("text_md <> '' OR text_raw <> ''")


def prefer_layout(content_pages: DataFrame, markdown_pages: DataFrame) -> DataFrame:
    """Pages of item lists where a report has any, its markdown files as pages otherwise."""
    have = content_pages.select("report_id").distinct()
    return content_pages.unionByName(markdown_pages.join(have, "report_id", "left_anti"))


def markdown_pages(spark: SparkSession, path: str, engine: str = "layout") -> DataFrame:
    """Markdown files of a report folder, sorted by path, as pages 1, 2, …"""
    from pyspark.sql import Window

    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    files = raw.select(F.input_file_name().alias("path"), F.col("value").alias("text_md"))
    report = F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1)
    named = files.withColumn("report_id", report)
    number = F.row_number().over(Window.partitionBy("report_id").orderBy("path"))
    return named.select("report_id", F.lit(engine).alias("engine"), number.alias("page"), "text_md", F.col("text_md").alias("text_raw"))


def first_content_list(paths: DataFrame) -> DataFrame:
    """Per report the first item list: under the report's own folder if there is one, else anywhere.

    ``paths``: report, path.
    """
    own = F.contains("path", F.concat(F.lit("/"), F.col("report"), F.lit("/")))
    return paths.groupBy("report").agg(F.min(F.struct(~own, F.col("path"))).alias("m")).select("report", F.col("m.path").alias("path"))
