"""File sources and sinks: documents, dictionaries, overrides, cases, taxonomies, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.recognise import rule_codes
from tallyweave.functions.text import strip
from tallyweave.session import path_exists
from tallyweave.sources.json_arrays import read_records

SUPPORTED_EXTENSIONS = (".pdf", ".docx")
METRIC_JSON = (
    "metric_code string, metric_name_cn string, metric_name_en string, statement_type string, value_nature string, "
    "parent_metric_code string, patterns array<string>, patterns_cn array<string>, patterns_exact array<string>, "
    "patterns_cn_exact array<string>, patterns_en array<string>, patterns_en_exact array<string>"
)
OVERRIDE_FIELDS = (
    "report_id", "fact_type", "metric_code", "period_start_date", "period_end_date", "as_of_date", "consolidation_scope",
    "value", "unit", "currency", "audit_flag", "reviewed_by", "review_notes",
)
CASE_JSON = "id string, label string, statement_type string, expected_metric_code string, required boolean"


# ---------------------------------------------------------------- documents


def scan_files(spark: SparkSession, path: str, extensions=SUPPORTED_EXTENSIONS) -> DataFrame:
    """Files below a folder with a wanted ending: path, hash, doc_id, length, modified_at.

    Contents are read for the hash only and do not leave the scan stage.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Path not found: {path}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1))
    wanted = files.filter(ending.isin(*extensions))
    return wanted.select("path", F.sha2("content", 256).alias("hash"), "length", F.col("modificationTime").alias("modified_at")).withColumn(
        "doc_id", F.left("hash", F.lit(32))
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks (doc_id, source_path, page, chunk_index, text, embedding) with a stable 64-bit id."""
    keyed = chunks.withColumn("chunk_id", F.xxhash64("doc_id", "page", "chunk_index"))
    keyed.write.mode("append").parquet(path)


# ---------------------------------------------------------------- JSON tables


def _json_items(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Items of one JSON document (an object with a list ``field``, or a bare list), read in splits, or of JSON lines, with their order.

    A folder is what a sink wrote: JSON lines, ordered by ``def_order`` where they have it.
    """
    if _is_folder(spark, path):
        lines = spark.read.schema(f"{schema}, def_order long").json(path)
        place = F.coalesce("def_order", F.monotonically_increasing_id()).alias("item_order")
        return lines.select(place, *[f.split()[0] for f in schema.split(", ")])
    records = read_records(spark, path, pattern="*", field=field)
    parsed = records.select(F.col("offset").alias("item_order"), F.from_json("record", f"struct<{_struct_fields(schema)}>").alias("i"))
    return parsed.filter("i IS NOT NULL").select("item_order", "i.*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(target) and system.getFileStatus(target).isDirectory()


def _struct_fields(schema: str) -> str:
    return ",".join(part.strip().replace(" ", ":", 1) for part in schema.split(","))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary file as metric definitions, re-bucketed; entries without a required field are dropped."""
    from tallyweave.operators.matching import bucket_patterns

    items = _json_items(spark, path, "metrics", METRIC_JSON)
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    complete = items.filter(given("metric_code") & given("metric_name_cn") & given("statement_type") & given("value_nature"))
    empty = F.array().cast("array<string>")
    filled = lambda c: F.when(F.size(F.coalesce(c, empty)) > 0, F.col(c))
    return bucket_patterns(
        complete.select(
            F.col("item_order").alias("def_order"),
            "metric_code", "metric_name_cn", "metric_name_en", "statement_type", "value_nature", "parent_metric_code",
            F.coalesce(filled("patterns"), filled("patterns_cn"), empty).alias("patterns"),
            F.coalesce(filled("patterns_exact"), filled("patterns_cn_exact"), empty).alias("patterns_exact"),
            F.coalesce("patterns_en", empty).alias("patterns_en"),
            F.coalesce("patterns_en_exact", empty).alias("patterns_en_exact"),
        )
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Dictionary as JSON lines, one metric per line, in the field names of the dictionary view, with its order."""
    from tallyweave.operators.matching import metric_dictionary

    metric_dictionary(metrics, "def_order").write.mode("overwrite").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Override rows of a CSV file with a header, or of a JSON list or ``rows`` object, with their order."""
    if path.lower().endswith(".json"):
        rows = _json_items(spark, path, "rows", ", ".join(f"{f} string" for f in OVERRIDE_FIELDS))
        ordered = rows.withColumnRenamed("item_order", "input_order")
    else:
        rows = spark.read.option("header", True).option("multiLine", True).csv(path)
        ordered = rows.withColumn("input_order", F.monotonically_increasing_id())
    for name in OVERRIDE_FIELDS:
        if name not in ordered.columns:
            ordered = ordered.withColumn(name, F.lit(None).cast("string"))
    dates = {c: F.try_to_date(F.nullif(c, F.lit(""))) for c in ("period_start_date", "period_end_date", "as_of_date")}
    blank = {c: F.nullif(c, F.lit("")) for c in ("value",)}
    return ordered.withColumns({**dates, **blank}).select("input_order", *OVERRIDE_FIELDS)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled matching cases; a case without the mark is required."""
    return _json_items(spark, path, "cases", CASE_JSON).withColumn("required", F.coalesce("required", F.lit(True)))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _json_items(spark, path, "reports", "path string, id string")


# ---------------------------------------------------------------- tab-separated tables


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def table_records(rows: DataFrame) -> DataFrame:
    """Rows of a document table (doc, row_index, cells) as (doc, row_index, record map).

    The first row names the fields; short rows are padded with empty texts, and
    cells beyond the header are dropped.
    """
    heads = rows.groupBy("doc").agg(F.min_by("cells", "row_index").alias("head"), F.min("row_index").alias("first"))
    joined = rows.join(heads, "doc").filter(F.col("row_index") > F.col("first"))
    width = F.size("head")
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.greatest(width - F.size("cells"), F.lit(0)))), 1, width)
    return joined.select("doc", "row_index", F.map_from_arrays("head", padded).alias("record"))


def rule_changes(records: DataFrame, name: str = "ELR名称", change: str = "变化说明") -> DataFrame:
    """Add the bracketed rule codes of the name and the description of a change."""
    text = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(change, F.lit("")))
    codes = F.regexp_extract_all(text, F.lit(r"\[(\d+[a-z]?)\]"), F.lit(1))
    return records.withColumn("elr_codes", codes)


def rule_statements(changes: DataFrame, order: str, name: str = "ELR名称") -> DataFrame:
    """(code, statement_type) of rule codes; a later record overwrites an earlier one."""
    has = lambda *ws: F.rlike(name, F.lit("|".join(ws)))
    statement = (
        F.when(has("资产负债表"), "balance_sheet")
        .when(has("利润表", "损益表"), "income_statement")
        .when(has("现金流量表"), "cash_flow")
        .when(has("所有者权益变动表", "股东权益变动表"), "changes_in_equity")
    )
    rows = changes.select(order, statement.alias("statement_type"), F.explode("elr_codes").alias("code")).filter(
        "statement_type IS NOT NULL"
    )
    named = rows.withColumn("code", F.lower(F.trim("code"))).filter("code <> ''")
    return named.groupBy("code").agg(F.max_by("statement_type", order).alias("statement_type"))


def list_literal(text: Column) -> Column:
    """A list written as ``['a', 'b']`` as an array."""
    return F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1))


def rule_map(statements: DataFrame) -> Column:
    """Rule codes as a literal map column, for ``recognise.detect_statement``; the codes number some hundreds."""
    rows = statements.orderBy("code").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many rule codes for a literal map")
    return F.create_map(*[F.lit(v) for r in rows for v in (r["code"], r["statement_type"])])


# ---------------------------------------------------------------- taxonomy label files


def concept_from_href(href: Column) -> Column:
    """Fragment of a reference after ``#`` and ``:``."""
    last = lambda c, mark: F.try_element_at(F.split(c, mark, -1), F.lit(-1))
    return F.nullif(last(last(href, "#"), ":"), F.lit(""))


def is_label_file(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]+)\z", 1))
    return name.endswith(".xml") & F.contains(name, F.lit("lab"))


def read_taxonomy_labels(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Labels of taxonomy link files: locators, arcs and labels are three row sets joined by file and key.

    A label that occurs again counts once, the last one.
    """
    def rows(tag: str, fields: str) -> DataFrame:
        raw = (
            spark.read.format("xml")
            .option("rowTag", f"link:{tag}")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.xml")
            .schema(fields)
            .load(path)
        )
        return raw.withColumn("file", F.input_file_name()).filter(is_label_file(F.col("file")))

    locs = rows("loc", "`_xlink:label` string, `_xlink:href` string").select(
        "file", F.col("`_xlink:label`").alias("loc_key"), concept_from_href(F.col("`_xlink:href`")).alias("concept"),
        F.monotonically_increasing_id().alias("loc_no"),
    ).filter("loc_key <> '' AND concept IS NOT NULL")
    arcs = rows("labelArc", "`_xlink:from` string, `_xlink:to` string").select(
        "file", F.col("`_xlink:from`").alias("loc_key"), F.col("`_xlink:to`").alias("label_key"), F.monotonically_increasing_id().alias("arc_no")
    ).filter("loc_key <> '' AND label_key <> ''")
    labels = rows("label", "`_xlink:label` string, `_xlink:role` string, `_xml:lang` string, _VALUE string").select(
        "file", F.col("`_xlink:label`").alias("label_key"), strip(F.col("_VALUE")).alias("label"),
        F.col("`_xlink:role`").alias("role"), F.col("`_xml:lang`").alias("lang"), F.monotonically_increasing_id().alias("label_no"),
    ).filter("label_key <> '' AND label <> ''")
    # Of several locators with one key the last is used.
    last_loc = locs.groupBy("file", "loc_key").agg(F.max_by("concept", "loc_no").alias("concept"))
    found = arcs.join(last_loc, ["file", "loc_key"]).join(labels, ["file", "label_key"])
    return last_labels(
        found.select(
            "concept", "label", "lang", "role", F.lit(source).alias("source"), "file",
            F.struct("file", "arc_no", "label_no").alias("entry_order"),
        )
    )


def last_labels(labels: DataFrame) -> DataFrame:
    """One row per (concept, label, lang, role, source): the place of the first, the file of the last."""
    return labels.groupBy("concept", "label", "lang", "role", "source").agg(
        F.max_by("file", "entry_order").alias("file"), F.min("entry_order").alias("entry_order")
    )
