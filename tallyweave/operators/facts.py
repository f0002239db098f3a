"""Reports to a star schema: registry, dimensions, tables, candidates, facts, run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import labels as L
from tallyweave.operators import matching as M
from tallyweave.operators.stage import materialize
from tallyweave.operators.tables import KEY, vote_by_rows


# ---------------------------------------------------------------- registry and dimensions


def ingest_mode(
    reports: DataFrame, registry: DataFrame, recompute: bool = False, allow_existing: bool = False, order: str | None = None
) -> DataFrame:
    """Add ``mode``: new, skip, append_candidates or recompute, by content hash.

    With ``order`` reports come in one by one: of those with one unknown hash the
    first is new and known to the others.
    """
    known = registry.select("source_hash", F.col("report_id").alias("known_report_id")).dropDuplicates(["source_hash"])
    again = "recompute" if recompute else "append_candidates" if allow_existing else "skip"
    found = reports.join(known, "source_hash", "left")
    if order is not None:
        place = F.struct(F.col(order).alias("at"), F.col("report_id").alias("id"))
        firsts = reports.groupBy("source_hash").agg(F.min(place).alias("_first"))
        earlier = F.when(place > F.col("_first"), F.col("_first.id"))
        found = found.join(firsts, "source_hash", "left").withColumn("known_report_id", F.coalesce("known_report_id", earlier)).drop("_first")
    return found.withColumn("mode", F.when(F.col("known_report_id").isNull(), F.lit("new")).otherwise(F.lit(again)))


def version_log(reports: DataFrame) -> DataFrame:
    """Run log of the modes: skipped duplicates are closed at once, the rest is running."""
    skipped = F.col("mode") == "skip"
    return reports.select(
        "source_hash",
        F.coalesce("known_report_id", "report_id").alias("report_id"),
        F.lit("v1").alias("parser_version"),
        F.when(skipped, F.lit("skipped")).otherwise(F.lit("running")).alias("status"),
        F.when(skipped, F.to_json(F.struct(F.lit("duplicate").alias("reason")))).alias("summary_json"),
    )


def field_status(meta: DataFrame) -> DataFrame:
    """Detected or missing per field; ready only with currency, units and period."""
    flag = lambda c: F.when(F.col(c).isNotNull(), F.lit("detected")).otherwise(F.lit("missing"))
    complete = F.col("currency").isNotNull() & F.col("units").isNotNull() & F.col("period_end").isNotNull()
    return meta.withColumns(
        {
            "currency_status": flag("currency"),
            "units_status": flag("units"),
            "period_status": flag("period_end"),
            "status": F.when(complete, F.lit("ready")).otherwise(F.lit("draft")),
            "version_no": F.lit(1),
            "is_restated": F.lit(False),
        }
    )


def company_dimension(reports: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Companies by name and ticker (a missing ticker equals a missing ticker), with a stable key."""
    found = reports.filter(F.coalesce("company_name", F.lit("")) != "").select(
        F.col("company_name").alias("name"), "ticker"
    ).distinct()
    key = F.xxhash64("name", F.coalesce("ticker", F.lit("")), F.col("ticker").isNull())
    if existing is None:
        return found.withColumn("company_id", key)
    old = existing.select(F.col("name").alias("o_name"), F.col("ticker").alias("o_ticker"))
    new = found.join(old, (F.col("name") == F.col("o_name")) & F.col("ticker").eqNullSafe(F.col("o_ticker")), "left_anti")
    return existing.select("name", "ticker", "company_id").unionByName(new.withColumn("company_id", key))


def metric_dimension(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Metrics used by rows(metric_code, metric_name, metric_statement, value_nature, unit_default, row_order).

    The first row of a code names it, as with get-or-create.
    """
    first = rows.groupBy("metric_code").agg(
        F.min_by(F.struct("metric_name", "metric_statement", "value_nature", "unit_default"), "row_order").alias("m")
    )
    made = first.select("metric_code", "m.*").withColumn("metric_id", F.xxhash64("metric_code"))
    if existing is None:
        return made
    new = made.join(existing.select("metric_code"), "metric_code", "left_anti")
    return existing.select(*made.columns).unionByName(new)


def upsert_pages(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """New pages are added; a stored page is replaced only while it has no table markup."""
    keys = ["report_id", "page"]
    new = incoming.select(*keys, F.struct("text_md", "text_raw").alias("new"))
    old = stored.select(*keys, F.struct("text_md", "text_raw").alias("old"))
    keeps = F.col("old").isNotNull() & F.contains(F.col("old.text_md"), F.lit("<table"))
    taken = F.when(F.col("new").isNull() | F.coalesce(keeps, F.lit(False)), F.col("old")).otherwise(F.col("new"))
    return old.join(new, keys, "full_outer").select(*keys, taken.alias("p")).select(*keys, "p.text_md", "p.text_raw")


# ---------------------------------------------------------------- table star


def normalize_tables(tables: DataFrame, rows: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    """Tables, columns, rows and cells; currency and units fall back to the report."""
    fall = meta.select("report_id", "engine", F.col("currency").alias("m_currency"), F.col("units").alias("m_units"))
    full = tables.join(fall, ["report_id", "engine"], "left").withColumns(
        {"currency": F.coalesce("currency", "m_currency"), "units": F.coalesce("units", "m_units")}
    )
    flag = lambda c: F.when(F.col(c).isNotNull(), F.lit("detected")).otherwise(F.lit("missing"))
    out_tables = full.withColumns({"currency_status": flag("currency"), "units_status": flag("units")}).drop(
        "columns", "m_currency", "m_units"
    )
    columns = tables.select(*KEY, F.posexplode("columns").alias("column_index", "c")).select(*KEY, "column_index", "c.*")
    out_rows = rows.select(
        *KEY,
        "row_index",
        "label",
        F.lit(None).cast("int").alias("level"),
        (F.contains("label", F.lit("合计")) | F.contains(F.lower("label"), F.lit("total"))).alias("is_total"),
        "page_number",
    )
    cells = (
        rows.join(full.select(*KEY, "units", F.size("columns").alias("n_columns")), KEY)
        .select(*KEY, "row_index", "units", "n_columns", F.posexplode("cells").alias("column_index", "cell"))
        .filter("column_index < n_columns AND (cell.value IS NOT NULL OR coalesce(cell.raw_text, '') <> '')")
        .select(*KEY, "row_index", "column_index", "cell.value", "cell.raw_text", F.col("units").alias("unit"))
    )
    return {"tables": out_tables, "columns": columns, "rows": out_rows, "cells": cells}


def row_ids(rows: DataFrame) -> DataFrame:
    """Stable row ids of stored tables, by table and row index."""
    return rows.select(*KEY, "row_index", F.xxhash64(*KEY, "row_index").alias("row_id"))


# ---------------------------------------------------------------- candidates


def infer_period_end(column: Column, report_end: Column) -> Column:
    """Column date, current and prior period of the report, column year, report date."""
    label = column["label"]
    return F.coalesce(
        column["period_end"],
        F.when(label == "current_period", report_end),
        F.when(label == "prior_period", F.add_months(report_end, -12)),
        F.when(column["fiscal_year"].isNotNull(), F.make_date(column["fiscal_year"], F.lit(12), F.lit(31))),
        report_end,
    )


def infer_period_start(report_type: Column, period_end: Column) -> Column:
    return F.when(report_type == "annual", F.trunc(period_end, "year"))


def consolidation_scope(is_consolidated: Column) -> Column:
    return F.when(is_consolidated, F.lit("consolidated")).when(~is_consolidated, F.lit("parent"))


def build_candidates(
    tables: DataFrame,
    rows: DataFrame,
    meta: DataFrame,
    metrics: DataFrame,
    patterns: dict[str, list[str]] | None = None,
    mapping: DataFrame | None = None,
    core_only: bool = True,
    min_rows: int = M.MIN_METRIC_ROWS,
    strict_core_gate: bool = False,
) -> DataFrame:
    """Cells of metric tables as candidate facts, one row per number.

    A table counts if it is a core statement and enough of its rows match
    metrics of one statement.  ``strict_core_gate`` lets only the parser's own
    statement names pass; otherwise a statement voted by rows passes as well.
    """
    patterns = patterns if patterns is not None else M.base_patterns()
    core = L.is_core_table(F.col("statement_type"), F.col("title"), F.col("section_title"))
    if not strict_core_gate:
        core = core | F.coalesce(F.col("statement_type").isin(*L.STATEMENTS), F.lit(False))
    wanted = tables.filter(core) if core_only else tables
    matched = materialize(M.match_labels(rows, metrics, "label", mapping), "matched-rows")
    votes = matched.groupBy(*KEY).agg(*[F.count(f"match_{s}").alias(f"hits_{s}") for s in L.STATEMENTS])
    mapped = L.mapped_statement(F.col("statement_type"))
    voted = vote_by_rows(wanted.filter(mapped.isNull()), matched, patterns)
    statement, hits = M.pick_statement({s: F.col(f"hits_{s}") for s in L.STATEMENTS}, F.col("preferred"), min_rows)
    about = meta.select(
        "report_id", "engine", "report_type", F.col("period_end").alias("report_end"),
        F.col("currency").alias("m_currency"), F.col("units").alias("m_units"),
    )
    picked = (
        wanted.join(votes, KEY)
        .join(voted, KEY, "left")
        .withColumn("preferred", F.coalesce(mapped, "voted"))
        .filter("preferred IS NOT NULL")
        .withColumns({"statement": statement, "hits": hits})
        .filter(F.col("hits") >= min_rows)
        .join(about, ["report_id", "engine"], "left")
        .select(
            *KEY, "statement", "columns", "report_type", "report_end",
            F.coalesce("currency", "m_currency").alias("currency"),
            F.coalesce("units", "m_units").alias("unit"),
            consolidation_scope(F.col("is_consolidated")).alias("consolidation_scope"),
        )
    )
    code, metric_statement = M.match_with_fallback(F.col("statement"))
    usable = matched.filter(L.is_row_label(F.col("label")) & (F.col("label") != "(blank)")).join(picked, KEY)
    coded = (
        usable.withColumns({"found_code": code, "metric_statement": metric_statement})
        .filter(F.col("found_code").isNotNull() | ~L.is_low_quality(F.col("norm_label")))
        .withColumn(
            "metric_code", F.coalesce("found_code", L.raw_metric_code(F.col("label"), F.col("metric_statement")))
        )
    )
    width = F.least(F.size("columns"), F.size("cells"))
    cells = coded.select(
        "*",
        F.posexplode(
            F.arrays_zip(F.slice("columns", 1, width).alias("column"), F.slice("cells", 1, width).alias("cell"))
        ).alias("column_index", "z"),
    ).filter("z.cell.value IS NOT NULL")
    end = infer_period_end(F.col("z")["column"], F.col("report_end"))
    stock = F.col("metric_statement") == "balance"
    dated = cells.withColumn("end", end)
    return dated.select(
        F.xxhash64(*KEY, "row_index", "column_index").alias("candidate_id"),
        "report_id",
        "engine",
        F.when(stock, F.lit("stock")).otherwise(F.lit("flow")).alias("fact_type"),
        "metric_code",
        F.when(~stock, infer_period_start(F.col("report_type"), F.col("end"))).alias("period_start_date"),
        F.when(~stock, F.col("end")).alias("period_end_date"),
        F.when(stock, F.col("end")).alias("as_of_date"),
        F.col("z.cell.value").alias("value"),
        "unit",
        "currency",
        "consolidation_scope",
        F.lit(None).cast("string").alias("audit_flag"),
        F.col("z")["column"]["label"].alias("column_label"),
        F.lit(None).cast("double").alias("quality_score"),
        "metric_statement",
        F.struct(
            F.xxhash64(F.lit("trace"), *KEY, "row_index", "column_index").alias("trace_id"),
            "table_key",
            "row_index",
            F.col("page_number").alias("page"),
            F.col("label").alias("raw_label"),
            F.col("z.cell.raw_text").alias("raw_value"),
        ).alias("source_trace"),
    )


def candidate_metrics(candidates: DataFrame, metrics: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Metric rows of candidates: dictionary names where known, the record's name or the raw label otherwise.

    A metric made from a taxonomy record is named by the record if the label
    carries its code.
    """
    known = metrics.select("metric_code", "metric_name_cn", F.col("value_nature").alias("known_nature"))
    label = F.col("source_trace.raw_label")
    norm = L.normalize_label(label)
    made = F.col("metric_code").startswith("cas2020_")
    named = candidates.join(known, "metric_code", "left")
    record_name = F.lit(None).cast("string")
    if mapping is not None:
        by_code, _ = M.mapping_tables(mapping, metrics)
        free = by_code.filter("free_name IS NOT NULL").select(F.concat(F.lit("cas2020_"), "code_key").alias("metric_code"), "free_name")
        named = named.join(free, "metric_code", "left")
        record_name = F.when(F.concat(F.lit("cas2020_"), L.sub_code(label)) == F.col("metric_code"), F.col("free_name"))
    stock = F.when(F.col("metric_statement") == "balance", F.lit("stock")).otherwise(F.lit("flow"))
    nature = F.when(made, M.synthetic_nature(label, norm, F.col("metric_statement"))).otherwise(stock)
    rows = named.select(
        "metric_code",
        F.coalesce(F.col("metric_name_cn"), record_name, label).alias("metric_name"),
        "metric_statement",
        F.coalesce(F.col("known_nature"), nature).alias("value_nature"),
        F.col("unit").alias("unit_default"),
        F.struct("report_id", "source_trace.table_key", "source_trace.row_index").alias("row_order"),
    )
    return metric_dimension(rows)


def direct_facts(candidates: DataFrame) -> DataFrame:
    """Facts of a single engine, taken over as they are."""
    return candidates.withColumns(
        {
            "selected_candidate_id": F.col("candidate_id"),
            "resolution_status": F.lit("auto"),
            "resolution_method": F.lit("single_engine"),
        }
    ).withColumnRenamed("candidate_id", "fact_id")


def union_engines(parts: list[DataFrame]) -> DataFrame:
    """Candidates of several engines; at least one engine must have given some."""
    if not parts:
        raise ValueError("No engine produced candidates")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- run log


def ingest_summary(pages: DataFrame, tables: DataFrame, rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per report and engine: pages, tables, rows, cells, flow and stock facts, with the JSON of the run log."""
    by = ["report_id", "engine"]
    n_pages = pages.groupBy(*by).agg(F.count("*").alias("pages"))
    widths = tables.select(*KEY, F.size("columns").alias("w"))
    per_table = rows.groupBy(*KEY).agg(F.count("*").alias("n"))
    shape = widths.join(per_table, KEY, "left").groupBy(*by).agg(
        F.count("*").alias("tables"),
        F.sum(F.coalesce("n", F.lit(0))).alias("rows"),
        F.sum(F.coalesce("n", F.lit(0)) * F.col("w")).alias("cells"),
    )
    facts = candidates.groupBy(*by).agg(
        F.count_if(F.col("fact_type") == "flow").alias("flow_facts"),
        F.count_if(F.col("fact_type") == "stock").alias("stock_facts"),
    )
    names = ["pages", "tables", "rows", "cells", "flow_facts", "stock_facts"]
    joined = n_pages.join(shape, by, "left").join(facts, by, "left").select(
        *by, *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )
    return joined.withColumn("summary_json", F.to_json(F.struct(*names)))


def quarantine(df: DataFrame, error: Column, source: str, stage_name: str) -> tuple[DataFrame, DataFrame]:
    """Split rows into good ones and error-log rows (source_path, stage, error_type, error_message)."""
    marked = df.withColumn("_error", error)
    bad = marked.filter("_error IS NOT NULL").select(
        F.col(source).cast("string").alias("source_path"),
        F.lit(stage_name).alias("stage"),
        F.lit("ValueError").alias("error_type"),
        F.col("_error").alias("error_message"),
    )
    return marked.filter("_error IS NULL").drop("_error"), bad
