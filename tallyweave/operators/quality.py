"""Evaluation: label matching, extraction quality, thresholds, percentiles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.labels import STATEMENTS
from tallyweave.operators.stage import local_table, materialize
from tallyweave.operators.tables import KEY

# Declared quality indicators with their thresholds and scopes.
KPI_THRESHOLDS = (
    ("evidence_link_rate", 1.0, "report"),
    ("required_field_presence", 0.98, "report"),
    ("table_extraction_success_rate", 0.90, "dataset"),
    ("column_alignment_accuracy", 0.95, "table"),
    ("unit_currency_detection_rate", 0.95, "table"),
    ("period_detection_rate", 0.95, "report"),
    ("integrity_checks_pass_rate", 0.98, "report"),
)
MIN_EXACT_RATE, MAX_FALSE_POSITIVE_RATE = 0.90, 0.10


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def match_quality(cases: DataFrame, splits: bool = True) -> DataFrame:
    """Confusion figures of cases(expected, predicted, required), for required, optional and all.

    A wrong non-NULL prediction counts as a miss only.
    """
    expected, predicted = F.col("expected"), F.col("predicted")
    aggs = [
        F.count("*").alias("total"),
        F.count_if(expected.eqNullSafe(predicted)).alias("exact_match"),
        F.count_if(expected == predicted).alias("tp"),
        F.count_if(expected.isNull() & predicted.isNotNull()).alias("fp"),
        F.count_if(expected.isNotNull() & ~expected.eqNullSafe(predicted)).alias("fn"),
        F.count_if(expected.isNull() & predicted.isNull()).alias("tn"),
    ]
    grouped = cases.cube("required").agg(F.grouping("required").alias("_all"), *aggs) if splits else cases.agg(*aggs)
    name = F.when(F.col("_all") == 1, "all_cases").when(F.col("required"), "required").otherwise("optional_only") if splits else F.lit("all_cases")
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return grouped.select(
        name.alias("split"), "total", "exact_match", "tp", "fp", "fn", "tn",
        ratio(F.col("exact_match"), F.col("total")).alias("exact_match_rate"),
        precision.alias("positive_precision"),
        recall.alias("positive_recall"),
        ratio(2 * precision * recall, precision + recall).alias("positive_f1"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_rate_on_negatives"),
    )


def match_errors(cases: DataFrame) -> DataFrame:
    return cases.filter(~F.col("expected").eqNullSafe(F.col("predicted")))


def match_gates(quality: DataFrame) -> DataFrame:
    """Pass or fail of each split against the accepted rates."""
    good = (F.col("exact_match_rate") >= MIN_EXACT_RATE) & (
        F.col("false_positive_rate_on_negatives") <= MAX_FALSE_POSITIVE_RATE
    )
    return quality.select("split", "exact_match_rate", "false_positive_rate_on_negatives", good.alias("passed"))


def extraction_quality(reports: DataFrame, tables: DataFrame, matched_rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Rates over all reports in one row.

    reports(report_id, ok, parse_time), extractor outputs, and ``matched_rows``
    = rows with the ``match_*`` columns: a row counts as matched if any
    statement knows its label.
    """
    docs = reports.agg(F.count("*").alias("n_docs"), F.count_if("ok").alias("n_ok"))
    per_table = matched_rows.groupBy(*KEY).agg(F.count("*").alias("n"))
    shape = tables.join(per_table, KEY, "left").agg(
        F.count("*").alias("tables_total"),
        F.count_if((F.coalesce("n", F.lit(0)) >= 2) & (F.size("columns") >= 2)).alias("n_valid"),
        F.count("statement_type").alias("n_statement"),
        F.count("units").alias("n_units"),
        F.count("currency").alias("n_currency"),
    )
    known = F.coalesce(*[F.col(f"match_{s}") for s in STATEMENTS]).isNotNull()
    rows = matched_rows.agg(
        F.count("*").alias("rows_total"),
        F.sum(F.size("cells")).alias("cells_total"),
        F.sum(F.size(F.filter("cells", lambda c: c["value"].isNotNull()))).alias("n_numeric"),
        F.count_if(known).alias("n_matched"),
    )
    fields = meta.agg(
        F.count("*").alias("n_meta"), F.count("currency").alias("m_currency"), F.count("units").alias("m_units"),
        F.count("period_end").alias("m_period"),
    )
    one = side_by_side([docs, shape, rows, fields])
    r = lambda a, b: ratio(F.coalesce(F.col(a), F.lit(0)), F.col(b))
    return one.select(
        r("n_ok", "n_docs").alias("doc_success_rate"),
        "tables_total",
        r("n_valid", "tables_total").alias("table_success_rate"),
        r("n_statement", "tables_total").alias("statement_table_rate"),
        r("n_units", "tables_total").alias("table_unit_rate"),
        r("n_currency", "tables_total").alias("table_currency_rate"),
        "rows_total",
        F.coalesce("cells_total", F.lit(0)).alias("cells_total"),
        r("n_numeric", "cells_total").alias("numeric_cell_rate"),
        r("n_matched", "rows_total").alias("core_metric_match_rate"),
        r("m_currency", "n_meta").alias("meta_currency_rate"),
        r("m_units", "n_meta").alias("meta_units_rate"),
        r("m_period", "n_meta").alias("meta_period_end_rate"),
    )


DIGIT = 16  # bits of a key that one round of nearest_rank decides


def ordered_key(df: DataFrame, value: str) -> Column:
    """A long that orders as the column does: its own value, or the bits of a double with those of negative ones turned round."""
    kind = df.schema[value].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(value).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.DecimalType):
        if kind.precision > 18:
            raise TypeError(f"{value}: a decimal of {kind.precision} digits has no key of 64 bits")
        return (F.col(value) * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long")

    @F.pandas_udf("long")
    def bits(values: pd.Series) -> pd.Series:
        whole = (values.to_numpy(np.float64) + 0.0).view(np.int64)
        return pd.Series(np.where(whole < 0, whole ^ np.int64(0x7FFFFFFFFFFFFFFF), whole))

    return bits(F.col(value).cast("double"))


def nearest_rank(df: DataFrame, value: str, p: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Value at rank round(p/100·(n−1)), halves to the even rank; no interpolation.  Nulls are left out.

    Values become 64-bit keys of the same order.  Each of four rounds counts the
    keys of a group by their next 16 bits, with partial sums, and goes on with the
    keys in the one bucket that holds the rank.  A task never sees a group's
    values in order, only its at most 65,536 counts, so one group may hold all rows
    and there may be any number of groups.
    """
    known = df.filter(F.col(value).isNotNull())
    keys = ["_one", *by]
    rows = known.select(F.lit(1).alias("_one"), *by, F.col(value).alias("_value"), ordered_key(known, value).alias("_key"))
    rows = materialize(rows, "ranked-values").alias("x")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    rank = F.bround(F.lit(p / 100.0) * (F.col("_n") - 1), 0).cast("long")
    chosen = sizes.select(*keys, F.greatest(F.lit(0), F.least(F.col("_n") - 1, rank)).alias("_rank"), F.lit(None).cast("long").alias("_prefix"))
    walk = Window.partitionBy(*keys).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    for shift in range(64 - DIGIT, -1, -DIGIT):
        same = reduce(lambda a, b: a & b, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in keys])
        inside = F.col("_prefix").isNull() | (F.shiftright("_key", min(63, shift + DIGIT)) == F.col("_prefix"))
        # a single group is one row of chosen, which goes to the rows; joined by key, all rows would go to one task
        met = rows.join(chosen.alias("y"), same) if by else rows.crossJoin(F.broadcast(chosen.alias("y")))
        left = met.filter(inside)
        left = left.select(*[F.col(f"x.{c}").alias(c) for c in keys], "_rank", F.col("x._value").alias("_value"), F.shiftright("_key", shift).alias("_digit"))
        counts = left.groupBy(*keys, "_rank", "_digit").agg(F.count("*").alias("_c"), F.min("_value").alias("_low"))
        placed = counts.withColumn("_below", F.coalesce(F.sum("_c").over(walk), F.lit(0)))
        hit = placed.filter("_rank >= _below and _rank < _below + _c")
        chosen = hit.select(*keys, (F.col("_rank") - F.col("_below")).alias("_rank"), F.col("_digit").alias("_prefix"), "_low")
    return chosen.select(*by, F.col("_low").alias(f"p{p:g}"))


def side_by_side(frames: list[DataFrame]) -> DataFrame:
    """One-row frames with different columns as one row."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def kpi_thresholds(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(KPI_THRESHOLDS), "kpi string, threshold double, scope string")


def quality_kpis(measured: DataFrame) -> DataFrame:
    """measured(kpi, value) against the declared thresholds."""
    limits = kpi_thresholds(measured.sparkSession)
    return limits.join(measured, "kpi", "left").select(
        "kpi", "scope", "threshold", "value", (F.coalesce("value", F.lit(0.0)) >= F.col("threshold")).alias("passed")
    )


def kpi_values(meta: DataFrame, tables: DataFrame, rows: DataFrame, candidates: DataFrame, checks: DataFrame) -> DataFrame:
    """The declared indicators measured on extractor outputs, candidates and identity checks, as (kpi, value)."""
    one = lambda df, kpi, part, whole: df.agg(ratio(part, whole).cast("double").alias("value")).select(F.lit(kpi).alias("kpi"), "value")
    trace = F.col("source_trace.page").isNotNull() & F.col("source_trace.row_index").isNotNull()
    required = [F.count(c) for c in ("currency", "units", "period_end", "report_type")]
    with_tables = tables.select("report_id", "engine").distinct().withColumn("has_table", F.lit(True))
    reports = meta.join(with_tables, ["report_id", "engine"], "left")
    filled = F.size(F.filter("cells", lambda c: c["value"].isNotNull() | c["raw_text"].isNotNull()))
    aligned = rows.join(tables.select(*KEY, F.size("columns").alias("w")), KEY)
    parts = [
        one(candidates, "evidence_link_rate", F.count_if(trace), F.count("*")),
        one(meta, "required_field_presence", sum(required[1:], required[0]), F.count("*") * 4),
        one(reports, "table_extraction_success_rate", F.count("has_table"), F.count("*")),
        one(aligned, "column_alignment_accuracy", F.count_if(filled == F.col("w")), F.count("*")),
        one(tables, "unit_currency_detection_rate", F.count_if(F.col("units").isNotNull() & F.col("currency").isNotNull()), F.count("*")),
        one(meta, "period_detection_rate", F.count("period_end"), F.count("*")),
        one(checks, "integrity_checks_pass_rate", F.count_if(F.col("status") == "pass"), F.count("*")),
    ]
    return reduce(DataFrame.unionByName, parts)


def raw_label_share(candidates: DataFrame) -> DataFrame:
    """Share of candidates without a dictionary metric per engine and fact type."""
    raw = F.count_if(F.col("metric_code").startswith("raw_"))
    return candidates.groupBy("engine", "fact_type").agg(
        F.count("*").alias("n"), raw.alias("n_raw"), ratio(raw, F.count("*")).alias("raw_share")
    )


def hits_at_k(judged: DataFrame, k: int = 5) -> DataFrame:
    """judged(query_id, rank, relevant): share of queries with a relevant hit among the first k."""
    per_query = judged.groupBy("query_id").agg(F.max((F.col("rank") <= k) & F.col("relevant")).alias("hit"))
    return per_query.agg(
        F.count("*").alias("n_queries"), F.count_if("hit").alias("n_hit"), ratio(F.count_if("hit"), F.count("*")).alias("hits_at_k")
    )


def citation_coverage(citations: DataFrame) -> DataFrame:
    """Share of citations that name a source and a page."""
    full = F.col("source_path").isNotNull() & F.col("page").isNotNull()
    return citations.agg(F.count("*").alias("n"), ratio(F.count_if(full), F.count("*")).alias("coverage"))


def gold_scores(gold: DataFrame, predicted: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """Field accuracy and completeness of predicted values against gold values of the same keys."""
    both = gold.select(*keys, F.col("value").alias("g")).join(
        predicted.select(*keys, F.col("value").alias("p"), F.lit(True).alias("found")), keys, "left"
    )
    near = F.abs(F.col("g") - F.col("p")) <= tolerance
    return both.agg(
        F.count("*").alias("n_gold"),
        ratio(F.count("found"), F.count("*")).alias("completeness"),
        ratio(F.count_if(near), F.count("*")).alias("field_accuracy"),
        ratio(F.count_if(near), F.count("found")).alias("numeric_accuracy"),
    )
