"""Operators that follow each other, and chains without a bound."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallyweave.operators import consensus, dictionary, matching, registry
from tallyweave.sources import files


def test_dictionary_round_trip(spark, tmp_path):
    metrics = matching.base_metrics(spark)
    path = str(tmp_path / "metrics")
    files.write_metrics(metrics, path)
    back = files.read_metrics(spark, path)
    assert back.count() == metrics.count() == 141
    order = lambda df: [r.metric_code for r in df.orderBy("def_order").collect()]
    assert order(back) == order(metrics)


def test_long_parent_chain(spark):
    chain = spark.range(0, 100).select(
        F.concat(F.lit("m"), "id").alias("metric_code"), F.when(F.col("id") > 0, F.concat(F.lit("m"), F.col("id") - 1)).alias("parent_metric_code")
    )
    found = dictionary.ancestors(chain)
    assert found.count() == 99 * 100 // 2 and found.agg(F.max("distance")).first()[0] == 99


def test_reviews_follow_each_other(spark):
    day = datetime.date(2024, 12, 31)
    facts = spark.createDataFrame(
        [(i, 1, "stock", i, None, None, day, None, "5", None, "CNY", None, 9, "auto", "agree") for i in (1, 2, 3)],
        "fact_id long, report_id long, fact_type string, metric_id long, period_start_date date, period_end_date date, as_of_date date, "
        "consolidation_scope string, value string, unit string, currency string, audit_flag string, selected_candidate_id long, "
        "resolution_status string, resolution_method string",
    )
    schema = (
        "report_id long, fact_type string, metric_id long, period_start_date date, period_end_date date, as_of_date date, "
        "consolidation_scope string, value string, unit string, currency string, audit_flag string, reviewed_by string, review_notes string, input_order long"
    )
    override = lambda code, who: spark.createDataFrame([(1, "stock", code, None, None, day, None, "7", None, None, None, who, "n", 0)], schema)
    once = consensus.apply_overrides(facts, override(1, "ann"))
    candidates = spark.createDataFrame([(40, "8", None, "CNY")], "candidate_id long, value string, unit string, currency string")
    picks = spark.createDataFrame([(2, 40, "bob", "p", 0)], "fact_id long, candidate_id long, reviewed_by string, review_notes string, input_order long")
    twice = consensus.apply_overrides(consensus.apply_picks(once, candidates, picks), override(3, "eve"))
    assert {r.fact_id: (r.value, r.reviewed_by) for r in twice.collect()} == {1: ("7", "ann"), 2: ("8", "bob"), 3: ("7", "eve")}


def test_queries_are_trimmed_of_all_white_space(spark):
    rows = spark.createDataFrame([("s", "user", "\t\n hello \n", 1)], "session_id string, role string, content string, ts long")
    assert registry.latest_user_query(rows).first()["query"] == "hello"


def test_taxonomy_creates_metrics_from_the_readers_output(spark):
    metrics = matching.base_metrics(spark)
    entry = lambda n: ("f.xml", n, n)
    rows = [("NewBalance", "资产负债表特别项目", "zh", "cas", entry(90_000_000_000)), ("NewFlow", "现金流量表特别项目", "zh", "cas", entry(5))]
    labels = spark.createDataFrame(rows, "concept string, label string, lang string, source string, entry_order struct<file:string,arc_no:bigint,label_no:bigint>")
    merged = dictionary.merge_labels(metrics, labels, create=True)
    known = metrics.agg(F.max("def_order")).first()[0]
    made = merged.filter(F.col("def_order") > known).orderBy("def_order").collect()
    assert [r.metric_name_cn for r in made] == ["现金流量表特别项目", "资产负债表特别项目"] and merged.count() == metrics.count() + 2


def test_base_codes_follow_loaded_ones_of_any_order(spark):
    base = matching.base_metrics(spark)
    loaded = base.limit(1).withColumns({"metric_code": F.lit("own"), "def_order": F.lit(90_000_000_000)})
    merged = matching.merge_metrics(base, loaded)
    assert merged.orderBy("def_order").first()["metric_code"] == "own" and merged.count() == base.count() + 1


def test_questions_take_the_last_write(spark):
    schema = "qa_id string, doc_id string, question string, answer string, raw_json string, created_at int"
    stored = spark.createDataFrame([("a", "d", "q", "old", None, 9), ("b", "d", "q", "kept", None, 9)], schema)
    incoming = spark.createDataFrame([("a", "d", "q", "one", None, 5, 1), ("a", "d", "q", "two", None, 5, 2)], schema + ", n int")
    got = {r.qa_id: (r.answer, r.created_at) for r in registry.upsert_questions(stored, incoming, "n").collect()}
    assert got == {"a": ("two", 5), "b": ("kept", 9)}
