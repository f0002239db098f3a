"""Consensus, identities, overrides, evaluation and dictionary jobs on small inputs."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import consensus as C
from tallyweave.operators import dictionary as J
from tallyweave.operators import facts as H
from tallyweave.operators import matching as M
from tallyweave.operators import quality as Q
from tallyweave.operators.ordered import running

CANDIDATES = (
    "candidate_id bigint, report_id bigint, version_id bigint, fact_type string, metric_id bigint, period_start_date date, "
    "period_end_date date, as_of_date date, value decimal(38,6), unit string, currency string, consolidation_scope string, "
    "audit_flag string, column_label string, quality_score double"
)
DAY = datetime.date(2024, 12, 31)


def candidate(i, version, value, label=None, quality=None, metric=1, unit=None):
    value = None if value is None else Decimal(str(value))
    return (i, 1, version, "stock", metric, None, None, DAY, value, unit, "CNY", None, None, label, quality)


def facts_of(spark, rows, versions, **options):
    frame = spark.createDataFrame(rows, CANDIDATES)
    known = spark.createDataFrame(versions, "version_id bigint, parse_method string")
    return C.consensus_facts(frame, known, **options)


def test_better_column_wins_within_one_engine(spark):
    got = facts_of(spark, [candidate(1, 1, 100, "col_2"), candidate(2, 1, 90, "col_1")], [(1, "text")]).first()
    assert (got["selected_candidate_id"], got["agree_count"], got["resolution_status"], got["resolution_method"]) == (2, 1, "auto", "single_engine")


def test_column_scores(spark):
    labels = ["col_1", "col_2", "2024", "2023", "本期", "上期", None, "Current", "其他"]
    rows = spark.createDataFrame([(l,) for l in labels], "l string").select("l", C.column_score(F.col("l")).alias("s")).collect()
    score = {r["l"]: r["s"] for r in rows}
    assert score == {"col_1": 999, "col_2": 998, "2024": 12024, "2023": 12023, "本期": 500, "上期": -500, None: 0, "Current": 500, "其他": 0}


def test_agreement_needs_engines_and_survives_nulls(spark):
    rows = [
        candidate(1, 1, 10.001), candidate(2, 2, 10.004), candidate(3, 1, 99), candidate(4, 1, 99), candidate(5, None, 7, metric=2),
        candidate(6, 9, 8, metric=2), candidate(7, 1, None, metric=3),
    ]
    got = {r["metric_id"]: r for r in facts_of(spark, rows, [(1, "text"), (2, "layout")], min_agree=2).collect()}
    assert (got[1]["agree_count"], got[1]["resolution_method"], got[1]["agreed"]) == (2, "consensus", True)
    assert got[2]["multi_engine"] and got[2]["resolution_status"] == "needs_review"
    assert got[3]["value"] is None


def test_value_key_rounds_half_up(spark):
    row = spark.sql("select cast(-2.345 as decimal(38,6)) a, cast(1000 as decimal(38,6)) b").select(
        C.value_key(F.col("a")).alias("a"), C.value_key(F.col("b")).alias("b")
    ).first()
    assert (row["a"], row["b"]) == ("-2.35", "1000.00")


def test_facts_do_not_depend_on_order_or_partitions(spark):
    rows = [candidate(i, i % 3 + 1, i % 4, f"col_{i % 5}", (i % 7) / 10 if i % 2 else None, metric=i % 6) for i in range(400)]
    versions = [(1, "text"), (2, "layout"), (3, None)]
    key = lambda df: sorted(map(str, df.drop("quality_score").collect()))
    first = key(facts_of(spark, rows, versions))
    again = spark.createDataFrame(rows[::-1], CANDIDATES).repartition(13)
    assert first == key(C.consensus_facts(again, spark.createDataFrame(versions, "version_id bigint, parse_method string")))


@pytest.mark.parametrize("fx, net, status", [(None, 75, "pass"), (-2.5, 72.5, "pass"), (-2.5, 75, "fail")])
def test_cashflow_identity(spark, fx, net, status):
    values = {"net_cash_flow_operating": 100, "net_cash_flow_investing": -40, "net_cash_flow_financing": 15, "net_increase_cash": net, "fx_effect_on_cash": fx}
    rows = [(1, i, c, DAY, Decimal(str(v)), "1", "CNY", None) for i, (c, v) in enumerate(values.items()) if v is not None]
    facts = spark.createDataFrame(rows, "report_id bigint, fact_id bigint, metric_code string, period_end_date date, value decimal(38,6), unit string, currency string, consolidation_scope string")
    got = C.cashflow_identity(facts).collect()
    assert [(r["name"], r["status"]) for r in got] == [("net_increase_eq_sum_cashflows", status)]


def test_sources_of_equity_and_fx(spark):
    metrics = M.base_metrics(spark)
    assert C.equity_source(metrics) == "total_equity"
    assert C.equity_source(metrics.filter("metric_code <> 'total_equity'")) == "total_equity_parent"
    assert C.fx_metric_code(metrics.limit(0)) is None


def test_overrides_validate_update_and_insert(spark):
    rows = [
        (0, 1, "stock", "a", None, None, DAY, None, "5", None, None, None, None, "n1"),
        (1, 1, "STOCK", "a", None, None, DAY, None, "6", "u", None, None, "eve", "n2"),
        (2, None, "stock", "b", None, DAY, None, "parent", "7", None, "USD", None, None, None),
        (3, 1, "stock", "zzz", None, None, DAY, None, "8", None, None, None, None, None),
        (4, 1, "other", "a", None, None, DAY, None, "8", None, None, None, None, None),
    ]
    schema = (
        "input_order bigint, report_id bigint, fact_type string, metric_code string, period_start_date date, period_end_date date, "
        "as_of_date date, consolidation_scope string, value string, unit string, currency string, audit_flag string, "
        "reviewed_by string, review_notes string"
    )
    metrics = spark.createDataFrame([("a", 1), ("b", 2)], "metric_code string, metric_id bigint")
    usable, rejected = C.prepare_overrides(spark.createDataFrame(rows, schema), metrics, report_id=9, reviewed_by="ann")
    assert sorted(r["reason"] for r in rejected.collect()) == ["Invalid fact_type: other", "Unknown metric_code: zzz"]
    facts = spark.createDataFrame(
        [(i, 1, "stock", 1, None, None, DAY, None, Decimal(1), u, "CNY", None, 5, "auto", "consensus") for i, u in ((10, "x"), (11, "y"))],
        "fact_id bigint, report_id bigint, fact_type string, metric_id bigint, period_start_date date, period_end_date date, as_of_date date, "
        "consolidation_scope string, value decimal(38,6), unit string, currency string, audit_flag string, selected_candidate_id bigint, "
        "resolution_status string, resolution_method string",
    )
    got = {r["fact_id"]: r for r in C.apply_overrides(facts, usable).collect()}
    wider = C.apply_overrides(facts.withColumn("quality_score", F.lit(0.5)), usable)
    assert {r["fact_id"]: (r["quality_score"], r["reviewed_at"] is not None) for r in wider.collect()} == {10: (0.5, True), 11: (0.5, False), None: (None, True)}
    assert len(got) == 3
    assert (got[10]["value"], got[10]["unit"], got[10]["currency"], got[10]["reviewed_by"], got[10]["review_notes"]) == (6, "u", "CNY", "eve", "n2")
    assert got[10]["selected_candidate_id"] is None and got[10]["resolution_method"] == "manual"
    assert (got[11]["value"], got[11]["resolution_method"]) == (1, "consensus")
    assert (got[None]["report_id"], got[None]["metric_id"], got[None]["as_of_date"], got[None]["reviewed_by"]) == (9, 2, DAY, "ann")


def test_running_values_over_blocks(spark):
    rows = [(g, i, (i * 7 + g) % 5) for g in range(3) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, i int, v int").repartition(7)
    out = running(
        df, ["g"], ["i"],
        {"total": ("sum", F.col("v")), "last_zero": ("max", F.when(F.col("v") == 0, F.struct("i", "v")))},
        F.col("i"), block_rows=8, levels=3,
    ).collect()
    want = {}
    for g in range(3):
        total, zero = 0, None
        for i in range(500):
            v = (i * 7 + g) % 5
            total += v
            zero = i if v == 0 else zero
            want[g, i] = (total, zero)
    assert {(r["g"], r["i"]): (r["total"], r["last_zero"]["i"] if r["last_zero"] else None) for r in out} == want


def test_nearest_rank(spark):
    values = [((i * 7919) % 1000) ** 3 / 7 for i in range(2500)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v double, g int")
    for p in (0, 5, 50, 95, 100):
        got = Q.nearest_rank(df, "v", p).collect()
        ordered = sorted(values)
        assert [r[0] for r in got] == [ordered[round(p / 100 * (len(values) - 1))]]
    by_group = {r["g"]: r["p95"] for r in Q.nearest_rank(df, "v", 95, ("g",)).collect()}
    for g in range(3):
        ordered = sorted(v for i, v in enumerate(values) if i % 3 == g)
        assert by_group[g] == ordered[round(0.95 * (len(ordered) - 1))]


def test_nearest_rank_of_odd_values(spark):
    values = [-0.0, 0.0, -1.5, -1e-310, 1e308, float("inf"), float("-inf"), None, 3.0, 3.0, -7.25]
    df = spark.createDataFrame([(v, None if i % 2 else "a", i - 5, 1) for i, v in enumerate(values)], "v double, g string, w long, _rank int")
    ordered = sorted(v for v in values if v is not None)
    for p in (0, 10, 33, 50, 90, 100):
        assert [r[0] for r in Q.nearest_rank(df, "v", p).collect()] == [ordered[round(p / 100 * (len(ordered) - 1))]]
        assert [r[0] for r in Q.nearest_rank(df, "w", p).collect()] == [list(range(-5, 6))[round(p / 100 * 10)]]
    by_group = {r["g"]: r["p50"] for r in Q.nearest_rank(df, "w", 50, ("g",)).collect()}
    assert by_group == {"a": -1, None: 0}  # a null group is a group
    dated = df.selectExpr("date_add(date'1970-01-01', int(w)) d", "cast(w / 3 as decimal(18,4)) m", "timestamp_micros(w * 1000000000000) t")
    for name in ("d", "m", "t"):
        want = sorted(r[0] for r in dated.select(name).collect())[round(0.3 * 10)]
        assert Q.nearest_rank(dated, name, 30).first()[0] == want
    assert not Q.nearest_rank(df.filter("v is null and w > 100"), "v", 50).count()


def test_match_quality_counts(spark):
    rows = [("a", "a", True), ("a", "b", True), ("a", None, True), (None, None, True), (None, "x", False)]
    got = {r["split"]: r for r in Q.match_quality(spark.createDataFrame(rows, "expected string, predicted string, required boolean")).collect()}
    every = got["all_cases"]
    assert (every["tp"], every["fp"], every["fn"], every["tn"], every["exact_match"]) == (1, 1, 2, 1, 2)
    assert got["optional_only"]["false_positive_rate_on_negatives"] == 1.0
    gates = {r["split"]: r["passed"] for r in Q.match_gates(Q.match_quality(spark.createDataFrame(rows, "expected string, predicted string, required boolean"))).collect()}
    assert not any(gates.values())


def test_contents_aliases_complete_the_dictionary(spark):
    toc = spark.createDataFrame(
        [(1, "CAS21", "租赁", "821110", "使用权资产", "附注_使用权资产（已执行新准则）"), (2, "CAS14", "收入", "837270", "合同资产", "附注_合同资产（已执行新准则）")],
        "row_order int, cas_code string, cas_name string, sub_code string, sub_name string, sub_name_raw string",
    )
    merged, records = J.merge_contents(M.base_metrics(spark), toc, create=True)
    methods = {r["sub_code"]: (r["metric_code"], r["mapping_method"], r["confidence"]) for r in records.collect()}
    assert methods["821110"][:2] == ("right_of_use_assets", "unique_name")
    assert methods["837270"] == ("contract_assets", "override_create", 0.95)
    labels = ["合同资产", "附注_合同资产（已执行新准则）", "[821110] 附注_使用权资产（已执行新准则）"]
    rows = spark.createDataFrame([(l,) for l in labels], "label string")
    got = {r["label"]: r["match_income"] or r["match_balance"] for r in M.match_labels(rows, merged, "label").collect()}
    assert got[labels[2]] == "right_of_use_assets" and got[labels[0]] == "contract_assets"


def test_ancestors_stop_at_cycles(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "metric_code string, parent_metric_code string")
    with pytest.raises(ValueError):
        J.ancestors(loop)


def test_quarantine_and_sync_state(spark):
    df = spark.createDataFrame([("p1", 1), ("p2", None)], "path string, n int")
    good, bad = H.quarantine(df, F.when(F.col("n").isNull(), F.lit("no pages")), "path", "parse")
    assert good.count() == 1 and bad.first()["error_message"] == "no pages"
    state = spark.createDataFrame([(1, "abc")], "state_id int, file_hash string")
    assert not J.needs_sync(state, "abc") and J.needs_sync(state, "abd") and J.needs_sync(state, "abc", force=True)


def test_written_facts_replace_only_their_reports(spark, tmp_path):
    path = str(tmp_path / "facts")
    frame = lambda rows: spark.createDataFrame(rows, "report_id bigint, value int")
    now = lambda: sorted(((r["report_id"], r["value"]) for r in C.read_facts(spark, path).collect()), key=repr)
    C.write_facts(frame([(1, 10), (2, 20), (3, 30), (None, 0)]), path)
    first = {p.name for p in (tmp_path / "facts" / "facts").iterdir()}
    C.write_facts(frame([(1, 11), (1, 12)]), path)
    assert now() == [(1, 11), (1, 12), (2, 20), (3, 30), (None, 0)]
    second = {p for p in (tmp_path / "facts" / "facts").iterdir() if p.name not in first}
    assert spark.read.parquet(*map(str, second)).count() == 2  # only the report's rows were written
    C.write_facts(frame([(2, 21)]), path, replace=False)
    C.write_facts(frame([]), path)
    assert now() == [(1, 11), (1, 12), (2, 20), (2, 21), (3, 30), (None, 0)]
    # a write that ends before its log counts for nothing
    frame([(3, 99)]).write.parquet(f"{path}/facts/fact_version=vlost")
    assert (3, 99) not in now() and (3, 30) in now()
    assert C.superseded_versions(spark, path).count() == 0
    C.write_facts(frame([(1, 1)]), path)
    assert C.superseded_versions(spark, path).count() == 1


def test_metrics_of_taxonomy_records(spark):
    records = spark.createDataFrame([(0, None, "837460", "特别资产", "附注_特别资产")], "record_order int, metric_code string, sub_code string, sub_name string, sub_name_raw string")
    trace = lambda i, label: ("t", i, 1, label)
    rows = [(1, "cas2020_837460", "balance", "1", trace(0, "[837460] 特别资产余")), (2, "raw_1", "income", "1", trace(1, "神秘"))]
    candidates = spark.createDataFrame(rows, "report_id bigint, metric_code string, metric_statement string, unit string, source_trace struct<table_key:string,row_index:int,page:int,raw_label:string>")
    got = {r["metric_code"]: (r["metric_name"], r["value_nature"]) for r in H.candidate_metrics(candidates, M.base_metrics(spark), records).collect()}
    assert got == {"cas2020_837460": ("特别资产", "stock"), "raw_1": ("神秘", "flow")}
