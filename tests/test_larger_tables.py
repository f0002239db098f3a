"""Faults that only larger tables showed, on small inputs that have the same trait."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyweave.functions import recognise as R
from tallyweave.operators import chunking as K
from tallyweave.operators import consensus as C
from tallyweave.operators import containment as O
from tallyweave.operators import dictionary as J
from tallyweave.operators import matching as M
from tallyweave.operators import quality as Q
from tallyweave.operators import retrieval as S
from tallyweave.operators import tables as T
from tallyweave.plans import derive as D


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_labels_of_all_parts_are_not_broadcast(spark):
    plan = plan_of(entry.queries()["contents_counts"](spark, SMALL))
    keys = re.findall(r"BroadcastHashJoin \[(\w+)#", plan)
    assert not {"norm", "metric_code", "o_custkey"} & set(keys), keys


def test_years_are_not_read_from_names_and_codes(spark):
    year = lambda text: T.report_metadata(
        spark.createDataFrame([(1, "text", 1, text, text)], "report_id int, engine string, page int, text_raw string, text_md string")
    ).first()["fiscal_year"]
    assert year("公司名称：C72047\n2024年年度报告\n截至2024年12月31日") == 2024
    assert year("证券代码：002024\nFY2023") == 2023
    assert year("公司名称：甲 2022年年度报告") == 2022


def test_base_only_codes_keep_a_fixed_first_number(spark):
    base = M.base_metrics(spark).limit(2)
    loaded = base.withColumns({"metric_code": F.concat(F.lit("own_"), "metric_code"), "def_order": F.col("def_order") + 1_500_000})
    number = lambda *first: {r["metric_code"]: r["def_order"] for r in M.merge_metrics(base, loaded, *first).collect()}
    known = {r["metric_code"]: r["def_order"] for r in base.collect()}
    fixed, free = number(1_000_000), number()
    assert all(fixed[c] == 1_000_000 + n and fixed[f"own_{c}"] == 1_500_000 + n for c, n in known.items())
    assert min(free[c] for c in known) > max(n for c, n in free.items() if c not in known)


def test_a_shared_code_makes_a_metric_only_for_its_free_record(spark):
    records = spark.createDataFrame(
        [(1, "total_assets", "000001", "甲项", ""), (1_000_001, None, "000001", "乙项", "")],
        "record_order int, metric_code string, sub_code string, sub_name string, sub_name_raw string",
    )
    rows = spark.createDataFrame([(1, "[000001] 丙项"), (1_000_001, "[000001] 丙项")], "row_id int, label string")
    income = lambda *own: {r["row_id"]: r["match_income"] for r in M.match_labels(rows, M.base_metrics(spark), "label", records, *own).collect()}
    assert income("row_id") == {1: None, 1_000_001: "cas2020_000001"}
    assert income() == {1: "cas2020_000001", 1_000_001: "cas2020_000001"}


def test_candidates_are_dealt_by_key_once(spark):
    facts = plan_of(C.consensus_facts(D.all_candidates(spark, SMALL), D.versions(spark)))
    assert facts.count("Exchange hashpartitioning") == 1, facts


def test_hot_keys_give_the_same_facts(spark, monkeypatch):
    candidates, versions = D.all_candidates(spark, SMALL), D.versions(spark)
    results = lambda: [
        sorted(map(str, f.collect()))
        for f in (C.consensus_facts(candidates, versions), C.discrepancies(candidates, versions, C.consensus_facts(candidates, versions)))
    ]
    cold = results()
    monkeypatch.setattr(C, "HOT_ROWS", 3)
    keyed = C.with_engines(candidates, versions).withColumn("key_hash", F.xxhash64(*C.FACT_KEY))
    assert 0 < len(C.hot_keys(keyed)) < keyed.select("key_hash").distinct().count()
    assert results() == cold


def test_phrases_of_one_name_and_a_number_meet_few_texts(spark, monkeypatch):
    phrases = spark.range(3000).selectExpr("concat('largering', lpad(bin(id), 12, '0')) AS phrase")
    texts = spark.range(3000).selectExpr("concat('rowlargering', lpad(bin(id), 12, '0'), 'of', id % 7) AS text")
    found = O.contained(texts, phrases)
    assert found.columns == ["text", "phrase"] and found.count() == found.distinct().count() == 3000
    monkeypatch.setattr(O.F, "contains", lambda text, phrase: F.lit(True))
    assert 3000 <= O.contained(texts, phrases).count() <= 6000


def test_rows_of_a_single_group_stay_where_they_are(spark):
    found = Q.nearest_rank(spark.range(1001).selectExpr("id * 37 % 1001 AS v"), "v", 75)
    plan = plan_of(found)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastNestedLoopJoin") == 4, plan
    assert found.collect() == [(750,)] and not Q.nearest_rank(spark.range(0), "id", 75).collect()


def test_vectors_of_a_batch_are_put_together_once(spark):
    docs = spark.range(0, 10000, 1, 1).selectExpr("id", "'One is. Two is. Three is. Four is.' AS text")

    def took(n: int) -> float:
        start = time.time()
        made = K.embed_sentences(docs.limit(n), lambda texts: [[1.0] * 64 for _ in texts], 64, batch=1)
        vecs, sents = made.select(F.sum(F.size("vecs")), F.sum(F.size("sents"))).first()
        assert vecs == sents >= n
        return time.time() - start

    took(10)
    assert took(10000) < 30


def test_a_cell_is_searched_for_its_number_once(spark):
    texts = ["", "a", "1,234.50", "(7)", "(-7)", "(7", "7)", "( 7 )", "2024年", "-3.25", "12.5%", None, "9" * 3 + ",999" * 12]
    cells = spark.createDataFrame([(t,) for t in texts], "t string")
    found = cells.select(R.first_number(F.col("t")).alias("v"))
    shown = [None if r.v is None else float(r.v) for r in found.collect()]
    assert shown == [None, None, 1234.5, -7.0, 7.0, None, None, 7.0, None, -3.25, None, None, None]
    assert plan_of(found).count("regexp_extract") == 1


def test_postings_of_single_keys_shuffle_no_word(spark):
    rows = [(1, "b a b"), (2, None), (3, ""), (None, "a"), (4, "A-c")]
    docs = spark.createDataFrame(rows, "doc long, text string")
    index = S.postings(docs, "doc")
    assert "hashpartitioning" not in plan_of(index)
    want = {("a", 1, 1, (1,)), ("b", 1, 2, (0, 2)), ("a", None, 1, (0,)), ("a", 4, 1, (0,)), ("c", 4, 1, (1,))}
    read = lambda frame: {(r["term"], r["doc"], r["tf"], tuple(r["positions"])) for r in frame.collect()}
    assert read(index) == want and index.count() == len(want)
    twice = S.postings(docs.union(spark.createDataFrame([(1, "c a"), (None, "d")], docs.schema)), "doc")
    assert read(twice) == want - {("a", 1, 1, (1,)), ("a", None, 1, (0,))} | {("a", 1, 2, (1, 1)), ("c", 1, 1, (0,)), ("a", None, 1, (0,)), ("d", None, 1, (0,))}


def test_a_term_search_keeps_only_postings_of_asked_terms(spark, monkeypatch):
    kept = {}
    real = S.materialize

    def noted(frame, purpose):
        kept[purpose] = real(frame, purpose)
        return kept[purpose]

    monkeypatch.setattr(S, "materialize", noted)
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "doc long, text string")
    found = S.term_search(S.postings(docs, "doc"), spark.createDataFrame([(1, "Word7 common")], "query_id long, query string"), "doc")
    assert [tuple(r) for r in found.collect()] == [(1, 7, 2)]
    assert {r["term"] for r in kept["posting-blocks"].collect()} == {"word7", "common"}


def test_label_rows_come_from_dealt_metrics(spark):
    rows = J.metric_labels(D.part_metrics(spark, SMALL), ("metric_name_cn", "metric_name_en"))
    plan = plan_of(rows)
    assert "REBALANCE" in plan and plan.index("Generate posexplode") < plan.index("REBALANCE")


def test_a_taxonomy_is_mapped_once(spark):
    merged = J.merge_labels(D.part_metrics(spark, SMALL), D.taxonomy_labels(spark, SMALL), create=True)
    assert plan_of(merged).count("FileScan parquet [l_orderkey") == 1


def test_picks_name_their_facts_without_a_join(spark):
    plan = plan_of(entry.queries()["resolve_picks"](spark, SMALL))
    assert plan.count("REPARTITION_BY_COL") == 1 and "f_metric_id" not in plan


def test_dealt_tasks_hold_a_bounded_number_of_candidates(spark, monkeypatch):
    candidates, versions = D.all_candidates(spark, SMALL), D.versions(spark)
    n, facts = candidates.count(), lambda: C.consensus_facts(candidates, versions)
    few = sorted(map(str, facts().collect()))
    monkeypatch.setattr(C, "TASK_ROWS", 500)
    made = facts()
    assert re.findall(r"hashpartitioning\(key_hash#\d+L, (\d+)\)", plan_of(made)) == [str(-(-n // 500))]
    assert sorted(map(str, made.collect())) == few


def test_lines_of_text_tables_are_neither_shuffled_nor_written(spark, monkeypatch):
    monkeypatch.setattr(T, "materialize", lambda frame, purpose: 1 / 0)
    plan = plan_of(entry.queries()["text_table_rows"](spark, SMALL))
    assert plan.count("Exchange") == 1 and "Join" not in plan, plan


def test_text_tables_of_whole_reports_equal_those_of_blocks(spark, monkeypatch):
    rnd = random.Random(7)
    kinds = ["", "标题文字", "资产负债表", "利润表 8 9", "货币资金 1 2", "存货 3", "利润 4 5 (6)", "2024年度", "100 200", "营业收入 7.5 8%"]
    rows = [
        (r if r < 7 else None, e, p, "\n".join(rnd.choice(kinds) for _ in range(rnd.randint(1, 9))))
        for r in range(8) for e in ("text", None if r == 3 else "layout") for p in range(1, 150, 1 + r % 4)
    ]
    rows += [x for x in rows if x[0] in (1, 2) and x[2] % 3 == 0] + [(4, "text", None, "标题 2024年"), (5, "text", 1000, None)]
    pages = spark.createDataFrame([(*x, x[3]) for x in rows], "report_id int, engine string, page int, text_raw string, text_md string")
    read = lambda frame: Counter(map(str, frame.collect()))
    tables, body = T._block_tables(pages, M.base_patterns(), None)
    joined = body.join(tables, T.KEY).select(*T.KEY, "row_index", "label", "cells", "title", "columns", "statement_type", "page_end")
    want = [read(tables), read(body), read(joined)]
    assert len(want[0]) > 50 and max(want[0].values()) > 1 and max(want[2].values()) > max(want[1].values())
    for hot in (T.HOT_PAGES, 60):
        monkeypatch.setattr(T, "HOT_PAGES", hot)
        tables, body = T.text_tables(pages, M.base_patterns())
        wide = T.text_tables(pages, M.base_patterns(), with_table=True)[1]
        wide = wide.select(*T.KEY, "row_index", "label", "cells", "table.title", "table.columns", "table.statement_type", "table.page_end")
        assert [read(tables), read(body), read(wide)] == want


def test_discrepancies_and_facts_come_out_of_one_narrow_shuffle(spark, tmp_path):
    found = entry.queries()["discrepancies"](spark, SMALL)
    moved = re.findall(r"Exchange hashpartitioning\((.*?), REPARTITION_BY_NUM", plan_of(found))
    assert len(moved) == 2 and "Exchange hashpartitioning" not in re.sub(r"Exchange hashpartitioning\((.*?), REPARTITION_BY_NUM", "", plan_of(found))
    rows = found.collect()
    ran = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ran.count("ReusedExchange") >= 1 and len(rows) == len(set(rows)) > 0


def test_discrepancies_with_null_keys_hot_keys_and_any_facts(spark, monkeypatch):
    rnd = random.Random(3)
    day = lambda: rnd.choice([None, "2024-12-31"])
    word = lambda *words: rnd.choice([None, *words])
    rows = [
        (i % 170, word(1, 2), rnd.choice([1, 2, 3, None]), word("flow", "stock"), word(1), None, day(), day(), rnd.choice([None, 1.0, 2.0, 2.004]), word("1"), "CNY", None, None, "col_1", word(0.5))
        for i in range(400)
    ]
    schema = (
        "candidate_id long, report_id long, version_id long, fact_type string, metric_id long, period_start_date string, period_end_date string, as_of_date string, "
        "value double, unit string, currency string, consolidation_scope string, audit_flag string, column_label string, quality_score double"
    )
    candidates = spark.createDataFrame(rows, schema).withColumn("value", F.col("value").cast("decimal(38,6)"))
    versions = D.versions(spark)
    said = {}
    for x in rows:
        at = (x[1], x[3], x[4], x[5], x[6], x[7], x[9], x[10], x[11])
        engine = {1: "text", 2: "layout", 3: "version_3"}.get(x[2]) or f"candidate_{x[0]}"
        value = "null" if x[8] is None else f"{x[8]:.2f}"
        said.setdefault(at, {}).setdefault((engine, value), []).append(x[0])
    agree = {at: max(len({e for e, w in v if w == value}) for _, value in v) for at, v in said.items()}
    want = Counter(
        (*at, *key, len(ids), min(ids), "auto", "consensus" if agree[at] > 1 else "single_engine")
        for at, v in said.items() if len({w for _, w in v}) > 1 for key, ids in v.items()
    )
    read = lambda frame: Counter(map(tuple, frame.collect()))
    for hot in (C.HOT_ROWS, 3):
        monkeypatch.setattr(C, "HOT_ROWS", hot)
        sizes = C.dealing(candidates)
        assert bool(sizes[1]) == (hot == 3)
        assert read(C.discrepancies(candidates, versions, C.consensus_facts(candidates, versions))) == want
        assert read(C.discrepancies(candidates, versions, C.consensus_facts(candidates, versions, sizes=sizes), sizes=sizes)) == want
        assert read(C.discrepancies(candidates, versions)) == Counter({k[:-2]: n for k, n in want.items()})
        assert sum(read(C.discrepancies(candidates, versions, C.consensus_facts(candidates, versions).limit(0))).values()) == len(want)
