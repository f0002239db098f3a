"""Recognisers, table extraction and matching on small report texts."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import labels as L
from tallyweave.functions import recognise as R
from tallyweave.operators import facts as H
from tallyweave.operators import matching as M
from tallyweave.operators import tables as T

PAGES = "report_id bigint, engine string, page int, text_raw string, text_md string"


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Revenue 1,234 (5,678) 9", [1234, -5678, 9]),
        ("货币资金1,000 900", [0, 900]),
        ("12.5% 3", [3]),
        ("1234567.89", []),
        ("(5 6)", [None, None]),
    ],
)
def test_numbers(spark, text, want):
    assert [None if c["value"] is None else int(c["value"]) for c in one(spark, text, R.numbers)] == want


def test_scalars(spark):
    assert one(spark, "Operating Income 12,345", R.strip_numbers) == "Operating Income"
    assert one(spark, "Amounts in USD", R.detect_currency) == "USD"
    assert one(spark, "Amounts in USD", R.detect_units) is None
    assert one(spark, "取得子公司及其他营业单位支付的现金净额 100", R.detect_units) is None
    day = datetime.date(2024, 12, 31)
    assert one(spark, "As of 2024-12-31", R.first_date) == day
    assert one(spark, "截至 2024 年 12 月 31 日", R.first_date) == day
    assert one(spark, "2024-13-45", R.first_date) is None
    rule = F.create_map(F.lit("230005a"), F.lit("balance_sheet"))
    assert one(spark, "ELR [230005a]", lambda c: R.detect_statement(c, rule)) == "balance_sheet"
    labels = one(spark, "For 2024 and 2023", lambda c: F.transform(T.guess_columns(c, F.lit(2)), lambda x: x["label"]))
    assert labels == ["2024", "2023"]
    assert one(spark, "cas2020_821110", L.english_name) == "Cas2020 821110"


def extract(spark, rows):
    tables, body = T.extract_tables(spark.createDataFrame(rows, PAGES), M.base_patterns())
    return tables.collect(), body.orderBy("report_id", "table_key", "row_index").collect()


def test_text_table(spark):
    text = "合并资产负债表\n项目 本期 上期\n货币资金 1,000 900\n存货 2,000 1,800"
    tables, rows = extract(spark, [(1, "text", 1, text, text)])
    assert len(tables) == 1 and tables[0]["statement_type"] == "balance_sheet"
    assert len(tables[0]["columns"]) == 2 and tables[0]["is_consolidated"]
    assert [r["label"] for r in rows] == ["货币资金", "存货"]


def test_html_comes_first_and_year_headers(spark):
    md = (
        "# 合并资产负债表\n<table><tr><td>项目</td><td>2024年度</td><td>2023年度</td></tr>"
        "<tr><td>货币资金</td><td>1,000</td><td>900</td></tr><tr><td>存货</td><td>2</td><td>3</td></tr>"
        "<tr><td>应收账款</td><td>4</td><td>(5)</td></tr></table>"
    )
    tables, rows = extract(spark, [(1, "layout", 1, "本期 100 200 元\n说明 300 400", md)])
    assert [c["fiscal_year"] for c in tables[0]["columns"]] == [2024, 2023]
    assert [r["label"] for r in rows] == ["货币资金", "存货", "应收账款"]
    assert rows[2]["cells"][1]["value"] == Decimal(-5)


def test_merged_header_cells(spark):
    md = (
        "# 利润表\n<table><tr><th rowspan=2>项目</th><th colspan=2>2024年度</th><th colspan=2>2023年度</th></tr>"
        "<tr><th>本期</th><th>上期</th><th>本期</th><th>上期</th></tr>"
        + "".join(f"<tr><td>{n}</td><td>1</td><td>2</td><td>3</td><td>4</td></tr>" for n in ("营业收入", "营业成本", "净利润"))
        + "</table>"
    )
    tables, _ = extract(spark, [(1, "layout", 1, "", md)])
    columns = tables[0]["columns"]
    assert len(columns) == 4 and columns[0]["fiscal_year"] == 2024 and columns[2]["fiscal_year"] == 2023
    assert columns[3]["label"] == "2023年度 上期"


def test_metadata(spark):
    text = "公司名称：测试股份有限公司\n2024年年度报告\n股票代码：123456\n截至2024年12月31日"
    meta = T.report_metadata(spark.createDataFrame([(1, "text", 1, text, text)], PAGES)).first()
    assert (meta["company_name"], meta["ticker"], meta["report_type"], meta["fiscal_year"]) == ("测试股份有限公司", "123456", "annual", 2024)
    assert meta["period_end"] == datetime.date(2024, 12, 31)


def walk_lines(pages):
    """Row runs found line by line: (page, line) lists with the three lines ahead."""
    import re

    number = re.compile(R.NUMBER.removeprefix("(?U)"))
    found, open_rows, ahead = [], None, []
    for page, text in pages:
        for raw in text.splitlines():
            line = raw.strip()
            n = len(number.findall(line))
            label = re.sub(r"\s{2,}", " ", number.sub(" ", line)).strip()
            row = bool(line) and bool(label) and n >= (1 if open_rows else 2)
            if row:
                if open_rows is None:
                    open_rows = []
                    found.append((list(ahead), open_rows))
                open_rows.append((page, label))
            else:
                open_rows = None
                if line:
                    ahead = (ahead + [line])[-3:]
    return found


def test_text_segmentation_matches_a_line_walk(spark):
    rnd = random.Random(5)
    kinds = ["", "标题文字", "资产负债表", "货币资金 1 2", "存货 3", "利润 4 5 6", "2024年度", "100 200"]
    reports = {r: [(p, "\n".join(rnd.choice(kinds) for _ in range(rnd.randint(1, 9)))) for p in range(1, 180, 1 + r % 3)] for r in range(6)}
    rows = [(r, "text", p, t, t) for r, pages in reports.items() for p, t in pages]
    tables, body = T.text_tables(spark.createDataFrame(rows, PAGES), M.base_patterns())
    got = {}
    for r in body.orderBy("row_index").collect():
        got.setdefault((r["report_id"], r["table_key"]), []).append((r["page_number"], r["label"]))
    want = []
    for r, pages in reports.items():
        for ahead, found in walk_lines(pages):
            head = " ".join(ahead)
            typed = any(k in head for k in ("资产负债表", "2024年度"))
            if len(found) >= 2:
                want.append((r, tuple(found), typed or len(found) >= 5))
    # Runs that pass the header or the length gate must be there; others may come in through an earlier statement line.
    gated = {(k[0], tuple(v)) for k, v in got.items()}
    runs = {(r, f) for r, f, _ in want}
    assert gated <= runs
    two = lambda f: [x for x in f]
    assert len(gated) > 20 and all(two(f) for _, f in gated)


CASES = [
    ("一、营业收入", "income", "revenue"),
    ("营业收入", "income", "revenue"),
    ("二、营业成本", "income", "operating_cost"),
    ("资产合计", "balance", "total_assets"),
    ("[999999] 虚构科目", "balance", None),
    ("流动负债", "balance", None),
    ("货币资金合计", "balance", "cash_and_cash_equivalents"),
    ("其中：货币资金", "balance", "cash_and_cash_equivalents"),
    ("货币资金明细", "balance", None),
]


def literal_match(label, statement, metrics, norm):
    """The matching rule read word for word, one metric after the other."""
    n = norm[label]
    ratio = "%" in label or n.endswith("率") or "比率" in n or "比例" in n
    for m in metrics:
        if m["statement_type"] != statement or (ratio and m["value_nature"] != "ratio"):
            continue
        if any(n == norm[p] for p in m["patterns_exact"]):
            return m["metric_code"]
        for p in m["patterns"]:
            q = norm[p]
            if not q:
                continue
            if n.startswith(q):
                if n == q or n[len(q) :] in L.LABEL_SUFFIXES:
                    return m["metric_code"]
            elif n.endswith(q) and n[: -len(q)] in L.LABEL_PREFIXES:
                return m["metric_code"]
    return None


def test_matching(spark):
    rows = spark.createDataFrame([(l, s) for l, s, _ in CASES], "label string, st string")
    got = M.match_labels(rows, M.base_metrics(spark)).select("label", "st", M.match_for(F.col("st")).alias("c")).collect()
    found = {(r["label"], r["st"]): r["c"] for r in got}
    assert [found[(l, s)] for l, s, _ in CASES] == [c for _, _, c in CASES]


def test_keyed_matching_equals_the_literal_rule(spark):
    from tallyweave.functions.base_metrics import base_metric_rows

    metrics = base_metric_rows()
    patterns = sorted({p for m in metrics for p in m["patterns"] + m["patterns_exact"]})
    labels = sorted({f(p) for p in patterns for f in (
        lambda p: p, lambda p: p + "合计", lambda p: "加" + p, lambda p: p + p, lambda p: p + "率", lambda p: "一、" + p, lambda p: p[:3])})
    words = spark.createDataFrame([(w,) for w in sorted(set(labels) | set(patterns))], "w string")
    norm = {r["w"]: r["n"] for r in words.select("w", L.normalize_label(F.col("w")).alias("n")).collect()}
    got = M.match_labels(spark.createDataFrame([(l,) for l in labels], "label string"), M.base_metrics(spark)).collect()
    direct = {(s, norm.get(l, l)): c for s, l, c in M.DIRECT_LABELS}
    for row in got:
        for s in L.STATEMENTS:
            want = direct.get((s, norm[row["label"]])) or literal_match(row["label"], s, metrics, norm)
            assert row[f"match_{s}"] == want, (row["label"], s)


def test_taxonomy_mapping(spark):
    metrics = M.base_metrics(spark)
    records = spark.createDataFrame(
        [
            (0, "total_assets", "800001", "资产总额特别项", ""),
            (1, "revenue", "800002", "模糊名称", ""),
            (2, "operating_cost", "800003", "模糊名称", ""),
            (3, None, "837460", "未映射资产项", "附注_未映射资产项"),
        ],
        "record_order int, metric_code string, sub_code string, sub_name string, sub_name_raw string",
    )
    labels = ["[800001] 某某资产", "模糊名称", "[837460] 随便", "附注_未映射资产项"]
    rows = spark.createDataFrame([(l,) for l in labels], "label string")
    got = {r["label"]: r for r in M.match_labels(rows, metrics, "label", records).collect()}
    assert got[labels[0]]["match_balance"] == "total_assets" and got[labels[0]]["match_income"] is None
    assert got[labels[1]]["match_income"] is None
    assert got[labels[2]]["match_balance"] == "cas2020_837460"
    assert got[labels[3]]["match_balance"] == "cas2020_837460"


def test_pattern_buckets(spark):
    row = M.base_metrics(spark).limit(1).withColumns(
        {
            "patterns": F.array(F.lit("资产"), F.lit("税"), F.lit("营业收入"), F.lit("费用")),
            "patterns_exact": F.array().cast("array<string>"),
            "patterns_en": F.array(F.lit("RO"), F.lit("revenue")),
        }
    )
    done = M.bucket_patterns(row).first()
    assert (done["patterns"], done["patterns_exact"], done["patterns_en"], done["patterns_en_exact"]) == (["营业收入"], ["税"], ["revenue"], ["RO"])


def test_prior_period_of_leap_day(spark):
    day = spark.sql("select date'2024-02-29' d, named_struct('label','prior_period','period_end',cast(null as date),'fiscal_year',cast(null as int)) c")
    assert day.select(H.infer_period_end(F.col("c"), F.col("d")).alias("e")).first()["e"] == datetime.date(2023, 2, 28)


def test_report_to_candidates_with_raw_codes(spark):
    md = (
        "# 资产负债表\n单位：万元\n<table><tr><td>项目</td><td>2024年</td><td>2023年</td></tr>"
        + "".join(f"<tr><td>{n}</td><td>1</td><td>2</td></tr>" for n in ("货币资金", "存货", "神秘资产项目", "其他"))
        + "</table>"
    )
    pages = spark.createDataFrame([(1, "layout", 1, "", md)], PAGES)
    tables, rows = T.extract_tables(pages, M.base_patterns())
    found = H.build_candidates(tables, rows, T.report_metadata(pages), M.base_metrics(spark)).collect()
    codes = {r["metric_code"] for r in found}
    assert len(found) == 6 and {"cash_and_cash_equivalents", "inventory"} < codes
    assert sum(c.startswith("raw_") for c in codes) == 1
    assert {r["consolidation_scope"] for r in found} == {"parent"} and {r["unit"] for r in found} == {"10k"}
