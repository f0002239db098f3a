"""Inputs of the registered queries, derived by Spark from the driver tables.

Each function names the rule in its docstring; ``oracle.py`` states the same
rule in SQL.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.base_metrics import base_metric_rows
from tallyweave.operators.stage import local_table, shuffled, spread
from tallyweave.session import work_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wide_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for heavy per-row work: a small file of one split is dealt out to all cores."""
    return spread(table(spark, folder, name))


def money(column: Column) -> Column:
    return column.cast("decimal(38,6)")


def named_values(values: list[tuple[str, Column]]) -> Column:
    """Rows (metric_code, value, part) of one record's values."""
    items = [
        F.struct(F.lit(n).alias("metric_code"), money(v).alias("value"), F.lit(i).alias("part"))
        for i, (n, v) in enumerate(values)
    ]
    return F.inline(F.array(*items))


def versions(spark: SparkSession) -> DataFrame:
    """Three extraction runs; the third has no engine name."""
    return local_table(spark, [(1, "text"), (2, "layout"), (3, None)], "version_id bigint, parse_method string")


def line_id() -> Column:
    """One number per line item."""
    return (
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")
    ) * 10000 + F.col("l_suppkey")


def stock_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as candidates of balance facts: 300 orders a report, 14 metrics, year ends."""
    year = F.year("l_shipdate")
    number = F.col("l_linenumber")
    return wide_table(spark, folder, "lineitem").select(
        line_id().alias("candidate_id"),
        F.floor(F.col("l_orderkey") / 300).cast("long").alias("report_id"),
        (1 + number % 3).cast("long").alias("version_id"),
        F.lit("stock").alias("fact_type"),
        (F.col("l_partkey") % 14).alias("metric_id"),
        F.lit(None).cast("date").alias("period_start_date"),
        F.lit(None).cast("date").alias("period_end_date"),
        F.make_date(year, F.lit(12), F.lit(31)).alias("as_of_date"),
        money(F.floor(F.col("l_quantity") / 10) * 10).alias("value"),
        F.when(F.col("l_linestatus") == "O", F.lit("1")).alias("unit"),
        F.lit("CNY").alias("currency"),
        F.when(F.col("l_returnflag") == "A", F.lit("consolidated"))
        .when(F.col("l_returnflag") == "N", F.lit("parent"))
        .alias("consolidation_scope"),
        F.lit(None).cast("string").alias("audit_flag"),
        F.when(number % 4 == 0, year.cast("string"))
        .when(number % 4 == 1, F.lit("col_1"))
        .when(number % 4 == 2, F.lit("本期"))
        .otherwise(F.lit("上期"))
        .alias("column_label"),
        F.when(number % 5 != 0, F.col("l_discount")).alias("quality_score"),
    )


def flow_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The same line items as candidates of flow facts over the calendar year."""
    stock = stock_candidates(spark, folder)
    return stock.withColumns(
        {
            "fact_type": F.lit("flow"),
            "period_start_date": F.trunc("as_of_date", "year"),
            "period_end_date": F.col("as_of_date"),
            "as_of_date": F.lit(None).cast("date"),
        }
    )


def all_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return stock_candidates(spark, folder).unionByName(flow_candidates(spark, folder))


def balance_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Each order as a balance sheet of its customer; every seventh is 5 off."""
    total = money(F.round("o_totalprice", 2))
    owed = money(F.round(F.col("o_totalprice") * 0.6, 2))
    off = F.when(F.col("o_orderkey") % 7 == 0, F.lit(5)).otherwise(F.lit(0)).cast("decimal(38,6)")
    orders = table(spark, folder, "orders")
    values = [
        ("total_assets", total),
        ("total_liabilities", owed),
        ("total_equity", (total - owed + off).cast("decimal(38,6)")),
        ("total_liabilities_equity", total),
    ]
    parts = named_values(values)
    return orders.select(
        F.col("o_orderkey").alias("report_id"),
        F.to_date("o_orderdate").alias("as_of_date"),
        F.lit("1").alias("unit"),
        F.when(F.col("o_orderstatus") != "P", F.lit("CNY")).alias("currency"),
        F.lit("consolidated").alias("consolidation_scope"),
        "o_orderkey",
        parts,
    ).withColumn("fact_id", F.col("o_orderkey") * 10 + F.col("part"))


def cashflow_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer and year as cash flows by priority; every fifth customer is 9 off, every third has fx."""
    orders = table(spark, folder, "orders").withColumn("y", F.year("o_orderdate"))
    cents = F.round("o_totalprice", 2).cast("decimal(18,2)")
    of = lambda *p: F.coalesce(F.sum(F.when(F.substring("o_orderpriority", 1, 1).isin(*p), cents)), F.lit(0)).cast(
        "decimal(38,6)"
    )
    sums = orders.groupBy("o_custkey", "y").agg(
        of("1", "2").alias("operating"), of("3").alias("investing"), of("4", "5").alias("financing")
    )
    fx = F.when(F.col("o_custkey") % 3 == 0, F.lit(-2.5).cast("decimal(38,6)"))
    off = F.when(F.col("o_custkey") % 5 == 0, F.lit(9)).otherwise(F.lit(0)).cast("decimal(38,6)")
    net = (
        F.col("operating") + F.col("investing") + F.col("financing") + F.coalesce(fx, F.lit(0)) + off
    ).cast("decimal(38,6)")
    begin = F.lit(100).cast("decimal(38,6)")
    names = [
        ("net_cash_flow_operating", F.col("operating")),
        ("net_cash_flow_investing", F.col("investing")),
        ("net_cash_flow_financing", F.col("financing")),
        ("net_increase_cash", net),
        ("fx_effect_on_cash", fx),
        ("cash_begin", begin),
        ("cash_end", (begin + net).cast("decimal(38,6)")),
    ]
    parts = named_values(names)
    return sums.select(
        F.col("o_custkey").alias("report_id"),
        F.make_date("y", F.lit(12), F.lit(31)).alias("period_end_date"),
        F.lit("1").alias("unit"),
        F.lit("CNY").alias("currency"),
        F.lit(None).cast("string").alias("consolidation_scope"),
        parts,
    ).withColumn("fact_id", F.col("part").cast("long"))


# ---------------------------------------------------------------- texts and labels


def first_patterns() -> list[tuple[str, str]]:
    """(pattern, statement) of every dictionary metric, in dictionary order."""
    return [(r["patterns"][0] if r["patterns"] else r["patterns_exact"][0], r["statement_type"]) for r in base_metric_rows()]


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def row_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as row labels: a dictionary word by part, dressed by line number; statement by supplier."""
    known = first_patterns()
    which = F.col("l_partkey") % len(known)
    word = pick([p for p, _ in known], which)
    number = F.col("l_linenumber") % 7
    label = (
        F.when(number == 0, F.concat(F.lit("一、"), word))
        .when(number == 1, word)
        .when(number == 2, F.concat(word, F.lit("合计")))
        .when(number == 3, F.concat(F.lit("其中："), word))
        .when(number == 4, F.concat(F.lit("加"), word))
        .when(number == 5, F.concat(word, F.lit("明细")))
        .otherwise(F.concat(F.lit(" "), word, F.lit("（净亏损以“-”号填列）")))
    )
    statement = F.when(F.col("l_suppkey") % 4 == 0, F.lit("income")).otherwise(pick([s for _, s in known], which))
    return wide_table(spark, folder, "lineitem").select(
        line_id().alias("row_id"), label.alias("label"), statement.alias("statement_type"), "l_extendedprice", "l_quantity"
    )


def number_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Row labels followed by a price and a bracketed quantity."""
    return row_labels(spark, folder).select(
        "row_id",
        "label",
        F.concat(
            F.col("label"), F.lit("  "), F.format_number("l_extendedprice", 2), F.lit(" ("),
            F.format_number("l_quantity", 0), F.lit(")  12.5%"),
        ).alias("line"),
    )


HEAD_WORDS = ["合并资产负债表", "利润表", "Cash Flow Statement", "所有者权益变动表", "附注 [230105A]"]
UNIT_NAMES = ["万元", "千元", "元", "人民币", "USD", "股"]


def heads(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as report heads: statement by key, unit by customer, order date 20 years on in three notations."""
    day = F.add_months("o_orderdate", 240)
    kind = F.col("o_orderkey") % 3
    shown = (
        F.when(kind == 0, F.date_format(day, "yyyy年M月d日"))
        .when(kind == 1, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "yyyy/M/d"))
    )
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(
            pick(HEAD_WORDS, F.col("o_orderkey") % 5), F.lit(" 单位："), pick(UNIT_NAMES, F.col("o_custkey") % 6), F.lit(" "), shown
        ).alias("head"),
    )


# ---------------------------------------------------------------- report pages

HTML_LABELS = ["货币资金", "应收账款", "存货", "固定资产", "短期借款"]
HTML_YEARS = ["2024年度", "2023年度", "2022年度"]


def html_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals per customer: five priorities by three states."""
    cents = F.round("o_totalprice", 2).cast("decimal(18,2)")
    cells = [
        F.sum(
            F.when((F.substring("o_orderpriority", 1, 1) == str(p + 1)) & (F.col("o_orderstatus") == s), cents)
        ).alias(f"v{p}{i}")
        for p in range(5)
        for i, s in enumerate("FOP")
    ]
    return table(spark, folder, "orders").groupBy("o_custkey").agg(*cells)


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A report per customer: a text page with its name and an HTML page with the sums, odd keys with merged heads.

    The digit 2 is shown as 3, so that no sum looks like a year.
    """
    shown = lambda c: F.translate(F.format_number(c, 2), "2", "3")
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(shown(c), F.lit("")), F.lit("</td>"))
    body = F.concat(
        *[
            F.concat(F.lit(f"<tr><td>{name}</td>"), *[cell(f"v{p}{i}") for i in range(3)], F.lit("</tr>"))
            for p, name in enumerate(HTML_LABELS)
        ]
    )
    years = "".join(f"<td>{y}</td>" for y in HTML_YEARS)
    plain = F.lit(f"<tr><td>项目</td>{years}</tr>")
    merged = F.lit(f'<tr><td rowspan="2">项目</td><td colspan="3">金额</td></tr><tr>{years}</tr>')
    head = F.when(F.col("o_custkey") % 2 == 1, merged).otherwise(plain)
    md = F.concat(F.lit("# 合并资产负债表\n单位：元\n<table>"), head, body, F.lit("</table>\n"))
    about = F.concat(F.lit("公司名称：C"), F.col("o_custkey").cast("string"), F.lit("\n2024年年度报告\n截至2024年12月31日\n单位：元"))
    pages = F.inline(
        F.array(
            F.struct(F.lit(1).alias("page"), about.alias("text_raw"), about.alias("text_md")),
            F.struct(F.lit(2).alias("page"), F.lit("").alias("text_raw"), md.alias("text_md")),
        )
    )
    return html_sums(spark, folder).select(F.col("o_custkey").alias("report_id"), F.lit("layout").alias("engine"), pages)


TEXT_HEADS = [
    "合并利润表\n单位：元\n项目 本期 上期",
    "资产负债表\n单位：万元\n项目 2024年 2023年",
    "概况\n说明文字\n备注",
]


def text_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A report per customer, a page per order: three head lines by order key, three number lines, prose."""
    amount = lambda share: F.format_number(F.round(F.col("o_totalprice") * share, 0), 0)
    text = F.concat(
        pick(TEXT_HEADS, F.col("o_orderkey") % 3),
        F.lit("\n营业收入 "), amount(1.0), F.lit(" "), amount(0.5),
        F.lit("\n营业成本 "), amount(0.25), F.lit(" ("), amount(0.125), F.lit(")"),
        F.lit("\n其中：利息收入 "), amount(0.0625),
        F.lit("\n\n本公司经营情况良好，收入增长。\n"),
    )
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("report_id"),
        F.lit("text").alias("engine"),
        F.col("o_orderkey").cast("int").alias("page"),
        text.alias("text_raw"),
        F.concat(F.lit("## Page\n\n"), text).alias("text_md"),
    )


# ---------------------------------------------------------------- registry, sessions, retrieval


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a path and a content hash; ``doc_no`` is the driver's id."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("doc_no"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.sha2(F.col("text").cast("binary"), 256).alias("hash"),
        "text",
        "lang",
    )


def prior_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Registry left by an earlier run: sources with an even last digit, status by id."""
    status = pick(["indexed", "empty", "failed", "indexed"], F.col("doc_no") % 4)
    return (
        documents(spark, folder)
        .filter(F.rlike("path", F.lit("^src[0-9]*[02468]/")))
        .groupBy("hash")
        .agg(F.min(F.struct("doc_no", "path")).alias("d"))
        .select(
            F.substring("hash", 1, 32).alias("doc_id"),
            F.col("d.path").alias("path"),
            "hash",
            F.col("d.doc_no").alias("doc_no"),
        )
        .withColumn("status", status)
        .select("doc_id", "path", "hash", "status", F.lit(1).alias("num_chunks"), F.lit(0).cast("long").alias("updated_at"))
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("ts"), "role", F.col("text").alias("content")
    )


def vector_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def centroid_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    parts = vector_corpus(spark, folder).select("label", F.posexplode("embedding").alias("i", "v"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p")).select(
        F.col("label").cast("long").alias("query_id"), F.transform("p", lambda x: x["m"]).alias("embedding")
    )


def ranked_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Search hits of the centroid queries with a source, a page and a text."""
    from tallyweave.operators.retrieval import top_n

    hits = top_n(centroid_queries(spark, folder), vector_corpus(spark, folder).select("id", "embedding"))
    return hits.withColumns(
        {
            "source_path": F.when(F.col("id") % 9 != 0, F.concat(F.lit("src"), (F.col("id") % 10).cast("string"))),
            "page": F.when(F.col("id") % 11 != 0, F.col("id") % 40),
            "text": F.repeat(F.concat(F.lit("passage "), F.col("id").cast("string"), F.lit(" ")), 30),
        }
    )


def rerank_responses(hits: DataFrame) -> DataFrame:
    """A ranker's JSON answer per query: scores by id, some ids left out, one query answered in prose."""
    hits = hits.filter(F.col("id") % 13 != 0)
    item = F.struct((F.col("rank") - 1).alias("index"), ((F.col("id") * 7919) % 11).alias("score"))
    answers = hits.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("response"))
    return answers.withColumn("response", F.when(F.col("query_id") == 3, F.lit("no scores today")).otherwise(F.col("response")))


# ---------------------------------------------------------------- dictionary jobs


def letters(column: Column) -> Column:
    """Digits as letters, for labels that must not hold digits."""
    return F.translate(column.cast("string"), "0123456789", "abcdefghij")


def part_name() -> Column:
    return F.concat_ws(" ", "p_name", F.lower("p_type"), letters(F.col("p_brand")), letters(F.col("p_size")))


def part_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as metric definitions: parent is a tenth of the key, statement by size, some labels short or too general."""
    key = F.col("p_partkey")
    code = F.concat(F.lit("m"), key.cast("string"))
    return table(spark, folder, "part").select(
        key.cast("int").alias("def_order"),
        code.alias("metric_code"),
        part_name().alias("metric_name_cn"),
        F.when(key % 3 == 0, F.concat(F.lit("Part "), letters(key))).alias("metric_name_en"),
        pick(["income", "balance", "cashflow"], F.col("p_size") % 3).alias("statement_type"),
        F.when(F.col("p_size") % 3 == 1, F.lit("stock")).otherwise(F.lit("flow")).alias("value_nature"),
        F.when(key > 0, F.concat(F.lit("m"), F.floor(key / 10).cast("string"))).alias("parent_metric_code"),
        F.array(
            part_name(), pick(["合计", "资产", "甲乙", "期末余额", "主营收入"], key % 5), F.concat(F.lit("专项"), letters(key))
        ).alias("patterns"),
        F.array(pick(["甲乙", "丙"], key % 2)).alias("patterns_exact"),
        F.array(F.concat(F.lit("item "), letters(key)), pick(["total", "ab", "Net asset"], key % 3)).alias("patterns_en"),
        F.array().cast("array<string>").alias("patterns_en_exact"),
    )


def taxonomy_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as taxonomy labels of their order: part names, other words, stop words, in three languages."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), part_name().alias("name"), "p_name")
    n = F.col("l_linenumber")
    label = (
        F.when(n % 4 == 0, F.col("name"))
        .when(n % 4 == 1, F.concat(F.col("p_name"), pick([" asset", " revenue", " cash flow", " ratio", ""], F.col("l_partkey") % 5)))
        .when(n % 4 == 2, pick(["合计", "现金", "丁", "x9"], F.col("l_partkey") % 4))
        .otherwise(F.concat(F.lit("附加"), letters(F.col("l_partkey") % 100)))
    )
    return table(spark, folder, "lineitem").join(parts, "l_partkey").select(
        F.concat(F.lit("ns:c-"), F.col("l_orderkey").cast("string")).alias("concept"),
        label.alias("label"),
        pick(["zh-CN", "en", "fr"], n % 3).alias("lang"),
        F.lit("ifrs").alias("source"),
        line_id().alias("entry_order"),
    )


def contents_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as one long contents list: every tenth key a heading, the others notes on a part, some overridden."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("o_custkey"), part_name().alias("name"))
    key = F.col("o_orderkey")
    name = F.when(key % 50 == 7, F.lit("合同资产")).otherwise(F.coalesce("name", F.lit("未知项目")))
    text = F.when(
        key % 10 == 0, F.concat(F.lit("CAS"), key.cast("string"), F.lit("  "), pick(["现金流量表", "存货资产", "收入"], key % 3))
    ).otherwise(
        F.concat(
            F.lit("["), F.lpad((key % 1000000).cast("string"), 6, "0"), F.lit("] 附注_ "), name, F.lit("（已执行新准则）"),
            F.when(key % 4 == 1, F.lit(" 比率")).otherwise(F.lit("")),
        )
    )
    return table(spark, folder, "orders").join(shuffled(parts), "o_custkey", "left").select(
        F.lit(0).alias("doc"), key.alias("row_index"), text.alias("text")
    )


def json_arrays(spark: SparkSession, folder: str) -> str:
    """A folder of text files, each one array of documents on lines of its own; their texts hold braces, brackets and escapes."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    record = F.to_json(F.struct("doc_id", "source", "text"), {"ignoreNullFields": "false"})

    def framed(batches):
        lead = "["
        for batch in batches:
            lines = []
            for value in batch.column("value").to_pylist():
                lines.append(lead + value)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])

    path = work_folder(spark, "json-arrays")
    docs.select(record.alias("value")).mapInArrow(framed, "value string").write.text(path)
    return path


def part_dictionary(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as tables, their lines as rows that name a part, and a dictionary with a phrase for each part (every seventh of two metrics)."""
    part = table(spark, folder, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("name"))
    key = (F.lit("text").alias("engine"), F.lit("t").alias("table_key"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("report_id"), *key)
    label = F.concat(F.lit("Row "), "name", F.lit(" of "), "l_suppkey")
    rows = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    statement = lambda n: F.element_at(F.array(*[F.lit(s) for s in ("income", "balance", "cashflow")]), (n % 3 + 1).cast("int"))
    one = part.select(statement(F.col("p_partkey")).alias("statement_type"), F.array("name").alias("patterns"))
    two = part.filter("p_partkey % 7 = 0").select(statement(F.col("p_partkey") + 1).alias("statement_type"), F.array("name").alias("patterns"))
    return orders, rows.select(F.col("l_orderkey").alias("report_id"), *key, label.alias("label")), one.unionByName(two)


MESSAGES_FROM = 1_700_000_000


def message_files(spark: SparkSession, folder: str) -> tuple[str, T.StructType]:
    """Conversation turns as timed messages, a second a turn after MESSAGES_FROM, dealt to eight files by a hash, so that later files hold earlier turns."""
    turns = table(spark, folder, "conversations")
    ts = F.timestamp_seconds(F.col("turn") + MESSAGES_FROM).alias("ts")
    messages = turns.select(F.col("conv_id").alias("session_id"), ts, "role", F.col("text").alias("content"))
    path = work_folder(spark, "message-files")
    messages.repartition(8, F.xxhash64("session_id", "ts")).write.parquet(path)
    return path, messages.schema
