"""SQL for DuckDB that states each registered query on its own."""

from __future__ import annotations

STOCK = """
SELECT ((l_orderkey*8 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey AS candidate_id,
       CAST(floor(l_orderkey/300) AS BIGINT) AS report_id,
       1 + l_linenumber % 3 AS version_id,
       'stock' AS fact_type,
       l_partkey % 14 AS metric_id,
       CAST(NULL AS DATE) AS period_start_date, CAST(NULL AS DATE) AS period_end_date,
       make_date(CAST(year(l_shipdate) AS INT),12,31) AS as_of_date,
       CAST(floor(l_quantity/10)*10 AS DECIMAL(38,6)) AS value,
       CASE WHEN l_linestatus='O' THEN '1' END AS unit,
       'CNY' AS currency,
       CASE l_returnflag WHEN 'A' THEN 'consolidated' WHEN 'N' THEN 'parent' END AS consolidation_scope,
       CASE l_linenumber % 4 WHEN 0 THEN CAST(year(l_shipdate) AS VARCHAR) WHEN 1 THEN 'col_1' WHEN 2 THEN '本期' ELSE '上期' END AS column_label,
       CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END AS quality_score
FROM lineitem"""

CANDIDATES = f"""
stock AS ({STOCK}),
flow AS (SELECT * REPLACE ('flow' AS fact_type, make_date(year(as_of_date),1,1) AS period_start_date,
                           as_of_date AS period_end_date, CAST(NULL AS DATE) AS as_of_date) FROM stock),
candidates AS (SELECT * FROM stock UNION ALL SELECT * FROM flow),
scored AS (
  SELECT *, CASE version_id WHEN 1 THEN 'text' WHEN 2 THEN 'layout' ELSE 'version_3' END AS engine,
         CAST(CAST(value AS DECIMAL(38,2)) AS VARCHAR) AS value_key,
         CASE WHEN regexp_full_match(column_label, '20[0-9][0-9]') THEN 10000 + CAST(column_label AS BIGINT)
              WHEN column_label = 'col_1' THEN 999 WHEN column_label = '本期' THEN 500
              WHEN column_label = '上期' THEN -500 ELSE 0 END AS score
  FROM candidates)"""

KEY = "report_id, fact_type, metric_id, period_start_date, period_end_date, as_of_date, unit, currency, consolidation_scope"


def consensus(min_agree: int) -> str:
    """Facts by ranking whole groups with window functions."""
    return f"""{CANDIDATES},
groups AS (
  SELECT {KEY}, value_key, count(DISTINCT engine) AS engines, count(*) AS n,
         round(coalesce(avg(quality_score), 0), 9) AS q, max(score) AS s
  FROM scored GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY engines DESC, n DESC, q DESC, s DESC, value_key DESC) AS rn,
         max(engines) OVER (PARTITION BY {KEY}) AS max_agree
  FROM groups),
engines AS (SELECT {KEY}, count(DISTINCT engine) AS n_engines FROM scored GROUP BY ALL),
chosen AS (
  SELECT *, row_number() OVER (PARTITION BY {KEY}, value_key
            ORDER BY (quality_score IS NOT NULL) DESC, coalesce(quality_score,0) DESC, score DESC, candidate_id DESC) AS pick
  FROM scored),
facts AS (
  SELECT b.report_id, b.fact_type, b.metric_id, b.period_start_date, b.period_end_date, b.as_of_date, b.unit, b.currency,
         b.consolidation_scope, c.value, c.candidate_id AS selected_candidate_id, c.quality_score, c.column_label,
         b.engines AS agree_count, b.n AS value_candidates,
         CASE WHEN b.engines >= {min_agree} THEN 'auto' ELSE 'needs_review' END AS resolution_status,
         CASE WHEN b.engines < {min_agree} THEN 'insufficient_agreement' WHEN b.engines > 1 THEN 'consensus' ELSE 'single_engine' END AS resolution_method,
         e.n_engines >= 2 AS multi_engine, b.max_agree >= 2 AS agreed
  FROM best b
  JOIN chosen c ON c.pick = 1 AND c.value_key = b.value_key AND {same("c", "b")}
  JOIN engines e ON {same("e", "b")}
  WHERE b.rn = 1)"""


def same(left: str, right: str, key: str = KEY) -> str:
    return " AND ".join(f"{left}.{c} IS NOT DISTINCT FROM {right}.{c}" for c in key.split(", "))


BALANCE = """
base AS (
  SELECT o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS as_of_date, '1' AS unit,
         CASE WHEN o_orderstatus <> 'P' THEN 'CNY' END AS currency, 'consolidated' AS consolidation_scope,
         CAST(round(o_totalprice,2) AS DECIMAL(38,6)) AS assets, CAST(round(o_totalprice*0.6,2) AS DECIMAL(38,6)) AS owed,
         CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 0 END AS extra
  FROM orders),
wide AS (SELECT *, assets - owed + extra AS equity FROM base)"""

CASHFLOW = """
sums AS (
  SELECT o_custkey, year(o_orderdate) AS y,
         coalesce(sum(CAST(round(o_totalprice,2) AS DECIMAL(18,2))) FILTER (WHERE left(o_orderpriority,1) IN ('1','2')),0) AS op,
         coalesce(sum(CAST(round(o_totalprice,2) AS DECIMAL(18,2))) FILTER (WHERE left(o_orderpriority,1) = '3'),0) AS inv,
         coalesce(sum(CAST(round(o_totalprice,2) AS DECIMAL(18,2))) FILTER (WHERE left(o_orderpriority,1) IN ('4','5')),0) AS fin
  FROM orders GROUP BY ALL),
wide AS (
  SELECT *, CASE WHEN o_custkey % 3 = 0 THEN -2.5 END AS fx,
         op + inv + fin + CASE WHEN o_custkey % 3 = 0 THEN -2.5 ELSE 0 END + CASE WHEN o_custkey % 5 = 0 THEN 9 ELSE 0 END AS net
  FROM sums)"""


def passes(lhs: str, rhs: str) -> str:
    return (
        f"CASE WHEN abs({lhs} - {rhs}) <= 1 OR abs({lhs} - {rhs}) <= greatest(abs({lhs}), abs({rhs})) * 0.000001 "
        "THEN 'pass' ELSE 'fail' END AS status"
    )


SQL: dict[str, str] = {}

SQL["consensus_facts"] = f"WITH {consensus(2)} SELECT * REPLACE (CAST(value AS DOUBLE) AS value) FROM facts WHERE fact_type = 'stock'"

SQL["agreement_stats"] = f"""WITH {consensus(1)}, counted AS (
  SELECT coalesce(fact_type, 'combined') AS fact_type, count(*) AS groups_total,
         count(*) FILTER (WHERE multi_engine) AS groups_multi_engine, count(*) FILTER (WHERE agreed) AS groups_agreed
  FROM facts GROUP BY ROLLUP (fact_type))
SELECT *, CASE WHEN groups_multi_engine = 0 THEN 0.0 ELSE round(groups_agreed / groups_multi_engine, 9) END AS agreement_rate FROM counted"""

SQL["balance_identity"] = f"""WITH {BALANCE}
SELECT report_id, as_of_date, unit, currency, consolidation_scope, 'assets_eq_liab_plus_equity' AS name,
       CAST(assets AS DOUBLE) AS lhs, CAST(owed + equity AS DOUBLE) AS rhs, CAST(assets - (owed + equity) AS DOUBLE) AS diff,
       {passes("assets", "(owed + equity)")} FROM wide
UNION ALL
SELECT report_id, as_of_date, unit, currency, consolidation_scope, 'assets_eq_liab_equity_total',
       CAST(assets AS DOUBLE), CAST(assets AS DOUBLE), 0.0, 'pass' FROM wide"""

SQL["cashflow_identity"] = f"""WITH {CASHFLOW}
SELECT o_custkey AS report_id, make_date(y,12,31) AS period_end_date, '1' AS unit, 'CNY' AS currency,
       CAST(NULL AS VARCHAR) AS consolidation_scope, 'net_increase_eq_sum_cashflows' AS name,
       CAST(net AS DOUBLE) AS lhs, CAST(op+inv+fin+coalesce(fx,0) AS DOUBLE) AS rhs, CAST(fx AS DOUBLE) AS fx_effect,
       CAST(net - (op+inv+fin+coalesce(fx,0)) AS DOUBLE) AS diff, {passes("net", "(op+inv+fin+coalesce(fx,0))")} FROM wide
UNION ALL
SELECT o_custkey, make_date(y,12,31), '1', 'CNY', NULL, 'cash_end_eq_cash_begin_plus_increase',
       CAST(100 + net AS DOUBLE), CAST(100 + net AS DOUBLE), NULL, 0.0, 'pass' FROM wide"""

OVERRIDES = f"""
facts AS (SELECT candidate_id AS fact_id, * EXCLUDE (candidate_id) FROM ({STOCK})),
raw AS (
  SELECT fact_id AS input_order, report_id, metric_id, as_of_date, consolidation_scope, value + 1 AS value,
         CASE WHEN fact_id % 2 = 0 THEN 'EUR' END AS currency FROM facts WHERE column_label = 'col_1'
  UNION ALL
  SELECT fact_id, report_id + 1000000, metric_id, as_of_date, consolidation_scope, value + 2, NULL FROM facts WHERE column_label = '本期'),
overrides AS (
  SELECT report_id, metric_id, as_of_date, consolidation_scope, arg_max(value, input_order) AS value,
         arg_max(currency, input_order) AS currency FROM raw GROUP BY ALL),
targets AS (
  SELECT o.*, (SELECT min(f.fact_id) FROM facts f WHERE f.report_id = o.report_id AND f.metric_id = o.metric_id
               AND f.as_of_date = o.as_of_date AND f.consolidation_scope IS NOT DISTINCT FROM o.consolidation_scope) AS target_id
  FROM overrides o)"""

SQL["manual_override"] = f"""WITH {OVERRIDES}
SELECT f.fact_id, coalesce(o.report_id, f.report_id) AS report_id, coalesce(o.metric_id, f.metric_id) AS metric_id,
       coalesce(o.as_of_date, f.as_of_date) AS as_of_date,
       CASE WHEN o.report_id IS NOT NULL THEN o.consolidation_scope ELSE f.consolidation_scope END AS consolidation_scope,
       CAST(CASE WHEN o.report_id IS NOT NULL THEN o.value ELSE f.value END AS DOUBLE) AS value,
       f.unit, coalesce(o.currency, f.currency) AS currency,
       CASE WHEN o.report_id IS NOT NULL THEN 'verified' ELSE 'auto' END AS resolution_status,
       CASE WHEN o.report_id IS NOT NULL THEN 'manual' ELSE 'single_engine' END AS resolution_method,
       CASE WHEN o.report_id IS NULL THEN f.fact_id END AS selected_candidate_id
FROM facts f FULL OUTER JOIN targets o ON f.fact_id = o.target_id"""

SQL["facts_in_force"] = """
WITH opened AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey AS report_id, o_orderkey AS fact_id, 'first' AS written, CAST(o_totalprice AS DOUBLE) AS value
FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM opened)
UNION ALL SELECT o_custkey, o_orderkey, 'replaced', CAST(o_totalprice AS DOUBLE) FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_custkey, o_orderkey, 'added', CAST(o_totalprice AS DOUBLE) FROM orders WHERE o_orderstatus = 'P'"""

SQL["question_upsert"] = """
WITH last AS (SELECT conv_id::VARCHAR AS qa_id, 'c' AS doc_id, role AS question, md5(text) AS answer FROM conversations c
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, md5(text) DESC) = 1)
SELECT qa_id, doc_id, question, answer, 1::BIGINT AS created_day FROM last
UNION ALL SELECT doc_id::VARCHAR, 'd', lang, source, 2::BIGINT FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT qa_id FROM last)"""

SQL["engine_coverage"] = f"""WITH {CANDIDATES},
v AS (SELECT DISTINCT {KEY}, engine, value_key FROM scored WHERE engine IN ('text', 'layout')),
k AS (SELECT {KEY}, list_sort(list(value_key) FILTER (WHERE engine='text')) AS l,
             list_sort(list(value_key) FILTER (WHERE engine='layout')) AS r FROM v GROUP BY ALL)
SELECT fact_type, count(*) FILTER (WHERE l IS NOT NULL) AS left_keys, count(*) FILTER (WHERE r IS NOT NULL) AS right_keys,
       count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS overlap,
       count(*) FILTER (WHERE r IS NULL) AS left_only, count(*) FILTER (WHERE l IS NULL) AS right_only,
       count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL AND l <> r) AS value_conflicts
FROM k GROUP BY fact_type"""

SQL["discrepancies"] = f"""WITH {consensus(1)},
v AS (SELECT {KEY}, engine, value_key, count(*) AS n_candidates, min(candidate_id) AS first_candidate_id FROM scored GROUP BY ALL),
d AS (SELECT {KEY} FROM v GROUP BY ALL HAVING count(DISTINCT value_key) > 1)
SELECT v.*, f.resolution_status, f.resolution_method
FROM v JOIN d ON {same("v", "d")} JOIN facts f ON {same("v", "f")}"""

SQL["resolve_picks"] = f"""WITH {consensus(1)},
p AS (SELECT {KEY}, max(candidate_id) AS pick FROM scored WHERE column_label = '上期' GROUP BY ALL)
SELECT f.report_id, f.fact_type, f.metric_id, f.as_of_date, f.consolidation_scope, f.unit, f.currency,
       CAST(coalesce(c.value, f.value) AS DOUBLE) AS value, coalesce(p.pick, f.selected_candidate_id) AS selected_candidate_id,
       CASE WHEN p.pick IS NOT NULL THEN 'verified' ELSE f.resolution_status END AS resolution_status,
       CASE WHEN p.pick IS NOT NULL THEN 'manual' ELSE f.resolution_method END AS resolution_method
FROM facts f LEFT JOIN p ON {same("f", "p")} LEFT JOIN stock c ON c.candidate_id = p.pick WHERE f.fact_type = 'stock'"""

# ---------------------------------------------------------------- labels and recognisers

from tallyweave.functions.base_metrics import base_metric_rows  # noqa: E402
from tallyweave.plans import derive as D  # noqa: E402


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_known = D.first_patterns()
N = len(_known)

ROW_LABELS = f"""
row_labels AS (
  SELECT row_id, l_extendedprice, l_quantity, statement_type,
    CASE v WHEN 0 THEN '一、' || w WHEN 1 THEN w WHEN 2 THEN w || '合计' WHEN 3 THEN '其中：' || w WHEN 4 THEN '加' || w
           WHEN 5 THEN w || '明细' ELSE ' ' || w || '（净亏损以“-”号填列）' END AS label
  FROM (SELECT ((l_orderkey*8 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey AS row_id, l_linenumber % 7 AS v,
          l_extendedprice, l_quantity, {quoted(p for p, _ in _known)}[l_partkey % {N} + 1] AS w,
          CASE WHEN l_suppkey % 4 = 0 THEN 'income' ELSE {quoted(s for _, s in _known)}[l_partkey % {N} + 1] END AS statement_type
        FROM lineitem))"""


def norm_sql(text: str) -> str:
    """Label normalisation step by step."""
    out = text
    for pattern in (
        r"^\s*([（(]\s*[一二三四五六七八九十0-9]+\s*[）)]|[一二三四五六七八九十0-9]+[、.．])\s*",
        r"^\s*其中\s*[：:]\s*",
    ):
        out = f"regexp_replace({out}, '{pattern}', '')"
    note = "[（(][^（）()]{0,64}(净亏损以|亏损以|损失以|收益以|号填列|填列)[^（）()]{0,64}[）)]"
    out = f"regexp_replace({out}, '{note}', '', 'g')"
    marks = r"""[\s　：:（）()，,．.。;；、_—－/\\“”"''‘’`-]+"""
    return f"lower(regexp_replace({out}, '{marks}', '', 'g'))"


def _values(rows) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


DICTIONARY = f"""
dict AS (
  SELECT *, {norm_sql("pattern")} AS np FROM (VALUES {_values(
    (r["metric_code"], r["statement_type"], r["value_nature"], r["def_order"], kind, p)
    for r in base_metric_rows() for kind in ("patterns", "patterns_exact") for p in r[kind]
  )}) t(code, st, nature, ord, kind, pattern)),
direct AS (SELECT st, {norm_sql("l")} AS nl, code FROM (VALUES ('balance','资产合计','total_assets'),
   ('cashflow','到的现金','cash_received_from_capital_contributions'), ('cashflow','利、利润','cash_paid_dividends_interest'),
   ('cashflow','耗、生产性生物资产折旧','depreciation_amortization')) t(st, l, code)),
names AS (SELECT DISTINCT label, {norm_sql("label")} AS nl FROM row_labels),
tests AS (
  SELECT n.label, d.st, d.code, d.ord FROM names n JOIN dict d ON
    (NOT (contains(n.label,'%') OR n.nl LIKE '%率' OR n.nl LIKE '%比率%' OR n.nl LIKE '%比例%') OR d.nature = 'ratio')
    AND (d.np <> '' AND n.nl = d.np
      OR d.kind = 'patterns' AND d.np <> '' AND
         CASE WHEN starts_with(n.nl, d.np) THEN n.nl[len(d.np)+1:] IN ('合计','小计','净额','总额','余额')
              WHEN ends_with(n.nl, d.np) THEN n.nl[:len(n.nl)-len(d.np)] IN ('其中','一','二','三','四','五','六','七','八','九','十','加','减')
              ELSE false END)),
firsts AS (SELECT label, st, arg_min(code, ord) AS code FROM tests GROUP BY ALL),
found AS (
  SELECT n.label, s.st, coalesce(x.code, f.code) AS code
  FROM names n CROSS JOIN (VALUES ('income'),('balance'),('cashflow')) s(st)
  LEFT JOIN direct x ON x.st = s.st AND x.nl = n.nl LEFT JOIN firsts f ON f.label = n.label AND f.st = s.st)"""

SQL["number_extract"] = f"""WITH {ROW_LABELS}
SELECT row_id, 2 AS n_numbers, round(l_extendedprice,2) AS first_value, -round(l_quantity,0) AS second_value,
       '(' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ')' AS second_text,
       trim(label) || ' 12.5%' AS row_label, round(l_extendedprice,2) AS cell_value FROM row_labels"""

SQL["head_recognisers"] = """
SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' WHEN 2 THEN 'cash_flow' WHEN 3 THEN 'changes_in_equity' ELSE 'balance_sheet' END AS statement_type,
  CASE o_custkey % 6 WHEN 4 THEN 'USD' WHEN 5 THEN NULL ELSE 'CNY' END AS currency,
  CASE o_custkey % 6 WHEN 0 THEN '10k' WHEN 1 THEN '1k' WHEN 2 THEN '1' END AS units,
  CAST(year(o_orderdate) + 20 AS INT) AS fiscal_year, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS period_end
FROM orders"""

SQL["label_normalize"] = f"WITH {ROW_LABELS} SELECT {norm_sql('label')} AS norm_label, count(*) AS n_rows FROM row_labels GROUP BY 1"

SQL["metric_match"] = f"""WITH {ROW_LABELS}, {DICTIONARY},
other AS (SELECT label, list(struct_pack(st := st, code := code)) FILTER (WHERE code IS NOT NULL) AS hits FROM found GROUP BY label)
SELECT r.row_id, f.code AS metric_code,
  coalesce(f.code, CASE WHEN len(o.hits) = 1 THEN o.hits[1].code END) AS fallback_code,
  CASE WHEN f.code IS NULL AND len(o.hits) = 1 THEN o.hits[1].st ELSE r.statement_type END AS fallback_statement,
  'raw_' || left(sha1(r.statement_type || ':' || n.nl), 12) AS raw_code
FROM row_labels r JOIN names n USING (label) JOIN found f ON f.label = r.label AND f.st = r.statement_type JOIN other o ON o.label = r.label"""

SQL["label_ambiguity"] = f"""WITH {ROW_LABELS}, {DICTIONARY},
plain AS (
  SELECT n.nl, d.st, d.code FROM (SELECT DISTINCT nl FROM names) n JOIN dict d ON
    d.np <> '' AND n.nl = d.np OR d.kind = 'patterns' AND d.np <> '' AND
         CASE WHEN starts_with(n.nl, d.np) THEN n.nl[len(d.np)+1:] IN ('合计','小计','净额','总额','余额')
              WHEN ends_with(n.nl, d.np) THEN n.nl[:len(n.nl)-len(d.np)] IN ('其中','一','二','三','四','五','六','七','八','九','十','加','减')
              ELSE false END),
many AS (SELECT nl, st, count(DISTINCT code) AS n, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM plain GROUP BY ALL HAVING count(DISTINCT code) > 1),
used AS (SELECT {norm_sql('label')} AS nl, count(*) AS n_rows FROM row_labels GROUP BY 1)
SELECT many.nl AS norm_key, st AS statement_type, n AS n_metrics, codes, n_rows FROM many JOIN used USING (nl)"""

# ---------------------------------------------------------------- report tables

HTML = f"""
cells AS (
  SELECT o_custkey AS report_id, CAST(left(o_orderpriority,1) AS INT) - 1 AS p, strpos('FOP', o_orderstatus) - 1 AS i,
         CAST(replace(CAST(sum(CAST(round(o_totalprice,2) AS DECIMAL(18,2))) AS VARCHAR),'2','3') AS DECIMAL(18,2)) AS value
  FROM orders GROUP BY ALL),
kept AS (SELECT report_id, min(p) AS first_p FROM cells GROUP BY 1 HAVING count(DISTINCT p) >= 3),
grid AS (
  -- leading rows without a number count as header rows
  SELECT k.report_id, p.p, p.p - k.first_p AS row_index, i.i, {quoted(D.HTML_LABELS)}[p.p+1] AS label, {quoted(D.HTML_YEARS)}[i.i+1] AS y,
         ['2024-12-31','2023-12-31','2022-12-31'][i.i+1]::DATE AS d, CAST(c.value AS DOUBLE) AS value
  FROM kept k CROSS JOIN range(5) p(p) CROSS JOIN range(3) i(i)
  LEFT JOIN cells c ON c.report_id = k.report_id AND c.p = p.p AND c.i = i.i
  WHERE p.p >= k.first_p)"""

HEAD = "CASE WHEN report_id % 2 = 1 THEN '金额 ' || y ELSE y END"

SQL["html_table_cells"] = f"""WITH {HTML}
SELECT report_id, row_index, label, 'balance_sheet' AS statement_type, '1' AS units, true AS is_consolidated,
       i AS column_index, {HEAD} AS column_label, d AS period_end, value FROM grid"""

SQL["text_table_rows"] = """
WITH t AS (
  SELECT o_custkey AS report_id, o_orderkey AS page, o_orderkey % 3 AS k, o_totalprice AS a,
         max(CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey END) OVER
           (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near
  FROM orders),
s AS (SELECT *, CASE WHEN k < 2 THEN k WHEN page - near <= 2 THEN near % 3 END AS st FROM t),
r AS (SELECT s.*, i, [round(a,0), round(a*0.25,0), NULL][i+1] AS v1, [round(a*0.5,0), -round(a*0.125,0), round(a*0.0625,0)][i+1] AS v2,
             ['营业收入','营业成本','其中：利息收入'][i+1] AS label FROM s CROSS JOIN range(3) x(i) WHERE st IS NOT NULL)
SELECT report_id, page, page AS page_start, i AS row_index, label, v1 AS value_1, v2 AS value_2,
  CASE st WHEN 0 THEN '合并利润表' ELSE '资产负债表' END AS title,
  CASE st WHEN 0 THEN 'income_statement' ELSE 'balance_sheet' END AS statement_type,
  CASE WHEN k < 2 THEN 'CNY' END AS currency, CASE k WHEN 0 THEN '1' WHEN 1 THEN '10k' END AS units,
  st = 0 AS is_consolidated,
  CASE k WHEN 0 THEN 'current_period|prior_period' WHEN 1 THEN '2024|2023' ELSE 'col_1|col_2' END AS column_labels
FROM r"""

SQL["report_metadata"] = """
SELECT DISTINCT o_custkey AS report_id, '2024年年度报告' AS report_title, 'C' || o_custkey AS company_name, CAST(NULL AS VARCHAR) AS ticker,
  'annual' AS report_type, 2024 AS fiscal_year, DATE '2024-12-31' AS period_end, 'CNY' AS currency, '1' AS units,
  'detected' AS currency_status, 'detected' AS units_status, 'detected' AS period_status, 'ready' AS status FROM orders"""

SQL["candidate_facts"] = f"""WITH {HTML}
SELECT report_id, 'stock' AS fact_type, ['cash_and_cash_equivalents','accounts_receivable','inventory','fixed_assets','short_term_borrowings'][p+1] AS metric_code,
  d AS as_of_date, value, '1' AS unit, 'CNY' AS currency, 'consolidated' AS consolidation_scope, {HEAD} AS column_label,
  2 AS page, label AS raw_label, format('{{:,.2f}}', value) AS raw_value
FROM grid WHERE value IS NOT NULL"""

SQL["report_star"] = f"""WITH {HTML}
SELECT report_id, '合并资产负债表' AS title, 'CNY' AS currency, '1' AS units, 'detected' AS currency_status, 'detected' AS units_status,
  count(DISTINCT p) AS n_rows, 0 AS n_total_rows, count(value) AS n_cells, round(sum(value),2) AS total, 3 AS n_columns, 2024 AS last_year
FROM grid GROUP BY report_id"""

# ---------------------------------------------------------------- chunks

WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]"


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def chunk_rows(list_sql: str, with_sql: str = "") -> str:
    return f"""{with_sql}
SELECT doc_id, i - 1 AS chunk_index, length(c[i]) AS n_chars, md5(c[i]) AS text_md5
FROM (SELECT doc_id, {list_sql} AS c FROM documents) d, range(1, len(c) + 1) r(i)"""


# RE2 has no look-behind: a mark is put after each sentence end instead and split at.
SENTENCES = (
    f"list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), "
    f"lambda s: {trimmed('s')}), lambda s: s <> '')"
)
WORDS = f"len(list_filter(regexp_split_to_array(%s, '{WS}+'), lambda w: w <> ''))"
LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda s: {trimmed('s')}), lambda s: s <> '')"


def overlapped(list_sql: str, width: int) -> str:
    return (
        f"list_reduce(list_transform({list_sql}, lambda s: [s]), lambda acc, s: "
        f"list_append(acc, right(acc[-1], {width}) || s[1]))"
    )


SQL["document_parts"] = f"""
SELECT doc_id, i AS part_no, length(c[i]) AS n_chars, md5(c[i]) AS text_md5
FROM (SELECT doc_id, {LINES} AS c FROM documents) d, range(1, len(c) + 1) r(i)"""
SQL["sentence_split"] = chunk_rows(SENTENCES)
SQL["hard_split"] = chunk_rows("list_transform(range(0, length(text), 450), lambda i: substr(text, i + 1, 500))")
SQL["chunk_overlap"] = chunk_rows(overlapped(LINES, 30))
SQL["token_count"] = f"SELECT doc_id, {WORDS % 'text'} AS n_words FROM documents"
# The running list holds [text so far, its words] per chunk; a sentence joins the last chunk while 60 words suffice.
_PACKED = (
    "list_transform(list_reduce(list_transform(" + SENTENCES + ", lambda s: [struct_pack(t := s, n := " + WORDS % "s" + ")]), "
    "lambda acc, s: CASE WHEN acc[-1].n + s[1].n <= 60 "
    "THEN list_append(acc[:-2], struct_pack(t := acc[-1].t || ' ' || s[1].t, n := acc[-1].n + s[1].n)) "
    "ELSE list_append(acc, s[1]) END), lambda x: x.t)"
)
SQL["sentence_chunks"] = f"""WITH p AS (SELECT doc_id, {_PACKED} AS packed FROM documents)
SELECT doc_id, i - 1 AS chunk_index, length(c[i]) AS n_chars, md5(c[i]) AS text_md5
FROM (SELECT doc_id, {overlapped("packed", 20)} AS c FROM p) d, range(1, len(c) + 1) r(i)"""

SQL["batch_embedding"] = f"""WITH s AS (SELECT doc_id, {SENTENCES} AS sents FROM documents)
SELECT doc_id, len(sents)::BIGINT AS n_vectors, coalesce(list_sum(list_transform(sents, lambda x: length(x))), 0)::BIGINT AS n_chars,
  coalesce(list_sum(list_transform(sents, lambda x: length(x) - length(replace(x, ' ', '')))), 0)::BIGINT AS n_spaces, len(sents)::BIGINT AS in_calls FROM s"""

# ---------------------------------------------------------------- retrieval

TERMS = r"list_filter(regexp_split_to_array(lower(%s), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'), lambda t: t <> '')"

SQL["hash_embedding"] = f"""WITH t AS (
  SELECT conv_id, turn, CAST(('0x' || left(md5(term), 8)) AS BIGINT) % 32 AS bucket
  FROM (SELECT conv_id, turn, unnest({TERMS % 'text'}) AS term FROM conversations)),
c AS (SELECT conv_id, turn, bucket, count(*) AS n FROM t GROUP BY ALL)
SELECT conv_id, turn, bucket, round(n / sqrt(sum(n*n) OVER (PARTITION BY conv_id, turn)), 6) AS weight FROM c"""

HITS = """
corpus AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
means AS (SELECT label, i, avg(v[i]) AS m FROM corpus, range(1, 65) r(i) GROUP BY ALL),
query AS (SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY i) AS q FROM means GROUP BY label),
pairs AS (SELECT query_id, id, list_cosine_similarity(v, q) AS score FROM query CROSS JOIN corpus),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM pairs QUALIFY rank <= 20)"""

SQL["vector_topk"] = f"WITH {HITS} SELECT query_id, id, round(score, 6) AS score, rank FROM hits"
HASHED = f"""{HITS},
width AS (SELECT min(b) AS bits FROM range(4, 50) r(b) WHERE 32 * (1::BIGINT << b) >= (SELECT count(*) FROM corpus)),
plane AS (
  SELECT t, b, i, 1 - 2 * (('0x' || substr(md5(t || ':' || b || ':' || (i - 1)), 1, 1))::INT & 1) AS s
  FROM range(0, 12) x(t), range(0, 50) y(b), range(1, 65) z(i) WHERE b < (SELECT bits FROM width)),
side AS (
  SELECT 'c' AS kind, id AS k, t, b, sum(floor(v[i] * 1048576)::BIGINT * s) AS p FROM corpus CROSS JOIN plane GROUP BY ALL
  UNION ALL SELECT 'q', query_id, t, b, sum(floor(q[i] * 1048576)::BIGINT * s) FROM query CROSS JOIN plane GROUP BY ALL),
code AS (SELECT kind, k, t, sum(CASE WHEN p > 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS c FROM side GROUP BY ALL),
near AS (SELECT k, t, b, row_number() OVER (PARTITION BY k, t ORDER BY abs(p), b) AS r FROM side WHERE kind = 'q' QUALIFY r <= 2),
flip AS (SELECT k, t, max(CASE WHEN r = 1 THEN 1::BIGINT << b END) AS one, max(CASE WHEN r = 2 THEN 1::BIGINT << b END) AS two FROM near GROUP BY ALL),
probe AS (SELECT k, t, xor(c, xor(CASE WHEN m & 1 = 1 THEN one ELSE 0 END, CASE WHEN m & 2 = 2 THEN two ELSE 0 END)) AS c
  FROM code JOIN flip USING (k, t), range(0, 4) x(m) WHERE kind = 'q'),
met AS (SELECT DISTINCT probe.k AS query_id, code.k AS id FROM probe JOIN code ON code.kind = 'c' AND code.t = probe.t AND code.c = probe.c),
approx AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
  FROM pairs JOIN met USING (query_id, id) QUALIFY rank <= 20)"""
SQL["hashed_topk"] = f"WITH {HASHED} SELECT query_id, id, round(score, 6) AS score, rank FROM approx"
SQL["hashed_recall"] = f"""WITH {HASHED},
n AS (SELECT count(*) AS n_exact, count(a.id) AS n_found FROM hits h LEFT JOIN approx a USING (query_id, id))
SELECT n_exact, n_found, n_found / n_exact AS recall, n_found / n_exact >= 0.9 AS enough FROM n"""
SQL["row_vote_dictionary"] = """
WITH phrase AS (
  SELECT lower(replace(p_name || p_partkey, ' ', '')) AS phrase, p_partkey % 3 AS s FROM part
  UNION ALL SELECT lower(replace(p_name || p_partkey, ' ', '')), (p_partkey + 1) % 3 FROM part WHERE p_partkey % 7 = 0),
line AS (SELECT l_orderkey, lower(replace('row' || p_name || p_partkey || 'of' || l_suppkey, ' ', '')) AS label FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
label AS (SELECT DISTINCT label FROM line),
hit AS (SELECT label, count(*) FILTER (s = 0) AS i, count(*) FILTER (s = 1) AS b, count(*) FILTER (s = 2) AS c FROM label JOIN phrase ON contains(label, phrase) GROUP BY label),
score AS (SELECT l_orderkey AS report_id, sum(i) AS i, sum(b) AS b, sum(c) AS c FROM line JOIN hit USING (label) GROUP BY 1)
SELECT report_id, CASE WHEN i >= b AND i >= c THEN 'income' WHEN b >= c THEN 'balance' ELSE 'cashflow' END AS voted FROM score"""
SQL["hits_at_k"] = f"""WITH {HITS},
j AS (SELECT query_id, bool_or(rank <= 5 AND label = query_id) AS hit FROM hits JOIN corpus USING (id) GROUP BY 1)
SELECT count(*) AS n_queries, count(*) FILTER (WHERE hit) AS n_hit, count(*) FILTER (WHERE hit) / count(*) AS hits_at_k FROM j"""

RERANKED = f"""{HITS},
best AS (
  SELECT query_id, id, rank, CAST((id * 7919) % 11 AS DOUBLE) AS rerank_score,
         row_number() OVER (PARTITION BY query_id ORDER BY (id * 7919) % 11 DESC, rank) AS position
  FROM hits WHERE id % 13 <> 0 AND query_id <> 3
  UNION ALL SELECT query_id, id, rank, NULL, rank FROM hits WHERE query_id = 3),
top AS (
  SELECT query_id, id, position, rerank_score, CASE WHEN id % 9 <> 0 THEN 'src' || (id % 10) END AS source_path,
         CASE WHEN id % 11 <> 0 THEN id % 40 END AS page, repeat('passage ' || id || ' ', 30) AS text
  FROM best WHERE position <= 5)"""

SQL["rerank_topk"] = f"WITH {RERANKED} SELECT query_id, position, id, rerank_score FROM top"
SQL["context_blocks"] = f"""WITH {RERANKED}
SELECT query_id, string_agg('[' || position || '] Source: ' || coalesce(source_path,'unknown') || ' | Page: ' ||
  coalesce(CAST(page AS VARCHAR),'0') || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS context FROM top GROUP BY 1"""
SQL["citations"] = f'WITH {RERANKED} SELECT query_id, position AS "index", source_path, page, left(text, 200) AS snippet FROM top'
SQL["hit_display"] = f"""WITH {RERANKED}
SELECT query_id, position, '- [' || position || '] ' || coalesce(source_path,'None') || ' p.' || coalesce(CAST(page AS VARCHAR),'None') AS line,
  coalesce(format('{{:.2f}}', rerank_score), 'n/a') AS rerank_text FROM top"""

POSTINGS = f"""words AS (SELECT doc_id, t[i] AS term, i - 1 AS pos FROM (SELECT doc_id, {TERMS % 'text'} AS t FROM documents) d, range(1, len(t) + 1) r(i)),
index AS (SELECT term, doc_id, count(*) AS tf, min(pos) AS first_position FROM words GROUP BY ALL)"""

SQL["postings"] = f"WITH {POSTINGS} SELECT * FROM index"
SQL["term_search"] = f"""WITH {POSTINGS},
q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS % 'text'}) AS term FROM benchmark),
n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
m AS (SELECT query_id, doc_id, count(*) AS n, sum(tf) AS tf_sum FROM q JOIN index USING (term) GROUP BY ALL)
SELECT m.query_id, m.doc_id, CAST(m.tf_sum AS BIGINT) AS tf_sum FROM m JOIN n ON m.query_id = n.query_id AND m.n = n.n"""

# ---------------------------------------------------------------- registry and sessions

SQL["content_hash"] = "SELECT left(sha256(text), 32) AS doc_id, sha256(text) AS hash, count(*) AS n_copies FROM documents GROUP BY ALL"

REGISTRY = f"""
docs AS (SELECT doc_id AS doc_no, source || '/' || doc_id AS path, sha256(text) AS hash, text, lang FROM documents),
prior AS (
  SELECT left(hash, 32) AS doc_id, arg_min(path, doc_no) AS path, hash,
         ['indexed','empty','failed','indexed'][min(doc_no) % 4 + 1] AS status, 1 AS num_chunks, 0 AS updated_at
  FROM docs WHERE regexp_matches(path, '^src[0-9]*[02468]/') GROUP BY hash),
tried AS (
  SELECT d.*, {WORDS % 'd.text'} // 50 AS n, k.hash IS NOT NULL AS known,
         CASE WHEN contains(d.text, '@') OR d.doc_no % 3 = 0 THEN 'failed' WHEN {WORDS % 'd.text'} < 50 THEN 'empty' ELSE 'indexed' END AS alone
  FROM docs d LEFT JOIN (SELECT hash FROM prior WHERE status = 'indexed') k ON k.hash = d.hash),
turns AS (SELECT *, known OR coalesce(bool_or(alone = 'indexed') OVER (
  PARTITION BY hash ORDER BY doc_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skip FROM tried),
outcome AS (SELECT * EXCLUDE (n, known, alone, skip), CASE WHEN skip THEN 0 ELSE n END AS num_chunks, CASE WHEN skip THEN 'skipped' ELSE alone END AS status FROM turns)"""

SQL["index_summary"] = f"""WITH {REGISTRY}
SELECT lang, count(*) FILTER (WHERE status='indexed') AS indexed, count(*) FILTER (WHERE status='skipped') AS skipped,
  count(*) FILTER (WHERE status='empty') AS empty, count(*) FILTER (WHERE status='failed') AS errors FROM outcome GROUP BY lang"""
SQL["registry_upsert"] = f"""WITH {REGISTRY},
both_ AS (SELECT *, 0 AS seq FROM prior UNION ALL
  SELECT left(hash,32), path, hash, status, num_chunks, doc_no + 1, 1 FROM outcome WHERE status <> 'skipped')
SELECT doc_id, path, hash, status, num_chunks, updated_at FROM both_
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC, updated_at DESC, path DESC) = 1"""
SQL["unseen_documents"] = f"""WITH {REGISTRY}
SELECT hash, min(doc_no) AS doc_no, arg_min(path, doc_no) AS path FROM docs WHERE hash NOT IN (SELECT hash FROM prior) GROUP BY hash"""
SQL["registry_health"] = """
SELECT doc_id, source || '/' || doc_id AS path, 'indexed' AS status, 1 AS num_chunks, (SELECT count(*) FROM documents) AS n_documents
FROM documents ORDER BY doc_id DESC LIMIT 5"""
SQL["session_activity"] = "SELECT conv_id AS session_id, min(turn) AS created_at, max(turn) AS updated_at, count(*) AS n_messages FROM conversations GROUP BY 1"
SQL["last_messages"] = """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts) AS position, ts, role, content_md5 FROM (
  SELECT conv_id AS session_id, turn AS ts, role, md5(text) AS content_md5 FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)"""
SQL["latest_user_query"] = """
SELECT conv_id AS session_id, trim(arg_max(text, turn)) AS query FROM conversations WHERE role = 'user' GROUP BY 1"""

# ---------------------------------------------------------------- dictionary jobs

def letters(text: str) -> str:
    return f"translate(CAST({text} AS VARCHAR), '0123456789', 'abcdefghij')"


PART_NAME = f"concat_ws(' ', p_name, lower(p_type), {letters('p_brand')}, {letters('p_size')})"
PARTS = f"""
parts AS (
  SELECT p_partkey AS k, 'm' || p_partkey AS code, {PART_NAME} AS cn, CASE WHEN p_partkey % 3 = 0 THEN 'Part ' || {letters('p_partkey')} END AS en,
    ['income','balance','cashflow'][p_size % 3 + 1] AS st, CASE WHEN p_size % 3 = 1 THEN 'stock' ELSE 'flow' END AS nature,
    CASE WHEN p_partkey > 0 THEN 'm' || (p_partkey // 10) END AS parent,
    [{PART_NAME}, ['合计','资产','甲乙','期末余额','主营收入'][p_partkey % 5 + 1], '专项' || {letters('p_partkey')}] AS pat,
    [['甲乙','丙'][p_partkey % 2 + 1]] AS pat_exact, ['item ' || {letters('p_partkey')}, ['total','ab','Net asset'][p_partkey % 3 + 1]] AS pat_en
  FROM part)"""
# Labels of a metric in order: names, phrases, exact labels, English phrases.
PART_LABELS = f"""{PARTS},
label_rows AS (SELECT code, k, i, label, {norm_sql('label')} AS norm FROM (
  SELECT code, k, unnest([cn, en] || pat || pat_exact || pat_en) AS label,
         generate_subscripts([cn, en] || pat || pat_exact || pat_en, 1) AS i FROM parts) WHERE coalesce(label, '') <> ''),
lindex AS (SELECT norm, arg_min(code, k * 100 + i) AS code, count(DISTINCT code) > 1 AS ambiguous FROM label_rows WHERE norm <> '' GROUP BY norm)"""

SQL["label_index"] = f"WITH {PART_LABELS} SELECT norm, code AS metric_code, ambiguous FROM lindex"

TAXONOMY = f"""{PART_LABELS},
entries AS (
  SELECT 'ns:c-' || l_orderkey AS concept, l_orderkey, ((l_orderkey*8 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey AS entry_order,
    CASE l_linenumber % 4 WHEN 0 THEN {PART_NAME}
      WHEN 1 THEN p_name || [' asset',' revenue',' cash flow',' ratio',''][l_partkey % 5 + 1]
      WHEN 2 THEN ['合计','现金','丁','x9'][l_partkey % 4 + 1] ELSE '附加' || {letters('l_partkey % 100')} END AS label,
    ['cn','en','fr'][l_linenumber % 3 + 1] AS lang
  FROM lineitem JOIN part ON p_partkey = l_partkey),
normed AS (SELECT *, {norm_sql('label')} AS norm FROM entries),
joined AS (SELECT n.*, x.code FROM normed n LEFT JOIN lindex x ON x.norm = n.norm AND NOT x.ambiguous),
concepts AS (
  SELECT concept, min(entry_order) AS concept_order, arg_min(code, entry_order) FILTER (WHERE code IS NOT NULL) AS code,
         arg_min(label, entry_order) AS name, string_agg(label, ' ' ORDER BY entry_order) AS words FROM joined GROUP BY concept),
typed AS (SELECT *, CASE WHEN regexp_matches(words, '(?i)(现金|现金流|cash\\s*flow)') THEN 'cashflow'
    WHEN regexp_matches(words, '(?i)(收入|成本|费用|利润|收益|税|income|revenue|expense|profit|loss)') THEN 'income'
    WHEN regexp_matches(words, '(?i)(资产|负债|权益|capital|equity|asset|liabil)') THEN 'balance' END AS st FROM concepts),
mapped AS (SELECT concept, concept_order, code IS NULL AS is_new, name, st, words,
    coalesce(code, CASE WHEN st IS NOT NULL THEN lower('xbrl_ifrs_' || regexp_replace(concept, '[^a-zA-Z0-9_]+', '_', 'g')) END) AS code FROM typed)"""

SQL["concept_mapping"] = f"""WITH {TAXONOMY}
SELECT concept, code AS metric_code, is_new, name AS metric_name_cn, st AS statement_type,
  CASE WHEN regexp_matches(words, '(?i)(率|%|percentage|ratio)') THEN 'ratio' WHEN st = 'balance' THEN 'stock' ELSE 'flow' END AS value_nature
FROM mapped WHERE code IS NOT NULL"""

from tallyweave.operators import dictionary as J  # noqa: E402


def among(norm: str, labels) -> str:
    return f"{norm} IN (SELECT {norm_sql('x')} FROM (SELECT unnest({quoted(labels)}) AS x))"


SQL["taxonomy_merge"] = f"""WITH {TAXONOMY},
adds AS (
  SELECT m.code, m.concept_order, n.entry_order, n.label,
    CASE WHEN n.lang = 'cn' THEN 'patterns' ELSE 'patterns_en' END || CASE WHEN length(n.norm) <= 2 THEN '_exact' ELSE '' END AS bucket
  FROM normed n JOIN mapped m USING (concept)
  WHERE m.code IS NOT NULL AND n.norm <> '' AND NOT {among('n.norm', J.STOP_LABELS)}
    AND NOT (length(n.norm) <= 2 AND n.norm IN ('资产','负债','权益','现金','成本','费用'))
    AND NOT regexp_matches(n.label, '[0-9]') AND n.lang IN ('cn','en')),
old AS (
  SELECT code, 'patterns' AS bucket, unnest(pat) AS label, generate_subscripts(pat,1) AS i FROM parts
  UNION ALL SELECT code, 'patterns_exact', unnest(pat_exact), generate_subscripts(pat_exact,1) FROM parts
  UNION ALL SELECT code, 'patterns_en', unnest(pat_en), generate_subscripts(pat_en,1) FROM parts),
both_ AS (
  SELECT code, bucket, label, 0 AS a, i AS b, 0 AS c FROM old
  UNION ALL
  SELECT code, bucket, label, 1, min(concept_order), arg_min(entry_order, (concept_order, entry_order)) FROM adds
  WHERE (code, bucket, label) NOT IN (SELECT (code, bucket, label) FROM old) GROUP BY code, bucket, label)
SELECT code AS metric_code, bucket, count(*) AS n_labels, string_agg(label, '|' ORDER BY a, b, c) AS labels FROM both_ GROUP BY code, bucket"""

CONTENTS = f"""
toc_rows AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 7 THEN '合同资产' ELSE coalesce({PART_NAME.replace("concat_ws(' ', p_name", "concat_ws(' ', p_name")}, '未知项目') END AS raw_name,
    p_name IS NULL AS lost, o_orderkey % 10 = 0 AS top, ['现金流量表','存货资产','收入'][o_orderkey % 3 + 1] AS heading
  FROM orders LEFT JOIN part ON p_partkey = o_custkey),
named AS (SELECT k, top, heading, CASE WHEN k % 50 <> 7 AND lost THEN '未知项目' ELSE raw_name END AS name FROM toc_rows),
filled AS (
  SELECT *, max(CASE WHEN top THEN k END) OVER (ORDER BY k) AS head_k FROM named),
toc AS (
  SELECT f.k, f.top, CASE WHEN f.head_k IS NOT NULL THEN 'CAS' || f.head_k END AS cas_code, h.heading AS cas_name,
    CASE WHEN NOT f.top THEN lpad(CAST(f.k % 1000000 AS VARCHAR), 6, '0') END AS sub_code,
    CASE WHEN NOT f.top THEN f.name || CASE WHEN f.k % 4 = 1 THEN ' 比率' ELSE '' END END AS sub_name,
    CASE WHEN NOT f.top THEN '附注_ ' || f.name || '（已执行新准则）' || CASE WHEN f.k % 4 = 1 THEN ' 比率' ELSE '' END END AS sub_name_raw
  FROM filled f LEFT JOIN named h ON h.k = f.head_k)"""

SQL["contents_fill"] = f"""WITH {CONTENTS}
SELECT k AS row_index, CASE WHEN top THEN 'cas' ELSE 'sub' END AS level, cas_code, cas_name, sub_code, sub_name, sub_name_raw FROM toc"""

CONTENTS_MAP = f"""{CONTENTS}, {PARTS},
name_rows AS (SELECT DISTINCT code, {norm_sql('label')} AS norm FROM (SELECT code, unnest([cn] || pat || pat_exact) AS label FROM parts)),
one_name AS (SELECT norm, min(code) AS code FROM name_rows WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT code) = 1),
subs AS (SELECT *, {norm_sql('sub_name')} AS norm, sub_name = '合同资产' AS over_,
   row_number() OVER (PARTITION BY sub_name = '合同资产' ORDER BY k) = 1 AS first_ FROM toc WHERE NOT top),
picked AS (SELECT s.*, o.code AS one FROM subs s LEFT JOIN one_name o USING (norm))"""

SQL["contents_mapping"] = f"""WITH {CONTENTS_MAP}, typed AS (
  SELECT *, CASE WHEN contains(coalesce(cas_name,'') || ' ' || sub_name, '现金流量') THEN 'cashflow'
    WHEN regexp_matches(coalesce(cas_name,'') || ' ' || sub_name, '(资产|负债|权益|财务报表|金融工具|合并财务报表|主体中权益|公允价值|持有待售|租赁)') THEN 'balance' ELSE 'income' END AS st FROM picked)
SELECT k AS row_order, cas_code, sub_code, sub_name, sub_name_raw,
  CASE WHEN over_ THEN 'contract_assets' WHEN one IS NOT NULL THEN one ELSE 'cas2020_' || sub_code END AS metric_code,
  CASE WHEN over_ AND first_ THEN 'override_create' WHEN over_ THEN 'override' WHEN one IS NOT NULL THEN 'unique_name' ELSE 'auto_create' END AS mapping_method,
  CAST(CASE WHEN over_ AND first_ THEN 0.95 WHEN over_ THEN 1.0 WHEN one IS NOT NULL THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence,
  st AS statement_type, CASE WHEN regexp_matches(sub_name, '(率|每股|%|比率)') THEN 'ratio' WHEN st = 'balance' THEN 'stock' ELSE 'flow' END AS value_nature
FROM typed"""

SQL["contents_counts"] = f"""WITH {CONTENTS_MAP},
raw AS (
  SELECT one AS code, 'patterns_exact' AS bucket, sub_name AS label FROM picked WHERE one IS NOT NULL
  UNION SELECT one, 'patterns', sub_name_raw FROM picked WHERE one IS NOT NULL AND sub_name_raw <> sub_name
  UNION SELECT one, 'patterns', '[' || sub_code || '] ' || sub_name_raw FROM picked WHERE one IS NOT NULL),
fresh AS (SELECT * FROM raw WHERE (code, bucket, label) NOT IN (
  SELECT (code, 'patterns', l) FROM (SELECT code, unnest(pat) AS l FROM parts) UNION ALL
  SELECT (code, 'patterns_exact', l) FROM (SELECT code, unnest(pat_exact) AS l FROM parts)))
SELECT (SELECT count(*) FROM picked WHERE one IS NOT NULL) AS matched, (SELECT count(*) FROM picked WHERE one IS NULL) AS skipped,
  0 AS created, (SELECT count(*) FROM fresh) AS alias_added"""

SQL["dictionary_cleanup"] = f"""WITH {PARTS}, bits AS (
  SELECT code, k, 1 AS no, unnest(pat) AS l, generate_subscripts(pat,1) AS i, 'patterns' AS b FROM parts
  UNION ALL SELECT code, k, 1, unnest(pat_en), generate_subscripts(pat_en,1), 'patterns_en' FROM parts),
judged AS (SELECT *, {norm_sql('l')} AS n FROM bits),
fate AS (SELECT *, CASE WHEN {among('n', J.STOP_LABELS)} THEN 'drop' WHEN length(n) > 2 THEN 'keep'
    WHEN b = 'patterns' AND n IN ('资产','负债','权益','现金','成本','费用') THEN 'drop' ELSE 'move' END AS f FROM judged),
rows_ AS (
  SELECT code, b AS bucket, l, 0 AS a, i FROM fate WHERE f = 'keep'
  UNION ALL SELECT code, 'patterns_exact', unnest(pat_exact), 0, 1 FROM parts
  UNION ALL SELECT f.code, b || '_exact', l, 1, i FROM fate f JOIN parts p ON p.code = f.code WHERE f.f = 'move' AND NOT (b = 'patterns' AND list_contains(p.pat_exact, l))),
lists AS (SELECT code, bucket, count(*) AS n_labels, string_agg(l, '|' ORDER BY a, i) AS labels FROM rows_ GROUP BY ALL)
SELECT code AS metric_code, bucket, n_labels, labels, (SELECT bool_or(f <> 'keep') FROM fate WHERE fate.code = lists.code) AS changed FROM lists"""

SQL["pattern_buckets"] = f"""WITH {PARTS}, bits AS (
  SELECT code, unnest(pat) AS l, generate_subscripts(pat,1) AS i, 'patterns' AS b FROM parts
  UNION ALL SELECT code, unnest(pat_en), generate_subscripts(pat_en,1), 'patterns_en' FROM parts),
judged AS (SELECT *, {norm_sql('l')} AS n FROM bits),
rows_ AS (
  SELECT code, b AS bucket, l, 0 AS a, i FROM judged WHERE length(n) > 2
  UNION ALL SELECT code, 'patterns_exact', unnest(pat_exact), 0, 1 FROM parts
  UNION ALL SELECT j.code, b || '_exact', l, 1, i FROM judged j JOIN parts p ON p.code = j.code
    WHERE length(n) BETWEEN 1 AND 2 AND NOT (b = 'patterns' AND (list_contains(p.pat_exact, l) OR n IN ('资产','负债','权益','现金','成本','费用'))))
SELECT code AS metric_code, bucket, count(*) AS n_labels, string_agg(l, '|' ORDER BY a, i) AS labels FROM rows_ GROUP BY ALL"""

SQL["dictionary_merge"] = f"""WITH {PARTS},
side AS (
  SELECT CASE WHEN st = 'income' THEN 'new_' || code ELSE code END AS code, k, NULL AS en, ['loaded ' || code] || list_reverse(pat) AS pat, pat_exact, pat_en, 0 AS turn FROM parts
  UNION ALL SELECT code, k, en, pat, pat_exact, pat_en, 1 FROM parts),
rows_ AS (
  SELECT code, turn, 'patterns' AS bucket, unnest(pat) AS l, generate_subscripts(pat, 1) AS i FROM side
  UNION ALL SELECT code, turn, 'patterns_exact', unnest(pat_exact), 1 FROM side
  UNION ALL SELECT code, turn, 'patterns_en', unnest(pat_en), generate_subscripts(pat_en, 1) FROM side),
firsts AS (SELECT code, bucket, l, min(turn * 100 + i) AS place FROM rows_ GROUP BY ALL),
about AS (SELECT code, max(en) AS metric_name_en, arg_min(CASE turn WHEN 0 THEN k ELSE 1000000 + k END, turn) AS def_order FROM side GROUP BY code)
SELECT f.code AS metric_code, bucket, count(*) AS n_labels, string_agg(l, '|' ORDER BY place) AS labels,
  any_value(metric_name_en) AS metric_name_en, any_value(def_order) AS def_order
FROM firsts f JOIN about USING (code) GROUP BY f.code, bucket"""

SQL["dictionary_prune"] = f"""WITH {PARTS}
SELECT count(*) AS before, count(*) FILTER (WHERE NOT starts_with(code, 'm1')) AS after, count(*) FILTER (WHERE starts_with(code, 'm1')) AS removed FROM parts"""

SQL["metric_upsert"] = f"""WITH {PARTS}
SELECT code AS metric_code, cn AS metric_name_cn, coalesce(en, upper(code)) AS metric_name_en, st AS statement_type, nature AS value_nature, st <> 'income' AS is_new FROM parts
UNION ALL SELECT 'old_' || code, 'old', 'old', st, nature, false FROM parts WHERE st <> 'income'"""

SQL["metric_parents"] = f"""WITH {PARTS}
SELECT c.code AS metric_code, p.k AS parent_metric_id FROM parts c LEFT JOIN parts p ON p.code = c.parent"""

SQL["dictionary_aliases"] = f"""WITH {PARTS}
SELECT code AS metric_code, unnest(pat) AS alias_text, 'cn' AS language, 'phrase' AS match_mode FROM parts
UNION ALL SELECT code, unnest(pat_exact), 'cn', 'exact' FROM parts UNION ALL SELECT code, unnest(pat_en), 'en', 'phrase' FROM parts"""

SQL["metric_ancestors"] = f"""WITH RECURSIVE {PARTS},
up AS (SELECT code, parent AS a, 1 AS d FROM parts WHERE parent IS NOT NULL
  UNION ALL SELECT up.code, p.parent, d + 1 FROM up JOIN parts p ON p.code = up.a WHERE p.parent IS NOT NULL)
SELECT code AS metric_code, a AS ancestor_code, d AS distance FROM up"""

SQL["taxonomy_match"] = f"""WITH {CONTENTS_MAP},
recs AS (SELECT k, sub_code, sub_name, sub_name_raw, one AS code FROM picked),
keys AS (
  SELECT k, sub_code, code, {norm_sql('x')} AS name_key FROM (SELECT k, sub_code, code, unnest([sub_name, sub_name_raw]) AS x FROM recs)),
by_code AS (
  SELECT sub_code, s.st, CASE WHEN count(DISTINCT p.code) FILTER (WHERE p.st = s.st) = 1 THEN min(p.code) FILTER (WHERE p.st = s.st) END AS code
  FROM recs r LEFT JOIN parts p ON p.code = r.code CROSS JOIN (VALUES ('income'),('balance'),('cashflow')) s(st) GROUP BY ALL),
by_name AS (
  SELECT name_key, s.st, CASE WHEN count(DISTINCT p.code) FILTER (WHERE p.st = s.st) = 1 THEN min(p.code) FILTER (WHERE p.st = s.st) END AS code
  FROM keys r LEFT JOIN parts p ON p.code = r.code CROSS JOIN (VALUES ('income'),('balance'),('cashflow')) s(st) GROUP BY ALL),
free_name AS (SELECT name_key, arg_min(sub_code, k) AS sub_code FROM keys WHERE code IS NULL GROUP BY name_key),
labels_ AS (SELECT k, sub_code AS own_code, k % 2 = 0 AS coded, sub_name_raw, {norm_sql("'[' || sub_code || '] ' || sub_name_raw")} AS with_code, {norm_sql("sub_name_raw")} AS plain FROM recs),
names2 AS (SELECT k, own_code, coded, CASE WHEN coded THEN with_code ELSE regexp_replace(plain, '^(附注)+', '') END AS n1,
    CASE WHEN coded AND starts_with(with_code, own_code) THEN regexp_replace(with_code[7:], '^(附注)+', '') END AS n2 FROM labels_),
found3 AS (
  SELECT n.k, s.st, coalesce(CASE WHEN n.coded THEN c.code END, b1.code, b2.code,
     'cas2020_' || coalesce(CASE WHEN n.coded AND r.code IS NULL THEN n.own_code END, f1.sub_code, f2.sub_code)) AS code
  FROM names2 n CROSS JOIN (VALUES ('income'),('balance'),('cashflow')) s(st)
  JOIN recs r ON r.k = n.k
  LEFT JOIN by_code c ON c.sub_code = n.own_code AND c.st = s.st
  LEFT JOIN by_name b1 ON b1.name_key = n.n1 AND b1.st = s.st LEFT JOIN by_name b2 ON b2.name_key = n.n2 AND b2.st = s.st
  LEFT JOIN free_name f1 ON f1.name_key = n.n1 LEFT JOIN free_name f2 ON f2.name_key = n.n2)
SELECT k AS row_id, max(code) FILTER (WHERE st='income') AS match_income, max(code) FILTER (WHERE st='balance') AS match_balance,
  max(code) FILTER (WHERE st='cashflow') AS match_cashflow FROM found3 GROUP BY k"""

# ---------------------------------------------------------------- evaluation

SQL["match_quality"] = f"""WITH {ROW_LABELS}, {DICTIONARY},
cases AS (
  SELECT CASE WHEN NOT contains(r.label, '明细') THEN {quoted(r["metric_code"] for r in base_metric_rows())}[(r.row_id // 10000) % 100000 % {N} + 1] END AS e,
         f.code AS p, CASE WHEN r.row_id % 3 <> 0 THEN 'required' ELSE 'optional_only' END AS s
  FROM row_labels r JOIN found f ON f.label = r.label AND f.st = r.statement_type),
c AS (
  SELECT coalesce(s, 'all_cases') AS split, count(*) AS total, count(*) FILTER (WHERE e IS NOT DISTINCT FROM p) AS exact_match,
    count(*) FILTER (WHERE e = p) AS tp, count(*) FILTER (WHERE e IS NULL AND p IS NOT NULL) AS fp,
    count(*) FILTER (WHERE e IS NOT NULL AND e IS DISTINCT FROM p) AS fn, count(*) FILTER (WHERE e IS NULL AND p IS NULL) AS tn
  FROM cases GROUP BY ROLLUP (s)),
d AS (SELECT *, exact_match / total AS x, tp / (tp + fp) AS pr, tp / (tp + fn) AS re, fp / (fp + tn) AS fr FROM c)
SELECT split, total, exact_match, tp, fp, fn, tn, round(x, 9) AS exact_match_rate, round(pr, 9) AS positive_precision, round(re, 9) AS positive_recall,
  round(2*pr*re/(pr+re), 9) AS positive_f1, round(fr, 9) AS false_positive_rate_on_negatives, x >= 0.9 AND fr <= 0.1 AS passed FROM d"""

SQL["percentile_all_lines"] = """
WITH v AS (SELECT l_orderkey, l_extendedprice::DOUBLE AS price FROM lineitem),
g AS (SELECT NULL::BIGINT AS l_orderkey, list(price ORDER BY price) AS p FROM v UNION ALL SELECT l_orderkey, list(price ORDER BY price) FROM v GROUP BY l_orderkey)
SELECT l_orderkey, p[1 + round_even(0.75 * (len(p) - 1), 0)::BIGINT] AS p75 FROM g"""
SQL["json_array_items"] = "SELECT doc_id, source, md5(text) AS text_md5, length(text)::INTEGER AS n_chars FROM documents"
SQL["nearest_rank_percentile"] = """
SELECT event_type, list_sort(list(value))[CAST(round_even(0.95 * (count(*) - 1), 0) AS INT) + 1] AS p95 FROM events GROUP BY event_type"""

SQL["extraction_quality"] = f"""WITH {HTML}, n AS (SELECT count(DISTINCT report_id) AS t, count(*) AS c, count(value) AS v FROM grid)
SELECT 1.0 AS doc_success_rate, t AS tables_total, 1.0 AS table_success_rate, 1.0 AS statement_table_rate, 1.0 AS table_unit_rate,
  1.0 AS table_currency_rate, c // 3 AS rows_total, c AS cells_total, round(v / c, 9) AS numeric_cell_rate, 1.0 AS core_metric_match_rate,
  1.0 AS meta_currency_rate, 1.0 AS meta_units_rate, 1.0 AS meta_period_end_rate FROM n"""

SQL["quality_kpis"] = f"""WITH {HTML}, {BALANCE},
m(kpi, value) AS (
  SELECT 'evidence_link_rate', 1.0 UNION ALL SELECT 'required_field_presence', 1.0 UNION ALL
  SELECT 'table_extraction_success_rate', (SELECT count(*) FROM kept) / (SELECT count(DISTINCT o_custkey) FROM orders) UNION ALL
  SELECT 'column_alignment_accuracy', (SELECT avg(CASE WHEN n = 3 THEN 1.0 ELSE 0.0 END) FROM (SELECT count(value) AS n FROM grid GROUP BY report_id, p)) UNION ALL
  SELECT 'unit_currency_detection_rate', 1.0 UNION ALL SELECT 'period_detection_rate', 1.0 UNION ALL
  SELECT 'integrity_checks_pass_rate', (SELECT (count(*) + count(*) FILTER (WHERE status = 'pass')) / (2 * count(*)) FROM (
     SELECT {passes("assets", "(owed + equity)")} FROM wide))),
k(kpi, threshold, scope) AS (VALUES ('evidence_link_rate',1.0,'report'),('required_field_presence',0.98,'report'),('table_extraction_success_rate',0.90,'dataset'),
  ('column_alignment_accuracy',0.95,'table'),('unit_currency_detection_rate',0.95,'table'),('period_detection_rate',0.95,'report'),('integrity_checks_pass_rate',0.98,'report'))
SELECT kpi, scope, CAST(threshold AS DOUBLE) AS threshold, round(CAST(value AS DOUBLE), 9) AS value, value >= threshold AS passed FROM k JOIN m USING (kpi)"""

SQL["raw_label_share"] = f"""WITH {ROW_LABELS}, {DICTIONARY}
SELECT ['text','layout','scan'][r.row_id % 3 + 1] AS engine, CASE WHEN r.statement_type = 'balance' THEN 'stock' ELSE 'flow' END AS fact_type,
  count(*) AS n, count(*) FILTER (WHERE f.code IS NULL) AS n_raw, round(count(*) FILTER (WHERE f.code IS NULL) / count(*), 9) AS raw_share
FROM row_labels r JOIN found f ON f.label = r.label AND f.st = r.statement_type GROUP BY ALL"""

SQL["citation_coverage"] = f"""WITH {RERANKED}
SELECT count(*) AS n, count(*) FILTER (WHERE source_path IS NOT NULL AND page IS NOT NULL) / count(*) AS coverage FROM top"""

SQL["gold_scores"] = f"""WITH {consensus(1)},
gold AS (SELECT report_id, metric_id, as_of_date, unit, consolidation_scope, max(value) AS g FROM stock GROUP BY ALL),
j AS (SELECT g, f.value AS p FROM gold LEFT JOIN facts f ON f.fact_type = 'stock' AND f.resolution_method = 'consensus' AND f.report_id = gold.report_id AND f.metric_id = gold.metric_id
  AND f.as_of_date = gold.as_of_date AND f.unit IS NOT DISTINCT FROM gold.unit AND f.consolidation_scope IS NOT DISTINCT FROM gold.consolidation_scope)
SELECT count(*) AS n_gold, round(count(p) / count(*), 9) AS completeness, round(count(*) FILTER (WHERE abs(g - p) <= 0.01) / count(*), 9) AS field_accuracy,
  round(count(*) FILTER (WHERE abs(g - p) <= 0.01) / count(p), 9) AS numeric_accuracy FROM j"""

# ---------------------------------------------------------------- dimensions and run log

SQL["ingest_summary"] = f"""WITH {HTML},
s AS (SELECT report_id, 1 AS tables, count(DISTINCT p) AS rows, count(*) AS cells, count(value) AS stock_facts FROM grid GROUP BY 1),
a AS (SELECT DISTINCT o_custkey AS report_id, 2 AS pages FROM orders),
j AS (SELECT a.report_id, pages, coalesce(tables,0) AS tables, coalesce(rows,0) AS rows, coalesce(cells,0) AS cells, 0 AS flow_facts, coalesce(stock_facts,0) AS stock_facts FROM a LEFT JOIN s USING (report_id))
SELECT *, '{{"pages":' || pages || ',"tables":' || tables || ',"rows":' || rows || ',"cells":' || cells || ',"flow_facts":' || flow_facts || ',"stock_facts":' || stock_facts || '}}' AS summary_json FROM j"""

SQL["ingest_modes"] = f"""WITH {REGISTRY},
one AS (SELECT d.doc_no, coalesce(CASE WHEN p.hash IS NOT NULL THEN 1 END, CASE WHEN d.doc_no > min(d.doc_no) OVER (PARTITION BY d.hash) THEN min(d.doc_no) OVER (PARTITION BY d.hash) END) AS known
  FROM docs d LEFT JOIN prior p USING (hash))
SELECT CASE WHEN known IS NULL THEN 'running' ELSE 'skipped' END AS status, CASE WHEN known IS NOT NULL THEN '{{"reason":"duplicate"}}' END AS summary_json,
  count(*) AS n, sum(coalesce(known, doc_no))::BIGINT AS report_ids FROM one GROUP BY ALL"""

SQL["company_dimension"] = """
SELECT DISTINCT c_mktsegment || ' ' || (c_nationkey % 5) AS name, CASE WHEN c_nationkey % 3 <> 0 THEN CAST(c_nationkey % 4 AS VARCHAR) END AS ticker,
  c_nationkey % 3 = 0 AS was_stored FROM customer"""

SQL["metric_dimension"] = f"""WITH {ROW_LABELS}, {DICTIONARY},
u AS (SELECT coalesce(f.code, 'raw_' || left(sha1(r.statement_type || ':' || n.nl), 12)) AS metric_code, r.label, r.statement_type, r.row_id
  FROM row_labels r JOIN names n USING (label) JOIN found f ON f.label = r.label AND f.st = r.statement_type)
SELECT metric_code, arg_min(label, row_id) AS metric_name, arg_min(statement_type, row_id) AS metric_statement,
  CASE WHEN arg_min(statement_type, row_id) = 'balance' THEN 'stock' ELSE 'flow' END AS value_nature, '1' AS unit_default FROM u GROUP BY 1"""

SQL["page_upsert"] = """
SELECT o_custkey AS report_id, o_orderkey AS page,
  CASE WHEN o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_custkey % 4 = 0) THEN CASE o_custkey % 4 WHEN 0 THEN '<table></table>' WHEN 1 THEN 'plain' END ELSE 'new' END AS text_md,
  CASE WHEN o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_custkey % 4 = 0) THEN 'old' ELSE 'new' END AS text_raw FROM orders"""

SQL["question_items"] = """WITH t AS (
  SELECT ((l_orderkey*8 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey AS row_id, l_linenumber AS n, l_returnflag AS f,
    CASE WHEN l_linenumber % 3 <> 0 THEN 'Order' || chr(10) || l_orderkey || chr(10) || chr(10) ELSE '' END || 'TABLE:' || chr(10) || 'qty' || chr(9) ||
    CAST(l_quantity AS INT) || chr(10) || 'line' || chr(9) || l_linenumber || chr(10) || chr(10) || ' ' || chr(10) || l_returnflag AS body FROM lineitem),
h AS (SELECT *, sha256(body) AS h, CASE WHEN n % 2 = 0 THEN 'q' || row_id ELSE left(sha256(body), 12) END AS qa_id FROM t)
SELECT row_id, qa_id, left(h, 32) AS doc_id, 'finqa::lines.json::' || qa_id AS source_path,
  CASE n % 4 WHEN 1 THEN 'How many?' WHEN 2 THEN 'What line?' WHEN 3 THEN 'Which flag?' END AS question,
  CASE WHEN n % 2 = 1 THEN '42' ELSE f END AS answer, md5(body) AS text_md5 FROM h"""

SQL["layout_pages"] = """WITH i AS (
  SELECT l_orderkey AS report_id, l_linenumber % 2 + 1 AS page, l_linenumber AS n, l_partkey AS p, l_suppkey % 9 AS lv,
    ((l_orderkey*8 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey AS pos FROM lineitem WHERE l_partkey % 3 < 2),
m AS (
  SELECT *, CASE WHEN p % 3 = 0 THEN CASE WHEN lv > 0 THEN repeat('#', least(lv, 6)) || ' ' ELSE '' END || 'item ' || p
    ELSE CASE WHEN n % 3 <> 0 THEN '### cap' || chr(10) || chr(10) ELSE '' END || '<table>' || p || '</table>' || CASE WHEN n % 3 = 1 THEN chr(10) || chr(10) || 'note' ELSE '' END END AS md,
    CASE WHEN p % 3 = 0 THEN 'item ' || p ELSE nullif(concat_ws(chr(10), CASE WHEN n % 3 <> 0 THEN 'cap' END, CASE WHEN n % 3 = 1 THEN 'note' END), '') END AS raw FROM i)
SELECT report_id, 'layout' AS engine, page, string_agg(md, chr(10) || chr(10) ORDER BY pos) AS text_md, coalesce(string_agg(raw, chr(10) ORDER BY pos), '') AS text_raw FROM m GROUP BY ALL"""

# ---------------------------------------------------------------- streams

SQL["stream_unseen"] = "SELECT sha256(text) AS hash, left(sha256(text), 32) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1, 2"
SQL["stream_sessions"] = """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations)
SELECT conv_id AS session_id, min(turn) AS created_at, max(turn) AS updated_at, count(*) AS n_messages,
  min(turn) FILTER (WHERE b <= 3) AS first_kept, count(*) FILTER (WHERE b <= 3) AS n_kept FROM r GROUP BY conv_id"""

SQL["resolution_summary"] = f"""WITH {consensus(1)},
s AS (SELECT report_id, count(*) FILTER (WHERE fact_type='flow') AS flow_candidates, count(*) FILTER (WHERE fact_type='stock') AS stock_candidates FROM candidates GROUP BY 1),
m AS (SELECT report_id, count(*) FILTER (WHERE fact_type='flow') AS flow_facts, count(*) FILTER (WHERE fact_type='stock') AS stock_facts,
  count(*) FILTER (WHERE fact_type='flow' AND multi_engine) AS flow_groups_multi_engine, count(*) FILTER (WHERE fact_type='stock' AND multi_engine) AS stock_groups_multi_engine,
  count(*) FILTER (WHERE fact_type='flow' AND agreed) AS flow_groups_agreed, count(*) FILTER (WHERE fact_type='stock' AND agreed) AS stock_groups_agreed FROM facts GROUP BY 1)
SELECT *, CASE WHEN flow_groups_multi_engine + stock_groups_multi_engine = 0 THEN 0.0
  ELSE round((flow_groups_agreed + stock_groups_agreed) / (flow_groups_multi_engine + stock_groups_multi_engine), 9) END AS multi_engine_agreement_rate
FROM s JOIN m USING (report_id)"""

SQL["pipeline_facts"] = f"""WITH {HTML}
SELECT report_id, ['cash_and_cash_equivalents','accounts_receivable','inventory','fixed_assets','short_term_borrowings'][p+1] AS metric_code, d AS as_of_date,
  value, 2 AS agree_count, 2 AS value_candidates, 'auto' AS resolution_status, 'consensus' AS resolution_method FROM grid WHERE value IS NOT NULL"""

# ---------------------------------------------------------------- chunkers with recursion and vectors

from tallyweave.functions.text import SEPARATORS  # noqa: E402


def _recursive(limit: int, width: int) -> str:
    """Level by level: nodes too long are split by their first mark; results are put together from the leaves up."""
    text = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
    words = lambda t: WORDS % t
    pieces = f"list_filter(list_transform(string_split(t, mark), lambda s: {trimmed('s')}), lambda s: s <> '')"
    pack = (
        f"list_reduce(list_transform({pieces}, lambda s: [s]), lambda acc, s: "
        f"CASE WHEN {words('(acc[-1] || mark || s[1])')} <= {limit} THEN list_append(acc[:-2], acc[-1] || mark || s[1]) "
        f"ELSE list_append(acc, s[1]) END)"
    )
    hard = f"list_transform(range(0, length(t), {max(1, limit - width)}), lambda i: substr(t, i + 1, {limit}))"
    parts = [f"n0 AS MATERIALIZED (SELECT doc_id, [0] AS path, {trimmed('text')} AS t FROM documents WHERE {trimmed('text')} <> '')"]
    depth = len(SEPARATORS)
    for d in range(depth):
        tests = " ".join(
            f"WHEN contains(t, {text(m)}) AND {trimmed(f'replace(t, {text(m)}, chr(32))')} <> '' THEN {text(m)}" for m in SEPARATORS[d:]
        )
        parts.append(f"o{d} AS MATERIALIZED (SELECT doc_id, path, t, CASE {tests} END AS mark FROM n{d} WHERE {words('t')} > {limit})")
        parts.append(
            f"n{d + 1} AS MATERIALIZED (SELECT doc_id, list_append(path, i) AS path, c[i] AS t "
            f"FROM (SELECT doc_id, path, {pack} AS c FROM o{d} WHERE mark IS NOT NULL) p, range(1, len(c) + 1) r(i))"
        )
    parts.append(f"r{depth} AS MATERIALIZED (SELECT doc_id, path, CASE WHEN {words('t')} <= {limit} THEN [t] ELSE {hard} END AS l FROM n{depth})")
    for d in range(depth - 1, -1, -1):
        parts.append(
            f"r{d} AS MATERIALIZED (SELECT doc_id, path, [t] AS l FROM n{d} WHERE {words('t')} <= {limit} "
            f"UNION ALL SELECT doc_id, path, {hard} FROM o{d} WHERE mark IS NULL "
            f"UNION ALL SELECT doc_id, path, {overlapped('l', width)} FROM (SELECT doc_id, path[:-2] AS path, flatten(list(l ORDER BY path[-1])) AS l "
            f"FROM r{d + 1} GROUP BY doc_id, path[:-2]))"
        )
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, i - 1 AS chunk_index, length(l[i]) AS n_chars, md5(l[i]) AS text_md5 FROM r0, range(1, len(l) + 1) r(i)"
    )


SQL["recursive_chunks"] = _recursive(80, 20)

# A sentence with its unit vector of 16 hash buckets and its words; chunks are folded as in the sentence chunker.
_VECTOR = (
    "list_transform(range(0, 16), lambda b: CAST(len(list_filter(" + TERMS % "s" + ", lambda t: CAST(('0x' || left(md5(t), 8)) AS BIGINT) % 16 = b)) AS DOUBLE))"
)
_UNITS = f"list_transform({SENTENCES}, lambda s: [struct_pack(t := s, v := {_VECTOR}, n := {WORDS % 's'})])"
_SAFE_COSINE = "coalesce(nullif(list_cosine_similarity(acc[-1].v, s[1].v), 'nan'::DOUBLE), 0)"
_LENGTH = "sqrt(list_sum(list_transform(u[1].v, lambda x: x * x)))"
_SCALED = f"list_transform(units, lambda u: [struct_pack(t := u[1].t, v := list_transform(u[1].v, lambda x: CASE WHEN {_LENGTH} = 0 THEN x ELSE x / {_LENGTH} END), n := u[1].n)])"
SQL["semantic_chunks"] = f"""WITH u AS MATERIALIZED (SELECT doc_id, {_UNITS} AS units FROM documents),
w AS MATERIALIZED (SELECT doc_id, {_SCALED} AS units FROM u WHERE len(units) > 0),
p AS MATERIALIZED (SELECT doc_id, list_transform(list_reduce(units, lambda acc, s:
  CASE WHEN acc[-1].n + s[1].n <= 200 AND {_SAFE_COSINE} >= 0.3141592
  THEN list_append(acc[:-2], struct_pack(t := acc[-1].t || ' ' || s[1].t,
    v := list_transform(list_zip(acc[-1].v, s[1].v), lambda z: (z[1] + z[2]) / 2.0), n := acc[-1].n + s[1].n))
  ELSE list_append(acc, s[1]) END), lambda x: x.t) AS packed FROM w)
SELECT doc_id, i - 1 AS chunk_index, length(c[i]) AS n_chars, md5(c[i]) AS text_md5
FROM (SELECT doc_id, {overlapped("packed", 20)} AS c FROM p) d, range(1, len(c) + 1) r(i)"""
SQL["stream_live_sessions"] = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations)
SELECT conv_id AS session_id, min(turn) AS created_at, max(turn) AS updated_at, count(*) AS n_messages,
       string_agg(turn || ':' || role, ',' ORDER BY turn, role, text) FILTER (back <= 3) AS kept FROM r GROUP BY conv_id"""
