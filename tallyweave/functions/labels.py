"""Label normalisation and the small label predicates of metric matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide how a label is read.
LEADING_ENUM = r"(?U)^\s*(?:[（(]\s*[一二三四五六七八九十\d]+\s*[）)]|[一二三四五六七八九十\d]+[、.．])\s*"
LEADING_OF_WHICH = r"(?U)^\s*其中\s*[：:]\s*"
FILL_NOTE = r"[（(][^（）()]{0,64}(?:净亏损以|亏损以|损失以|收益以|号填列|填列)[^（）()]{0,64}[）)]"
PUNCTUATION = r"""[：:（）()，,．.。;；、_\-—－/\\“”"'‘’`]+"""
SHORT_MAX = 2
GENERIC_SHORT = ("资产", "负债", "权益", "现金", "成本", "费用")
LABEL_SUFFIXES = ("合计", "小计", "净额", "总额", "余额")
LABEL_PREFIXES = ("其中", "一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "加", "减")
LOW_QUALITY = ("其他", "合计", "小计", "金额", "项目", "列", "影响", "费用税金")
STATEMENTS = ("income", "balance", "cashflow")
STATEMENT_NAMES = {
    "balance_sheet": "balance",
    "income_statement": "income",
    "cash_flow": "cashflow",
    "balance": "balance",
    "income": "income",
    "cashflow": "cashflow",
}
CORE_STATEMENTS = ("balance_sheet", "income_statement", "cash_flow")
CORE_TITLE = r"(资产负债表|利润表|损益表|现金流量表)"


def normalize_label(label: Column) -> Column:
    """One enumeration prefix, ``其中：``, fill-in notes, white space and marks removed; lower case."""
    out = F.coalesce(label, F.lit(""))
    for pattern in (LEADING_ENUM, LEADING_OF_WHICH, FILL_NOTE, r"(?U)[\s\x1c-\x1f　]+", PUNCTUATION):
        out = F.regexp_replace(out, pattern, "")
    return F.lower(out)


def is_ratio_label(label: Column, norm: Column) -> Column:
    return (
        F.contains(label, F.lit("%"))
        | norm.endswith("率")
        | F.contains(norm, F.lit("比率"))
        | F.contains(norm, F.lit("比例"))
    )


def sub_code(label: Column) -> Column:
    """Six-digit code in brackets anywhere, else leading the label."""
    inside = F.regexp_extract(label, r"(?U)[\[【]\s*(\d{6})\s*[\]】]", 1)
    leading = F.regexp_extract(label, r"(?U)^\s*(\d{6})\D", 1)
    return F.coalesce(F.nullif(inside, F.lit("")), F.nullif(leading, F.lit("")))


def mapping_names(norm: Column, code: Column) -> Column:
    """Names to look up: the label without its code and without repeated 附注."""
    without_code = F.when(norm.startswith(code), F.substring(norm, F.length(code) + 1, F.length(norm)))
    trimmed = F.transform(F.array(norm, without_code), lambda n: F.regexp_replace(n, "^(?:附注)+", ""))
    return F.array_distinct(F.filter(trimmed, lambda n: n.isNotNull() & (n != "")))


def raw_metric_code(label: Column, statement: Column) -> Column:
    """Stable code of a label no metric matches."""
    return F.concat(
        F.lit("raw_"), F.substring(F.sha1(F.concat(statement, F.lit(":"), normalize_label(label)).cast("binary")), 1, 12)
    )


def is_low_quality(norm: Column) -> Column:
    return (
        (F.length(norm) <= SHORT_MAX)
        | norm.isin(*LOW_QUALITY)
        | F.contains(norm, F.lit("分类"))
        | F.rlike(norm, F.lit(r"\A[0-9a-z]+\z"))
    )


def is_row_label(label: Column) -> Column:
    """A plausible row caption and no sentence of prose."""
    return (
        (label != "")
        & (F.length(label) <= 60)
        & ~F.contains(label, F.lit("。"))
        & ~F.contains(label, F.lit("，"))
        & ~(F.contains(label, F.lit("公司")) & (F.length(label) > 30))
    )


def english_name(code: Column) -> Column:
    """``snake_case`` to Title Case; a letter after a digit starts a word too."""
    words = F.replace(code, F.lit("_"), F.lit(" "))
    parts = F.regexp_extract_all(words, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, F.initcap), "")


def mapped_statement(statement: Column) -> Column:
    """Parser vocabulary to dictionary vocabulary."""
    return F.coalesce(*[F.when(statement == parser, F.lit(name)) for parser, name in STATEMENT_NAMES.items()])


def is_core_table(statement: Column, title: Column, section_title: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(section_title, F.lit("")))
    return F.coalesce(F.trim(statement).isin(*CORE_STATEMENTS), F.lit(False)) | F.rlike(text, F.lit(CORE_TITLE))
