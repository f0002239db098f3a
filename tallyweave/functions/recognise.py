"""Recognisers for report text: statements, units, years, dates, numbers, HTML cells."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.text import lines, strip
from tallyweave.functions.vectors import let

# Keywords, unit words and patterns that decide what is recognised.
STATEMENT_KEYWORDS = {
    "balance_sheet": ("资产负债表", "合并资产负债表", "balance sheet", "statement of financial position"),
    "income_statement": ("利润表", "合并利润表", "income statement", "statement of profit", "statement of operations"),
    "cash_flow": ("现金流量表", "合并现金流量表", "cash flow"),
    "changes_in_equity": ("所有者权益变动表", "股东权益变动表", "changes in equity"),
}
UNIT_WORDS = (
    ("万元", "CNY", "10k"),
    ("千元", "CNY", "1k"),
    ("元", "CNY", "1"),
    ("人民币", "CNY", None),
    ("USD", "USD", None),
    ("美元", "USD", None),
)
NUMBER = r"(?U)(?<![\w.%])[(]?-?\d{1,3}(?:,\d{3})*(?:\.\d+)?[)]?(?![\w.%])"
DATE = r"(?U)(20\d{2})\s*[年\-/]\s*(\d{1,2})\s*[月\-/]\s*(\d{1,2})"
YEAR = r"(?U)(20\d{2})"
UNIT_HINT = r"(?U)单位\s*[:：]?\s*([^\n；;。]{1,24})"
RULE_CODE = r"(?iU)[\[【]\s*([0-9]{6}[a-z]?)\s*[\]】]"
CELL_TAG = r"(?is)^<t[dh]\b([^>]*)>"
HEADER_WORDS = ("项目", "期末", "期初", "本期", "上期")
# References as HTML reads them: numbers, and names with up to 32 characters; the older names also count without a semicolon.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
OLD_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
ENTITY_NAMES = "\x01".join(f"{name}\x02{chars}" for name, chars in html5.items())
# Numbers from 128 to 159 are read as Windows-1252, where that has a character.
CONTROL_NUMBERS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0: "\ufffd", 0x0D: "\r"}

DECIMAL = "decimal(38,6)"
CELL_TYPE = f"struct<value:{DECIMAL},raw_text:string>"


def contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def statement_by_keyword(text: Column, lowered: Column | None = None) -> Column:
    """Statement type of the first keyword found; ``lowered`` is the text in lower case if that is there already."""
    lowered = F.lower(text) if lowered is None else lowered
    return F.coalesce(*[F.when(contains_any(lowered, keys), F.lit(s)) for s, keys in STATEMENT_KEYWORDS.items()])


def rule_codes(text: Column) -> Column:
    """All bracketed rule codes in order, lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(RULE_CODE), F.lit(1)), F.lower)


def detect_statement(text: Column, rule_map: Column | None = None, lowered: Column | None = None) -> Column:
    """Statement type by keyword, else by the first rule code that ``rule_map`` knows.

    ``rule_map`` is a ``map<string,string>`` column of code to statement.  Each
    keyword would put the text in lower case anew, so costly loops pass it ``lowered``.
    """
    found = statement_by_keyword(text, lowered)
    if rule_map is None:
        return found
    mapped = F.filter(F.transform(rule_codes(text), lambda c: F.try_element_at(rule_map, c)), lambda s: s.isNotNull())
    return F.coalesce(found, F.get(mapped, 0))


def _first_word(text: Column, field: int) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(w[0])), F.lit(w[field])) for w in UNIT_WORDS if w[field]])


def detect_currency(text: Column) -> Column:
    """First currency word of the text; without any unit word a unit hint may name it."""
    hint = F.regexp_extract(text, UNIT_HINT, 1)
    return F.coalesce(_first_word(text, 1), F.when(detect_units(text).isNull(), _first_word(hint, 1)))


def detect_units(text: Column) -> Column:
    return F.coalesce(_first_word(text, 2), _first_word(F.regexp_extract(text, UNIT_HINT, 1), 2))


def first_year(text: Column) -> Column:
    return F.regexp_extract(text, YEAR, 1).try_cast("int")


def all_years(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(YEAR), F.lit(1))


def first_date(text: Column) -> Column:
    """Date of the first match; an impossible date gives NULL."""
    day = F.regexp_extract(text, DATE, 0)
    part = lambda i: F.lpad(F.regexp_extract(text, DATE, i), 2, "0")
    joined = F.concat_ws("-", F.regexp_extract(text, DATE, 1), part(2), part(3))
    return F.when(day != "", F.try_to_date(joined, "yyyy-MM-dd"))


def number_texts(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0))


def number_value(raw: Column) -> Column:
    """Value of one number text: ``(…)`` is negative, a single bracket gives NULL."""

    def read(plain: Column) -> Column:
        opens, closes = plain.startswith("("), plain.endswith(")")
        inner = F.substring(plain, 2, 1000)
        inside = F.left(inner, F.length(inner) - 1).try_cast(DECIMAL)
        # texts without a number never reach the cast: each cast that fails costs an exception
        return F.when((plain != "") & (opens == closes), F.when(opens, -inside).otherwise(plain.try_cast(DECIMAL)))

    return let(F.replace(raw, F.lit(","), F.lit("")), read)


def numbers(line: Column) -> Column:
    """All numbers of a line as ``array<struct<value,raw_text>>``."""
    return F.transform(
        number_texts(line), lambda r: F.struct(number_value(r).alias("value"), r.alias("raw_text")).cast(CELL_TYPE)
    )


def first_number(text: Column) -> Column:
    return number_value(F.regexp_extract(text, NUMBER, 0))


def strip_numbers(line: Column) -> Column:
    """The row label that stays when numbers are taken out."""
    return strip(F.regexp_replace(F.regexp_replace(line, NUMBER, " "), r"(?U)[\s\x1c-\x1f]{2,}", " "))


def numbered_character(number: Column) -> Column:
    """The character of a number in a reference; NULL counts as too large, and numbers of no character give an empty text."""
    bits = lambda n: F.lpad(F.hex(n), 8, "0")
    control = F.create_map(*[F.lit(v) for pair in CONTROL_NUMBERS.items() for v in pair])
    none = (
        number.between(0x01, 0x08) | number.between(0x0E, 0x1F) | (number == 0x0B) | (number == 0x7F)
        | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    return (
        F.when(number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when((number == 0) | (number == 0x0D) | number.between(0x80, 0x9F), F.try_element_at(control, number.cast("int")))
        .when(none, F.lit(""))
        .when(number == 0xFEFF, F.lit("\ufeff"))  # the decoder would take it for a byte order mark
        .otherwise(F.decode(F.unhex(bits(number)), "UTF-32"))
    )


def entity_text(entity: Column) -> Column:
    """What a reference that ``ENTITY`` matches stands for; an unknown name stays, an older one may be only its beginning."""
    names = F.str_to_map(F.lit(ENTITY_NAMES), F.lit("\x01"), F.lit("\x02"))
    digits = F.ltrim(F.regexp_extract(entity, r"^&#[xX]?([0-9a-fA-F]+)", 1), F.lit("0"))
    hexadecimal = F.rlike(entity, F.lit(r"^&#[xX]"))
    short = lambda most: F.when(F.length(digits) <= most, F.concat(F.lit("0"), digits))
    number = F.when(hexadecimal, F.conv(short(6), 16, 10)).otherwise(short(7)).cast("long")
    name = F.substring(entity, 2, 40)
    begin = F.regexp_extract(name, f"^(?:{OLD_NAMES})", 0)
    begun = F.concat(F.try_element_at(names, begin), F.substr(name, F.length(begin) + 1))
    return F.when(F.startswith(entity, F.lit("&#")), let(number, numbered_character)).otherwise(
        F.coalesce(F.try_element_at(names, name), begun, entity)
    )


def unescape(text: Column) -> Column:
    """The text with its HTML character references decoded, each once."""
    between = F.split(text, ENTITY, -1)
    decoded = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), entity_text)
    pieces = F.zip_with(between, decoded, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def cell_text(cell_html: Column) -> Column:
    plain = let(F.regexp_replace(cell_html, r"<[^>]+>", " "), unescape)
    return strip(F.replace(plain, F.lit("\u00a0"), F.lit(" ")))


def cell_span(cell_html: Column, name: str) -> Column:
    """``rowspan`` or ``colspan`` of the opening tag, 1 at least."""
    attrs = F.regexp_extract(strip(cell_html), CELL_TAG, 1)
    found = F.regexp_extract_all(attrs, F.lit(rf"""(?i)\b{name}\s*=\s*['"]?(\d+)"""), F.lit(1))
    span = F.greatest(F.lit(1), F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("int"), F.lit(1)))
    return F.when(F.contains(F.lower(cell_html), F.lit(name)), span).otherwise(1)


def last_heading(context: Column) -> Column:
    heads = F.filter(F.transform(lines(context), strip), lambda l: l.startswith("#"))
    text = strip(F.ltrim(F.try_element_at(heads, F.lit(-1)), F.lit("# ")))
    return F.nullif(text, F.lit(""))


def is_header_row(cells: Column) -> Column:
    joined = F.array_join(cells, "")
    return let(
        joined,
        lambda j: contains_any(j, HEADER_WORDS)
        | F.rlike(j, F.lit(YEAR))
        | F.forall(cells, lambda c: first_number(c).isNull()),
    )


def has_period(text: Column) -> Column:
    return F.rlike(text, F.lit(YEAR)) | F.contains(text, F.lit("本期")) | F.contains(text, F.lit("上期"))
