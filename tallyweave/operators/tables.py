"""Tables out of report pages: HTML tables first, runs of number lines otherwise.

Input ``pages``: report_id, engine, page, text_raw, text_md.  Both extractors
give two DataFrames:

* tables — one row per table: report_id, engine, table_key, title,
  section_title, statement_type, page_start, page_end, currency, units,
  is_consolidated, columns ``array<struct<label, period_start, period_end,
  fiscal_year, fiscal_period>>``
* rows — one row per table row: report_id, engine, table_key, row_index, label,
  page_number, cells ``array<struct<value, raw_text>>``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import recognise as R
from tallyweave.functions.labels import STATEMENTS, is_row_label, normalize_label
from tallyweave.functions.text import lines, strip
from tallyweave.functions.vectors import let
from tallyweave.operators.containment import contained
from tallyweave.operators.ordered import running
from tallyweave.operators.stage import materialize, spread, stage

TABLE = r"(?is)<table\b.*?>.*?</table>"
ROW = r"(?is)<tr\b.*?>.*?</tr>"
CELL = r"(?is)<t[dh]\b.*?>.*?</t[dh]>"
BEFORE_CHARS, AFTER_CHARS = 1200, 800
KEY = ["report_id", "engine", "table_key"]
COLUMN_TYPE = "struct<label:string,period_start:date,period_end:date,fiscal_year:int,fiscal_period:string>"
PAGES_PER_BLOCK = 64
# A task reads the lines of about so many pages or characters at most, so that none has to be spilled.
TASK_PAGES, TASK_CHARS = 25_000, 8_000_000
# Reports with more pages are cut into blocks; the sketch that finds them keeps this many reports at most.
HOT_PAGES, SKETCH_REPORTS = 5_000, 8192


# ---------------------------------------------------------------- row statement vote


def statement_scores(label: Column, patterns: dict[str, list[str]]) -> dict[str, Column]:
    """Per statement: how many dictionary phrases the label contains.

    The phrases are literals of the expression (a few hundred short strings), so
    rows are scored where they are read.
    """
    norm = normalize_label(label)

    def score(found: list[str]) -> Column:
        if not found:
            return F.lit(0)
        known = F.array(*[F.lit(p) for p in found])
        return let(norm, lambda n: F.size(F.filter(known, lambda p: F.contains(n, p))))

    return {s: score(patterns.get(s, [])) for s in STATEMENTS}


def best_statement(scores: dict[str, Column]) -> Column:
    """Highest score, the earlier statement on a tie; NULL when all are 0."""
    top = F.greatest(*scores.values())
    return F.when(top > 0, F.coalesce(*[F.when(scores[s] == top, F.lit(s)) for s in STATEMENTS]))


def phrase_scores(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, points of each statement) of tables by a dictionary of any size: rows(key, label), phrases(statement_type, phrase).

    A phrase that several metrics list counts once for each.  Tables without a hit are left out.
    """
    named = phrases.select("statement_type", normalize_label(F.col("phrase")).alias("phrase")).filter("phrase <> ''")
    points = [F.count_if(F.col("statement_type") == s).alias(f"points_{s}") for s in STATEMENTS]
    weights = named.groupBy("phrase").agg(*points)
    labels = materialize(rows.select(*KEY, normalize_label(F.col("label")).alias("text")), "vote-labels")
    total = lambda c: F.sum(c).alias(c)
    each = [f"points_{s}" for s in STATEMENTS]
    by_text = contained(labels, weights).groupBy("text").agg(*map(total, each))
    return labels.join(by_text, "text").groupBy(*KEY).agg(*map(total, each))


def vote_by_rows(tables: DataFrame, rows: DataFrame, patterns: dict[str, list[str]] | DataFrame) -> DataFrame:
    """(key, voted): statement of the given tables by the phrases in their row labels.

    Only rows of these tables are scored.  ``patterns`` are a few phrases per
    statement, or a table (statement_type, phrase) such as ``matching.loose_phrases`` of a loaded dictionary.
    """
    asked = rows.join(tables.select(*KEY), KEY, "left_semi")
    if isinstance(patterns, DataFrame):
        sums = phrase_scores(asked, patterns)
        return sums.select(*KEY, best_statement({s: F.col(f"points_{s}") for s in STATEMENTS}).alias("voted"))
    scored = stage(asked, {f"points_{s}": c for s, c in statement_scores(F.col("label"), patterns).items()}, KEY)
    sums = scored.groupBy(*KEY).agg(*[F.sum(f"points_{s}").alias(f"points_{s}") for s in STATEMENTS])
    return sums.select(*KEY, best_statement({s: F.col(f"points_{s}") for s in STATEMENTS}).alias("voted"))


# ---------------------------------------------------------------- HTML tables


def expand_grid(raw_rows: Column) -> Column:
    """Fan merged cells out into a full grid of texts.

    ``raw_rows`` is ``array<array<struct<text,rowspan,colspan>>>``.  Cells that
    span rows are carried down in a map from column to (text, rows left).
    """
    carry_type = "map<int,struct<text:string,left:int>>"
    row_type = "map<int,string>"
    inner_type = f"struct<col:int,row:{row_type},carry:{carry_type}>"
    outer_type = f"struct<rows:array<{row_type}>,carry:{carry_type}>"

    def place(acc: Column, cell: Column) -> Column:
        open_cols = F.filter(
            F.sequence(acc["col"], acc["col"] + F.size(acc["row"])), lambda i: ~F.map_contains_key(acc["row"], i)
        )
        return let(F.get(open_cols, 0), lambda col: placed(acc, cell, col))

    def placed(acc: Column, cell: Column, col: Column) -> Column:
        held = F.create_map(col, F.struct(cell["text"].alias("text"), (cell["rowspan"] - 1).alias("left")))
        others = F.map_filter(acc["carry"], lambda k, _: k != col)
        return F.struct(
            (col + 1).alias("col"),
            F.map_concat(acc["row"], F.create_map(col, cell["text"])).alias("row"),
            F.when(cell["rowspan"] > 1, F.map_concat(others, held)).otherwise(acc["carry"]).alias("carry"),
        ).cast(inner_type)

    def one_row(acc: Column, cells: Column) -> Column:
        spread = F.flatten(F.transform(cells, lambda c: F.array_repeat(F.struct(c["text"], c["rowspan"]), c["colspan"])))
        still = F.map_filter(acc["carry"], lambda _, v: v["left"] > 1)
        start = F.struct(
            F.lit(0).alias("col"),
            F.transform_values(acc["carry"], lambda _, v: v["text"]).alias("row"),
            F.transform_values(still, lambda _, v: F.struct(v["text"].alias("text"), (v["left"] - 1).alias("left"))).alias(
                "carry"
            ),
        ).cast(inner_type)
        done = F.aggregate(spread, start, place)
        return let(
            done,
            lambda d: F.struct(F.concat(acc["rows"], F.array(d["row"])).alias("rows"), d["carry"].alias("carry")).cast(
                outer_type
            ),
        )

    empty = F.struct(
        F.array().cast(f"array<{row_type}>").alias("rows"),
        F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<struct<text:string,left:int>>")).alias(
            "carry"
        ),
    ).cast(outer_type)
    spanned = F.aggregate(raw_rows, empty, one_row, lambda acc: acc["rows"])

    def pad_maps(maps: Column) -> Column:
        width = F.array_max(F.transform(maps, lambda m: F.coalesce(F.array_max(F.map_keys(m)), F.lit(-1)))) + 1
        return let(
            width,
            lambda w: F.transform(
                maps,
                lambda m: F.when(
                    w > 0,
                    F.transform(F.sequence(F.lit(0), w - 1), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(""))),
                ).otherwise(F.array().cast("array<string>")),
            ),
        )

    def pad_plain(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, F.size))
        return let(
            width,
            lambda w: F.transform(
                rows,
                lambda r: F.concat(F.transform(r, lambda c: c["text"]), F.array_repeat(F.lit(""), w - F.size(r))),
            ),
        )

    has_spans = F.exists(raw_rows, lambda r: F.exists(r, lambda c: (c["rowspan"] > 1) | (c["colspan"] > 1)))
    return F.when(has_spans, let(spanned, pad_maps)).otherwise(pad_plain(raw_rows))


def merge_header(rows: Column) -> Column:
    """Per column: the texts of all header rows, without blanks and direct repeats."""
    width = F.size(F.get(rows, 0))

    def column_text(i: Column) -> Column:
        values = F.filter(F.transform(rows, lambda r: strip(F.get(r, i))), lambda v: v != "")
        kept = F.filter(values, lambda v, j: (j == 0) | (v != F.get(values, j - 1)))
        return F.array_join(kept, " ")

    return F.transform(F.sequence(F.lit(0), width - 1), column_text)


def html_tables(pages: DataFrame, patterns: dict[str, list[str]], rule_map: Column | None = None):
    """Tables of pages that carry ``<table>`` markup: ``(tables, rows)``.

    Everything about a table lies in its own page, so no shuffle is needed; the
    parsed tables are written once and read by both results.
    """
    found = (
        spread(pages)
        .filter(F.contains("text_md", F.lit("<table")))
        .select(
            "report_id",
            "engine",
            "page",
            "text_md",
            F.regexp_extract_all("text_md", F.lit(TABLE), F.lit(0)).alias("tables"),
            F.split("text_md", TABLE, -1).alias("gaps"),
        )
        .select("*", F.posexplode("tables").alias("table_no", "html"))
    )
    length = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda acc, p: acc + F.length(p))
    start = length(F.col("gaps"), F.col("table_no") + 1) + length(F.col("tables"), F.col("table_no"))
    raw_rows = F.filter(
        F.transform(
            F.regexp_extract_all("html", F.lit(ROW), F.lit(0)),
            lambda r: F.transform(
                F.regexp_extract_all(r, F.lit(CELL), F.lit(0)),
                lambda c: F.struct(
                    R.cell_text(c).alias("text"),
                    R.cell_span(c, "rowspan").alias("rowspan"),
                    R.cell_span(c, "colspan").alias("colspan"),
                ),
            ),
        ),
        lambda r: F.exists(r, lambda c: c["text"] != ""),
    )
    place = ["report_id", "engine", "page", "table_no"]
    placed = stage(found, {"start": start, "raw_rows": raw_rows}, [*place, "text_md", "html"]).select(
        *place,
        F.substring(
            "text_md", F.greatest(F.col("start") - BEFORE_CHARS, F.lit(0)) + 1, F.least(F.col("start"), F.lit(BEFORE_CHARS))
        ).alias("before"),
        F.substring("text_md", F.col("start") + F.length("html") + 1, F.lit(AFTER_CHARS)).alias("after"),
        "raw_rows",
    )
    place += ["before", "after"]
    grids = stage(placed.filter(F.size("raw_rows") > 0), {"grid": expand_grid(F.col("raw_rows"))}, place)
    first_data = F.array_position(F.transform("grid", R.is_header_row), F.lit(False))
    headed = stage(grids, {"first_data": first_data.cast("int")}).filter("first_data > 0")
    header = F.when(F.col("first_data") > 1, merge_header(F.slice("grid", 1, F.col("first_data") - 1)))
    split = stage(
        headed.filter(F.size(F.get("grid", 0)) >= 3),
        {"header": F.coalesce(header, F.get("grid", 0)), "n_cols": F.size(F.get("grid", 0)) - 1},
    )
    context = F.concat(F.col("before"), F.lit("\n"), F.col("after"))
    labels = (
        F.when(R.is_header_row(F.col("header")), F.slice("header", 2, F.col("n_cols")))
        .otherwise(
            F.transform(F.sequence(F.lit(1), F.col("n_cols")), lambda i: F.concat(F.lit("col_"), i.cast("string")))
        )
    )
    table_rows = F.filter(
        F.transform(
            F.slice("grid", F.col("first_data"), F.size("grid")),
            lambda r: F.struct(
                strip(F.get(r, 0)).alias("label"),
                F.transform(
                    F.slice(r, 2, F.col("n_cols")),
                    lambda c: F.struct(
                        R.first_number(c).alias("value"), F.nullif(c, F.lit("")).alias("raw_text")
                    ).cast(R.CELL_TYPE),
                ).alias("cells"),
            ),
        ),
        lambda r: r["label"] != "",
    )
    labelled = stage(
        split,
        {
            "table_key": F.concat_ws(":", F.lit("h"), F.col("page"), F.col("table_no")),
            "context": context,
            "title": R.last_heading(F.col("before")),
            "labels": labels,
            "rows": table_rows,
        },
        ["report_id", "engine", "page"],
    )
    with_numbers = F.size(F.filter("rows", lambda r: F.exists(r["cells"], lambda c: c["value"].isNotNull())))

    def column(label: Column) -> Column:
        year = R.first_year(label)
        year_end = F.when(year.isNotNull(), F.make_date(year, F.lit(12), F.lit(31)))
        return F.struct(
            label.alias("label"),
            F.lit(None).cast("date").alias("period_start"),
            F.coalesce(R.first_date(label), year_end, F.col("context_date")).alias("period_end"),
            year.alias("fiscal_year"),
            F.lit(None).cast("string").alias("fiscal_period"),
        ).cast(COLUMN_TYPE)

    scored = stage(
        labelled.filter(with_numbers >= 3),
        {
            "by_context": R.detect_statement(F.col("context"), rule_map),
            "context_date": R.first_date(F.col("context")),
        },
    )

    def table_score(statement: str) -> Column:
        points = F.transform("rows", lambda r: statement_scores(r["label"], patterns)[statement])
        return F.when(F.col("by_context").isNull(), F.aggregate(points, F.lit(0), lambda acc, v: acc + v))

    if isinstance(patterns, DataFrame):
        scored = materialize(scored, "html-scored")
        labels = scored.filter("by_context IS NULL").select(*KEY, F.explode("rows").alias("row")).select(*KEY, F.col("row.label").alias("label"))
        points = phrase_scores(labels, patterns).withColumnsRenamed({f"points_{s}": f"score_{s}" for s in STATEMENTS})
        with_scores = scored.join(points, KEY, "left").fillna(0, [f"score_{s}" for s in STATEMENTS])
    else:
        with_scores = stage(scored, {f"score_{s}": table_score(s) for s in STATEMENTS})
    typed = with_scores.withColumn(
        "statement_type",
        F.coalesce(F.col("by_context"), best_statement({s: F.col(f"score_{s}") for s in STATEMENTS})),
    )
    kept = typed.filter(
        R.has_period(F.array_join("labels", " "))
        | F.col("statement_type").isNotNull()
        | F.coalesce(F.contains("title", F.lit("表")), F.lit(False))
    )
    # Tables and rows are two views of the same costly parse.
    columns = [*KEY, "page", "title", "statement_type", "context", "labels", "context_date", "rows"]
    kept = materialize(kept.select(*columns), "html-tables")
    tables = kept.select(
        *KEY,
        "title",
        F.col("title").alias("section_title"),
        "statement_type",
        F.col("page").alias("page_start"),
        F.col("page").alias("page_end"),
        R.detect_currency(F.col("context")).alias("currency"),
        R.detect_units(F.col("context")).alias("units"),
        F.contains("context", F.lit("合并")).alias("is_consolidated"),
        F.transform("labels", column).alias("columns"),
    )
    rows = kept.select(*KEY, "page", F.posexplode("rows").alias("row_index", "row")).select(
        *KEY, "row_index", F.col("row.label"), F.col("page").alias("page_number"), F.col("row.cells")
    )
    return tables, rows


# ---------------------------------------------------------------- text tables


def guess_columns(header_text: Column, n_cols: Column) -> Column:
    """Column structs of a text table: period words, then years, then ``col_i``."""
    years = R.all_years(header_text)
    both = F.contains(header_text, F.lit("本期")) & F.contains(header_text, F.lit("上期")) & (n_cols >= 2)
    one_year = (F.size(years) == 1) & (n_cols == 2)
    year = F.get(years, 0)
    labels = (
        F.when(both, F.array(F.lit("current_period"), F.lit("prior_period")))
        .when(F.size(years) >= n_cols, F.slice(years, F.size(years) - n_cols + 1, n_cols))
        .when(one_year, F.array(year, (year.try_cast("int") - 1).cast("string")))
        .otherwise(F.transform(F.sequence(F.lit(1), n_cols), lambda i: F.concat(F.lit("col_"), i.cast("string"))))
    )
    day = R.first_date(header_text)
    return F.transform(
        labels,
        lambda l: F.struct(
            l.alias("label"),
            F.lit(None).cast("date").alias("period_start"),
            day.alias("period_end"),
            F.when(F.rlike(l, F.lit(r"\A\d{4}\z")), l.try_cast("int")).alias("fiscal_year"),
            F.lit(None).cast("string").alias("fiscal_period"),
        ).cast(COLUMN_TYPE),
    )


def text_tables(pages: DataFrame, patterns: dict[str, list[str]] | DataFrame, rule_map: Column | None = None, with_table: bool = False):
    """Tables from runs of number lines: ``(tables, rows)``.

    A table opens at a line with a label and two numbers, goes on over lines
    with a label and one number, and ends at any other line.  Whether a line
    belongs to a table follows from two running maxima, the last line that
    cannot be a row and the last that can open a table.  The pages of a report
    meet in one task and nothing else is shuffled; very long reports (and pages
    without a report or engine) are cut into blocks of pages instead of being
    walked line by line.

    With ``with_table`` each row also has its table's columns as the struct
    ``table``, as the join of rows and tables by their key would give them.
    """
    by_blocks = lambda some: _with_tables(*_block_tables(some, patterns, rule_map), with_table)
    if isinstance(patterns, DataFrame) or pages.isStreaming:
        return by_blocks(pages)
    group = ["report_id", "engine"]
    # A constant engine would be taken out of the windows' keys but not out of those that pages are dealt by.
    raw = stage(pages, {c: F.col(c) for c in group}, ["page", "text_raw"])
    named = F.col("report_id").isNotNull() & F.col("engine").isNotNull()
    report = F.xxhash64(*group)
    size = raw.agg(
        F.count_if(named).alias("pages"),
        F.count_if(~named).alias("others"),
        F.coalesce(F.sum(F.length("text_raw")), F.lit(0)).alias("chars"),
        F.expr(f"approx_top_k(xxhash64(report_id, engine), {SKETCH_REPORTS // 2}, {SKETCH_REPORTS})").alias("top"),
    ).first()
    hot = [item["item"] for item in size["top"] or [] if item["count"] > HOT_PAGES]
    usual = named & ~report.isin(*hot) if hot else named
    few = min(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.sparkSession.sparkContext.defaultParallelism)
    tasks = max(few, -(-size["pages"] // TASK_PAGES), -(-size["chars"] // TASK_CHARS))
    wide = _dealt_rows(raw.filter(usual).repartition(tasks, *group), patterns, rule_map)
    if with_table:  # each row meets each copy of its table
        rows = wide.withColumn("_copy", F.explode(F.sequence(F.lit(1), "n_copies"))).drop("_copy", "n_copies")
    else:
        wide = materialize(wide.drop("n_copies"), "text-tables")
        rows = wide.drop("table")
    tables = wide.filter("row_index = 0").select(*KEY, "table.*")
    if not (hot or size["others"]):
        return tables, rows
    more, more_rows = by_blocks(raw.filter(~usual))
    return tables.unionByName(more), rows.unionByName(more_rows)


def _with_tables(tables: DataFrame, rows: DataFrame, with_table: bool) -> tuple[DataFrame, DataFrame]:
    if not with_table:
        return tables, rows
    table = F.struct(*[c for c in tables.columns if c not in KEY]).alias("table")
    return tables, rows.join(tables.select(*KEY, table), KEY)


def _read_lines(pages: DataFrame, rule_map: Column | None) -> DataFrame:
    """Lines of pages with what decides whether they belong to a table; ``label`` counts only where there is a number."""
    group = ["report_id", "engine"]
    raw = pages.select(*group, "page", F.posexplode(lines(F.col("text_raw"))).alias("pos", "raw")).select(
        *group, "page", "pos", strip(F.col("raw")).alias("line")
    )
    # One number per line that orders the lines of a report; running maxima of it are cheap.
    place = F.shiftleft(F.col("page").cast("long"), 32) + F.col("pos")
    with_digit = F.rlike("line", F.lit(r"(?U)\d"))
    return stage(
        stage(
            raw,
            {
                "n_numbers": F.when(with_digit, F.size(R.number_texts(F.col("line")))).otherwise(0),
                "label": F.when(with_digit, R.strip_numbers(F.col("line"))).otherwise(""),
                "lowered": F.lower("line"),
            },
        ),
        {
            "place": place,
            "can_be_row": (F.col("n_numbers") >= 1) & (F.col("label") != ""),
            "names_statement": R.detect_statement(F.col("line"), rule_map, F.col("lowered")).isNotNull(),
        },
    ).drop("pos", "lowered")


def _is_row() -> Column:
    return (
        F.col("can_be_row")
        & F.col("last_open").isNotNull()
        & (F.col("last_break").isNull() | (F.col("last_open") > F.col("last_break")))
    )


def _table_sums(kept: Column) -> list[Column]:
    return [
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.min(F.when(kept, F.col("kept_no"))).alias("first_kept"),
        F.max(F.when(kept, F.col("n_numbers"))).alias("n_cols"),
        F.count_if(kept).alias("n_rows"),
        F.count_if(kept & (F.col("n_numbers") >= 2)).alias("n_two"),
        F.count_if(kept & (F.length("label") <= 40)).alias("n_short"),
    ]


IS_TABLE = "n_cols >= 2 AND n_rows >= 2 AND n_two >= 2 AND n_two * 2 >= n_rows AND n_short * 2 >= n_rows"


def _statement(text: Column, rule_map: Column | None) -> Column:
    return let(F.lower(text), lambda lowered: R.detect_statement(text, rule_map, lowered))


def _full_header(found: Column, near_line: Column, near_place: Column, rule_map: Column | None) -> Column:
    """The lines above a table, led by the last line that names a statement where that lies at most two pages back."""
    adds = (
        _statement(F.array_join(found, " "), rule_map).isNull()
        & near_line.isNotNull()
        & (F.col("page_start") - F.shiftright(near_place, 32) <= 2)
        & ~F.array_contains(found, near_line)
    )
    return F.when(F.coalesce(adds, F.lit(False)), F.concat(F.array(near_line), found)).otherwise(found)


def _names_table(header_text: Column, by_header: Column) -> Column:
    return R.has_period(header_text) | by_header.isNotNull() | (F.col("n_rows") >= 5)


def _table_columns() -> dict[str, Column]:
    """Columns of a text table from its header."""
    return {
        "title": F.get("header", 0),
        "section_title": F.try_element_at("header", F.lit(-1)),
        "statement_type": F.col("by_header"),
        "page_start": F.col("page_start"),
        "page_end": F.col("page_end"),
        "currency": R.detect_currency(F.col("header_text")),
        "units": R.detect_units(F.col("header_text")),
        "is_consolidated": F.when(F.col("header_text") != "", F.contains("header_text", F.lit("合并"))),
        "columns": guess_columns(F.col("header_text"), F.col("n_cols")),
    }


def _cells(line: Column, n_cols: Column, n_numbers: Column) -> Column:
    blank = F.struct(F.lit(None).cast(R.DECIMAL).alias("value"), F.lit(None).cast("string").alias("raw_text")).cast(
        R.CELL_TYPE
    )
    return F.concat(F.array_repeat(blank, n_cols - n_numbers), R.numbers(line))


def _dealt_rows(dealt: DataFrame, patterns: dict[str, list[str]], rule_map: Column | None) -> DataFrame:
    """Rows of text tables, each with its ``table`` and ``n_copies`` of that; pages are dealt by report and engine, which are not NULL.

    All windows and groups stay in the tasks that hold the pages, so no line is
    shuffled or written.  Where a statement line comes more than once at the same
    place (a page that is there twice), each makes a copy of the table.
    """
    group = ["report_id", "engine"]
    read = _read_lines(dealt, rule_map)
    ordered = Window.partitionBy(*group).orderBy("place")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.col("place")
    states = read.withColumns(
        {
            "last_break": F.max(F.when(~F.col("can_be_row"), here)).over(upto),
            "last_open": F.max(F.when(F.col("can_be_row") & (F.col("n_numbers") >= 2), here)).over(upto),
            "last_statement": F.max(F.when(F.col("names_statement"), here)).over(upto),
            "near_here": F.collect_list(F.when(F.col("names_statement"), F.col("line"))).over(
                ordered.rangeBetween(Window.currentRow, Window.currentRow)
            ),
        }
    ).withColumn("is_row", _is_row())
    in_header = ~F.col("is_row") & (F.col("line") != "")
    kept = is_row_label(F.col("label"))
    counted = (
        states.withColumns({"in_header": in_header, "kept": F.col("is_row") & kept})
        .withColumns(
            {
                "header_no": F.sum(F.col("in_header").cast("long")).over(upto),
                "kept_no": F.sum(F.col("kept").cast("long")).over(upto),
                "near": F.last(F.when(F.col("names_statement") & here.isNotNull(), F.col("near_here")), ignorenulls=True).over(upto),
            }
        )
        .drop("near_here", "can_be_row", "names_statement", "last_open")
    )
    # The last three lines that are no rows are the last ones of each remainder of their running number.
    third = lambda r: F.last(F.when(F.col("in_header") & (F.col("header_no") % 3 == r), F.col("line")), ignorenulls=True)
    body = counted.withColumns({f"header_{r}": third(r).over(upto) for r in range(3)}).filter("is_row")
    row = F.struct("kept_no", "label", "page", "n_numbers", "line")
    sums = (
        body.groupBy(*group, "last_break")
        .agg(
            F.min(F.struct("place", "header_no", "header_0", "header_1", "header_2", "last_statement", "near")).alias("first"),
            *_table_sums(F.col("kept")),
            F.collect_list(F.when(F.col("kept"), row)).alias("rows"),
        )
        .filter(IS_TABLE)
    )
    ahead = F.array(*[F.col(f"first.header_{r}") for r in range(3)])
    last = F.col("first.header_no")
    found = F.filter(F.transform(F.sequence(last - 2, last), lambda i: F.get(ahead, F.pmod(i, F.lit(3)).cast("int"))), lambda l: l.isNotNull())
    table_key = F.concat_ws(":", F.lit("t"), F.coalesce("last_break", F.lit(-1)))
    headed = stage(
        sums.withColumns({"near": F.col("first.near"), "near_place": F.col("first.last_statement")}),
        {"table_key": table_key, "found": found},
    )

    def counts(near_line: Column) -> Column:
        text = F.array_join(_full_header(F.col("found"), near_line, F.col("near_place"), rule_map), " ")
        return F.coalesce(_names_table(text, _statement(text, rule_map)), F.lit(False))

    n_copies = F.when(F.size("near") > 1, F.size(F.filter("near", counts))).otherwise(1)
    copies = headed.withColumn("n_copies", n_copies).select("*", F.explode_outer("near").alias("near_line"))
    texts = stage(copies, {"header": _full_header(F.col("found"), F.col("near_line"), F.col("near_place"), rule_map)}).withColumn(
        "header_text", F.array_join("header", " ")
    )
    named = stage(texts, {"by_header": _statement(F.col("header_text"), rule_map)}).filter(
        _names_table(F.col("header_text"), F.col("by_header"))
    )

    def points(statement: str) -> Column:
        each = F.transform("rows", lambda r: statement_scores(r["label"], patterns)[statement])
        return F.when(F.col("by_header").isNull(), F.aggregate(each, F.lit(0), lambda acc, v: acc + v))

    voted = stage(named, {f"score_{s}": points(s) for s in STATEMENTS})
    statement = F.coalesce("by_header", best_statement({s: F.col(f"score_{s}") for s in STATEMENTS}))
    columns = _table_columns() | {"statement_type": statement}
    tables = stage(voted, {"table": F.struct(*[c.alias(n) for n, c in columns.items()])}, [*KEY, "n_copies", "n_cols", "first_kept", "rows"])
    return tables.select(*KEY, "n_copies", "n_cols", "first_kept", "table", F.explode("rows").alias("row")).select(
        *KEY,
        (F.col("row.kept_no") - F.col("first_kept")).cast("int").alias("row_index"),
        "row.label",
        F.col("row.page").alias("page_number"),
        _cells(F.col("row.line"), F.col("n_cols"), F.col("row.n_numbers")).alias("cells"),
        "table",
        "n_copies",
    )


def _block_tables(pages: DataFrame, patterns: dict[str, list[str]] | DataFrame, rule_map: Column | None):
    """``(tables, rows)`` of text tables; reports of any length are cut into blocks of pages."""
    group = ["report_id", "engine"]
    read = materialize(_read_lines(spread(pages), rule_map), "report-lines")
    here = F.col("place")
    states = running(
        read,
        group,
        ["place"],
        {
            "last_break": ("max", F.when(~F.col("can_be_row"), here)),
            "last_open": ("max", F.when(F.col("can_be_row") & (F.col("n_numbers") >= 2), here)),
            "last_statement": ("max", F.when(F.col("names_statement"), here)),
        },
        F.col("page"),
        PAGES_PER_BLOCK,
        keep_blocks=True,
    )
    marked = states.withColumn("is_row", _is_row())
    counted = running(
        marked,
        group,
        ["place"],
        {
            "header_no": ("sum", (~F.col("is_row") & (F.col("line") != "")).cast("long")),
            "kept_no": ("sum", (F.col("is_row") & is_row_label(F.col("label"))).cast("long")),
        },
        F.col("page"),
        PAGES_PER_BLOCK,
    )
    counted = materialize(counted, "report-line-states")
    table_key = F.concat_ws(":", F.lit("t"), F.coalesce("last_break", F.lit(-1)))
    kept = F.col("kept")
    body = stage(counted.filter("is_row"), {"table_key": table_key, "kept": is_row_label(F.col("label"))})
    sums = (
        body.groupBy(*KEY)
        .agg(
            F.min(F.struct("place", "header_no", "last_statement")).alias("first"),
            *_table_sums(kept),
        )
        .filter(IS_TABLE)
    )
    # The header is the last three lines that are no rows, found by their running number.
    wanted = sums.select(*KEY, F.col("first.header_no").alias("upto")).select(
        *KEY, F.explode(F.sequence(F.col("upto") - 2, F.col("upto"))).alias("header_no")
    )
    header_lines = counted.filter("NOT is_row AND line <> ''").select(*group, "header_no", "line")
    headers = (
        wanted.join(header_lines, [*group, "header_no"])
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("header_no", "line"))).alias("found"))
        .select(*KEY, F.transform("found", lambda f: f["line"]).alias("found"))
    )
    # The last line that names a statement, where it lies at most two pages back.
    named = counted.filter("names_statement").select(
        *group, F.col("place").alias("near_place"), F.col("line").alias("near_line")
    )
    found = F.coalesce(F.col("found"), F.array().cast("array<string>"))
    header = _full_header(found, F.col("near_line"), F.col("near_place"), rule_map)
    tables = (
        sums.join(headers, KEY, "left")
        .withColumn("near_place", F.col("first.last_statement"))
        .join(named, [*group, "near_place"], "left")
        .transform(lambda df: stage(df, {"header": header}))
        .withColumn("header_text", F.array_join("header", " "))
        .transform(lambda df: stage(df, {"by_header": _statement(F.col("header_text"), rule_map)}))
        .filter(_names_table(F.col("header_text"), F.col("by_header")))
        .select(*KEY, *[c.alias(n) for n, c in _table_columns().items()], "n_cols", "first_kept")
    )
    tables = materialize(tables, "block-tables")
    voted = vote_by_rows(tables.filter("statement_type IS NULL"), body.filter(kept), patterns)
    tables = tables.join(voted, KEY, "left").withColumn("statement_type", F.coalesce("statement_type", "voted")).drop("voted")
    rows = (
        body.filter(kept)
        .join(tables.select(*KEY, "n_cols", "first_kept"), KEY)
        .select(
            *KEY,
            (F.col("kept_no") - F.col("first_kept")).cast("int").alias("row_index"),
            "label",
            F.col("page").alias("page_number"),
            _cells(F.col("line"), F.col("n_cols"), F.col("n_numbers")).alias("cells"),
        )
    )
    return tables.drop("n_cols", "first_kept"), rows


def extract_tables(pages: DataFrame, patterns: dict[str, list[str]], rule_map: Column | None = None):
    """HTML tables where a report has any, text tables for the other reports."""
    html, html_rows = html_tables(pages, patterns, rule_map)
    with_html = html.select("report_id", "engine").distinct()
    text, text_rows = text_tables(pages.join(with_html, ["report_id", "engine"], "left_anti"), patterns, rule_map)
    return html.unionByName(text), html_rows.unionByName(text_rows)


# ---------------------------------------------------------------- report metadata


def report_metadata(pages: DataFrame) -> DataFrame:
    """Title, company, ticker, type, year, period, currency and units of the first three pages."""
    first = Window.partitionBy("report_id", "engine").orderBy("page")
    heads = (
        pages.withColumn("_n", F.row_number().over(first))
        .filter("_n <= 3")
        .groupBy("report_id", "engine")
        .agg(F.array_sort(F.collect_list(F.struct("page", "text_raw"))).alias("parts"))
        .select(
            "report_id",
            "engine",
            F.array_join(F.transform("parts", lambda p: F.coalesce(p["text_raw"], F.lit(""))), "\n").alias("head"),
        )
        .withColumn("head_lines", lines(F.col("head")))
    )

    def first_line(test) -> Column:
        return F.get(F.filter("head_lines", test), 0)

    def after_colon(line: Column) -> Column:
        return strip(F.regexp_replace(line, r"(?s)\A[^：]*：", ""))

    is_title = lambda l: (
        F.contains(l, F.lit("年度报告")) | F.contains(l, F.lit("年报")) | F.contains(F.lower(l), F.lit("annual report"))
    )
    is_annual = lambda l: F.contains(l, F.lit("年度报告")) | F.contains(l, F.lit("年报"))
    # A value that comes out empty does not count: the next matching line is read.
    first_value = lambda test: F.get(
        F.filter(F.transform(F.filter("head_lines", test), after_colon), lambda v: v != ""), 0
    )
    # Digits of a company's name or code are no year; they count only where no other line shows one.
    names_company = lambda l: R.contains_any(l, ("公司名称", "股票代码", "证券代码"))
    other_lines = F.array_join(F.filter("head_lines", lambda l: ~names_company(l)), "\n")
    read = heads.select(
        "report_id",
        "engine",
        strip(first_line(is_title)).alias("report_title"),
        first_value(lambda l: F.contains(l, F.lit("公司名称"))).alias("company_name"),
        first_value(lambda l: F.contains(l, F.lit("股票代码")) | F.contains(l, F.lit("证券代码"))).alias("ticker"),
        F.when(F.exists("head_lines", is_annual), F.lit("annual")).alias("report_type"),
        F.coalesce(R.first_year(other_lines), R.first_year(F.col("head"))).alias("fiscal_year"),
        R.first_date(F.col("head")).alias("head_date"),
        R.detect_currency(F.col("head")).alias("currency"),
        R.detect_units(F.col("head")).alias("units"),
        F.left("head", F.lit(2000)).alias("raw_head"),
    )
    year_end = F.when(
        (F.col("report_type") == "annual") & F.col("fiscal_year").isNotNull(),
        F.make_date("fiscal_year", F.lit(12), F.lit(31)),
    )
    return read.withColumns(
        {"period_start": F.lit(None).cast("date"), "period_end": F.coalesce("head_date", year_end)}
    ).drop("head_date")


def choose_engine(pages: DataFrame, preferred: tuple[str, ...] = ("layout", "text")) -> DataFrame:
    """Keep, per report, the pages of the first preferred engine that gave any."""
    rank = F.coalesce(
        *[F.when(F.col("engine") == e, F.lit(i)) for i, e in enumerate(preferred)], F.lit(len(preferred))
    )
    best = pages.groupBy("report_id").agg(F.min(F.struct(rank.alias("r"), F.col("engine"))).alias("best"))
    return pages.join(best.select("report_id", F.col("best.engine")), ["report_id", "engine"], "left_semi")
