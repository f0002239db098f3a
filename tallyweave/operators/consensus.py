"""Candidates of several engines to facts: agreement, identities, review.

Candidates: candidate_id, report_id, version_id, fact_type (flow | stock),
metric_id, period_start_date, period_end_date, as_of_date, value, unit,
currency, consolidation_scope, audit_flag, column_label, quality_score.

Groups are formed by aggregation in three steps (value and engine, value,
fact).  Candidates are dealt by a 64-bit hash of their key once, and all steps
use that order (:func:`by_key`); a key that holds very many candidates is kept
out of it and aggregated before each shuffle, so that it leaves every map task
as few rows.  The hash leads the grouping columns: the best candidate is a
struct, so Spark groups by sorting, and sorting on one number first is far
cheaper than on nine mixed columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.operators.stage import materialize, stage
from tallyweave.session import path_exists

FACT_KEY = [
    "report_id",
    "fact_type",
    "metric_id",
    "period_start_date",
    "period_end_date",
    "as_of_date",
    "unit",
    "currency",
    "consolidation_scope",
]
# Words that mark a column as the current or the earlier period.
CURRENT_EN, CURRENT_CN = ("current",), ("本期", "本年", "当期", "期末")
PRIOR_EN, PRIOR_CN = ("prior", "previous", "last"), ("上期", "上年", "期初")
BALANCE_CODES = ("total_assets", "total_liabilities", "total_equity", "total_equity_parent", "total_liabilities_equity")
CASHFLOW_CODES = (
    "net_cash_flow_operating",
    "net_cash_flow_investing",
    "net_cash_flow_financing",
    "net_increase_cash",
    "fx_effect_on_cash",
    "cash_begin",
    "cash_end",
)
# Keys with more candidates are aggregated before they are shuffled; the sketch that finds them keeps this many keys at most.
HOT_ROWS, SKETCH_KEYS = 100_000, 8192
# A task sorts about so many dealt candidates at most, so that none has to be spilled (134 to 329 MB of a task's memory were measured).
TASK_ROWS = 200_000
FX_NAME = "汇率变动对现金及现金等价物的影响"


def value_key(value: Column, decimals: int | None = 2) -> Column:
    """Text of the value rounded half up; ``None`` keeps the exact value."""
    rounded = value if decimals is None else F.round(value, decimals)
    return F.coalesce(rounded.cast("string"), F.lit("null"))


def engine_key(parse_method: Column, version_id: Column, candidate_id: Column) -> Column:
    return F.coalesce(
        F.nullif(parse_method, F.lit("")),
        F.concat(F.lit("version_"), version_id.cast("string")),
        F.concat(F.lit("candidate_"), candidate_id.cast("string")),
    )


def column_score(label: Column) -> Column:
    """Preference of a column: years, then ``col_i``, then current over prior words.

    Patterns run only behind a cheap test of how the label starts.
    """
    raw = F.trim(F.coalesce(label, F.lit("")))
    lower = F.lower(raw)
    year = F.when(raw.startswith("20"), F.regexp_extract(raw, r"(?U)\A(20\d{2})\z", 1).try_cast("int"))
    col = F.when(lower.startswith("col_"), F.regexp_extract(lower, r"(?U)\Acol_(\d+)\z", 1).try_cast("long"))

    def points(text: Column, words, value: int) -> Column:
        hit = reduce(or_, [F.contains(text, F.lit(word)) for word in words])
        return F.when(hit, F.lit(value)).otherwise(F.lit(0))

    worded = points(lower, CURRENT_EN, 500) + points(raw, CURRENT_CN, 500)
    worded = worded + points(lower, PRIOR_EN, -500) + points(raw, PRIOR_CN, -500)
    return F.coalesce(F.lit(10000) + year, F.lit(1000) - col, worded).cast("long")


def with_trace_labels(candidates: DataFrame, traces: DataFrame) -> DataFrame:
    """Column label of the source trace, kept NULL where a candidate has no trace."""
    return candidates.join(traces.select(F.col("trace_id").alias("source_trace_id"), "column_label"), "source_trace_id", "left")


def with_engines(candidates: DataFrame, versions: DataFrame) -> DataFrame:
    """Add the engine each candidate counts for."""
    known = versions.select("version_id", "parse_method")
    joined = candidates.join(known, "version_id", "left")
    return joined.withColumn(
        "engine", engine_key(F.col("parse_method"), F.col("version_id"), F.col("candidate_id"))
    ).drop("parse_method")


def key_sizes(keyed: DataFrame) -> tuple[int, list[int]]:
    """How many candidates there are, and the hashes of the keys with more than HOT_ROWS of them (and of others that a sketch of bounded size can't tell from them).

    They say only how a key's rows are dealt, never what counts.
    """
    found = keyed.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(key_hash, {SKETCH_KEYS // 2}, {SKETCH_KEYS})").alias("top")).first()
    return found["n"], [item["item"] for item in found["top"] or [] if item["count"] > HOT_ROWS]


def hot_keys(keyed: DataFrame) -> list[int]:
    return key_sizes(keyed)[1]


def dealt_by_key(keyed: DataFrame, rows: int) -> DataFrame:
    """Rows by ``key_hash``, to as many tasks as bound the rows of each; a small table to as many as the session says."""
    tasks = -(-rows // TASK_ROWS)
    few = tasks <= int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition("key_hash") if few else keyed.repartition(tasks, "key_hash")


Steps = Callable[[DataFrame], DataFrame]


def by_key(rows: DataFrame, steps: Steps, hot_steps: Steps | None = None) -> DataFrame:
    """``steps`` over rows dealt by ``key_hash`` once; rows of hot keys go undealt through ``hot_steps``, or the same steps.

    Steps must group by ``key_hash`` and further columns only, so that both parts are whole.
    """
    keyed = rows.withColumn("key_hash", F.xxhash64(*FACT_KEY))
    size, hot = key_sizes(keyed)
    if not hot:
        return steps(dealt_by_key(keyed, size))
    is_hot = F.col("key_hash").isin(*hot)
    return steps(dealt_by_key(keyed.filter(~is_hot), size)).unionByName((hot_steps or steps)(keyed.filter(is_hot)))


def dealing(candidates: DataFrame) -> tuple[int, list[int]]:
    """How the keys of candidates are dealt, for operators that read the same candidates and so can share one shuffle."""
    return key_sizes(candidates.withColumn("key_hash", F.xxhash64(*FACT_KEY)))


def alike(columns: list[str]) -> Column:
    """A number that is near for rows that are alike in the leading columns: a few bits of the hash of each."""
    width = 63 // len(columns)
    bits = [F.xxhash64(c).bitwiseAND(F.lit((1 << width) - 1)) for c in columns]
    return reduce(add, [F.shiftleft(b, width * i) for i, b in enumerate(reversed(bits))])


def narrow_parts(rows: DataFrame, sizes: tuple[int, list[int]], decimals: int | None = 2) -> tuple[DataFrame, DataFrame | None, Column | None]:
    """Candidates with ``value_key`` and ``key_hash``, dealt by the latter: usual rows, rows of hot keys undealt, the test of a hot ``key_hash``.

    Operators that need no more than keys, engines, values as text and candidate
    ids shuffle the same columns here, so Spark runs one shuffle for all of them.
    Before it a task sorts its rows so that those which have most in common
    follow each other, where the shuffle's compression finds it.  The hash is not
    shuffled but made again.
    """
    size, hot = sizes
    words, days = ["fact_type", "currency", "unit", "consolidation_scope", "engine"], ["period_start_date", "period_end_date", "as_of_date", "metric_id"]
    needed = [*words, "value_key", *days, "report_id", "candidate_id"]
    made = rows.withColumn("value_key", value_key(F.col("value"), decimals))
    made = made.select(*needed, *[c for c in made.columns if c not in needed])
    key_hash = F.xxhash64(*FACT_KEY)
    few = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    tasks = max(few, -(-size // TASK_ROWS))

    def dealt(part: DataFrame) -> DataFrame:
        moved = part.sortWithinPartitions(alike([*words, *days, "value_key"])).repartition(tasks, key_hash)
        told = {c: F.col(c) for c in ("engine", "value_key", "candidate_id")}  # so that no reader takes one of them out of the shuffle
        return stage(moved, told, [c for c in moved.columns if c not in told]).withColumn("key_hash", key_hash)

    if not hot:
        return dealt(made), None, None
    is_hot = key_hash.isin(*hot)
    return dealt(made.filter(~is_hot)), made.filter(is_hot).withColumn("key_hash", key_hash), F.col("key_hash").isin(*hot)


def value_groups(candidates: DataFrame, decimals: int | None = 2) -> DataFrame:
    """Per fact key and value key: engines, candidates, mean quality, best column, best candidate; needs ``key_hash``."""
    payload = [c for c in ("value", "audit_flag", "source_trace_id", "column_label") if c in candidates.columns]
    quality = F.col("quality_score").cast("double")
    score = column_score(F.col("column_label"))
    best = F.struct(
        F.col("quality_score").isNotNull().alias("has_quality"),
        F.coalesce(quality, F.lit(0.0)).alias("quality"),
        F.col("score"),
        F.col("candidate_id"),
        F.col("quality_score"),
        *payload,
    )
    known = "value_key" in candidates.columns
    by_engine = (
        candidates.withColumns(
            {"value_key": F.col("value_key") if known else value_key(F.col("value"), decimals), "score": score}
        )
        .groupBy("key_hash", *FACT_KEY, "value_key", "engine")
        .agg(
            F.count("*").alias("n"),
            F.sum(quality).alias("q_sum"),
            F.count("quality_score").alias("q_n"),
            F.max("score").alias("best_score"),
            F.max(best).alias("best"),
        )
    )
    return by_engine.groupBy("key_hash", *FACT_KEY, "value_key").agg(
        F.count("*").alias("engines"),
        F.sum("n").alias("candidates"),
        F.coalesce(F.sum("q_sum") / F.nullif(F.sum("q_n"), F.lit(0)), F.lit(0.0)).alias("avg_quality"),
        F.max("best_score").alias("best_score"),
        F.max("best").alias("best"),
        F.min("engine").alias("engine_min"),
        F.max("engine").alias("engine_max"),
    )


def consensus_facts(
    candidates: DataFrame,
    versions: DataFrame,
    min_agree: int = 1,
    decimals: int | None = 2,
    sizes: tuple[int, list[int]] | None = None,
) -> DataFrame:
    """One fact per key: the value most engines agree on.

    Ties go to more candidates, higher mean quality, the better column, the
    larger value text.  The mean is rounded to 9 digits before it is compared,
    as sums of doubles depend on their order.  With ``sizes`` (see
    :func:`dealing`) the facts keep their ``key_hash`` and lie where
    :func:`discrepancies` of the same candidates and sizes deals them.
    """
    rank = F.struct(
        "engines", "candidates", F.round("avg_quality", 9).alias("avg_quality"), "best_score", "value_key", "best"
    )
    steps = lambda rows: value_groups(rows, decimals).groupBy("key_hash", *FACT_KEY).agg(
        F.max(rank).alias("top"),
        F.max("engines").alias("max_agree"),
        (F.min("engine_min") != F.max("engine_max")).alias("multi_engine"),
    )
    rows = with_engines(candidates, versions)
    if sizes is None:
        chosen = by_key(rows, steps)
    else:
        usual, hot, _ = narrow_parts(rows, sizes, decimals)
        chosen = steps(usual) if hot is None else steps(usual).unionByName(steps(hot))
    agree = F.col("max_agree")  # the most engines come first in the rank
    enough = agree >= min_agree
    return chosen.select(
        *FACT_KEY,
        F.col("top.best.value").alias("value"),
        F.col("top.best.candidate_id").alias("selected_candidate_id"),
        F.col("top.best.quality_score").alias("quality_score"),
        F.col("top.best.column_label").alias("column_label"),
        agree.alias("agree_count"),
        F.col("top.candidates").alias("value_candidates"),
        F.when(enough, F.lit("auto")).otherwise(F.lit("needs_review")).alias("resolution_status"),
        F.when(~enough, F.lit("insufficient_agreement"))
        .when(agree > 1, F.lit("consensus"))
        .otherwise(F.lit("single_engine"))
        .alias("resolution_method"),
        "multi_engine",
        (F.col("max_agree") >= 2).alias("agreed"),
        *(["key_hash"] if sizes else []),
    )


def agreement_stats(facts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Groups, multi-engine groups, agreed groups and their rate: flow, stock and combined."""
    cols = [*map(F.col, by), F.col("fact_type")]
    counted = facts.groupingSets([cols, cols[:-1]], *cols).agg(
        F.grouping("fact_type").alias("_all"),
        F.count("*").alias("groups_total"),
        F.count_if("multi_engine").alias("groups_multi_engine"),
        F.count_if("agreed").alias("groups_agreed"),
    )
    return counted.select(
        *by,
        F.when(F.col("_all") == 1, F.lit("combined")).otherwise(F.col("fact_type")).alias("fact_type"),
        "groups_total",
        "groups_multi_engine",
        "groups_agreed",
        F.coalesce(F.try_divide("groups_agreed", "groups_multi_engine"), F.lit(0.0)).alias("agreement_rate"),
    )


def resolution_summary(candidates: DataFrame, facts: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Run summary per report: candidates, facts, agreement of flow and stock, passed and failed identities.

    The checks themselves stay rows of their own; the summary counts them.
    """
    flow, stock = F.col("fact_type") == "flow", F.col("fact_type") == "stock"
    seen = candidates.groupBy("report_id").agg(
        F.count_if(flow).alias("flow_candidates"), F.count_if(stock).alias("stock_candidates")
    )
    sides = {"flow": flow, "stock": stock}
    made = facts.groupBy("report_id").agg(
        *[F.count_if(t).alias(f"{n}_facts") for n, t in sides.items()],
        *[F.count_if(t & F.col("multi_engine")).alias(f"{n}_groups_multi_engine") for n, t in sides.items()],
        *[F.count_if(t & F.col("agreed")).alias(f"{n}_groups_agreed") for n, t in sides.items()],
    )
    out = seen.join(made, "report_id", "left")
    if checks is not None:
        done = checks.groupBy("report_id").agg(
            F.count_if(F.col("status") == "pass").alias("checks_passed"), F.count_if(F.col("status") == "fail").alias("checks_failed")
        )
        out = out.join(done, "report_id", "left")
    counts = [c for c in out.columns if c != "report_id"]
    out = out.select("report_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    multi = F.col("flow_groups_multi_engine") + F.col("stock_groups_multi_engine")
    agreed = F.col("flow_groups_agreed") + F.col("stock_groups_agreed")
    rated = out.withColumn("multi_engine_agreement_rate", F.coalesce(F.try_divide(agreed, multi), F.lit(0.0)))
    return rated.withColumn("summary_json", F.to_json(F.struct(*[c for c in rated.columns if c != "report_id"])))


def write_facts(facts: DataFrame, path: str, replace: bool = True) -> None:
    """Write facts as a new version below ``path``, of the size of ``facts`` whatever is stored.

    The facts go to a folder of their own.  Then a small log, one row a report,
    makes them count: with ``replace`` from here on they are the report's only
    ones, else they are added to those before.  A write that is lost before the
    log is written leaves the earlier facts in force.  One writer at a time; a
    report without any row in ``facts`` stays as it is, a null report is one too.
    """
    spark, version, log = facts.sparkSession, f"v{uuid.uuid4().hex}", f"{path}/log"
    facts.write.parquet(f"{path}/facts/fact_version={version}")
    done = spark.read.parquet(log).agg(F.max("seq")).first()[0] if path_exists(spark, log) else 0
    reports = spark.read.parquet(f"{path}/facts/fact_version={version}").select("report_id").distinct()
    reports.select("report_id", F.lit(version).alias("fact_version"), F.lit((done or 0) + 1).alias("seq"), F.lit(replace).alias("replaces")).write.mode(
        "append"
    ).parquet(log)


def _versions_in_force(spark: SparkSession, path: str) -> DataFrame:
    """(report, fact_version) of every write since a report's last replacement."""
    log = spark.read.parquet(f"{path}/log")
    since = log.groupBy(F.col("report_id").alias("report")).agg(F.max(F.when(F.col("replaces"), F.col("seq"))).alias("since"))
    joined = log.join(since, F.col("report_id").eqNullSafe(F.col("report")))
    return joined.filter("since IS NULL OR seq >= since").select("report", "fact_version")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """The facts in force of what :func:`write_facts` wrote; columns that a version lacks are null."""
    stored = spark.read.option("mergeSchema", True).parquet(f"{path}/facts")
    current = _versions_in_force(spark, path).withColumnRenamed("fact_version", "version")
    in_force = stored.join(current, F.col("report_id").eqNullSafe(F.col("report")) & (F.col("fact_version") == F.col("version")), "left_semi")
    return in_force.drop("fact_version")


def superseded_versions(spark: SparkSession, path: str) -> DataFrame:
    """Logged versions of which no report uses anything any more: their folders can be deleted when no reader is left."""
    logged = spark.read.parquet(f"{path}/log").select("fact_version").distinct()
    return logged.join(_versions_in_force(spark, path), "fact_version", "left_anti")


def unresolved(facts: DataFrame) -> DataFrame:
    """Facts no reviewer has settled."""
    return facts.filter(~F.col("resolution_method").eqNullSafe(F.lit("manual")))


# ---------------------------------------------------------------- accounting identities


def within_tolerance(left: Column, right: Column, abs_tol: float = 1, rel_tol: float = 0.000001) -> Column:
    diff = F.abs(left - right)
    return (diff <= F.lit(abs_tol)) | (diff <= F.greatest(F.abs(left), F.abs(right)) * F.lit(str(rel_tol)).cast("decimal(12,9)"))


def _pivot(facts: DataFrame, codes, keys: list[str]) -> DataFrame:
    """One column per metric code; of several facts the one with the highest id counts."""
    wanted = facts.filter(F.col("metric_code").isin(*codes) & F.col("value").isNotNull())
    pick = lambda code: F.max_by(
        F.when(F.col("metric_code") == code, F.col("value")), F.when(F.col("metric_code") == code, F.col("fact_id"))
    ).alias(code)
    return wanted.groupBy(*keys).agg(*[pick(c) for c in codes])


def _check_rows(wide: DataFrame, keys: list[str], checks, abs_tol: float, rel_tol: float) -> DataFrame:
    """``checks``: (name, left, right, fx) per identity; rows only where both sides are known."""
    items = [
        F.struct(F.lit(name).alias("name"), left.alias("lhs"), right.alias("rhs"), fx.cast("decimal(38,6)").alias("fx_effect"))
        for name, left, right, fx in checks
    ]
    typed = [i.cast("struct<name:string,lhs:decimal(38,6),rhs:decimal(38,6),fx_effect:decimal(38,6)>") for i in items]
    return (
        wide.select(*keys, F.inline(F.array(*typed)))
        .filter("lhs IS NOT NULL AND rhs IS NOT NULL")
        .select(
            *keys,
            "name",
            F.col("lhs").cast("double").alias("lhs"),
            F.col("rhs").cast("double").alias("rhs"),
            F.col("fx_effect").cast("double").alias("fx_effect"),
            (F.col("lhs") - F.col("rhs")).cast("double").alias("diff"),
            F.when(within_tolerance(F.col("lhs"), F.col("rhs"), abs_tol, rel_tol), "pass").otherwise("fail").alias("status"),
        )
    )


def balance_identity(
    facts: DataFrame, equity_code: str = "total_equity", abs_tol: float = 1, rel_tol: float = 0.000001
) -> DataFrame:
    """Assets = liabilities + equity, and assets = total of liabilities and equity.

    ``equity_code`` is chosen from the dictionary (see :func:`equity_source`),
    not from the values.
    """
    keys = ["report_id", "as_of_date", "unit", "currency", "consolidation_scope"]
    wide = _pivot(facts, BALANCE_CODES, keys)
    none = F.lit(None)
    checks = [
        ("assets_eq_liab_plus_equity", F.col("total_assets"), F.col("total_liabilities") + F.col(equity_code), none),
        ("assets_eq_liab_equity_total", F.col("total_assets"), F.col("total_liabilities_equity"), none),
    ]
    return _check_rows(wide, keys, checks, abs_tol, rel_tol).drop("fx_effect")


def equity_source(metrics: DataFrame) -> str:
    """``total_equity`` where the dictionary has it, else the parent's equity."""
    return "total_equity" if metrics.filter("metric_code = 'total_equity'").take(1) else "total_equity_parent"


def fx_metric_code(metrics: DataFrame) -> str | None:
    """The exchange effect's code, by code or by the first cash-flow metric of that name."""
    found = metrics.filter(
        (F.col("metric_code") == "fx_effect_on_cash")
        | ((F.col("statement_type") == "cashflow") & F.contains("metric_name_cn", F.lit(FX_NAME)))
    )
    first = found.orderBy((F.col("metric_code") != "fx_effect_on_cash"), "def_order").select("metric_code").take(1)
    return first[0][0] if first else None


def cashflow_identity(
    facts: DataFrame, fx_code: str | None = "fx_effect_on_cash", abs_tol: float = 1, rel_tol: float = 0.000001
) -> DataFrame:
    """Net increase = operating + investing + financing (+ fx); end = begin + net increase."""
    keys = ["report_id", "period_end_date", "unit", "currency", "consolidation_scope"]
    codes = [fx_code if c == "fx_effect_on_cash" and fx_code else c for c in CASHFLOW_CODES]
    wide = _pivot(facts, codes, keys)
    fx = F.col(fx_code) if fx_code else F.lit(None).cast("decimal(38,6)")
    total = F.col("net_cash_flow_operating") + F.col("net_cash_flow_investing") + F.col("net_cash_flow_financing")
    checks = [
        ("net_increase_eq_sum_cashflows", F.col("net_increase_cash"), total + F.coalesce(fx, F.lit(0)), fx),
        ("cash_end_eq_cash_begin_plus_increase", F.col("cash_end"), F.col("cash_begin") + F.col("net_increase_cash"), F.lit(None)),
    ]
    return _check_rows(wide, keys, checks, abs_tol, rel_tol)


# ---------------------------------------------------------------- review


OVERRIDE_KEY = ["report_id", "fact_type", "metric_id", "period_start_date", "period_end_date", "as_of_date", "consolidation_scope"]


def prepare_overrides(
    rows: DataFrame, metrics: DataFrame, report_id: int | None = None, reviewed_by: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Validate override rows: ``(usable, rejected)``.

    ``rows`` needs ``input_order``.  Rejected rows carry the reason.
    """
    fact_type = F.lower(F.coalesce("fact_type", F.lit("")))
    joined = rows.drop("metric_id").join(metrics.select("metric_code", "metric_id"), "metric_code", "left").withColumns(
        {
            "report_id": F.coalesce(F.col("report_id").try_cast("long"), F.lit(report_id).cast("long")),
            "reviewed_by": F.coalesce(F.nullif("reviewed_by", F.lit("")), F.lit(reviewed_by).cast("string")),
            "fact_type": fact_type,
            "value": F.col("value").try_cast("decimal(38,6)"),
        }
    )
    reason = (
        F.when(F.col("metric_id").isNull(), F.concat(F.lit("Unknown metric_code: "), F.coalesce("metric_code", F.lit("None"))))
        .when(F.col("report_id").isNull(), F.lit("report_id missing."))
        .when(~F.col("fact_type").isin("stock", "flow"), F.concat(F.lit("Invalid fact_type: "), F.col("fact_type")))
    )
    checked = joined.withColumn("reason", reason)
    day = lambda a, b: F.coalesce(F.col(a), F.col(b))
    stock = F.col("fact_type") == "stock"
    usable = checked.filter("reason IS NULL").withColumns(
        {
            "as_of_date": F.when(stock, day("as_of_date", "period_end_date")),
            "period_end_date": F.when(~stock, day("period_end_date", "as_of_date")),
            "period_start_date": F.when(~stock, F.col("period_start_date")),
        }
    )
    return usable.drop("reason"), checked.filter("reason IS NOT NULL")


REVIEWED = [
    "value", "unit", "currency", "audit_flag", "selected_candidate_id", "resolution_status", "resolution_method",
    "reviewed_by", "review_notes", "reviewed_at",
]


def _review_time(facts: DataFrame, hit: Column) -> Column:
    """The time of this review where it hits a fact, else that of an earlier one."""
    earlier = F.col("reviewed_at") if "reviewed_at" in facts.columns else F.lit(None).cast("timestamp")
    return F.when(hit, F.current_timestamp()).otherwise(earlier).alias("reviewed_at")


def apply_overrides(facts: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace or add facts by hand-checked values.

    Keys compare NULL-safe.  Of several facts of a key the one with the lowest
    id is replaced.  Of several overrides of a key the last value, reviewer and
    notes count; unit, currency and flag take the last one given.  All other
    columns of a fact stay, and are null in an added one.
    """
    last = lambda c: F.max_by(c, "input_order").alias(f"o_{c}")
    last_given = lambda c: F.max_by(
        F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("input_order"))
    ).alias(f"o_{c}")
    wanted = overrides.groupBy(*OVERRIDE_KEY).agg(
        *[last(c) for c in ("value", "reviewed_by", "review_notes")],
        *[last_given(c) for c in ("unit", "currency", "audit_flag")],
    )
    keyed = wanted.select(*[F.col(c).alias(f"k_{c}") for c in OVERRIDE_KEY], *[c for c in wanted.columns if c not in OVERRIDE_KEY])
    targets = (
        facts.join(keyed, _same_key("k_", OVERRIDE_KEY))
        .groupBy(*[F.col(f"k_{c}").alias(f"t_{c}") for c in OVERRIDE_KEY])
        .agg(F.min("fact_id").alias("target_id"))
    )
    located = keyed.join(
        targets, reduce(and_, [F.col(f"k_{c}").eqNullSafe(F.col(f"t_{c}")) for c in OVERRIDE_KEY]), "left"
    ).drop(*[f"t_{c}" for c in OVERRIDE_KEY])
    joined = facts.join(located, facts["fact_id"] == located["target_id"], "full_outer")
    hit = F.col("k_report_id").isNotNull()
    # a fact that no override hits keeps its earlier review
    earlier = lambda c: F.col(c) if c in facts.columns else F.lit(None).cast("string")
    others = [c for c in facts.columns if c not in ("fact_id", *OVERRIDE_KEY, *REVIEWED)]
    return joined.select(
        "fact_id",
        *others,
        *[F.when(hit, F.col(f"k_{c}")).otherwise(F.col(c)).alias(c) for c in OVERRIDE_KEY],
        F.when(hit, F.col("o_value")).otherwise(F.col("value")).alias("value"),
        F.when(hit, F.coalesce("o_unit", "unit")).otherwise(F.col("unit")).alias("unit"),
        F.when(hit, F.coalesce("o_currency", "currency")).otherwise(F.col("currency")).alias("currency"),
        F.when(hit, F.coalesce("o_audit_flag", "audit_flag")).otherwise(F.col("audit_flag")).alias("audit_flag"),
        F.when(~hit, F.col("selected_candidate_id")).alias("selected_candidate_id"),
        F.when(hit, F.lit("verified")).otherwise(F.col("resolution_status")).alias("resolution_status"),
        F.when(hit, F.lit("manual")).otherwise(F.col("resolution_method")).alias("resolution_method"),
        *[F.when(hit, F.col(f"o_{c}")).otherwise(earlier(c)).alias(c) for c in ("reviewed_by", "review_notes")],
        _review_time(facts, hit),
    )


def apply_picks(facts: DataFrame, candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """Facts take the candidate a reviewer picked: picks(fact_id, candidate_id, reviewed_by, review_notes, input_order)."""
    last = picks.groupBy("fact_id").agg(
        F.max_by(F.struct("candidate_id", "reviewed_by", "review_notes"), "input_order").alias("p")
    )
    named = last.select("fact_id", "p.candidate_id", F.col("p.reviewed_by").alias("p_reviewed_by"), F.col("p.review_notes").alias("p_review_notes"))
    chosen = named.join(
        candidates.select("candidate_id", F.col("value").alias("p_value"), F.col("unit").alias("p_unit"), F.col("currency").alias("p_currency")),
        "candidate_id",
    )
    joined = facts.join(chosen.withColumnRenamed("candidate_id", "p_candidate"), "fact_id", "left")
    hit = F.col("p_candidate").isNotNull()
    earlier = lambda c: F.col(c) if c in facts.columns else F.lit(None).cast("string")
    keep = [c for c in facts.columns if c == "audit_flag" or c not in REVIEWED]
    return joined.select(
        *keep,
        F.when(hit, F.col("p_value")).otherwise(F.col("value")).alias("value"),
        F.when(hit, F.col("p_unit")).otherwise(F.col("unit")).alias("unit"),
        F.when(hit, F.col("p_currency")).otherwise(F.col("currency")).alias("currency"),
        F.when(hit, F.col("p_candidate")).otherwise(F.col("selected_candidate_id")).alias("selected_candidate_id"),
        F.when(hit, F.lit("verified")).otherwise(F.col("resolution_status")).alias("resolution_status"),
        F.when(hit, F.lit("manual")).otherwise(F.col("resolution_method")).alias("resolution_method"),
        *[F.when(hit, F.col(f"p_{c}")).otherwise(earlier(c)).alias(c) for c in ("reviewed_by", "review_notes")],
        _review_time(facts, hit),
    )


def engine_coverage(candidates: DataFrame, versions: DataFrame, left: str, right: str, decimals: int | None = 2) -> DataFrame:
    """Fact keys per engine, keys both have, keys only one has, and keys whose values differ.

    One pass: per key the engines seen and the value range of each engine.
    Values of an engine are compared as sets through their smallest and largest
    value key and their number.
    """
    engines = with_engines(candidates, versions).filter(F.col("engine").isin(left, right))
    values = engines.select(*FACT_KEY, "engine", value_key(F.col("value"), decimals).alias("value_key")).distinct()
    of = lambda e: F.col("engine") == e
    per_key = values.groupBy(*FACT_KEY).agg(
        F.count_if(of(left)).alias("n_left"),
        F.count_if(of(right)).alias("n_right"),
        F.count_distinct("value_key").alias("n_values"),
    )
    both = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    return per_key.groupBy("fact_type").agg(
        F.count_if(F.col("n_left") > 0).alias("left_keys"),
        F.count_if(F.col("n_right") > 0).alias("right_keys"),
        F.count_if(both).alias("overlap"),
        F.count_if(F.col("n_right") == 0).alias("left_only"),
        F.count_if(F.col("n_left") == 0).alias("right_only"),
        # Equal sets: each engine has all the values there are.
        F.count_if(both & ((F.col("n_values") != F.col("n_left")) | (F.col("n_values") != F.col("n_right")))).alias("value_conflicts"),
    )


def in_period(period_end: Column, fiscal_year: int | None, period: str | None) -> Column:
    """Filter of the review list: fiscal year, and annual or q1 … q4 by the closing month."""
    test = F.lit(True)
    if fiscal_year is not None:
        test = test & (F.year(period_end) == fiscal_year)
    months = {"annual": 12, "q1": 3, "q2": 6, "q3": 9, "q4": 12}
    if period:
        test = test & (F.month(period_end) == months[period])
    return test


def discrepancies(
    candidates: DataFrame,
    versions: DataFrame,
    facts: DataFrame | None = None,
    fact_type: str | None = None,
    fiscal_year: int | None = None,
    period: str | None = None,
    limit: int | None = None,
    sizes: tuple[int, list[int]] | None = None,
) -> DataFrame:
    """What each engine said about the fact keys whose candidates differ in value.

    One row per key, engine and value, with the number of candidates behind it
    and the first of them; copies of a candidate do not pile up and no key is
    gathered into one row.  A review screen passes ``limit`` (200 by default there).
    Rows meet their facts where they were dealt; facts of :func:`consensus_facts`
    with the same ``sizes`` lie there already and come out of the same shuffle.
    """
    rows = with_engines(candidates, versions)
    if fact_type:
        rows = rows.filter(F.col("fact_type") == fact_type)
    if fiscal_year is not None or period:
        rows = rows.filter(in_period(F.coalesce("period_end_date", "as_of_date"), fiscal_year, period))

    def said(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key_hash", *FACT_KEY, "engine", "value_key").agg(
            F.count("*").alias("n_candidates"), F.min("candidate_id").alias("first_candidate_id")
        )

    def differing(rows: DataFrame) -> DataFrame:
        whole = Window.partitionBy("key_hash", *FACT_KEY)
        ends = said(rows).withColumns({"lo": F.min("value_key").over(whole), "hi": F.max("value_key").over(whole)})
        return ends.filter("lo <> hi").drop("lo", "hi")

    def differing_hot(rows: DataFrame) -> DataFrame:
        values = said(rows)
        keys = values.groupBy("key_hash", *FACT_KEY).agg(F.min("value_key").alias("lo"), F.max("value_key").alias("hi")).filter("lo <> hi")
        return values.join(_prefixed(keys, "d_"), _same_key("d_"), "left_semi")

    usual, hot, is_hot = narrow_parts(rows, sizes or dealing(rows))
    if facts is not None:
        facts = facts if "key_hash" in facts.columns else facts.withColumn("key_hash", F.xxhash64(*FACT_KEY))

    def with_status(found: DataFrame, some: Column | None) -> DataFrame:
        if facts is None:
            return found.drop("key_hash")
        own = facts if some is None else facts.filter(some)
        status = _prefixed(own, "f_", "resolution_status", "resolution_method", F.col("key_hash").alias("f_key_hash"))
        # The hash alone is the join's key, since rows lie by it; that the keys are the same is tested as a count, which Spark does not take for further join keys.
        same = reduce(add, [F.col(c).eqNullSafe(F.col(f"f_{c}")).cast("int") for c in FACT_KEY]) == len(FACT_KEY)
        joined = found.join(status, (F.col("key_hash") == F.col("f_key_hash")) & same, "left")
        return joined.drop("key_hash", "f_key_hash", *[f"f_{c}" for c in FACT_KEY])

    out = with_status(differing(usual), None if is_hot is None else ~is_hot)
    if hot is not None:
        out = out.unionByName(with_status(differing_hot(hot), is_hot))
    return out.orderBy(*FACT_KEY, "engine", "value_key").limit(limit) if limit is not None else out


def _prefixed(df: DataFrame, prefix: str, *extra: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in FACT_KEY], *extra)


def _same_key(prefix: str, key=tuple(FACT_KEY)) -> Column:
    """NULL-safe equality with the prefixed copy of a key."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in key])
