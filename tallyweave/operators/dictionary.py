"""Upkeep of the metric dictionary: taxonomy merge, contents mapping, cleanup, sync.

Metrics use the columns of ``matching.METRIC_SCHEMA``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.labels import GENERIC_SHORT, SHORT_MAX, english_name, normalize_label
from tallyweave.operators.ordered import running
from tallyweave.operators.quality import side_by_side
from tallyweave.operators.stage import dealt, materialize, shuffled, stage

BUCKETS = ("patterns", "patterns_exact", "patterns_en", "patterns_en_exact")
# Labels too general to name a metric; the short list is the one of contents mapping.
CONTENTS_STOP_LABELS = (
    "合计", "小计", "其他", "金额", "项目", "单位", "币种", "余额", "本期", "上期", "本年", "上年", "本年度", "上年度",
    "期末", "期初", "年末", "年初", "其中", "人民币", "元", "千元", "万元", "亿元",
)
STOP_LABELS = (
    "合计", "小计", "其他", "金额", "项目", "单位", "币种", "余额", "本期", "上期", "本年", "上年", "本年度", "上年度",
    "期末", "期初", "年末", "年初", "期末余额", "期初余额", "年末余额", "年初余额", "其中", "合计,", "合计：", "小计：",
    "金额（元）", "金额(元)", "金额（人民币元）", "人民币", "元", "千元", "万元", "亿元",
    "total", "subtotal", "amount", "balance", "currency", "unit", "current", "prior", "year",
)
NAME_OVERRIDES = {"合同资产": "contract_assets"}
CASHFLOW_WORDS = r"(?iu)(现金|现金流|cash\s*flow)"
INCOME_WORDS = r"(?iu)(收入|成本|费用|利润|收益|税|income|revenue|expense|profit|loss)"
BALANCE_WORDS = r"(?iu)(资产|负债|权益|capital|equity|asset|liabil)"
RATIO_WORDS = r"(?iu)(率|%|percentage|ratio)"
CONTENTS_CASHFLOW = r"(现金流量)"
CONTENTS_BALANCE = r"(资产|负债|权益|财务报表|金融工具|合并财务报表|主体中权益|公允价值|持有待售|租赁)"
CONTENTS_RATIO = r"(率|每股|%|比率)"
TOP_ROW = r"(?U)\A(CAS\d+)\s+(.+)\z"
SUB_ROW = r"(?U)\A\[(\d{6})\]\s*(.+)\z"


def _norm_in(norm: Column, labels) -> Column:
    """Whether the normalised label is one of the labels, normalised alike."""
    return F.array_contains(F.array_distinct(F.array(*[normalize_label(F.lit(v)) for v in labels])), norm)


# ---------------------------------------------------------------- label index and taxonomy merge


def metric_labels(metrics: DataFrame, names: tuple[str, ...], buckets: tuple[str, ...] = BUCKETS) -> DataFrame:
    """All labels of all metrics as rows (metric_code, def_order, label_no, label, norm)."""
    labels = F.concat(F.array(*names), *buckets)
    packed = dealt(metrics.select("metric_code", "def_order", labels.alias("labels")))
    rows = packed.select("metric_code", "def_order", F.posexplode("labels").alias("label_no", "label"))
    known = rows.filter(F.coalesce("label", F.lit("")) != "")
    return stage(known, {"norm": normalize_label(F.col("label"))}).filter("norm <> ''")


def label_index(metrics: DataFrame) -> DataFrame:
    """(norm, metric_code, ambiguous): the first metric of a label, and whether another one has it too."""
    rows = metric_labels(metrics, ("metric_name_cn", "metric_name_en"))
    return rows.groupBy("norm").agg(
        F.min_by("metric_code", F.struct("def_order", "label_no")).alias("metric_code"),
        (F.min("metric_code") != F.max("metric_code")).alias("ambiguous"),
    )


def normalize_lang(lang: Column) -> Column:
    lower = F.lower(F.coalesce(lang, F.lit("")))
    return (
        F.when(lower == "", F.lit("unknown"))
        .when(lower.startswith("zh"), F.lit("cn"))
        .when(lower.startswith("en"), F.lit("en"))
        .otherwise(lower)
    )


def concept_code(source: Column, concept: Column) -> Column:
    return F.lower(F.concat(F.lit("xbrl_"), source, F.lit("_"), F.regexp_replace(concept, "[^a-zA-Z0-9_]+", "_")))


def map_concepts(labels: DataFrame, metrics: DataFrame, create: bool = False) -> DataFrame:
    """Concepts to metrics: (concept, metric_code, is_new, and the fields of a new metric).

    The first label in order that names exactly one metric decides.  With
    ``create`` a concept without one becomes a metric if its labels tell the
    statement.  ``labels``: concept, label, lang, source, entry_order.
    """
    usable = labels.filter((F.coalesce("concept", F.lit("")) != "") & (F.coalesce("label", F.lit("")) != ""))
    named = stage(usable, {"norm": normalize_label(F.col("label"))})
    index = label_index(metrics).filter("NOT ambiguous").select("norm", "metric_code")
    hits = named.join(index, "norm", "left")
    word = lambda pattern: F.max(F.rlike("label", F.lit(pattern)))
    found = hits.groupBy("concept").agg(
        F.min_by(
            "metric_code", F.when(F.col("metric_code").isNotNull(), F.col("entry_order"))
        ).alias("metric_code"),
        F.min(F.struct("entry_order", "label", "source")).alias("first"),
        word(CASHFLOW_WORDS).alias("w_cash"),
        word(INCOME_WORDS).alias("w_income"),
        word(BALANCE_WORDS).alias("w_balance"),
        word(RATIO_WORDS).alias("w_ratio"),
    )
    statement = F.when(F.col("w_cash"), "cashflow").when(F.col("w_income"), "income").when(F.col("w_balance"), "balance")
    made = concept_code(F.coalesce("first.source", F.lit("xbrl")), F.col("concept"))
    out = found.select(
        "concept",
        F.col("first.entry_order").alias("concept_order"),
        F.coalesce("metric_code", F.when(F.lit(create) & statement.isNotNull(), made)).alias("metric_code"),
        F.col("metric_code").isNull().alias("is_new"),
        F.col("first.label").alias("metric_name_cn"),
        statement.alias("statement_type"),
        F.when(F.col("w_ratio"), "ratio").when(statement == "balance", "stock").otherwise("flow").alias("value_nature"),
    )
    return out.filter("metric_code IS NOT NULL")


def append_labels(metrics: DataFrame, additions: DataFrame) -> DataFrame:
    """Add additions(metric_code, bucket, label, add_order) to the metrics' buckets, without repeats.

    Repeats are dropped before labels are put together, so a metric's row holds
    its distinct labels only.
    """
    firsts = additions.groupBy("metric_code", "bucket", "label").agg(F.min("add_order").alias("add_order"))
    lists = firsts.groupBy("metric_code").agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("add_order", "label")))),
                lambda x: x["label"],
            ).alias(f"add_{b}")
            for b in BUCKETS
        ]
    )
    empty = F.array().cast("array<string>")
    joined = metrics.join(lists, "metric_code", "left")
    grown = {b: F.concat(F.coalesce(b, empty), F.array_except(F.coalesce(f"add_{b}", empty), F.coalesce(b, empty))) for b in BUCKETS}
    return joined.withColumns(grown).select(*metrics.columns)


def new_metrics(found: DataFrame, metrics: DataFrame, order: str) -> DataFrame:
    """Metric rows of codes the dictionary does not have, after all it has; the first row of a code describes it.

    ``order`` may be of any type that sorts: the rows are sorted over the
    cluster and numbered in that order, with gaps.
    """
    fields = ["metric_name_cn", "statement_type", "value_nature"]
    fresh = found.join(metrics.select("metric_code"), "metric_code", "left_anti")
    first = fresh.groupBy("metric_code").agg(F.min(F.struct(F.col(order).alias("at"), *fields)).alias("d"))
    after = F.coalesce(metrics.agg(F.max("def_order").cast("long")).scalar(), F.lit(-1)) + 1
    first = first.orderBy("d.at", "metric_code").withColumn("place", F.monotonically_increasing_id())
    empty = F.array().cast("array<string>")
    values = {
        "def_order": after + F.col("place"),
        "metric_name_cn": F.col("d.metric_name_cn"),
        "metric_name_en": F.lit(None).cast("string"),
        "statement_type": F.col("d.statement_type"),
        "value_nature": F.col("d.value_nature"),
        "parent_metric_code": F.lit(None).cast("string"),
        **{b: empty for b in BUCKETS},
    }
    return first.select(*[(values[c] if c in values else F.col(c)).alias(c) for c in metrics.columns])


def label_additions(labels: DataFrame, concepts: DataFrame) -> DataFrame:
    """Labels of mapped concepts that pass the guards, with the bucket they go to."""
    joined = labels.join(concepts.select("concept", "metric_code", "concept_order"), "concept")
    named = stage(joined, {"norm": normalize_label(F.col("label")), "language": normalize_lang(F.col("lang"))})
    short = F.length("norm") <= SHORT_MAX
    kept = named.filter(
        (F.col("norm") != "")
        & ~_norm_in(F.col("norm"), STOP_LABELS)
        & ~(short & _norm_in(F.col("norm"), GENERIC_SHORT))
        & ~F.rlike("label", F.lit(r"(?U)\d"))
        & F.col("language").isin("cn", "en")
    )
    bucket = F.when(F.col("language") == "cn", F.when(short, "patterns_exact").otherwise("patterns")).otherwise(
        F.when(short, "patterns_en_exact").otherwise("patterns_en")
    )
    return kept.select("metric_code", bucket.alias("bucket"), "label", F.struct("concept_order", "entry_order").alias("add_order"))


def merge_labels(metrics: DataFrame, labels: DataFrame, create: bool = False) -> DataFrame:
    """Dictionary with the labels of a taxonomy added.

    New metrics and additions both need the mapped concepts, and these need all labels, so they are mapped once.
    """
    concepts = materialize(map_concepts(labels, metrics, create), "mapped-concepts")
    full = metrics
    if create:
        full = metrics.unionByName(new_metrics(concepts.filter("is_new"), metrics, "concept_order"))
    return append_labels(full, label_additions(labels, concepts))


# ---------------------------------------------------------------- table of contents


def clean_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def sub_name(raw: Column) -> Column:
    """Name of a contents row without the note prefix and bracketed remarks."""
    out = F.regexp_replace(clean_spaces(raw), r"(?U)\A附注[_:：\-\s]*", "")
    return clean_spaces(F.regexp_replace(F.regexp_replace(out, "（[^）]*）", ""), r"\([^)]*\)", ""))


def contents(rows: DataFrame, group: str = "doc", order: str = "row_index", block_rows: int = 4096) -> DataFrame:
    """Contents rows (level, cas_code, cas_name, sub_code, sub_name, sub_name_raw): headings filled down.

    ``rows``: group, order (an integer), text.  Filling down is a running
    maximum over blocks, so one long list is spread over tasks.
    """
    read = stage(
        rows.select(group, order, clean_spaces(F.col("text")).alias("text")),
        {
            "top_code": F.nullif(F.regexp_extract("text", TOP_ROW, 1), F.lit("")),
            "top_name": F.regexp_extract("text", TOP_ROW, 2),
            "sub_code": F.nullif(F.regexp_extract("text", SUB_ROW, 1), F.lit("")),
            "sub_name_raw": F.regexp_extract("text", SUB_ROW, 2),
        },
    )
    read = materialize(read, "contents-rows")
    top = F.when(F.col("top_code").isNotNull(), F.struct(order, "top_code", "top_name"))
    filled = running(read, [group], [order], {"head": ("max", top)}, F.col(order), block_rows)
    is_top = F.col("top_code").isNotNull()
    return filled.filter("top_code IS NOT NULL OR sub_code IS NOT NULL").select(
        group,
        order,
        F.when(is_top, "cas").otherwise("sub").alias("level"),
        F.col("head.top_code").alias("cas_code"),
        F.col("head.top_name").alias("cas_name"),
        F.when(~is_top, F.col("sub_code")).alias("sub_code"),
        F.when(~is_top, sub_name(F.col("sub_name_raw"))).alias("sub_name"),
        F.when(~is_top, F.col("sub_name_raw")).alias("sub_name_raw"),
    )


def map_contents(toc: DataFrame, metrics: DataFrame, create: bool = False) -> DataFrame:
    """Contents rows to metrics, with method and confidence.

    A fixed override comes first, then a name that exactly one metric has, then
    (with ``create``) a new metric.  ``toc``: row_order, cas_code, cas_name,
    sub_code, sub_name, sub_name_raw.
    """
    rows = metric_labels(metrics, ("metric_name_cn",), ("patterns", "patterns_exact"))
    index = (
        rows.groupBy("norm")
        .agg(F.min("metric_code").alias("unique_code"), F.max("metric_code").alias("_max"))
        .filter("unique_code = _max")
        .drop("_max")
    )
    fixed = reduce(
        lambda acc, kv: acc.when(F.col("sub_name") == kv[0], F.lit(kv[1])), NAME_OVERRIDES.items(), F.when(F.lit(False), F.lit(""))
    )
    wanted = toc.filter((F.coalesce("sub_code", F.lit("")) != "") & (F.coalesce("sub_name", F.lit("")) != ""))
    named = materialize(stage(wanted, {"norm": normalize_label(F.col("sub_name")), "override": fixed}), "contents-names")
    fixed_codes = metrics.filter(F.col("metric_code").isin(*NAME_OVERRIDES.values()))
    known = fixed_codes.select(F.col("metric_code").alias("override"), F.lit(True).alias("override_known"))
    firsts = named.filter("override IS NOT NULL").groupBy("override").agg(F.min("row_order").alias("first_order"))
    joined = named.join(shuffled(index), "norm", "left").join(known, "override", "left").join(firsts, "override", "left")
    overridden = F.col("override").isNotNull() & (F.col("override_known").isNotNull() | F.lit(create))
    makes = overridden & F.col("override_known").isNull() & (F.col("row_order") == F.col("first_order"))
    unique = ~overridden & F.col("unique_code").isNotNull()
    auto = ~overridden & F.col("unique_code").isNull() & F.lit(create)
    text = F.concat_ws(" ", F.coalesce("cas_name", F.lit("")), F.col("sub_name"))
    statement = (
        F.when(F.rlike(text, F.lit(CONTENTS_CASHFLOW)), "cashflow")
        .when(F.rlike(text, F.lit(CONTENTS_BALANCE)), "balance")
        .otherwise("income")
    )
    nature = F.when(F.rlike("sub_name", F.lit(CONTENTS_RATIO)), "ratio").when(statement == "balance", "stock").otherwise("flow")
    return joined.select(
        "row_order", "cas_code", "cas_name", "sub_code", "sub_name", "sub_name_raw",
        F.when(overridden, F.col("override"))
        .when(unique, F.col("unique_code"))
        .when(auto, F.concat(F.lit("cas2020_"), F.col("sub_code")))
        .alias("metric_code"),
        F.when(makes, "override_create").when(overridden, "override").when(unique, "unique_name").when(auto, "auto_create").otherwise("unmapped").alias("mapping_method"),
        F.when(makes, 0.95).when(overridden, 1.0).when(unique, 0.9).when(auto, 0.5).otherwise(0.0).alias("confidence"),
        F.col("sub_name").alias("metric_name_cn"),
        statement.alias("statement_type"),
        nature.alias("value_nature"),
    )


def contents_additions(mapped: DataFrame) -> DataFrame:
    """Aliases a mapped contents row gives its metric: name (exact), raw name and ``[code] raw name``."""
    raw = F.coalesce("sub_name_raw", F.lit(""))
    entry = lambda no, label, exact: F.struct(F.lit(no).alias("no"), label.alias("label"), F.lit(exact).alias("exact"))
    names = F.array(
        entry(0, F.col("sub_name"), True),
        entry(1, F.when((raw != "") & (raw != F.col("sub_name")), raw), False),
        entry(2, F.concat(F.lit("["), F.col("sub_code"), F.lit("] "), F.coalesce(F.nullif(raw, F.lit("")), F.col("sub_name"))), False),
    )
    rows = mapped.filter("metric_code IS NOT NULL").select("metric_code", "row_order", F.inline(names)).filter("label IS NOT NULL")
    named = stage(rows, {"norm": normalize_label(F.col("label"))})
    short = F.length("norm") <= SHORT_MAX
    kept = named.filter(
        (F.col("norm") != "")
        & ~_norm_in(F.col("norm"), CONTENTS_STOP_LABELS)
        & ~(short & _norm_in(F.col("norm"), GENERIC_SHORT))
    )
    bucket = F.when(F.col("exact") | short, "patterns_exact").otherwise("patterns")
    return kept.select("metric_code", bucket.alias("bucket"), "label", F.struct("row_order", "no").alias("add_order"))


def merge_contents(metrics: DataFrame, toc: DataFrame, create: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(dictionary, mapping records)`` after merging a table of contents."""
    mapped = map_contents(toc, metrics, create)
    full = metrics.unionByName(new_metrics(mapped.filter("metric_code IS NOT NULL"), metrics, "row_order")) if create else metrics
    records = mapped.drop("metric_name_cn", "statement_type", "value_nature")
    return append_labels(full, contents_additions(mapped)), records


def contents_counts(mapped: DataFrame, metrics: DataFrame) -> DataFrame:
    """Counts of one merge: matched, created, alias_added, skipped."""
    per_row = mapped.agg(
        F.count_if(F.col("mapping_method") == "unique_name").alias("matched"),
        F.count_if(F.col("mapping_method") == "unmapped").alias("skipped"),
    )
    made = mapped.filter("metric_code IS NOT NULL").select("metric_code").distinct().join(shuffled(metrics), "metric_code", "left_anti")
    have = metrics.select("metric_code", F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("labels")) for b in BUCKETS])).alias("x")).select(
        "metric_code", "x.bucket", F.explode("x.labels").alias("label")
    )
    added = contents_additions(mapped).select("metric_code", "bucket", "label").distinct().join(shuffled(have), ["metric_code", "bucket", "label"], "left_anti")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return side_by_side([per_row, one(made, "created"), one(added, "alias_added")])


# ---------------------------------------------------------------- cleanup and sync


def clean_dictionary(metrics: DataFrame) -> DataFrame:
    """Remove stop labels and generic short ones, move other short labels to the exact bucket; add ``changed``."""
    info = lambda c: F.transform(c, lambda l: F.struct(l.alias("label"), normalize_label(l).alias("norm")))
    read = stage(metrics, {"_cn": info(F.col("patterns")), "_en": info(F.col("patterns_en"))})
    stop = lambda x: _norm_in(x["norm"], STOP_LABELS)
    short = lambda x: F.length(x["norm"]) <= SHORT_MAX
    generic = lambda x: _norm_in(x["norm"], GENERIC_SHORT)
    labels = lambda items: F.transform(items, lambda x: x["label"])
    long_ = lambda c: labels(F.filter(c, lambda x: ~stop(x) & ~short(x)))
    moved_cn = labels(F.filter("_cn", lambda x: ~stop(x) & short(x) & ~generic(x)))
    moved_en = labels(F.filter("_en", lambda x: ~stop(x) & short(x)))
    changed = (F.size(long_("_cn")) < F.size("_cn")) | (F.size(long_("_en")) < F.size("_en"))
    done = read.select(
        *[c for c in metrics.columns if c not in BUCKETS],
        F.array_distinct(long_("_cn")).alias("patterns"),
        F.array_distinct(F.concat("patterns_exact", moved_cn)).alias("patterns_exact"),
        F.array_distinct(long_("_en")).alias("patterns_en"),
        F.array_distinct(F.concat("patterns_en_exact", moved_en)).alias("patterns_en_exact"),
        changed.alias("changed"),
    )
    return done.select(*metrics.columns, "changed")


def prune_prefix(metrics: DataFrame, prefix: str = "cas2020_") -> DataFrame:
    return metrics.filter(~F.col("metric_code").startswith(prefix))


def prune_counts(metrics: DataFrame, prefix: str = "cas2020_") -> DataFrame:
    gone = F.count_if(F.col("metric_code").startswith(prefix))
    return metrics.agg(F.count("*").alias("before"), (F.count("*") - gone).alias("after"), gone.alias("removed"))


def needs_sync(state: DataFrame, file_hash: str, force: bool = False) -> bool:
    """Whether a dictionary file differs from the one last synced; ``state`` has at most one row."""
    return force or not state.filter((F.col("state_id") == 1) & (F.col("file_hash") == file_hash)).take(1)


def upsert_metrics(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored metrics with names, statement and nature replaced; unknown codes added with a stable id.

    ``stored``: metric_id, metric_code, metric_name_cn, metric_name_en,
    statement_type, value_nature.
    """
    fields = ["metric_name_cn", "metric_name_en", "statement_type", "value_nature"]
    last = incoming.groupBy("metric_code").agg(F.max_by(F.struct(*fields), "def_order").alias("n"))
    named = last.withColumn("n", F.struct(
        F.col("n.metric_name_cn"), F.coalesce("n.metric_name_en", english_name(F.col("metric_code"))).alias("metric_name_en"),
        F.col("n.statement_type"), F.col("n.value_nature"),
    ))
    old = stored.select("metric_code", "metric_id", F.struct(*fields).alias("o"))
    both = old.join(named, "metric_code", "full_outer")
    taken = F.coalesce("n", "o")
    return both.select(
        F.coalesce("metric_id", F.xxhash64("metric_code")).alias("metric_id"), "metric_code", taken.alias("t")
    ).select("metric_id", "metric_code", "t.*")


def resolve_parents(metrics: DataFrame) -> DataFrame:
    """(metric_code, parent_metric_id): NULL for a parent that is not there."""
    parents = metrics.select(F.col("metric_code").alias("parent_metric_code"), F.col("metric_id").alias("parent_metric_id"))
    return metrics.join(parents, "parent_metric_code", "left").select("metric_code", "parent_metric_id")


def alias_rows(metrics: DataFrame) -> DataFrame:
    """(metric_code, alias_text, language, match_mode) of all four buckets."""
    kinds = {"patterns": ("cn", "phrase"), "patterns_exact": ("cn", "exact"), "patterns_en": ("en", "phrase"), "patterns_en_exact": ("en", "exact")}
    packs = [
        F.struct(F.col(b).alias("labels"), F.lit(lang).alias("language"), F.lit(mode).alias("match_mode"))
        for b, (lang, mode) in kinds.items()
    ]
    return metrics.select("metric_code", F.inline(F.array(*packs))).select(
        "metric_code", F.explode("labels").alias("alias_text"), "language", "match_mode"
    )


def ancestors(metrics: DataFrame) -> DataFrame:
    """(metric_code, ancestor_code, distance) for every step up the parent chain, however long.

    Steps double in each round: pairs at most 2**k apart meet pairs exactly 2**k
    apart, so a chain of n levels takes log2(n) rounds; each is written to the
    shared work folder.  A code that meets itself is a cycle and an error.
    """
    codes = metrics.select("metric_code")
    found = materialize(
        metrics.filter("parent_metric_code IS NOT NULL")
        .select("metric_code", F.col("parent_metric_code").alias("ancestor_code"), F.lit(1).cast("int").alias("distance"))
        .join(codes.withColumnRenamed("metric_code", "ancestor_code"), "ancestor_code", "left_semi")
        .select("metric_code", "ancestor_code", "distance"),
        "parent-edges",
    )
    reach = 1
    while True:
        if found.filter("metric_code = ancestor_code").take(1):
            raise ValueError("parent chain has a cycle")
        far = found.filter(F.col("distance") == reach)
        above = found.select(F.col("metric_code").alias("ancestor_code"), F.col("ancestor_code").alias("next_code"), F.col("distance").alias("more"))
        grown = far.join(above, "ancestor_code").select("metric_code", F.col("next_code").alias("ancestor_code"), (F.col("distance") + F.col("more")).alias("distance"))
        grown = materialize(grown, "ancestor-level")
        if not grown.take(1):
            return found
        found, reach = found.unionByName(grown), 2 * reach
