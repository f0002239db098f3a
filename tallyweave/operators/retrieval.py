"""Vector search, reranking, contexts and term search over tables of queries.

Exact search never joins queries with vectors row by row.  A bounded block of
query vectors is multiplied with each Arrow batch of the corpus, and every task
sends on only its best rows per query.  Query sets beyond the bound are cut
into blocks that meet corpus blocks on a grid.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import vectors as V
from tallyweave.operators.stage import materialize, spread, stage

# The scoring helpers run in Python workers, which need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP_N, TOP_K = 20, 5
MAX_QUERY_BLOCK = 2048
GRID_ROWS = 50_000
HITS = "query_id long, id long, score double"


def _unit_rows(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _keep(best: pd.DataFrame | None, fresh: pd.DataFrame, n: int) -> pd.DataFrame:
    """Best ``n`` rows per query: score down to 9 digits, then id."""
    both = fresh if best is None else pd.concat([best, fresh], ignore_index=True)
    both = both.assign(_r=both["score"].round(9)).sort_values(["query_id", "_r", "id"], ascending=[True, False, True])
    return both.groupby("query_id", sort=False).head(n).drop(columns="_r")


def _score_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, corpus: np.ndarray, n: int) -> pd.DataFrame:
    scores = corpus @ queries.T
    rounded = np.round(scores, 9)
    if len(ids) > n:
        # The n-th best score per query; ties with it are all kept for the id order.
        floor = -np.partition(-rounded, n - 1, axis=0)[n - 1]
        rows, cols = np.nonzero(rounded >= floor)
    else:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
    return pd.DataFrame({"query_id": query_ids[cols], "id": ids[rows], "score": scores[rows, cols]})


def _rank(hits: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_n(
    queries: DataFrame, corpus: DataFrame, n: int = TOP_N, max_block: int = MAX_QUERY_BLOCK, grid_rows: int = GRID_ROWS
) -> DataFrame:
    """Exact cosine top-N: queries(query_id, embedding) against corpus(id, embedding).

    Up to ``max_block`` queries travel to the tasks and the corpus is scanned in
    place.  More queries go through the block grid, with the same result.
    """
    head = queries.select("query_id", "embedding").limit(max_block + 1).toPandas()
    if len(head) > max_block:
        return _grid_top_n(queries, corpus, n, max_block, grid_rows)
    if not len(head):
        return queries.sparkSession.createDataFrame([], HITS + ", rank int")
    query_ids, matrix = head["query_id"].to_numpy(np.int64), _unit_rows(head["embedding"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            if len(batch):
                fresh = _score_block(query_ids, matrix, batch["id"].to_numpy(np.int64), _unit_rows(batch["embedding"]), n)
                best = _keep(best, fresh, n)
        if best is not None:
            yield best

    return _rank(corpus.select(F.col("id").cast("long"), "embedding").mapInPandas(scan, HITS), n)


def _grid_top_n(queries: DataFrame, corpus: DataFrame, n: int, max_block: int, grid_rows: int) -> DataFrame:
    """Query blocks by corpus blocks: each cell of the grid is one bounded group."""
    q_blocks = max(1, -(-queries.count() // max_block))
    c_blocks = max(1, -(-corpus.count() // grid_rows))
    place = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select(
        F.col("query_id").cast("long"), "embedding", place("query_id", q_blocks).alias("qb"), every(c_blocks).alias("cb")
    )
    right = corpus.select(F.col("id").cast("long"), "embedding", place("id", c_blocks).alias("cb"), every(q_blocks).alias("qb"))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64"})
        hits = _score_block(
            q["query_id"].to_numpy(np.int64), _unit_rows(q["embedding"]), c["id"].to_numpy(np.int64), _unit_rows(c["embedding"]), n
        )
        return _keep(None, hits, n)

    return _rank(left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(cell, HITS), n)


# ---------------------------------------------------------------- hashed search


TABLES, FLIPS, BUCKET, MIN_BITS = 12, 2, 32, 4
UNIT = 1 << 20  # components are read in steps of its inverse, so that projections are whole numbers and exact anywhere


def plane_sign(table: int, bit: int, dimension: int) -> int:
    """1 or -1, by the first hex digit of the MD5 of the three numbers: the same planes in any language."""
    return 1 - 2 * (int(hashlib.md5(f"{table}:{bit}:{dimension}".encode()).hexdigest()[0], 16) & 1)


def hyperplanes(width: int, tables: int, bits: int) -> np.ndarray:
    return np.array([[[plane_sign(t, b, i) for i in range(width)] for b in range(bits)] for t in range(tables)], np.int64).reshape(tables, bits, width)


def bits_for(rows: int, bucket: int = BUCKET) -> int:
    """Fewest bits, at least MIN_BITS, that leave at most ``bucket`` rows a bucket if all are equally full."""
    return max(MIN_BITS, (max(1, -(-rows // bucket)) - 1).bit_length())


def signatures(df: DataFrame, tables: int, bits: int, flips: int = 0, vector: str = "embedding") -> DataFrame:
    """Add ``signature``: the buckets of each row, table number and signs of the projections in one number.

    With ``flips``, also the buckets on the other side of any of the ``flips``
    planes nearest to the vector, ties to the lower bit.  Vectors may differ in
    width; a null one has no bucket.
    """
    flips = min(flips, bits)
    weights = (1 << np.arange(bits)).astype(np.int64)
    chosen = np.array([[m >> k & 1 for k in range(flips)] for m in range(1 << flips)], np.int64).reshape(1 << flips, flips)

    @F.pandas_udf("array<long>")
    def sign(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        size = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
        for width in set(size.tolist()) - {-1}:
            rows = np.flatnonzero(size == width)
            whole = np.floor(np.stack(vectors.iloc[rows].to_list()).astype(np.float64) * UNIT).astype(np.int64)
            side = np.einsum("tbw,nw->ntb", hyperplanes(width, tables, bits), whole)
            code = ((side > 0) * weights).sum(axis=2)[:, :, None]
            nearest = np.argsort(np.abs(side), axis=2, kind="stable")[:, :, :flips]
            code = code ^ (weights[nearest] @ chosen.T)
            code = code * tables + np.arange(tables)[:, None]
            for i, own in zip(rows.tolist(), code.reshape(len(rows), -1)):
                out[i] = own
        return pd.Series(out)

    return df.withColumn("signature", sign(vector))


def hashed_top_n(
    queries: DataFrame, corpus: DataFrame, n: int, tables: int = TABLES, bits: int | None = None, flips: int = FLIPS, bucket: int = BUCKET
) -> DataFrame:
    """Approximate top-N: candidates share a bucket with a query, or one across its nearest planes, and are scored exactly.

    The number of bits follows the size of the corpus, so buckets stay about as
    full at any size.  Only ids meet in the buckets; vectors are fetched once for
    each pair that met.  Copies of a vector share all buckets: only the first
    ``n`` ids of a vector can be among the best n of any query, so copies beyond
    that are dropped before the join and a bucket full of copies stays small.
    """
    if bits is None:
        bits = bits_for(corpus.count(), bucket)
    copies = Window.partitionBy("embedding").orderBy("id")
    distinct = corpus.select("id", "embedding").withColumn("_c", F.row_number().over(copies)).filter(F.col("_c") <= n).drop("_c")
    distinct = materialize(distinct, "hashed-corpus")
    buckets = lambda df, key, flips: signatures(df, tables, bits, flips).select(key, F.explode("signature").alias("bucket"))
    met = buckets(queries, "query_id", flips).join(buckets(distinct, "id", 0), "bucket").select("query_id", "id").distinct()
    pairs = met.join(distinct.withColumnRenamed("embedding", "c_vec"), "id")
    pairs = pairs.join(queries.select("query_id", F.col("embedding").alias("q_vec")), "query_id")
    return _rank(pairs.select("query_id", "id", V.cosine(F.col("q_vec"), F.col("c_vec")).alias("score")), n)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n_exact, n_found, recall of (query_id, id) pairs of a search against the exact one."""
    keys = ["query_id", "id"]
    met = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    counted = met.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    return counted.withColumn("recall", F.coalesce(F.try_divide("n_found", "n_exact"), F.lit(0.0)))


# ---------------------------------------------------------------- rerank and contexts


def lexical_score(query: Column, passage: Column) -> Column:
    """Share of the query's terms in the passage, 0 to 10: the default scorer."""
    q = F.array_distinct(V.terms(query))
    return F.coalesce(
        F.try_divide(10.0 * F.size(F.array_intersect(q, V.terms(passage))), F.nullif(F.size(q), F.lit(0))), F.lit(0.0)
    )


def parse_scores(response: Column) -> Column:
    """Scores of a ranker's JSON answer; NULL when it cannot be read.

    A missing score counts 0; an entry without a usable index spoils the answer.
    """
    parsed = F.from_json(response, "array<struct<index:string,score:string>>", {"mode": "PERMISSIVE"})
    typed = F.transform(
        parsed,
        lambda p: F.struct(
            p["index"].try_cast("int").alias("index"), F.coalesce(p["score"], F.lit("0")).try_cast("double").alias("score")
        ),
    )
    readable = F.forall(typed, lambda p: p["index"].isNotNull() & p["score"].isNotNull())
    return F.when(readable, typed)


def rerank(hits: DataFrame, scores: DataFrame, k: int = TOP_K, failed: DataFrame | None = None) -> DataFrame:
    """Order hits by rerank score; ``scores`` has query_id, index (0-based rank) and rerank_score.

    Hits without a score are dropped.  Queries in ``failed`` keep the vector
    order.  Equal scores keep the order of the scores (``score_pos`` where
    given, else the index).
    """
    position = "score_pos" if "score_pos" in scores.columns else "index"
    scored = hits.withColumn("index", F.col("rank") - 1).join(scores, ["query_id", "index"])
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), position)
    ranked = scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    keep = [*hits.columns, "rerank_score", "position"]
    out = ranked.select(*keep)
    if failed is None:
        return out
    fallback = hits.join(failed.select("query_id").distinct(), "query_id", "left_semi").filter(F.col("rank") <= k)
    return out.join(failed.select("query_id").distinct(), "query_id", "left_anti").unionByName(
        fallback.withColumns({"rerank_score": F.lit(None).cast("double"), "position": F.col("rank")}).select(*keep)
    )


def context_blocks(hits: DataFrame) -> DataFrame:
    """Per query the numbered sources as one text; at most the K hits of the query meet in one row."""
    block = F.concat(
        F.lit("["), F.col("position").cast("string"), F.lit("] Source: "), F.coalesce("source_path", F.lit("unknown")),
        F.lit(" | Page: "), F.coalesce(F.col("page").cast("string"), F.lit("0")), F.lit("\n"), F.coalesce("text", F.lit("")),
    )
    return (
        hits.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", block.alias("block")))).alias("b"))
        .select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))
    )


def citations(hits: DataFrame, width: int = 200) -> DataFrame:
    return hits.select(
        "query_id", F.col("position").alias("index"), "source_path", "page",
        F.left(F.coalesce("text", F.lit("")), F.lit(width)).alias("snippet"),
    )


def result_rows(hits: DataFrame) -> DataFrame:
    """Result list: source, page, a 240-character snippet and the scores there are."""
    extra = [c for c in ("score", "rerank_score") if c in hits.columns]
    names = {"score": "vector_score"}
    return hits.select(
        "query_id", "position", "source_path", "page", F.left(F.coalesce("text", F.lit("")), F.lit(240)).alias("snippet"),
        *[F.col(c).alias(names.get(c, c)) for c in extra],
    )


def _fixed(value: Column, digits: int) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)).otherwise(F.lit("n/a"))


def display_lines(hits: DataFrame, top: int = 5) -> DataFrame:
    """Display lines of the first hits: vector score with 4 digits, rerank score with 2."""
    rows = hits.filter(F.col("position") <= top)
    line = F.concat(
        F.lit("- ["), F.col("position").cast("string"), F.lit("] "), F.coalesce("source_path", F.lit("None")), F.lit(" p."),
        F.coalesce(F.col("page").cast("string"), F.lit("None")),
    )
    shown = {"vector_text": _fixed(F.col("score"), 4)}
    if "rerank_score" in hits.columns:
        shown["rerank_text"] = _fixed(F.col("rerank_score"), 2)
    return rows.select("query_id", "position", line.alias("line"), *[c.alias(n) for n, c in shown.items()])


def search(queries: DataFrame, corpus: DataFrame, n: int = TOP_N, k: int = TOP_K, scorer=lexical_score) -> DataFrame:
    """Vector top-N, rerank, first K: queries(query_id, query, embedding), corpus(id, text, source_path, page, embedding)."""
    hits = top_n(queries, corpus, n)
    about = corpus.drop("embedding")
    full = hits.join(about, "id").join(queries.select("query_id", "query"), "query_id")
    # At most n rows per query, read twice: once for the scores, once for the order.
    full = materialize(full, "search-hits")
    scores = full.select(
        "query_id", (F.col("rank") - 1).alias("index"), scorer(F.col("query"), F.col("text")).alias("rerank_score")
    )
    return rerank(full, scores, k)


# ---------------------------------------------------------------- term search


def _text_postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Postings of each row of ``docs`` on its own: its sorted words are cut where the term changes, so no word is shuffled."""
    words = F.transform(V.terms(F.col(text)), lambda t, i: F.struct(t.alias("term"), i.alias("position")))
    ordered = stage(docs.select(key, text), {"words": F.sort_array(words)}, [key]).filter(F.size("words") > 0)
    at = F.sequence(F.lit(0), F.size("words") - 1)
    first = F.filter(at, lambda i: (i == 0) | (F.get("words", i)["term"] != F.get("words", i - 1)["term"]))
    cut = stage(ordered, {"first": first}, [key, "words"])

    def posting(a: Column, k: Column) -> Column:
        end = F.coalesce(F.get("first", k + 1), F.size("words"))
        positions = F.transform(F.slice("words", a + 1, end - a), lambda w: w["position"])
        return F.struct(F.get("words", a)["term"].alias("term"), (end - a).cast("long").alias("tf"), positions.alias("positions"))

    return cut.select(key, F.inline(F.transform("first", posting))).select("term", key, "tf", "positions")


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Inverted index rows (term, key, tf, positions); a term's rows stay rows and are never gathered.

    A key's postings are made within its row.  Only rows that share a key, found
    by a count of the keys when the plan is built, meet in a shuffle of their words.
    """
    docs = spread(docs.select(key, text))
    repeated = docs.groupBy(key).count().filter("count > 1").select(F.col(key).alias("repeated"))
    if not repeated.take(1):
        return _text_postings(docs, key, text)
    same = F.col(key).eqNullSafe(F.col("repeated"))
    words = docs.join(repeated, same, "left_semi").select(key, F.posexplode(V.terms(F.col(text))).alias("position", "term"))
    shared = words.groupBy("term", key).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))
    return _text_postings(docs.join(repeated, same, "left_anti"), key, text).unionByName(shared)


def key_range(key: str, ranges: int) -> Column:
    """Which of ``ranges`` equal ranges of hashes a key falls into; the same for every term."""
    return F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int")


def posting_blocks(index: DataFrame, key: str, ranges: int) -> DataFrame:
    """Postings in blocks (term, block, df, entries): a term's keys of one range of keys, in key order.

    ``ranges`` should grow with the corpus (documents by the wanted size of a
    block): a block has at most the documents of one range, however frequent its
    term.  ``df``: how many entries it has.
    """
    entry = F.struct(F.col(key).alias("key"), "tf")
    blocks = index.groupBy("term", key_range(key, ranges).alias("block"))
    return blocks.agg(F.count("*").alias("df"), F.array_sort(F.collect_list(entry)).alias("entries"))


def probe_plan(blocks: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, others): the rarest term of each query and its further terms; a query with an unknown term is in neither."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(V.terms(F.col("query")))).alias("term"))
    sizes = blocks.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    ranked = wanted.join(sizes, "term", "left")
    rarest = ranked.groupBy("query_id").agg(
        F.min(F.struct("df", "term")).alias("r"), F.count_if(F.col("df").isNull()).alias("unknown"), F.count("*").alias("n_terms")
    )
    first = rarest.filter("unknown = 0").select("query_id", F.col("r.term").alias("term"), "n_terms")
    others = wanted.join(first.select("query_id", F.col("term").alias("rare")), "query_id").filter("term <> rare")
    return first, others.select("query_id", "term")


def candidates(blocks: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """(query_id, n_terms, block, key, tf): postings of each query's rarest term."""
    return blocks.select("term", "block", "entries").join(first, "term").select("query_id", "n_terms", "block", F.inline("entries")).withColumnRenamed(
        "key", key
    )


def needed_blocks(blocks: DataFrame, found: DataFrame, others: DataFrame) -> DataFrame:
    """Blocks of further terms in ranges where their query has candidates; all others are skipped unread."""
    asked = found.select("query_id", "block").distinct().join(others, "query_id").select("term", "block").distinct()
    return blocks.join(asked, ["term", "block"], "left_semi")


def term_search(index: DataFrame, queries: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Keys that hold every term of a query: queries(query_id, query), index(term, key, tf).

    Only postings of terms that some query has are kept; the index is read once.
    The rarest term of a query gives its candidates; of its other terms only the
    blocks are read in which a candidate can lie, and candidates meet postings
    by term and key.  So a frequent term beside a rare one costs as many rows as
    the rare one's ranges hold.  Without ``ranges`` they are made to hold some
    1024 documents each.
    """
    wanted = queries.select(F.explode(V.terms(F.col("query"))).alias("term")).distinct()
    index = materialize(index.select("term", key, "tf").join(wanted, "term", "left_semi"), "wanted-postings")
    if ranges is None:
        ranges = max(1, index.select(F.approx_count_distinct(key)).first()[0] // 1024)
    blocks = materialize(posting_blocks(index, key, ranges), "posting-blocks")
    first, others = probe_plan(blocks, queries)
    found = materialize(candidates(blocks, first, key), "term-candidates")
    read = needed_blocks(blocks, found, others).select("term", F.inline("entries")).withColumnRenamed("key", key)
    probes = found.select("query_id", key).join(others, "query_id")
    hits = probes.join(read, ["term", key]).select("query_id", key, "tf")
    terms = found.select("query_id", key, "tf").unionByName(hits)
    counted = terms.groupBy("query_id", key).agg(F.count("*").alias("n_hit"), F.sum("tf").alias("tf_sum"))
    return counted.join(first.select("query_id", "n_terms"), "query_id").filter("n_hit = n_terms").select("query_id", key, "tf_sum")
