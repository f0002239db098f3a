"""Ranked lexical search turned round: few items wait in an inverted index, many documents stream past it.

The index of the items' terms is broadcast.  Each task counts the terms of its
documents, follows the postings of those that some item holds, adds up the
integer scores of the items met, and keeps each item's ``k`` best documents.
The tasks' lists are merged in two steps, so no task reads all of them.

Two scans of the texts: the first counts documents, terms and document
frequencies, the second scores.  Items beyond ``most_bytes`` of text are dealt into
blocks of bounded size, one pair of scans each, so what is broadcast never
grows with the data.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_stream, stored, with_types

# The formula's fixed values.
K_SCALE, SATURATION, FREE, FULL = 1_000_000_000, 12, 25, 100
MOST_BYTES = 32 << 20  # item text of one block, on which its index depends
PIECE = 1 << 20  # bytes of a long text that are split into terms at a time
CELLS = 1 << 20  # sums (documents x items) held at a time

# Bytes that part terms become blanks; A-Z become a-z; all other bytes, also those of characters beyond ASCII, are kept.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term (UTF-8 bytes, lower-cased in A-Z); a long text is gone through in pieces cut between terms."""
    folded = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    if len(folded) <= PIECE:
        return Counter(folded.split())
    counts, at = Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def _texts(batch):
    column = batch.column("text")
    for i in range(batch.num_rows):
        yield i, column[i].as_py()


def corpus_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and the document frequency of each term of the vocabulary."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)

    def one(batches):
        terms, with_terms, total, held = known.value, 0, 0, Counter()
        for batch in batches:
            for _, text in _texts(batch):
                counts = term_counts(text)
                with_terms += bool(counts)
                total += counts.total()
                held.update(terms[t] for t in counts.keys() & terms.keys())
        yield {"term": [-2, -1, *held], "n": [with_terms, total, *held.values()]}

    # one row a term and task, summed with partial aggregation; as many rows as terms reach the driver
    rows = arrow_stream(docs.select("text"), one, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist()))
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(-2, 0), found.get(-1, 0), df


class Index:
    """Postings of a block of items, and the weights of their terms."""

    def __init__(self, texts: list[str | None]):
        self.items = len(texts)
        counts = [term_counts(t) for t in texts]
        self.vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        term = np.array([self.vocabulary[t] for c in counts for t in c], np.int64)
        item = np.repeat(np.arange(len(texts)), [len(c) for c in counts])
        times = np.array([n for c in counts for n in c.values()], np.int64)
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order], times[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))

    def weigh(self, n: int, total: int, df: np.ndarray) -> None:
        self.n, self.total = n, total
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) for f in df], np.int64)


class Best:
    """For each item the ``k`` highest scores and their documents: bounded heaps in flat arrays, ties to the smaller id (null last)."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # a score counts from 1 on
        self.parts: list[np.ndarray] = []
        self.waiting, self.most = 0, 4 * k * items + CELLS

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least[item]
        if good.any():
            self.parts.append(np.stack([item[good], score[good], null[good], doc[good]]))
            self.waiting += int(good.sum())
            if self.waiting > self.most:
                self.rows()

    def rows(self) -> np.ndarray:
        """Keep the best; rows of item, score, null, document."""
        if not self.parts:
            return np.zeros((4, 0), np.int64)
        every = np.concatenate(self.parts, axis=1)
        every = every[:, np.lexsort((every[3], every[2], -every[1], every[0]))]
        start = np.searchsorted(every[0], every[0], "left")
        place = np.arange(every.shape[1]) - start
        last = every[:, place == self.k - 1]
        self.least[last[0]] = last[1]
        every = every[:, place < self.k]
        self.parts, self.waiting = [every], 0
        return every


def _scored(index: Index, terms: list, tfs: list, sizes: list[int], ids: list, best: Best) -> None:
    """Scores of a run of documents against all items, offered to the heaps."""
    if not terms:
        return
    counts = np.array([len(t) for t in terms])
    doc = np.repeat(np.arange(len(terms)), counts)
    term = np.fromiter((t for own in terms for t in own), np.int64, int(counts.sum()))
    tf = np.fromiter((n for own in tfs for n in own), np.int64, int(counts.sum()))
    m = np.array([FULL - FREE + (FREE * n * index.n) // index.total for n in sizes], np.int64)
    gain = index.weight[term] * ((K_SCALE * tf) // (1000 * tf + SATURATION * m[doc]))
    many = index.first[term + 1] - index.first[term]
    ends = np.cumsum(many)
    place = np.repeat(index.first[term] - (ends - many), many) + np.arange(int(ends[-1]))
    sums = np.zeros(len(terms) * index.items, np.int64)
    np.add.at(sums, np.repeat(doc * index.items, many) + index.item[place], np.repeat(gain, many) * index.times[place])
    at = np.flatnonzero(sums >= np.tile(best.least, len(terms)))
    null = np.array([i is None for i in ids], np.int64)
    number = np.array([0 if i is None else i for i in ids], np.int64)
    best.offer(at % index.items, sums[at], number[at // index.items], null[at // index.items])


def _stream(docs: DataFrame, index: Index, k: int) -> DataFrame:
    """item (place in the block), doc_id, score: each task's ``k`` best documents of every item."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def one(batches):
        index = held.value
        best, known = Best(index.items, k), index.vocabulary.keys()
        run = max(1, CELLS // max(1, index.items))
        terms, tfs, sizes, ids, met = [], [], [], [], 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, text in _texts(batch):
                counts = term_counts(text)
                own = counts.keys() & known
                if not own:
                    continue
                terms.append([index.vocabulary[t] for t in own])
                tfs.append([counts[t] for t in own])
                sizes.append(counts.total())
                ids.append(doc_ids[i])
                met += sum(int(index.first[t + 1] - index.first[t]) for t in terms[-1])
                if len(terms) == run or met > CELLS:
                    _scored(index, terms, tfs, sizes, ids, best)
                    terms, tfs, sizes, ids, met = [], [], [], [], 0
        _scored(index, terms, tfs, sizes, ids, best)
        rows = best.rows()
        yield {"item": rows[0], "doc_id": [None if n else d for n, d in zip(rows[2].tolist(), rows[3].tolist())], "score": rows[1]}

    return arrow_stream(docs, one, "item bigint, doc_id bigint, score bigint")


def _blocks(items: DataFrame, most_bytes: int) -> list[DataFrame]:
    """The items in blocks of at most ``most_bytes`` of text; a longer item is a block of its own."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    total = items.agg(F.sum(size).alias("n"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return []
    parts = 1
    while True:
        block = F.pmod(F.xxhash64("number"), F.lit(parts))
        loads = items.groupBy(block.alias("block")).agg(F.sum(size).alias("n"), F.count("*").alias("rows")).filter((F.col("n") > most_bytes) & (F.col("rows") > 1))
        if parts == 1 and total["n"] <= most_bytes or not loads.limit(1).count():
            return [items.filter(block == b) for b in range(parts)]
        parts = max(2 * parts, math.ceil(total["n"] / most_bytes))


def search(docs: DataFrame, items: DataFrame, k: int = 20, most_bytes: int = MOST_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's ``k`` best documents with a score above 0.

    ``docs``: doc_id, text; ``items``: item_id, text; further columns are not read.
    Null and empty texts hold no term: such documents count for nothing and
    such items have no rows.  Each row is a document or an item of its own, also
    where an id is null or repeated; equal scores go to the smaller doc_id, null last.
    """
    spark: SparkSession = docs.sparkSession
    docs = with_types(docs, doc_id="bigint", text="string")
    items = stored(with_types(items, item_id="bigint", text="string").withColumn("number", F.monotonically_increasing_id()), "items")
    out = spark.createDataFrame([], "number bigint, item_id bigint, doc_id bigint, score bigint")
    for block in _blocks(items, most_bytes):
        held = block.orderBy("number").toArrow()  # bounded by most_bytes
        index = Index(held.column("text").to_pylist())
        index.weigh(*corpus_counts(docs, index.vocabulary))
        if not index.n:
            break
        names = spark.createDataFrame(held.select(["number", "item_id"]).append_column("item", [list(range(held.num_rows))]))
        found = _stream(docs, index, k)
        slots = math.isqrt(found.rdd.getNumPartitions()) + 1
        found = found.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(slots)))
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        some = found.withColumn("place", F.row_number().over(W.partitionBy("item", "slot").orderBy(*order))).filter(F.col("place") <= k)
        out = out.union(some.drop("slot", "place").join(F.broadcast(names), "item").select("number", "item_id", "doc_id", "score"))  # as bounded as the block
    order = W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
