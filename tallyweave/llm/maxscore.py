"""Exact top-k inner products over integer vectors by MaxScore (Turtle and Flood, 1995).

A dimension is a term, and its postings in a shard are the rows whose component has
the sign of the query's.  Only these raise a score; the others lower it.  A term's bound is its largest
possible contribution in the shard.  Terms are taken by bound: as long as the bounds of the
smallest ones do not reach the k-th best score so far, they are non-essential.  Rows in
no essential posting list cannot enter; for the others the essential terms are
summed, then the non-essential ones are probed, largest bound first, while the row can
still enter.  Each pair of a shard and a block of queries is one row of a join;
shards give their k best for each query, which are merged.

Where a shard's and a query's components are so large that a score could leave 62
bits, the same search runs on Python's integers; a score travels as two numbers,
its high and its low 62 bits, so that shards merge in the right order.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_map, stored

SHARD, QUERIES, BLOCK = 8192, 1024, 4096  # rows of a shard, queries of a block, rows between two looks at the threshold
SCALE = 64
LOW_BITS = 62


def integer_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of floor(64 x)); vectors that are null or hold null or non-finite components are left out, as are null ids."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter("vec_id is not null and embedding is not null")
    return kept.filter(good).select("vec_id", F.transform("embedding", lambda e: F.floor(e * SCALE)).alias("v"))


class Shard:
    """Postings of a block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.high, self.low = self.x.max(0), self.x.min(0)
        self.blocks = [
            (a, [(np.flatnonzero(part[:, d] > 0), np.flatnonzero(part[:, d] < 0)) for d in range(x.shape[1])])
            for a in range(0, len(ids), BLOCK)
            for part in [self.x[a : a + BLOCK]]
        ]

        self.kinds = {self.x.dtype: self}
        self.reach = np.maximum(np.abs(self.high.astype(float)), np.abs(self.low.astype(float)))

    def of_kind(self, kind: type) -> Shard:
        """The same postings with components as floats, 64-bit or unbounded integers."""
        kind = np.dtype(kind)
        if kind not in self.kinds:
            other = Shard.__new__(Shard)
            other.ids, other.blocks = self.ids, self.blocks
            other.x, other.high, other.low = (a.astype(kind) for a in (self.x, self.high, self.low))
            self.kinds[kind] = other
        return self.kinds[kind]

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than the query's own, ties to smaller ids.

        As long as no sum can reach 2^52, floats are exact and fastest.
        """
        reach = np.abs(q.astype(float)) @ self.reach
        kind = np.float64 if reach < 2.0**52 else np.int64 if reach < 2.0**61 else object
        best, score = self.of_kind(kind)._search(query_id, q.astype(kind), k)
        return best, score if kind is object else score.astype(np.int64)

    def _search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        bound = np.maximum(np.maximum(q * self.high, q * self.low), 0)
        terms = np.argsort(bound, kind="stable")
        below = np.cumsum(bound[terms])
        best, score, least = np.zeros(0, np.int64), np.zeros(0, q.dtype), None
        for a, postings in self.blocks:
            part = self.x[a : a + BLOCK]
            split = 0 if least is None else int(np.searchsorted(below, least, "left"))  # bounds that sum to less are non-essential
            weak, strong = terms[:split], terms[split:]
            strong = strong[q[strong] != 0]
            if split:
                hit = np.zeros(len(part), bool)
                for d in strong[::-1]:
                    hit[postings[d][0 if q[d] > 0 else 1]] = True
                    if hit.all():
                        break
                rows = np.flatnonzero(hit)
            else:
                rows = np.arange(len(part))
            if len(rows) == len(part):
                essential = np.zeros_like(q)
                essential[strong] = q[strong]
                total = part @ essential
            else:
                total = part[np.ix_(rows, strong)] @ q[strong]
            for place in range(split - 1, -1, -1):
                can = total + below[place] >= least
                if not can.all():
                    rows, total = rows[can], total[can]
                if not len(rows):
                    break
                d = weak[place]
                if q[d]:
                    total = total + part[rows, d] * q[d]
            rows = rows + a
            other = self.ids[rows] != query_id
            rows, total = rows[other], total[other]
            if least is not None:
                rows, total = rows[total >= least], total[total >= least]
            best, score = np.concatenate([best, self.ids[rows]]), np.concatenate([score, total])
            if len(best) > k:
                order = _best_first(best, score)[:k]
                best, score = best[order], score[order]
                least = int(score[-1])
            elif len(best) == k:
                least = int(score.min())
        order = _best_first(best, score)
        return best[order], score[order]


def _best_first(ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    order = np.argsort(ids, kind="stable")
    return order[np.argsort(-score[order], kind="stable")]


def limbs(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low bits of each score; a high part beyond 64 bits stops at the end of its range."""
    high, low = score >> LOW_BITS, score & ((1 << LOW_BITS) - 1)
    if score.dtype == object:
        high = np.array([min(max(h, -(2**63)), 2**63 - 1) for h in high], np.int64)
    return high.astype(np.int64), low.astype(np.int64)


def packed(rows: DataFrame, most: int, number: str) -> DataFrame:
    """Rows of at most ``most`` ids and their vectors of one width, numbered within each width from 0."""

    schema = pa.schema([("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("values", pa.list_(pa.int64())), ("place", pa.string())])

    def one(batches):
        waiting: dict[int, list] = {}
        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                own = waiting.setdefault(len(v), [])
                own.append((i, v))
                if len(own) == most:
                    yield _packed_row(len(v), waiting.pop(len(v)), schema)
        for width, own in waiting.items():
            yield _packed_row(width, own, schema)

    # each row gets a name of its own before it is stored, so equal rows stay apart
    made = stored(rows.mapInArrow(one, "width int, ids array<bigint>, values array<bigint>, place string"), number)
    order = W.partitionBy("width").orderBy("place")
    marks = made.select("place", (F.row_number().over(order) - 1).alias(number))
    return stored(made.join(marks, "place").drop("place"), number)


def _packed_row(width: int, own: list, schema: pa.Schema) -> pa.RecordBatch:
    row = {"width": width, "ids": [i for i, _ in own], "values": [x for _, v in own for x in v], "place": uuid.uuid4().hex}
    return pa.RecordBatch.from_pylist([row], schema=schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` highest inner products of each query with other rows.

    ``vectors`` and ``queries``: vec_id long, v array of long.  A query's own id
    is no candidate, whichever row holds it; vectors of other widths are none
    either.  Ties go to the smaller vec_id.  With fewer candidates, all are
    returned.  Each row of ``queries`` is a query: an id that occurs twice among
    them has two rankings.  Scores are exact; one that a long cannot hold is
    ranked by its true size and returned as the nearest long.  (Beyond 2^125, in
    vectors with components of 2^59 and more, scores count as equal.)
    """
    shards = packed(vectors, shard, "shard")
    blocks = packed(queries, block, "block")
    count = shards.groupBy("width").agg(F.count("*").alias("shards"))
    # each block meets each shard of its width once; the smaller side, the queries, is what is copied
    spread = blocks.join(count, "width").withColumn("shard", F.explode(F.sequence(F.lit(0), (F.col("shards") - 1).cast("int"))))
    spread = spread.select("width", "shard", "block", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    # shards are few rows of much work: dealt over tasks by number, not by bytes
    n = shards.count()
    dealt = shards.withColumn("shard", F.col("shard").cast("int")).repartition(max(n, min(4 * n, 1024), 1), "width", "shard")
    met = dealt.join(spread, ["width", "shard"])

    schema = pa.schema([(n, pa.int64()) for n in ("query_id", "width", "query_row", "vec_id", "high", "low")])

    def one(batches):
        last, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                width, number, part = (batch.column(c)[i].as_py() for c in ("width", "shard", "block"))
                arrays = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "values", "q_ids", "q_values")]
                if (width, number) != last:
                    last, index = (width, number), Shard(arrays[0], arrays[1].reshape(len(arrays[0]), width))
                found = [index.search(int(q), v, k) for q, v in zip(arrays[2], arrays[3].reshape(len(arrays[2]), width))]
                sizes = [len(f[0]) for f in found]
                high, low = zip(*(limbs(f[1]) for f in found))
                columns = [np.repeat(arrays[2], sizes), np.full(sum(sizes), width), np.repeat(part * block + np.arange(len(found)), sizes)]
                columns += [np.concatenate(c) for c in ([f[0] for f in found], high, low)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    found = met.mapInArrow(one, "query_id bigint, width bigint, query_row bigint, vec_id bigint, high bigint, low bigint")
    # a query row is its width and its place among the blocks of that width
    order = W.partitionBy("width", "query_row").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    fits = F.col("high").isin(-2, -1, 0, 1)
    whole = F.shiftleft("high", LOW_BITS).bitwiseOR(F.col("low"))
    most = F.when(F.col("high") > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))
    return ranked.select("query_id", "rank", "vec_id", F.when(fits, whole).otherwise(most).alias("score"))
