"""Which of many phrases stand in which of many texts, as an equi-join.

A phrase can only stand in texts that hold all of its grams.  Its grams are its
substrings of one length, the greatest power of two that it reaches, so each
covers at least half of it.  Each phrase is filed under the one of its grams that
the fewest phrases hold; a text meets, for each of these lengths, the phrases
filed under its own grams, and only these pairs are compared.  Few phrases share
a file, so pairs grow with the texts and not with texts times phrases.

A bitmap of the grams in use, of one size for any dictionary, lets a task drop
nearly all other grams of its texts before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.stage import materialize

Q = 64  # no gram is longer
BITMAP_BITS = 26


def _task_functions(lengths: list[int], bitmap: np.ndarray | None):
    """The functions that run in tasks; made in a function, so that workers need not have this package."""

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def hashes(values: pa.Array, wanted: list[int]):
        """Per wanted length (of powers of two, rising): row and hash of every gram of that many code points."""
        sizes = pc.utf8_length(values).to_numpy()
        points = np.frombuffer("".join(values.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        left = np.cumsum(sizes)[rows] - np.arange(len(rows))  # code points from here to the end of the text
        h, reach = mixed(points.astype(np.uint64) + np.uint64(1)), 1
        for length in wanted:
            while reach < length:
                h = mixed(h[:-reach] * np.uint64(0xD6E8FEB86659FD93) + h[reach:]) if len(h) > reach else h[:0]
                reach *= 2
            whole = np.flatnonzero(left[: len(h)] >= length)
            yield length, rows[whole], mixed(h[whole] + np.uint64(length))

    def emit(batch: pa.RecordBatch, rows: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((found, rows))
        rows, found = rows[order], found[order]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
        gram = pa.array(found[first].view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[first])), gram], [batch.schema.names[0], "gram"])

    def of_phrases(batches):
        for batch in batches:
            sizes = np.minimum(pc.utf8_length(batch.column(0)).to_numpy(), lengths[-1])
            for length, rows, found in hashes(batch.column(0), lengths):
                own = (sizes[rows] >= length) & (sizes[rows] < 2 * length)
                yield emit(batch, rows[own], found[own])

    def of_texts(batches):
        for batch in batches:
            for _, rows, found in hashes(batch.column(0), lengths):
                bit = found >> np.uint64(64 - BITMAP_BITS)
                used = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                yield emit(batch, rows[used], found[used])

    return of_phrases, of_texts


def _bitmap(filed: DataFrame) -> np.ndarray:
    """The grams in use by their first bits: at most 2**20 words reach the driver, however many grams there are."""
    bit = F.shiftrightunsigned("gram", 64 - BITMAP_BITS)
    word = filed.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(gram, {64 - BITMAP_BITS}) & 63))").alias("mask"))
    found = word.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return bitmap.view(np.uint64)


def contained(texts: DataFrame, phrases: DataFrame, q: int = Q) -> DataFrame:
    """Distinct (text, phrase) with the phrase somewhere in the text, and the other columns that ``phrases`` has.

    ``texts``: text; ``phrases``: phrase, of which one row each is kept.  No gram
    is longer than ``q``.  Null and empty texts and phrases meet nothing.
    """
    phrases = materialize(phrases.filter("phrase <> ''").dropDuplicates(["phrase"]), "containment-phrases")
    texts = texts.select("text").filter("text <> ''").distinct()
    power = F.floor(F.log2(F.least(F.length("phrase"), F.lit(q)).cast("double")) + 1e-9)
    lengths = sorted(1 << r[0] for r in phrases.select(power.cast("int")).distinct().collect())  # seven numbers at most
    if not lengths:
        return texts.select("text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in phrases.schema]).limit(0)
    of_phrases, _ = _task_functions(lengths, None)
    asked = phrases.select("phrase").mapInArrow(of_phrases, "phrase string, gram long")
    counts = asked.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram").groupBy("phrase").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    filed = materialize(rarest.join(phrases, "phrase"), "rarest-grams")
    _, of_texts = _task_functions(lengths, _bitmap(filed))
    held = texts.mapInArrow(of_texts, "text string, gram long")
    return held.join(filed, "gram").filter(F.contains("text", F.col("phrase"))).select("text", *phrases.columns)
