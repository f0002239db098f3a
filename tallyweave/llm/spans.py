"""Substring deduplication on runs of consecutive sentences.

A sentence ends after a word that ends in a full stop, exclamation or question
mark, and at a line break.  It also ends after each word with the least hash
of some ``WINDOW`` consecutive words of the sentence (winnowing; the last of
equal ones), so no sentence is longer, and what is cut inside a passage depends on
the passage alone, but for fewer than ``WINDOW`` words at each of its ends.  So a
passage of more than 50 words, wherever it begins and ends, holds 30 words or more
that are cut alike everywhere.  A span is the shortest run of
two or more consecutive sentences with enough words that begins with a sentence,
or that ends with it: together they cover each sentence of any longer run that
repeats.  Span hashes meet once over all documents; of each span the first place
stays, and the sentences of all later places go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_map, slices, stored, with_types
from tallyweave.llm.words import byte_class, range_hash, signed, sums, words_of

SLICE = 1 << 19
WINDOW = 11  # a passage of n words keeps n + 1 - 2 * WINDOW of them between its first and last common end


def sentences(texts) -> tuple:
    """The words, the first word of each sentence (and their number), and each text's first sentence."""
    words = words_of(texts, lower=True)
    n = len(words.start)
    ends = np.zeros(n, bool)
    if n:
        ends |= byte_class(b".!?")[words.buffer[words.end - 1]]
        breaks = np.flatnonzero(words.buffer == 10)
        ends[:-1] |= np.searchsorted(breaks, words.start[1:]) > np.searchsorted(breaks, words.end[:-1])
        ends[words.first[1:][np.diff(words.first) > 0] - 1] = True
        ends |= least_of_windows(words.hash, ends)
    first = np.concatenate([[0], np.flatnonzero(ends) + 1])
    return words, first, np.searchsorted(first, words.first)


def least_of_windows(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Is the word the last one with the least hash of some ``WINDOW`` consecutive words of its sentence?"""
    n = len(hashes)
    sentence = np.cumsum(ends) - ends
    around = np.ones(n, np.int64)  # length of the longest run of the sentence in which the word is that one
    for left in (True, False):
        alive = np.ones(n, bool)
        for k in range(1, min(WINDOW, n)):
            here, there = (slice(k, n), slice(0, n - k)) if left else (slice(0, n - k), slice(k, n))
            alive[here] &= sentence[here] == sentence[there]
            alive[here] &= hashes[here] <= hashes[there] if left else hashes[here] < hashes[there]
            alive[slice(0, k) if left else slice(n - k, n)] = False
            around += alive
    return around >= WINDOW


def spans(texts, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first sentence in its text, number of sentences and hash of every span; a run is one span, also if it is shortest from both sides."""
    words, first, at = sentences(texts)
    n = len(first) - 1
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    each = np.arange(n)
    end = np.maximum(np.searchsorted(first, first[:-1] + least_words), each + 2)  # sentence after the run from each one
    start = np.minimum(np.searchsorted(first, first[1:] - least_words, "right") - 1, each - 1)  # of the run up to each one
    from_it = end <= at[text + 1] if n else np.zeros(0, bool)
    up_to_it = start >= at[text] if n else np.zeros(0, bool)
    up_to_it[up_to_it] = end[start[up_to_it]] != each[up_to_it] + 1
    made = []
    for a, b in ((each[from_it], end[from_it]), (start[up_to_it], each[up_to_it] + 1)):
        made.append((text[a], a - at[text[a]], b - a, range_hash(lambda low, high: words.hash[low:high], first[a], first[b])))
    return tuple(np.concatenate(part) for part in zip(*made))


def span_rows(docs: DataFrame, least_words: int) -> DataFrame:
    def one(batch):
        for part in slices(batch, "text", SLICE):
            text, start, size, hashes = spans(part.column("text"), least_words)
            yield {"doc_id": part.column("doc_id").take(text), "version": part.column("version").take(text), "start": start, "size": size, "span": signed(hashes)}

    return arrow_map(docs, one, "doc_id bigint, version bigint, start bigint, size bigint, span bigint")


def remove_repeated_spans(docs: DataFrame, least_words: int = 30, carry: dict[str, str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its text less repeated sentences, n_sentences, n_removed, words_removed.

    The first place of a span is that of the smallest (doc_id, text hash,
    sentence), a null doc_id after all others.  Rows that agree in doc_id and
    text are one document and end up alike.  Null and empty texts stay as they
    are.  A span's 64-bit hash stands for its words (lower-cased in A-Z).
    """
    carry = carry or {}
    docs = with_types(docs, doc_id="bigint", text="string", **carry).withColumn("version", F.xxhash64("text"))
    one_each = docs.select("doc_id", "text", "version")
    # counted on hashes alone; the places are read anew for those that repeat
    counted = arrow_map(one_each, _hashes_only(least_words), "span bigint").groupBy("span").agg(F.count("*").alias("n"))
    again = stored(counted.filter("n > 1").select("span"), "repeated-spans")
    places = stored(span_rows(one_each, least_words).join(again, "span"), "span-places")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version", "start").alias("place")
    firsts = stored(places.select("span", place).groupBy("span").agg(F.min("place").alias("first")), "first-places")
    later = places.withColumn("place", place).join(firsts, "span").filter("place <> first")
    gone = later.select(F.col("doc_id").alias("id"), F.col("version").alias("v"), "start", "size").distinct()
    gone = gone.groupBy("id", "v").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    gone = stored(gone, "covered-sentences")
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("v")), "left")
    columns = ["doc_id", *carry]

    def rebuild(batch):
        for part in slices(batch, "text", SLICE):
            words, first, at = sentences(part.column("text"))
            starts, sizes = part.column("starts").to_pylist(), part.column("sizes").to_pylist()
            lost = np.zeros(len(first), bool)
            for i, (own, size) in enumerate(zip(starts, sizes)):
                for a, s in zip(own or (), size or ()):
                    lost[at[i] + a : at[i] + a + s] = True
            n_words = np.diff(first)
            texts = part.column("text").to_pylist()
            for i in np.flatnonzero(sums(lost[:-1], at)):
                base, whole = words.at[i], words.buffer[words.at[i] : words.at[i + 1]]
                begins = words.start[first[at[i] : at[i + 1]]] - base
                keep = np.ones(len(whole), bool)
                for a, b, bad in zip(begins, np.append(begins[1:], len(whole)), lost[at[i] : at[i + 1]]):
                    keep[a:b] &= not bad
                texts[i] = whole[keep].tobytes().decode()
            yield {n: part.column(n) for n in columns} | {
                "text": texts,
                "n_sentences": np.diff(at),
                "n_removed": sums(lost[:-1], at),
                "words_removed": sums(np.repeat(lost[:-1], n_words), words.first),
            }

    kept = "".join(f", {n} {k}" for n, k in carry.items())
    return arrow_map(joined.select(*columns, "text", "starts", "sizes"), rebuild, f"doc_id bigint{kept}, text string, n_sentences bigint, n_removed bigint, words_removed bigint")


def _hashes_only(least_words: int):
    def one(batch):
        for part in slices(batch, "text", SLICE):
            yield {"span": signed(spans(part.column("text"), least_words)[3])}

    return one
