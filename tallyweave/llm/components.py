"""Connected components of a link table, by alternating star steps (Kiveris et al., 2014).

Every step groups links by node with partial aggregation and never holds the
neighbours of a node in one place, so a node may have any number of links.
Before links leave a task, the task joins them in a union-find of its own and
passes on one link a node, from it to the least node it is joined with.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_stream, stored

HELD = 1 << 21  # links that a task joins at a time


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the least of its component, and that least node."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    top = np.arange(len(nodes))
    while True:
        low, high = np.minimum(top[left], top[right]), np.maximum(top[left], top[right])
        open_ = low != high
        if not open_.any():
            break
        left, right = left[open_], right[open_]
        np.minimum.at(top, high[open_], low[open_])
        while True:  # shorten all chains
            further = top[top]
            if (further == top).all():
                break
            top = further
    moved = top != np.arange(len(nodes))
    return nodes[moved], nodes[top[moved]]


def shrunk(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components as the given ones: at most one a node and run of links of a task, from larger to smaller."""

    def one(batches):
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
            n += batch.num_rows
            if n >= HELD:
                a, b = least_reachable(*(np.concatenate(part) for part in zip(*held)))
                held, n = [], 0
                yield {"a": a, "b": b}
        if held:
            a, b = least_reachable(*(np.concatenate(part) for part in zip(*held)))
            yield {"a": a, "b": b}

    return arrow_stream(links.select("a", "b"), one, "a bigint, b bigint")


def _large_star(links: DataFrame) -> tuple[DataFrame, F.Column]:
    """Links from every larger neighbour of a node to its least one, and which of them are new."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(least, "a").filter("b > a"), F.col("low") < F.col("a")


def _small_star(links: DataFrame) -> tuple[DataFrame, F.Column]:
    """Links from a node and its smaller neighbours to the least of these, and which of them are new."""
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    return links.join(least, "a"), F.col("b") != F.col("low")


def _step(joined: DataFrame, changed: F.Column, small: bool) -> tuple[DataFrame, int]:
    """The step's links, shrunk and stored, and how many were new; the count comes with the write."""
    seen = Observation()
    joined = joined.observe(seen, F.sum(changed.cast("long")).alias("changed"))
    if small:
        ends = F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
        made = joined.select(F.inline(F.filter(ends, lambda e: e["a"] != e["b"])))
    else:
        made = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    out = stored(shrunk(made), "links")
    return out, seen.get["changed"] or 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a long, b long): the component is its smallest node.

    Links of a node with itself and repeated links have no effect; rows with a null are left out.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    links = stored(shrunk(links), "links")
    while True:
        links, small = _step(*_small_star(links), True)
        links, large = _step(*_large_star(links), False)
        if not small and not large:
            break
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
