"""Near duplicates by circulant MinHash, banding, and exact Jaccard verification.

Circulant MinHash needs two permutations of the hash values only.  The first
scatters the shingles; the second, shifted by one place further for each
coordinate, ranks them, and a coordinate is the least rank in the document
(Li and Li, 2022).  Here both are bijections of the 64-bit numbers and the shift
is taken modulo 2**64.

Steps, none of which holds a group of copies in one task:

1. One pass over the texts gives each document the number of its distinct
   shingles, a 128-bit digest of the set and the band keys.  Documents with
   equal digests are one node; those that share a bucket get a sketch (one bit of
   each of 1024 coordinates of the same two permutations).
2. Each node is compared with one node only, the centre that it shares most
   buckets with, and the links found are closed to components.
3. Buckets that still hold several components are gone through in full: each
   node outside the bucket's largest component meets all nodes of other
   components.  Pairs within a component need no test any more, so a large group
   of copies costs no square of its size, and every pair of different components
   that met in any band has been tested.  A bucket's sets are cut into blocks of
   bounded size; a task holds two blocks at a time, compares each pair in the first
   band that it shares, and only links that join components leave it.

Pairs are dropped before the exact test only where the sizes of the sets rule a
link out, or the sketches differ in more coordinates than a pair at the threshold
does but once in 10**8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_map, arrow_stream, is_empty, slices, stored, with_types
from tallyweave.llm.components import components
from tallyweave.llm.words import BASE, MIX_A, MIX_B, mix, runs_of, signed, words_of

SLICE = 1 << 18
SKETCH = tuple(f"sketch_{k}" for k in range(16))  # one bit of each of 64 * 16 coordinates
BLOCK = 1 << 19  # shingles (on average) of each of the two blocks that a task compares
ROWS = 1 << 10  # sets (on average) of each of them
ROUND = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, lower-cased in A-Z."""
    words = words_of(texts, lower=True)
    runs, at = runs_of(words.hash, words.first, width, short=True)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        one = np.sort(runs[a:b])
        if len(one) > 1:
            one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        out.append(one)
    return out


def circulant_signature(flat: np.ndarray, first: np.ndarray, coordinates: int) -> Iterator[np.ndarray]:
    """For each coordinate, the least rank in each (non-empty) set under its shift of the second permutation."""
    scattered = mix(flat + BASE) * MIX_A  # first permutation; the product starts the second
    rank, high = np.empty_like(scattered), np.empty_like(scattered)
    for k in range(coordinates):
        np.subtract(scattered, np.uint64(k * int(MIX_A) & (1 << 64) - 1), out=rank)  # shift by k places, before the product
        np.right_shift(rank, np.uint64(32), out=high)
        np.bitwise_xor(rank, high, out=rank)
        np.multiply(rank, ROUND, out=rank)
        yield np.minimum.reduceat(rank, first)


def sketches(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of 64 coordinates' bits for each name of SKETCH, one column a set."""
    out = np.zeros((len(SKETCH), len(first)), np.uint64)
    for k, low in enumerate(circulant_signature(flat, first, 64 * len(SKETCH))):
        out[k // 64] |= ((low >> np.uint64(17)) & np.uint64(1)) << np.uint64(k % 64)
    return out


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (two longs), keys (one long a band) of each row of ``docs``."""

    def one(batch):
        for part in slices(batch, "text", SLICE):
            sets = shingle_sets(part.column("text"), width)
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            keys = [None] * len(sets)
            digest = np.zeros((2, len(sets)), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                first = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                digest[0, full] = mix(np.add.reduceat(mix(flat ^ MIX_B), first) + size[full].astype(np.uint64))
                digest[1, full] = mix(np.add.reduceat(mix(flat + MIX_A) * ROUND, first))
                low = np.stack(list(circulant_signature(flat, first, bands * rows)))
                joined = np.zeros((bands, len(full)), np.uint64)
                for r in range(rows):
                    joined = mix(joined + low[r::rows] + BASE)
                joined = mix(joined + np.arange(1, bands + 1, dtype=np.uint64)[:, None] * BASE)
                for i, column in zip(full, signed(np.ascontiguousarray(joined.T))):
                    keys[i] = column
            yield {
                "doc_id": part.column("doc_id"),
                "n_shingles": size,
                "set_a": signed(digest[0]),
                "set_b": signed(digest[1]),
                "keys": keys,
            }

    return arrow_map(docs, one, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, keys array<bigint>")


def most_different(threshold: float, coordinates: int, odds: float = 1e-8) -> int:
    """In more coordinates' bits than this, a pair at the threshold differs only at these odds."""
    p, tail = (1 - threshold) / 2, 0.0
    if p <= 0:
        return 0
    for n in range(coordinates, -1, -1):
        ways = math.lgamma(coordinates + 1) - math.lgamma(n + 1) - math.lgamma(coordinates - n + 1)
        tail += math.exp(ways + n * math.log(p) + (coordinates - n) * math.log(1 - p))
        if tail > odds:
            return n
    return 0


def _lists(column) -> list[np.ndarray]:
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))

    def one(batch):
        good = np.array([_linked(x, y, percent) for x, y in zip(*(_lists(batch.column(c)) for c in ("left", "right")))], bool)
        yield {"a": batch.column("a").filter(good), "b": batch.column("b").filter(good)}

    return arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right"), one, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, block: int = BLOCK, most_rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text; further columns are not read).

    A document's set are its distinct ``width``-word shingles; fewer words are
    one shingle; without a word (or with null text) it is empty and linked with
    nothing.  Documents are linked if 100 * intersection >= ``percent`` * union.
    ``component_id`` is the smallest doc_id reachable, a null one counting as
    larger than all; ``kept`` says that the row has this doc_id.  Rows that
    repeat a doc_id are documents of their own: equal texts fall together
    anyhow, and then each of the equal rows is kept.

    32 bands of 4 coordinates miss a pair at similarity 0.8 once in 2 * 10**7.
    ``block`` and ``most_rows``, the shingles and sets of each of the two blocks that a cell compares, have no effect on the rows.
    """
    docs = with_types(docs, doc_id="bigint", text="string")
    marked = signatures(docs, width, bands, rows).withColumn("row", F.monotonically_increasing_id())
    marked = stored(marked, "signatures")
    classes = marked.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"))
    classes = stored(classes, "classes")
    nodes = stored(marked.join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node"), "nodes")

    placed = nodes.select("node", F.explode("keys").alias("key"))
    # a bucket's centre is one of its nodes, another one in each bucket
    centre = F.min_by("node", F.xxhash64("node", "key")).alias("centre")
    met = placed.groupBy("key").agg(F.count("*").alias("n"), centre).filter("n > 1")
    met = stored(met.select("key", "centre"), "shared-buckets")  # a stored side lets the planner split a hot bucket's join
    placed = stored(placed.join(met, "key"), "buckets")

    involved = placed.select("node").distinct().join(nodes.select("node", "doc_id", "set_a", "set_b"), "node")
    sets = stored(_sets_of(docs, involved, width), "sets")
    if not is_empty(sets.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")):
        sets = stored(sets.dropDuplicates(["node"]), "sets")  # equal rows that share a doc_id
    facts = sets.select("node", F.size("shingles").cast("long").alias("n_shingles"), *SKETCH)
    apart = most_different(percent / 100, 64 * len(SKETCH))

    # each node meets the possible centre that it shares most buckets with
    stars = placed.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    stars = _possible(stars.groupBy("a", "b").agg(F.count("*").alias("n_bands")), facts, percent, apart)
    stars = stars.groupBy("a").agg(F.max_by("b", F.struct("n_bands", -F.col("b"))).alias("b"))
    links = stored(confirmed(stars, sets, percent), "star-links")
    found = stored(components(links), "components")

    more = stored(_cross_links(_mixed(placed, found), sets, nodes, percent, apart, block, most_rows), "cross-links")
    if not is_empty(more):
        found = stored(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")

    member = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = member.join(least, "component").select("set_a", "set_b", "component_id")
    rows_out = marked.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_a")).alias("set_a"), "set_b")
    joined = rows_out.join(ids, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _cross_links(mixed: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int, apart: int, block: int, most_rows: int) -> DataFrame:
    """Links (a, b) that join the components of each bucket: all pairs of different components are tested or joined already.

    A bucket's nodes outside its largest component (``outer``) and all its nodes
    are cut into blocks by their shingles and rows; each pair of blocks is a cell.
    A cell joins the components that it finds linked, so it tests no pair of a component that it has joined.
    """
    outer = F.col("component") != F.col("main")
    load = mixed.join(sets.select("node", F.size("shingles").cast("long").alias("n")), "node").groupBy("key")
    load = load.agg(
        F.sum(F.when(outer, F.col("n"))).alias("outer"), F.sum("n").alias("all"), F.sum(outer.cast("long")).alias("outer_rows"), F.count("*").alias("all_rows")
    )
    parts = lambda c: F.ceil(F.greatest(F.col(c) / block, F.col(f"{c}_rows") / most_rows)).cast("int")
    cut = load.select("key", *[parts(c).alias(f"n_{c}") for c in ("outer", "all")])

    place = lambda blocks: F.pmod(F.xxhash64("node", "key"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    rows = mixed.join(cut, "key")
    rest = ("node", "component", outer.alias("outer"))
    held_rows = rows.select("key", every("n_outer").alias("i"), place("n_all").alias("j"), F.lit(0).alias("role"), *rest)
    asking_rows = rows.filter(outer).select("key", place("n_outer").alias("i"), every("n_all").alias("j"), F.lit(1).alias("role"), *rest)
    facts = sets.join(nodes.select("node", "keys"), "node").select("node", "keys", F.array(*SKETCH).alias("sketch"), "shingles")
    cells = held_rows.union(asking_rows).join(facts, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")

    def compare(batches):
        cell, held, top = None, [], {}

        def root(c):
            while top.get(c, c) != c:
                top[c] = top.get(top[c], top[c])
                c = top[c]
            return c

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, role, node, component = (batch.column(c).to_numpy() for c in ("key", "i", "j", "role", "node", "component"))
            shingles, a, b = _lists(batch.column("shingles")), [], []
            size = np.array([len(s) for s in shingles], np.int64)
            keys, sketch = (np.array(_lists(batch.column(c))).view(np.uint64) for c in ("keys", "sketch"))
            outside = batch.column("outer").to_numpy(zero_copy_only=False)
            place = np.stack([key, i, j, role])
            starts = np.concatenate([[0], np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1, [len(node)]])
            for low, high in zip(starts[:-1], starts[1:]):
                if cell != (at := (key[low], i[low], j[low])):
                    cell, held, top = at, [], {}
                if role[low] == 0:
                    held.append((node[low:high], component[low:high], outside[low:high], size[low:high], keys[low:high], sketch[low:high], shingles[low:high]))
                    continue
                if not held:  # no node's place is in this block of the bucket
                    continue
                if len(held) > 1:
                    held = [tuple(sum(part, []) if isinstance(part[0], list) else np.concatenate(part) for part in zip(*held))]
                ids, groups, ask_too, sizes, their_keys, their_sketch, their_sets = held[0]
                band = np.flatnonzero(keys[low].view(np.int64) == cell[0])[0]
                joined = np.fromiter((root(int(g)) for g in groups), np.int64, len(groups))
                for x in range(low, high):
                    own = root(int(component[x]))
                    fits = 100 * np.minimum(sizes, size[x]) >= percent * np.maximum(sizes, size[x])
                    fits &= (joined != own) & (~ask_too | (ids > node[x]))
                    maybe = np.flatnonzero(fits)
                    maybe = maybe[np.bitwise_count(their_sketch[maybe] ^ sketch[x]).sum(axis=1) <= apart]
                    maybe = maybe[(their_keys[maybe] == keys[x]).argmax(axis=1) == band]
                    while len(maybe):
                        y, maybe = maybe[0], maybe[1:]
                        if _linked(shingles[x], their_sets[y], percent):
                            top[int(joined[y])] = own
                            joined[joined == joined[y]] = own
                            maybe = maybe[joined[maybe] != own]
                            a.append(min(node[x], ids[y]))
                            b.append(max(node[x], ids[y]))
            yield {"a": a, "b": b}

    return arrow_stream(cells, compare, "a bigint, b bigint").distinct()


def _fits(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _differing(x: str, y: str):
    """Number of coordinates whose bits differ."""
    total = F.lit(0)
    for name in SKETCH:
        total = total + F.bit_count(F.col(f"{x}.{name}").bitwiseXOR(F.col(f"{y}.{name}")))
    return total


def _mixed(placed: DataFrame, found: DataFrame) -> DataFrame:
    """key, node, component, main (the bucket's largest component) of the buckets that hold several components."""
    known = placed.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    shares = known.groupBy("key", "component").agg(F.count("*").alias("n"))
    several = shares.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"))
    several = stored(several.filter("parts > 1").select("key", "main"), "mixed-keys")
    return stored(known.join(several, "key"), "mixed-buckets")


def _possible(pairs: DataFrame, facts: DataFrame, percent: int, apart: int) -> DataFrame:
    x = facts.select(F.col("node").alias("a"), F.struct("n_shingles", *SKETCH).alias("x"))
    y = facts.select(F.col("node").alias("b"), F.struct("n_shingles", *SKETCH).alias("y"))
    good = _fits(F.col("x.n_shingles"), F.col("y.n_shingles"), percent) & (_differing("x", "y") <= apart)
    return pairs.join(x, "a").join(y, "b").filter(good).drop("x", "y")


def _sets_of(docs: DataFrame, involved: DataFrame, width: int) -> DataFrame:
    """node, shingles and sketch of the involved nodes, from the texts of the documents that stand for them (equal rows repeat a node)."""
    wanted = involved.withColumnRenamed("doc_id", "id")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "set_a", "set_b", "text")

    def one(batch):
        for part in slices(batch, "text", SLICE):
            sets = shingle_sets(part.column("text"), width)
            size = np.array([len(s) for s in sets], np.int64)
            sums = np.zeros((2, len(sets)), np.uint64)
            for i, s in enumerate(sets):
                if len(s):
                    sums[0, i] = mix(np.array([mix(s ^ MIX_B).sum(dtype=np.uint64)]) + np.uint64(size[i]))[0]
                    sums[1, i] = mix(np.array([(mix(s + MIX_A) * ROUND).sum(dtype=np.uint64)]))[0]
            # rows that share a doc_id may have other texts: the digest picks the right ones
            right = (signed(sums[0]) == part.column("set_a").to_numpy()) & (signed(sums[1]) == part.column("set_b").to_numpy())
            own = [s for s, good in zip(sets, right) if good]
            if not own:
                continue
            flat = np.concatenate(own)
            bits = sketches(flat, np.cumsum([0] + [len(s) for s in own])[:-1])
            yield {"node": part.column("node").filter(right), "shingles": [signed(s) for s in own]} | {n: signed(b) for n, b in zip(SKETCH, bits)}

    parts = "".join(f", {name} bigint" for name in SKETCH)
    return arrow_map(texts, one, f"node bigint, shingles array<bigint>{parts}")
