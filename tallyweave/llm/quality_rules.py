"""Quality rules: statistics of whole texts, fixed rules, and an isolation forest on the statistics.

The forest (Liu, Ting and Zhou, 2008) splits a few hundred rows at random
features and places; a row that random splits soon separate from the others has a short
path and is an anomaly.  Trees are grown from rows labelled good, with splits
drawn over the range of all labelled rows, and the score from which a document
is rejected is calibrated by the labels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_map, slices, stored, with_types
from tallyweave.llm.labelled import labelled
from tallyweave.llm.words import BASE, byte_class, byte_hash, mix, owner, repeats, runs_of, sums, words_of

SLICE = 1 << 19
SYMBOLS = b"#*$%&|<>"
SAMPLE = 8000  # labelled rows that the forest is grown from
BINS = 1 << 16  # equal bins of scores in which labelled rows are counted for the threshold
NOTHING = 2.0  # a threshold above all scores
TREES, TREE_ROWS, SEED = 100, 256, 7
GOOD_COST = 3.0  # a rejected row labelled good weighs as much as so many kept rows labelled bad

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_ends")


def statistics(texts) -> dict[str, np.ndarray]:
    """The counts of each text; a null or empty text has zeros."""
    words = words_of(texts)
    buffer, at, n = words.buffer, words.at, len(words.at) - 1
    count = np.diff(words.first)
    text = owner(words.first)
    salt = np.arange(n, dtype=np.uint64) * BASE

    in_word = np.zeros(len(buffer) + 1, np.int8)
    in_word[words.start] += 1
    np.add.at(in_word, words.end, -1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    points = in_word & ((buffer & 0xC0) != 0x80)

    breaks = np.flatnonzero(buffer == 10)
    line_start = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], breaks + 1]))
    line_start = line_start[line_start < len(buffer)]
    line_end = np.concatenate([line_start[1:], [len(buffer)]])[: len(line_start)]
    closed = buffer[line_end - 1] == 10
    line_end = line_end - closed
    filled = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    line_start, line_end = line_start[filled], line_end[filled]
    line_text = np.searchsorted(at, line_start, "right") - 1
    _, dup_line = repeats(mix(byte_hash(buffer, line_start, line_end) + salt[line_text]))

    runs, run_at = runs_of(words.hash, words.first, 3, short=False)
    run_text = owner(run_at)
    many, _ = repeats(mix(runs + salt[run_text]))
    place = words.first[run_text] + np.arange(len(runs)) - run_at[run_text]
    covered = np.zeros(len(words.start) + 3, bool)
    for k in range(3):
        covered[place[many] + k] = True
    _, seen = repeats(mix(words.hash + salt[text]))

    upper = (buffer >= 65) & (buffer <= 90)
    letters = upper | ((buffer >= 97) & (buffer <= 122)) | (buffer >= 192)
    last = buffer[words.end - 1] if len(words.end) else buffer[:0]
    return {
        "n_words": count,
        "word_chars": sums(points, at),
        "n_symbols": sums(byte_class(SYMBOLS)[buffer], at),
        "n_dup_lines": np.bincount(line_text[dup_line], minlength=n),
        "n_repeat_words": sums(covered[: len(words.start)], words.first),
        "n_lines": np.bincount(line_text, minlength=n),
        "n_distinct": count - sums(seen, words.first),
        "n_upper": sums(upper, at),
        "n_letters": sums(letters, at),
        "n_ends": sums(byte_class(b"!?;:$#*%&|")[last], words.first),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of ratios that do not depend on a text's length, but for the last."""
    words, lines, letters = (np.maximum(s[k], 1).astype(float) for k in ("n_words", "n_lines", "n_letters"))
    return np.stack(
        [
            s["word_chars"] / words,
            np.minimum(s["n_symbols"] / words, 4),
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words,
            s["n_upper"] / letters,
            s["n_ends"] / words,
            # distinct words against what a text of this length usually has
            np.minimum(s["n_distinct"] / words**0.85, 1.5),
        ],
        axis=1,
    )


def path_normal(n) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator, depth: int) -> dict[str, np.ndarray]:
    """One tree as arrays: feature (-1: leaf), split, children, path length at a leaf.

    Splits are drawn over the box from ``low`` to ``high``, which may be wider
    than the rows: what lies where no row is ends in an empty leaf, early.
    """
    feature, split, left, right, length = [], [], [], [], []

    def node(part: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> int:
        me = len(feature)
        for column in (feature, split, left, right, length):
            column.append(0)
        usable = np.flatnonzero(high > low)
        if level >= depth or len(part) <= 1 or not len(usable):
            feature[me], left[me], right[me], length[me] = -1, me, me, level + path_normal(len(part))
            return me
        f = int(rng.choice(usable))
        s = rng.uniform(low[f], high[f])
        side = part[:, f] < s
        below, above = high.copy(), low.copy()
        below[f], above[f] = s, s
        feature[me], split[me] = f, s
        left[me] = node(part[side], low, below, level + 1)
        right[me] = node(part[~side], above, high, level + 1)
        return me

    node(rows, low, high, 0)
    return {"feature": np.array(feature), "split": np.array(split, float), "left": np.array(left), "right": np.array(right), "length": np.array(length, float)}


def fit_forest(rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> list[dict]:
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(rows))
    depth = int(np.ceil(np.log2(max(size, 2)))) + 6
    return [grow(rows[rng.choice(len(rows), size, replace=False)], low, high, rng, depth) for _ in range(trees)] if size else []


def anomaly(forest: list[dict], rows: np.ndarray, tree_rows: int = TREE_ROWS) -> np.ndarray:
    """0 to 1, higher for shorter mean paths; 0 without a forest."""
    if not forest or not len(rows):
        return np.zeros(len(rows))
    total = np.zeros(len(rows))
    for tree in forest:
        at = np.zeros(len(rows), np.int64)
        while True:
            f = tree["feature"][at]
            moving = np.flatnonzero(f >= 0)
            if not len(moving):
                break
            here = at[moving]
            less = rows[moving, f[moving]] < tree["split"][here]
            at[moving] = np.where(less, tree["left"][here], tree["right"][here])
        total += tree["length"][at]
    return 2.0 ** (-total / len(forest) / max(path_normal(tree_rows), 1))


def cut(bad: np.ndarray, good: np.ndarray, good_cost: float = GOOD_COST) -> float:
    """The score from which to reject: the middle of the gap where the labels speak least against it.

    ``bad`` and ``good``: how many rows of each label have a score in each of
    equal bins from 0 to 1.  A row labelled good that is rejected costs
    ``good_cost`` rows labelled bad that are kept.  Without rows of both labels
    nothing is rejected.
    """
    if not bad.sum() or not good.sum():
        return NOTHING
    bins = len(bad)
    used = np.flatnonzero(bad + good)
    cost = np.concatenate([[0], np.cumsum(bad[used])]) + good_cost * (good.sum() - np.concatenate([[0], np.cumsum(good[used])]))
    k = int(np.argmin(cost))  # bins of which all rows stay
    if k == len(used):
        return NOTHING if used[-1] == bins - 1 else float((used[-1] + 1 + bins) / 2 / bins)
    return float(((used[k - 1] + 1 if k else 0) + used[k]) / 2 / bins)


def bin_of(scores: np.ndarray, bins: int = BINS) -> np.ndarray:
    return np.minimum((scores * bins).astype(np.int64), bins - 1)


def threshold(scores: np.ndarray, quality: np.ndarray, good_cost: float = GOOD_COST) -> float:
    """:func:`cut` of rows in memory."""
    place = bin_of(scores)
    return cut(*[np.bincount(place[quality == q], minlength=BINS) for q in (0, 1)], good_cost)


def model_of(counted: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[dict], float]:
    """Forest from at most ``sample`` labelled rows, threshold from all labelled rows that are not held out.

    ``counted``: doc_id and the counts.  Labels meet counts, never texts; to the
    driver come the sample's counts and the rows of each label in each of a
    fixed number of bins.  Of rows that share an id one, the least, is taken.
    """
    one_each = labelled(labels).join(counted.select("doc_id", F.struct(*COUNTS).alias("c")), "doc_id")
    rows = one_each.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("c").alias("c"))
    judged = stored(rows.select("doc_id", "quality", "c.*"), "quality-labels")
    # The least hashes, cut off near the last one wanted first, so that not every task hands on a whole sample.
    share = min(1.0, 1.5 * sample / max(judged.count(), 1) + 1e-12)
    low = judged.filter(F.xxhash64("doc_id") <= F.lit(min(int(-(2**63) + share * 2**64), 2**63 - 1)))
    table = low.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas().sort_values("doc_id")
    if not len(table):
        return [], NOTHING
    counts = {c: table[c].to_numpy() for c in COUNTS}
    seen = features(counts)
    # What the fixed rules reject anyhow says nothing about the threshold of the rest.
    usual = seen[~base_rules(counts) & (table["quality"].to_numpy() == 1)]
    forest = fit_forest(usual, seen.min(0), seen.max(0))
    if not forest:
        return [], NOTHING

    def one(batch):
        counts = {c: batch.column(c).to_numpy() for c in COUNTS}
        passed = ~base_rules(counts)
        place = bin_of(anomaly(forest, features(counts))[passed])
        marks, n = np.unique(place * 2 + batch.column("quality").to_numpy()[passed], return_counts=True)
        yield {"bin": marks // 2, "quality": marks % 2, "n": n}

    found = arrow_map(judged, one, "bin bigint, quality bigint, n bigint").groupBy("bin", "quality").agg(F.sum("n").alias("n")).toPandas()
    bad, good = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for label, count in ((0, bad), (1, good)):
        own = found[found["quality"] == label]
        count[own["bin"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
    return forest, cut(bad, good)


def base_rules(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, carry: dict[str, str] | None = None) -> DataFrame:
    """The counts, base_failed, anomaly and kept of every row of ``docs`` (doc_id, text and the columns of ``carry``).

    Null and empty texts have zero words and fail; without labels only the fixed
    rules reject.  Repeated rows are judged alike.  The counts of all texts are
    stored with the carried columns, the model is made of the counts, and the
    rows are judged by them: no text is shuffled or counted twice.
    """
    carry = carry or {}
    docs = with_types(docs, **({"doc_id": "bigint", "text": "string"} | carry))
    names = ["doc_id", *carry]

    def count(batch):
        for part in slices(batch, "text", SLICE):
            yield {n: part.column(n) for n in names} | statistics(part.column("text"))

    schema = "doc_id bigint" + "".join(f", {n} {k}" for n, k in carry.items()) + "".join(f", {c} bigint" for c in COUNTS)
    counted = stored(arrow_map(docs, count, schema), "quality-counts")
    forest, least = model_of(counted.select("doc_id", *COUNTS), labels, sample)

    def judge(batch):
        counts = {c: batch.column(c).to_numpy() for c in COUNTS}
        failed = base_rules(counts)
        score = anomaly(forest, features(counts))
        yield {n: batch.column(n) for n in names} | counts | {"base_failed": failed, "anomaly": score, "kept": ~failed & (score < least)}

    return arrow_map(counted, judge, f"{schema}, base_failed boolean, anomaly double, kept boolean")
