"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

The n-grams are those of the words themselves and those of their forms (how a
word begins and ends, capitals inside, whether it repeats one of the two words before).
A document's features are the shares of its n-grams, so its score is a sparse
dot product: the mean weight of the n-grams that it has.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_map, slices, with_types
from tallyweave.llm.labelled import held_out, labelled_sample
from tallyweave.llm.words import BASE, mix, owner, runs_of, words_of

SLICE = 1 << 19
BITS = 18
SAMPLE = 8000  # labelled rows to learn from
SCALE = 20.0  # the shares are multiplied by this


def forms(words) -> np.ndarray:
    """A hash of each word's form."""
    n, buffer = len(words.start), words.buffer
    if not n:
        return np.zeros(0, np.uint64)
    kind = np.zeros(256, np.uint64)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 3, 2
    for c in range(33, 128):
        if not kind[c]:
            kind[c] = c
    upper = np.concatenate([[0], np.cumsum((buffer >= 65) & (buffer <= 90))])
    capitals = np.minimum(upper[words.end] - upper[np.minimum(words.start + 1, words.end)], 2).astype(np.uint64)
    same = np.zeros(n, np.uint64)
    text = owner(words.first)
    for back in (2, 1):
        equal = (words.hash[back:] == words.hash[:-back]) & (text[back:] == text[:-back])
        same[back:][equal] = back
    parts = [kind[buffer[words.start]], kind[buffer[words.end - 1]], kind[buffer[np.maximum(words.end - 2, words.start)]], capitals, same]
    out = np.zeros(n, np.uint64)
    for part in parts:
        out = mix(out + part + BASE)
    return out


def grams(texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams, and where each text's begin in each of the four kinds (kinds x (texts + 1))."""
    words = words_of(texts, lower=False)
    form = forms(words)
    found, at, base = [], [], 0
    for k, (hashes, width) in enumerate(((words.hash, 1), (words.hash, 2), (form, 1), (form, 2))):
        runs, first = runs_of(hashes, words.first, width, short=False)
        found.append((mix(runs ^ np.uint64(k << 60)) >> np.uint64(64 - bits)).astype(np.int64))
        at.append(first + base)
        base += len(runs)
    return np.concatenate(found), np.stack(at)


def share_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of the values over each text's n-grams (0 without one)."""
    total = sum(sums_of(values, row) for row in at)
    return total / np.maximum(sum(np.diff(row) for row in at), 1)


def sums_of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def sparse_rows(texts, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    numbers, at = grams(texts, bits)
    out = []
    for i in range(at.shape[1] - 1):
        own = np.concatenate([numbers[row[i] : row[i + 1]] for row in at])
        index, count = np.unique(own, return_counts=True)
        out.append((index, count / max(len(own), 1)))
    return out


def follow_the_leader(rows: list, labels: np.ndarray, bits: int, alpha=0.3, beta=1.0, l1=1e-5, l2=1e-3, rounds=6) -> np.ndarray:
    """Weights and, last, the bias (McMahan et al., 2013).  Rows come in the given order in each round."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(rounds):
        for (index, value), y in zip(rows, labels):
            i = np.append(index, size - 1)
            x = np.append(value * SCALE, 1.0)
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] = zi + g - step * w
            n[i] = ni + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Weights from at most ``sample`` labelled rows that are not held out; their sparse rows reach the driver, not their texts."""

    def one(batch):
        for part in slices(batch, "text", SLICE):
            rows = sparse_rows(part.column("text"), bits)
            yield {
                "doc_id": part.column("doc_id"),
                "quality": part.column("quality"),
                "index": [r[0].astype(np.int32) for r in rows],
                "share": [r[1].astype(np.float32) for r in rows],
            }

    table = arrow_map(labelled_sample(docs, labels, sample), one, "doc_id bigint, quality int, index array<int>, share array<float>").toArrow()
    rows, quality, order = [], [], []
    for batch in table.to_batches():
        index, share = batch.column("index"), batch.column("share")
        at, i, x = index.offsets.to_numpy(), index.values.to_numpy(), share.values.to_numpy()
        rows += [(i[a:b], x[a:b]) for a, b in zip(at[:-1], at[1:])]
        quality += batch.column("quality").to_pylist()
        order += mix(batch.column("doc_id").to_numpy().view(np.uint64)).tolist()
    # repeated rows of one id: by their features
    order = sorted(range(len(rows)), key=lambda k: (order[k], rows[k][0].tobytes()))
    rows, got = [rows[k] for k in order], {"quality": quality}
    return follow_the_leader(rows, np.array([got["quality"][i] for i in order], float), bits)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null and empty texts get the bias alone; without labels every score is one
    half.  A null id counts as held out.  Only the text is an input of a score.
    """
    docs = with_types(docs, doc_id="bigint", text="string")
    weights = train(docs, labels, sample, bits)

    def one(batch):
        for part in slices(batch, "text", SLICE):
            numbers, at = grams(part.column("text"), bits)
            raw = weights[-1] + SCALE * share_sums(weights[numbers], at)
            yield {"doc_id": part.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(raw, -35, 35)))}

    scored = arrow_map(docs, one, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
