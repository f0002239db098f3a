"""Words and their hashes, for whole Arrow string columns at a time.

A word is a longest run of bytes other than blank, tab, line feed, vertical
tab, form feed and carriage return, which in UTF-8 is the same as a longest run
of such characters.  A word's hash is the difference of two running sums over
the bytes, brought to a common place and mixed, so numpy computes the hashes of
all words of many texts in a few passes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tallyweave.llm.common import text_offsets, worker_store

BLOCK = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit numbers (new array)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    buffer: np.ndarray  # bytes of all texts
    at: np.ndarray  # offsets of the texts in it
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # index of each text's first word, and the number of words
    hash: np.ndarray | None  # uint64 of each word


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = text_offsets(texts)
    data = texts.buffers()[2]
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buffer[at[0] : at[-1]], at - at[0]


def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
    if lower:
        values[65:91] = values[97:123]
    return values


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2**64."""
    kept = worker_store()
    if "powers" not in kept or len(kept["powers"][0]) < n:
        n = max(n, BLOCK + (1 << 16))
        base = np.full(n, BASE, np.uint64)
        base[0] = 1
        back = np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
        back[0] = 1
        kept["powers"] = np.cumprod(base), np.cumprod(back)
    return kept["powers"]


def range_hash(values, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges whose starts and ends both ascend, in blocks of bounded length (a longer range makes its block longer).

    ``values(low, high)`` gives the 64-bit values of the places from low to high.
    """
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        low, high = int(start[i]), int(end[j - 1])
        up, down = powers(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values(low, high) * up[: high - low], out=total[1:])
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def byte_hash(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    values = byte_values(lower)
    return range_hash(lambda low, high: values[buffer[low:high]], start, end)


def words_of(texts: pa.Array, lower: bool = False, hashed: bool = True) -> Words:
    """``lower``: letters A-Z count as a-z in the hashes."""
    buffer, at = text_bytes(texts)
    word = (buffer != 32) & ((buffer < 9) | (buffer > 13))
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    inner = at[:-1][(np.diff(at) > 0)]
    begins[inner] = word[inner]
    last = inner[1:] - 1
    ends[last] = word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(buffer, at, start, end, np.searchsorted(start, at), byte_hash(buffer, start, end, lower) if hashed else None)


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each word (or other part) from the texts' first parts."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


PLACES = mix(np.arange(101, 133, dtype=np.uint64) * BASE) | np.uint64(1)


def runs_of(hashes: np.ndarray, first: np.ndarray, width: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` consecutive words of a text, and each text's first run (with the number of runs).

    ``short``: a text with fewer words (but at least one) has its whole sequence as one run.
    """
    count = np.diff(first)
    made = np.maximum(count - width + 1, ((count > 0) & short).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    text = np.repeat(np.arange(len(count)), made)
    place = first[text] + np.arange(len(text)) - at[text]
    size = np.minimum(width, count[text])
    out = size.astype(np.uint64) * PLACES[31]
    for k in range(width):
        inside = size > k
        if inside.all():
            out += hashes[place + k] * PLACES[k]
        else:
            out[inside] += hashes[place[inside] + k] * PLACES[k]
    return mix(out), at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the flags between consecutive places."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more, and is it equal to an earlier one?"""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later
