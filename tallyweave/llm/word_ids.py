"""Token ids of whole texts through a table of the white-space separated words met so far.

For a tokenizer that drops white space and never joins across it, a text's ids
are those of its words in turn.  Each distinct word is then encoded once for
many occurrences; a table of ``most`` words or more is emptied before the next texts.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, islice

import numpy as np


class Numbers(dict):
    """A number for each word, in the order in which words are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def side_by_side(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each list begins in the ids of all, its length, and the ids of all."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.cumsum(size) - size, size, np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))


class WordIds:
    def __init__(self, encode_words: Callable, encode_text: Callable, special: tuple[str, ...], most: int = 800_000):
        """``encode_words``: list of words to the arrays of :func:`side_by_side`; ``encode_text``: one text that holds a special string, to ids."""
        self.encode_words, self.encode_text, self.most = encode_words, encode_text, most
        # str.split also parts words at these four, which are ordinary characters to the tokenizers
        self.odd = ("\x1c", "\x1d", "\x1e", "\x1f", *special)
        self.clear()

    def clear(self) -> None:
        self.table, self.used = Numbers(), 0
        self.first, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)

    def _add(self, n: int) -> None:
        """Ids of all words from number ``n`` on."""
        words = list(islice(reversed(self.table), len(self.table) - n))[::-1]
        first, size, flat = self.encode_words(words)
        while n + len(words) > len(self.size):
            self.size, self.first = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.first))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.size[n : n + len(words)] = size
        self.first[n : n + len(words)] = self.used + first
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text."""
        odd = [any(x in t for x in self.odd) for t in texts]
        parts = [[] if o else t.split() for t, o in zip(texts, odd)]
        if len(self.table) >= self.most:
            self.clear()
        known = len(self.table)
        try:
            number = np.fromiter(map(self.table.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
            if len(self.table) > known:
                self._add(known)
        except BaseException:
            self.clear()  # no word stays without its ids
            raise
        size = self.size[number]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.first[number] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        words = np.cumsum([0, *map(len, parts)])
        at = np.concatenate([[0], ends])[words]
        return [np.asarray(self.encode_text(t), np.int32) if o else flat[at[i] : at[i + 1]] for i, (t, o) in enumerate(zip(texts, odd))]
