"""Byte-pair encoding and decoding with a vocabulary file, by batched merge rounds in numpy.

The symbols of many words lie in one flat array.  A round looks up the pairs of
neighbours by binary search over the sorted keys of all merge rules, finds the lowest
rank of each word, and carries out all of that rank's merges; words without a
further merge leave the array.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame

from tallyweave.llm.common import arrow_map, slices, with_types, worker_store
from tallyweave.llm.word_ids import WordIds, side_by_side

SLICE = 1 << 19
NONE = np.int64(1 << 40)
END = "</w>"
SPACE = regex.compile(r"\s+")

# Fixed values, by the character tables of the tokenizers library (Unicode 16): code points that newer tables call
# letters or numbers and these do not, and capitals whose small letters older tables do not know.
NO_LETTERS = regex.compile(
    "[\U00000558\U0000058b-\U0000058c\U0000088f\U00000c5c\U00000cdc\U0000208f\U0000209d-\U0000209f\U0000a7ce-\U0000a7cf\U0000a7dd"
    "\U0000a7e2\U0000a7f1\U0000ab6c-\U0000ab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    "\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f"
    "\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
    "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6]"
)
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)} | {ord("Σ"): ord("σ")}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next unused one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Encoder:
    """Encodes and decodes as the vocabulary file says (normal form C, white space, lower case, word ends)."""

    def __init__(self, file: dict):
        model = file["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        self.words = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.final = np.array([self.vocab[c + END] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([self.vocab[m[k]] for m in pairs], np.int64) for k in (0, 1))
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], NONE << 10)
        self.rank = np.append(order, NONE)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)

    def pieces(self, text: str) -> list[str]:
        """The parts of a text without special tokens between which no merge goes."""
        text = SPACE.sub(" ", unicodedata.normalize("NFC", text))
        if text.isascii():
            return self.words.findall(text.lower())
        text = text.translate(SMALL).lower()
        seen = NO_LETTERS.sub("¦", text)
        return [text[m.start() : m.end()] for m in self.words.finditer(seen)]

    def merge(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece."""
        data = [p.encode() for p in pieces]
        size = np.fromiter(map(len, data), np.int64, len(data))
        symbols = self.inner[np.frombuffer(b"".join(data), np.uint8)]
        word = np.repeat(np.arange(len(data)), size)
        symbols[np.cumsum(size) - 1] = self.final[[d[-1] for d in data]]
        done_symbols, done_words = [], []
        while len(symbols):
            inside = np.flatnonzero(word[1:] == word[:-1])
            keys = symbols[inside] << 20 | symbols[inside + 1]
            found = np.searchsorted(self.keys, keys)
            rank = np.full(len(symbols), NONE)
            rank[inside] = np.where(self.keys[found] == keys, self.rank[found], NONE)
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(begins, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, begins), lengths)
            over = least == NONE
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            here = (rank == least) & ~over
            # in a run of one symbol every second place begins a merge
            at = np.flatnonzero(here)
            near = np.concatenate([[False], (np.diff(at) == 1)]) if len(at) else np.zeros(0, bool)
            if near.any():
                run = np.maximum.accumulate(np.where(near, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            stay = ~over
            stay[at + 1] = False
            symbols, word = symbols[stay], word[stay]
        if not done_words:
            return []
        ids, owner = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return np.split(ids[order], np.cumsum(np.bincount(owner, minlength=len(data)))[:-1])

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of strings without special tokens, each on its own."""
        parts = [self.pieces(w) for w in words]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(p for own in parts for p in own))}
        merged = [x.tolist() for x in self.merge(list(distinct))]
        return [merged[distinct[own[0]]] if len(own) == 1 else [i for p in own for i in merged[distinct[p]]] for own in parts]

    def encode_text(self, text: str) -> list[int]:
        """Ids of one text, special tokens included."""
        parts = self.marks.split(text) if self.marks else [text]
        ids = iter(self.encode_words([p for p in parts if p not in self.special]))
        return [i for p in parts for i in ([self.special[p]] if p in self.special else next(ids))]

    def decode(self, ids: list[int]) -> str:
        """The tokens with one space between, as a file without a decoder says; special tokens stay."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


def encoder(path: str) -> tuple[Encoder, WordIds]:
    """Loaded once in each Python worker."""
    kept = worker_store()
    if ("bpe", path) not in kept:
        with open(path, encoding="utf-8") as file:
            own = Encoder(json.load(file))
        kept["bpe", path] = own, WordIds(lambda words: side_by_side(own.encode_words(words)), own.encode_text, tuple(own.special))
    return kept["bpe", path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every row of ``docs`` (doc_id, text); a null or empty text has no ids.

    ``path``: vocabulary file, at the same place on every executor.
    """

    def one(batch):
        _, words = encoder(path)
        for part in slices(batch, "text", SLICE):
            yield {"doc_id": part.column("doc_id"), "ids": words.of(texts_of(part))}

    return arrow_map(with_types(docs, doc_id="bigint", text="string"), one, "doc_id bigint, ids array<int>", keep="bpe")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids); null ids give an empty text."""

    def one(batch):
        own, _ = encoder(path)
        yield {"doc_id": batch.column("doc_id"), "text": [own.decode(x or []) for x in batch.column("ids").to_pylist()]}

    return arrow_map(encoded.select("doc_id", "ids"), one, "doc_id bigint, text string", keep="bpe")


def encode_and_decode(docs: DataFrame, path: str, summary: Callable, schema: str) -> DataFrame:
    """Both in one pass over the texts: ``summary(ids, decoded text)`` gives the further columns of each row."""
    names = [f.split()[0] for f in schema.split(", ")]

    def one(batch):
        own, words = encoder(path)
        for part in slices(batch, "text", SLICE):
            rows = [summary(ids, own.decode(ids)) for ids in (x.tolist() for x in words.of(texts_of(part)))]
            yield {"doc_id": part.column("doc_id")} | {n: list(c) for n, c in zip(names, zip(*rows))}

    return arrow_map(with_types(docs, doc_id="bigint", text="string"), one, f"doc_id bigint, {schema}", keep="bpe")


def texts_of(part) -> list[str]:
    return [t or "" for t in part.column("text").to_pylist()]


def digests(ids: list[int], decoded: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids with one space between, SHA-256 of the decoded text."""
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
