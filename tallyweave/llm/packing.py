"""Best-fit packing of token sequences, with large items matched first.

Documents are cut into pieces of at most ``capacity`` tokens.  Pieces above a
third of the capacity are paired, at most two in a sequence, each largest one with
the largest that fits beside it; smaller pieces then go, largest first, into the
smallest gap that takes them, and into new sequences where none does.

Pieces of one length are alike, so the plan needs only how many there are of each
length: at most ``capacity`` numbers reach the driver, and the plan has a few
rows for each length, whatever the corpus.  Every piece finds its place from its length
and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import compress

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.llm.bpe import byte_letters
from tallyweave.llm.common import arrow_map, arrow_stream, slices, stored, with_types, worker_store
from tallyweave.llm.word_ids import WordIds, side_by_side

SLICE = 1 << 19
CAPACITY = 2048


def token_source(path: str, most: int = 800_000) -> WordIds:
    """The tokenizer of a file that drops white space, loaded once in each Python worker."""
    kept = worker_store()
    if ("tokenizer", path, most) not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tokenizer, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for own in (tokenizer, bare):
            own.no_padding()
            own.no_truncation()
        bare.normalizer, bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        stop = tokenizer.token_to_id(BYTES[0] + "</w>")
        special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        kept["tokenizer", path, most] = WordIds(
            lambda words: encoded_words(tokenizer, bare, words, stop),
            lambda text: tokenizer.encode(text, add_special_tokens=False).ids,
            special,
            most,
        )
    return kept["tokenizer", path, most]


# Latin letters that normal form C leaves alone and whose small letters are letters, digits, and marks that are no part of a contraction.
MARKS = r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f"[A-Za-zÀ-ÖØ-öø-įı-ɏ0-9{MARKS}]+")
NO_LETTERS = re.compile(f"[{MARKS}]+|[0-9]")
BYTES = {b: letter for b, letter in enumerate(byte_letters()) if b != 32}


def encoded_words(tokenizer, bare, words: list[str], stop: int, group: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words, as :func:`side_by_side` lays them out.

    Words of letters, digits and marks are made small, cut into runs and written
    in the letters of their bytes here, as the tokenizer does it.  ``bare``, which
    has the merges alone, encodes many of them in a call, each before a zero byte,
    of which ``stop`` is the id.  The others are encoded one by one.
    """
    is_plain = [PLAIN.fullmatch(w) is not None for w in words]
    plain, rest = list(compress(words, is_plain)), [w for w, p in zip(words, is_plain) if not p]
    texts = [NO_LETTERS.sub(r" \g<0> ", " \0 ".join([*plain[k : k + group], ""]).lower()) for k in range(0, len(plain), group)]
    texts = [t.encode().decode("latin-1").translate(BYTES) for t in texts]
    flat = np.array([i for e in bare.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int32)
    others = side_by_side([e.ids for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False)])
    order = np.argsort(~np.array(is_plain, bool), kind="stable")
    ends = np.flatnonzero(flat == stop)
    first, size = np.empty((2, len(words)), np.int64)
    first[order] = np.concatenate([[0] * (len(ends) > 0), ends[:-1] + 1, len(flat) + others[0]])
    size[order] = np.concatenate([np.diff(ends, prepend=-1) - 1, others[1]])
    return first, size, np.concatenate([flat, others[2]])


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = True, known_words: int = 800_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth and, if wanted, ids of every piece.

    ``nth`` numbers the pieces of a length that a task makes, from 0.

    A document's ids are the tokenizer's and then ``end``; a null or empty text
    has ``end`` alone.  Rows that repeat a doc_id are documents of their own.
    A worker keeps the ids of up to ``known_words`` words: fewer take less
    memory and more encoding, with the same result.
    """

    def one(batches):
        words, made, task = token_source(path, known_words), Counter(), TaskContext.get().partitionId()
        for part in (part for batch in batches for part in slices(batch, "text", SLICE)):
            doc, piece, start, length, crc, ids, nth = [], [], [], [], [], [], []
            for d, own in zip(part.column("doc_id").to_pylist(), words.of([t or "" for t in part.column("text").to_pylist()])):
                whole = np.append(own, np.int32(end)).astype("<u4")
                for k, at in enumerate(range(0, len(whole), capacity)):
                    cut = whole[at : at + capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(cut))
                    nth.append(made[len(cut)])
                    made[len(cut)] += 1
                    crc.append(zlib.crc32(cut.tobytes()))
                    ids.append(cut.astype(np.int32) if with_ids else None)
            columns = {"doc_id": doc, "piece": piece, "start": start, "length": length, "ids_crc32": crc, "task": [task] * len(doc), "nth": nth}
            yield columns | ({"ids": ids} if with_ids else {})

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint" + ", ids array<int>" * with_ids
    return arrow_stream(with_types(docs, doc_id="bigint", text="string"), one, schema, keep="tokenizer")


class Plan:
    """Sequences for so many pieces of each length.

    ``moves`` has rows (length, first rank, pieces, pieces a sequence, first
    sequence, offset): of the pieces of this length, those from this rank on fill
    consecutive sequences, side by side from the offset.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.moves, self.sequences = capacity, [], 0
        self.ranks: dict[int, int] = defaultdict(int)
        self.gaps: list[int] = []  # sizes of gaps, ascending
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, number of them)
        left = {n: c for n, c in counts.items() if c > 0}
        self.match({n: left.pop(n) for n in sorted(left) if 3 * n > capacity})
        for n in sorted(left, reverse=True):
            self.fit(n, left[n])

    def new(self, number: int) -> int:
        self.sequences += number
        return self.sequences - number

    def put(self, length: int, pieces: int, each: int, sequence: int, offset: int) -> None:
        self.moves.append((length, self.ranks[length], pieces, each, sequence, offset))
        self.ranks[length] += pieces

    def keep(self, gap: int, sequence: int, number: int) -> None:
        if gap > 0 and number > 0:
            if not self.open[gap]:
                bisect.insort(self.gaps, gap)
            self.open[gap].append((sequence, number))

    def match(self, large: dict[int, int]) -> None:
        lengths = sorted(large)
        while lengths:
            n = lengths[-1]
            fit = bisect.bisect_right(lengths, self.capacity - n) - 1
            if fit < 0:
                self.keep(self.capacity - n, self.new(0), large[n])
                self.put(n, large[n], 1, self.new(large[n]), 0)
                lengths.pop()
                continue
            m = lengths[fit]
            pairs = large[n] // 2 if m == n else min(large[n], large[m])
            if m == n and pairs == 0:  # one of its own length is left: the next smaller is its best partner
                if len(lengths) == 1:
                    self.keep(self.capacity - n, self.new(0), 1)
                    self.put(n, 1, 1, self.new(1), 0)
                    break
                m, pairs = lengths[-2], 1
            self.keep(self.capacity - n - m, self.new(0), pairs)
            first = self.new(pairs)
            if m == n:
                self.put(n, 2 * pairs, 2, first, 0)
                large[n] -= 2 * pairs
            else:
                self.put(n, pairs, 1, first, 0)
                self.put(m, pairs, 1, first, n)
                large[n] -= pairs
                large[m] -= pairs
            lengths = [x for x in lengths if large[x]]

    def fit(self, n: int, count: int) -> None:
        while count:
            k = bisect.bisect_left(self.gaps, n)
            if k == len(self.gaps):
                each = min(self.capacity // n, count)
                bins = max(1, count // each)
                first = self.new(bins)
                self.put(n, bins * each, each, first, 0)
                self.keep(self.capacity - each * n, first, bins)
                count -= bins * each
                continue
            gap = self.gaps[k]
            first, bins = self.open[gap].pop()
            if not self.open[gap]:
                self.gaps.pop(k)
            each = min(gap // n, count)
            used = min(bins, count // each)
            self.put(n, used * each, each, first, self.capacity - gap)
            self.keep(gap - each * n, first, used)
            self.keep(gap, first + used, bins - used)
            count -= used * each


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``, and ``task`` and ``nth`` as :func:`tokenized_pieces` numbers them) with sequence_id and offset.

    Sequences are numbered from 0 and filled without gaps from offset 0.  An
    empty table stays empty.
    """
    marked = stored(pieces, "pieces")
    # ranks: pieces of a task and length in the task's order, after those of earlier tasks
    shares = marked.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    shares = stored(shares.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    counts = {r.length: r.n for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(counts, capacity)
    moves = sorted(plan.moves)
    table = np.array(moves, np.int64).reshape(-1, 6)
    first_of = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    ranked = marked.join(shares.select("task", "length", "before"), ["task", "length"])
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("before"))
    columns = [c for c in pieces.columns if c not in ("task", "nth")]

    def place(batch):
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        # moves of one length lie together in order of rank: one search over (length, rank)
        step = np.int64(1) << 40
        at = np.searchsorted(table[:, 0] * step + table[:, 1], length * step + rank, "right") - 1
        _, low, _, each, sequence, offset = table[at].T
        inner = rank - low
        yield {n: batch.column(n) for n in columns} | {"sequence_id": sequence + inner // each, "offset": offset + inner % each * length}

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns)
    assert first_of[-1] == len(table)
    return arrow_map(ranked.select(*columns, "rank"), place, f"{kinds}, sequence_id bigint, offset bigint")
