"""Chunkers against a plain restatement of the rules, on random texts."""

from __future__ import annotations

import html
import html.entities
import math
import random
import re

from pyspark.sql import functions as F

from tallyweave.functions import recognise as R
from tallyweave.functions import text as X
from tallyweave.functions import vectors as V
from tallyweave.operators import tables as T
from tallyweave.operators.containment import contained
from tallyweave.operators.matching import base_metrics, base_patterns, loose_phrases

MARKS = list(X.SEPARATORS)


def words(text):
    return len(text.split())


def tail_join(chunks, width):
    done = []
    for chunk in chunks:
        done.append((done[-1][-width:] if done and width else "") + chunk)
    return done


def pack(pieces, joiner, limit):
    groups = []
    for piece in pieces:
        if groups and words(joiner.join(groups[-1] + [piece])) <= limit:
            groups[-1].append(piece)
        else:
            groups.append([piece])
    return [joiner.join(g) for g in groups]


def by_sentences(text, limit, width):
    parts = [p.strip() for p in re.split(r"(?<=[。！？.!?])\s+", text) if p.strip()]
    return parts, tail_join(pack(parts, " ", limit), width)


def by_marks(text, limit, width, marks):
    text = text.strip()
    if not text or words(text) <= limit:
        return [text] if text else []
    usable = [m for m in marks if m in text and any(p.strip() for p in text.split(m))]
    if not usable:
        return [text[i : i + limit] for i in range(0, len(text), max(1, limit - width))] if limit > 0 else [text]
    mark = usable[0]
    out = []
    for chunk in pack([p.strip() for p in text.split(mark) if p.strip()], mark, limit):
        out += [chunk] if words(chunk) <= limit else by_marks(chunk, limit, width, marks[1:])
    return tail_join(out, width)


def random_texts(n, seed):
    rnd = random.Random(seed)
    parts = ["alpha", "beta", "货币资金", "x", "ü", "gamma. ", "delta! ", "\n", "\n\n", "。", "！ ", "; ", ", ", " ", "  ", ".", "? "]
    return ["", " ", "。。。", "a" * 50] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 120))) for _ in range(n)]


def column_of(spark, texts, expr):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", expr(F.col("t")).alias("c")).collect()
    return [list(r["c"]) for r in sorted(rows, key=lambda r: r["i"])]


def test_sentences_and_sentence_chunks(spark):
    texts = random_texts(300, 1)
    assert column_of(spark, texts, X.sentences) == [by_sentences(t, 8, 5)[0] for t in texts]
    got = column_of(spark, texts, lambda c: X.sentence_chunks(c, 8, 5, X.count_words))
    assert got == [by_sentences(t, 8, 5)[1] for t in texts]


def test_recursive_chunks(spark):
    texts = random_texts(300, 2)
    for limit, width in ((6, 3), (3, 0), (12, 5)):
        got = column_of(spark, texts, lambda c: X.recursive_chunks(c, limit, width, counter=X.count_words))
        assert got == [by_marks(t, limit, width, MARKS) for t in texts]


def test_hard_split_and_overlap(spark):
    assert column_of(spark, ["abcdefghij"], lambda c: X.hard_split(c, 4, 1)) == [["abcd", "defg", "ghij", "j"]]
    assert column_of(spark, ["a b cc"], lambda c: X.overlap_chunks(F.split(c, " "), 2)) == [["a", "ab", "abcc"]]


def test_semantic_chunks(spark):
    texts = random_texts(150, 3)

    def plain(text):
        units = by_sentences(text, 1, 0)[0]
        chunks = []
        for s in units:
            v, n = vectors[s], words(s)
            if chunks:
                last = chunks[-1]
                dot = sum(a * b for a, b in zip(last["v"], v))
                size = math.sqrt(sum(a * a for a in last["v"])) * math.sqrt(sum(b * b for b in v))
                if (dot / size if size else 0.0) >= 0.3 and last["n"] + n <= 9:
                    chunks[-1] = {"t": last["t"] + " " + s, "v": [(a + b) / 2 for a, b in zip(last["v"], v)], "n": last["n"] + n}
                    continue
            chunks.append({"t": s, "v": v, "n": n})
        return tail_join([c["t"] for c in chunks], 4)

    every = sorted({s for t in texts for s in by_sentences(t, 1, 0)[0]})
    embedded = spark.createDataFrame([(s,) for s in every], "s string").select("s", V.hash_embedding(F.col("s"), 8).alias("v"))
    vectors = {r["s"]: list(r["v"]) for r in embedded.collect()}
    unit = lambda s: F.struct(s.alias("sent"), V.hash_embedding(s, 8).alias("vec"), X.count_words(s).cast("int").alias("size"))
    got = column_of(spark, texts, lambda c: X.semantic_chunks(F.transform(X.sentences(c), unit), 9, 4, 0.3))
    assert got == [plain(t) for t in texts]


def test_default_counter_adds_up(spark):
    texts = ["货币资金 1,000 元", "hello, world", "a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.count_tokens(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [8, 3, 2]


def test_cosine_of_empty_and_zero(spark):
    row = spark.sql("select array() e, array(0d, 0d) z, array(3d, 4d) v").select(
        V.cosine(F.col("e").cast("array<double>"), F.col("v")).alias("a"), V.cosine(F.col("z"), F.col("v")).alias("b"),
        V.cosine(F.col("v"), F.col("v")).alias("c"),
    ).first()
    assert (row["a"], row["b"], round(row["c"], 12)) == (0.0, 0.0, 1.0)


def test_cell_text_decodes_all_references(spark):
    rng = random.Random(11)
    names = sorted(html.entities.html5)
    numbers = [*range(0x110), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFEFF, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000, 10**9, 10**30]
    texts = ["&#65; &ensp;1&#12288;&frac12;&amp;lt;", "&", "&;", "&&amp;&", "a & b", "&notit; &nosuch; &ampx &copy2", "&#; &#x; &#xZ;", None, ""]
    texts += [f"a&{n}b" for n in names] + [f"a&{n.rstrip(';')} b" for n in names]
    texts += [f"a&#{n};b&#{n}z" for n in numbers] + [f"a&#{x}{n:{x}};b&#X000{n:X}z" for n in numbers for x in "x"]
    texts += ["".join(rng.choice(["&", "#", "x", "amp", "lt;", ";", "not", "in", "12", "é", " ", "\n"]) for _ in range(12)) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", R.unescape(F.col("t")).alias("got")).collect()
    assert {r.i: r.got for r in rows} == {i: t if t is None else html.unescape(t) for i, t in enumerate(texts)}
    cell = spark.createDataFrame([("<td>&#65;&ensp;&#12288;&frac12;&nbsp;</td>",)], "t string").select(R.cell_text(F.col("t"))).first()[0]
    assert cell == "A\u2002\u3000½"


def test_contained_phrases_against_all_pairs(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abé资产") for _ in range(n))
    texts = [word(rng.randint(0, 25)) for _ in range(300)] + [None, ""]
    phrases = [word(rng.randint(1, 7)) for _ in range(200)] + [None, "", "zz", "资产"]
    made = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    want = {(t, p) for t in texts if t for p in phrases if p and p in t}
    for q in (1, 3, 4):
        got = contained(*made, q).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert not contained(made[0], made[1].limit(0)).count() and not contained(made[0].limit(0), made[1]).count()


def test_row_votes_of_a_table_of_phrases_and_of_literals_agree(spark):
    rng = random.Random(7)
    known = base_patterns()
    every = [p for own in known.values() for p in own]
    rows = [(i // 5, "text", "t", rng.choice(["其中：", "", "1. "]) + rng.choice(every) + rng.choice(["", "合计", " (续)"])) for i in range(400)]
    rows = spark.createDataFrame(rows, "report_id long, engine string, table_key string, label string")
    tables = rows.select("report_id", "engine", "table_key").distinct()
    by_table = T.vote_by_rows(tables, rows, loose_phrases(base_metrics(spark)))
    assert every[0] not in by_table._jdf.queryExecution().optimizedPlan().toString()  # no phrase is a literal
    want = {r["report_id"]: r["voted"] for r in T.vote_by_rows(tables, rows, known).collect() if r["voted"]}
    assert {r["report_id"]: r["voted"] for r in by_table.collect()} == want and len(want) == 80
