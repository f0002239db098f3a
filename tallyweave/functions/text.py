"""Text segmentation as Column expressions: sentences, token counts, chunks.

Every function maps one text column to one array column, so a whole corpus is
chunked inside the scan stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.vectors import cosine, let

# Characters treated as white space, and the chunk separators from coarse to fine.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "; ", ", ", " ")
SENTENCE_BREAK = r"(?U)(?<=[。！？.!?])[\s\x1c-\x1f]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
DEFAULT_MAX_TOKENS = 800
DEFAULT_OVERLAP = 100
DEFAULT_SIMILARITY = 0.75

TokenCounter = Callable[[Column], Column]


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any script."""
    return F.btrim(text, F.lit(WHITESPACE))


def nonempty(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def lines(text: Column) -> Column:
    """Split into lines; a final line break does not open another line."""
    return F.split(F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK, -1)


def count_words(text: Column) -> Column:
    """Tokens separated by white space."""
    return F.size(nonempty(F.split(text, r"(?U)\s+", -1)))


def count_tokens(text: Column) -> Column:
    """Default counter: ideographs one by one, words as runs, marks one by one."""
    wide = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
    return F.regexp_count(text, F.lit(rf"(?U)[{wide}]|[\w&&[^{wide}]]+|[^\s\w]"))


def sentences(text: Column) -> Column:
    """Split after a sentence mark that white space follows."""
    return nonempty(F.transform(F.split(text, SENTENCE_BREAK, -1), strip))


def _pack(pieces: Column, joiner: Column, max_tokens: int, counter: TokenCounter) -> Column:
    """Greedily join neighbouring pieces while they fit.

    Counts are taken once per piece and added up.  What the joiner adds (or
    takes away, where it merges two words) is measured between two letters;
    that is exact for counters whose tokens end at white space or at a mark.
    """
    gap = counter(F.concat(F.lit("x"), joiner, F.lit("x"))) - 2 * counter(F.lit("x"))
    state = "struct<done:array<string>,open:string,size:int>"
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size")
    ).cast(state)
    counted = F.transform(pieces, lambda p: F.struct(p.alias("piece"), counter(p).cast("int").alias("size")))

    def step(acc: Column, item: Column) -> Column:
        total = acc["size"] + gap.cast("int") + item["size"]
        joins = (acc["open"] != "") & (total <= max_tokens)
        return F.struct(
            F.when((acc["open"] == "") | joins, acc["done"])
            .otherwise(F.concat(acc["done"], F.array(acc["open"])))
            .alias("done"),
            F.when(joins, F.concat(acc["open"], joiner, item["piece"])).otherwise(item["piece"]).alias("open"),
            F.when(joins, total).otherwise(item["size"]).alias("size"),
        ).cast(state)

    return F.aggregate(
        counted,
        start,
        step,
        lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))),
    )


def overlap_chunks(chunks: Column, overlap: int | Column) -> Column:
    """Prefix every chunk with the tail of the chunk before it, tail included."""
    width = F.lit(overlap) if isinstance(overlap, int) else overlap
    state = "struct<out:array<string>,last:string>"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last")).cast(state)

    def step(acc: Column, chunk: Column) -> Column:
        joined = F.concat(F.right(acc["last"], width), chunk)
        return F.struct(F.concat(acc["out"], F.array(joined)).alias("out"), joined.alias("last")).cast(state)

    return F.aggregate(chunks, start, step, lambda acc: acc["out"])


def hard_split(text: Column, max_chars: int, overlap: int) -> Column:
    """Fixed windows of characters; the last windows may lie inside the overlap."""
    if max_chars <= 0:
        return F.array(text)
    stride = max(1, max_chars - overlap)
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(max_chars)))).otherwise(
        F.array().cast("array<string>")
    )


def sentence_chunks(
    text: Column,
    max_tokens: int = DEFAULT_MAX_TOKENS,
    overlap: int = DEFAULT_OVERLAP,
    counter: TokenCounter = count_tokens,
) -> Column:
    """Whole sentences packed up to the limit."""
    return overlap_chunks(_pack(sentences(text), F.lit(" "), max_tokens, counter), max(overlap, 0))


def recursive_chunks(
    text: Column,
    max_tokens: int = DEFAULT_MAX_TOKENS,
    overlap: int = DEFAULT_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
    counter: TokenCounter = count_tokens,
) -> Column:
    """Split by the coarsest separator that occurs, finer ones only for what stays too long.

    The recursion is unrolled into one expression, at most a level per
    separator.  Overlap is added at each level.
    """

    def fit_or_split(chunk: Column, depth: int) -> Column:
        return F.when(counter(chunk) <= max_tokens, F.array(chunk)).otherwise(level(chunk, depth))

    def level(chunk: Column, depth: int) -> Column:
        if depth == len(separators):
            return hard_split(chunk, max_tokens, overlap)
        # The first separator left that occurs and has some text beside it.
        mark = F.coalesce(
            *[
                F.when(F.contains(chunk, F.lit(s)) & (strip(F.replace(chunk, F.lit(s), F.lit(" "))) != ""), F.lit(s))
                for s in separators[depth:]
            ]
        )
        return let(
            mark,
            lambda m: F.when(m.isNull(), hard_split(chunk, max_tokens, overlap)).otherwise(by_mark(chunk, m, depth)),
        )

    def by_mark(chunk: Column, mark: Column, depth: int) -> Column:
        quoted = F.concat(F.lit("\\Q"), mark, F.lit("\\E"))
        pieces = nonempty(F.transform(F.split(chunk, quoted, -1), strip))
        packed = _pack(pieces, mark, max_tokens, counter)
        return overlap_chunks(F.flatten(F.transform(packed, lambda c: fit_or_split(c, depth + 1))), max(overlap, 0))

    body = strip(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(fit_or_split(body, 0))


def semantic_chunks(
    units: Column,
    max_tokens: int = DEFAULT_MAX_TOKENS,
    overlap: int = DEFAULT_OVERLAP,
    threshold: float = DEFAULT_SIMILARITY,
) -> Column:
    """Join a sentence to the running chunk while it is similar enough and fits.

    ``units`` is ``array<struct<sent:string, vec:array<double>, size:int>>`` in
    sentence order.  The running vector is the mean of itself and the newcomer.
    """
    state = "struct<done:array<string>,open:string,vec:array<double>,size:int>"
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("open"),
        F.array().cast("array<double>").alias("vec"),
        F.lit(0).alias("size"),
    ).cast(state)

    def step(acc: Column, item: Column) -> Column:
        fits = acc["open"].isNotNull() & (acc["size"] + item["size"] <= max_tokens)
        similar = F.when(fits, cosine(acc["vec"], item["vec"]) >= threshold).otherwise(F.lit(False))
        return let(similar, lambda joins: merge(acc, item, joins))

    def merge(acc: Column, item: Column, joins: Column) -> Column:
        return F.struct(
            F.when(joins | acc["open"].isNull(), acc["done"])
            .otherwise(F.concat(acc["done"], F.array(acc["open"])))
            .alias("done"),
            F.when(joins, F.concat_ws(" ", acc["open"], item["sent"])).otherwise(item["sent"]).alias("open"),
            F.when(joins, F.zip_with(acc["vec"], item["vec"], lambda a, b: (a + b) / 2.0))
            .otherwise(item["vec"])
            .alias("vec"),
            F.when(joins, acc["size"] + item["size"]).otherwise(item["size"]).alias("size"),
        ).cast(state)

    packed = F.aggregate(
        units,
        start,
        step,
        lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))),
    )
    return overlap_chunks(packed, max(overlap, 0))
