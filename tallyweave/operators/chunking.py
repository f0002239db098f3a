"""Documents to parts to chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions import text as X
from tallyweave.functions.vectors import hash_embedding
from tallyweave.operators.stage import spread, stage


def split_parts(docs: DataFrame, text: str = "text", by: str = "paragraph") -> DataFrame:
    """Numbered parts of each text without the empty ones.

    ``paragraph`` numbers the kept lines from 1; ``blank_line`` splits at blank
    lines and keeps the number of the place.
    """
    if by == "paragraph":
        parts = X.nonempty(F.transform(X.lines(F.col(text)), X.strip))
        return docs.select(*[c for c in docs.columns if c != text], F.posexplode(parts).alias("_i", "text")).select(
            "*", (F.col("_i") + 1).alias("part_no")
        ).drop("_i")
    parts = F.transform(F.split(text, "\n\n", -1), X.strip)
    numbered = docs.select(*[c for c in docs.columns if c != text], F.posexplode(parts).alias("_i", "text"))
    return numbered.filter("text <> ''").withColumn("part_no", F.col("_i") + 1).drop("_i")


def chunk_column(
    strategy: str = "recursive",
    max_tokens: int = X.DEFAULT_MAX_TOKENS,
    overlap: int = X.DEFAULT_OVERLAP,
    counter: X.TokenCounter = X.count_tokens,
    embed: Callable[[Column], Column] = hash_embedding,
) -> Callable[[Column], Column]:
    """The chunker of a strategy; an unknown name means recursive."""
    if strategy == "sentence":
        return lambda c: X.sentence_chunks(c, max_tokens, overlap, counter)
    if strategy == "semantic":
        unit = lambda s: F.struct(s.alias("sent"), embed(s).alias("vec"), counter(s).cast("int").alias("size"))
        return lambda c: X.semantic_chunks(F.transform(X.sentences(c), unit), max_tokens, overlap)
    return lambda c: X.recursive_chunks(c, max_tokens, overlap, counter=counter)


def chunk_documents(docs: DataFrame, chunker: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """One row per chunk; ``chunk_index`` starts again in every input row."""
    made = stage(spread(docs), {"_chunks": chunker(F.col(text))}, [c for c in docs.columns if c != text])
    keep = [c for c in made.columns if c != "_chunks"]
    return made.select(*keep, F.posexplode("_chunks").alias("chunk_index", "text"))


def embed_sentences(docs: DataFrame, embed_batch, width: int, text: str = "text", batch: int = 32, concurrency: int = 1) -> DataFrame:
    """Sentences with vectors of a batch embedder, as input of the semantic chunker: ``sents`` and ``vecs`` beside the other columns.

    ``embed_batch`` maps a list of texts to a list of vectors.  The sentences of
    a partition are one stream: each call has exactly ``batch`` of them, across
    the borders of rows and Arrow batches, but for the partition's last call.
    ``concurrency`` calls of a task are made at once.  A call that comes back
    with another number of vectors or another width fails.  Rows without a
    sentence have no vectors.  Rows leave in the order they came in.
    """
    split = stage(docs, {"sents": F.coalesce(X.sentences(F.col(text)), F.array().cast("array<string>"))})
    schema = T.StructType([*split.schema.fields, T.StructField("vecs", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def call(texts: list[str]) -> np.ndarray:
        made = list(embed_batch(texts))
        if len(made) != len(texts):
            raise ValueError(f"Embedding count mismatch: {len(made)} vs {len(texts)}")
        if any(len(v) != width for v in made):
            raise ValueError(f"Embedding width mismatch: {width} wanted")
        return np.asarray(made, np.float64).reshape(len(made), width)

    def run(batches):
        waiting: deque[pa.RecordBatch] = deque()  # rows whose vectors are not all there
        texts: list[str] = []  # sentences without a vector
        done = np.zeros((0, width))  # vectors that no row has taken

        with ThreadPoolExecutor(concurrency) as pool:

            def embed(whole: bool) -> None:
                nonlocal done
                end = len(texts) if whole else len(texts) - len(texts) % batch
                calls = [texts[i : i + batch] for i in range(0, end, batch)]
                del texts[:end]
                # put together once: appended call by call, the vectors of a batch would be copied for each call
                made = [done]
                for start in range(0, len(calls), concurrency):
                    made += pool.map(call, calls[start : start + concurrency])
                done = np.concatenate(made)

            def ready():
                nonlocal done
                while waiting and len(done) >= (n := len(waiting[0].column("sents").flatten())):
                    rows = waiting.popleft()
                    inner = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(done[:n].ravel()))
                    sizes = pc.fill_null(pc.list_value_length(rows.column("sents")), 0).to_numpy()
                    vecs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), inner)
                    done = done[n:]
                    yield pa.RecordBatch.from_arrays([*rows.columns, vecs], [*rows.schema.names, "vecs"])

            for rows in batches:
                waiting.append(rows)
                texts += rows.column("sents").flatten().to_pylist()
                embed(False)
                yield from ready()
            embed(True)
            yield from ready()

    return split.mapInArrow(run, schema)
