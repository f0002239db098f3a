"""JSON arrays of any size read by many tasks: items are found by prefix sums over pieces of the file.

The text reader cuts a file after closing braces, wherever its splits fall, so a
task sees its part of the file as a run of pieces and never the whole.  What a chunk
of pieces does to the reader's state is known without what came before: an
unescaped quote turns "inside a string" round, and for either state at its start the
brackets outside strings add up to a change of depth.  Running sums of these effects
over the chunks of a file give every chunk its state; then each chunk is cut on its
own, at commas between the items of the list (or at line ends).  Items that cross
chunks are the only ones that are put together afterwards.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.operators.stage import materialize

# The cutting runs in Python workers, which need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 20
BREAK = b"}"
QUOTE, BACKSLASH, COMMA, OPEN, CLOSE = 34, 92, 44, 91, 93
BLANKS = b" \t\r\n\v\f"
MARK = b"\xef\xbb\xbf"


class Marks(NamedTuple):
    place: np.ndarray  # of brackets, braces and commas
    byte: np.ndarray
    inside: np.ndarray  # in a string, if the chunk starts outside one
    turns: int  # unescaped quotes


def marks_of(data: np.ndarray) -> Marks:
    """What matters in a chunk, whatever state it starts in; a byte after an odd run of backslashes counts for nothing."""
    special = np.zeros(256, bool)
    special[[QUOTE, BACKSLASH, COMMA, OPEN, CLOSE, 123, 125]] = True
    place = np.flatnonzero(special[data])
    byte = data[place]
    slashes = place[byte == BACKSLASH]
    if len(slashes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        length = np.diff(first, append=len(slashes))
        escaped = (slashes[first] + length)[length % 2 == 1]
        keep = (byte != BACKSLASH) & ~np.isin(place, escaped)
        place, byte = place[keep], byte[keep]
    quote = byte == QUOTE
    inside = (np.cumsum(quote) % 2).astype(bool)
    return Marks(place[~quote], byte[~quote], inside[~quote], int(quote.sum()))


def depth_changes(byte: np.ndarray) -> np.ndarray:
    return np.where(byte == COMMA, 0, np.where((byte == OPEN) | (byte == 123), 1, -1))


def cut(data: bytes, quoted: bool, depth: int, level: int) -> Iterator[tuple[int, int, bool, bool, str | None]]:
    """Parts of items of lists at ``level`` in a chunk: (start, end, does the item start here, does it end here, name).

    ``name`` is set on the part that opens a list: the key before it, or ''.
    """
    marks = marks_of(np.frombuffer(data, np.uint8))
    real = marks.inside == quoted  # a chunk that starts in a string has its strings where it seems to have none
    place, byte = marks.place[real], marks.byte[real]
    change = depth_changes(byte)
    after = depth + np.cumsum(change)
    opens = (byte == OPEN) & (after == level)
    closes = (byte == CLOSE) & (after == level - 1)
    edges = opens | closes | ((byte == COMMA) & (after == level))
    start, started, name, listed = 0, False, None, depth >= level
    for at, is_open, is_close in zip(place[edges].tolist(), opens[edges].tolist(), closes[edges].tolist()):
        if is_open:
            start, started, listed, name = at + 1, True, True, _key_before(data, at)
            continue
        if listed:
            yield start, at, started, True, name
        start, started, name, listed = at + 1, True, None, not is_close
    if listed:
        yield start, len(data), started, False, name


def _key_before(data: bytes, at: int) -> str:
    head = data[max(0, at - 1000) : at].rstrip(BLANKS)
    if not head.endswith(b":"):
        return ""
    head = head[:-1].rstrip(BLANKS)
    return head[head.rfind(b'"', 0, -1) + 1 : -1].decode("utf-8", "replace")


def cut_lines(data: bytes, first: bool) -> Iterator[tuple[int, int, bool, bool, None]]:
    """Parts of lines, ended by either line mark."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((raw == 10) | (raw == 13)).tolist()
    start, started = 0, first
    for end in ends:
        yield start, end, started, True, None
        start, started = end + 1, True
    yield start, len(data), started, False, None


CHUNK = "file_path string, file_size bigint, block bigint, chunk int, data binary, bytes bigint, turns bigint, change_out bigint, change_in bigint, first int"


def read_chunks(spark: SparkSession, path: str, pattern: str = "*.json", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The files in chunks that end after a closing brace, with what each does to the reader's state (stored, as the splits may change)."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", BREAK.decode()).text(path)
    meta = F.col("_metadata")
    pieces = raw.select(
        meta["file_path"].alias("file_path"), meta["file_size"].alias("file_size"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("value")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, number = None, [], 0, 0
        names = CHUNK.replace(",", "").split()[::2]

        def row() -> pa.RecordBatch:
            data = BREAK.join(held) + BREAK
            marks = marks_of(np.frombuffer(data, np.uint8))
            change = depth_changes(marks.byte)
            body = data[3:] if data[:3] == MARK else data
            lead = body.lstrip(BLANKS)[:1]
            values = (*at[:2], at[2], number, data, len(data), marks.turns, int(change[~marks.inside].sum()), int(change[marks.inside].sum()), lead[0] if lead else None)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 4, pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            for *place, value in zip(*(batch.column(n).to_pylist() for n in ("file_path", "file_size", "block")), batch.column("value")):
                if place != at:
                    if held:
                        yield row()
                    at, held, size, number = place, [], 0, 0
                held.append(value.as_py())
                size += len(held[-1]) + 1
                if size >= chunk_bytes:
                    yield row()
                    held, size, number = [], 0, number + 1
        if held:
            yield row()

    return materialize(pieces.mapInArrow(run, CHUNK), "json-chunks")


KEY = ["file_path", "block", "chunk"]


def _carried(chunks: DataFrame, column: str, total, name: str) -> DataFrame:
    """Add ``name``: ``total`` (sum or max) of a column over all earlier chunks of the file.

    Totals run over the chunks of a block and over the blocks of a file, so no task sees all chunks of a large file.
    """
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = chunks.groupBy("file_path", "block").agg(total(column).alias("own"))
    blocks = blocks.select("file_path", "block", total("own").over(earlier("file_path", "block")).alias("_blocks"))
    inside = chunks.withColumn("_chunks", total(column).over(earlier(*KEY))).join(blocks, ["file_path", "block"])
    none = F.lit(0) if total is F.sum else F.lit(None)
    both = F.coalesce("_blocks", none) + F.coalesce("_chunks", none) if total is F.sum else F.greatest("_blocks", "_chunks")
    return inside.withColumn(name, both).drop("_blocks", "_chunks")


def _placed(chunks: DataFrame) -> DataFrame:
    """Each chunk's offset, whether it starts in a string, its depth, the file's first byte, and whether its last brace is the reader's own."""
    state = _carried(_carried(chunks.drop("data"), "turns", F.sum, "before"), "bytes", F.sum, "offset")
    state = state.withColumn("quoted", F.col("before") % 2 == 1)
    state = _carried(state.withColumn("change", F.when(F.col("quoted"), F.col("change_in")).otherwise(F.col("change_out"))), "change", F.sum, "depth")
    files = chunks.groupBy("file_path").agg(
        F.sum("bytes").alias("total"), F.min_by("first", F.when(F.col("first").isNotNull(), F.struct("block", "chunk"))).alias("kind")
    )
    # the reader drops a byte order mark of three bytes, and ends a file alike with and without a last brace
    extra = (F.col("total") - F.col("file_size")).isin(1, -2) & (F.col("offset") + F.col("bytes") == F.col("total"))
    return state.join(files, "file_path").select(*KEY, "quoted", "depth", "offset", "kind", extra.alias("extra"))


PART = "file_path string, block bigint, chunk int, offset bigint, part binary, starts boolean, ends boolean, name string"


def read_records(spark: SparkSession, path: str, pattern: str = "*.json", field: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """file_path, offset (in bytes), record of every item of the JSON files below ``path``.

    A file that begins with ``[`` is one array, cut at its items.  Any other is
    read by lines; with ``field`` it is an object, and the items are those of the list
    under that key.  Items are whatever stands between the commas and need not
    parse.  An unfinished last item of a truncated array is a record too.
    Blank items and files without any give no row.
    """
    chunks = read_chunks(spark, path, pattern, chunk_bytes)
    placed = materialize(_placed(chunks), "json-places")  # of known size, a row a chunk: the planner need not shuffle the chunks' bytes
    chunks = chunks.select(*KEY, "data").join(placed, KEY)
    with_field = field is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = row["data"][:-1] if row["extra"] else row["data"]
                if row["kind"] == OPEN or with_field:
                    parts = cut(data, row["quoted"], row["depth"], 1 if row["kind"] == OPEN else 2)
                else:
                    parts = cut_lines(data, row["offset"] == 0)
                parts = list(parts)
                if not parts:
                    continue
                starts, ends = [p[2] for p in parts], [p[3] for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([row[n]] * len(parts), k) for n, k in (("file_path", pa.string()), ("block", pa.int64()), ("chunk", pa.int32()))],
                        pa.array([row["offset"] + p[0] for p in parts], pa.int64()),
                        pa.array([data[p[0] : p[1]] for p in parts], pa.binary()),
                        pa.array(starts, pa.bool_()),
                        pa.array(ends, pa.bool_()),
                        pa.array([p[4] for p in parts], pa.string()),
                    ],
                    names=[*KEY, "offset", "part", "starts", "ends", "name"],
                )

    parts = materialize(chunks.mapInArrow(run, PART), "json-items")
    whole = parts.filter("starts and ends").select("file_path", "offset", "part", "name")
    # parts of items that cross chunks, two a chunk at most: a chunk's first part goes on with the last item left open before it
    left_open = parts.filter("starts and not ends").select(*KEY, F.col("offset").alias("open"))
    carried = _carried(placed.select(*KEY).join(left_open, KEY, "left"), "open", F.max, "item").select(*KEY, "item")
    pieces = parts.filter("not (starts and ends)").join(carried, KEY)
    pieces = pieces.withColumn("item", F.when(F.col("starts"), F.col("offset")).otherwise(F.col("item"))).filter("item is not null")
    joined = pieces.groupBy("file_path", "item").agg(F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("p"), F.max("name").alias("name"))
    joined = joined.select("file_path", F.col("item").alias("offset"), F.array_join(F.transform("p", lambda p: F.hex(p["part"])), "").alias("hex"), "name")
    joined = joined.select("file_path", "offset", F.unhex("hex").alias("part"), "name")
    items = whole.unionByName(joined)
    if with_field:
        items = _of_field(items, field)
    record = F.regexp_replace(F.col("part").cast("string"), r"^[\x{FEFF}\s]+|\s+\z", "")
    return items.select("file_path", "offset", record.alias("record")).filter("record <> ''")


def _of_field(items: DataFrame, field: str) -> DataFrame:
    """Items of bare arrays and of the lists under ``field``: each item's list is the last one opened before it."""
    # one row a list of a file's outer object
    opened = items.filter("name is not null").select("file_path", F.col("offset").alias("low"), "name")
    ends = F.lead("low").over(Window.partitionBy("file_path").orderBy("low"))
    wanted = opened.withColumn("high", ends).filter(F.col("name").isin("", field)).select(F.col("file_path").alias("f"), "low", "high")
    inside = (F.col("file_path") == F.col("f")) & (F.col("offset") >= F.col("low")) & (F.col("high").isNull() | (F.col("offset") < F.col("high")))
    return items.join(wanted, inside, "left_semi")
