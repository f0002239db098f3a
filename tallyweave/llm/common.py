"""Reading tables, the shared work folder, and helpers that run inside tasks."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def work_path(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one that the session names.

    A cluster must name one (``spark.checkpoint.dir``): a folder of one machine
    would hold only what this machine wrote.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from the files, whatever executors are lost."""
    path = work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def with_types(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; a column that is missing is null.  Extra columns stay outside the operator."""
    have = {n.lower() for n in df.columns}
    return df.select(*[(F.col(f"`{n}`") if n.lower() in have else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def arrow_map(df: DataFrame, function, schema: str, keep: str | None = None) -> DataFrame:
    """``mapInArrow`` with a function from one record batch to any number of dicts of columns.

    ``keep``: the kind of entry of the worker's store that the function uses; entries of other kinds are let go.
    """
    def each(batches):
        for batch in batches:
            yield from function(batch)

    return arrow_stream(df, each, schema, keep)


def arrow_stream(df: DataFrame, function, schema: str, keep: str | None = None) -> DataFrame:
    """Like :func:`arrow_map` with a function from all record batches of a partition, in their order, to dicts of columns.

    Batches of long texts end at ``BATCH_BYTES``: a batch lies in the executor, outside its heap, and in the worker at once.
    """
    df.sparkSession.conf.set(BATCH_KEY, BATCH_BYTES)
    out = T.StructType.fromDDL(schema)
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in out.fields])

    def run(batches):
        store = worker_store()
        for key in [k for k in store if isinstance(k, tuple) and k[0] != keep]:
            del store[key]
        give_back()
        columns = None
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays(
                [columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], type=arrow.field(n).type) for n in arrow.names],
                schema=arrow,
            )
        del columns
        give_back()

    return df.mapInArrow(run, out)


def give_back() -> None:
    """Freed memory goes back to the system, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    simple = {
        "string": pa.string(),
        "int": pa.int32(),
        "bigint": pa.int64(),
        "double": pa.float64(),
        "float": pa.float32(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
        "smallint": pa.int16(),
    }
    return simple[kind.simpleString()]


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Runs of rows whose texts have at most ``most`` bytes together; a longer text stands alone."""
    at = text_offsets(batch.column(column))
    start, rows = 0, batch.num_rows
    while start < rows:
        end = start + 1
        while end < rows and at[end + 1] - at[start] <= most:
            end += 1
        yield batch.slice(start, end - start)
        start = end


def text_offsets(array: pa.Array):
    """Byte offsets of a string array, one more than it has rows; a null has no bytes."""
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)


def worker_store() -> dict:
    """What a Python worker keeps between tasks (a loaded tokenizer, encoded words); every entry can be made anew."""
    name = "_tallyweave_worker_store"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].kept = {}
    return sys.modules[name].kept
