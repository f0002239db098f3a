"""Plan helpers shared by the operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.session import work_folder


def stage(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns that are computed once and never copied into later filters.

    The optimizer moves filters below projections by substituting what a column
    stands for; with deep nested expressions the copies multiply.  A one-row
    ``inline`` produces the same columns behind a boundary it does not cross.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*(keep if keep is not None else ["*"]), made)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work when a scan has fewer splits than cores.

    Scans of cluster size have more splits than cores and stay as they are, and
    so do inputs that come out of a shuffle.
    """
    if df.isStreaming or df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows that each become many, dealt to tasks of bounded size.

    Well packed files have one split for what is exploded to many times its
    bytes; the engine sets the number of tasks by the bytes of the unpacked rows.
    """
    return df.hint("rebalance")


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that is never broadcast.

    The planner judges a table by the bytes of its files.  Rows that are exploded
    from well packed files, or built from them, are many times that size, and a
    broadcast of them goes through the driver.
    """
    return df.hint("merge")


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    Used where several branches need the same costly rows: they then read a
    columnar table, and a lost executor repeats the read and not the work.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table whose size the planner knows.

    Rows handed over one by one become an RDD of unknown size and make a join
    shuffle its other side; an Arrow table becomes a local relation.
    """
    fields = T.StructType.fromDDL(schema).fields
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), ARROW_TYPES[f.dataType.simpleString()]) for c, f in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=[f.name for f in fields]), schema=T.StructType(fields))
