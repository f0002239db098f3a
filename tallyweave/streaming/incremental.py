"""Incremental document ingest: each content is processed once, however often it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators.registry import unseen, with_hash
from tallyweave.session import path_exists, work_folder


def stored_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All registered batches; an empty frame before the first one."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


PREFIX_DIGITS = 1


def earlier_hashes(spark: SparkSession, batch: DataFrame, batch_id: int, registry_path: str, schema) -> DataFrame:
    """Hashes of earlier batches under the prefixes that the batch holds; other prefixes are not read."""
    wanted = [r[0] for r in batch.select("prefix").distinct().collect()]  # at most 16 to the number of digits
    earlier = stored_batches(spark, registry_path, schema)
    return earlier.filter((F.col("batch") < batch_id) & F.col("prefix").isin(wanted)).select("hash")


def register_batch(batch: DataFrame, batch_id: int, registry_path: str, prefix_digits: int = PREFIX_DIGITS) -> None:
    """Register the new contents of one micro-batch.

    The registry lies in folders by batch and by the first digits of the hash.
    The batch writes its own folders and reads only earlier ones, so running it
    again after a failure gives the same files; of those it reads only the ones
    whose digits some row of it has.  ``prefix_digits`` sets the number of folders
    (16 to that power) and must stay the same for a registry.
    """
    spark = batch.sparkSession
    hashed = with_hash(batch.withColumnRenamed("doc_id", "doc_no")).withColumn("prefix", F.left("hash", F.lit(prefix_digits)))
    columns = hashed.select("hash", "doc_id", "source", "doc_no", "prefix")
    schema = T.StructType(columns.drop("prefix").schema.fields).add("batch", "long").add("prefix", "string")
    earlier = earlier_hashes(spark, columns, batch_id, registry_path, schema)
    fresh = unseen(columns, earlier, only_indexed=False, batch_order="doc_no")
    # one file a folder
    fresh.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{registry_path}/batch={batch_id}")


def registry_stream(source: DataFrame, registry_path: str, checkpoint: str):
    """Start the ingest of a stream of documents(doc_id, text, source)."""
    return (
        source.writeStream.foreachBatch(lambda batch, batch_id: register_batch(batch, batch_id, registry_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_registry_stream(spark: SparkSession, source: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Run the ingest over all files there are, in batches of ``files_per_batch`` (all at once if unset), and return the registry."""
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source)
    registry_path = work_folder(spark, "registry")
    registry_stream(stream, registry_path, work_folder(spark, "registry-progress")).awaitTermination()
    return spark.read.parquet(registry_path)
