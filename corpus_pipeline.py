"""Corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import near_dups, packing, pii, quality_rules, spans
from tallyweave.llm.common import is_empty, read, work_path
from tallyweave.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRY = {"lang": "string", "source": "string", "n_chars": "bigint"}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep."""
    judged = quality_rules.score_documents(docs, read(spark, sf_dir, "labels"), carry=CARRY | {"text": "string"})
    return judged.filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on five-word shingles at 0.8.

    Rows that share a doc_id stay together if one of them stays; rows that
    repeat both doc_id and text become one.
    """
    judged = near_dups.near_duplicates(docs, width=5)
    gone = judged.filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    stays = judged.filter("kept").select(F.col("doc_id").alias("stays")).distinct()
    gone = gone.join(stays, F.col("gone").eqNullSafe(F.col("stays")), "left_anti")
    kept = docs.select(*COLUMNS).join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")
    version = F.xxhash64("text")
    if not is_empty(docs.groupBy("doc_id", version.alias("version")).agg(F.count("*").alias("n")).filter("n > 1")):
        kept = kept.withColumn("version", version).dropDuplicates(["doc_id", "version"])
    return kept.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less their repeated passages; documents of which nothing is left go."""
    cleaned = spans.remove_repeated_spans(docs, carry={"lang": "string", "source": "string"})
    left = cleaned.filter("n_removed = 0 or n_removed < n_sentences")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind."""
    carry = {"lang": "string", "source": "string"}
    cleaned = pii.find_and_mask(docs, pii.learn(docs.select("doc_id", "text")), carry)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all pieces with their places in sequences of 2048."""
    return packing.pack(packing.tokenized_pieces(docs, vocabulary(), known_words=100_000))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
