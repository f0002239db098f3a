"""A bounded, repeatable sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import with_types


def held_out(doc_id) -> F.Column:
    """Documents kept from every training: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(True))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, quality of all labelled ids that are not held out.

    Labels other than 0 and 1 and null ids are left out; an id labelled twice
    counts once, with its lowest label.
    """
    labels = with_types(labels, doc_id="bigint", quality="int").filter("doc_id is not null and quality in (0, 1)")
    return labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, quality of at most ``most`` ids of :func:`labelled`, chosen by a hash of the id."""
    chosen = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # bounded by the parameter, so every task can have it
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
