"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, licenses, maxscore, near_dups, packing, pii, quality_model, quality_rules, reversed_search, secrets, spans, warc, whitening
from tallyweave.llm.common import read, work_path


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of at most 2048 tokens, packed best-fit with large items matched first."""
    return packing.pack(packing.tokenized_pieces(read(spark, folder, "documents"), vocabulary(), with_ids=False))


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed patterns and the skip-chain field."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    secret = F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    digest = F.sha2(pii.listed("base"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.listed("spans").alias("spans"), secret, F.size("spans").cast("long").alias("n_spans"))


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Circulant MinHash over four-word shingles, verified at 0.8."""
    return near_dups.near_duplicates(read(spark, folder, "documents"), width=4)


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule statistics judged by an isolation forest."""
    return quality_rules.score_documents(read(spark, folder, "documents"), read(spark, folder, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"
    )


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without sentences that a non-first repeated span covers."""
    return spans.remove_repeated_spans(read(spark, folder, "documents"))


def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """MaxScore for every vec_id divisible by 20 against all other rows."""
    vectors = maxscore.integer_vectors(read(spark, folder, "embeddings"))
    return maxscore.top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Hashed n-gram logistic regression, follow-the-regularised-leader."""
    return quality_model.classify(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Notices found by MinHash bands of windows and exact containment."""
    return licenses.scan(read(spark, folder, "documents"))


def op9_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Ids by merge rounds, and their decoding."""
    docs = read(spark, folder, "documents")
    return bpe.encode_and_decode(docs, vocabulary(), bpe.digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as archives and read back by verified boundary chains."""
    path = work_path(spark, "archives")
    warc.write_archives(warc.plan_records(read(spark, folder, "pages")), path)
    records = warc.read_archives(spark, path)
    return records.select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_number(F.col("refers")).alias("refers_to"),
    )


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item, documents streamed through an index of the items."""
    return reversed_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings on the 16 leading components, by Jacobi-Davidson."""
    return whitening.whiten(read(spark, folder, "embeddings"))


def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed patterns, and strings judged by the owners that hold them."""
    found = secrets.find(read(spark, folder, "documents"))
    counts = [secrets.number(i).alias(f"n_{kind}") for i, kind in enumerate(secrets.KINDS)]
    digest = F.sha2(secrets.listed("base"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secrets.listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), "n_live", "n_examples")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_personal_data,
        op3_near_duplicates,
        op4_quality_rules,
        op5_substring_dedup,
        op6_exact_top_k,
        op7_quality_classifier,
        op8_license_scan,
        op9_bpe_round_trip,
        op10_warc_round_trip,
        op11_ranked_search,
        op12_embedding_whitening,
        op13_secret_scan,
    )
}
