"""Document registry, sessions and the question store as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import strip


def with_hash(docs: DataFrame, content: str = "text") -> DataFrame:
    """SHA-256 of the content and the document id made of its first 32 digits."""
    return docs.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256)).withColumn(
        "doc_id", F.substring("hash", 1, 32)
    )


def last_write_wins(rows: DataFrame, key: str | list[str], order: Column | str) -> DataFrame:
    """One row per key, the one that comes last; partial aggregation keeps hot keys small."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def upsert_documents(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry after writing ``incoming``; both have doc_id, path, hash, status, num_chunks, updated_at."""
    both = registry.withColumn("_seq", F.lit(0)).unionByName(incoming.withColumn("_seq", F.lit(1)))
    return last_write_wins(both, "doc_id", F.struct("_seq", "updated_at", "path")).drop("_seq")


def unseen(docs: DataFrame, registry: DataFrame, only_indexed: bool = True, batch_order: str | None = None) -> DataFrame:
    """Documents whose content is not in the registry yet.

    ``only_indexed`` skips contents that were indexed; otherwise any known hash
    is skipped.  With ``batch_order`` the first copy within the batch is kept.
    """
    known = registry.filter("status = 'indexed'") if only_indexed else registry
    fresh = docs.join(known.select("hash").distinct(), "hash", "left_anti")
    if batch_order is None:
        return fresh
    rest = [c for c in fresh.columns if c != "hash"]
    first = fresh.groupBy("hash").agg(F.min_by(F.struct(*rest), batch_order).alias("_r"))
    return first.select("hash", "_r.*").select(*fresh.columns)


def index_status(num_chunks: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), F.lit("failed")).when(num_chunks == 0, F.lit("empty")).otherwise(F.lit("indexed"))


def first_success(tried: DataFrame, order: str, key: str = "hash") -> DataFrame:
    """(key, first_order) of the first row of each content that was indexed.

    One partial aggregation: a content with many copies leaves each task as one row.
    """
    won = tried.filter("status = 'indexed'")
    return won.groupBy(key).agg(F.min(order).alias("first_order"))


def skip_copies(tried: DataFrame, order: str, key: str = "hash") -> DataFrame:
    """What a run that takes documents one by one, by ``order``, does with copies.

    ``tried`` holds for each document the status it has if it is processed.
    After the first copy that was indexed the rest are skipped; after a failed
    or empty one the next copy is tried.  Needs the columns status, num_chunks
    and error; a row without ``key`` has no copies.
    """
    late = F.col("first_order") < F.col(order)
    done = tried.join(first_success(tried, order, key), key, "left").withColumns(
        {
            "num_chunks": F.when(late, F.lit(0)).otherwise(F.col("num_chunks")),
            "error": F.when(~F.coalesce(late, F.lit(False)), F.col("error")),
            "status": F.when(late, F.lit("skipped")).otherwise(F.col("status")),
        }
    )
    return done.select(*tried.columns)


def index_summary(outcome: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of indexed, skipped, empty and failed documents; failures are listed by :func:`index_errors`."""
    return outcome.groupBy(*(by or [])).agg(
        F.count_if(F.col("status") == "indexed").alias("indexed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "empty").alias("empty"),
        F.count_if(F.col("status") == "failed").alias("errors"),
    )


def index_errors(outcome: DataFrame) -> DataFrame:
    return outcome.filter("status = 'failed'").select(F.concat_ws(": ", "path", "error").alias("error"))


def registry_health(registry: DataFrame, latest: int = 5) -> DataFrame:
    """The most recent documents with the number of all documents beside each."""
    newest = registry.orderBy(F.desc("updated_at"), F.desc("doc_id")).limit(latest)
    total = registry.agg(F.count("*")).scalar()
    return newest.select("doc_id", "path", "status", "num_chunks", total.alias("n_documents"))


def session_activity(messages: DataFrame, at: str = "ts") -> DataFrame:
    """First and last activity and number of messages per session."""
    return messages.groupBy("session_id").agg(
        F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.count("*").alias("n_messages")
    )


def last_messages(messages: DataFrame, limit: int = 20, at: str = "ts") -> DataFrame:
    """The last messages of each session, numbered in time order.

    The ranking filter is pushed below the shuffle as a group limit, so each
    task sends at most ``limit`` rows of a session.
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc(at))
    ranked = messages.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= limit)
    oldest = Window.partitionBy("session_id").orderBy(at)
    return ranked.withColumn("position", F.row_number().over(oldest)).drop("_back")


def latest_user_query(messages: DataFrame, at: str = "ts", content: str = "content") -> DataFrame:
    """Trimmed text of the last user message of each session."""
    return (
        messages.filter("role = 'user'")
        .groupBy("session_id")
        .agg(strip(F.max_by(content, at)).alias("query"))
    )


def payload_query(payload: Column) -> Column:
    """Query of a chat payload: the top-level message, else the newest user turn with text.

    ``payload`` is ``struct<message:string, messages:array<struct<role:string,
    content:string, items:array<struct<type:string,text:string>>>>>``; a turn has
    either ``content`` or ``items``.
    """
    users = F.reverse(F.filter(payload["messages"], lambda m: m["role"] == "user"))
    texts = F.transform(
        users,
        lambda m: F.when(m["content"].isNotNull(), m["content"]).otherwise(
            F.nullif(
                F.array_join(
                    F.transform(
                        F.filter(m["items"], lambda i: (i["type"] == "text") & (F.coalesce(i["text"], F.lit("")) != "")),
                        lambda i: i["text"],
                    ),
                    " ",
                ),
                F.lit(""),
            )
        ),
    )
    newest = F.get(F.filter(texts, lambda t: t.isNotNull()), 0)
    return strip(F.coalesce(payload["message"], newest, F.lit("")))


def upsert_questions(stored: DataFrame, incoming: DataFrame, order: str = "created_at") -> DataFrame:
    """Question store after writing ``incoming``: last write wins, the first creation time stays.

    Any incoming row is a later write than the stored one, whatever their times.
    Incoming rows are written by ``order``, equal ones by their texts.
    """
    rest = ["doc_id", "question", "answer", "raw_json"]
    columns = ["qa_id", "created_at", *rest]
    written = incoming.select(*columns, F.lit(1).alias("_write"), F.col(order).alias("_at"))
    kept = stored.select(*columns, F.lit(0).alias("_write"), F.lit(None).cast(written.schema["_at"].dataType).alias("_at"))
    both = kept.unionByName(written)
    return (
        both.groupBy("qa_id")
        .agg(F.max(F.struct("_write", "_at", *rest)).alias("r"), F.min("created_at").alias("created_at"))
        .select("qa_id", *[f"r.{c}" for c in rest], "created_at")
    )
