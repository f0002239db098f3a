"""Session state from a message stream: activity and the last messages of each session.

Every micro-batch is first reduced on its own (partial aggregation, group limit)
and stored as a partition; readers merge the partitions.  A session that takes
a third of all messages costs each task a few rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tallyweave.operators.registry import last_messages, session_activity
from tallyweave.session import work_folder

# The state function runs in Python workers, which need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def reduce_batch(batch: DataFrame, batch_id: int, root: str, limit: int) -> None:
    session_activity(batch).write.mode("overwrite").parquet(f"{root}/activity/batch={batch_id}")
    last_messages(batch, limit).drop("position").write.mode("overwrite").parquet(f"{root}/messages/batch={batch_id}")


def session_stream(messages: DataFrame, root: str, checkpoint: str, limit: int = 20):
    """Start the reduction of a stream of messages(session_id, ts, role, content)."""
    return (
        messages.writeStream.foreachBatch(lambda batch, batch_id: reduce_batch(batch, batch_id, root, limit))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged_activity(spark: SparkSession, root: str) -> DataFrame:
    parts = spark.read.parquet(f"{root}/activity")
    return parts.groupBy("session_id").agg(
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.sum("n_messages").alias("n_messages")
    )


def merged_messages(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    return last_messages(spark.read.parquet(f"{root}/messages").drop("batch"), limit)


def activity_updates(messages: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The same activity as a native streaming aggregation, for update-mode sinks; needs a timestamp ``ts``."""
    return session_activity(messages.withWatermark("ts", lateness))


def run_session_stream(spark: SparkSession, source: str, schema, limit: int = 20, files_per_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Run over all conversation files there are, in batches of ``files_per_batch`` (all at once if unset): ``(activity, last messages)``."""
    reader = spark.readStream.schema(schema)
    raw = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source)
    messages = raw.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ts"), "role", F.col("text").alias("content"))
    root = work_folder(spark, "sessions")
    session_stream(messages, root, work_folder(spark, "sessions-progress"), limit).awaitTermination()
    return merged_activity(spark, root), merged_messages(spark, root, limit)


# ---------------------------------------------------------------- state kept by the engine

# Times are microseconds in the state and in what the function gives back; the engine makes timestamps of them.
STATE = "n_messages bigint, created_at bigint, updated_at bigint, ts array<bigint>, role array<string>, content array<string>"
SESSION = f"session_id {{key}}, {STATE}, closed boolean"
COLUMNS = pd.Index([f.split()[0] for f in SESSION.split(", ")])


def live_sessions(messages: DataFrame, limit: int = 20, lateness: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """Sessions as a stateful stream: activity, the last ``limit`` messages, and the end of sessions.

    ``messages``: session_id, ts (timestamp), role, content.  The state of a session
    is its counts and its last messages, so it stays small however long the
    session is.  Each micro-batch emits the sessions that it touched; a session that
    the watermark leaves behind by ``idle_ms`` is emitted once more as closed and its
    state is dropped.  Messages may come in any order within ``lateness``; later ones are left out.
    """
    key = messages.schema["session_id"].dataType.simpleString()

    def advance(session, batches, state):
        if state.hasTimedOut:
            kept = state.get
            state.remove()
            yield _session_row(session[0], kept, True, key)
            return
        n, first, last, kept = 0, None, None, []
        if state.exists:
            n, first, last, *columns = state.get
            kept = list(zip(*columns))
        reached = state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            # the engine's own filter lags a batch behind and would open closed sessions again
            rows = [(m["us"], m["role"], m["content"]) for m in batch["message"].tolist() if m["us"] >= reached]
            if not rows:
                continue
            n += len(rows)
            # the last of a batch are all that can be among the last of the session
            kept = sorted(kept + rows, key=lambda r: (r[0], str(r[1]), str(r[2])))[-limit:]
            times = [r[0] for r in rows]
            low, high = min(times), max(times)
            first, last = low if first is None else min(first, low), high if last is None else max(last, high)
        if not n:
            return
        done = (n, first, last, *([list(c) for c in zip(*kept)] or [[], [], []]))
        state.update(done)
        state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield _session_row(session[0], done, False, key)

    # one column for the function, as the engine converts each one for each session; ts stays for the engine, which finds the watermark in it
    whole = F.struct(F.unix_micros("ts").alias("us"), "role", "content").alias("message")
    stream = messages.filter("ts IS NOT NULL").select("session_id", "ts", whole).withWatermark("ts", lateness)
    made = stream.groupBy("session_id").applyInPandasWithState(advance, SESSION.format(key=key), STATE, "update", GroupStateTimeout.EventTimeTimeout)
    message = lambda m: F.struct(F.timestamp_micros(m["ts"]).alias("ts"), m["role"].alias("role"), m["content"].alias("content"))
    times = [F.timestamp_micros(c).alias(c) for c in ("created_at", "updated_at")]
    last_messages = F.transform(F.arrays_zip("ts", "role", "content"), message).alias("last_messages")
    return made.select("session_id", *times, "n_messages", last_messages, "closed")


def _session_row(session, kept, closed: bool, key: str) -> pd.DataFrame:
    """One row; of plain objects, as a frame that looks for the kind of each column takes several times as long."""
    values = np.empty((1, len(COLUMNS)), object)
    for i, value in enumerate((session, *kept, closed)):
        values[0, i] = value
    row = pd.DataFrame(values, columns=COLUMNS)
    return row.infer_objects() if key.startswith("timestamp") else row


def live_session_stream(messages: DataFrame, root: str, checkpoint: str, **options):
    """Start :func:`live_sessions`; each micro-batch writes the sessions that it touched as a folder of its own."""
    write = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    stream = live_sessions(messages, **options).writeStream.outputMode("update").foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_sessions(spark: SparkSession, root: str) -> DataFrame:
    """The last row of every session over all micro-batches."""
    rows = spark.read.parquet(root)
    fields = [c for c in rows.columns if c not in ("session_id", "batch")]
    # a batch holds a session once more when it closes
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*fields), F.struct("batch", "closed")).alias("s")).select("session_id", "s.*")


def run_live_sessions(spark: SparkSession, source: str, schema, files_per_batch: int | None = None, **options) -> DataFrame:
    """Run over all message files there are, in batches of ``files_per_batch`` (all at once if unset)."""
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source)
    root = work_folder(spark, "live-sessions")
    live_session_stream(stream, root, work_folder(spark, "live-progress"), **options).awaitTermination()
    return newest_sessions(spark, root)
