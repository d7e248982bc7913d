"""Rebuilding conversations from message rows with keyed streaming state.

The stream has three stateful stages, all on event time (the instant that a message states) and all in append mode.

1. (session, minute): late and redelivered rows meet in a set of message keys (instant, speaker, hash of the texts); no
   text is kept in state.  When the watermark passes the minute, what it says is emitted: first and last speaker, and
   whether a prompt inside it goes unanswered.
2. (session, day): the minutes of a day, at most 1440, are folded in order by the same associative rule.
3. (session): days are buffered until the session's timeout has passed without another one; then the conversation is
   validated and emitted.  A session that speaks again later is emitted in parts, which are folded when read.

So no group of a stage grows with a session, and one that holds a third of all rows is spread over its minutes.  State is
kept in RocksDB, on disk.  Rows later than the watermark allows would be lost: a run that met any raises.

Defined results for odd input: a null session id is a session of its own; rows that are no messages only show that
their session exists, at the time they arrived; null content, null parts and invisible text make a row no message; equal
(instant, role, texts) are one message; messages of one instant are ordered user first, then by their texts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from loomlog.operators.running import running
from loomlog.storage import materialize, scratch_path

# Spellings of the speakers.
USER, ASSISTANT, IGNORED = ["user", "human"], ["assistant", "model"], ["system", "developer", "tool"]
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"
#: A character that can be seen: no white space, separator, control, format or blank-rendering character.
_VISIBLE = "[^\\s\\p{Z}\\p{Cc}\\p{Cf}\\u034f\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180f\\u2800\\u3164\\ufe00-\\ufe0f\\uffa0]"
_OUTER = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
_END = datetime(9999, 12, 1)
_MARK = "\0punctuation"
#: State on disk, its caches and buffers in a bounded part of each executor's memory, and changes uploaded, not whole stores.
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.numRecentProgressUpdates": "100000",
}

ROWS = "session_id string, at timestamp, state string, instant bigint, answer boolean, hash bigint"
CLOSED = "session_id string, at timestamp, bad boolean, n bigint, first boolean, last boolean, broken boolean, reason string"


class LateRows(RuntimeError):
    """Rows came after the watermark had passed them; the run is void."""


def message_rows(items: DataFrame, with_text: bool = False) -> DataFrame:
    """Each row reduced to what a conversation needs.  state: message, bad (makes its session a case) or none.

    at is the event time: the instant of a message, else the arrival."""
    role = F.lower(F.regexp_replace("payload.role", _OUTER, ""))
    role = F.when(role.isin(USER), "user").when(role.isin(ASSISTANT), "assistant").when(role.isin(IGNORED), "ignored").otherwise("unusable")
    written = F.regexp_replace("timestamp", _OUTER, "")
    stated = F.when(written.rlike(_ISO), written).try_cast("timestamp")
    texts = F.transform("payload.content", lambda p: p["text"])
    visible = F.exists(F.filter(texts, lambda t: t.isNotNull()), lambda t: t.rlike(_VISIBLE))
    is_message = F.coalesce((F.col("type") == "response_item") & (F.col("payload.type") == "message") & visible, F.lit(False))
    rows = items.select("session_id", "received_at", is_message.alias("is_message"), role.alias("role"), stated.alias("stated"), texts.alias("texts"))
    state = (
        F.when(~F.col("is_message") | (F.col("role") == "ignored"), "none")
        .when((F.col("role") == "unusable") | F.col("stated").isNull(), "bad")
        .otherwise("message")
    )
    rows = rows.withColumn("state", state)
    kept = F.col("state") == "message"
    joined = F.array_join(F.filter("texts", lambda t: t.isNotNull()), "\n")
    return rows.select(
        "session_id",
        F.when(kept, F.col("stated")).otherwise(F.coalesce("received_at", "stated", F.current_timestamp())).alias("at"),
        "state",
        F.when(kept, F.unix_micros("stated")).alias("instant"),
        F.when(kept, F.col("role") == "assistant").alias("answer"),
        F.when(kept, F.xxhash64(F.to_json("texts"))).alias("hash"),
        *([F.when(kept, joined).alias("text")] if with_text else []),
    )


# ------------------------------------------------------------------------------------------------ the stream


def _inside(messages: Column) -> list[Column]:
    """n, first, last, broken of an ordered array of messages; speakers are true for the assistant."""
    nexts = F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))
    # zip_with fills up with nulls: the last message has no next one here
    unanswered = F.exists(F.zip_with(messages, nexts, lambda a, b: ~a["answer"] & ~F.coalesce(b["answer"], F.lit(True))), lambda x: x)
    size = F.size(messages)
    return [size.cast("bigint").alias("n"), F.get(messages, F.lit(0))["answer"].alias("first"), F.get(messages, size - 1)["answer"].alias("last"), unanswered.alias("broken")]




def _across(parts: Column) -> list[Column]:
    """first, last, broken of parts that follow each other: broken too if a prompt ends one and no answer begins the next."""
    nexts = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    gap = F.exists(F.zip_with(parts, nexts, lambda a, b: ~a["last"] & ~F.coalesce(b["first"], F.lit(True))), lambda x: x)
    return [F.get(parts, F.lit(0))["first"].alias("first"), F.get(parts, F.size(parts) - 1)["last"].alias("last"), (gap | F.exists(parts, lambda p: p["broken"])).alias("broken")]


def _reason() -> Column:
    """Why a conversation does not stay; null if it does."""
    return F.when(F.col("bad"), "unusable").when(F.col("n") == 0, "empty").when(F.col("first"), "no_prompt").when(F.col("broken") | ~F.col("last"), "no_reply")


def _combined(grouped, *keys: str) -> DataFrame:
    part = F.when(F.col("n") > 0, F.struct("at", "first", "last", "broken"))
    rows = grouped.agg(F.max("bad").alias("bad"), F.sum("n").alias("n"), F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select(*keys, "bad", "n", *_across(F.col("parts")))


def conversations_of(rows: DataFrame, delay: str = "10 days", timeout: str = "7 days") -> DataFrame:
    """Streaming rows of message_rows to validated conversations (CLOSED), each emitted when its timeout has passed."""
    message = F.when(F.col("state") == "message", F.struct("instant", "answer", "hash"))
    minutes = (
        rows.withWatermark("at", delay)
        .groupBy("session_id", F.window("at", "1 minute"))
        .agg(F.max(F.col("state") == "bad").alias("bad"), F.array_sort(F.collect_set(message)).alias("messages"))
        .select("session_id", F.window_time("window").alias("at"), "bad", *_inside(F.col("messages")))
    )
    days = _combined(minutes.groupBy("session_id", F.window("at", "1 day")), "session_id", F.window_time("window").alias("at"))
    whole = _combined(days.groupBy("session_id", F.session_window("at", timeout)), "session_id", F.col("session_window.start").alias("at"))
    return whole.withColumn("reason", _reason())


def run(spark: SparkSession, path: str, files_per_batch: int | None = None, delay: str = "10 days", timeout: str = "7 days") -> DataFrame:
    """Runs a finished table through the stream and returns what it emits.

    By default all files form one micro-batch, so that no row can be late.  A punctuation row far in the future, which
    belongs to no session, then moves the watermark past every timeout and closes all keys."""
    base = scratch_path(spark, "conversations")
    schema = spark.read.parquet(path).schema
    mark = spark.range(1).select(
        F.lit(_MARK).alias("session_id"), F.lit(_END).alias("at"), F.lit("none").alias("state"),
        F.lit(None).cast("bigint").alias("instant"), F.lit(None).cast("boolean").alias("answer"), F.lit(None).cast("bigint").alias("hash"),
    )
    before = {k: spark.conf.get(k, None) for k in _STATE_STORE}
    for k, v in _STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        # a pattern, as the stream takes a plain path for a folder only
        rows = message_rows(reader.parquet(f"{path[:-1]}[{path[-1]}]"))
        mark.where("false" if files_per_batch else "true").write.parquet(f"{base}/mark")
        rows = rows.unionByName(spark.readStream.schema(ROWS).parquet(f"{base}/mark"))
        for first in (True, False) if files_per_batch else (True,):
            if not first:  # all small batches are done: the mark follows in a run of its own over the same state
                mark.write.mode("append").parquet(f"{base}/mark")
            query = (
                conversations_of(rows, delay, timeout)
                .writeStream.format("parquet")
                .option("path", f"{base}/closed")
                .option("checkpointLocation", f"{base}/state")
                .outputMode("append")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
            late = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
            if late:
                raise LateRows(f"{late} rows came more than {delay} late; run again with a longer delay")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(CLOSED).parquet(f"{base}/closed").where(F.col("session_id").isNull() | (F.col("session_id") != _MARK))


def verdicts(closed: DataFrame) -> DataFrame:
    """session_id, keep, reason: what the stream emitted, parts of one session folded in order.

    Reasons: unusable, empty, no_prompt, no_reply."""
    return _combined(closed.groupBy("session_id"), "session_id").select("session_id", _reason().alias("reason")).withColumn("keep", F.col("reason").isNull())


def found(spark: SparkSession, path: str) -> DataFrame:
    """Sessions to drop."""
    return verdicts(run(spark, path)).where("not keep").select("session_id")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """session_id, position, instant, role, text of the conversations that stay, in order.

    The stream says which stay; their texts, which it never held, come from the table."""
    kept = verdicts(run(spark, path)).where("keep").select(F.col("session_id").alias("kept"))
    rows = message_rows(spark.read.parquet(path), with_text=True).where("state = 'message'")
    rows = rows.join(kept, F.col("session_id").eqNullSafe(F.col("kept")), "left_semi")
    once = materialize(rows.groupBy("session_id", "instant", "answer", "hash").agg(F.min("text").alias("text")), "messages")
    # blocks of a day; messages of one instant are few
    before = running(once, ["session_id"], "instant", {"before": ("sum", F.lit(1).cast("bigint"))}, before_only=True, block=86_400_000_000)
    tie = F.row_number().over(W.partitionBy("session_id", "instant").orderBy("answer", "text", "hash"))
    return before.select(
        "session_id", (F.coalesce("before", F.lit(0)) + tie - 1).cast("bigint").alias("position"), F.col("instant").alias("instant_us"), F.when(F.col("answer"), "assistant").otherwise("user").alias("role"), "text"
    )
