"""Message streams: the same rules as column expressions in batch, and as Structured Streaming with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.functions.strings import contains_folded

#: Messages and seconds after which a session's buffer is extracted.
COUNT_TRIGGER, SECONDS_TRIGGER = 50, 5
TRIGGER_EVENTS = ("error", "decision", "task_complete", "session_end")


def body(msg_type: Column) -> Column:
    """The text of a message by its type; sensor readings become ``sensor: key=value`` in key order, control messages have none."""
    values = F.array_join(F.transform(F.array_sort(F.map_entries("sensor_values")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    reading = F.concat(F.coalesce("sensor_id", F.lit("sensor")), F.lit(": "), values)
    event = F.concat_ws(": ", "event_name", "description")
    return F.when(msg_type == "content", F.col("content")).when(msg_type == "sensor", F.when(F.size("sensor_values") > 0, reading)).when(msg_type == "event", F.when(F.length(event) > 0, event))


def mode(msg_type: Column) -> Column:
    return F.when(msg_type == "content", "conversation").when(msg_type == "sensor", "sensor").when(msg_type == "event", "event")


def importance(text: Column, kind: Column) -> Column:
    """Base 0.5, more for long texts, questions, code and errors, less for short ones; sensors 0.4; in [0, 1]."""
    count = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    length = F.when(count > 50, 0.1).when(count < 10, -0.1).otherwise(0.0)
    code = text.contains("```") | text.contains("fn ") | text.contains("def ")
    fault = contains_folded(text, "error") | contains_folded(text, "failed")
    talk = F.when(text.contains("?"), 0.15).otherwise(0.0) + F.when(code, 0.2).otherwise(0.0) + F.when(fault, 0.2).otherwise(0.0)
    event = F.when(contains_folded(text, "error"), 0.3).when(contains_folded(text, "warning"), 0.15).otherwise(0.0)
    score = F.when(kind == "sensor", 0.4).when(kind == "event", 0.5 + length + event).otherwise(0.5 + length + talk)
    return F.when(text.isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def memory_type(tags: Column, kind: Column) -> Column:
    """The first tag that names a type decides, else the mode."""
    pick = lambda t: F.when(contains_folded(t, "error"), "Error").when(contains_folded(t, "decision"), "Decision").when(contains_folded(t, "learning"), "Learning").when(contains_folded(t, "discovery"), "Discovery")
    first = F.get(F.filter(F.transform(tags, pick), lambda x: x.isNotNull()), 0)
    return F.coalesce(first, F.when(kind == "conversation", "Conversation").otherwise("Observation"))


def content_key(text: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(text)))


def extracted(messages: DataFrame) -> DataFrame:
    """Batch: one memory per distinct text of a session (the first by time), with importance and type; messages without text give none."""
    m = messages.withColumn("text", body(F.col("msg_type"))).where("length(trim(text)) > 0").withColumn("kind", mode(F.col("msg_type")))
    first = F.row_number().over(Window.partitionBy("session_id", content_key(F.col("text"))).orderBy("ts", "msg_id"))
    return m.withColumn("_n", first).where("_n = 1").select(
        "msg_id", "session_id", "user_id", "ts", "text", F.coalesce(F.col("importance").cast("double"), importance(F.col("text"), F.col("kind"))).alias("importance"), memory_type(F.col("tags"), F.col("kind")).alias("memory_type")
    )


def batches_by_count(messages: DataFrame, count: int = COUNT_TRIGGER) -> DataFrame:
    """Adds ``batch``: messages of a session are cut after every ``count`` and after a flush, close or trigger event."""
    w = Window.partitionBy("session_id").orderBy("ts", "msg_id")
    cut = F.col("msg_type").isin("flush", "close") | ((F.col("msg_type") == "event") & F.coalesce(F.col("event_name").isin(*TRIGGER_EVENTS), F.lit(False)))
    forced = messages.withColumn("_f", F.coalesce(F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("session_id", "_f").orderBy("ts", "msg_id")) - 1
    return forced.withColumn("_k", F.floor(place / count)).withColumn("batch", F.dense_rank().over(Window.partitionBy("session_id").orderBy("_f", "_k"))).drop("_f", "_k")


def windowed_counts(stream: DataFrame, late: str = "30 days", width: str = "1 hour") -> DataFrame:
    """Event-time windows with a watermark: works on a stream and on a batch alike."""
    kept = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["msg_id"]) if stream.isStreaming else stream.dropDuplicates(["msg_id"])
    return kept.groupBy(F.window("ts", width), "msg_type").agg(F.count("*").alias("n"))


_STATE = "buffered int, first_us long, seen array<long>"
_OUT = "session_id string, batch int, messages int, duplicates int, text string"


def _extract(most_seen: int, count: int, idle_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffered, batch, seen = state.get if state.exists else (0, 0, [])
        known, out, held, dropped = dict.fromkeys(seen), [], [], 0
        rows = pd.concat(list(frames)) if not state.hasTimedOut else pd.DataFrame(columns=["ts", "msg_id", "msg_type", "text", "hash", "cut"])
        for r in rows.sort_values(["ts", "msg_id"]).itertuples():
            if r.text and pd.notna(r.hash):
                if int(r.hash) in known:
                    dropped += 1
                else:
                    known[int(r.hash)] = None
                    held.append(r.text)
                    buffered += 1
            if r.cut or buffered >= count:
                if held:
                    out.append((key[0], int(batch), len(held), dropped, "\n".join(held)))
                    batch += 1
                held, dropped, buffered = [], 0, 0
        if held:  # a micro-batch ends: what is buffered is handed on, as the time trigger would
            out.append((key[0], int(batch), len(held), dropped, "\n".join(held)))
            batch += 1
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((0, int(batch), list(known)[-most_seen:]))
            last = int(rows["ts"].max().timestamp() * 1000) + idle_ms
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "batch", "messages", "duplicates", "text"])

    return run


def session_extractor(stream: DataFrame, most_seen: int = 10_000, count: int = COUNT_TRIGGER, late: str = "30 days", idle_ms: int = 86_400_000) -> DataFrame:
    """Stateful extraction per session: exact duplicates (of the last ``most_seen`` texts) dropped, texts joined, cut by count, by
    control messages and by trigger events. State is bounded per session and ends when the watermark is ``idle_ms`` past its last message."""
    cut = F.col("msg_type").isin("flush", "close") | ((F.col("msg_type") == "event") & F.coalesce(F.col("event_name").isin(*TRIGGER_EVENTS), F.lit(False)))
    shown = stream.select("session_id", "ts", "msg_id", "msg_type", body(F.col("msg_type")).alias("text"), cut.alias("cut")).withColumn("hash", content_key(F.col("text")))
    shown = shown.where("ts is not null").withWatermark("ts", late)
    return shown.groupBy("session_id").applyInPandasWithState(_extract(most_seen, count, idle_ms), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay(spark: SparkSession, folder: str, name: str, transform, mode: str = "append") -> DataFrame:
    """Run a streaming transform over a Parquet file to its end and return the rows it produced."""
    import os
    import uuid

    from palimpsest.runtime import shared_folder

    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    stream = stream.parquet(path) if os.path.isdir(path) else stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    df = transform(stream)
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").start()
    else:
        keys = [c for c in df.columns]

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

        query = df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode).start()
        del keys
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")
