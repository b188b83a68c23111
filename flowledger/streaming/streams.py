"""Structured Streaming forms of the log operators, and native event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import payload
from ..operators.eventlog import CHANNELS


def log_source(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_messages(stream: DataFrame, at: str, delay: str = "1 hour") -> DataFrame:
    """Each message id once, within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(["message_uuid"])


def latest(stream: DataFrame) -> DataFrame:
    """The current value of each (workflow, key); complete or update mode."""
    return stream.groupBy("workflow_uuid", "key").agg(F.max_by("value", "function_id").alias("value"))


def tumbling(stream: DataFrame, at: str, size: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("count"))


def sessions(stream: DataFrame, at: str, gap: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("count"))


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Everything available now, appended as Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notifications(stream: DataFrame, table: str) -> DataFrame:
    """Stream of (channel, payload) from the rows appended to a log table, as ``eventlog.change_feeds`` gives between snapshots."""
    channel, columns, _, _ = CHANNELS[table]
    return stream.select(F.lit(channel).alias("channel"), payload(*columns).alias("payload"))


def receive(requests_and_messages: DataFrame, timeout_column: str = "deadline_ms") -> DataFrame:
    """Stream of (destination, topic, kind: wait or message, at, deadline_ms, message) → each wait's message, or a timeout.

    State of one (destination, topic): messages not consumed, in order, and the
    waits that are open.  Messages and waits meet in order of time; a message that
    comes after a wait's deadline doesn't answer it.  Event time drives the
    timeouts: a wait whose deadline the watermark has passed ends when its key has
    rows, or else by a timer.
    """
    from collections import deque

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out = "destination string, topic string, outcome string, message string"

    def step(key, frames, state: GroupState):
        waits, box = (deque(x) for x in state.get) if state.exists else (deque(), deque())
        rows, mark = [], state.getCurrentWatermarkMs()

        def expire(until: int) -> None:
            for deadline in [w for w in waits if w < until]:
                waits.remove(deadline)
                rows.append((*key, "timeout", None))

        if not state.hasTimedOut:
            events = pd.concat(list(frames)).sort_values("at", kind="stable")
            for kind, at, deadline, message in events[["kind", "at", timeout_column, "message"]].itertuples(index=False, name=None):
                if kind == "wait":
                    waits.append(int(deadline))
                else:
                    expire(int(at))
                    box.append(message)
                while waits and box:
                    waits.popleft()
                    rows.append((*key, "message", box.popleft()))
        expire(mark)
        state.update((list(waits), list(box)))
        if waits:
            state.setTimeoutTimestamp(max(min(waits), mark) + 1)
        yield pd.DataFrame(rows, columns=["destination", "topic", "outcome", "message"])

    return requests_and_messages.groupBy("destination", "topic").applyInPandasWithState(step, out, "waits array<bigint>, box array<string>", "append", GroupStateTimeout.EventTimeTimeout)
