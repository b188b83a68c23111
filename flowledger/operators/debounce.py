"""Debouncing: calls of one key replace each other until the delay or deadline has passed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "key string, first_ms long, fires_ms long, calls long, input string"


def debounced(calls: DataFrame, deadline_ms: int | None = None) -> DataFrame:
    """calls(key, at_ms, period_ms, input) → the workflows they become, one a burst.

    The first call waits its period; each call before that has passed moves the
    time to now + its period (earlier, too), the deadline at most, and replaces
    the input.  A fold in order of time: keys are sorted within their partition
    and streamed, so no key is held in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = first = fires = last_input = None
        n, rows = 0, []
        for batch in batches:
            for k, at, period, value in batch[["key", "at_ms", "period_ms", "input"]].itertuples(index=False, name=None):
                if n and (k != key or at >= fires):
                    rows.append((key, first, fires, n, last_input))
                    n = 0
                if not n:
                    key, first = k, at
                fires = at + period if deadline_ms is None else min(at + period, first + deadline_ms)
                last_input, n = value, n + 1
            if rows:
                yield pd.DataFrame(rows, columns=["key", "first_ms", "fires_ms", "calls", "input"])
                rows = []
        if n:
            yield pd.DataFrame([(key, first, fires, n, last_input)], columns=["key", "first_ms", "fires_ms", "calls", "input"])

    ordered = calls.select("key", "at_ms", "period_ms", "input").repartition("key").sortWithinPartitions("key", "at_ms", "input")
    return ordered.mapInPandas(run, RESULT)


def debounced_constant(calls: DataFrame, period_ms: int) -> DataFrame:
    """The same for one period and no deadline, where it is gaps between calls: window functions only."""
    w = Window.partitionBy("key").orderBy("at_ms", "input")
    starts = calls.withColumn("new", F.coalesce((F.col("at_ms") - F.lag("at_ms").over(w) >= period_ms).cast("int"), F.lit(1)))
    return starts.withColumn("burst", F.sum("new").over(w)).groupBy("key", "burst").agg(F.min("at_ms").alias("first_ms"), (F.max("at_ms") + period_ms).alias("fires_ms"), F.count("*").alias("calls"), F.max_by("input", F.struct("at_ms", "input")).alias("input")).drop("burst")


def holder_conflicts(calls: DataFrame, ws: DataFrame) -> DataFrame:
    """What each of calls(call, name, queue_name, key) meets: fresh, bounced (on a debounced holder of its own name), or duplicate; with the holder.

    A holder that was not debounced, or has another name, refuses the call.
    """
    held = ws.where(F.col("queue_name").isNotNull() & F.col("deduplication_id").isNotNull()).select("queue_name", F.col("deduplication_id").alias("key"), F.col("workflow_uuid").alias("holder"), F.col("is_debounced").alias("_debounced"), F.col("name").alias("_name"))
    both = calls.join(held, ["queue_name", "key"], "left")
    answer = F.when(F.col("holder").isNull(), "fresh").when(F.col("_debounced") & (F.col("_name") == F.col("name")), "bounced").otherwise("duplicate")
    return both.select("call", answer.alias("answer"), "holder")
