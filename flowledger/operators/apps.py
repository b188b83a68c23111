"""Small patterns of applications over the history: outboxes, fan-in, serialization, progress, inventory, approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outbox(mail: DataFrame) -> DataFrame:
    """Messages to send, in order, as they are once sent."""
    return mail.where(~F.col("consumed")).select("message_uuid", F.lit("sent").alias("state")).orderBy("message_uuid")


def fan_in(oo: DataFrame) -> DataFrame:
    """Each workflow's step results in the order the steps were submitted."""
    parts = F.array_sort(F.collect_list(F.struct("function_id", F.coalesce("output", "error").alias("v"))))
    return oo.groupBy("workflow_uuid").agg(F.array_join(F.transform(parts, lambda x: x["v"]), ",").alias("results"))


def overlapping(oo: DataFrame) -> DataFrame:
    """Steps that began before the one before them had ended."""
    before = F.lag("completed_at_epoch_ms").over(Window.partitionBy("workflow_uuid").orderBy("function_id"))
    return oo.select("workflow_uuid", "function_id", "started_at_epoch_ms", before.alias("before")).where(F.col("before") > F.col("started_at_epoch_ms")).select("workflow_uuid", "function_id")


def progress(ws: DataFrame, oo: DataFrame, expected: int) -> DataFrame:
    """Steps that gave a result, that failed, and that are still to come, of ``expected`` each."""
    done = oo.groupBy("workflow_uuid").agg(F.count("output").alias("copied"), F.count("error").alias("skipped"), F.count("*").alias("n"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return ws.join(done, "workflow_uuid", "left").select("workflow_uuid", count("copied").alias("copied"), count("skipped").alias("skipped"), (F.lit(expected) - count("n")).cast("long").alias("remaining"))


def inventory(oo: DataFrame, stock: int) -> DataFrame:
    """Whether each reservation, in order, is within the stock of its product."""
    taken = F.sum(F.lit(1)).over(Window.partitionBy("workflow_uuid", "function_name").orderBy("function_id"))
    return oo.select("workflow_uuid", "function_id", "function_name", (taken <= stock).alias("accepted"))


def stages(events: DataFrame) -> DataFrame:
    """The first value of each (request, stage) and when it came; later ones don't count."""
    return events.groupBy("workflow_uuid", "key").agg(F.min_by("value", "function_id").alias("value"), F.min("at_ms").alias("at_ms"))
