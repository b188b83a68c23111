"""Event-log folds, mailboxes and ordered streams in batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import payload
from ..schema import CLOSED, NULL_TOPIC


def latest_events(history: DataFrame) -> DataFrame:
    """The current value of each (workflow, key): an aggregate, so nothing is sorted."""
    return history.groupBy("workflow_uuid", "key").agg(F.max_by("value", "function_id").alias("value"), F.max("function_id").alias("function_id"))


def latest_before(history: DataFrame, step: int) -> DataFrame:
    w = Window.partitionBy("workflow_uuid", "key").orderBy(F.col("function_id").desc())
    return history.where(F.col("function_id") < step).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("workflow_uuid", "key", "value")


def step_ids(log: DataFrame, order: list[str]) -> DataFrame:
    return log.withColumn("function_id", (F.row_number().over(Window.partitionBy("workflow_uuid").orderBy(*order)) - 1).cast("long"))


def mailbox_heads(mail: DataFrame) -> DataFrame:
    """The oldest unread message of each (destination, topic)."""
    first = F.min_by(F.struct("message_uuid", "message"), F.struct("created_at_epoch_ms", "message_uuid"))
    return mail.where(~F.col("consumed")).groupBy("destination_uuid", "topic").agg(first.alias("m")).select("destination_uuid", "topic", "m.message_uuid", "m.message")


def consume(mail: DataFrame) -> DataFrame:
    """The mailbox after each head is read: marked, never dropped."""
    heads = mailbox_heads(mail).select("message_uuid", F.lit(True).alias("_read"))
    return mail.join(heads, "message_uuid", "left").withColumn("consumed", F.col("consumed") | F.coalesce("_read", F.lit(False))).drop("_read")


def waiting(ws: DataFrame, mail: DataFrame) -> DataFrame:
    """Workflows with an unread message."""
    return ws.join(mail.where(~F.col("consumed")), F.col("workflow_uuid") == F.col("destination_uuid"), "left_semi").select("workflow_uuid")


def send(mail: DataFrame, incoming: DataFrame, ws: DataFrame) -> DataFrame:
    """New messages that may be appended: known destination, unseen id, a topic for those without."""
    own = incoming.withColumn("topic", F.coalesce("topic", F.lit(NULL_TOPIC)))
    return own.join(ws.select(F.col("workflow_uuid").alias("destination_uuid")), "destination_uuid", "left_semi").join(mail, "message_uuid", "left_anti").dropDuplicates(["message_uuid"])


def closed_at(streams: DataFrame) -> DataFrame:
    return streams.where(F.col("value") == CLOSED).groupBy("workflow_uuid", "key").agg(F.min("offset").alias("close_offset"))


def readable(streams: DataFrame) -> DataFrame:
    """Stream rows before each stream's first close mark."""
    return streams.join(closed_at(streams), ["workflow_uuid", "key"], "left").where(F.col("close_offset").isNull() | (F.col("offset") < F.col("close_offset"))).drop("close_offset")


def pages(streams: DataFrame, start: int) -> DataFrame:
    """By stream, from ``start`` on: number of values, next offset, whether closed."""
    own = streams.where(F.col("offset") >= start).join(closed_at(streams.where(F.col("offset") >= start)), ["workflow_uuid", "key"], "left")
    seen = own.where(F.col("close_offset").isNull() | (F.col("offset") <= F.col("close_offset")))
    return seen.groupBy("workflow_uuid", "key").agg(F.count(F.when(F.col("value") != CLOSED, 1)).alias("n_values"), (F.max("offset") + 1).cast("long").alias("next_offset"), (F.max(F.col("value") == CLOSED)).alias("closed"))


def next_offsets(streams: DataFrame) -> DataFrame:
    return streams.groupBy("workflow_uuid", "key").agg((F.max("offset") + 1).cast("long").alias("next_offset"))


def append(streams: DataFrame, incoming: DataFrame) -> DataFrame:
    """Gap-free offsets for incoming (workflow_uuid, key, seq, value); rows for closed streams, and rows after a close mark of the batch, are refused."""
    base = next_offsets(streams)
    open_ = incoming.join(closed_at(streams), ["workflow_uuid", "key"], "left_anti").join(base, ["workflow_uuid", "key"], "left")
    w = Window.partitionBy("workflow_uuid", "key").orderBy("seq")
    before = F.coalesce(F.max(F.col("value") == CLOSED).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    placed = open_.withColumns({"_late": before, "offset": (F.coalesce("next_offset", F.lit(0)) + F.row_number().over(w) - 1).cast("long")})
    return placed.where(~F.col("_late")).select("workflow_uuid", "key", "offset", "value")


def halted_streams(streams: DataFrame, ws: DataFrame) -> DataFrame:
    """Streams that end for their readers: closed, or their workflow no longer runs."""
    halted = ws.where(~F.col("status").isin("PENDING", "ENQUEUED", "DELAYED")).select("workflow_uuid", F.lit(True).alias("_halted"))
    return pages(streams, 0).join(halted, "workflow_uuid", "left").select("workflow_uuid", "key", (F.col("closed") | F.coalesce("_halted", F.lit(False))).alias("ends"))


def change_feed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(channel, payload) between two snapshots of workflow_status: ids whose status changed, and ``status::queue`` to wake queues, each once."""
    o = old.select("workflow_uuid", F.col("status").alias("s0"), F.col("queue_name").alias("q0"), F.col("delay_until_epoch_ms").alias("d0"))
    both = new.select("workflow_uuid", "status", "queue_name", "delay_until_epoch_ms").join(o, "workflow_uuid", "left")
    moved = ~F.col("status").eqNullSafe(F.col("s0"))
    state = both.where(moved).select(F.lit("status").alias("channel"), F.col("workflow_uuid").alias("payload"))
    wake = F.col("status").isin("ENQUEUED", "DELAYED") & F.col("queue_name").isNotNull() & (moved | ~F.col("queue_name").eqNullSafe(F.col("q0")) | ~F.col("delay_until_epoch_ms").eqNullSafe(F.col("d0")))
    return state.unionByName(both.where(wake).select(F.lit("queue").alias("channel"), payload("status", "queue_name").alias("payload")).distinct())


#: By table: the channel, the columns of the payload, the key, and whether changed rows are announced too.
CHANNELS = {
    "notifications": ("recv", ("destination_uuid", "topic"), ["message_uuid"], False),
    "workflow_events": ("event", ("workflow_uuid", "key"), ["workflow_uuid", "key"], True),
    "streams": ("stream", ("workflow_uuid", "key"), ["workflow_uuid", "key", "offset"], False),
}


def change_feeds(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(channel, payload) of all tables in both: status, queue, recv (a message), event (set or set again) and stream (a value); each payload once.

    Notifications name a place and never a value, so announcing one twice says nothing more.
    """
    parts = [change_feed(old["workflow_status"], new["workflow_status"])] if "workflow_status" in new else []
    for table, (channel, columns, key, updates) in CHANNELS.items():
        if table in new:
            same = [*key, "value"] if updates else key
            fresh = new[table].join(old[table].select(*same), same, "left_anti")
            parts.append(fresh.select(F.lit(channel).alias("channel"), payload(*columns).alias("payload")).distinct())
    return reduce(DataFrame.unionByName, parts)
