"""Point lookups and small predicates, for many keys at once where the reference asks for one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import STEP_COLUMNS


def workflow(ws: DataFrame, workflow_id: str) -> DataFrame:
    return ws.where(F.col("workflow_uuid") == workflow_id)


def steps(oo: DataFrame, workflow_id: str) -> DataFrame:
    have = [c for c in STEP_COLUMNS if c in oo.columns]
    return oo.where(F.col("workflow_uuid") == workflow_id).select(*have).orderBy("function_id")


def results(ws: DataFrame) -> DataFrame:
    """Outcome kind and value: what has no final state, CANCELLING included, is pending."""
    s = F.col("status")
    kind = F.when(s == "SUCCESS", "output").when(s == "ERROR", "error").when(s == "CANCELLED", "cancelled").when(s == "MAX_RECOVERY_ATTEMPTS_EXCEEDED", "max_recovery_attempts_exceeded").otherwise("pending")
    return ws.select("workflow_uuid", kind.alias("kind"), F.when(s == "SUCCESS", F.col("output")).when(s == "ERROR", F.col("error")).alias("value"))


def deduplicated(ws: DataFrame, queue: str, dedup: str) -> DataFrame:
    return ws.where((F.col("queue_name") == queue) & (F.col("deduplication_id") == dedup)).select("workflow_uuid")


def debounce_holders(ws: DataFrame) -> DataFrame:
    return ws.where(F.col("queue_name").isNotNull() & F.col("deduplication_id").isNotNull()).select("queue_name", "deduplication_id", "workflow_uuid", "is_debounced", "name")


def check_children(asked: DataFrame, oo: DataFrame) -> DataFrame:
    """asked(workflow_uuid, function_id, function_name) → none, existing or mismatch, with the child."""
    recorded = oo.select("workflow_uuid", "function_id", F.col("function_name").alias("recorded"), "child_workflow_id")
    return asked.join(recorded, ["workflow_uuid", "function_id"], "left").select(
        "workflow_uuid", "function_id",
        F.when(F.col("recorded").isNull(), "none").when(F.col("recorded") != F.col("function_name"), "mismatch").when(F.col("child_workflow_id").isNull(), "none").otherwise("existing").alias("answer"),
        F.when(F.col("recorded") == F.col("function_name"), F.col("child_workflow_id")).alias("child"),
    )


def check_executions(asked: DataFrame, ws: DataFrame, oo: DataFrame) -> DataFrame:
    """What a step about to run finds, in this order: no workflow, cancelled, cancelling, no record, another name, a value, a failure."""
    state = ws.select("workflow_uuid", "status")
    recorded = oo.select("workflow_uuid", "function_id", F.col("function_name").alias("recorded"), "error")
    answer = (
        F.when(F.col("status").isNull(), "nonexistent_workflow").when(F.col("status") == "CANCELLED", "cancelled").when(F.col("status") == "CANCELLING", "cancelling")
        .when(F.col("recorded").isNull(), "none").when(F.col("recorded") != F.col("function_name"), "unexpected_step").when(F.col("error").isNotNull(), "replay_failure").otherwise("replay")
    )
    return asked.join(state, "workflow_uuid", "left").join(recorded, ["workflow_uuid", "function_id"], "left").select("workflow_uuid", "function_id", answer.alias("answer"))


def _same_step(asked: DataFrame, oo: DataFrame) -> DataFrame:
    recorded = oo.select("workflow_uuid", "function_id", F.col("function_name").alias("recorded"))
    return asked.join(recorded, ["workflow_uuid", "function_id"], "left").withColumn("same", F.col("recorded") == F.col("function_name"))


def patch(asked: DataFrame, oo: DataFrame) -> DataFrame:
    """Whether a patch applies: true if the step is unrecorded or of that name."""
    return _same_step(asked, oo).select("workflow_uuid", "function_id", F.coalesce("same", F.lit(True)).alias("patched"))


def deprecate_patch(asked: DataFrame, oo: DataFrame) -> DataFrame:
    """Whether a patch's marker is there: true only if the step is recorded and of that name."""
    return _same_step(asked, oo).select("workflow_uuid", "function_id", F.coalesce("same", F.lit(False)).alias("deprecated"))


def patches(asked: DataFrame, oo: DataFrame) -> DataFrame:
    """Both answers in one pass."""
    return _same_step(asked, oo).select("workflow_uuid", "function_id", F.coalesce("same", F.lit(True)).alias("patched"), F.coalesce("same", F.lit(False)).alias("deprecated"))


def cancellations(ws: DataFrame) -> DataFrame:
    return ws.select("workflow_uuid", F.when(F.col("status") == "CANCELLED", "cancelled").when(F.col("status") == "CANCELLING", "cancelling").alias("cancellation"))


def deadlines(ws: DataFrame, now_ms: int) -> DataFrame:
    return ws.select("workflow_uuid", F.coalesce(F.col("workflow_deadline_epoch_ms"), F.lit(now_ms) + F.col("workflow_timeout_ms")).alias("deadline"))


def existing(ws: DataFrame, ids: DataFrame) -> DataFrame:
    return ws.select("workflow_uuid").join(ids, "workflow_uuid", "left_semi")


def children(ws: DataFrame, workflow_id: str) -> DataFrame:
    return ws.where(F.col("parent_workflow_id") == workflow_id).select("workflow_uuid")


def active_schedules(schedules: DataFrame) -> DataFrame:
    return schedules.where(F.col("status") == "ACTIVE")
