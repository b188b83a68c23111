"""Tables, enumerations and sentinels of the workflow history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMA_VERSION = 42

# Fixed values.
STATUSES = ["PENDING", "ENQUEUED", "DELAYED", "SUCCESS", "ERROR", "CANCELLING", "CANCELLED", "MAX_RECOVERY_ATTEMPTS_EXCEEDED"]
TERMINAL = ["SUCCESS", "ERROR", "CANCELLED", "MAX_RECOVERY_ATTEMPTS_EXCEEDED"]
RETRYABLE = ["ERROR", "CANCELLED", "MAX_RECOVERY_ATTEMPTS_EXCEEDED"]
SPAWNING = ["DBOS.getResult", "DBOS.enqueue", "DBOS.forkWorkflow"]
NULL_TOPIC = "__null__topic__"
CLOSED = "__dbos_stream_closed__"
INTERNAL_QUEUE = "_dbos_internal_queue"
COMPENSATOR = "DBOS.compensate"

_KINDS = {"S": T.StringType(), "L": T.LongType(), "I": T.IntegerType(), "B": T.BooleanType(), "D": T.DoubleType()}


def _struct(line: str) -> T.StructType:
    """``name:K`` words; ``name:K?`` is nullable."""
    return T.StructType([T.StructField(n, _KINDS[k[0]], k.endswith("?")) for n, k in (w.split(":") for w in line.split())])


TABLES = {
    "workflow_status": _struct(
        "workflow_uuid:S status:S? name:S? authenticated_user:S? assumed_role:S? authenticated_roles:S? request:S? output:S? error:S? executor_id:S? created_at:L updated_at:L "
        "application_version:S? application_id:S? class_name:S? config_name:S? recovery_attempts:L? queue_name:S? workflow_timeout_ms:L? workflow_deadline_epoch_ms:L? inputs:S? "
        "started_at_epoch_ms:L? deduplication_id:S? priority:I queue_partition_key:S? forked_from:S? owner_xid:S? parent_workflow_id:S? serialization:S? delay_until_epoch_ms:L? "
        "was_forked_from:B rate_limited:B completed_at:L? attributes:S? schedule_name:S? debounce_deadline_epoch_ms:L? is_debounced:B ex_workflow_version:S?"
    ),
    "operation_outputs": _struct("workflow_uuid:S function_id:I function_name:S output:S? error:S? child_workflow_id:S? started_at_epoch_ms:L? completed_at_epoch_ms:L? serialization:S? ex_compensation:S?"),
    "notifications": _struct("destination_uuid:S topic:S? message:S created_at_epoch_ms:L message_uuid:S serialization:S? consumed:B"),
    "workflow_events": _struct("workflow_uuid:S key:S value:S serialization:S?"),
    "workflow_events_history": _struct("workflow_uuid:S function_id:I key:S value:S serialization:S?"),
    "streams": _struct("workflow_uuid:S key:S value:S offset:I function_id:I serialization:S?"),
    "workflow_schedules": _struct("schedule_id:S schedule_name:S workflow_name:S workflow_class_name:S? schedule:S status:S context:S last_fired_at:S? automatic_backfill:B cron_timezone:S? queue_name:S?"),
    "application_versions": _struct("version_id:S version_name:S version_timestamp:L created_at:L"),
    "queues": _struct("queue_id:S name:S concurrency:I? worker_concurrency:I? rate_limit_max:I? rate_limit_period_sec:D? priority_enabled:B partition_queue:B polling_interval_sec:D created_at:L updated_at:L"),
    "executor_leases": T.StructType([*_struct("executor_id:S application_version:S? node:S lease_expires_epoch_ms:L renewed_at_epoch_ms:L").fields, T.StructField("ex_capabilities", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())])))]),
}
KEYS = {
    "workflow_status": ["workflow_uuid"], "operation_outputs": ["workflow_uuid", "function_id"], "notifications": ["message_uuid"], "workflow_events": ["workflow_uuid", "key"],
    "workflow_events_history": ["workflow_uuid", "function_id", "key"], "streams": ["workflow_uuid", "key", "offset"], "workflow_schedules": ["schedule_id"],
    "application_versions": ["version_id"], "queues": ["queue_id"], "executor_leases": ["executor_id"],
}
CHILDREN = {"operation_outputs": "workflow_uuid", "notifications": "destination_uuid", "workflow_events": "workflow_uuid", "workflow_events_history": "workflow_uuid", "streams": "workflow_uuid"}
STEP_COLUMNS = ["function_id", "function_name", "output", "error", "child_workflow_id", "started_at_epoch_ms", "completed_at_epoch_ms", "serialization"]


def checked(df: DataFrame, table: str, version: int = SCHEMA_VERSION) -> DataFrame:
    """``df`` with the table's columns in order; a missing column, another type or version is an error, never a cast."""
    if version != SCHEMA_VERSION:
        raise ValueError(f"schema version {version}; this engine reads {SCHEMA_VERSION}")
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in TABLES[table] if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{table}: missing or of another type: {', '.join(wrong)}")
    return df.select(*TABLES[table].names)
