"""State transitions: each takes a snapshot and gives (next snapshot, affected ids).  Nothing is written in place."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHILDREN, INTERNAL_QUEUE, RETRYABLE
from .reports import unwindable


def no(kind: str) -> Column:
    return F.lit(None).cast(kind)


def changed(ws: DataFrame, hit: Column, change: dict[str, Column], mark: str = "_hit") -> tuple[DataFrame, DataFrame]:
    marked = ws.withColumn(mark, F.coalesce(hit, F.lit(False)))
    after = marked.withColumns({c: F.when(F.col(mark), v).otherwise(F.col(c)) for c, v in change.items() if c in ws.columns})
    return after.select(*[c for c in ws.columns if not c.startswith("_")]), marked.where(mark).select("workflow_uuid")


def named(ws: DataFrame, ids: DataFrame) -> DataFrame:
    return ws.join(ids.select("workflow_uuid", F.lit(True).alias("_named")).distinct(), "workflow_uuid", "left")


def cancel(ws: DataFrame, oo: DataFrame, ids: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Cancels what isn't final or being cancelled; pending work with something to unwind is CANCELLING first. Affected: all that exist."""
    both = named(ws, ids).join(unwindable(ws, oo).withColumnRenamed("unwindable", "_unwind"), "workflow_uuid", "left")
    hit = F.coalesce(F.col("_named"), F.lit(False)) & ~F.col("status").isin("SUCCESS", "ERROR", "CANCELLED", "CANCELLING")
    slow = F.col("_unwind") & (F.col("status") == "PENDING")
    keep = lambda c, new: F.when(slow, F.col(c)).otherwise(new)
    change = {
        "completed_at": keep("completed_at", F.lit(now_ms).cast("long")), "started_at_epoch_ms": keep("started_at_epoch_ms", no("long")), "queue_name": keep("queue_name", no("string")),
        "deduplication_id": no("string"), "updated_at": F.lit(now_ms).cast("long"), "status": F.when(slow, "CANCELLING").otherwise("CANCELLED"),
    }
    after, _ = changed(both, hit, change)
    return after, ws.join(ids, "workflow_uuid", "left_semi").select("workflow_uuid")


def cancel_before(ws: DataFrame, oo: DataFrame, cutoff_ms: int, now_ms: int) -> tuple[DataFrame, DataFrame]:
    ids = ws.where((F.col("created_at") <= cutoff_ms) & F.col("status").isin("PENDING", "ENQUEUED", "DELAYED")).select("workflow_uuid")
    return cancel(ws, oo, ids, now_ms)


def _restart() -> dict[str, Column]:
    return {"status": F.lit("ENQUEUED"), "queue_name": F.coalesce(F.col("queue_name"), F.lit(INTERNAL_QUEUE)), "recovery_attempts": F.lit(0).cast("long"), "workflow_deadline_epoch_ms": no("long"), "deduplication_id": no("string"), "started_at_epoch_ms": no("long"), "completed_at": no("long")}


def resume(ws: DataFrame, ids: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Everything named but SUCCESS and ERROR is enqueued afresh. Affected: all that exist."""
    both = named(ws, ids)
    after, _ = changed(both, F.coalesce(F.col("_named"), F.lit(False)) & ~F.col("status").isin("SUCCESS", "ERROR"), _restart() | {"updated_at": F.lit(now_ms).cast("long")})
    return after, ws.join(ids, "workflow_uuid", "left_semi").select("workflow_uuid")


def retry(ws: DataFrame, ids: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Only failed, cancelled and dead-lettered workflows, error cleared. Affected: those updated."""
    both = named(ws, ids)
    return changed(both, F.coalesce(F.col("_named"), F.lit(False)) & F.col("status").isin(RETRYABLE), _restart() | {"error": no("string"), "updated_at": F.lit(now_ms).cast("long")})


def promote_delayed(ws: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    due = (F.col("status") == "DELAYED") & (F.col("delay_until_epoch_ms") <= now_ms)
    dedup = F.when(F.col("is_debounced"), no("string")).otherwise(F.col("deduplication_id"))
    return changed(ws, due, {"deduplication_id": dedup, "updated_at": F.lit(now_ms).cast("long"), "status": F.lit("ENQUEUED")})


def clear_queue_assignment(ws: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = named(ws, ids)
    return changed(both, F.coalesce(F.col("_named"), F.lit(False)) & (F.col("status") == "PENDING") & F.col("queue_name").isNotNull(), {"started_at_epoch_ms": no("long"), "status": F.lit("ENQUEUED")})


def reclaim(ws: DataFrame, chosen: DataFrame, executor: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    both = named(ws, chosen)
    return changed(both, F.coalesce(F.col("_named"), F.lit(False)), {"executor_id": F.lit(executor), "updated_at": F.lit(now_ms).cast("long")})


def dead_letter(ws: DataFrame, max_retries: int, owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pending work with more attempts than max_retries + 1; where the snapshot has ``owner_xid``, only that of other owners than ``owner``."""
    over = (F.col("recovery_attempts") > max_retries + 1) & (F.lit(max_retries) > 0) & (F.col("status") == "PENDING")
    if "owner_xid" in ws.columns:
        over = over & ~F.col("owner_xid").eqNullSafe(F.lit(owner).cast("string"))
    return changed(ws, over, {"deduplication_id": no("string"), "started_at_epoch_ms": no("long"), "queue_name": no("string"), "status": F.lit("MAX_RECOVERY_ATTEMPTS_EXCEEDED")})


def record_outcomes(ws: DataFrame, done: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """done(workflow_uuid, new_status, new_output, new_error): refused over CANCELLED, SUCCESS and ERROR, and over CANCELLING unless it becomes CANCELLED."""
    both = ws.join(done.select("workflow_uuid", F.col("new_status").alias("_s"), F.col("new_output").alias("_o"), F.col("new_error").alias("_e")), "workflow_uuid", "left")
    ok = F.col("_s").isNotNull() & ~F.col("status").isin("CANCELLED", "SUCCESS", "ERROR") & ((F.col("status") != "CANCELLING") | (F.col("_s") == "CANCELLED"))
    return changed(both, ok, {"output": F.col("_o"), "error": F.col("_e"), "completed_at": F.lit(now_ms).cast("long"), "deduplication_id": no("string"), "updated_at": F.lit(now_ms).cast("long"), "status": F.col("_s")})


def enqueue_unwinds(ws: DataFrame, oo: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    """New compensation workflows for failed or cancelled ones that can be unwound and have none yet."""
    own = ws.join(ids, "workflow_uuid", "left_semi").where(F.col("status").isin("ERROR", "CANCELLED"))
    need = own.join(unwindable(ws, oo).where("unwindable"), "workflow_uuid", "left_semi").select(F.concat("workflow_uuid", F.lit("-compensate")).alias("workflow_uuid"), F.lit("ENQUEUED").alias("status"), F.lit("DBOS.compensate").alias("name"), F.lit(INTERNAL_QUEUE).alias("queue_name"), F.col("workflow_uuid").alias("parent_workflow_id"), F.lit(now_ms).cast("long").alias("created_at"))
    return need.join(ws.select("workflow_uuid"), "workflow_uuid", "left_anti")


def collect_garbage(ws: DataFrame, cutoff_ms: int | None, keep_newest: int | None) -> tuple[DataFrame, DataFrame]:
    """Drops workflows created before the later of the cutoff and the n-th newest, but those pending, enqueued or delayed; (kept, dropped ids)."""
    if cutoff_ms is None and keep_newest is None:
        return ws, ws.limit(0).select("workflow_uuid")
    if keep_newest is not None and keep_newest < 1:
        raise ValueError("keep_newest must be positive")
    limit = F.lit(cutoff_ms).cast("long")
    if keep_newest is not None:
        nth = ws.select("created_at").orderBy(F.col("created_at").desc()).offset(keep_newest - 1).limit(1).agg(F.max("created_at").alias("_nth"))
        ws, limit = ws.crossJoin(F.broadcast(nth)), F.greatest(limit, F.col("_nth"))
    gone = F.coalesce((F.col("created_at") < limit) & ~F.col("status").isin("PENDING", "ENQUEUED", "DELAYED"), F.lit(False))
    return ws.where(~gone).drop("_nth"), ws.where(gone).select("workflow_uuid")


def cascade(dropped: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Child tables without the rows of dropped workflows."""
    return {n: df.join(dropped.withColumnRenamed("workflow_uuid", CHILDREN[n]), CHILDREN[n], "left_anti") for n, df in tables.items()}


class Forked(NamedTuple):
    workflows: DataFrame
    steps: DataFrame
    events: DataFrame
    history: DataFrame
    streams: DataFrame | None
    marked: DataFrame


#: What a fork's row takes over from the original, as far as the snapshot has it.
FORKED = ["name", "authenticated_user", "assumed_role", "authenticated_roles", "application_id", "inputs", "serialization", "class_name", "config_name", "attributes", "ex_workflow_version"]


def fork(ws: DataFrame, oo: DataFrame, history: DataFrame, asked: DataFrame, now_ms: int, streams: DataFrame | None = None, executor: str | None = None) -> Forked:
    """asked(workflow_uuid, new_id, start_step, perhaps new_version) → new workflows, their steps, current events, event history and streams, and the snapshot with the originals marked.

    Steps, events and stream values before start_step are copied, without
    compensations and notifications; the events' current values are the latest
    of those.  A new_version that isn't null replaces the original's.
    """
    own = asked.select("workflow_uuid", "new_id", "start_step", (F.col("new_version") if "new_version" in asked.columns else no("string")).alias("_version"))

    def before(df: DataFrame) -> DataFrame:
        return df.join(own, "workflow_uuid").where(F.col("function_id") < F.col("start_step"))

    def copied(df: DataFrame, left_out: tuple[str, ...] = ()) -> list:
        return [F.col("new_id").alias("workflow_uuid"), *[c for c in df.columns if c not in ("workflow_uuid", *left_out)]]

    at = F.lit(now_ms).cast("long")
    new = ws.join(own, "workflow_uuid").select(
        F.col("new_id").alias("workflow_uuid"), F.lit("ENQUEUED").alias("status"), *[c for c in FORKED if c in ws.columns], F.coalesce("_version", "application_version").alias("application_version"), F.lit(INTERNAL_QUEUE).alias("queue_name"),
        F.lit(executor).cast("string").alias("executor_id"), F.lit(0).cast("long").alias("recovery_attempts"), F.col("workflow_uuid").alias("forked_from"), at.alias("created_at"), at.alias("updated_at"),
    )
    latest = Window.partitionBy("new_id", "key").orderBy(F.col("function_id").desc())
    current = before(history).withColumn("rn", F.row_number().over(latest)).where("rn = 1")
    events = current.select(F.col("new_id").alias("workflow_uuid"), "key", "value", *[c for c in ("serialization",) if c in history.columns])
    hit = F.coalesce(F.col("_named"), F.lit(False))
    known = F.coalesce(F.col("was_forked_from"), F.lit(False)) if "was_forked_from" in ws.columns else F.lit(False)
    marked = named(ws, asked).withColumn("was_forked_from", hit | known).drop("_named")
    return Forked(new, before(oo).select(copied(oo, ("ex_compensation",))), events, before(history).select(copied(history)), None if streams is None else before(streams).select(copied(streams)), marked)


def insert_enqueued(ws: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """asked(workflow_uuid, queue_name, deduplication_id, delay_ms) → what becomes of each: existing, duplicate, DELAYED or ENQUEUED."""
    known = ws.select("workflow_uuid", F.lit(True).alias("_known"))
    held = ws.where(F.col("queue_name").isNotNull() & F.col("deduplication_id").isNotNull()).select("queue_name", "deduplication_id", F.col("workflow_uuid").alias("holder"))
    both = asked.join(known, "workflow_uuid", "left").join(held, ["queue_name", "deduplication_id"], "left")
    slow = F.coalesce(F.col("delay_ms") > 0, F.lit(False))
    answer = F.when(F.col("_known"), "existing").when(F.col("holder").isNotNull(), "duplicate").when(slow, "DELAYED").otherwise("ENQUEUED")
    return both.select("workflow_uuid", answer.alias("answer"), F.when(answer == "DELAYED", F.lit(now_ms) + F.col("delay_ms")).alias("delay_until_epoch_ms"))


def insert_rows(ws: DataFrame, asked: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The next snapshot and the answers (workflow_uuid, answer, delay_until_epoch_ms) of ``insert_enqueued``, in one batch.

    ``asked`` has request (its place in the order of arrival), workflow_uuid (once
    in a batch), queue_name, deduplication_id, delay_ms and what else new rows
    take over.  Of new requests with one deduplication id in one queue the first
    is taken.  A known workflow changes in nothing but ``updated_at``.
    """
    told = insert_enqueued(ws, asked, now_ms).withColumnRenamed("answer", "_answer")
    new = F.col("_answer").isin("ENQUEUED", "DELAYED")
    both = asked.join(told, "workflow_uuid")
    alone = F.when(~new | F.col("deduplication_id").isNull() | F.col("queue_name").isNull(), F.col("workflow_uuid"))  # what cannot compete makes no hot key
    place = F.row_number().over(Window.partitionBy("queue_name", F.when(alone.isNull(), F.col("deduplication_id")), alone).orderBy("request"))
    answered = both.withColumn("answer", F.when(new & (place > 1), "duplicate").otherwise(F.col("_answer")))
    answers = answered.select("workflow_uuid", "answer", F.when(F.col("answer") == "DELAYED", F.col("delay_until_epoch_ms")).alias("delay_until_epoch_ms"))
    at = F.lit(now_ms).cast("long")
    made = {"status": F.col("answer"), "created_at": at, "updated_at": at, "recovery_attempts": F.lit(0).cast("long")}
    added = answered.where(F.col("answer").isin("ENQUEUED", "DELAYED")).withColumns({c: v for c, v in made.items() if c in ws.columns})
    have = set(added.columns)
    added = added.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ws.schema])
    known = answers.where("answer = 'existing'")
    after, _ = changed(named(ws, known), F.col("_named"), {"updated_at": at})
    return after.unionByName(added), answers


def upsert_rows(ws: DataFrame, incoming: DataFrame, now_ms: int, count_attempt: bool = True) -> DataFrame:
    """The next snapshot after ``upsert_status``: of known rows attempts, executor and ``updated_at`` change, new ones take over what ``incoming`` has."""
    decided = upsert_status(ws, incoming, count_attempt).select("workflow_uuid", F.col("status").alias("_status"), F.col("executor_id").alias("_executor"), F.col("recovery_attempts").alias("_attempts"))
    at = F.lit(now_ms).cast("long")
    own = named(ws, incoming).join(decided, "workflow_uuid")
    after, _ = changed(own, F.col("_named"), {"executor_id": F.col("_executor"), "recovery_attempts": F.col("_attempts"), "updated_at": at})
    fresh = incoming.join(ws.select("workflow_uuid"), "workflow_uuid", "left_anti").join(decided, "workflow_uuid")
    made = {"status": F.col("_status"), "executor_id": F.col("_executor"), "recovery_attempts": F.col("_attempts"), "created_at": at, "updated_at": at}
    fresh = fresh.withColumns({c: v for c, v in made.items() if c in ws.columns})
    have = set(fresh.columns)
    return after.unionByName(fresh.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ws.schema]))


def upsert_status(ws: DataFrame, incoming: DataFrame, count_attempt: bool = True) -> DataFrame:
    """incoming(workflow_uuid, status, executor_id): new rows start with attempts 0 (queued) or 1; on conflict attempts and executor change unless the incoming one is queued, the status never."""
    queued = F.col("in_status").isin("ENQUEUED", "DELAYED")
    both = ws.select("workflow_uuid", "status", "executor_id", "recovery_attempts").join(incoming.select("workflow_uuid", F.col("status").alias("in_status"), F.col("executor_id").alias("in_executor")), "workflow_uuid", "full_outer")
    new = F.col("status").isNull()
    attempts = F.when(new, F.when(queued, 0).otherwise(1)).when(F.col("in_status").isNull() | queued, F.col("recovery_attempts")).otherwise(F.col("recovery_attempts") + int(count_attempt))
    return both.select("workflow_uuid", F.coalesce("status", "in_status").alias("status"), F.when(new | (F.col("in_status").isNotNull() & ~queued), F.col("in_executor")).otherwise(F.col("executor_id")).alias("executor_id"), attempts.cast("long").alias("recovery_attempts"))


def reconcile_steps(oo: DataFrame, incoming: DataFrame) -> DataFrame:
    """What recording each step meets: inserted, same, unexpected_step or conflict."""
    fields = ["function_name", "output", "error", "child_workflow_id", "started_at_epoch_ms", "completed_at_epoch_ms"]
    old = oo.select("workflow_uuid", "function_id", *[F.col(c).alias(f"old_{c}") for c in fields])
    both = incoming.join(old, ["workflow_uuid", "function_id"], "left")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return both.select("workflow_uuid", "function_id", F.when(F.col("old_function_name").isNull(), "inserted").when(same, "same").when(F.col("old_function_name") != F.col("function_name"), "unexpected_step").otherwise("conflict").alias("answer"))


def renew_leases(el: DataFrame, renewals: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Leases with those of ``renewals``(executor_id) running until now + ttl; others as they are."""
    fresh = renewals.select("executor_id", F.lit(now_ms + ttl_ms).cast("long").alias("_until"))
    return el.join(fresh, "executor_id", "full_outer").select("executor_id", F.coalesce("_until", "lease_expires_epoch_ms").alias("lease_expires_epoch_ms"))


def register_versions(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    return versions.unionByName(incoming.join(versions, "version_name", "left_anti").select(*versions.columns))
