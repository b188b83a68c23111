"""Reports over the history: orphans, declined work, recovery candidates, counts, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import COMPENSATOR, INTERNAL_QUEUE, SPAWNING, TERMINAL


def pending(ws: DataFrame) -> DataFrame:
    return ws.where(F.col("status") == "PENDING")


def of_executors(ws: DataFrame, dead: list[str] | DataFrame) -> DataFrame:
    """Rows of the executors named, in a short list or in a table (executor_id) of any size."""
    return ws.where(F.col("executor_id").isin(dead)) if isinstance(dead, list) else ws.join(dead, "executor_id", "left_semi")


def capabilities(el: DataFrame) -> DataFrame:
    """Distinct (cap_name, cap_version) that executors advertise; leases keep theirs as an array or already one a row."""
    if "ex_capabilities" in el.columns:
        el = el.select("*", F.inline("ex_capabilities").alias("cap_name", "cap_version"))
    return el.where(F.col("cap_name").isNotNull()).select("cap_name", "cap_version").distinct()


def live_executors(el: DataFrame, now_ms: int) -> DataFrame:
    return el.where(F.col("lease_expires_epoch_ms") > now_ms)


def can_run(ws: DataFrame, caps: DataFrame):
    return (caps["cap_name"] == ws["name"]) & caps["cap_version"].eqNullSafe(ws["ex_workflow_version"])


def orphans(ws: DataFrame, el: DataFrame, now_ms: int) -> DataFrame:
    """Groups of pending workflows that no live executor can take, largest first, with the reason.

    The anti join by executor and the one by capability come first, so that only
    candidates are grouped; whether the name is advertised at all is a mark on
    the groups.  A live executor of unknown capabilities suppresses the report.
    """
    live = live_executors(el, now_ms)
    caps = capabilities(live)
    unknown = live.where(F.col("cap_name").isNull()).select(F.lit(1).alias("_")).limit(1)
    lost = pending(ws).where(F.col("queue_name").isNull()).join(live, "executor_id", "left_anti")
    lost = lost.join(caps, can_run(lost, caps), "left_anti").join(unknown, F.lit(True), "left_anti")
    grouped = lost.groupBy("name", "application_version", "ex_workflow_version").agg(F.count("*").alias("count"), F.min("created_at").alias("oldest_created_at"), F.min("workflow_uuid").alias("sample_id"))
    names = caps.select(F.col("cap_name").alias("name"), F.lit(True).alias("advertised")).distinct()
    alive = live.agg(F.countDistinct("executor_id").alias("live"))
    marked = grouped.join(names, "name", "left").crossJoin(F.broadcast(alive))
    reason = F.when(F.col("live") == 0, "no_live_executors").when(F.col("advertised"), "version_mismatch").otherwise("name_not_registered")
    return marked.select("name", "application_version", "ex_workflow_version", "count", "oldest_created_at", "sample_id", reason.alias("reason")).orderBy(F.col("count").desc(), "name", "application_version", "ex_workflow_version")


def declined(ws: DataFrame, dead: list[str] | DataFrame, caps: DataFrame, handled: DataFrame) -> DataFrame:
    """Pending work of dead executors that this engine didn't take, by group, with whether it could have and why not."""
    left = of_executors(pending(ws).where(F.col("queue_name").isNull()), dead).join(handled, "workflow_uuid", "left_anti")
    mark = caps.select(F.col("cap_name").alias("name"), F.col("cap_version").alias("_v"), F.lit(True).alias("_can"))
    marked = left.join(mark, (left["name"] == mark["name"]) & left["ex_workflow_version"].eqNullSafe(mark["_v"]), "left").drop(mark["name"])
    known = caps.select(F.col("cap_name").alias("name"), F.lit(True).alias("_named")).distinct()
    groups = marked.groupBy("name", "application_version", "ex_workflow_version", F.coalesce("_can", F.lit(False)).alias("claimable")).agg(F.count("*").alias("count"), F.min("created_at").alias("oldest_created_at"), F.min("workflow_uuid").alias("sample_id"))
    reason = F.when(F.col("claimable"), "locked_elsewhere").when(F.col("_named"), "version_mismatch").otherwise("name_not_registered")
    return groups.join(known, "name", "left").select("name", "application_version", "ex_workflow_version", "claimable", "count", "oldest_created_at", "sample_id", reason.alias("reason"))


def expired_pending_executors(ws: DataFrame, el: DataFrame, now_ms: int) -> DataFrame:
    """Executors that hold pending work and have no lease, or one that ended at ``now_ms`` or before."""
    held = pending(ws).where(F.col("executor_id").isNotNull()).select("executor_id").distinct()
    return held.join(live_executors(el, now_ms), "executor_id", "left_anti")


def stale_cancelling(ws: DataFrame, el: DataFrame, now_ms: int) -> DataFrame:
    return ws.where(F.col("status") == "CANCELLING").join(live_executors(el, now_ms), "executor_id", "left_anti").select("workflow_uuid")


def reclaimable(ws: DataFrame, dead: list[str] | DataFrame, caps: DataFrame, batch: int | None = None) -> DataFrame:
    """Unqueued pending work of dead executors that these capabilities can run, oldest first."""
    own = of_executors(pending(ws).where(F.col("queue_name").isNull()), dead)
    able = own.join(caps, can_run(own, caps), "left_semi").select("workflow_uuid", "created_at")
    return able.orderBy("created_at", "workflow_uuid").limit(batch) if batch else able


def queued_pending(ws: DataFrame, dead: list[str] | DataFrame) -> DataFrame:
    return of_executors(pending(ws).where(F.col("queue_name").isNotNull()), dead).select("workflow_uuid")


def recovered(ws: DataFrame, dead: list[str] | DataFrame, caps: DataFrame, batch: int | None = None) -> DataFrame:
    """Ids one reclaim pass handles: queued work put back, then work reclaimed."""
    return queued_pending(ws, dead).unionByName(reclaimable(ws, dead, caps, batch).select("workflow_uuid"))


def unwindable(ws: DataFrame, oo: DataFrame) -> DataFrame:
    """workflow_uuid and whether unwinding it would do anything: no compensator, and a step to undo or a child."""
    undo = oo.where(F.col("ex_compensation").isNotNull() | F.col("function_name").isin(SPAWNING)).select("workflow_uuid", F.lit(True).alias("_has")).distinct()
    return ws.join(undo, "workflow_uuid", "left").select("workflow_uuid", ((F.col("name") != COMPENSATOR) & F.coalesce("_has", F.lit(False))).alias("unwindable"))


def delayed_wake(ws: DataFrame) -> DataFrame:
    return ws.where(F.col("status") == "DELAYED").agg(F.min("delay_until_epoch_ms").alias("wake_epoch_ms"))


def partitions(ws: DataFrame) -> DataFrame:
    return ws.where((F.col("status") == "ENQUEUED") & F.col("queue_partition_key").isNotNull()).select("queue_name", "queue_partition_key").distinct()


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.agg(F.max_by("version_name", F.struct("version_timestamp", "version_name")).alias("version_name"))


def queue_depth(ws: DataFrame) -> DataFrame:
    return ws.where((F.col("status") == "ENQUEUED") & F.col("queue_name").isNotNull()).groupBy("queue_name").agg(F.count("*").alias("depth")).orderBy(F.col("depth").desc(), "queue_name")


def pending_by_expired_executor(ws: DataFrame, el: DataFrame, now_ms: int) -> DataFrame:
    """Counts of pending work by executor without a live lease; now in whole seconds, null executors kept."""
    live = live_executors(el, now_ms // 1000 * 1000)
    return pending(ws).join(live, "executor_id", "left_anti").groupBy("executor_id").agg(F.count("*").alias("pending"))


def in_flight(ws: DataFrame) -> DataFrame:
    return ws.where(F.col("status").isin("PENDING", "ENQUEUED", "DELAYED")).groupBy("application_version", "status").agg(F.count("*").alias("count"))


def recently_failed(ws: DataFrame, n: int = 50) -> DataFrame:
    return ws.where(F.col("status").isin("ERROR", "MAX_RECOVERY_ATTEMPTS_EXCEEDED")).orderBy(F.col("updated_at").desc(), "workflow_uuid").select("workflow_uuid", "name", "status", "updated_at").limit(n)


def running(ws: DataFrame) -> DataFrame:
    return pending(ws).select("workflow_uuid", "name", "executor_id", "created_at").orderBy("created_at", "workflow_uuid")


def outcome_tally(ws: DataFrame) -> DataFrame:
    return ws.where(F.col("status").isin(TERMINAL)).groupBy("name").pivot("status", TERMINAL).agg(F.count(F.lit(1))).na.fill(0)


def latency_summary(oo: DataFrame) -> DataFrame:
    """Step durations by function with nearest-rank median (sorted[n div 2]) and p95 (sorted[ceil(.95 n) - 1]).

    Durations are counted first; ranks are then found among distinct values, so
    no task sorts a whole group.
    """
    counted = durations(oo).groupBy("function_name", "duration").agg(F.count("*").alias("c"))
    w = Window.partitionBy("function_name")
    ranked = counted.withColumns({"upto": F.sum("c").over(w.orderBy("duration")), "n": F.sum("c").over(w)})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("duration")))
    p95 = F.least(F.col("n") - 1, F.ceil(F.col("n") * 95 / F.lit(100)) - 1)
    return ranked.groupBy("function_name").agg(F.max("n").alias("n"), (F.sum(F.col("duration") * F.col("c")) / F.max("n")).alias("mean"), F.min("duration").alias("least"), at(F.floor(F.col("n") / 2)).alias("median"), at(p95).alias("p95"), F.max("duration").alias("most"))


def durations(oo: DataFrame) -> DataFrame:
    return oo.select("workflow_uuid", "function_id", "function_name", (F.col("completed_at_epoch_ms") - F.col("started_at_epoch_ms")).alias("duration"))


def fitted_line(oo: DataFrame) -> DataFrame:
    """Least squares of a workflow's total step time over its number of steps."""
    per = durations(oo).groupBy("workflow_uuid").agg(F.count("*").cast("double").alias("x"), F.sum("duration").cast("double").alias("y"))
    return per.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"))


def lifetimes(ws: DataFrame) -> DataFrame:
    """Lifetime and queue wait by name."""
    return ws.groupBy("name").agg(F.count("completed_at").alias("completed"), F.sum(F.col("completed_at") - F.col("created_at")).alias("lifetime_ms"), F.max(F.when(F.col("queue_name").isNotNull(), F.col("started_at_epoch_ms") - F.col("created_at"))).alias("longest_wait_ms"))


def parked(oo: DataFrame) -> DataFrame:
    """Time from each step's end to the next step's start."""
    w = Window.partitionBy("workflow_uuid").orderBy("function_id")
    return oo.select("workflow_uuid", "function_id", (F.lead("started_at_epoch_ms").over(w) - F.col("completed_at_epoch_ms")).alias("parked_ms"))


def exactly_once(log: DataFrame) -> DataFrame:
    """(workflow_uuid, function_name) that ran more often than once."""
    return log.groupBy("workflow_uuid", "function_name").agg(F.count("*").alias("runs")).where(F.col("runs") > 1)


def rendered(ws: DataFrame) -> DataFrame:
    """One JSON document a workflow; times as text."""
    times = ["created_at", "updated_at", "started_at_epoch_ms", "completed_at"]
    return ws.select("workflow_uuid", F.to_json(F.struct(F.col("workflow_uuid").alias("WorkflowUUID"), F.col("status").alias("Status"), F.col("name").alias("WorkflowName"), *[F.col(t).cast("string").alias(t) for t in times])).alias("json"))


def shown(value: Column) -> Column:
    """A text as it is shown: in quotes, with its own quotes, backslashes and line ends escaped."""
    escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


#: The fields of each rendered document. Times become text, payloads are shown, others stay as they are.
RENDERED = {
    "workflow": "workflow_uuid status name authenticated_user assumed_role authenticated_roles executor_id application_version application_id attempts queue_name workflow_timeout_ms deduplication_id priority queue_partition_key created_at updated_at workflow_deadline_epoch_ms started_at_epoch_ms input output error",
    "step": "function_id function_name child_workflow_id started_at_epoch_ms completed_at_epoch_ms output error",
    "orphan": "name application_version workflow_version reason count oldest_created_at_epoch_ms example_workflow_id",
    "queue": "name worker_concurrency global_concurrency rate_limit priority_enabled partition_queue polling_interval_ms",
}
TIMES = {"workflow": ["created_at", "updated_at", "workflow_deadline_epoch_ms", "started_at_epoch_ms"], "orphan": ["oldest_created_at_epoch_ms"]}
SHOWN = {"workflow": ["input", "output", "error"], "step": ["output", "error"]}
#: Names of the fields in the tables, where they differ.
FROM = {
    "workflow": {"attempts": "recovery_attempts", "input": "inputs"}, "queue": {"global_concurrency": "concurrency"},
    "orphan": {"workflow_version": "ex_workflow_version", "oldest_created_at_epoch_ms": "oldest_created_at", "example_workflow_id": "sample_id"},
}


def document(df: DataFrame, kind: str) -> Column:
    """The JSON document of a row of ``df``: all fields of its kind, null where the table has no such column."""

    def field(name: str) -> Column:
        source = FROM.get(kind, {}).get(name, name)
        if name == "rate_limit":
            pair = F.struct(F.col("rate_limit_max").alias("limit"), F.col("rate_limit_period_ms").alias("period_ms"))
            return F.when(F.col("rate_limit_max").isNotNull(), pair).alias(name)
        value = F.col(source) if source in df.columns else F.lit(None).cast("string")
        value = value.cast("string") if name in TIMES.get(kind, ()) else shown(value) if name in SHOWN.get(kind, ()) else value
        return value.alias(name)

    return F.to_json(F.struct(*[field(n) for n in RENDERED[kind].split()]), {"ignoreNullFields": "false"})


def internal_queue(ws: DataFrame) -> DataFrame:
    return ws.where(F.col("queue_name") == INTERNAL_QUEUE)
