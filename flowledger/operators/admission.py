"""Queue admission, for all queues and partitions in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


QUEUE, PARTITION = ["queue_name"], ["queue_name", "queue_partition_key"]


def recent_starts(ws: DataFrame, qs: DataFrame, now_ms: int, keys: list[str] = QUEUE) -> DataFrame:
    """By queue (or partition): rate-limited starts after now - period (strictly)."""
    own = ws.where(F.col("rate_limited") & ~F.col("status").isin("ENQUEUED", "DELAYED"))
    limits = qs.where(F.col("rate_limit_max").isNotNull()).select(F.col("name").alias("queue_name"), "rate_limit_period_ms")
    return own.join(limits, "queue_name").where(F.col("started_at_epoch_ms") > F.lit(now_ms) - F.col("rate_limit_period_ms")).groupBy(*keys).agg(F.count("*").alias("recent"))


def running_counts(ws: DataFrame, keys: list[str] = QUEUE) -> DataFrame:
    return ws.where((F.col("status") == "PENDING") & F.col("queue_name").isNotNull()).groupBy(*keys).agg(F.count("*").alias("running"))


def partitions(ws: DataFrame, qs: DataFrame) -> DataFrame:
    """The partitions that are dequeued: those with enqueued rows, of queues that are partitioned (all, where ``qs`` doesn't say)."""
    own = ws.where((F.col("status") == "ENQUEUED") & F.col("queue_partition_key").isNotNull()).select(*PARTITION).distinct()
    some = qs.where("partition_queue") if "partition_queue" in qs.columns else qs
    return own.join(some.select(F.col("name").alias("queue_name")), "queue_name", "left_semi")


def capacity(ws: DataFrame, qs: DataFrame, local: DataFrame, now_ms: int, per_partition: bool = False) -> DataFrame:
    """By queue: what may be claimed (null: unbounded) and whether the rate limit blocks.

    ``local``: queue_name, local_running, and queue_partition_key if by partition.
    A partition has its queue's limits and its own counts.
    """
    keys = PARTITION if per_partition else QUEUE
    q = qs.withColumnRenamed("name", "queue_name")
    if per_partition:
        q = q.join(partitions(ws, qs), "queue_name")
    joined = q.join(recent_starts(ws, qs, now_ms, keys), keys, "left").join(running_counts(ws, keys), keys, "left").join(local, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    left = lambda bound, used: F.when(F.col(bound).isNotNull(), F.greatest(F.col(bound) - zero(used), F.lit(0)))
    worker, overall, rate = left("worker_concurrency", "local_running"), left("concurrency", "running"), left("rate_limit_max", "recent")
    return joined.select(*keys, F.least(worker, overall).cast("long").alias("slots"), rate.cast("long").alias("rate_left"), (zero("recent") >= F.col("rate_limit_max")).alias("limited"))


def version_gate(version: str, latest: str | None) -> Column:
    """Rows of this version; the latest version's (or, with none registered, any) worker also takes rows of none."""
    own = F.col("application_version") == version
    return (own | F.col("application_version").isNull()) if latest is None or version == latest else own


def dequeue(ws: DataFrame, qs: DataFrame, local: DataFrame, now_ms: int, version: str, latest: str | None, per_partition: bool = False) -> DataFrame:
    """The rows each queue claims: by priority, creation and id up to its slots and rate.

    Per partition each key is dequeued by itself, with its own counts; rows of no
    partition are left out.  The greatest bound of all is found first (one row);
    as a literal it lets Spark keep no more than so many of each task's rows
    before the shuffle (a group limit below the window).  The exact bound of each
    queue follows.  Where a queue has no bound there is no such literal.
    """
    keys = PARTITION if per_partition else QUEUE
    ready = ws.where((F.col("status") == "ENQUEUED") & version_gate(version, latest) & F.col(keys[-1]).isNotNull())
    caps = capacity(ws, qs, local, now_ms, per_partition).where(~F.coalesce("limited", F.lit(False)))
    bounded = caps.select(*keys, F.least("slots", "rate_left").alias("_bound"))
    most = bounded.agg(F.max(F.coalesce("_bound", F.lit(1 << 62))).alias("m")).first()["m"] or 0
    ranked = ready.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("priority", "created_at", "workflow_uuid")))
    if most < 1 << 31:
        ranked = ranked.where(F.col("rank") <= int(most))
    shown = ["queue_name", "queue_partition_key", "workflow_uuid", F.col("rank").cast("long").alias("rank")]
    return ranked.join(bounded, keys).where(F.col("_bound").isNull() | (F.col("rank") <= F.col("_bound"))).select(*shown)


def outcomes(ws: DataFrame, qs: DataFrame, local: DataFrame, now_ms: int, version: str, latest: str | None) -> DataFrame:
    """By queue: rows claimed, or why none: rate_limited, no_capacity, empty."""
    claimed = dequeue(ws, qs, local, now_ms, version, latest).groupBy("queue_name").agg(F.count("*").alias("claimed"))
    n = F.coalesce("claimed", F.lit(0)).cast("long")
    why = F.when(F.coalesce("limited", F.lit(False)), "rate_limited").when(F.col("slots") == 0, "no_capacity").when(n == 0, "empty")
    return capacity(ws, qs, local, now_ms).join(claimed, "queue_name", "left").select("queue_name", n.alias("claimed"), why.alias("blocked"))


def throughput(worker_concurrency: Column, polling_ms: Column) -> Column:
    """The most workflows a second that one engine starts: its concurrency over the polling interval; null without a bound."""
    return worker_concurrency * 1000 / polling_ms


TICK = ["idle", "limited", "claimed", "contention"]


def tick_summary(reports: DataFrame) -> DataFrame:
    """The strongest of a tick's outcomes."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TICK]), F.col("outcome"))
    return reports.groupBy("tick").agg(F.max(rank).alias("r")).select("tick", F.element_at(F.array(*[F.lit(t) for t in TICK]), F.col("r").cast("int")).alias("summary"))


def claim(ws: DataFrame, chosen: DataFrame, now_ms: int, version: str, executor: str, qs: DataFrame | None = None, registry: DataFrame | None = None) -> DataFrame:
    """The next snapshot in which the chosen rows are pending on ``executor``.

    With ``qs`` a row is marked as rate limited if its queue is; with ``registry``
    (name, version: what this executor can run) it gets the version registered for
    its name, the least of several, and none if the name is unknown.
    """
    hit = F.col("_hit").isNotNull()
    marked = ws.join(chosen.select("workflow_uuid", F.lit(1).alias("_hit")), "workflow_uuid", "left")
    change = {
        "status": F.lit("PENDING"), "application_version": F.lit(version), "executor_id": F.lit(executor), "started_at_epoch_ms": F.lit(now_ms).cast("long"),
        "workflow_deadline_epoch_ms": F.coalesce(F.col("workflow_deadline_epoch_ms"), F.lit(now_ms) + F.col("workflow_timeout_ms")), "updated_at": F.lit(now_ms).cast("long"),
    }
    if qs is not None:
        marked = marked.join(qs.select(F.col("name").alias("queue_name"), F.col("rate_limit_max").isNotNull().alias("_limited")), "queue_name", "left")
        change["rate_limited"] = F.coalesce("_limited", F.lit(False))
    if registry is not None:
        marked = marked.join(registry.groupBy("name").agg(F.min("version").alias("_version")), "name", "left")
        change["ex_workflow_version"] = F.col("_version")
    return marked.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in change.items()}).select(*ws.columns)


def rate_audit(ws: DataFrame, period_ms: int) -> DataFrame:
    """By queue, the most starts that any period saw."""
    w = Window.partitionBy("queue_name").orderBy("started_at_epoch_ms").rangeBetween(-(period_ms - 1), 0)
    started = ws.where(F.col("queue_name").isNotNull() & F.col("started_at_epoch_ms").isNotNull())
    return started.select("queue_name", F.count("*").over(w).alias("n")).groupBy("queue_name").agg(F.max("n").alias("most_starts"))


def fair_share(ws: DataFrame, per_tenant: int, overall: int) -> DataFrame:
    """A cap for each (queue, tenant), then one for each queue."""
    order = ["priority", "created_at", "workflow_uuid"]
    own = ws.where(F.col("status") == "ENQUEUED").withColumn("tenant_rank", F.row_number().over(Window.partitionBy("queue_name", "authenticated_user").orderBy(*order))).where(F.col("tenant_rank") <= per_tenant)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("queue_name").orderBy(*order))).where(F.col("rank") <= overall).select("queue_name", "authenticated_user", "workflow_uuid")


class QueueConfig:
    """A queue's settings, validated."""

    def __init__(self, name: str, concurrency: int | None = None, worker_concurrency: int | None = None, rate_limit: tuple[int, int] | None = None, priority_enabled: bool = False, partition_queue: bool = False, polling_interval_ms: int = 1000):
        positive = lambda v: v is None or (isinstance(v, int) and v > 0)
        if not name:
            raise ValueError("a queue needs a name")
        if not positive(concurrency):
            raise ValueError("concurrency must be a positive integer")
        if not positive(worker_concurrency):
            raise ValueError("worker_concurrency must be a positive integer")
        if concurrency and worker_concurrency and worker_concurrency > concurrency:
            raise ValueError("worker_concurrency must not be more than concurrency")
        if rate_limit is not None and not all(isinstance(v, int) and v > 0 for v in rate_limit):
            raise ValueError("rate_limit needs a positive limit and period")
        if not positive(polling_interval_ms) or polling_interval_ms is None:
            raise ValueError("polling_interval_ms must be a positive integer")
        self.name, self.concurrency, self.worker_concurrency, self.rate_limit = name, concurrency, worker_concurrency, rate_limit
        self.priority_enabled, self.partition_queue, self.polling_interval_ms = priority_enabled, partition_queue, polling_interval_ms

    def throughput_bound(self) -> float | None:
        """Workflows a second: worker concurrency over the polling interval."""
        return self.worker_concurrency * 1000 / self.polling_interval_ms if self.worker_concurrency else None


def check_dispatch(options: dict) -> dict:
    allowed = {"queue", "deduplication_id", "priority", "partition_key", "delay_ms", "timeout_ms", "workflow_id", "app_version", "attributes"}
    unknown = set(options) - allowed
    if unknown:
        raise ValueError(f"unknown option: {', '.join(sorted(unknown))}")
    if options.get("deduplication_id") and options.get("partition_key"):
        raise ValueError("deduplication_id and partition_key exclude each other")
    return options
