"""Registration and upserts: schedules, queues, leases, requests from SQL clients, events, chunks.

As everywhere, a transition takes snapshots and gives new ones.  An upsert is one
anti join on the key, so that untouched rows are neither sorted nor compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stub_embedding, text_chunks
from .reports import latest_version


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with its rows of the same key replaced by those of ``new``, which holds a key once."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, that with the greatest ``order``; an aggregate, so nothing is sorted."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*")


def expire_leases(el: DataFrame, executors: DataFrame, now_ms: int) -> DataFrame:
    """Leases of ``executors``(executor_id) end now; unknown executors change nothing."""
    ended = el.join(executors.select("executor_id", F.lit(now_ms).cast("long").alias("_now")).distinct(), "executor_id", "left")
    return ended.withColumn("lease_expires_epoch_ms", F.coalesce("_now", "lease_expires_epoch_ms")).select(*el.columns)


def register_schedules(schedules: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by name; a known schedule keeps its id, status and last firing, a new one is ACTIVE and has not fired."""
    kept = schedules.select("schedule_name", F.struct("schedule_id", "status", "last_fired_at").alias("_old"))
    both = incoming.join(kept, "schedule_name", "left")
    new = both.withColumns({
        "schedule_id": F.coalesce("_old.schedule_id", "schedule_id"), "status": F.coalesce("_old.status", F.lit("ACTIVE")), "last_fired_at": F.col("_old.last_fired_at"),
    })
    return upsert(schedules, new, ["schedule_name"])


def mark_fired(schedules: DataFrame, fired: DataFrame) -> DataFrame:
    """fired(schedule_name, epoch_ms): the last firing, kept as text."""
    both = schedules.join(fired.groupBy("schedule_name").agg(F.max("epoch_ms").cast("string").alias("_at")), "schedule_name", "left")
    return both.withColumn("last_fired_at", F.coalesce("_at", "last_fired_at")).select(*schedules.columns)


def register_queues(queues: DataFrame, incoming: DataFrame, versions: DataFrame, version: str) -> DataFrame:
    """Unknown queues are added; known ones are changed only by the latest version, or where none is registered."""
    may = latest_version(versions).select(F.coalesce(F.col("version_name") == version, F.lit(True)).alias("_may"))  # one row
    known = queues.select("name", F.lit(True).alias("_known"))
    new = incoming.join(known, "name", "left").crossJoin(F.broadcast(may)).where(F.col("_known").isNull() | F.col("_may"))
    return upsert(queues, new, ["name"])


def portable_inputs(positional: Column, named: Column) -> Column:
    """The JSON text of a request's arguments; ``positional`` holds JSON texts, ``named`` one JSON object."""
    args = F.coalesce(F.concat(F.lit("["), F.array_join(positional, ","), F.lit("]")), F.lit("null"))
    return F.concat(F.lit('{"positionalArgs" : '), args, F.lit(', "namedArgs" : '), F.coalesce(named, F.lit("null")), F.lit("}"))


def enqueue_requests(ws: DataFrame, asked: DataFrame) -> DataFrame:
    """What becomes of requests of SQL clients: (request, workflow_uuid, answer, error, inputs, delay_until_epoch_ms).

    ``asked`` has request (its place in the order of arrival), workflow_uuid, name,
    queue_name, deduplication_id, positional_args, named_args and
    delay_until_epoch_ms.  The answer is ``invalid`` with the first broken rule,
    ``existing``, ``duplicate``, DELAYED (any delay, even 0) or ENQUEUED.  A
    missing id is made up.  Of new requests with one deduplication id in one
    queue the first is taken.  A batch names a workflow once.
    """
    # The messages.
    rules = [
        (F.coalesce("name", F.lit("")) == "", "Workflow name cannot be null or empty"),
        (F.coalesce("queue_name", F.lit("")) == "", "Queue name cannot be null or empty"),
        (F.col("named_args").isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_parse_json("named_args")).startswith("OBJECT"), F.lit(False)), "Named args must be a JSON object"),
        (F.col("workflow_uuid") == "", "Workflow ID cannot be an empty string if provided."),
        (F.col("delay_until_epoch_ms") < 0, "delay_until_epoch_ms must be >= 0"),
    ]
    error = F.coalesce(*[F.when(broken, message) for broken, message in rules])
    known = ws.select("workflow_uuid", F.lit(True).alias("_known"))
    pair = ["queue_name", "deduplication_id"]
    held = ws.where(F.col("queue_name").isNotNull() & F.col("deduplication_id").isNotNull()).select(*pair, F.lit(True).alias("_held")).distinct()
    both = asked.withColumn("error", error).join(known, "workflow_uuid", "left").join(held, pair, "left")
    fresh = F.col("error").isNull() & F.col("_known").isNull() & F.col("deduplication_id").isNotNull()
    # Rows that cannot compete are spread by their own request, so that they make no hot partition.
    group = F.when(fresh, F.struct(*pair, F.lit(None).cast(asked.schema["request"].dataType).alias("r"))).otherwise(F.struct(*[F.lit(None).cast("string").alias(c) for c in pair], F.col("request").alias("r")))
    place = F.row_number().over(Window.partitionBy(group).orderBy("request"))
    answer = (
        F.when(F.col("error").isNotNull(), "invalid").when(F.col("_known"), "existing").when(fresh & (F.col("_held").isNotNull() | (F.col("_place") > 1)), "duplicate")
        .when(F.col("delay_until_epoch_ms").isNotNull(), "DELAYED").otherwise("ENQUEUED")
    )
    id_ = F.when(F.col("error").isNull(), F.coalesce("workflow_uuid", F.uuid())).otherwise(F.col("workflow_uuid"))
    return both.withColumn("_place", place).select("request", id_.alias("workflow_uuid"), answer.alias("answer"), "error", portable_inputs(F.col("positional_args"), F.col("named_args")).alias("inputs"), "delay_until_epoch_ms")


def patch_markers(oo: DataFrame, asked: DataFrame) -> DataFrame:
    """The step log with a marker (nothing but its name) for each of asked(workflow_uuid, function_id, function_name) whose step is not taken."""
    keys = ["workflow_uuid", "function_id"]
    new = asked.select(*keys, "function_name").dropDuplicates(keys).join(oo.select(*keys), keys, "left_anti")
    return oo.unionByName(new, allowMissingColumns=True)


def set_events(current: DataFrame, history: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """incoming(workflow_uuid, function_id, key, value) → current values and history; of one key's values the last step's is current."""
    now = last_by(incoming.select("workflow_uuid", "key", "function_id", "value"), ["workflow_uuid", "key"], "function_id")
    return upsert(current, now, ["workflow_uuid", "key"]), upsert(history, incoming, ["workflow_uuid", "function_id", "key"])


def ingest_documents(store: DataFrame, docs: DataFrame, size: int = 500) -> DataFrame:
    """store(doc_id, chunk_index, chunk, embedding) after docs(doc_id, text) is cut, embedded and upserted; chunks beyond a shorter text's end stay."""
    cut = docs.select("doc_id", F.posexplode(text_chunks(F.col("text"), size)).alias("chunk_index", "chunk"))
    return upsert(store, cut.withColumn("embedding", stub_embedding(F.col("chunk"))), ["doc_id", "chunk_index"])


def text_lines(report: DataFrame) -> tuple[str, str, DataFrame]:
    """A report as padded text: header, rule, and the rows' (line).  Widths are one aggregate; the lines stay distributed."""
    cells = report.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in report.columns])
    found = cells.agg(*[F.max(F.length(c)).alias(c) for c in cells.columns]).first()
    width = {c: max(len(c), found[c] or 0) for c in cells.columns}
    header = "  ".join(c.ljust(n) for c, n in width.items()).rstrip()
    return header, "  ".join("-" * n for n in width.values()), cells.select(F.rtrim(F.concat_ws("  ", *[F.rpad(c, n, " ") for c, n in width.items()])).alias("line"))
