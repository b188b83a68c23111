"""Every operator as a registered query over the projected history, with DuckDB SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cron, scalars
from ..operators import admission, apps, debounce, eventlog, integrity, lineage, lookups, recovery, registration, reports, transitions
from ..sources.projection import LEASE_NOW, NOW, History, duck_ctes
from .filters import WorkflowFilter, list_workflows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES = duck_ctes()


def add(name: str, plan: Callable[[History], DataFrame], sql: str | None = None, ctes: dict[str, str] | None = None, recursive: bool = False) -> None:
    """Registers ``plan``; ``sql`` gets the common table expressions that it names."""
    QUERIES[name] = lambda spark, sf_dir: plan(History(spark, sf_dir))
    if sql is not None:
        own = ctes or {}
        used = {n: t for n, t in _CTES.items() if re.search(rf"\b{n}\b", " ".join([sql, *own.values()]))} | own
        ORACLES[name] = (f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({t})" for n, t in used.items()) + " " if used else "") + sql


SHOW = ["workflow_uuid", "status", "created_at"]
SHOWN = "workflow_uuid, status, created_at"


def _filter(label: str, where: str, /, **options) -> None:
    add(f"fil_{label}", lambda h: list_workflows(h.ws, WorkflowFilter(**options)).select(*SHOW), f"SELECT {SHOWN} FROM ws WHERE {where}")


# -- Scans, projections, filters, sorts, limits
add("scan_workflows", lambda h: h.ws, "SELECT * FROM ws")
add("scan_steps", lambda h: h.oo, "SELECT * FROM oo")
add("inline_capabilities", lambda h: reports.capabilities(h.el.groupBy("executor_id", "lease_expires_epoch_ms").agg(F.collect_list(F.struct(F.col("cap_name").alias("name"), F.col("cap_version").alias("version"))).alias("ex_capabilities"))), "SELECT DISTINCT cap_name, cap_version FROM el")
add("json_capabilities", lambda h: h.el.select("executor_id", F.to_json(F.array(F.struct(F.col("cap_name").alias("name"), F.col("cap_version").alias("version")))).alias("j")).select("executor_id", F.inline(F.from_json("j", "array<struct<name:string,version:string>>"))), "SELECT executor_id, cap_name AS name, cap_version AS version FROM el")
_filter("status", "status IN ('PENDING', 'ERROR')", status=["PENDING", "ERROR"])
_filter("name", "name = 'building/1'", name="building/1")
_filter("queue_name", "queue_name IN ('q1', 'q2')", queue_name=["q1", "q2"])
_filter("executor_id", "executor_id = 'exec-7'", executor_id="exec-7")
_filter("application_version", "application_version = 'v2'", application_version="v2")
_filter("created", f"created_at >= {NOW - 86_400_000 * 900} AND created_at <= {NOW}", created_after=NOW - 86_400_000 * 900, created_before=NOW)
_filter("workflow_ids", "workflow_uuid IN ('wf-0000000001', 'wf-0000000017', 'none')", workflow_ids=["wf-0000000001", "wf-0000000017", "none"])
_filter("authenticated_user", "authenticated_user = 'user3'", authenticated_user="user3")
_filter("forked_from", "forked_from = 'wf-0000000022'", forked_from="wf-0000000022")
_filter("parent", "parent_workflow_id = 'wf-0000000002'", parent_workflow_id="wf-0000000002")
_filter("deduplication_id", "deduplication_id = 'd9'", deduplication_id="d9")
_filter("completed", f"completed_at >= {NOW - 86_400_000 * 700} AND completed_at <= {NOW}", completed_after=NOW - 86_400_000 * 700, completed_before=NOW)
_filter("dequeued", f"started_at_epoch_ms >= {NOW - 86_400_000 * 700} AND started_at_epoch_ms <= {NOW}", dequeued_after=NOW - 86_400_000 * 700, dequeued_before=NOW)
_filter("schedule_name", "schedule_name = 'nightly1'", schedule_name="nightly1")
_filter("is_debounced", "is_debounced", is_debounced=True)
_filter("id_prefix", "workflow_uuid LIKE 'wf-00000_00%'", workflow_id_prefix="wf-00000_00")
_filter("has_parent", "parent_workflow_id IS NOT NULL", has_parent=True)
_filter("no_parent", "parent_workflow_id IS NULL", has_parent=False)
_filter("attributes", "attributes::JSON->>'tier' = 't1' AND (attributes::JSON->>'n')::INT = 3 AND list_contains(attributes::JSON->>'$.tags[*]', 'b1')", attributes={"tier": "t1", "n": 3.0, "tags": ["b1"]})
_filter("queues_only", "queue_name IS NOT NULL", queues_only=True)
add("prj_without_payload", lambda h: list_workflows(h.ws, WorkflowFilter(load_input=False, load_output=False)).select("workflow_uuid", "inputs", "output", "error"), "SELECT workflow_uuid, NULL::VARCHAR AS inputs, NULL::VARCHAR AS output, NULL::VARCHAR AS error FROM ws")
add("prj_known_status", lambda h: h.ws.select("workflow_uuid", scalars.known_status(F.col("status")).alias("status"), scalars.is_terminal(F.col("status")).alias("terminal"), scalars.is_retryable(F.col("status")).alias("retryable")), "SELECT workflow_uuid, status, status IN ('SUCCESS','ERROR','CANCELLED','MAX_RECOVERY_ATTEMPTS_EXCEEDED') AS terminal, status IN ('ERROR','CANCELLED','MAX_RECOVERY_ATTEMPTS_EXCEEDED') AS retryable FROM ws")
add("srt_page", lambda h: list_workflows(h.ws, WorkflowFilter(limit=25, offset=50)).select(*SHOW), f"SELECT {SHOWN} FROM ws ORDER BY created_at DESC, workflow_uuid LIMIT 25 OFFSET 50")
add("srt_ascending", lambda h: list_workflows(h.ws, WorkflowFilter(sort="asc", limit=40)).select(*SHOW), f"SELECT {SHOWN} FROM ws ORDER BY created_at, workflow_uuid LIMIT 40")

# -- Point lookups
add("pnt_workflow", lambda h: lookups.workflow(h.ws, "wf-0000000042").select(*SHOW), f"SELECT {SHOWN} FROM ws WHERE workflow_uuid = 'wf-0000000042'")
add("pnt_steps", lambda h: lookups.steps(h.oo, "wf-0000000042"), "SELECT function_id, function_name, output, error, child_workflow_id, started_at_epoch_ms, completed_at_epoch_ms FROM oo WHERE workflow_uuid = 'wf-0000000042'")
add("pnt_results", lambda h: lookups.results(h.ws), "SELECT workflow_uuid, CASE status WHEN 'SUCCESS' THEN 'output' WHEN 'ERROR' THEN 'error' WHEN 'CANCELLED' THEN 'cancelled' WHEN 'MAX_RECOVERY_ATTEMPTS_EXCEEDED' THEN 'max_recovery_attempts_exceeded' ELSE 'pending' END AS kind, CASE status WHEN 'SUCCESS' THEN output WHEN 'ERROR' THEN error END AS value FROM ws")
add("pnt_deduplicated", lambda h: lookups.deduplicated(h.ws, "q1", "d9"), "SELECT workflow_uuid FROM ws WHERE queue_name = 'q1' AND deduplication_id = 'd9'")
add("pnt_debounce_holders", lambda h: lookups.debounce_holders(h.ws), "SELECT queue_name, deduplication_id, workflow_uuid, is_debounced, name FROM ws WHERE queue_name IS NOT NULL AND deduplication_id IS NOT NULL")
ASKED = ASKED_STEPS = "SELECT workflow_uuid, function_id, CASE WHEN function_id = 3 THEN 'other' ELSE 'charge' END AS function_name FROM (SELECT workflow_uuid, unnest([1, 3, 9])::INT AS function_id FROM ws)"


def _asked(h: History) -> DataFrame:
    return h.ws.select("workflow_uuid", F.explode(F.array(F.lit(1), F.lit(3), F.lit(9))).alias("function_id")).withColumn("function_name", F.when(F.col("function_id") == 3, "other").otherwise("charge"))


add("pnt_check_children", lambda h: lookups.check_children(_asked(h), h.oo), "SELECT a.workflow_uuid, a.function_id, CASE WHEN o.function_name IS NULL THEN 'none' WHEN o.function_name <> a.function_name THEN 'mismatch' WHEN o.child_workflow_id IS NULL THEN 'none' ELSE 'existing' END AS answer, CASE WHEN o.function_name = a.function_name THEN o.child_workflow_id END AS child FROM asked a LEFT JOIN oo o USING (workflow_uuid, function_id)", {"asked": ASKED})
add("pnt_check_executions", lambda h: lookups.check_executions(_asked(h), h.ws, h.oo), "SELECT a.workflow_uuid, a.function_id, CASE WHEN w.status IS NULL THEN 'nonexistent_workflow' WHEN w.status = 'CANCELLED' THEN 'cancelled' WHEN w.status = 'CANCELLING' THEN 'cancelling' WHEN o.function_name IS NULL THEN 'none' WHEN o.function_name <> a.function_name THEN 'unexpected_step' WHEN o.error IS NOT NULL THEN 'replay_failure' ELSE 'replay' END AS answer FROM asked a LEFT JOIN ws w USING (workflow_uuid) LEFT JOIN oo o ON o.workflow_uuid = a.workflow_uuid AND o.function_id = a.function_id", {"asked": ASKED})
add("pnt_patches", lambda h: lookups.patches(_asked(h), h.oo), "SELECT a.workflow_uuid, a.function_id, coalesce(o.function_name = a.function_name, true) AS patched, coalesce(o.function_name = a.function_name, false) AS deprecated FROM asked a LEFT JOIN oo o USING (workflow_uuid, function_id)", {"asked": ASKED})
add("pnt_cancellations", lambda h: lookups.cancellations(h.ws), "SELECT workflow_uuid, CASE status WHEN 'CANCELLED' THEN 'cancelled' WHEN 'CANCELLING' THEN 'cancelling' END AS cancellation FROM ws")
add("pnt_deadlines", lambda h: lookups.deadlines(h.ws, NOW), f"SELECT workflow_uuid, coalesce(workflow_deadline_epoch_ms, {NOW} + workflow_timeout_ms) AS deadline FROM ws")
add("pnt_existing", lambda h: lookups.existing(h.ws, h.ev.select("workflow_uuid")), "SELECT workflow_uuid FROM ws WHERE workflow_uuid IN (SELECT workflow_uuid FROM ev)")
add("pnt_children", lambda h: lookups.children(h.ws, "wf-0000000003"), "SELECT workflow_uuid FROM ws WHERE parent_workflow_id = 'wf-0000000003'")
add("pnt_queue", lambda h: h.qs.where(F.col("name") == "q1"), "SELECT * FROM qs WHERE name = 'q1'")

# -- Joins, recovery, orphans
DEAD = [f"exec-{i}" for i in range(1, 20, 2)]
DEAD_SQL = "(" + ", ".join(f"'{d}'" for d in DEAD) + ")"
LIVE = f"SELECT * FROM el WHERE lease_expires_epoch_ms > {LEASE_NOW}"
CAPS = "SELECT DISTINCT cap_name, cap_version FROM live"
CAN = "EXISTS (SELECT 1 FROM caps WHERE cap_name = ws.name AND cap_version IS NOT DISTINCT FROM ws.ex_workflow_version)"
OWN = {"live": LIVE, "caps": CAPS}


def _caps(h: History) -> DataFrame:
    return reports.capabilities(reports.live_executors(h.el, LEASE_NOW))


add("orphans", lambda h: reports.orphans(h.ws, h.el, LEASE_NOW), f"SELECT name, application_version, ex_workflow_version, count(*) AS count, min(created_at) AS oldest_created_at, min(workflow_uuid) AS sample_id, CASE WHEN (SELECT count(*) FROM live) = 0 THEN 'no_live_executors' WHEN EXISTS (SELECT 1 FROM caps WHERE cap_name = ws.name) THEN 'version_mismatch' ELSE 'name_not_registered' END AS reason FROM ws WHERE status = 'PENDING' AND queue_name IS NULL AND NOT EXISTS (SELECT 1 FROM live WHERE cap_name IS NULL) AND NOT EXISTS (SELECT 1 FROM live WHERE live.executor_id = ws.executor_id) AND NOT {CAN} GROUP BY ALL", OWN)
add("declined", lambda h: reports.declined(h.ws, DEAD, _caps(h), h.ev.select("workflow_uuid")), f"SELECT name, application_version, ex_workflow_version, claimable, count(*) AS count, min(created_at) AS oldest_created_at, min(workflow_uuid) AS sample_id, CASE WHEN claimable THEN 'locked_elsewhere' WHEN EXISTS (SELECT 1 FROM caps WHERE cap_name = w.name) THEN 'version_mismatch' ELSE 'name_not_registered' END AS reason FROM (SELECT *, {CAN} AS claimable FROM ws WHERE status = 'PENDING' AND queue_name IS NULL AND executor_id IN {DEAD_SQL} AND workflow_uuid NOT IN (SELECT workflow_uuid FROM ev)) w GROUP BY ALL", OWN)
add("joi_expired_executors", lambda h: reports.expired_pending_executors(h.ws, h.el, LEASE_NOW), f"SELECT DISTINCT ws.executor_id FROM ws LEFT JOIN el USING (executor_id) WHERE status = 'PENDING' AND (lease_expires_epoch_ms IS NULL OR lease_expires_epoch_ms <= {LEASE_NOW})")
add("joi_stale_cancelling", lambda h: reports.stale_cancelling(h.ws, h.el, LEASE_NOW), f"SELECT workflow_uuid FROM ws LEFT JOIN el USING (executor_id) WHERE status = 'CANCELLING' AND (lease_expires_epoch_ms IS NULL OR lease_expires_epoch_ms <= {LEASE_NOW})")
add("joi_unwindable", lambda h: reports.unwindable(h.ws, h.oo), "SELECT workflow_uuid, name <> 'DBOS.compensate' AND EXISTS (SELECT 1 FROM oo WHERE oo.workflow_uuid = ws.workflow_uuid AND (ex_compensation IS NOT NULL OR function_name IN ('DBOS.getResult', 'DBOS.enqueue', 'DBOS.forkWorkflow'))) AS unwindable FROM ws")
add("rec_reclaimable", lambda h: reports.reclaimable(h.ws, DEAD, _caps(h)), f"SELECT workflow_uuid, created_at FROM ws WHERE status = 'PENDING' AND queue_name IS NULL AND executor_id IN {DEAD_SQL} AND {CAN}", OWN)
add("rec_reclaim_batch", lambda h: reports.reclaimable(h.ws, DEAD, _caps(h), 10), f"SELECT workflow_uuid, created_at FROM ws WHERE status = 'PENDING' AND queue_name IS NULL AND executor_id IN {DEAD_SQL} AND {CAN} ORDER BY created_at, workflow_uuid LIMIT 10", OWN)
add("rec_queued_pending", lambda h: reports.queued_pending(h.ws, DEAD), f"SELECT workflow_uuid FROM ws WHERE status = 'PENDING' AND queue_name IS NOT NULL AND executor_id IN {DEAD_SQL}")
add("rec_recovered", lambda h: reports.recovered(h.ws, DEAD, _caps(h)), f"SELECT workflow_uuid FROM ws WHERE status = 'PENDING' AND executor_id IN {DEAD_SQL} AND (queue_name IS NOT NULL OR {CAN})", OWN)

# -- Aggregates and top-k
add("agg_delayed_wake", lambda h: reports.delayed_wake(h.ws), "SELECT min(delay_until_epoch_ms) AS wake_epoch_ms FROM ws WHERE status = 'DELAYED'")
add("agg_partitions", lambda h: reports.partitions(h.ws), "SELECT DISTINCT queue_name, queue_partition_key FROM ws WHERE status = 'ENQUEUED' AND queue_partition_key IS NOT NULL")
add("agg_latest_version", lambda h: reports.latest_version(h.vs), "SELECT version_name FROM vs ORDER BY version_timestamp DESC, version_name DESC LIMIT 1")
add("agg_queue_depth", lambda h: reports.queue_depth(h.ws), "SELECT queue_name, count(*) AS depth FROM ws WHERE status = 'ENQUEUED' AND queue_name IS NOT NULL GROUP BY 1")
add("agg_pending_by_expired", lambda h: reports.pending_by_expired_executor(h.ws, h.el, LEASE_NOW), "SELECT ws.executor_id, count(*) AS pending FROM ws LEFT JOIN el USING (executor_id) WHERE status = 'PENDING' AND (lease_expires_epoch_ms IS NULL OR lease_expires_epoch_ms <= 0) GROUP BY 1")
add("agg_in_flight", lambda h: reports.in_flight(h.ws), "SELECT application_version, status, count(*) AS count FROM ws WHERE status IN ('PENDING', 'ENQUEUED', 'DELAYED') GROUP BY 1, 2")
add("agg_success_by_prefix", lambda h: h.ws.where((F.col("status") == "SUCCESS") & F.col("workflow_uuid").like("wf-00000001%")).agg(F.count("*").alias("done")), "SELECT count(*) AS done FROM ws WHERE status = 'SUCCESS' AND workflow_uuid LIKE 'wf-00000001%'")
add("agg_outcome_tally", lambda h: reports.outcome_tally(h.ws), "SELECT name, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("SUCCESS", "ERROR", "CANCELLED", "MAX_RECOVERY_ATTEMPTS_EXCEEDED")) + " FROM ws WHERE status IN ('SUCCESS','ERROR','CANCELLED','MAX_RECOVERY_ATTEMPTS_EXCEEDED') GROUP BY 1")
add("agg_latency", lambda h: reports.latency_summary(h.oo), "SELECT function_name, n, sum(d)::DOUBLE / n AS mean, min(d) AS least, min(CASE WHEN r = n // 2 THEN d END) AS median, min(CASE WHEN r = least(n - 1, ceil(n * 95 / 100.0)::BIGINT - 1) THEN d END) AS p95, max(d) AS most FROM (SELECT function_name, completed_at_epoch_ms - started_at_epoch_ms AS d, count(*) OVER (PARTITION BY function_name) AS n, row_number() OVER (PARTITION BY function_name ORDER BY completed_at_epoch_ms - started_at_epoch_ms) - 1 AS r FROM oo) GROUP BY 1, 2")
add("agg_fitted_line", lambda h: reports.fitted_line(h.oo), "SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM (SELECT count(*)::DOUBLE AS x, sum(completed_at_epoch_ms - started_at_epoch_ms)::DOUBLE AS y FROM oo GROUP BY workflow_uuid)")
add("agg_round_trips", lambda h: h.oo.groupBy("workflow_uuid").agg(F.count("*").alias("statements"), F.count(F.when(F.col("function_name") == "charge", 1)).alias("transactions")).withColumn("round_trips", F.col("statements") + 2 * F.col("transactions")), "SELECT *, statements + 2 * transactions AS round_trips FROM (SELECT workflow_uuid, count(*) AS statements, count(*) FILTER (function_name = 'charge') AS transactions FROM oo GROUP BY 1)")
add("top_recently_failed", lambda h: reports.recently_failed(h.ws), "SELECT workflow_uuid, name, status, updated_at FROM ws WHERE status IN ('ERROR', 'MAX_RECOVERY_ATTEMPTS_EXCEEDED') ORDER BY updated_at DESC, workflow_uuid LIMIT 50")
add("top_running", lambda h: reports.running(h.ws), "SELECT workflow_uuid, name, executor_id, created_at FROM ws WHERE status = 'PENDING'")
add("met_lifetimes", lambda h: reports.lifetimes(h.ws), "SELECT name, count(completed_at) AS completed, sum(completed_at - created_at)::BIGINT AS lifetime_ms, max(CASE WHEN queue_name IS NOT NULL THEN started_at_epoch_ms - created_at END) AS longest_wait_ms FROM ws GROUP BY 1")
add("met_step_durations", lambda h: reports.durations(h.oo).groupBy("function_name").agg(F.count("*").alias("n"), F.sum("duration").alias("total")), "SELECT function_name, count(*) AS n, sum(completed_at_epoch_ms - started_at_epoch_ms)::BIGINT AS total FROM oo GROUP BY 1")
add("met_parked", lambda h: reports.parked(h.oo), "SELECT workflow_uuid, function_id, lead(started_at_epoch_ms) OVER (PARTITION BY workflow_uuid ORDER BY function_id) - completed_at_epoch_ms AS parked_ms FROM oo")
add("met_exactly_once", lambda h: reports.exactly_once(h.oo), "SELECT workflow_uuid, function_name, count(*) AS runs FROM oo GROUP BY 1, 2 HAVING count(*) > 1")
add("snk_ages", lambda h: h.ws.select("workflow_uuid", scalars.age(F.lit(NOW) - F.col("created_at")).alias("age")).where(F.col("age").isNotNull()), f"SELECT workflow_uuid, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age FROM (SELECT workflow_uuid, floor(({NOW} - created_at) / 1000.0)::BIGINT AS s FROM ws)")
add("snk_json", lambda h: reports.rendered(h.ws.where(F.col("completed_at").isNotNull())), "SELECT workflow_uuid, '{\"WorkflowUUID\":\"' || workflow_uuid || '\",\"Status\":\"' || status || '\",\"WorkflowName\":\"' || name || '\",\"created_at\":\"' || created_at || '\",\"updated_at\":\"' || updated_at || '\",\"started_at_epoch_ms\":\"' || started_at_epoch_ms || '\",\"completed_at\":\"' || completed_at || '\"}' AS json FROM ws WHERE completed_at IS NOT NULL")

# -- Event log, mailboxes, streams
add("win_latest_events", lambda h: eventlog.latest_events(h.ev), "SELECT workflow_uuid, key, max_by(value, function_id) AS value, max(function_id) AS function_id FROM ev GROUP BY 1, 2")
add("win_latest_before", lambda h: eventlog.latest_before(h.ev, 40), "SELECT workflow_uuid, key, value FROM ev WHERE function_id < 40 QUALIFY row_number() OVER (PARTITION BY workflow_uuid, key ORDER BY function_id DESC) = 1")
add("win_step_ids", lambda h: eventlog.step_ids(h.ev.select("workflow_uuid", "key", "at_ms", F.col("function_id").alias("seq")), ["at_ms", "seq"]), "SELECT workflow_uuid, key, at_ms, function_id AS seq, row_number() OVER (PARTITION BY workflow_uuid ORDER BY at_ms, function_id) - 1 AS function_id FROM ev")
add("win_mailbox_heads", lambda h: eventlog.mailbox_heads(h.nt), "SELECT destination_uuid, topic, message_uuid, message FROM nt WHERE NOT consumed QUALIFY row_number() OVER (PARTITION BY destination_uuid, topic ORDER BY created_at_epoch_ms, message_uuid) = 1")
add("str_consume", lambda h: eventlog.consume(h.nt), "SELECT destination_uuid, topic, message, created_at_epoch_ms, message_uuid, consumed OR (NOT consumed AND row_number() OVER (PARTITION BY destination_uuid, topic, consumed ORDER BY created_at_epoch_ms, message_uuid) = 1) AS consumed FROM nt")
add("str_waiting", lambda h: eventlog.waiting(h.ws, h.nt), "SELECT workflow_uuid FROM ws WHERE workflow_uuid IN (SELECT destination_uuid FROM nt WHERE NOT consumed)")
add("str_send", lambda h: eventlog.send(h.nt.where(F.col("created_at_epoch_ms") < 2), h.nt.withColumn("topic", F.when(F.col("topic") != "user", F.col("topic"))), h.ws).select("destination_uuid", "topic", "message_uuid"), "SELECT destination_uuid, CASE WHEN topic = 'user' THEN '__null__topic__' ELSE topic END AS topic, message_uuid FROM nt WHERE created_at_epoch_ms >= 2 AND destination_uuid IN (SELECT workflow_uuid FROM ws)")
add("str_readable", lambda h: eventlog.readable(h.st), 'SELECT * FROM st WHERE "offset" < coalesce((SELECT min(s."offset") FROM st s WHERE s.value = \'__dbos_stream_closed__\' AND s.workflow_uuid = st.workflow_uuid AND s.key = st.key), 999999)')
add("str_pages", lambda h: eventlog.pages(h.st, 3), "SELECT workflow_uuid, key, count(*) FILTER (value <> '__dbos_stream_closed__') AS n_values, max(\"offset\") + 1 AS next_offset, bool_or(value = '__dbos_stream_closed__') AS closed FROM (SELECT *, count(*) FILTER (value = '__dbos_stream_closed__') OVER (PARTITION BY workflow_uuid, key ORDER BY \"offset\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM st WHERE \"offset\" >= 3) WHERE c = 0 GROUP BY 1, 2")
add("str_append", lambda h: eventlog.append(h.st, h.ev.select("workflow_uuid", "key", F.col("function_id").alias("seq"), "value")), 'SELECT e.workflow_uuid, e.key, n + row_number() OVER (PARTITION BY e.workflow_uuid, e.key ORDER BY e.function_id) - 1 AS "offset", e.value FROM ev e JOIN (SELECT workflow_uuid, key, max("offset") + 1 AS n, bool_or(value = \'__dbos_stream_closed__\') AS c FROM st GROUP BY 1, 2) s ON e.workflow_uuid = s.workflow_uuid AND e.key = s.key WHERE NOT c')
add("str_ends", lambda h: eventlog.halted_streams(h.st, h.ws), "SELECT workflow_uuid, key, bool_or(value = '__dbos_stream_closed__') OR bool_or(coalesce(status NOT IN ('PENDING', 'ENQUEUED', 'DELAYED'), false)) AS ends FROM st LEFT JOIN ws USING (workflow_uuid) GROUP BY 1, 2")
add("str_change_feed", lambda h: eventlog.change_feed(h.ws, transitions.promote_delayed(h.ws, NOW)[0]), f"SELECT 'status' AS channel, workflow_uuid AS payload FROM ws WHERE status = 'DELAYED' AND delay_until_epoch_ms <= {NOW} UNION ALL SELECT DISTINCT 'queue', 'ENQUEUED::' || queue_name FROM ws WHERE status = 'DELAYED' AND delay_until_epoch_ms <= {NOW}")
add("str_park", lambda h: h.ws.select("workflow_uuid", scalars.parks(F.col("delay_until_epoch_ms") - NOW, F.col("recovery_attempts")).alias("parks")), f"SELECT workflow_uuid, delay_until_epoch_ms - {NOW} > 60000 AND recovery_attempts < 500 AS parks FROM ws")

# -- Queue admission
LOCAL = [("q0", 1), ("q1", 7), ("q2", 2)]
LOCAL_SQL = "SELECT * FROM (VALUES ('q0', 1), ('q1', 7), ('q2', 2)) t(queue_name, local_running)"
QUEUE = {
    "loc": LOCAL_SQL,
    "recent": f"SELECT queue_name, count(*) AS recent FROM ws JOIN qs ON queue_name = qs.name WHERE rate_limited AND status NOT IN ('ENQUEUED', 'DELAYED') AND rate_limit_max IS NOT NULL AND started_at_epoch_ms > {NOW} - rate_limit_period_ms GROUP BY 1",
    "cap": "SELECT qs.name AS queue_name, CASE WHEN worker_concurrency IS NULL AND concurrency IS NULL THEN NULL ELSE least(greatest(worker_concurrency - coalesce(local_running, 0), 0), greatest(concurrency - coalesce(r.running, 0), 0)) END AS slots, CASE WHEN rate_limit_max IS NOT NULL THEN greatest(rate_limit_max - coalesce(recent, 0), 0) END AS rate_left, coalesce(recent, 0) >= rate_limit_max AS limited FROM qs LEFT JOIN recent ON qs.name = recent.queue_name LEFT JOIN loc ON qs.name = loc.queue_name LEFT JOIN (SELECT queue_name, count(*) AS running FROM ws WHERE status = 'PENDING' GROUP BY 1) r ON qs.name = r.queue_name",
}
QUEUE["cap"] = QUEUE["cap"].replace("greatest(worker_concurrency - coalesce(local_running, 0), 0)", "CASE WHEN worker_concurrency IS NOT NULL THEN greatest(worker_concurrency - coalesce(local_running, 0), 0) END").replace("greatest(concurrency - coalesce(r.running, 0), 0)", "CASE WHEN concurrency IS NOT NULL THEN greatest(concurrency - coalesce(r.running, 0), 0) END")


def _ranked(keys: str) -> str:
    return f"SELECT ws.queue_name, queue_partition_key, workflow_uuid, row_number() OVER (PARTITION BY {keys} ORDER BY priority, created_at, workflow_uuid) AS rank FROM ws WHERE status = 'ENQUEUED' AND (application_version = 'v1' OR application_version IS NULL)"


CLAIMED = "SELECT r.* FROM ranked r JOIN cap USING (queue_name) WHERE NOT coalesce(limited, false) AND rank <= coalesce(least(slots, rate_left), 9223372036854775807)"


def _local(h: History) -> DataFrame:
    return h.spark.sql(LOCAL_SQL)


add("que_recent_starts", lambda h: admission.recent_starts(h.ws, h.qs, NOW), "SELECT * FROM recent", {k: QUEUE[k] for k in ("recent",)})
add("que_capacity", lambda h: admission.capacity(h.ws, h.qs, _local(h), NOW), "SELECT * FROM cap", QUEUE)
add("que_dequeue", lambda h: admission.dequeue(h.ws, h.qs, _local(h), NOW, "v1", "v1"), CLAIMED, QUEUE | {"ranked": _ranked("queue_name")})
# A dequeue by itself for each partition key, so every count is of that key alone.
PARTS = {
    "part": "SELECT DISTINCT queue_name, queue_partition_key FROM ws WHERE status = 'ENQUEUED' AND queue_name IS NOT NULL AND queue_partition_key IS NOT NULL",
    "plocal": "SELECT queue_name, 'p3' AS queue_partition_key, local_running FROM (VALUES ('q0', 1), ('q1', 7), ('q2', 2)) t(queue_name, local_running)",
    "pcount": f"SELECT p.queue_name, p.queue_partition_key, (SELECT count(*) FROM ws WHERE ws.queue_name = p.queue_name AND ws.queue_partition_key = p.queue_partition_key AND rate_limited AND status NOT IN ('ENQUEUED', 'DELAYED') AND started_at_epoch_ms > {NOW} - rate_limit_period_ms) AS recent, (SELECT count(*) FROM ws WHERE ws.queue_name = p.queue_name AND ws.queue_partition_key = p.queue_partition_key AND status = 'PENDING') AS running FROM part p JOIN qs ON qs.name = p.queue_name",
    "pcap": "SELECT c.queue_name, c.queue_partition_key, CASE WHEN worker_concurrency IS NULL THEN CASE WHEN concurrency IS NOT NULL THEN greatest(concurrency - running, 0) END WHEN concurrency IS NULL THEN greatest(worker_concurrency - coalesce(local_running, 0), 0) ELSE least(greatest(worker_concurrency - coalesce(local_running, 0), 0), greatest(concurrency - running, 0)) END AS slots, CASE WHEN rate_limit_max IS NOT NULL THEN greatest(rate_limit_max - recent, 0) END AS rate_left, rate_limit_max IS NOT NULL AND recent >= rate_limit_max AS limited FROM pcount c JOIN qs ON qs.name = c.queue_name LEFT JOIN plocal l ON l.queue_name = c.queue_name AND l.queue_partition_key = c.queue_partition_key",
}


def _plocal(h: History) -> DataFrame:
    return h.spark.sql(PARTS["plocal"])


add("que_dequeue_partitions", lambda h: admission.dequeue(h.ws, h.qs, _plocal(h), NOW, "v1", "v1", per_partition=True), "SELECT queue_name, queue_partition_key, workflow_uuid, row_number() OVER (PARTITION BY queue_name, queue_partition_key ORDER BY priority, created_at, workflow_uuid) AS rank FROM ws JOIN pcap USING (queue_name, queue_partition_key) WHERE status = 'ENQUEUED' AND (application_version = 'v1' OR application_version IS NULL) AND NOT limited QUALIFY rank <= coalesce(least(slots, rate_left), 9223372036854775807)", PARTS)
add("que_recent_starts_partitions", lambda h: admission.recent_starts(h.ws, h.qs, NOW, admission.PARTITION), f"SELECT queue_name, queue_partition_key, count(*) AS recent FROM ws JOIN qs ON queue_name = qs.name WHERE rate_limited AND status NOT IN ('ENQUEUED', 'DELAYED') AND rate_limit_max IS NOT NULL AND started_at_epoch_ms > {NOW} - rate_limit_period_ms GROUP BY 1, 2")
add("que_running_partitions", lambda h: admission.running_counts(h.ws, admission.PARTITION), "SELECT queue_name, queue_partition_key, count(*) AS running FROM ws WHERE status = 'PENDING' AND queue_name IS NOT NULL GROUP BY 1, 2")
add("que_capacity_partitions", lambda h: admission.capacity(h.ws, h.qs, _plocal(h), NOW, per_partition=True).withColumn("limited", F.coalesce("limited", F.lit(False))), "SELECT * FROM pcap", PARTS)
REGISTRY = "SELECT * FROM (VALUES ('building/1', '7'), ('building/1', '8'), ('machinery/1', '2')) t(name, version)"
add("que_claim_registered", lambda h: admission.claim(h.ws, admission.dequeue(h.ws, h.qs, _local(h), NOW, "v1", "v1"), NOW, "v1", "me", h.qs, h.spark.sql(REGISTRY)).select("workflow_uuid", "status", "rate_limited", "ex_workflow_version"), f"SELECT workflow_uuid, CASE WHEN hit THEN 'PENDING' ELSE status END AS status, CASE WHEN hit THEN queue_name IN (SELECT name FROM qs WHERE rate_limit_max IS NOT NULL) ELSE rate_limited END AS rate_limited, CASE WHEN hit THEN (SELECT min(version) FROM reg WHERE reg.name = w.name) ELSE ex_workflow_version END AS ex_workflow_version FROM (SELECT *, workflow_uuid IN (SELECT workflow_uuid FROM ({CLAIMED})) AS hit FROM ws) w", QUEUE | {"ranked": _ranked("queue_name"), "reg": REGISTRY})
TICKS = "select queue_name as tick, case when r then 'limited' when n > 0 then 'claimed' else 'idle' end as outcome from (select queue_name, queue_partition_key, bool_or(rate_limited) as r, count(*) as n from ws where queue_name is not null group by queue_name, queue_partition_key) t"
add("que_tick_summary", lambda h: admission.tick_summary(_rows(h, TICKS.replace("from ws", "FROM ws"))), "SELECT tick, CASE WHEN bool_or(outcome = 'claimed') THEN 'claimed' WHEN bool_or(outcome = 'limited') THEN 'limited' ELSE 'idle' END AS summary FROM k GROUP BY 1", {"k": TICKS})
add("que_throughput", lambda h: h.qs.select("name", admission.throughput(F.col("worker_concurrency"), F.lit(50)).alias("most_per_second")), "SELECT name, worker_concurrency * 1000 / 50.0 AS most_per_second FROM qs")
add("que_outcomes", lambda h: admission.outcomes(h.ws, h.qs, _local(h), NOW, "v1", "v1"), f"SELECT cap.queue_name, coalesce(n, 0) AS claimed, CASE WHEN coalesce(limited, false) THEN 'rate_limited' WHEN slots = 0 THEN 'no_capacity' WHEN coalesce(n, 0) = 0 THEN 'empty' END AS blocked FROM cap LEFT JOIN (SELECT queue_name, count(*) AS n FROM ({CLAIMED}) GROUP BY 1) c ON cap.queue_name = c.queue_name", QUEUE | {"ranked": _ranked("queue_name")})
add("que_claim", lambda h: admission.claim(h.ws, admission.dequeue(h.ws, h.qs, _local(h), NOW, "v1", "v1"), NOW, "v1", "me").select("workflow_uuid", "status", "application_version", "executor_id", "started_at_epoch_ms", "workflow_deadline_epoch_ms"), f"SELECT workflow_uuid, CASE WHEN hit THEN 'PENDING' ELSE status END AS status, CASE WHEN hit THEN 'v1' ELSE application_version END AS application_version, CASE WHEN hit THEN 'me' ELSE executor_id END AS executor_id, CASE WHEN hit THEN {NOW} ELSE started_at_epoch_ms END AS started_at_epoch_ms, CASE WHEN hit THEN coalesce(workflow_deadline_epoch_ms, {NOW} + workflow_timeout_ms) ELSE workflow_deadline_epoch_ms END AS workflow_deadline_epoch_ms FROM (SELECT *, workflow_uuid IN (SELECT workflow_uuid FROM ({CLAIMED})) AS hit FROM ws)", QUEUE | {"ranked": _ranked("queue_name")})
add("que_rate_audit", lambda h: admission.rate_audit(h.ws, 86_400_000), "SELECT queue_name, max(n) AS most_starts FROM (SELECT queue_name, count(*) OVER (PARTITION BY queue_name ORDER BY started_at_epoch_ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS n FROM ws WHERE queue_name IS NOT NULL AND started_at_epoch_ms IS NOT NULL) GROUP BY 1")
add("app_fair_share", lambda h: admission.fair_share(h.ws, 3, 20), "SELECT queue_name, authenticated_user, workflow_uuid FROM (SELECT * FROM ws WHERE status = 'ENQUEUED' QUALIFY row_number() OVER (PARTITION BY queue_name, authenticated_user ORDER BY priority, created_at, workflow_uuid) <= 3) QUALIFY row_number() OVER (PARTITION BY queue_name ORDER BY priority, created_at, workflow_uuid) <= 20")

# -- Transitions
NEXT = "workflow_uuid, {status} AS status, {queue} AS queue_name, {dedup} AS deduplication_id, {started} AS started_at_epoch_ms, {completed} AS completed_at"
NEXT_COLUMNS = ["workflow_uuid", "status", "queue_name", "deduplication_id", "started_at_epoch_ms", "completed_at"]


def _next(hit: str, **change: str) -> str:
    old = {"status": "status", "queue": "queue_name", "dedup": "deduplication_id", "started": "started_at_epoch_ms", "completed": "completed_at"}
    return "SELECT " + NEXT.format(**{k: f"CASE WHEN {hit} THEN {change[k]} ELSE {v} END" if k in change else v for k, v in old.items()})


UNWIND = "SELECT workflow_uuid FROM oo WHERE ex_compensation IS NOT NULL OR function_name IN ('DBOS.getResult', 'DBOS.enqueue', 'DBOS.forkWorkflow')"
SLOW = "status = 'PENDING' AND workflow_uuid IN (SELECT workflow_uuid FROM u)"
RESTART = {"status": "'ENQUEUED'", "queue": "coalesce(queue_name, '_dbos_internal_queue')", "dedup": "NULL", "started": "NULL", "completed": "NULL"}
EVEN = "(SELECT workflow_uuid FROM ws WHERE recovery_attempts % 2 = 0)"


def _even(h: History) -> DataFrame:
    return h.ws.where(F.col("recovery_attempts") % 2 == 0).select("workflow_uuid")


CANCEL = _next("{hit}", status=f"CASE WHEN {SLOW} THEN 'CANCELLING' ELSE 'CANCELLED' END", queue=f"CASE WHEN {SLOW} THEN queue_name END", dedup="NULL", started=f"CASE WHEN {SLOW} THEN started_at_epoch_ms END", completed=f"CASE WHEN {SLOW} THEN completed_at ELSE {NOW} END")
add("mut_cancel", lambda h: transitions.cancel(h.ws, h.oo, _even(h), NOW)[0].select(*NEXT_COLUMNS), CANCEL.replace("{hit}", f"workflow_uuid IN {EVEN} AND status NOT IN ('SUCCESS', 'ERROR', 'CANCELLED', 'CANCELLING')") + " FROM ws", {"u": UNWIND})
CUT = NOW - 86_400_000 * 365
add("mut_cancel_before", lambda h: transitions.cancel_before(h.ws, h.oo, CUT, NOW)[0].select(*NEXT_COLUMNS), CANCEL.replace("{hit}", f"created_at <= {CUT} AND status IN ('PENDING', 'ENQUEUED', 'DELAYED')") + " FROM ws", {"u": UNWIND})
add("mut_resume", lambda h: transitions.resume(h.ws, _even(h), NOW)[0].select(*NEXT_COLUMNS), _next(f"workflow_uuid IN {EVEN} AND status NOT IN ('SUCCESS', 'ERROR')", **RESTART) + " FROM ws")
add("mut_retry", lambda h: transitions.retry(h.ws, _even(h), NOW)[0].select(*NEXT_COLUMNS, "error"), _next(f"workflow_uuid IN {EVEN} AND status IN ('ERROR', 'CANCELLED', 'MAX_RECOVERY_ATTEMPTS_EXCEEDED')", **RESTART) + f", CASE WHEN workflow_uuid IN {EVEN} AND status IN ('ERROR', 'CANCELLED', 'MAX_RECOVERY_ATTEMPTS_EXCEEDED') THEN NULL ELSE error END AS error FROM ws")
add("mut_retry_affected", lambda h: transitions.retry(h.ws, _even(h), NOW)[1], f"SELECT workflow_uuid FROM ws WHERE workflow_uuid IN {EVEN} AND status IN ('ERROR', 'CANCELLED', 'MAX_RECOVERY_ATTEMPTS_EXCEEDED')")
add("mut_promote_delayed", lambda h: transitions.promote_delayed(h.ws, NOW)[0].select(*NEXT_COLUMNS), _next(f"status = 'DELAYED' AND delay_until_epoch_ms <= {NOW}", status="'ENQUEUED'", dedup="CASE WHEN NOT is_debounced THEN deduplication_id END") + " FROM ws")
add("mut_clear_queue", lambda h: transitions.clear_queue_assignment(h.ws, _even(h))[0].select(*NEXT_COLUMNS), _next(f"workflow_uuid IN {EVEN} AND status = 'PENDING' AND queue_name IS NOT NULL", status="'ENQUEUED'", started="NULL") + " FROM ws")
add("mut_reclaim", lambda h: transitions.reclaim(h.ws, reports.reclaimable(h.ws, DEAD, _caps(h)), "me", NOW)[0].select("workflow_uuid", "executor_id"), f"SELECT workflow_uuid, CASE WHEN status = 'PENDING' AND queue_name IS NULL AND executor_id IN {DEAD_SQL} AND {CAN} THEN 'me' ELSE executor_id END AS executor_id FROM ws", OWN)
add("mut_dead_letter", lambda h: transitions.dead_letter(h.ws, 2)[0].select(*NEXT_COLUMNS), _next("status = 'PENDING' AND recovery_attempts > 3", status="'MAX_RECOVERY_ATTEMPTS_EXCEEDED'", queue="NULL", dedup="NULL", started="NULL") + " FROM ws")
DONE = "SELECT workflow_uuid, CASE WHEN recovery_attempts = 0 THEN 'CANCELLED' WHEN recovery_attempts = 2 THEN 'ERROR' ELSE 'SUCCESS' END AS s FROM ws WHERE recovery_attempts % 2 = 0"
add("mut_outcomes", lambda h: transitions.record_outcomes(h.ws, h.ws.where("recovery_attempts % 2 = 0").selectExpr("workflow_uuid", "CASE WHEN recovery_attempts = 0 THEN 'CANCELLED' WHEN recovery_attempts = 2 THEN 'ERROR' ELSE 'SUCCESS' END AS new_status", "'o' AS new_output", "cast(null as string) AS new_error"), NOW)[0].select("workflow_uuid", "status", "output", "error", "completed_at", "deduplication_id"), f"SELECT ws.workflow_uuid, CASE WHEN hit THEN s ELSE status END AS status, CASE WHEN hit THEN 'o' ELSE output END AS output, CASE WHEN hit THEN NULL ELSE error END AS error, CASE WHEN hit THEN {NOW} ELSE completed_at END AS completed_at, CASE WHEN hit THEN NULL ELSE deduplication_id END AS deduplication_id FROM (SELECT ws.*, s, s IS NOT NULL AND status NOT IN ('CANCELLED', 'SUCCESS', 'ERROR') AND (status <> 'CANCELLING' OR s = 'CANCELLED') AS hit FROM ws LEFT JOIN done USING (workflow_uuid)) ws", {"done": DONE})
add("mut_enqueue_unwinds", lambda h: transitions.enqueue_unwinds(h.ws, h.oo, _even(h), NOW), f"SELECT workflow_uuid || '-compensate' AS workflow_uuid, 'ENQUEUED' AS status, 'DBOS.compensate' AS name, '_dbos_internal_queue' AS queue_name, workflow_uuid AS parent_workflow_id, {NOW} AS created_at FROM ws WHERE workflow_uuid IN {EVEN} AND status IN ('ERROR', 'CANCELLED') AND name <> 'DBOS.compensate' AND workflow_uuid IN (SELECT workflow_uuid FROM u)", {"u": UNWIND})
add("mut_garbage", lambda h: transitions.collect_garbage(h.ws, CUT, 500)[1], f"SELECT workflow_uuid FROM ws WHERE status NOT IN ('PENDING', 'ENQUEUED', 'DELAYED') AND created_at < greatest({CUT}, (SELECT created_at FROM ws ORDER BY created_at DESC LIMIT 1 OFFSET 499))")
add("mut_cascade", lambda h: transitions.cascade(transitions.collect_garbage(h.ws, CUT, None)[1], {"operation_outputs": h.oo})["operation_outputs"].select("workflow_uuid", "function_id"), f"SELECT workflow_uuid, function_id FROM oo WHERE workflow_uuid NOT IN (SELECT workflow_uuid FROM ws WHERE status NOT IN ('PENDING', 'ENQUEUED', 'DELAYED') AND created_at < {CUT})")
FORKS = "SELECT workflow_uuid, workflow_uuid || '-f' AS new_id, 3 AS start_step FROM ws WHERE status = 'ERROR'"


def _forks(h: History, part: int) -> DataFrame:
    """Its columns that the SQL of the three oldest queries has; ``_forked`` has all."""
    shown = ["workflow_uuid status name inputs application_version queue_name forked_from created_at", "workflow_uuid function_id function_name output error child_workflow_id", "workflow_uuid key value"][part]
    return transitions.fork(h.ws, h.oo, h.ev, h.ws.where("status = 'ERROR'").selectExpr("workflow_uuid", "workflow_uuid || '-f' AS new_id", "3 AS start_step"), NOW)[part].select(*shown.split())


def _forked(h: History) -> transitions.Forked:
    asked = h.ws.where("status = 'ERROR'").selectExpr("workflow_uuid", "workflow_uuid || '-f' AS new_id", "3 AS start_step", "CASE WHEN recovery_attempts = 0 THEN 'v9' END AS new_version")
    return transitions.fork(h.ws, h.oo, h.ev, asked, NOW, h.sf, "exec-9")


add("mut_fork_workflows", lambda h: _forks(h, 0), f"SELECT new_id AS workflow_uuid, 'ENQUEUED' AS status, name, inputs, application_version, '_dbos_internal_queue' AS queue_name, workflow_uuid AS forked_from, {NOW} AS created_at FROM ws JOIN f USING (workflow_uuid)", {"f": FORKS})
add("mut_fork_steps", lambda h: _forks(h, 1), "SELECT new_id AS workflow_uuid, function_id, function_name, output, error, child_workflow_id FROM oo JOIN f USING (workflow_uuid) WHERE function_id < start_step", {"f": FORKS})
add("mut_fork_events", lambda h: _forks(h, 2), "SELECT new_id AS workflow_uuid, key, value FROM ev JOIN f USING (workflow_uuid) WHERE function_id < start_step QUALIFY row_number() OVER (PARTITION BY new_id, key ORDER BY function_id DESC) = 1", {"f": FORKS})
add("mut_fork_workflows_whole", lambda h: _forked(h).workflows, f"SELECT new_id AS workflow_uuid, 'ENQUEUED' AS status, name, authenticated_user, inputs, attributes, ex_workflow_version, CASE WHEN recovery_attempts = 0 THEN 'v9' ELSE application_version END AS application_version, '_dbos_internal_queue' AS queue_name, 'exec-9' AS executor_id, 0 AS recovery_attempts, workflow_uuid AS forked_from, {NOW} AS created_at, {NOW} AS updated_at FROM ws JOIN f USING (workflow_uuid)", {"f": FORKS})
add("mut_fork_steps_whole", lambda h: _forked(h).steps, "SELECT new_id AS workflow_uuid, function_id, function_name, output, error, child_workflow_id, started_at_epoch_ms, completed_at_epoch_ms FROM oo JOIN f USING (workflow_uuid) WHERE function_id < start_step", {"f": FORKS})
add("mut_fork_history", lambda h: _forked(h).history, "SELECT new_id AS workflow_uuid, ev.* EXCLUDE (workflow_uuid) FROM ev JOIN f USING (workflow_uuid) WHERE function_id < start_step", {"f": FORKS})
add("mut_fork_streams", lambda h: _forked(h).streams, "SELECT new_id AS workflow_uuid, sf.* EXCLUDE (workflow_uuid) FROM sf JOIN f USING (workflow_uuid) WHERE function_id < start_step", {"f": FORKS})
add("mut_fork_marked", lambda h: _forked(h).marked, "SELECT *, status = 'ERROR' AS was_forked_from FROM ws")
add("mut_insert_enqueued", lambda h: transitions.insert_enqueued(h.ws, h.ws.where("recovery_attempts < 3").selectExpr("CASE WHEN recovery_attempts = 0 THEN workflow_uuid ELSE 'new-' || workflow_uuid END AS workflow_uuid", "queue_name", "deduplication_id", "1000 * (recovery_attempts - 1) AS delay_ms"), NOW), f"SELECT workflow_uuid, answer, CASE WHEN answer = 'DELAYED' THEN {NOW} + delay_ms END AS delay_until_epoch_ms FROM (SELECT *, CASE WHEN r = 0 THEN 'existing' WHEN queue_name IS NOT NULL AND deduplication_id IS NOT NULL THEN 'duplicate' WHEN delay_ms > 0 THEN 'DELAYED' ELSE 'ENQUEUED' END AS answer FROM (SELECT CASE WHEN recovery_attempts = 0 THEN workflow_uuid ELSE 'new-' || workflow_uuid END AS workflow_uuid, recovery_attempts AS r, queue_name, deduplication_id, 1000 * (recovery_attempts - 1) AS delay_ms FROM ws WHERE recovery_attempts < 3))")
add("mut_upsert_status", lambda h: transitions.upsert_status(h.ws, h.ws.where("recovery_attempts < 3").selectExpr("CASE WHEN recovery_attempts = 0 THEN 'new-' || workflow_uuid ELSE workflow_uuid END AS workflow_uuid", "CASE WHEN status = 'PENDING' THEN 'ENQUEUED' ELSE 'PENDING' END AS status", "'me' AS executor_id")), "SELECT workflow_uuid, status, CASE WHEN recovery_attempts BETWEEN 1 AND 2 AND status <> 'PENDING' THEN 'me' ELSE executor_id END AS executor_id, CASE WHEN recovery_attempts BETWEEN 1 AND 2 AND status <> 'PENDING' THEN recovery_attempts + 1 ELSE recovery_attempts END AS recovery_attempts FROM ws UNION ALL SELECT 'new-' || workflow_uuid, CASE WHEN status = 'PENDING' THEN 'ENQUEUED' ELSE 'PENDING' END, 'me', CASE WHEN status = 'PENDING' THEN 0 ELSE 1 END FROM ws WHERE recovery_attempts = 0")
add("mut_reconcile_steps", lambda h: transitions.reconcile_steps(h.oo, h.oo.withColumns({"function_id": (F.col("function_id") + F.when(F.col("function_name") == "ship", 100).otherwise(0)).cast("int"), "output": F.when(F.col("function_name") == "refund", F.lit("x")).otherwise(F.col("output")), "function_name": F.when(F.col("function_name") == "notify", F.lit("y")).otherwise(F.col("function_name"))})), "SELECT workflow_uuid, CASE WHEN function_name = 'ship' THEN function_id + 100 ELSE function_id END AS function_id, CASE function_name WHEN 'ship' THEN 'inserted' WHEN 'notify' THEN 'unexpected_step' WHEN 'refund' THEN 'conflict' ELSE 'same' END AS answer FROM oo")
add("mut_renew_leases", lambda h: transitions.renew_leases(h.el, h.spark.sql("SELECT 'exec-1' AS executor_id UNION ALL SELECT 'exec-99'"), 500, 60_000), "SELECT executor_id, CASE WHEN executor_id = 'exec-1' THEN 60500 ELSE lease_expires_epoch_ms END AS lease_expires_epoch_ms FROM el UNION ALL SELECT 'exec-99', 60500")
add("mut_register_versions", lambda h: transitions.register_versions(h.vs, h.spark.sql("SELECT 'v1' AS version_name, 900 AS version_timestamp UNION ALL SELECT 'v9', 901")), "SELECT * FROM vs UNION ALL SELECT 'v9', 901")
add("int_duplicate_keys", lambda h: integrity.duplicate_keys(h.oo, ["workflow_uuid", "function_name"]), "SELECT workflow_uuid, function_name, count(*) AS copies FROM oo GROUP BY 1, 2 HAVING count(*) > 1")
add("int_orphan_rows", lambda h: integrity.orphan_rows(h.nt, h.ws.where("recovery_attempts > 0"), "destination_uuid"), "SELECT DISTINCT destination_uuid FROM nt WHERE destination_uuid NOT IN (SELECT workflow_uuid FROM ws WHERE recovery_attempts > 0)")
add("int_output_or_error", lambda h: integrity.both_or_neither(h.oo.withColumn("error", F.when(F.col("function_id") == 2, F.lit("e")).otherwise(F.col("error")))), "SELECT workflow_uuid, function_id FROM oo WHERE (output IS NULL) = (CASE WHEN function_id = 2 THEN 'e' ELSE error END IS NULL)")

# -- Lineage
ROOTS = [f"wf-{k:010d}" for k in (0, 4, 8, 12)]
add("gra_descendants", lambda h: lineage.descendants(h.ws, h.ws.where(F.col("workflow_uuid").isin(ROOTS))), "SELECT root, node AS workflow_uuid, depth FROM r WHERE depth > 0", {"r": "SELECT workflow_uuid AS root, workflow_uuid AS node, 0 AS depth, [workflow_uuid] AS path FROM ws WHERE workflow_uuid IN (" + ", ".join(f"'{r}'" for r in ROOTS) + ") UNION ALL SELECT root, ws.workflow_uuid, depth + 1, list_append(path, ws.workflow_uuid) FROM r JOIN ws ON ws.parent_workflow_id = r.node WHERE NOT list_contains(path, ws.workflow_uuid) AND depth < 1000"}, recursive=True)
STEPS = "SELECT * FROM (SELECT workflow_uuid, function_id, CASE WHEN ex_compensation IS NOT NULL THEN 'undo' ELSE 'descendant' END AS kind, CASE WHEN ex_compensation IS NULL THEN CASE WHEN function_name = 'DBOS.getResult' THEN child_workflow_id ELSE output END END AS descendant FROM oo WHERE ex_compensation IS NOT NULL OR function_name IN ('DBOS.getResult', 'DBOS.enqueue', 'DBOS.forkWorkflow')) WHERE kind = 'undo' OR descendant IS NOT NULL"
add("gra_unwind_steps", lambda h: lineage.unwind_steps(h.oo), STEPS)
add("gra_unwind_plan", lambda h: lineage.unwind_plan(h.ws, h.oo, reports.unwindable(h.ws, h.oo)), "SELECT s.workflow_uuid, s.function_id, CASE WHEN kind = 'undo' THEN 'undo' WHEN status IN ('PENDING', 'ENQUEUED', 'DELAYED', 'CANCELLING') THEN 'cancel_and_wait' WHEN status = 'SUCCESS' AND ws.workflow_uuid IN (SELECT workflow_uuid FROM u) THEN 'unwind' ELSE 'skip' END AS action FROM steps s LEFT JOIN ws ON ws.workflow_uuid = s.descendant", {"u": UNWIND, "steps": STEPS})
add("met_unwind_position", lambda h: _positions(h), "SELECT workflow_uuid, function_id, row_number() OVER (PARTITION BY workflow_uuid ORDER BY function_id DESC) - 1 AS position, count(*) OVER (PARTITION BY workflow_uuid) - row_number() OVER (PARTITION BY workflow_uuid ORDER BY function_id DESC) + 1 AS outstanding FROM steps", {"steps": STEPS})


def _positions(h: History) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("workflow_uuid")
    place = (F.row_number().over(w.orderBy(F.col("function_id").desc())) - 1).cast("long")
    return lineage.unwind_steps(h.oo).select("workflow_uuid", "function_id", place.alias("position"), (F.count("*").over(w) - place).alias("outstanding"))


# -- Schedules, retries, debouncing
FROM, TO = 1_767_225_600_000, 1_769_904_000_000  # January 2026
add("crn_due_weekdays", lambda h: cron.due_between(h.spark, cron.parse("0 30 9,17 1 * MON-FRI"), FROM, TO), f"SELECT s * 1000 AS fire_ms FROM (SELECT unnest(range({FROM // 1000 + 1}, {TO // 1000 + 1})) AS s) WHERE s % 60 = 0 AND (s // 60) % 60 = 30 AND (s // 3600) % 24 IN (9, 17) AND (extract(day FROM to_timestamp(s) AT TIME ZONE 'UTC') = 1 OR extract(dow FROM to_timestamp(s) AT TIME ZONE 'UTC') BETWEEN 1 AND 5)")
add("crn_due_every", lambda h: cron.due_between(h.spark, cron.parse("@every 1h30m"), FROM, TO), f"SELECT unnest(range({FROM + 5_400_000}, {TO + 1}, 5400000)) AS fire_ms")
add("sch_reconcile", lambda h: cron.reconcile(h.spark, "daily", cron.parse("@daily"), FROM, TO, h.spark.sql(f"SELECT 'sched-daily-{FROM + 86_400_000}' AS workflow_uuid")), f"SELECT 'sched-daily-' || f AS workflow_uuid, f AS fire_ms FROM (SELECT unnest(range({FROM + 2 * 86_400_000}, {TO + 1}, 86400000)) AS f)")
add("sca_retry_delays", lambda h: h.oo.select("workflow_uuid", "function_id", scalars.retry_delay_ms(F.col("function_id") + 1, 250, 1.5, 2000).alias("delay_ms"), scalars.reconnect_delay_ms(F.col("function_id")).alias("reconnect_ms"), scalars.may_retry(F.col("function_id"), 3).alias("again")), "SELECT workflow_uuid, function_id, round(least(250 * pow(1.5, function_id), 2000))::BIGINT AS delay_ms, least(200 * pow(2, function_id), 5000)::BIGINT AS reconnect_ms, function_id <= 3 AS again FROM oo")
add("sca_poll_fold", lambda h: h.ev.groupBy("workflow_uuid").agg(F.count("*").alias("n")).select("workflow_uuid", scalars.poll_after(F.transform(F.sequence(F.lit(1), F.col("n").cast("int") % 9 + 1), lambda i: F.when(i % 4 == 0, "contention").otherwise("idle")), 100, 5000, True).alias("poll_ms")), "SELECT workflow_uuid, list_reduce([100.0::DOUBLE] || list_transform(range(1, (n % 9 + 2)::BIGINT), lambda i: CASE WHEN i % 4 = 0 THEN 2.0 ELSE 1.5 END), lambda a, f: least(a * f, 5000.0)) AS poll_ms FROM (SELECT workflow_uuid, count(*) AS n FROM ev GROUP BY 1)")
add("sca_digest", lambda h: h.ws.select("workflow_uuid", scalars.short_digest(F.col("inputs")).alias("digest"), F.concat(F.col("workflow_uuid"), F.lit("::"), F.col("queue_name")).alias("payload")), "SELECT workflow_uuid, substr(sha256(inputs), 1, 16) AS digest, workflow_uuid || '::' || queue_name AS payload FROM ws")
add("sca_split_payload", lambda h: h.ws.select("workflow_uuid", scalars.split_payload(F.concat(F.col("name"), F.lit("::a::b")))[1].alias("tail")), "SELECT workflow_uuid, 'a::b' AS tail FROM ws")
add("app_chunks", lambda h: h.spark.read.parquet(f"{h.sf_dir}/documents.parquet").select("doc_id", F.posexplode(scalars.text_chunks(F.col("text"))).alias("chunk_index", "chunk")).select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"), F.round(scalars.stub_embedding(F.col("chunk"))[0], 9).alias("first")), "SELECT doc_id, i::INT AS chunk_index, md5(substr(text, i * 500 + 1, 500)) AS chunk_md5, round(('0x' || substr(md5(substr(text, i * 500 + 1, 500)), 1, 2))::INT / 255.0, 9) AS first FROM documents, LATERAL (SELECT unnest(range(0, (length(text) + 499) // 500)) AS i)")
add("app_outbox", lambda h: apps.outbox(h.nt), "SELECT message_uuid, 'sent' AS state FROM nt WHERE NOT consumed")
add("app_fan_in", lambda h: apps.fan_in(h.oo), "SELECT workflow_uuid, string_agg(coalesce(output, error), ',' ORDER BY function_id) AS results FROM oo GROUP BY 1")
add("app_serialized", lambda h: apps.overlapping(h.oo), "SELECT workflow_uuid, function_id FROM (SELECT *, lag(completed_at_epoch_ms) OVER (PARTITION BY workflow_uuid ORDER BY function_id) AS before FROM oo) WHERE before > started_at_epoch_ms")
add("app_progress", lambda h: apps.progress(h.ws, h.oo, 7), "SELECT workflow_uuid, coalesce(copied, 0) AS copied, coalesce(skipped, 0) AS skipped, 7 - coalesce(n, 0) AS remaining FROM ws LEFT JOIN (SELECT workflow_uuid, count(output) AS copied, count(error) AS skipped, count(*) AS n FROM oo GROUP BY 1) o USING (workflow_uuid)")
add("app_inventory", lambda h: apps.inventory(h.oo, 2), "SELECT workflow_uuid, function_id, function_name, sum(1) OVER (PARTITION BY workflow_uuid, function_name ORDER BY function_id) <= 2 AS accepted FROM oo")
add("app_stages", lambda h: apps.stages(h.ev), "SELECT workflow_uuid, key, min_by(value, function_id) AS value, min(at_ms) AS at_ms FROM ev GROUP BY 1, 2")
CALLS = "select workflow_uuid || ':' || key as key, at_ms, cast(7200000 as bigint) as period_ms, value || cast(function_id as string) as input from ev"


def _calls(h: History) -> DataFrame:
    return h.ev.select(F.concat("workflow_uuid", F.lit(":"), "key").alias("key"), "at_ms", F.lit(7_200_000).cast("long").alias("period_ms"), F.concat("value", F.col("function_id").cast("string")).alias("input"))


BURSTS = "SELECT key, min(at_ms) AS first_ms, max(at_ms) + 7200000 AS fires_ms, count(*) AS calls, max_by(input, (at_ms, input)) AS input FROM (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY at_ms, input) AS burst FROM (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY key ORDER BY at_ms, input) < 7200000 THEN 0 ELSE 1 END AS new FROM calls)) GROUP BY key, burst"
add("deb_constant", lambda h: debounce.debounced_constant(_calls(h), 7_200_000), BURSTS, {"calls": CALLS})
add("deb_fold", lambda h: debounce.debounced(_calls(h)), BURSTS, {"calls": CALLS})
add("deb_deadline", lambda h: debounce.debounced(_calls(h), 3 * 3_600_000))


# -- Registration, requests of SQL clients, upserts
def _rows(h: History, text: str) -> DataFrame:
    return h.spark.sql(re.sub(r"\bFROM (ws|oo|ev)\b", r"FROM {\1}", text), **{n: getattr(h, n) for n in ("ws", "oo", "ev") if f"FROM {n}" in text})


SCHEDULES = "SELECT * FROM (VALUES ('s1', 'daily', 'report/1', '@daily', 'PAUSED', '5'), ('s2', 'hourly', 'sweep/1', '@hourly', 'ACTIVE', NULL)) t(schedule_id, schedule_name, workflow_name, schedule, status, last_fired_at)"
INCOMING = "SELECT * FROM (VALUES ('s8', 'daily', 'report/2', '0 0 6 * * *'), ('s9', 'weekly', 'report/1', '@weekly')) t(schedule_id, schedule_name, workflow_name, schedule)"
FIRED = "SELECT 'hourly' AS schedule_name, 900 AS epoch_ms UNION ALL SELECT 'none', 1"
NEW_QUEUES = "SELECT * FROM (VALUES ('q0', 9, 9, NULL, NULL), ('q9', 1, 1, 10, 1000)) t(name, concurrency, worker_concurrency, rate_limit_max, rate_limit_period_ms)"
ASKED = (
    "SELECT workflow_uuid AS request, CASE WHEN recovery_attempts = 1 THEN workflow_uuid WHEN recovery_attempts = 2 AND priority = 2 THEN '' ELSE 'new-' || workflow_uuid END AS workflow_uuid, "
    "CASE WHEN recovery_attempts = 3 AND priority = 1 THEN '' ELSE name END AS name, queue_name, CASE WHEN recovery_attempts = 4 THEN deduplication_id WHEN recovery_attempts = 0 THEN 'fresh' || cast(priority AS string) END AS deduplication_id, "
    "CASE WHEN recovery_attempts = 3 AND priority = 3 THEN '[1]' ELSE attributes END AS named_args, cast(CASE WHEN priority = 4 THEN 0 WHEN priority = 5 AND recovery_attempts = 3 THEN -1 END AS bigint) AS delay_until_epoch_ms FROM ws"
)
add("mut_expire_leases", lambda h: registration.expire_leases(h.el, h.spark.sql("SELECT 'exec-2' AS executor_id UNION ALL SELECT 'exec-99'"), 500).select("executor_id", "lease_expires_epoch_ms"), "SELECT executor_id, CASE WHEN executor_id = 'exec-2' THEN 500 ELSE lease_expires_epoch_ms END AS lease_expires_epoch_ms FROM el")
add("mut_register_schedules", lambda h: registration.register_schedules(_rows(h, SCHEDULES), _rows(h, INCOMING)), "SELECT coalesce(s.schedule_id, i.schedule_id) AS schedule_id, schedule_name, coalesce(i.workflow_name, s.workflow_name) AS workflow_name, coalesce(i.schedule, s.schedule) AS schedule, coalesce(s.status, 'ACTIVE') AS status, s.last_fired_at FROM s FULL JOIN i USING (schedule_name)", {"s": SCHEDULES, "i": INCOMING})
add("mut_schedule_fired", lambda h: registration.mark_fired(_rows(h, SCHEDULES), _rows(h, FIRED)).select("schedule_name", "last_fired_at"), "SELECT schedule_name, coalesce(cast(epoch_ms AS varchar), last_fired_at) AS last_fired_at FROM s LEFT JOIN f USING (schedule_name)", {"s": SCHEDULES, "f": FIRED})
add("mut_register_queues", lambda h: registration.register_queues(h.qs, _rows(h, NEW_QUEUES), h.vs, "v1"), "SELECT * FROM n UNION ALL SELECT * FROM qs WHERE name NOT IN (SELECT name FROM n)", {"n": NEW_QUEUES})
add("mut_register_queues_old", lambda h: registration.register_queues(h.qs, _rows(h, NEW_QUEUES), h.vs, "v2"), "SELECT * FROM qs UNION ALL SELECT * FROM n WHERE name NOT IN (SELECT name FROM qs)", {"n": NEW_QUEUES})
add(
    "mut_enqueue_requests",
    lambda h: registration.enqueue_requests(h.ws, _rows(h, ASKED).withColumn("positional_args", F.array(F.lit("1"), F.lit('"x"')))),
    "SELECT request, workflow_uuid, CASE WHEN error IS NOT NULL THEN 'invalid' WHEN known THEN 'existing' WHEN deduplication_id IS NOT NULL AND (held OR row_number() OVER (PARTITION BY queue_name, deduplication_id, error IS NULL AND NOT known ORDER BY request) > 1) THEN 'duplicate' "
    "WHEN delay_until_epoch_ms IS NOT NULL THEN 'DELAYED' ELSE 'ENQUEUED' END AS answer, error, '{\"positionalArgs\" : [1,\"x\"], \"namedArgs\" : ' || named_args || '}' AS inputs, delay_until_epoch_ms FROM ("
    "SELECT *, CASE WHEN name = '' THEN 'Workflow name cannot be null or empty' WHEN queue_name IS NULL THEN 'Queue name cannot be null or empty' WHEN json_type(named_args) <> 'OBJECT' THEN 'Named args must be a JSON object' WHEN workflow_uuid = '' THEN 'Workflow ID cannot be an empty string if provided.' WHEN delay_until_epoch_ms < 0 THEN 'delay_until_epoch_ms must be >= 0' END AS error, "
    "workflow_uuid IN (SELECT workflow_uuid FROM ws) AS known, EXISTS (SELECT 1 FROM ws WHERE ws.queue_name = a.queue_name AND ws.deduplication_id = a.deduplication_id) AS held FROM a)",
    {"a": ASKED},
)
MARKS = "SELECT workflow_uuid, function_id + CASE WHEN function_name = 'ship' THEN 100 ELSE 0 END AS function_id, 'DBOS.patch-x' AS function_name FROM oo"
add("mut_patch_markers", lambda h: registration.patch_markers(h.oo, _rows(h, MARKS)).select("workflow_uuid", "function_id", "function_name", "output"), "SELECT workflow_uuid, function_id, function_name, output FROM oo UNION ALL SELECT workflow_uuid, function_id, function_name, NULL FROM m WHERE (workflow_uuid, function_id) NOT IN (SELECT (workflow_uuid, function_id) FROM oo)", {"m": MARKS})
SET = "SELECT workflow_uuid, key, function_id + 1 AS function_id, 'v' || cast(function_id AS string) AS value FROM ev"
add("str_set_events", lambda h: registration.set_events(eventlog.latest_events(h.ev).select("workflow_uuid", "key", "value"), h.ev.select("workflow_uuid", "key", "function_id", "value"), _rows(h, SET))[0], "SELECT workflow_uuid, key, max_by(value, function_id) AS value FROM s GROUP BY workflow_uuid, key", {"s": SET})
add("str_event_history", lambda h: registration.set_events(eventlog.latest_events(h.ev).select("workflow_uuid", "key", "value"), h.ev.select("workflow_uuid", "key", "function_id", "value"), _rows(h, SET))[1], "SELECT workflow_uuid, key, function_id, coalesce(s.value, ev.value) AS value FROM ev FULL JOIN s USING (workflow_uuid, key, function_id)", {"s": SET})


def _ingested(h: History, second: int | None = 700) -> DataFrame:
    """Chunks after a second version, of ``second`` characters of each text or (None) the whole."""
    docs = h.spark.read.parquet(f"{h.sf_dir}/documents.parquet").select("doc_id", "text")
    empty = h.spark.createDataFrame([], "doc_id bigint, chunk_index int, chunk string, embedding array<double>").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    store = registration.ingest_documents(empty, docs)
    again = registration.ingest_documents(store, docs.withColumn("text", F.concat(F.lit("."), F.substring("text", 1, second) if second else F.col("text"))))
    return again.select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"), F.round(F.col("embedding")[0], 9).alias("first"))


CUTS = "SELECT doc_id, i::INT AS chunk_index, substr(t, i * 500 + 1, 500) AS chunk FROM {texts}, LATERAL (SELECT unnest(range(0, (length(t) + 499) // 500)) AS i)"
add("app_ingest", _ingested, "SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5, round(('0x' || substr(md5(chunk), 1, 2))::INT / 255.0, 9) AS first FROM (SELECT doc_id, chunk_index, coalesce(n.chunk, o.chunk) AS chunk FROM o FULL JOIN n USING (doc_id, chunk_index))", {"o": CUTS.format(texts="(SELECT doc_id, text AS t FROM documents)"), "n": CUTS.format(texts="(SELECT doc_id, '.' || substr(text, 1, 700) AS t FROM documents)")})
add("app_ingest_whole", lambda h: _ingested(h, None), ORACLES["app_ingest"].replace("substr(text, 1, 700)", "text"))
add("snk_text_lines", lambda h: registration.text_lines(reports.queue_depth(h.ws).select("queue_name", "depth"))[2], "SELECT rtrim(rpad(queue_name, greatest(10, (SELECT max(length(queue_name)) FROM d))::INT, ' ') || '  ' || rpad(cast(depth AS varchar), greatest(5, (SELECT max(length(cast(depth AS varchar))) FROM d))::INT, ' ')) AS line FROM d", {"d": "SELECT queue_name, count(*) AS depth FROM ws WHERE status = 'ENQUEUED' AND queue_name IS NOT NULL GROUP BY queue_name"})

# -- Whole inserts and upserts, recovery, cancelling with children
NEW_ROWS = "SELECT workflow_uuid AS request, CASE WHEN recovery_attempts = 0 THEN workflow_uuid ELSE 'new-' || workflow_uuid END AS workflow_uuid, name, inputs, priority, queue_name, CASE WHEN recovery_attempts = 2 AND priority = 1 THEN 'fresh' WHEN recovery_attempts = 0 THEN deduplication_id END AS deduplication_id, 1000 * (recovery_attempts - 1) AS delay_ms FROM ws WHERE recovery_attempts < 3"
INSERTED = f"SELECT *, CASE WHEN request = workflow_uuid THEN 'existing' WHEN deduplication_id IS NOT NULL AND queue_name IS NOT NULL AND row_number() OVER (PARTITION BY queue_name, deduplication_id, request = workflow_uuid ORDER BY request) > 1 THEN 'duplicate' WHEN delay_ms > 0 THEN 'DELAYED' ELSE 'ENQUEUED' END AS answer FROM n"
ROW = ["workflow_uuid", "status", "name", "inputs", "queue_name", "deduplication_id", "delay_until_epoch_ms", "recovery_attempts", "created_at", "updated_at", "executor_id"]
add("mut_insert_rows", lambda h: transitions.insert_rows(h.ws, _rows(h, NEW_ROWS), NOW)[0].select(*ROW), f"SELECT workflow_uuid, status, name, inputs, queue_name, deduplication_id, delay_until_epoch_ms, recovery_attempts, created_at, CASE WHEN workflow_uuid IN (SELECT workflow_uuid FROM a WHERE answer = 'existing') THEN {NOW} ELSE updated_at END AS updated_at, executor_id FROM ws UNION ALL SELECT workflow_uuid, answer, name, inputs, queue_name, deduplication_id, CASE WHEN answer = 'DELAYED' THEN {NOW} + delay_ms END, 0, {NOW}, {NOW}, NULL FROM a WHERE answer IN ('ENQUEUED', 'DELAYED')", {"n": NEW_ROWS, "a": INSERTED})
add("mut_insert_answers", lambda h: transitions.insert_rows(h.ws, _rows(h, NEW_ROWS), NOW)[1], f"SELECT workflow_uuid, answer, CASE WHEN answer = 'DELAYED' THEN {NOW} + delay_ms END AS delay_until_epoch_ms FROM a", {"n": NEW_ROWS, "a": INSERTED})
UPSERTS = "SELECT CASE WHEN recovery_attempts = 0 THEN 'new-' || workflow_uuid ELSE workflow_uuid END AS workflow_uuid, CASE WHEN status = 'PENDING' THEN 'ENQUEUED' ELSE 'PENDING' END AS status, 'me' AS executor_id, name, inputs FROM ws WHERE recovery_attempts < 3"
add("mut_upsert_rows", lambda h: transitions.upsert_rows(h.ws, _rows(h, UPSERTS), NOW).select(*ROW), f"SELECT ws.workflow_uuid, ws.status, ws.name, ws.inputs, queue_name, deduplication_id, delay_until_epoch_ms, CASE WHEN u.status = 'PENDING' THEN recovery_attempts + 1 ELSE recovery_attempts END AS recovery_attempts, created_at, CASE WHEN u.status IS NOT NULL THEN {NOW} ELSE updated_at END AS updated_at, CASE WHEN u.status = 'PENDING' THEN u.executor_id ELSE ws.executor_id END AS executor_id FROM ws LEFT JOIN u USING (workflow_uuid) UNION ALL SELECT workflow_uuid, status, name, inputs, NULL, NULL, NULL, CASE WHEN status = 'PENDING' THEN 1 ELSE 0 END, {NOW}, {NOW}, executor_id FROM u WHERE workflow_uuid LIKE 'new-%'", {"u": UPSERTS})
add("mut_dead_letter_owner", lambda h: transitions.dead_letter(h.ws.withColumn("owner_xid", F.when(F.col("priority") > 2, F.concat(F.lit("x"), F.col("priority").cast("string")))), 2, "x4")[0].select(*NEXT_COLUMNS), _next("status = 'PENDING' AND recovery_attempts > 3 AND priority <> 4", status="'MAX_RECOVERY_ATTEMPTS_EXCEEDED'", queue="NULL", dedup="NULL", started="NULL") + " FROM ws")
RECLAIMED = f"status = 'PENDING' AND executor_id IN {DEAD_SQL}"
add("rec_reclaim_pass", lambda h: recovery.reclaim(h.ws, DEAD, _caps(h), "me", NOW).workflows.select("workflow_uuid", "status", "executor_id", "started_at_epoch_ms"), f"SELECT workflow_uuid, CASE WHEN {RECLAIMED} AND queue_name IS NOT NULL THEN 'ENQUEUED' ELSE status END AS status, CASE WHEN {RECLAIMED} AND queue_name IS NULL AND {CAN} THEN 'me' ELSE executor_id END AS executor_id, CASE WHEN {RECLAIMED} AND queue_name IS NOT NULL THEN NULL ELSE started_at_epoch_ms END AS started_at_epoch_ms FROM ws", OWN)
add("rec_reclaim_handled", lambda h: recovery.reclaim(h.ws, DEAD, _caps(h), "me", NOW, 10).handled, f"SELECT workflow_uuid FROM ws WHERE {RECLAIMED} AND queue_name IS NOT NULL UNION ALL SELECT * FROM (SELECT workflow_uuid FROM ws WHERE {RECLAIMED} AND queue_name IS NULL AND {CAN} ORDER BY created_at, workflow_uuid LIMIT 10)", OWN)
add("rec_reclaim_declined", lambda h: recovery.reclaim(h.ws, DEAD, _caps(h), "me", NOW).declined, f"SELECT name, application_version, ex_workflow_version, false AS claimable, count(*) AS count, min(created_at) AS oldest_created_at, min(workflow_uuid) AS sample_id, CASE WHEN EXISTS (SELECT 1 FROM caps WHERE cap_name = ws.name) THEN 'version_mismatch' ELSE 'name_not_registered' END AS reason FROM ws WHERE {RECLAIMED} AND queue_name IS NULL AND NOT {CAN} GROUP BY ALL", OWN)
EXPIRED = f"(executor_id IS NOT NULL AND executor_id NOT IN (SELECT executor_id FROM el WHERE lease_expires_epoch_ms > {LEASE_NOW}))"
SWEPT = f"status = 'PENDING' AND {EXPIRED}"


def _sweep(h: History):
    return recovery.lease_sweep(h.ws, h.oo, h.el, _caps(h), "me", LEASE_NOW, None)


add("rec_lease_sweep", lambda h: _sweep(h)[0].workflows.select("workflow_uuid", "status", "executor_id", "completed_at"), f"SELECT workflow_uuid, CASE WHEN {SWEPT} AND queue_name IS NOT NULL THEN 'ENQUEUED' WHEN status = 'CANCELLING' AND {EXPIRED} THEN 'CANCELLED' ELSE status END AS status, CASE WHEN {SWEPT} AND queue_name IS NULL AND {CAN} THEN 'me' ELSE executor_id END AS executor_id, CASE WHEN status = 'CANCELLING' AND {EXPIRED} THEN {LEASE_NOW} ELSE completed_at END AS completed_at FROM ws", OWN)
add("rec_lease_sweep_unwinds", lambda h: _sweep(h)[2], f"SELECT workflow_uuid || '-compensate' AS workflow_uuid, 'ENQUEUED' AS status, 'DBOS.compensate' AS name, '_dbos_internal_queue' AS queue_name, workflow_uuid AS parent_workflow_id, {LEASE_NOW} AS created_at FROM ws WHERE status = 'CANCELLING' AND {EXPIRED} AND workflow_uuid IN (SELECT workflow_uuid FROM u)", {"u": UNWIND})
add("rec_detection", lambda h: h.el.groupBy("executor_id").agg(F.max("lease_expires_epoch_ms").alias("ttl")).select("executor_id", scalars.detection_ms(F.col("ttl"), F.lit(30_000)).cast("long").alias("detected_ms")), "SELECT executor_id, max(lease_expires_epoch_ms) + 30000 AS detected_ms FROM el GROUP BY 1")
ROOT_SQL = "(" + ", ".join(f"'{r}'" for r in ROOTS) + ")"
add("gra_cancel_children", lambda h: recovery.cancel_with_children(h.ws, h.oo, h.ws.where(F.col("workflow_uuid").isin(ROOTS)), NOW)[0].select(*NEXT_COLUMNS), CANCEL.replace("{hit}", "workflow_uuid IN (SELECT node FROM r) AND status NOT IN ('SUCCESS', 'ERROR', 'CANCELLED', 'CANCELLING')") + " FROM ws", {"r": f"SELECT workflow_uuid AS node FROM ws WHERE workflow_uuid IN {ROOT_SQL} UNION SELECT ws.workflow_uuid FROM r JOIN ws ON ws.parent_workflow_id = r.node", "u": UNWIND}, recursive=True)

# -- Call graphs
CALLED = "SELECT * FROM (VALUES ('e1', 'a', 'Kernel', 'f.ex', 1, 1), ('e1', 'b', 'M', 'f.ex', 2, 2), ('a', 't', 'M', 'f.ex', 3, 3), ('b', 'now', 'DateTime', 'f.ex', 4, 4), ('t', 'now', 'DateTime', 'f.ex', 5, 5), ('a', 'now', 'DateTime', 'f.ex', 6, 6), ('e2', 'b', 'M', 'g.ex', 1, 7), ('b', 'c', 'M', 'g.ex', 2, 8), ('c', 'a', 'M', 'g.ex', 3, 9), ('c', 'b', 'M', 'g.ex', 4, 10), ('c', 'nap', 'Process', 'g.ex', 5, 11), ('e2', 'e1', 'M', 'g.ex', 6, 12)) t(caller, callee, module, file, line, ordinal)"
ENTRIES = "SELECT * FROM (VALUES ('e1'), ('e2')) t(entry)"
BANNED = "SELECT * FROM (VALUES ('now', 'utc_now'), ('nap', 'sleep')) t(callee, rule)"
STOPS = "SELECT * FROM (VALUES ('t'), ('e1'), ('e2')) t(node)"
GRAPH = {"calls": CALLED, "entries": ENTRIES, "banned": BANNED, "stops": STOPS}
PATHS = "SELECT entry, entry AS node, [entry] AS path, CAST([] AS BIGINT[]) AS rank, NULL::VARCHAR AS file, NULL::INT AS line FROM entries UNION ALL SELECT w.entry, c.callee, list_append(w.path, c.callee), list_append(w.rank, c.ordinal), c.file, c.line FROM w JOIN calls c ON c.caller = w.node WHERE (w.node = w.entry OR w.node NOT IN (SELECT node FROM stops)) AND NOT list_contains(w.path, c.callee)"
add("gra_banned_calls", lambda h: lineage.banned_calls(*[h.spark.sql(GRAPH[n]) for n in ("entries", "calls", "banned", "stops")]).withColumn("path", F.array_join("path", ">")), "SELECT entry, rule, callee, file, line, path FROM (SELECT entry, rule, node AS callee, file, line, array_to_string(path, '>') AS path, row_number() OVER (PARTITION BY entry, rule, node ORDER BY len(path), rank) AS rn FROM w JOIN banned b ON b.callee = w.node) WHERE rn = 1", GRAPH | {"w": PATHS}, recursive=True)
add("gra_reached", lambda h: lineage.reached(*[h.spark.sql(GRAPH[n]) for n in ("entries", "calls", "stops")]), "SELECT DISTINCT node FROM w", {k: v for k, v in GRAPH.items() if k != "banned"} | {"w": PATHS}, recursive=True)
MFA = "SELECT * FROM (VALUES ('Kernel', 'send', 2), ('Kernel', 'send', 3), ('Task', 'start_link', 1), ('Task', 'async', 1), (':rand', 'uniform', 0), ('DateTime', 'utc_now', 1), ('Process', 'sleep', 1), ('Process', 'exit', 2), ('My.Repo', 'all', 1), ('Kernel', 'make_ref', 0), ('System', 'os_time', 0), (':erlang', 'spawn', 1)) t(module, function, arity)"
add("gra_rules_workflow", lambda h: lineage.match_rules(h.spark.sql(MFA), "workflow", "My.Repo"), "SELECT module || '.' || function || '/' || arity AS callee, CASE WHEN module = 'My.Repo' THEN 'repo' WHEN function LIKE 'spawn%' THEN 'spawn' WHEN module = 'Task' THEN 'task' WHEN module = ':rand' THEN 'rand' WHEN module = 'System' THEN 'system_time' ELSE function END AS rule FROM m WHERE (module, function, arity) NOT IN (('Kernel', 'send', 3), ('Task', 'start_link', 1), ('Process', 'exit', 2))", {"m": MFA})
add("gra_rules_step", lambda h: lineage.match_rules(h.spark.sql(MFA), "step"), "SELECT module || '.' || function || '/' || arity AS callee, CASE WHEN module = 'Task' THEN 'task' ELSE 'spawn' END AS rule FROM m WHERE module = 'Task' OR function LIKE 'spawn%'", {"m": MFA})
DECLARED = "SELECT * FROM (VALUES ('a', 'why'), ('lost', 'why not')) t(node, reason)"
add("gra_unused", lambda h: lineage.unused(h.spark.sql(DECLARED), lineage.reached(*[h.spark.sql(GRAPH[n]) for n in ("entries", "calls", "stops")]), "node"), "SELECT 'lost' AS node, 'why not' AS reason")
OLD_EDGES = "SELECT * FROM (VALUES ('A', 'x'), ('A', 'y'), ('B', 'z'), ('C', 'w')) t(module, callee)"
TRACED = "SELECT * FROM (VALUES ('A', 'v')) t(module, callee)"
KNOWN = "SELECT * FROM (VALUES ('A'), ('B')) t(module)"
add("gra_manifest", lambda h: lineage.merge_manifest(*[h.spark.sql(x) for x in (OLD_EDGES, TRACED, KNOWN)]), "SELECT * FROM o WHERE module NOT IN (SELECT module FROM t2) AND module IN (SELECT module FROM k) UNION ALL SELECT * FROM t2", {"o": OLD_EDGES, "t2": TRACED, "k": KNOWN})
add("gra_unscannable", lambda h: lineage.unscannable(h.spark.sql("SELECT * FROM (VALUES ('M', 'm2'), ('M', 'm1'), ('N', 'n')) t(module, file)"), h.spark.sql(CALLED)), "SELECT 'M' AS module, 'm1' AS file")

# -- Renders, change feeds, payloads, integrity, debounce conflicts
_shown = lambda c: f"'\"' || {c} || '\"'"
add("snk_json_workflows", lambda h: h.ws.select("workflow_uuid", reports.document(h.ws, "workflow").alias("json")), f"SELECT workflow_uuid, json_object('workflow_uuid', workflow_uuid, 'status', status, 'name', name, 'authenticated_user', authenticated_user, 'assumed_role', NULL, 'authenticated_roles', NULL, 'executor_id', executor_id, 'application_version', application_version, 'application_id', NULL, 'attempts', recovery_attempts, 'queue_name', queue_name, 'workflow_timeout_ms', workflow_timeout_ms, 'deduplication_id', deduplication_id, 'priority', priority, 'queue_partition_key', queue_partition_key, 'created_at', created_at::VARCHAR, 'updated_at', updated_at::VARCHAR, 'workflow_deadline_epoch_ms', workflow_deadline_epoch_ms::VARCHAR, 'started_at_epoch_ms', started_at_epoch_ms::VARCHAR, 'input', {_shown('inputs')}, 'output', {_shown('output')}, 'error', {_shown('error')})::VARCHAR AS json FROM ws")
add("snk_json_steps", lambda h: h.oo.select("workflow_uuid", "function_id", reports.document(h.oo, "step").alias("json")), f"SELECT workflow_uuid, function_id, json_object('function_id', function_id, 'function_name', function_name, 'child_workflow_id', child_workflow_id, 'started_at_epoch_ms', started_at_epoch_ms, 'completed_at_epoch_ms', completed_at_epoch_ms, 'output', {_shown('output')}, 'error', {_shown('error')})::VARCHAR AS json FROM oo")


def _rendered(df: DataFrame, kind: str) -> DataFrame:
    return df.select(reports.document(df, kind).alias("json"))


add("snk_json_orphans", lambda h: _rendered(reports.orphans(h.ws, h.el, LEASE_NOW), "orphan"), "SELECT json_object('name', name, 'application_version', application_version, 'workflow_version', ex_workflow_version, 'reason', reason, 'count', count, 'oldest_created_at_epoch_ms', oldest_created_at::VARCHAR, 'example_workflow_id', sample_id)::VARCHAR AS json FROM (" + ORACLES["orphans"] + ")")
add("snk_json_queues", lambda h: _rendered(h.qs.withColumns({"priority_enabled": F.lit(False), "partition_queue": F.lit(True), "polling_interval_ms": F.lit(1000)}), "queue"), "SELECT json_object('name', name, 'worker_concurrency', worker_concurrency, 'global_concurrency', concurrency, 'rate_limit', CASE WHEN rate_limit_max IS NOT NULL THEN json_object('limit', rate_limit_max, 'period_ms', rate_limit_period_ms) END, 'priority_enabled', false, 'partition_queue', true, 'polling_interval_ms', 1000)::VARCHAR AS json FROM qs")


def _feeds(h: History) -> DataFrame:
    events = eventlog.latest_events(h.ev)
    old = {"workflow_status": h.ws, "notifications": h.nt.where("created_at_epoch_ms < 2"), "workflow_events": eventlog.latest_events(h.ev.where("function_id < 5")), "streams": h.st.where("offset < 3")}
    return eventlog.change_feeds(old, {"workflow_status": transitions.promote_delayed(h.ws, NOW)[0], "notifications": h.nt, "workflow_events": events, "streams": h.st})


PROMOTED = f"status = 'DELAYED' AND delay_until_epoch_ms <= {NOW}"
add("str_change_feeds", _feeds, f"SELECT 'status' AS channel, workflow_uuid AS payload FROM ws WHERE {PROMOTED} UNION ALL SELECT DISTINCT 'queue', 'ENQUEUED::' || queue_name FROM ws WHERE {PROMOTED} UNION ALL SELECT DISTINCT 'recv', destination_uuid || '::' || topic FROM nt WHERE created_at_epoch_ms >= 2 UNION ALL SELECT DISTINCT 'event', workflow_uuid || '::' || key FROM (SELECT workflow_uuid, key, max_by(value, function_id) AS v, max_by(value, function_id) FILTER (function_id < 5) AS o FROM ev GROUP BY 1, 2) WHERE v IS DISTINCT FROM o UNION ALL SELECT DISTINCT 'stream', workflow_uuid || '::' || key FROM st WHERE \"offset\" >= 3")
BATCH = "SELECT workflow_uuid || '-b' AS workflow_uuid, key, function_id AS seq, CASE WHEN function_id % 6 = 4 THEN '__dbos_stream_closed__' ELSE value END AS value FROM ev"
add("str_append_closing", lambda h: eventlog.append(h.st, _rows(h, BATCH)), "SELECT workflow_uuid, key, row_number() OVER (PARTITION BY workflow_uuid, key ORDER BY seq) - 1 AS \"offset\", value FROM b QUALIFY coalesce(bool_or(value = '__dbos_stream_closed__') OVER (PARTITION BY workflow_uuid, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) = false", {"b": BATCH})
add("str_remaining", lambda h: h.ws.select("workflow_uuid", scalars.remaining_ms(F.col("workflow_deadline_epoch_ms"), NOW).alias("remaining_ms")), f"SELECT workflow_uuid, CASE WHEN workflow_deadline_epoch_ms IS NULL THEN 0 ELSE greatest(workflow_deadline_epoch_ms - {NOW}, 0) END AS remaining_ms FROM ws")
add("sca_payload", lambda h: h.ws.select("workflow_uuid", scalars.payload("workflow_uuid", "queue_name").alias("payload"), scalars.stable_uuid(F.col("workflow_uuid")).alias("uuid")), "SELECT workflow_uuid, workflow_uuid || '::' || queue_name AS payload, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-4' || substr(d, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr(d, 17, 1))::INT % 4, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS uuid FROM (SELECT workflow_uuid, queue_name, sha256(workflow_uuid) AS d FROM ws)")
add("sca_base64", lambda h: h.ws.select("workflow_uuid", scalars.encoded_payload(F.col("inputs")).alias("encoded"), scalars.decoded_payload(scalars.encoded_payload(F.col("inputs")), F.lit("erl_etf")).cast("string").alias("decoded"), scalars.decoded_payload(F.col("attributes"), F.lit("portable_json")).cast("string").alias("portable")), "SELECT workflow_uuid, to_base64(encode(inputs)) AS encoded, inputs AS decoded, attributes AS portable FROM ws")
add("sca_database_delays", lambda h: h.spark.range(1, scalars.DATABASE_ATTEMPTS).select(F.col("id").alias("attempt"), scalars.database_retry_delay_ms(F.col("id")).alias("delay_ms")), "SELECT a AS attempt, least(100 * pow(2, a - 1), 30000)::DOUBLE AS delay_ms FROM (SELECT unnest(range(1, 10)) AS a)")
add("app_chunks_graphemes", lambda h: h.spark.read.parquet(f"{h.sf_dir}/documents.parquet").select("doc_id", F.posexplode(scalars.text_graphemes(F.col("text"))).alias("chunk_index", "chunk")).select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5")), "SELECT doc_id, i::INT AS chunk_index, md5(substring_grapheme(text, i * 500 + 1, 500)) AS chunk_md5 FROM documents, LATERAL (SELECT unnest(range(0, (length_grapheme(text) + 499) // 500)) AS i)")
add("pnt_patch", lambda h: lookups.patch(_asked(h), h.oo), "SELECT a.workflow_uuid, a.function_id, coalesce(o.function_name = a.function_name, true) AS patched FROM asked a LEFT JOIN oo o USING (workflow_uuid, function_id)", {"asked": ASKED_STEPS})
add("pnt_deprecate_patch", lambda h: lookups.deprecate_patch(_asked(h), h.oo), "SELECT a.workflow_uuid, a.function_id, coalesce(o.function_name = a.function_name, false) AS deprecated FROM asked a LEFT JOIN oo o USING (workflow_uuid, function_id)", {"asked": ASKED_STEPS})
add("int_duplicate_dedups", lambda h: integrity.duplicate_dedups(h.ws.withColumn("deduplication_id", F.concat(F.lit("d"), (F.length("name") % 3).cast("string")))), "SELECT queue_name, 'd' || (length(name) % 3) AS deduplication_id, count(*) AS copies FROM ws WHERE queue_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
add("int_report", lambda h: integrity.report({"workflow_status": h.ws.where("recovery_attempts > 0"), "operation_outputs": h.oo, "notifications": h.nt, "workflow_events": eventlog.latest_events(h.ev), "workflow_events_history": h.ev, "streams": h.st}), "SELECT 'workflow_status: key' AS rule, (SELECT count(*) FROM (SELECT 1 FROM x GROUP BY workflow_uuid HAVING count(*) > 1)) AS violations UNION ALL SELECT 'operation_outputs: key', (SELECT count(*) FROM (SELECT 1 FROM oo GROUP BY workflow_uuid, function_id HAVING count(*) > 1)) UNION ALL SELECT 'notifications: key', (SELECT count(*) FROM (SELECT 1 FROM nt GROUP BY message_uuid HAVING count(*) > 1)) UNION ALL SELECT 'workflow_events: key', 0 UNION ALL SELECT 'workflow_events_history: key', (SELECT count(*) FROM (SELECT 1 FROM ev GROUP BY workflow_uuid, function_id, key HAVING count(*) > 1)) UNION ALL SELECT 'streams: key', (SELECT count(*) FROM (SELECT 1 FROM st GROUP BY workflow_uuid, key, \"offset\" HAVING count(*) > 1)) UNION ALL SELECT 'operation_outputs: parent', (SELECT count(DISTINCT workflow_uuid) FROM oo WHERE workflow_uuid NOT IN (SELECT workflow_uuid FROM x)) UNION ALL SELECT 'notifications: parent', (SELECT count(DISTINCT destination_uuid) FROM nt WHERE destination_uuid NOT IN (SELECT workflow_uuid FROM x)) UNION ALL SELECT 'workflow_events: parent', (SELECT count(DISTINCT workflow_uuid) FROM ev WHERE workflow_uuid NOT IN (SELECT workflow_uuid FROM x)) UNION ALL SELECT 'workflow_events_history: parent', (SELECT count(DISTINCT workflow_uuid) FROM ev WHERE workflow_uuid NOT IN (SELECT workflow_uuid FROM x)) UNION ALL SELECT 'streams: parent', (SELECT count(DISTINCT workflow_uuid) FROM st WHERE workflow_uuid NOT IN (SELECT workflow_uuid FROM x)) UNION ALL SELECT 'workflow_status: deduplication', (SELECT count(*) FROM (SELECT 1 FROM x WHERE queue_name IS NOT NULL AND deduplication_id IS NOT NULL GROUP BY queue_name, deduplication_id HAVING count(*) > 1)) UNION ALL SELECT 'operation_outputs: output or error', (SELECT count(*) FROM oo WHERE (output IS NULL) = (error IS NULL))", {"x": "SELECT * FROM ws WHERE recovery_attempts > 0"})
BOUNCES = "SELECT workflow_uuid AS call, CASE WHEN recovery_attempts = 1 THEN 'other' ELSE name END AS name, queue_name, CASE WHEN recovery_attempts = 2 THEN 'none' ELSE deduplication_id END AS key FROM ws WHERE deduplication_id IS NOT NULL"
add("deb_conflicts", lambda h: debounce.holder_conflicts(_rows(h, BOUNCES), h.ws), "SELECT call, CASE WHEN w.workflow_uuid IS NULL THEN 'fresh' WHEN w.is_debounced AND w.name = c.name THEN 'bounced' ELSE 'duplicate' END AS answer, w.workflow_uuid AS holder FROM c LEFT JOIN ws w ON w.queue_name = c.queue_name AND w.deduplication_id = c.key", {"c": BOUNCES})
NEXT_AFTER = [("0 30 9 * * *", 40_000), ("15 */20 * * * *", 7), ("0 0 12 1 2 ?", 0), ("0 5/7 * * * *", 301)]
NEXT_WHERE = ["s % 86400 = 34200", "s % 60 = 15 AND (s // 60) % 20 = 0", "s % 86400 = 43200 AND extract(day FROM to_timestamp(s) AT TIME ZONE 'UTC') = 1 AND extract(month FROM to_timestamp(s) AT TIME ZONE 'UTC') = 2", "s % 3600 = 300"]
add("crn_next_after", lambda h: h.spark.createDataFrame([(t, cron.next_after(cron.parse(t), FROM + 1000 * s)) for t, s in NEXT_AFTER], "cron string, fire_ms long"), " UNION ALL ".join(f"SELECT '{t}' AS cron, min(s) * 1000 AS fire_ms FROM (SELECT unnest(range({FROM // 1000 + s + 1}, {FROM // 1000 + s + 90 * 86400})) AS s) WHERE {w}" for (t, s), w in zip(NEXT_AFTER, NEXT_WHERE)))
add("crn_due_steps", lambda h: cron.due_between(h.spark, cron.parse("0 7/20,10-40/15 6 * * MON-FRI/2"), FROM, TO), f"SELECT s * 1000 AS fire_ms FROM (SELECT unnest(range({FROM // 1000 + 1}, {TO // 1000 + 1})) AS s) WHERE s % 60 = 0 AND (s // 60) % 60 IN (7, 10, 25, 40) AND (s // 3600) % 24 = 6 AND extract(dow FROM to_timestamp(s) AT TIME ZONE 'UTC') IN (1, 3, 5)")
DEADLINE = 3 * 3_600_000
ORACLES["deb_deadline"] = "WITH RECURSIVE " + f"ev AS ({_CTES['ev']}), calls AS ({CALLS}), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, input) AS i FROM calls), f AS (SELECT key, i, at_ms AS first_ms, least(at_ms + period_ms, at_ms + {DEADLINE}) AS fires_ms, 1 AS calls, input FROM o WHERE i = 1 UNION ALL SELECT o.key, o.i, CASE WHEN o.at_ms >= f.fires_ms THEN o.at_ms ELSE f.first_ms END, least(o.at_ms + o.period_ms, CASE WHEN o.at_ms >= f.fires_ms THEN o.at_ms ELSE f.first_ms END + {DEADLINE}), CASE WHEN o.at_ms >= f.fires_ms THEN 1 ELSE f.calls + 1 END, o.input FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1) SELECT key, first_ms, max_by(fires_ms, i) AS fires_ms, max(calls)::BIGINT AS calls, max_by(input, i) AS input FROM f GROUP BY key, first_ms"
