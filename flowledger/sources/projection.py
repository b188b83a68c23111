"""The workflow history that the test tables stand for.

Orders are workflows, line items their steps, suppliers executors, events event
history and streams, conversations mailboxes.  Column expressions are plain SQL
that both Spark and DuckDB read; ``{ms}`` and ``{div}`` are what differs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

NOW = 946_684_800_000
LEASE_NOW = 500
SPARK = {"ms": "unix_millis(cast(o_orderdate as timestamp))", "div": "div", "ts": "unix_millis(cast(ts as timestamp))"}
DUCK = {"ms": "epoch_ms(o_orderdate)", "div": "//", "ts": "epoch_us(ts) // 1000"}


def _wf(k: str) -> str:
    return f"'wf-' || lpad(cast({k} as string), 10, '0')"


K = "o_orderkey"
STATUS = (
    f"case o_orderstatus when 'F' then case when {K} % 11 = 0 then 'MAX_RECOVERY_ATTEMPTS_EXCEEDED' when {K} % 7 = 0 then 'CANCELLED' when {K} % 5 = 0 then 'ERROR' else 'SUCCESS' end "
    f"when 'O' then case when {K} % 4 = 0 then 'DELAYED' else 'ENQUEUED' end else case when {K} % 13 = 0 then 'CANCELLING' else 'PENDING' end end"
)
CREATED = f"{{ms}} + {K}"
STARTED = f"case when o_orderstatus <> 'O' then {CREATED} + 10 * ({K} % 50) end"
WS = {
    "workflow_uuid": _wf(K),
    "status": STATUS,
    "name": "lower(c_mktsegment) || '/1'",
    "authenticated_user": "'user' || cast(o_custkey % 10 as string)",
    "output": f"case when o_orderstatus = 'F' then 'out-' || cast({K} as string) end",
    "error": f"case when o_orderstatus = 'F' and {K} % 5 = 0 then 'err-' || cast({K} % 3 as string) end",
    "executor_id": "'exec-' || cast(o_custkey % 20 as string)",
    "created_at": CREATED,
    "updated_at": f"{CREATED} + 1000 * ({K} % 7)",
    "application_version": f"case when {K} % 17 <> 0 then 'v' || cast({K} % 3 as string) end",
    "recovery_attempts": f"cast({K} % 5 as bigint)",
    "queue_name": f"case when o_orderstatus = 'O' or {K} % 2 = 1 then 'q' || cast({K} % 4 as string) end",
    "workflow_timeout_ms": f"case when {K} % 6 = 0 then 5000 * ({K} % 4 + 1) end",
    "workflow_deadline_epoch_ms": f"case when {K} % 12 = 0 then {CREATED} + 60000 end",
    "inputs": f"'in-' || cast({K} as string)",
    "started_at_epoch_ms": STARTED,
    "deduplication_id": f"case when {K} % 9 = 0 then 'd' || cast({K} as string) end",
    "priority": "cast(substr(o_orderpriority, 1, 1) as int)",
    "queue_partition_key": f"case when {K} % 3 = 0 then 'p' || cast({K} % 5 as string) end",
    "forked_from": f"case when {K} % 23 = 0 and {K} > 0 then {_wf(K + ' - 1')} end",
    "parent_workflow_id": f"case when {K} % 4 <> 0 then {_wf(K + ' {div} 4')} end",
    "delay_until_epoch_ms": f"case when o_orderstatus = 'O' and {K} % 4 = 0 then {CREATED} + 86400000 * ({K} % 10) end",
    "rate_limited": f"{K} % 10 = 0",
    "completed_at": f"case when o_orderstatus = 'F' then {CREATED} + 10 * ({K} % 50) + {K} % 1000 end",
    "attributes": f"'{{{{\"tier\":\"t' || cast({K} % 3 as string) || '\",\"n\":' || cast({K} % 5 as string) || ',\"tags\":[\"a\",\"b' || cast({K} % 2 as string) || '\"]}}}}'",
    "schedule_name": f"case when {K} % 19 = 0 then 'nightly' || cast({K} % 3 as string) end",
    "is_debounced": f"o_orderstatus = 'O' and {K} % 8 = 0",
    "ex_workflow_version": f"case when {K} % 3 <> 0 then cast({K} % 3 as string) end",
}
STEP = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1"
FUNCTION = "case l_returnflag || l_linestatus when 'RF' then 'charge' when 'NO' then 'DBOS.getResult' when 'AF' then 'ship' when 'NF' then 'DBOS.enqueue' when 'RO' then 'notify' else 'refund' end"
OO = {
    "workflow_uuid": _wf("l_orderkey"),
    "function_id": "cast(step as int)",
    "function_name": "fn",
    "output": "case when l_quantity <= 45 then 'o' || cast(l_partkey as string) end",
    "error": "case when l_quantity > 45 then 'e' || cast(l_partkey % 3 as string) end",
    "child_workflow_id": f"case when fn = 'DBOS.getResult' then {_wf('l_orderkey * 4 + 1')} end",
    "started_at_epoch_ms": f"{CREATED} + 1000 * step",
    "completed_at_epoch_ms": f"{CREATED} + 1000 * step + cast(l_quantity as bigint)",
    "ex_compensation": "case when fn = 'charge' and l_suppkey % 3 = 0 then 'undo' end",
}
LEASES = {
    "executor_id": "'exec-' || cast(s_suppkey as string)",
    "lease_expires_epoch_ms": "cast(case when s_suppkey % 2 = 0 then 1000 else 0 end as bigint)",
    "cap_name": "case when s_suppkey % 2 = 0 then 'building/1' else 'machinery/1' end",
    "cap_version": "cast(s_suppkey % 3 as string)",
}
EVENTS = {"workflow_uuid": _wf("user_id"), "key": "event_type", "function_id": "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int)", "value": "props", "at_ms": "{ts}"}
STREAMS = {
    "workflow_uuid": _wf("user_id"), "key": "event_type", "offset": "cast(row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as int)",
    "value": "case when event_id % 97 = 5 then '__dbos_stream_closed__' else props end",
}
MAIL = {
    "destination_uuid": _wf("conv_id"), "topic": "case when role = 'system' then '__null__topic__' else role end", "message": "text",
    "created_at_epoch_ms": "turn", "message_uuid": "'m-' || cast(conv_id as string) || '-' || cast(turn as string)", "consumed": "turn % 3 = 0",
}
#: name, concurrency, worker_concurrency, rate_limit_max, rate_limit_period_ms
QUEUES = [("q0", 5, 3, None, None), ("q1", None, 40, 30, 86_400_000), ("q2", 25, None, None, None), ("q3", None, None, 4000, 86_400_000 * 3650)]
VERSIONS = [("v0", 100), ("v1", 300), ("v2", 200)]
OO_FROM = f"(select *, {STEP} as step, {FUNCTION} as fn from lineitem) l join orders on l_orderkey = o_orderkey"


def _select(columns: dict[str, str], source: str, of: dict[str, str]) -> str:
    return "select " + ", ".join(f"{e.format(**of)} as \"{n}\"" if of is DUCK else f"{e.format(**of)} as `{n}`" for n, e in columns.items()) + f" from {source}"


def _values(rows: list[tuple], names: str) -> str:
    q = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"select * from (values {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) t({names})"


SOURCES = {
    "ws": (WS, "orders join customer on o_custkey = c_custkey"), "oo": (OO, OO_FROM), "el": (LEASES, "supplier where s_suppkey < 12"),
    "ev": (EVENTS, "events"), "st": (STREAMS, "events"), "nt": (MAIL, "conversations"),
    "sf": (STREAMS | {"function_id": EVENTS["function_id"]}, "events"),
}
NAMED = {"qs": _values(QUEUES, "name, concurrency, worker_concurrency, rate_limit_max, rate_limit_period_ms"), "vs": _values(VERSIONS, "version_name, version_timestamp")}


def duck_ctes() -> dict[str, str]:
    return {n: _select(*s, DUCK) for n, s in SOURCES.items()} | NAMED


class History:
    """The projected tables of a folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _build(self, name: str) -> DataFrame:
        columns, source = SOURCES[name]
        for t in ("orders", "customer", "lineitem", "supplier", "events", "conversations"):
            source = source.replace(f" {t} ", f" {{{t}}} ").replace(f" {t})", f" {{{t}}})")
            source = "{" + t + "}" + source[len(t):] if source.startswith(t) else source
        frames = {t: self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet") for t in ("orders", "customer", "lineitem", "supplier", "events", "conversations") if "{" + t + "}" in source}
        text = _select(columns, "@@", SPARK).replace("{", "{{").replace("}", "}}").replace("@@", source)
        return self.spark.sql(text, **frames)

    ws = cached_property(lambda self: self._build("ws"))
    oo = cached_property(lambda self: self._build("oo"))
    el = cached_property(lambda self: self._build("el"))
    ev = cached_property(lambda self: self._build("ev"))
    st = cached_property(lambda self: self._build("st"))
    nt = cached_property(lambda self: self._build("nt"))
    sf = cached_property(lambda self: self._build("sf"))
    qs = cached_property(lambda self: self.spark.sql(NAMED["qs"]))
    vs = cached_property(lambda self: self.spark.sql(NAMED["vs"]))
