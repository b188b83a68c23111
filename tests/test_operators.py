"""Boundaries and rules of single operators on literal rows."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from flowledger import schema
from flowledger.functions import cron, scalars
from flowledger.operators import admission, debounce, eventlog, integrity, lineage, reports, transitions
from flowledger.plans import queries
from flowledger.plans.filters import WorkflowFilter, list_workflows


def ms(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize(
    "text, start, expected",
    [
        ("0 * * * * *", ms(2026, 1, 1, 10, 15, 30), ms(2026, 1, 1, 10, 16)),
        ("0 30 9 * * *", ms(2026, 1, 1, 12), ms(2026, 1, 2, 9, 30)),
        ("0 0 0 1 3 *", ms(2026, 1, 15), ms(2026, 3, 1)),
        ("0 0 0 1 * 1", ms(2026, 2, 1, 0, 0, 1), ms(2026, 2, 2)),
        ("0 0 0 1 MAR *", ms(2026, 1, 15), ms(2026, 3, 1)),
        ("0 0 0 1 JAN-MAR *", ms(2026, 1, 2), ms(2026, 2, 1)),
        ("0 0 0 1 jan,mar,may *", ms(2026, 1, 2), ms(2026, 3, 1)),
        ("0 0 9 * * MON-FRI", ms(2026, 1, 2, 9, 0, 1), ms(2026, 1, 5, 9)),
        ("0 0 9 * * sun,sat", ms(2026, 1, 1), ms(2026, 1, 3, 9)),
        ("0 0 9 * * MON-FRI/2", ms(2026, 1, 1, 9, 0, 1), ms(2026, 1, 2, 9)),
        ("0 0 9 ? * MON", ms(2026, 1, 1, 9, 0, 1), ms(2026, 1, 5, 9)),
        ("0 0 0 1 * mon", ms(2026, 2, 2, 0, 0, 1), ms(2026, 2, 9)),
        ("@yearly", ms(2026, 3, 1), ms(2027, 1, 1)),
        ("@weekly", ms(2026, 1, 1, 0, 0, 1), ms(2026, 1, 4)),
        ("@hourly", ms(2026, 1, 1, 10, 15), ms(2026, 1, 1, 11)),
        ("@every 1h30m", ms(2026, 1, 1, 10), ms(2026, 1, 1, 11, 30)),
        ("0 5/7 * * * *", ms(2026, 1, 1, 10, 5), ms(2026, 1, 1, 11, 5)),
    ],
)
def test_cron_next(text, start, expected):
    assert cron.next_after(cron.parse(text), start) == expected


@pytest.mark.parametrize("text, said", [("* * * * *", "six"), ("70 * * * * *", "second"), ("* * * 32 * *", "day-of-month"), ("* * * * 13 *", "month"), ("* * * * * 8", "day-of-week"), ("@bogus", "@bogus"), ("@every nonsense", "nonsense"), ("@every 1ns", "interval")])
def test_cron_errors(text, said):
    with pytest.raises(ValueError, match=said):
        cron.parse(text)


def test_cron_due_agrees_with_next(spark):
    for text in ("0 */20 * * * *", "30 0 6 1,15 * SUN", "@every 45m", "0 0 12 */10 2 ?"):
        c, at, end = cron.parse(text), ms(2026, 1, 25), ms(2026, 3, 2)
        expected = []
        while (at := cron.next_after(c, at)) <= end:
            expected.append(at)
        assert sorted(r[0] for r in cron.due_between(spark, c, ms(2026, 1, 25), end).collect()) == expected


CONTAINS = [
    ('{"a":1,"b":{"c":[1,2,{"d":"x"}]}}', {"b": {"c": [{"d": "x"}, 1]}}, True),
    ('{"a":1}', {"a": 1.0}, True), ('{"a":"1"}', {"a": 1}, False), ('{"a":true}', {"a": 1}, False), ('{"a":null}', {"a": None}, True), ("{}", {"a": None}, False),
    ("[1,2,2]", [2, 1, 1], True), ("[1,[2]]", [2], False), ('["x"]', "x", True), ('{"a":["x"]}', {"a": "x"}, False), ('{"a":{"b":1}}', {}, True), ("[]", {}, False), (None, {"a": 1}, False), ("bad", {"a": 1}, False),
]


@pytest.mark.parametrize("document, pattern, expected", CONTAINS)
def test_json_containment(spark, document, pattern, expected):
    df = spark.createDataFrame([(document,)], "d string")
    assert df.select(scalars.json_contains(F.col("d"), pattern)).first()[0] is expected


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(scalars.age(F.lit(x * 1000))) for x in (59, 60, 3599, 3600, 86399, 86400)] == ["59s", "1m", "59m", "1h", "23h", "1d"]
    assert [get(scalars.retry_delay_ms(F.lit(n), 100, 2, 350)) for n in (1, 2, 3)] == [100, 200, 350]
    assert scalars.duration_ms("1.5s") == 1500 and scalars.duration_ms("1h30m") == 5_400_000
    assert get(scalars.text_chunks(F.lit("a" * 1001))) == ["a" * 500, "a" * 500, "a"] and get(scalars.text_chunks(F.lit(""))) == []
    assert get(scalars.split_payload(F.lit("a::b::c"))) == ["a", "b::c"]
    with pytest.raises(Exception, match="unknown status"):
        get(scalars.known_status(F.lit("DONE")))


WS = "workflow_uuid string, status string, created_at long, queue_name string, executor_id string, name string, ex_workflow_version string, deduplication_id string, delay_until_epoch_ms long, is_debounced boolean, started_at_epoch_ms long, completed_at long, updated_at long"


def ws(spark, *rows):
    base = {"status": "PENDING", "created_at": 0, "name": "n", "is_debounced": False, "updated_at": 0}
    names = [c.split()[0] for c in WS.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], WS)


def ids(df):
    return sorted(r[0] for r in df.select("workflow_uuid").collect())


def test_filters_and_requests(spark):
    df = ws(spark, {"workflow_uuid": "a_1", "created_at": 5}, {"workflow_uuid": "ab1", "created_at": 6}, {"workflow_uuid": "b", "created_at": 7, "status": "ERROR"})
    assert ids(list_workflows(df, WorkflowFilter(workflow_id_prefix="a_"))) == ["a_1", "ab1"]
    assert ids(list_workflows(df, WorkflowFilter(created_after=6, created_before=6))) == ["ab1"]
    assert ids(list_workflows(df, WorkflowFilter.from_request('{"status": ["ERROR"]}'))) == ["b"]
    for bad in ('{"status": "DONE"}', '{"nonsense": 1}'):
        with pytest.raises(ValueError):
            WorkflowFilter.from_request(bad)
    with pytest.raises(ValueError):
        WorkflowFilter(created_after=[1]).predicates()


def test_boundaries(spark):
    df = ws(spark, {"workflow_uuid": "at", "status": "DELAYED", "delay_until_epoch_ms": 10, "deduplication_id": "d", "is_debounced": True}, {"workflow_uuid": "after", "status": "DELAYED", "delay_until_epoch_ms": 11})
    after, hit = transitions.promote_delayed(df, 10)
    assert ids(hit) == ["at"] and after.where("workflow_uuid = 'at'").select("status", "deduplication_id").first() == ("ENQUEUED", None)
    lease = spark.createDataFrame([("e1", 10, None, None), ("e2", 11, None, None)], "executor_id string, lease_expires_epoch_ms long, cap_name string, cap_version string")
    df = ws(spark, *({"workflow_uuid": e, "executor_id": e} for e in ("e1", "e2", "e3")))
    assert sorted(r[0] for r in reports.expired_pending_executors(df, lease, 10).collect()) == ["e1", "e3"]
    # One live executor of unknown capabilities suppresses the whole report.
    assert reports.orphans(df.withColumn("application_version", F.lit("v")), lease, 10).count() == 0
    old = ws(spark, {"workflow_uuid": "old", "status": "CANCELLING", "created_at": 4}, {"workflow_uuid": "edge", "status": "SUCCESS", "created_at": 5}, {"workflow_uuid": "live", "created_at": 1})
    assert ids(transitions.collect_garbage(old, 5, None)[1]) == ["old"] and ids(transitions.collect_garbage(old, None, None)[1]) == []


def test_descendants_end_at_cycles(spark):
    df = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "c")], "workflow_uuid string, parent_workflow_id string")
    found = lineage.descendants(df, spark.createDataFrame([("a",)], "workflow_uuid string"))
    assert sorted((r.workflow_uuid, r.depth) for r in found.collect()) == [("b", 1), ("c", 2), ("d", 3)]


def test_banned_calls_take_the_first_chain(spark):
    calls = spark.createDataFrame([("e", "x", "f", 1, 1), ("e", "y", "f", 2, 2), ("x", "t", "f", 3, 3), ("y", "ban", "f", 4, 4), ("t", "ban", "f", 5, 5), ("x", "ban", "f", 6, 6)], "caller string, callee string, file string, line int, ordinal int")
    out = lineage.banned_calls(spark.createDataFrame([("e",)], "entry string"), calls, spark.createDataFrame([("ban", "clock")], "callee string, rule string"), spark.createDataFrame([("t",)], "node string")).collect()
    assert [(r.line, r.path) for r in out] == [(6, ["e", "x", "ban"])]


def test_streams_and_mail(spark):
    st = spark.createDataFrame([("w", "k", i, v) for i, v in enumerate(["a", "b", schema.CLOSED, "late"])], "workflow_uuid string, key string, offset int, value string")
    assert [tuple(r)[2:] for r in eventlog.pages(st, 0).collect()] == [(2, 3, True)] and eventlog.readable(st).count() == 2
    assert eventlog.append(st, spark.createDataFrame([("w", "k", 1, "x")], "workflow_uuid string, key string, seq int, value string")).count() == 0


def test_debounce_forms_agree(spark):
    rows = [(k, at, 10, f"{k}{at}") for k in "abc" for at in (0, 5, 9, 19, 40, 45, 60, 61, 71)]
    calls = spark.createDataFrame(rows, "key string, at_ms long, period_ms long, input string")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(debounce.debounced(calls)) == got(debounce.debounced_constant(calls, 10).select("key", "first_ms", "fires_ms", "calls", "input"))
    moved = spark.createDataFrame([("k", 0, 100, "x"), ("k", 10, 5, "y"), ("k", 14, 50, "z"), ("k", 15, 50, "w")], "key string, at_ms long, period_ms long, input string")
    assert got(debounce.debounced(moved, 30)) == [("k", 0, 30, 4, "w")]


def test_queue_rules():
    for bad in ({"name": ""}, {"name": "q", "concurrency": 0}, {"name": "q", "worker_concurrency": -1}, {"name": "q", "concurrency": 1, "worker_concurrency": 2}, {"name": "q", "rate_limit": (0, 1)}):
        with pytest.raises(ValueError):
            admission.QueueConfig(**bad)
    assert admission.QueueConfig("q", worker_concurrency=20, polling_interval_ms=50).throughput_bound() == 400
    with pytest.raises(ValueError):
        admission.check_dispatch({"deduplication_id": "d", "partition_key": "p"})


def test_schema_is_checked_not_cast(spark):
    good = spark.createDataFrame([], schema.TABLES["workflow_events"])
    assert schema.checked(good, "workflow_events").columns == schema.TABLES["workflow_events"].names
    with pytest.raises(ValueError):
        schema.checked(good.withColumn("key", F.lit(1)), "workflow_events")
    with pytest.raises(ValueError):
        schema.checked(good, "workflow_events", 41)


def test_integrity(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "workflow_uuid string")
    assert [tuple(r) for r in integrity.duplicate_keys(df, ["workflow_uuid"]).collect()] == [("a", 2)]


def test_streaming_equals_batch(spark, tmp_path):
    from flowledger.streaming import streams

    df = spark.createDataFrame([("w", "k", i, str(i)) for i in range(20)], "workflow_uuid string, key string, function_id int, value string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    live = streams.latest(streams.log_source(spark, str(tmp_path / "in"), df.schema, 1))
    q = live.writeStream.outputMode("complete").format("memory").queryName("latest_events").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("latest_events").collect()] == [("w", "k", "19")]


def test_receive_takes_messages_in_order(spark, tmp_path):
    from flowledger.streaming import streams

    rows = [("d", "t", "message", 1, None, "first"), ("d", "t", "wait", 2, 9_000, None), ("d", "t", "message", 3, None, "second"), ("e", "t", "wait", 1, 9_000, None)]
    df = spark.createDataFrame(rows, "destination string, topic string, kind string, at long, deadline_ms long, message string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = streams.log_source(spark, str(tmp_path / "in"), df.schema).withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", "1 second")
    q = streams.receive(live).writeStream.format("memory").queryName("received").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("received").collect()] == [("d", "t", "message", "first")]


def test_snapshots_round_trip(spark, tmp_path):
    from flowledger.sources import tables

    df = spark.createDataFrame([("w", "k", "v", None)], schema.TABLES["workflow_events"])
    tables.write_snapshot(df, str(tmp_path), "workflow_events")
    assert [tuple(r) for r in tables.read_snapshot(spark, str(tmp_path), "workflow_events").collect()] == [("w", "k", "v", None)]
    with pytest.raises(Exception, match="exist"):
        tables.write_snapshot(df, str(tmp_path), "workflow_events")


def test_queue_outcomes(spark):
    df = ws(spark, *({"workflow_uuid": f"w{i}", "status": "ENQUEUED", "queue_name": "q", "created_at": i} for i in range(4))).withColumns({"application_version": F.lit(None).cast("string"), "priority": F.lit(0), "rate_limited": F.lit(False), "queue_partition_key": F.lit(None).cast("string")})
    qs = spark.createDataFrame([("q", 3, 2, None, None), ("none", None, None, None, None)], "name string, concurrency int, worker_concurrency int, rate_limit_max int, rate_limit_period_ms long")
    local = lambda n: spark.createDataFrame([("q", n)], "queue_name string, local_running int")
    got = lambda n: {r.queue_name: (r.claimed, r.blocked) for r in admission.outcomes(df, qs, local(n), 0, "v", "v").collect()}
    assert got(1) == {"q": (1, None), "none": (0, "empty")} and got(2)["q"] == (0, "no_capacity")
    assert ids(admission.dequeue(df, qs, local(0), 0, "v", "v")) == ["w0", "w1"] and ids(admission.dequeue(df, qs, local(0), 0, "v", "w")) == []


def test_fork_copies_all(spark):
    """Roles, class names, streams and history come along; the original is marked, other marks stay."""
    ws = spark.createDataFrame([("a", "n", "u", "r", "v1", "C", "json", False), ("b", "n", None, None, "v1", None, None, True), ("c", "n", None, None, "v1", None, None, None)], "workflow_uuid string, name string, authenticated_user string, authenticated_roles string, application_version string, class_name string, serialization string, was_forked_from boolean")
    oo = spark.createDataFrame([("a", 0, "f", 5, "undo"), ("a", 2, "g", 6, None)], "workflow_uuid string, function_id int, function_name string, started_at_epoch_ms long, ex_compensation string")
    ev = spark.createDataFrame([("a", "k", 0, "x", "json"), ("a", "k", 1, "y", "json"), ("a", "k", 2, "z", "json")], "workflow_uuid string, key string, function_id int, value string, serialization string")
    st = spark.createDataFrame([("a", "s", 0, 1, "p"), ("a", "s", 1, 2, "q")], "workflow_uuid string, key string, offset int, function_id int, value string")
    got = transitions.fork(ws, oo, ev, spark.createDataFrame([("a", "a2", 2, "v2")], "workflow_uuid string, new_id string, start_step int, new_version string"), 7, st, "me")
    new = got.workflows.first()
    assert (new.workflow_uuid, new.authenticated_roles, new.class_name, new.serialization, new.application_version, new.executor_id, new.updated_at, new.forked_from) == ("a2", "r", "C", "json", "v2", "me", 7, "a")
    assert [tuple(r) for r in got.steps.collect()] == [("a2", 0, "f", 5)] and [tuple(r) for r in got.events.collect()] == [("a2", "k", "y", "json")]
    assert sorted(r.value for r in got.history.collect()) == ["x", "y"] and [tuple(r) for r in got.streams.collect()] == [("a2", "s", 0, 1, "p")]
    assert {r.workflow_uuid: r.was_forked_from for r in got.marked.collect()} == {"a": True, "b": True, "c": False}


def test_mailbox_queries_give_whole_texts(spark, sf_dir):
    own = {(f"m-{r.conv_id}-{r.turn}"): r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    for name in ("win_mailbox_heads", "str_consume"):
        got = queries.QUERIES[name](spark, sf_dir).collect()
        assert got and all(r.message == own[r.message_uuid] for r in got)


def _queue_rows(spark, *rows):
    df = ws(spark, *rows).withColumns({"application_version": F.lit(None).cast("string"), "priority": F.lit(0), "rate_limited": F.lit(False)})
    keys = spark.createDataFrame([(r["workflow_uuid"], r.get("queue_partition_key")) for r in rows], "workflow_uuid string, queue_partition_key string")
    return df.join(keys, "workflow_uuid")


def test_partitions_have_their_own_counts(spark):
    """Two partitions of a queue with a global limit of two: what runs in one takes nothing from the other; rows of no partition stay."""
    rows = [{"workflow_uuid": f"{p}{i}", "status": "ENQUEUED", "queue_name": "q", "created_at": i, "queue_partition_key": p} for p in "ab" for i in range(3)]
    rows += [{"workflow_uuid": "run", "queue_name": "q", "queue_partition_key": "a", "executor_id": "e"}, {"workflow_uuid": "none", "status": "ENQUEUED", "queue_name": "q"}, {"workflow_uuid": "other", "status": "ENQUEUED", "queue_name": "r", "queue_partition_key": "a"}]
    df = _queue_rows(spark, *rows)
    qs = spark.createDataFrame([("q", 2, None, None, None, True), ("r", None, 5, None, None, False)], "name string, concurrency int, worker_concurrency int, rate_limit_max int, rate_limit_period_ms long, partition_queue boolean")
    local = spark.createDataFrame([], "queue_name string, queue_partition_key string, local_running int")
    got = admission.dequeue(df, qs, local, 0, "v", "v", per_partition=True)
    assert ids(got) == ["a0", "b0", "b1"]
    whole = admission.dequeue(df, qs, local.drop("queue_partition_key"), 0, "v", "v")
    assert ids(whole) == ["a0", "other"]


def test_dequeue_limits_groups_before_the_shuffle(spark):
    df = _queue_rows(spark, *({"workflow_uuid": f"w{i}", "status": "ENQUEUED", "queue_name": "q", "created_at": i} for i in range(9)))
    qs = spark.createDataFrame([("q", 3, 2, None, None)], "name string, concurrency int, worker_concurrency int, rate_limit_max int, rate_limit_period_ms long")
    got = admission.dequeue(df, qs, spark.createDataFrame([], "queue_name string, local_running int"), 0, "v", "v")
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString() and ids(got) == ["w0", "w1"]


def test_queue_config_rules_name_what_is_wrong():
    for bad, said in (({"name": ""}, "name"), ({"name": "q", "concurrency": 0}, "concurrency"), ({"name": "q", "worker_concurrency": 0}, "worker_concurrency"), ({"name": "q", "concurrency": 1, "worker_concurrency": 2}, "not be more"), ({"name": "q", "rate_limit": (1, 0)}, "rate_limit"), ({"name": "q", "polling_interval_ms": 0}, "polling_interval_ms")):
        with pytest.raises(ValueError, match=said):
            admission.QueueConfig(**bad)
    with pytest.raises(ValueError, match="unknown option: nonsense"):
        admission.check_dispatch({"nonsense": 1})
    assert admission.check_dispatch({"queue": "q", "delay_ms": 5}) == {"queue": "q", "delay_ms": 5}


def test_append_stops_at_a_close_mark_of_the_batch(spark):
    st = spark.createDataFrame([("w", "k", 0, "a")], "workflow_uuid string, key string, offset int, value string")
    more = spark.createDataFrame([("w", "k", 1, "b"), ("w", "k", 2, schema.CLOSED), ("w", "k", 3, "late")], "workflow_uuid string, key string, seq int, value string")
    assert sorted(tuple(r)[2:] for r in eventlog.append(st, more).collect()) == [(1, "b"), (2, schema.CLOSED)]


def test_reclaim_with_a_full_batch_reports_nothing_declined(spark):
    from flowledger.operators import recovery

    df = ws(spark, *({"workflow_uuid": f"w{i}", "executor_id": "dead", "created_at": i} for i in range(3)), {"workflow_uuid": "q", "executor_id": "dead", "queue_name": "q"}, {"workflow_uuid": "far", "executor_id": "dead", "name": "far"}).withColumn("application_version", F.lit("v"))
    caps = spark.createDataFrame([("n", None)], "cap_name string, cap_version string")
    some = recovery.reclaim(df, ["dead"], caps, "me", 9, 2)
    assert some.outcome == "batch_exhausted" and some.declined is None and ids(some.handled) == ["q", "w0", "w1"]
    table = spark.createDataFrame([("dead",)], "executor_id string")
    every = recovery.reclaim(df, table, caps, "me", 9)
    assert every.outcome == "drained" and [(r.name, r.reason) for r in every.declined.collect()] == [("far", "name_not_registered")]
    assert {r.workflow_uuid: (r.status, r.executor_id) for r in every.workflows.collect()} == {"w0": ("PENDING", "me"), "w1": ("PENDING", "me"), "w2": ("PENDING", "me"), "q": ("ENQUEUED", "dead"), "far": ("PENDING", "dead")}


def test_jdbc_reads_are_dealt_out():
    from flowledger.sources import tables

    got = tables.jdbc_options("jdbc:x", "workflow_status", "dbos", (0, 1000), 8, user="u")
    assert (got["partitionColumn"], got["lowerBound"], got["upperBound"], got["numPartitions"], got["user"]) == ("created_at", "0", "1000", "8", "u") and "query" not in got and got["dbtable"].startswith("(SELECT ")
    assert "partitionColumn" not in tables.jdbc_options("jdbc:x", "streams", "dbos")
    for table, bounds in (("streams", (0, 1)), ("workflow_status", (5, 5))):
        with pytest.raises(ValueError):
            tables.jdbc_options("jdbc:x", table, "dbos", bounds)


def test_snapshots_are_ranged_by_key(spark, tmp_path):
    from flowledger.sources import tables

    df = spark.createDataFrame([(f"w{i:03d}", "k", str(i), None) for i in range(200)], schema.TABLES["workflow_events"]).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows make one file
    try:
        tables.write_snapshot(df, str(tmp_path), "workflow_events")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(str(tmp_path / "workflow_events")).withColumn("f", F.input_file_name()).groupBy("f").agg(F.min("workflow_uuid").alias("a"), F.max("workflow_uuid").alias("b")).collect()
    ends = sorted((r.a, r.b) for r in files)
    assert len(ends) > 1 and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))


def test_receive_times_out(spark, tmp_path):
    """A wait ends once the watermark passes its deadline, and a message after that waits for the next one."""
    from flowledger.streaming import streams

    fields = "destination string, topic string, kind string, at long, deadline_ms long, message string"
    parts = [[("d", "t", "wait", 1_000, 5_000, None), ("e", "t", "wait", 1_000, 50_000, None)], [("z", "t", "message", 20_000, None, "clock")], [("d", "t", "message", 21_000, None, "late"), ("e", "t", "message", 22_000, None, "in time")], [("d", "t", "wait", 23_000, 90_000, None)]]
    for rows in parts:
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = streams.log_source(spark, str(tmp_path / "in"), spark.createDataFrame([], fields).schema).withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", "1 second")
        out = streams.to_table(streams.receive(live), str(tmp_path / "out"), str(tmp_path / "cp"))
        out.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("destination", "outcome", "message").collect())
    assert got == [("d", "message", "late"), ("d", "timeout", None), ("e", "message", "in time")]


def test_streamed_notifications_equal_batch(spark, tmp_path):
    from flowledger.streaming import streams

    st = spark.createDataFrame([("w", "k", i, "v") for i in range(6)], "workflow_uuid string, key string, offset int, value string")
    st.write.parquet(str(tmp_path / "in"))
    streams.to_table(streams.notifications(streams.log_source(spark, str(tmp_path / "in"), st.schema), "streams"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    batch = eventlog.change_feeds({"streams": st.limit(0)}, {"streams": st})
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).distinct().collect()] == [tuple(r) for r in batch.collect()] == [("stream", "w::k")]


def test_shown_texts_are_escaped(spark):
    df = spark.createDataFrame([('a"b\\c\nd',)], "output string")
    assert df.select(reports.shown(F.col("output"))).first()[0] == '"a\\"b\\\\c\\nd"'
    assert spark.range(1).select(scalars.text_graphemes(F.lit("e\u0301\r\n👨‍👩‍👧ab"), 2)).first()[0] == ["e\u0301\r\n", "👨‍👩‍👧a", "b"]
