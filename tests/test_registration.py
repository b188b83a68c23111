"""Registration, requests and upserts on literal rows."""

from flowledger.operators import registration as r

WS = "workflow_uuid string, queue_name string, deduplication_id string"
ASKED = "request int, workflow_uuid string, name string, queue_name string, deduplication_id string, positional_args array<string>, named_args string, delay_until_epoch_ms bigint"


def test_requests(spark):
    ws = spark.createDataFrame([("w1", "q", "d1"), ("w2", None, None)], WS)
    asked = spark.createDataFrame([
        (1, "n1", "f", "q", "d2", ["1"], "{}", None), (2, "n2", "f", "q", "d2", [], "{}", None), (3, "n3", "f", "q", "d1", None, None, None), (4, "w1", "f", "q", "d1", [], "{}", None),
        (5, "n5", "f", "q", None, [], "{}", 0), (6, "n6", None, "q", "d3", [], "{}", None), (7, "n7", "f", "q", "d3", [], "{}", None), (8, "n8", "f", "q", None, [], "[]", None),
        (9, "n9", "f", "q", None, [], "not json", None), (10, None, "f", "q", None, [], "{}", None), (11, "", "f", "q", None, [], "{}", None), (12, "n12", "f", "", None, [], "{}", -1),
    ], ASKED)
    rows = {x.request: x for x in r.enqueue_requests(ws, asked).collect()}
    answers = [rows[i].answer for i in range(1, 13)]
    assert answers == ["ENQUEUED", "duplicate", "duplicate", "existing", "DELAYED", "invalid", "ENQUEUED", "invalid", "invalid", "ENQUEUED", "invalid", "invalid"]
    assert rows[1].inputs == '{"positionalArgs" : [1], "namedArgs" : {}}' and rows[3].inputs == '{"positionalArgs" : null, "namedArgs" : null}'
    assert len(rows[10].workflow_uuid) == 36 and rows[12].error == "Queue name cannot be null or empty"
    assert r.enqueue_requests(ws, asked.limit(0)).count() == 0


def test_queues_without_a_registered_version(spark):
    queues = spark.createDataFrame([("q", 1)], "name string, concurrency int")
    new = spark.createDataFrame([("q", 2)], "name string, concurrency int")
    none = spark.createDataFrame([], "version_name string, version_timestamp int")
    assert r.register_queues(queues, new, none, "v1").collect() == [("q", 2)]


def test_schedules_keep_their_state(spark):
    old = spark.createDataFrame([("s1", "a", "0 * * * * *", "PAUSED", "7")], "schedule_id string, schedule_name string, schedule string, status string, last_fired_at string")
    new = spark.createDataFrame([("s2", "a", "@daily"), ("s3", "b", "@daily")], "schedule_id string, schedule_name string, schedule string")
    both = r.register_schedules(old, new)
    assert sorted(map(tuple, both.collect())) == [("s1", "a", "@daily", "PAUSED", "7"), ("s3", "b", "@daily", "ACTIVE", None)]
    fired = r.mark_fired(both, spark.createDataFrame([("b", 9), ("b", 12)], "schedule_name string, epoch_ms bigint"))
    assert {x.schedule_name: x.last_fired_at for x in fired.collect()} == {"a": "7", "b": "12"}


def test_events_of_one_key_take_the_last_step(spark):
    current = spark.createDataFrame([("w", "k", "old"), ("w", "other", "x")], "workflow_uuid string, key string, value string")
    history = spark.createDataFrame([("w", "k", 1, "old")], "workflow_uuid string, key string, function_id int, value string")
    incoming = spark.createDataFrame([("w", "k", 3, "b"), ("w", "k", 2, "a"), ("w", "k", 1, "again")], "workflow_uuid string, key string, function_id int, value string")
    now, log = r.set_events(current, history, incoming)
    assert sorted(map(tuple, now.collect())) == [("w", "k", "b"), ("w", "other", "x")]
    assert sorted(map(tuple, log.collect())) == [("w", "k", 1, "again"), ("w", "k", 2, "a"), ("w", "k", 3, "b")]


def test_text_lines(spark):
    header, rule, lines = r.text_lines(spark.createDataFrame([("a", 12345, None), ("longer", 1, "x")], "name string, n int, why string"))
    assert (header, rule) == ("name    n      why", "------  -----  ---")
    assert sorted(x.line for x in lines.collect()) == ["a       12345", "longer  1      x"]
