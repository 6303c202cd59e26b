import datetime
import random
import time
from collections import Counter

import pytest

from pageloom.operators.ledger import (
    EVENT_SCHEMA, created_tasks, deleted_tasks, finish_events, get_task, ledger_state, list_tasks, start_events, task_view, with_liveness,
)
from pageloom.operators.schedule import send_schedule
from pageloom.streaming.keyed import ledger_state_stream, send_schedule_in_order, send_schedule_stream
from pageloom.streaming.run import run_available, stream_table

T0 = datetime.datetime(2024, 1, 1)


def event(seq, task, kind, status=None, count=0, records=None, error=None):
    return (seq, task, kind, status, f"https://e.com/{task}", count, records, error, T0 + datetime.timedelta(seconds=seq))


def frame(spark, events):
    return spark.createDataFrame(events, EVENT_SCHEMA)


def replay(events):
    """State of a keyed table after each event in turn; also which events took effect."""
    state, took = {}, {}
    for e in sorted(events):
        seq, task, kind, status, url, count, records, error, at = e
        live = task in state
        took[seq] = live
        if kind == "create" and not live:
            state[task] = ("pending", url, 0, None, None, at, at)
        elif kind == "update" and live:
            state[task] = (status, state[task][1], count, records, error, state[task][5], at)
        elif kind == "delete":
            state.pop(task, None)
    return state, took


def random_events(n=2000, seed=3):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        task = "hot" if rng.random() < 0.35 else f"t{rng.randrange(40)}"
        kind = rng.choices(["create", "update", "delete"], [2, 6, 1])[0]
        status = rng.choice(["running", "completed", "failed"])
        out.append(event(seq, task, kind, status if kind == "update" else None, rng.randrange(3), rng.choice([None, "[1]"]), rng.choice([None, "e"])))
    return out


def test_life_of_a_task(spark):
    events = [event(1, "task-456", "create"), event(2, "task-456", "update", "completed", 2, '[{"a":1},{"a":2}]')]
    row = get_task(ledger_state(frame(spark, events)), "task-456").first()
    assert (row.status, row.records_count, row.records) == ("completed", 2, '[{"a":1},{"a":2}]')
    events.append(event(3, "task-456", "update", "failed", 0, None, "boom"))
    row = get_task(ledger_state(frame(spark, events)), "task-456").first()
    assert (row.status, row.records_count, row.records, row.error_message) == ("failed", 0, None, "boom")
    assert task_view(ledger_state(frame(spark, events[:2]))).first().records.toPython() == [{"a": 1}, {"a": 2}]
    assert get_task(ledger_state(frame(spark, events)), "other").count() == 0


def test_state_agrees_with_replay(spark):
    events = random_events()
    got = ledger_state(frame(spark, events)).collect()
    assert {r.task_id: tuple(r)[1:] for r in got} == replay(events)[0]


@pytest.mark.parametrize("span", [7, 1_000_000])
def test_liveness_agrees_with_replay(spark, span):
    events = random_events()
    assert {r.seq: r.live for r in with_liveness(frame(spark, events), span).collect()} == replay(events)[1]


def test_duplicate_create_and_delete(spark):
    events = frame(spark, [event(1, "t1", "create"), event(2, "t1", "create"), event(3, "t1", "delete"), event(4, "t1", "delete"), event(5, "t1", "create")])
    assert [(r.seq, r.accepted) for r in created_tasks(events).orderBy("seq").collect()] == [(1, True), (2, False), (5, True)]
    assert [(r.seq, r.deleted) for r in deleted_tasks(events).orderBy("seq").collect()] == [(3, True), (4, False)]


def test_list(spark):
    events = frame(spark, [event(i, f"t{i:02d}", "create") for i in range(60)])
    rows = list_tasks(events).collect()
    assert [r.task_id for r in rows] == [f"t{i:02d}" for i in range(59, 9, -1)] and "records" not in rows[0]
    assert "records" in list_tasks(events, 2, include_records=True).columns


def test_events_of_a_crawl(spark):
    tasks = spark.createDataFrame([(0, "a", "u0", T0), (1, "b", "u1", T0), (2, "c", "u2", T0)], "task_no bigint, task_id string, url string, at timestamp")
    records = spark.createDataFrame([("u0", 2, 0, '{"x":2}'), ("u0", 1, 0, '{"x":1}')], "seed string, page_no int, item_no int, record string")
    failures = spark.createDataFrame([("u2", "bad schema")], "seed string, error string")
    state = ledger_state(start_events(tasks).union(finish_events(tasks, records, failures)))
    assert {r.task_id: (r.status, r.records_count, r.records, r.error_message) for r in state.collect()} == {
        "a": ("completed", 2, '[{"x":1},{"x":2}]', None), "b": ("completed", 0, "[]", None), "c": ("failed", 0, None, "bad schema")
    }


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_state_over_several_batches(spark, tmp_path, shuffled):
    events = random_events(600)
    arrived = random.Random(8).sample(events, len(events)) if shuffled else events
    path = str(tmp_path / "events")
    for part in range(3):
        frame(spark, arrived[part * 200:(part + 1) * 200]).coalesce(1).write.mode("append").parquet(path)
    changes = run_available(ledger_state_stream(stream_table(spark, path, EVENT_SCHEMA, files_per_batch=1)), "test-status").collect()
    latest = {}
    for r in sorted(changes, key=lambda r: r.version):
        latest[r.task_id] = (r.status, r.url, r.records_count) if r.live else None
    assert {k: v for k, v in latest.items() if v} == {k: v[:3] for k, v in replay(events)[0].items()}


def test_stream_schedule_over_several_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"d{rng.randrange(3)}", i, i * 10 + rng.randrange(5), 25) for i in range(300)]
    schema = "domain string, request_id bigint, arrival_us bigint, delay_us bigint"
    path = str(tmp_path / "requests")
    for part in range(3):
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], schema).coalesce(1).write.mode("append").parquet(path)
    got = run_available(send_schedule_stream(stream_table(spark, path, schema, files_per_batch=1)), "test-times").collect()
    last, want = {}, {}
    for domain, request, arrival, delay in sorted(rows, key=lambda r: (r[2], r[1])):
        last[domain] = want[request] = max(arrival, last.get(domain, -1000) + delay)
    assert {r.request_id: r.start_us for r in got} == want and not any(r.late for r in got)


def test_stream_schedule_marks_late_requests(spark, tmp_path):
    schema = "domain string, request_id bigint, arrival_us bigint, delay_us bigint"
    path = str(tmp_path / "requests")
    for rows in ([("d", 1, 100, 10), ("d", 2, 300, 10)], [("d", 3, 200, 10), ("d", 4, 400, 10)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by age
    got = run_available(send_schedule_stream(stream_table(spark, path, schema, files_per_batch=1)), "test-late").collect()
    assert {r.request_id: (r.start_us, r.late) for r in got} == {1: (100, False), 2: (300, False), 3: (310, True), 4: (400, False)}


def test_ordered_stream_of_shuffled_files_equals_the_batch(spark, tmp_path):
    """Files newest first, ties, a hot domain and one without a name: the times of the batch form; what is older than the wait is dropped."""
    rng = random.Random(12)
    second = 1_000_000
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), i, (i // 2 + 1) * second + rng.choice([0, 0, 7]), 2 * second) for i in range(400)]
    schema = "domain string, request_id bigint, arrival_us bigint, delay_us bigint"
    path = str(tmp_path / "requests")

    def write(part):
        time.sleep(1.1)  # files are taken by age
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)

    for k in (2, 0, 3, 1):  # by hundreds
        write(rows[k * 100:(k + 1) * 100])

    def close():
        write([("end", 1000, 10 ** 6 * second, 2 * second)])
        write([("a", 1001, 300 * second, second)])

    stream = send_schedule_in_order(stream_table(spark, path, schema, files_per_batch=1), "1 hour")
    got = run_available(stream, "test-ordered", close).collect()
    want = send_schedule(spark.createDataFrame(rows, schema)).collect()
    # 1000 waits for a newer request, 1001 is older than the wait allows
    assert Counter((r.domain, r.request_id, r.start_us) for r in got) == Counter((r.domain, r.request_id, r.start_us) for r in want)


def test_events_without_a_task_id_are_kept(spark):
    events = [event(1, None, "create"), event(2, "a", "create"), event(3, None, "create"), event(4, None, "delete"), event(5, None, "delete"), event(6, "a", "delete")]
    made = created_tasks(frame(spark, events)).orderBy("seq").collect()
    assert [(r.seq, r.accepted) for r in made] == [(1, True), (2, True), (3, False)]
    assert [(r.seq, r.deleted) for r in deleted_tasks(frame(spark, events)).orderBy("seq").collect()] == [(4, True), (5, False), (6, True)]


def test_a_seed_that_fails_twice_has_one_event(spark):
    tasks = spark.createDataFrame([(1, "t1", "u", T0), (2, "t2", "v", T0)], "task_no bigint, task_id string, url string, at timestamp")
    records = spark.createDataFrame([("v", 1, 0, "{}")], "seed string, page_no int, item_no int, record string")
    failures = spark.createDataFrame([("u", "b"), ("u", "a"), ("u", None)], "seed string, error string")
    got = {r.task_id: (r.status, r.records_count, r.error_message) for r in finish_events(tasks, records, failures).collect()}
    assert got == {"t1": ("failed", 0, "a"), "t2": ("completed", 1, None)}
    assert finish_events(tasks, records, failures).count() == 2


def test_requests_without_a_domain_are_scheduled(spark):
    rows = [(None, 1, 0, 10), (None, 2, 0, 10), ("a", 3, 0, 5), ("a", 4, 3, 5), (None, 5, 40, 10)]
    got = send_schedule(spark.createDataFrame(rows, "domain string, request_id bigint, arrival_us bigint, delay_us bigint").repartition(3))
    assert {r.request_id: r.start_us for r in got.collect()} == {1: 0, 2: 10, 3: 0, 4: 5, 5: 40}
