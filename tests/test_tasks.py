"""Task states over batches, restarts, late rows and timers; a queue's worker."""

import datetime

from tidemark.streaming import logs, tasks

EVENT = "task_id string, seq long, kind string, pct int, at timestamp"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def feed(spark, folder, rows):
    spark.createDataFrame([(*r[:4], at(r[4] if len(r) > 4 else r[1])) for r in rows], EVENT).coalesce(1).write.mode("append").parquet(folder)


def test_states_follow_events_over_restarts(spark, tmp_path):
    source, place = f"{tmp_path}/in", f"{tmp_path}/out"
    batches = [
        [("a", 1, "submit", None), ("a", 2, "start", None), ("b", 3, "submit", None), ("c", 4, "start", None), ("d", 5, "submit", None), ("d", 6, "cancel", None)],
        [("a", 7, "progress", 40), ("a", 8, "cancel", None), ("b", 9, "cancel", None), ("c", 10, "submit", None), ("d", 11, "fail", None), ("a", 2, "fail", None)],
        [("a", 12, "complete", None), ("c", 14, "progress", 5), ("c", 13, "start", None), (None, 15, "submit", None), ("a", 16, None, None)],
    ]

    def run():
        stream = spark.readStream.schema(EVENT).parquet(source)
        return sorted((str(r.task_id), r.seq, r.status, r.progress, r.late) for r in logs.drained(tasks.task_states(stream), "t", place).collect())

    for rows in batches:
        feed(spark, source, rows)
        found = run()
    assert found == sorted([
        ("a", 1, "pending", 0, 0), ("a", 2, "running", 0, 0), ("a", 7, "running", 40, 1), ("a", 8, "running", 40, 1), ("a", 12, "completed", 100, 1), ("a", 16, "completed", 100, 1),
        ("b", 3, "pending", 0, 0), ("b", 9, "cancelled", 0, 0), ("c", 10, "pending", 0, 0), ("c", 13, "running", 0, 0), ("c", 14, "running", 5, 0),
        ("d", 5, "pending", 0, 0), ("d", 6, "cancelled", 0, 0), ("d", 11, "failed", 0, 0), ("None", 15, "pending", 0, 0),
    ])
    assert run() == found  # nothing new: nothing again


def test_silent_tasks_fail_and_ended_ones_are_forgotten(spark, tmp_path):
    source, place = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(rows):
        feed(spark, source, rows)
        stream = spark.readStream.schema(EVENT).parquet(source)
        states = tasks.task_states(stream, timeout_ms=60_000, keep_ms=30_000, lateness="1 second")
        return {(r.task_id, r.seq, r.status, r.reason) for r in logs.drained(states, "t", place).collect()}

    run([("a", 1, "submit", None, 0), ("b", 2, "submit", None, 0), ("b", 3, "complete", None, 5)])
    run([("c", 4, "submit", None, 200)])
    found = run([("c", 5, "start", None, 210), ("b", 6, "submit", None, 211)])
    assert ("a", 1, "failed", "timeout") in found
    assert ("b", 6, "pending", None) in found  # had been forgotten, and so could be submitted again
    assert ("c", 5, "running", None) in found and not any(r[0] == "c" and r[2] == "failed" for r in found)


def test_the_worker_hands_jobs_to_their_kind(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    feed(spark, source, [("a", k, "x" if k % 2 else "y", None) for k in range(10)])

    def run():
        logs.work(spark.readStream.schema(EVENT).parquet(source), {"x": lambda b: b.select("seq"), "y": lambda b: b.selectExpr("-seq as seq")}, out)
        return sorted(r.seq for kind in "xy" for r in spark.read.parquet(f"{out}/{kind}").select("seq").collect())

    want = sorted([k if k % 2 else -k for k in range(10)])
    assert run() == want
    feed(spark, source, [("a", 11, "x", None), ("a", 12, "z", None)])
    assert run() == sorted([*want, 11])


def test_once_with_a_bound(spark, tmp_path):
    source = f"{tmp_path}/in"
    feed(spark, source, [("a", 1, "x", None), ("a", 1, "x", None), ("b", 1, "x", None)])
    stream = spark.readStream.schema(EVENT).parquet(source)
    assert logs.drained(logs.once(stream, "task_id", "seq", "at"), "once").count() == 2
    assert logs.once(spark.read.parquet(source), "task_id", "seq", "at").count() == 2


def test_totals_go_on_from_their_place(spark, tmp_path):
    source, place = f"{tmp_path}/in", f"{tmp_path}/out"

    def run():
        stream = spark.readStream.schema(EVENT).parquet(source)
        return {r.task_id: (r.last_seq, r.n) for r in logs.drained_totals(logs.progress(stream, "task_id", "seq"), "p", place).collect()}

    feed(spark, source, [("a", 1, "x", None), ("b", 2, "x", None)])
    assert run() == {"a": (1, 1), "b": (2, 1)}
    feed(spark, source, [("a", 5, "x", None)])
    assert run() == {"a": (5, 2), "b": (2, 1)} == run()
