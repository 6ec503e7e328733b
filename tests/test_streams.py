"""Session state across micro-batches and restarts, expiry of idle sessions, and a feed that stays up."""

import datetime
from array import array

from pyspark.sql import functions as F

from briarlake.operators.versions import StaleWrite
from briarlake.scratch import Scratch
from briarlake.streaming import events, sessions

SCHEMA = "session_id long, ts timestamp, event_id long, log_line string, said string"
START = datetime.datetime(2024, 1, 1)


def message(session, minute, event, line=None, said=None):
    return (session, START + datetime.timedelta(minutes=minute), event, line, said)


def feed(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_state_goes_on_over_micro_batches_and_restarts(spark, tmp_path):
    scratch = Scratch(spark, "t")
    feed(spark, tmp_path / "in", [message(1, 1, 10, "a"), message(1, 0, 11, "b", "success"), message(2, 0, 20, None, "error")], "one")
    first = events.drain(sessions.session_fold(stream(spark, tmp_path / "in")), scratch).collect()
    assert [(r.event_id, r.position, r.status) for r in sorted(first, key=lambda r: (r.session_id, r.position))] == [(11, 1, "completed"), (10, 2, "completed"), (20, 1, "error")]
    feed(spark, tmp_path / "in", [message(1, 5, 10, "again"), message(1, 6, 12, "c", "running"), message(1, 7, None, "line")], "two")
    got = events.drain(sessions.session_fold(stream(spark, tmp_path / "in")), scratch)  # a restart
    own = sorted((r for r in got.collect() if r.session_id == 1), key=lambda r: r.position)
    assert [(r.position, r.event_id, r.is_new, r.n_events, r.log_line, r.n_logs, r.status) for r in own] == [
        (1, 11, True, 1, "b", 1, "completed"), (2, 10, True, 2, "a", 2, "completed"), (3, 10, False, 2, "again", 3, "completed"), (4, 12, True, 3, "c", 4, "running"), (5, None, False, 3, "line", 5, "running"),
    ]
    assert {tuple(r) for r in sessions.latest_states(got).collect()} == {(1, "running", 3, 5), (2, "error", 1, 0)}


def test_idle_sessions_expire_and_begin_anew(spark, tmp_path):
    scratch, folder = Scratch(spark, "t"), tmp_path / "in"
    feed(spark, folder, [message(1, 0, 1, "a"), message(2, 0, 1)], "one")
    run = lambda: events.drain(sessions.session_fold(stream(spark, folder), idle="30 minutes", late="1 minute"), scratch)
    run()
    feed(spark, folder, [message(2, 25, 2), message(3, 50, 1)], "two")
    run()
    feed(spark, folder, [message(1, 51, 1, "anew"), message(3, 52, 2)], "three")
    got = sorted((r.session_id, r.position, r.status, r.n_events, r.is_new) for r in run().collect())
    assert [r for r in got if r[0] == 1] == [(1, 1, "running", 1, True), (1, 1, "running", 1, True), (1, 2, "expired", 1, False)]  # its events count again
    assert [r for r in got if r[0] == 2] == [(2, 1, "running", 1, True), (2, 2, "running", 2, True)]


def test_a_live_feed_sends_each_client_what_is_new(spark, tmp_path):
    folder = tmp_path / "in"
    rows = lambda a, b: [message(1, k, k) for k in range(a, b)]
    feed(spark, folder, rows(0, 60), "one")
    ids = lambda frame: sorted(r.event_id for r in frame.collect())
    live = sessions.LiveFeed(stream(spark, folder).select("event_id"), f"file://{tmp_path}/feed", every="200 milliseconds").start()
    try:
        live.query.processAllAvailable()
        assert ids(live.delta("a")) == list(range(60)) and ids(live.delta("a")) == []
        feed(spark, folder, rows(60, 150), "two")
        live.query.processAllAvailable()
        assert ids(live.delta("a")) == list(range(60, 150)) and ids(live.delta("b")) == list(range(150))
    finally:
        live.stop()
    feed(spark, folder, rows(150, 170), "three")
    again = sessions.LiveFeed(stream(spark, folder).select("event_id"), f"file://{tmp_path}/feed", every="200 milliseconds").start()
    try:
        again.query.processAllAvailable()
        assert ids(again.delta("a")) == list(range(150, 170))
    finally:
        again.stop()


def test_two_readers_of_a_client_dont_both_take_a_delta(spark, tmp_path):
    feed(spark, tmp_path / "in", [message(1, 0, 1)], "one")
    live = sessions.LiveFeed(stream(spark, tmp_path / "in").select("event_id"), f"file://{tmp_path}/feed", every="200 milliseconds").start()
    try:
        live.query.processAllAvailable()
    finally:
        live.stop()
    base = live.offsets.latest()
    live.delta("a")
    try:
        live.offsets.commit({"clients": spark.createDataFrame([("a", 9)], "client string, epoch long")}, base)
        raise AssertionError("a stale reader took it too")
    except StaleWrite:
        assert live.offsets.read("clients").where(F.col("epoch") == 0).count() == 1


def test_a_session_calls_its_state_a_few_times_however_many_messages_come():
    class Parts:
        """A session's map, counting its calls."""

        def __init__(self):
            self.held, self.calls = {}, 0

        def getValue(self, key):
            self.calls += 1
            return self.held[key]

        def updateValue(self, key, value):
            self.calls += 1
            self.held[key] = value

    kept, seen, n, only = Parts(), set(), 0, None
    for told in (range(100), range(50, 150), [k << 40 for k in range(-500, 500)], range(10_000), [3, 20_000], [3, 20_000]):
        calls, own = kept.calls, sessions._Seen(kept, n, only)
        for event in told:
            assert own.add(event) == (event not in seen)
            seen.add(event)
        n, only = own.n, own.write()
        assert n == len(seen) and kept.calls - calls <= 3 * min(len(told), own.parts)
    held = [array("q", value[0]) for value in kept.held.values()]
    assert sorted(k for part in held for k in part) == sorted(seen) and max(map(len, held)) < 4 * sessions._PART


def test_more_parts_than_memory_may_hold_lose_no_id(monkeypatch):
    class Parts(dict):
        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self[key] = value

    monkeypatch.setattr(sessions, "_PART", 4)
    monkeypatch.setattr(sessions, "_HELD", 3)
    kept = Parts()
    own = sessions._Seen(kept, 0, None)
    assert all(own.add(k) for k in range(100)) and not any(own.add(k) for k in range(100))
    own.write()
    again = sessions._Seen(kept, 100, None)
    assert [k for k in range(90, 110) if again.add(k)] == list(range(100, 110))


def test_a_long_session_goes_on_over_micro_batches(spark, tmp_path):
    """Of null ids and times too, and of ids that a double doesn't hold."""
    scratch, big = Scratch(spark, "t"), 2**60 + 1
    feed(spark, tmp_path / "in", [message(1, k, big + k, "a") for k in range(300)] + [(1, None, 7, "b", None), message(1, 0, None)], "one")
    run = lambda: events.drain(sessions.session_fold(stream(spark, tmp_path / "in")), scratch)
    run()
    feed(spark, tmp_path / "in", [message(1, 400 + k, big + k) for k in range(250, 350)] + [message(1, 900, 7)], "two")
    got = sorted(run().collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(1, 404))
    assert [r.event_id for r in got] == [big, None, *range(big + 1, big + 300), 7, *range(big + 250, big + 350), 7]
    assert [r.is_new for r in got] == [True, False, *[True] * 300, *[False] * 50, *[True] * 50, False] and got[-1].n_events == 351 and got[-1].n_logs == 301
