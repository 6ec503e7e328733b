"""Session loop, providers and driver-side helpers."""

import threading
import time
import uuid

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from briarlake.plans import session as S


def ports(spark, gains):
    def retrieve(round_):
        start, n = 100 * round_, gains[min(round_, len(gains)) - 1]
        return spark.range(start, start + n)

    return S.Ports(retrieve, lambda frame: frame.where("id % 2 = 0"))


def run(spark, gains, name=None, **limits):
    return S.Session(spark, name or uuid.uuid4().hex, ports(spark, gains), S.Limits(**{"target": 10} | limits)).run()


def test_stops_at_the_target(spark):
    leads, p = run(spark, [8, 8, 8, 8])
    assert p.stop == "target_fulfilled" and p.gains == [4, 4, 4] and leads.count() == 12


def test_stops_when_stalled(spark):
    assert run(spark, [4, 0, 0, 4])[1].stop == "early_exit_stalled"
    assert run(spark, [0])[1].stop == "exhausted"


def test_resumes_from_written_rounds(spark):
    name = uuid.uuid4().hex
    first = run(spark, [4] * 9, name, max_rounds=2)[1]
    leads, second = run(spark, [4] * 9, name, target=8)
    assert first.stop == "max_rounds" and second.round == 4 and leads.count() == 8


def test_cancel_and_timeout(spark):
    one = S.Session(spark, uuid.uuid4().hex, ports(spark, [2]), S.Limits(5))
    assert one.run(lambda: True)[1].stop == "cancelled"
    assert run(spark, [2], seconds=-1)[1].stop == "timeout"


def test_cancelling_ends_a_running_round_and_leaves_the_last(spark):
    """The second round would take minutes; it ends within seconds, and another session goes on from the first."""
    name, began = uuid.uuid4().hex, threading.Event()

    def retrieve(round_):
        if round_ < 2:
            return spark.range(0, 8)
        began.set()
        slow = F.udf(lambda x: time.sleep(0.5) or x, "long")
        return spark.range(100, 2000, 1, 8).select(slow("id").alias("id"))

    session = S.Session(spark, name, S.Ports(retrieve, lambda frame: frame), S.Limits(5000))
    out = []
    worker = InheritableThread(target=lambda: out.append(session.run()), session=spark)
    worker.start()
    assert began.wait(60)
    while not spark.sparkContext.statusTracker().getActiveJobsIds():
        time.sleep(0.2)
    time.sleep(1)
    stopped = time.monotonic()
    session.cancel()
    worker.join(30)
    assert not worker.is_alive() and time.monotonic() - stopped < 20
    leads, p = out[0]
    assert (p.stop, p.round, leads.count()) == ("cancelled", 1, 8) and session.store.versions() == [1]
    again = S.Session(spark, name, S.Ports(lambda round_: spark.range(50, 60), lambda frame: frame), S.Limits(10))
    assert again.run()[1].round == 2 and again.store.read("accepted").count() == 18


def test_providers():
    def bad(_):
        raise OSError

    a, b = S.Provider("a", bad, most=2), S.Provider("b", str.upper)
    assert [S.first_answer([a, b], "x") for _ in range(3)] == [("b", "X")] * 3 and a.failures == 2
    with pytest.raises(RuntimeError):
        S.first_answer([a], "x")


def test_retries():
    slept, tried = [], []

    def call(attempt):
        tried.append(attempt)
        if attempt < 2:
            raise OSError("busy")
        return "done"

    assert S.retried(call, lambda e: "target_transient", sleep=slept.append, jitter=0) == "done" and slept == [0.75] and tried == [1, 2]
    with pytest.raises(OSError):
        S.retried(lambda a: call(0), lambda e: "provider_auth", sleep=slept.append)


def test_small_helpers():
    assert S.by_priority([(1, lambda: "a"), (9, lambda: "b")], 1) == ["a", "b"]
    assert (S.provider_mode("secondary", False), S.provider_mode("", True), S.provider_mode("", False)) == ("primary", "hybrid", "primary")
    assert S.key_list('["a", "b ", "a"]') == ["a", "b"] and S.key_list("x, y,,x") == ["x", "y"]
    assert [S.clamped(v, 50, 10, 500) for v in (None, 3, 75, 800, "no")] == [50, 10, 75, 500, 50]
