"""A discovery session: rounds over frames until one of the exit conditions holds, resumable from written state."""

from __future__ import annotations

import json
import random
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.operators.versions import Tables, VersionedStore
from briarlake.scratch import shared_dir


@dataclass
class Progress:
    """What is carried from round to round, besides the accepted leads."""

    round: int = 0
    accepted: int = 0
    stalled: int = 0
    stop: str = ""
    gains: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class Ports:
    """The stages of a round; each takes and returns frames with a long `id`."""

    retrieve: Callable[[int], DataFrame]
    verify: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Limits:
    target: int
    max_rounds: int = 8
    seconds: float = 3600.0


def exit_reason(p: Progress, limits: Limits, began: float, cancelled: Callable[[], bool]) -> str:
    """The first exit condition that holds, else empty."""
    if cancelled():
        return "cancelled"
    if time.monotonic() - began > limits.seconds:
        return "timeout"
    if p.accepted >= limits.target:
        return "target_fulfilled"
    if p.stalled >= 2 and p.accepted:
        return "early_exit_stalled"
    if p.stalled >= 3:
        return "exhausted"
    return "max_rounds" if p.round >= limits.max_rounds else ""


class Session:
    """A round's accepted leads and the progress are one commit of a versioned store; `run` resumes from the last.

    `cancel`, from any thread, ends the jobs of a running round by their tag; what
    that round had written has no manifest, so the last commit is the state.
    """

    def __init__(self, spark: SparkSession, name: str, ports: Ports, limits: Limits):
        self.spark, self.ports, self.limits = spark, ports, limits
        self.store = VersionedStore(spark, f"{shared_dir(spark)}/session-{name}")
        self.tag, self._cancelled = f"session-{uuid.uuid4().hex}", threading.Event()

    def _saved(self) -> Progress:
        if not self.store.latest():
            return Progress()
        return Progress(**json.loads(self.store.read("progress").first().value))

    def accepted(self, p: Progress) -> DataFrame | None:
        return self.store.read("accepted", p.round) if p.round else None

    def cancel(self) -> None:
        """End the running round, and take no other."""
        self._cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _round(self, p: Progress) -> Progress:
        before = self.accepted(p)
        new = self.ports.verify(self.ports.retrieve(p.round + 1)).dropDuplicates(["id"])
        if before is not None:
            new = before.unionByName(new.join(before.select(F.col("id").alias("_seen")), F.col("id") == F.col("_seen"), "left_anti"))
        after: list[Progress] = []

        def progress(written: Tables) -> DataFrame:
            count = written["accepted"].count()
            gain = count - p.accepted
            after.append(Progress(p.round + 1, count, 0 if gain else p.stalled + 1, "", [*p.gains, gain]))
            return self.spark.createDataFrame([(json.dumps(asdict(after[0])),)], "value string").coalesce(1)

        self.store.commit({"accepted": new, "progress": progress}, p.round)
        return after[0]

    def run(self, cancelled: Callable[[], bool] = lambda: False) -> tuple[DataFrame | None, Progress]:
        p, began = self._saved(), time.monotonic()
        ended = lambda: self._cancelled.is_set() or cancelled()
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        context.setInterruptOnCancel(True)
        try:
            while not (stop := exit_reason(p, self.limits, began, ended)):
                try:
                    p = self._round(p)
                except Exception:
                    if not self._cancelled.is_set():
                        raise
        finally:
            context.removeJobTag(self.tag)
            context.setInterruptOnCancel(False)
        p.stop = stop
        return self.accepted(p), p


class Provider:
    """A service with a breaker: after `most` failures it is not tried again in this session."""

    def __init__(self, name: str, call: Callable[[str], str], most: int = 3):
        self.name, self.call, self.most, self.failures = name, call, most, 0

    @property
    def usable(self) -> bool:
        return self.failures < self.most


def first_answer(providers: Iterable[Provider], prompt: str) -> tuple[str, str]:
    """(provider, answer) of the first usable provider that answers."""
    last: Exception | None = None
    for p in providers:
        if p.usable:
            try:
                return p.name, p.call(prompt)
            except Exception as error:
                p.failures, last = p.failures + 1, error
    raise RuntimeError("no provider answered") from last


def retried(call: Callable[[int], object], kind: Callable[[Exception], str], retries: int = 1, base: float = 0.75, sleep: Callable[[float], None] = time.sleep, jitter: float = 0.25) -> object:
    """Retry transient failures with doubling delays and jitter; others are raised at once."""
    attempt = 1
    while True:
        try:
            return call(attempt)
        except Exception as error:
            if not kind(error).endswith("_transient") or attempt > min(max(retries, 0), 2):
                raise
            start = max(base, 5.0) if kind(error) == "transport_transient" else base
            sleep(start * 2 ** (attempt - 1) + random.random() * jitter)
            attempt += 1


def by_priority(tasks: list[tuple[int, Callable[[], object]]], at_once: int) -> list[object]:
    """Results in the order given; higher priority starts first, 1 to 16 at once."""
    order = sorted(range(len(tasks)), key=lambda k: -tasks[k][0])
    with ThreadPoolExecutor(min(max(at_once, 1), 16)) as pool:
        running = {k: pool.submit(tasks[k][1]) for k in order}
        return [running[k].result() for k in range(len(tasks))]


def provider_mode(explicit: str, secondary_ready: bool) -> str:
    """The explicit mode unless its provider is missing; else both, or the primary alone."""
    if explicit in ("hybrid", "primary", "secondary"):
        return "primary" if explicit == "secondary" and not secondary_ready else explicit
    return "hybrid" if secondary_ready else "primary"


def key_list(raw: str) -> list[str]:
    """Distinct keys of a JSON array or a comma list."""
    try:
        parsed = json.loads(raw)
    except ValueError:
        parsed = raw.split(",")
    return list(dict.fromkeys(k.strip() for k in (parsed if isinstance(parsed, list) else [str(parsed)]) if isinstance(k, str) and k.strip()))


def clamped(value: object, default: int, low: int, high: int) -> int:
    try:
        return min(max(int(float(value)), low), high)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
