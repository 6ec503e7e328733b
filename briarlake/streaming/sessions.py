"""Live state of sessions: status, log and deduplicated events folded across micro-batches, with timers that end idle sessions."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = {"position": "long", "event_id": "long", "is_new": "boolean", "n_events": "long", "log_line": "string", "n_logs": "long", "status": "string"}
_MESSAGE = {"at": "long", "event_id": "long", "log_line": "string", "said": "string"}
#: Messages come and go in lists of so many at most, as a row of each costs some ten times what folding it does; of so many of a partition lists are made at a time.
_PACK, _AT_ONCE = 100, 200_000
_Packed = Row("session_id", *_COLUMNS)
#: What a session's own status becomes in its state.
_STATUS = {"success": "completed"}
#: Event ids that a part of a session's holds on the average, and parts held in memory.
_PART, _HELD = 128, 4096


def _lists(columns: dict[str, str]) -> str:
    return "session_id long, " + ", ".join(f"{name} array<{kind}>" for name, kind in columns.items())


def _packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A row for up to _PACK messages of a session."""
    table = pa.Table.from_batches(held).sort_by("session_id")
    session = table["session_id"].to_numpy()
    begins = np.flatnonzero(np.append(True, session[1:] != session[:-1]))
    place = np.arange(len(session)) - np.repeat(begins, np.diff(np.append(begins, len(session))))
    starts = np.flatnonzero(place % _PACK == 0)
    offsets = pa.array(np.append(starts, len(session)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(session[starts]), *(pa.ListArray.from_arrays(offsets, table[name].combine_chunks()) for name in _MESSAGE)], ["session_id", *_MESSAGE])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= _AT_ONCE:
            yield _packed(held)
            held, n = [], 0
    if n:
        yield _packed(held)


def _part(event: int, parts: int) -> int:
    """Which of so many parts has an id; one part more takes ids only of one other."""
    mask = (1 << (parts - 1).bit_length()) - 1
    place = zlib.crc32(event.to_bytes(8, "little", signed=True)) & mask if mask else 0
    return place if place < parts else place & mask >> 1


def _ids(held: bytes) -> set[int]:
    return set(array("q", bytes(held)))


class _Seen:
    """The `n` event ids of one session in a map of parts, each read when it is asked for and written once a micro-batch.

    A call of the state costs some hundred times what an id does. Parts are added
    by linear hashing, so an id costs the work on a part or two, however many
    the session has. An `only` part is not in the map.
    """

    def __init__(self, state: MapState, n: int, only: bytes | None):
        self.state, self.n, self.parts = state, n, -(-n // _PART)
        self.ids: dict[int, set[int]] = {} if only is None else {0: _ids(only)}
        self.changed: set[int] = set()

    def _read(self, part: int) -> set[int]:
        if part not in self.ids:
            if len(self.ids) >= _HELD:
                self.write()
            self.ids[part] = _ids(self.state.getValue((part,))[0])
        return self.ids[part]

    def _grow(self) -> None:
        last, self.parts = self.parts, self.parts + 1
        moved: set[int] = set()
        if last:
            split = last - (1 << last.bit_length() - 1)
            ids = self._read(split)
            moved = {event for event in ids if _part(event, self.parts) == last}
            ids -= moved
            self.changed.add(split)
        self.ids[last] = moved
        self.changed.add(last)

    def add(self, event: int) -> bool:
        """Whether it is new."""
        if self.n and event in self._read(_part(event, self.parts)):
            return False
        if self.n == self.parts * _PART:
            self._grow()
        self.n += 1
        part = _part(event, self.parts)
        self._read(part).add(event)
        self.changed.add(part)
        return True

    def write(self) -> bytes | None:
        """Into the map; an only part is returned instead."""
        if self.parts == 1:
            return array("q", self.ids[0]).tobytes()
        for part in self.changed:
            self.state.updateValue((part,), (array("q", self.ids[part]).tobytes(),))
        self.ids, self.changed = {}, set()
        return None


def _in_order(message: tuple) -> tuple:
    """By time and id, each with null last."""
    at, event = message[:2]
    return at is None, at or 0, event is None, event or 0


class _Fold(StatefulProcessor):
    """Totals, status and few event ids are a value, more ids a map of parts: a message costs the same, however long its session is."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "messages long, events long, logs long, status string, timer long, ids binary")
        self.seen = handle.getMapState("seen", "part long", "ids binary")

    def _clear(self) -> None:
        self.totals.clear()
        self.seen.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, events, logs, status, timer, only = self.totals.get() if self.totals.exists() else (0, 0, 0, "running", 0, None)
        first = next(rows)
        pick = itemgetter(*map(first.__fields__.index, _MESSAGE))
        messages = sorted((m for r in chain([first], rows) for m in zip(*pick(tuple(r)), strict=True)), key=_in_order)
        last = max((m[0] for m in messages if m[0] is not None), default=0) // 1000
        seen, out = _Seen(self.seen, events, only), []
        for _, event, line, said in messages:
            n += 1
            new = event is not None and seen.add(event)
            logs += line is not None
            status = status if said is None else _STATUS.get(said, said)
            out.append((n, event, new, seen.n, line, logs, status))
        only = seen.write()
        if self.idle_ms is not None and last + self.idle_ms > timer:
            if timer:
                self.handle.deleteTimer(timer)
            timer = last + self.idle_ms
            self.handle.registerTimer(timer)
        self.totals.update((n, seen.n, logs, status, timer, only))
        for k in range(0, len(out), _PACK):
            yield _Packed(key[0], *map(list, zip(*out[k : k + _PACK], strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, events, logs, *_ = self.totals.get()
        self._clear()
        yield _Packed(key[0], [n + 1], [None], [False], [events], [None], [logs], ["expired"])

    def close(self) -> None:
        pass


def session_fold(stream: DataFrame, idle: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(session_id, position, event_id, is_new, n_events, log_line, n_logs, status): each message of a session as it changes the session's state.

    `stream` has session_id, ts, event_id, log_line and said: a message's event,
    its line of the log and the status it tells, each perhaps null. A session
    runs from its first message on. An event that was seen counts once; its
    line is logged again. What one micro-batch brings of a session is taken in
    order of time and id.

    State lies in RocksDB and is checkpointed with the query, so a restart goes
    on where it ended. With `idle`, a session without messages for so long, by
    the watermark that trails by `late`, ends as `expired` and its state goes.
    The rows are increments: the sink's table holds logs and events in order, so
    no message writes a whole session again.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    session = F.col("session_id").cast("long").alias("session_id")
    message = [c.cast(_MESSAGE[name]).alias(name) for name, c in zip(_MESSAGE, (F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"), F.col("log_line"), F.col("said")), strict=True)]
    rows = stream.where("session_id IS NOT NULL")
    if idle is None:
        idle_ms, mode = None, "none"
        rows = rows.select(session, *message).repartition("session_id").mapInArrow(_pack, _lists(_MESSAGE))
    else:  # late messages are told by ts, each for itself
        idle_ms, mode = int(pd.Timedelta(idle).total_seconds() * 1000), "eventTime"
        rows = rows.withWatermark("ts", late).select(session, "ts", *(F.array(c).alias(name) for name, c in zip(_MESSAGE, message, strict=True)))
    folded = rows.groupBy("session_id").transformWithState(_Fold(idle_ms), _lists(_COLUMNS), "append", mode)
    return folded.select("session_id", F.inline(F.arrays_zip(*_COLUMNS)))


def latest_states(folded: DataFrame) -> DataFrame:
    """(session_id, status, n_events, n_logs) as of the last message."""
    last = F.max_by(F.struct("status", "n_events", "n_logs"), "position").alias("s")
    return folded.groupBy("session_id").agg(last).select("session_id", "s.*")


class LiveFeed:
    """A query that stays up on a processing-time trigger; clients ask for what is new since they last asked.

    Each trigger's rows are a folder of their own, which a repeated trigger
    replaces. A client's offset is committed with a compare-and-swap, so two
    readers of one client don't both take a delta, and after a restart each
    client goes on where it was.
    """

    def __init__(self, stream: DataFrame, folder: str, every: str = "1 second"):
        from briarlake.operators.versions import VersionedStore

        self.stream, self.folder, self.every, self.query = stream, folder, every, None
        self.spark: SparkSession = stream.sparkSession
        self.offsets = VersionedStore(self.spark, f"{folder}/offsets")

    def start(self) -> LiveFeed:
        folder = self.folder

        def kept(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

        self.query = self.stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(kept).trigger(processingTime=self.every).start()
        return self

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None

    def _epochs(self) -> list[int]:
        """Of finished triggers."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath() for f in files.listStatus(root)] if files.exists(root) else []
        return sorted(int(p.getName().partition("=")[2]) for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def delta(self, client: str) -> DataFrame:
        """The rows of the triggers that ended since this client last asked."""
        base = self.offsets.latest()
        known = self.offsets.read("clients") if base else None
        at = known.where(F.col("client") == client).agg(F.max("epoch")).first()[0] if known is not None else None
        new = [e for e in self._epochs() if at is None or e > at]
        if not new:
            return self.spark.createDataFrame([], self.stream.schema)
        row = self.spark.createDataFrame([(client, new[-1])], "client string, epoch long")
        others = row if known is None else known.where(F.col("client") != client).unionByName(row)
        self.offsets.commit({"clients": others}, base)
        return self.spark.read.schema(self.stream.schema).parquet(*[f"{self.folder}/rows/epoch={e}" for e in new])
