"""Streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.registry import Frames, query
from briarlake.scratch import Scratch
from briarlake.streaming import events as E
from briarlake.streaming import sessions as S


def _stream(f: Frames) -> tuple[DataFrame, Scratch]:
    return E.source(f.spark, f.sf_dir), Scratch(f.spark, "stream")


@query("i01_event_source", "SELECT event_id, user_id, event_type FROM events")
def _(f: Frames) -> DataFrame:
    """Micro-batches of what is new since the last offsets."""
    stream, scratch = _stream(f)
    return E.drain(stream.select("event_id", "user_id", "event_type"), scratch)


@query("i03_duplicate_suppression", "SELECT DISTINCT event_id, event_type FROM events")
def _(f: Frames) -> DataFrame:
    stream, scratch = _stream(f)
    return E.drain(E.once(stream.select("event_id", "event_type")), scratch)


_SAID = "CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' END"
_LINE = "CASE WHEN event_type <> 'view' THEN event_type || ' ' || event_id END"
#: Each tenth event is sent again two hours later.
_SENT = f"sent AS (SELECT user_id, event_id, ts, {_LINE} AS line, {_SAID} AS said FROM events UNION ALL SELECT user_id, event_id, ts + INTERVAL '2' HOUR, {_LINE}, {_SAID} FROM events WHERE event_id % 10 = 0)"


def _messages(f: Frames) -> tuple[DataFrame, Scratch]:
    stream, scratch = _stream(f)
    hours = F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0))))
    sent = stream.withColumn("h", hours).withColumn("ts", F.col("ts") + F.make_interval(hours=F.col("h")))
    return sent.select(F.col("user_id").alias("session_id"), "ts", "event_id", F.expr(_LINE).alias("log_line"), F.expr(_SAID).alias("said")), scratch


@query("i04_session_fold", f"""WITH {_SENT}, m AS (SELECT *, row_number() OVER w AS position, row_number() OVER (PARTITION BY user_id, event_id ORDER BY ts) = 1 AS is_new FROM sent WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id AS session_id, position, event_id, is_new, CAST(count(*) FILTER (WHERE is_new) OVER p AS BIGINT) AS n_events, line AS log_line, CAST(count(line) OVER p AS BIGINT) AS n_logs,
 CASE coalesce(last_value(said IGNORE NULLS) OVER p, 'running') WHEN 'success' THEN 'completed' ELSE coalesce(last_value(said IGNORE NULLS) OVER p, 'running') END AS status FROM m WINDOW p AS (PARTITION BY user_id ORDER BY position ROWS UNBOUNDED PRECEDING)""")
def _(f: Frames) -> DataFrame:
    """Every message of every session in order, with the status, log and distinct events so far."""
    stream, scratch = _messages(f)
    return E.drain(S.session_fold(stream), scratch)


@query("i02_live_deltas", "SELECT event_id, event_type FROM events")
def _(f: Frames) -> DataFrame:
    """A17 and E10 too: a query that stays up on a trigger; a client's delta of what has arrived."""
    stream, scratch = _stream(f)
    feed = S.LiveFeed(stream.select("event_id", "event_type"), f"{scratch.base}/feed").start()
    try:
        feed.query.processAllAvailable()
        return feed.delta("view")
    finally:
        feed.stop()


@query("i10_day_windows", "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, event_type, CAST(count(*) AS BIGINT) AS n, sum(CAST(value AS DECIMAL(18,4))) AS total FROM events GROUP BY 1, 2")
def _(f: Frames) -> DataFrame:
    stream, scratch = _stream(f)
    return E.drain(E.day_counts(stream), scratch, "complete").withColumn("day", F.col("day").cast("timestamp_ntz"))
