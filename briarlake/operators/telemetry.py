"""Aggregates over trace events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briarlake.operators.order import folded


def zero_filled(rows: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """(column, n) for every value of a fixed domain, also those without rows."""
    counts = rows.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("n"))
    values = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return values.join(counts, F.col(column) == F.col("_v"), "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def provider_summary(events: DataFrame, providers: tuple[str, ...]) -> DataFrame:
    """Calls, outcomes, latency, tokens and fallbacks of every provider; started events don't count."""
    status = F.col("status")
    tokens = F.when(F.col("total_tokens") > 0, F.col("total_tokens")).otherwise(F.col("input_tokens") + F.col("output_tokens"))
    sums = {
        "calls": F.count("*"), "successes": F.count_if(status == "success"), "failures": F.count_if(status == "error"), "skipped": F.count_if(status == "skipped"),
        "latency_ms": F.sum("latency_ms"), "avg_latency_ms": F.floor(F.sum("latency_ms").cast("double") / F.count("*") + 0.5), "total_tokens": F.sum(tokens), "fallback_uses": F.count_if("fallback_used"),
    }
    found = events.where("status <> 'started' AND provider IS NOT NULL").groupBy(F.col("provider").alias("_p")).agg(*[c.alias(n) for n, c in sums.items()])
    listed = events.sparkSession.createDataFrame([(p,) for p in providers], "provider string")
    return listed.join(found, F.col("provider") == F.col("_p"), "left").select("provider", *[F.coalesce(n, F.lit(0)).alias(n) for n in sums])


def folded_status(status: Column, order: Column) -> Column:
    """Any error, else any success, else the first that is not info, else info."""
    first = F.min(F.when(status != "info", F.struct(order.alias("o"), status.alias("s"))))["s"]
    return F.when(F.bool_or(status == "error"), "error").when(F.bool_or(status == "success"), "success").otherwise(F.coalesce(first, F.lit("info")))


def phase_timeline(events: DataFrame) -> DataFrame:
    """(session_id, phase, n_events, duration_ms, status)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = F.floor((F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1000)
    return events.groupBy("session_id", "phase").agg(F.count("*").alias("n_events"), span.alias("duration_ms"), folded_status(F.col("status"), F.col("event_id")).alias("status"))


def capped_reservations(requests: DataFrame, group: str, order: str, units: str, limit: int) -> DataFrame:
    """(group, used, granted, denied): requests of a group in order are granted while they fit under the limit; a denied one takes nothing."""

    def step(state: tuple, units: int) -> tuple:
        used, granted, denied = state
        return (used + units, granted + 1, denied) if used + units <= limit else (used, granted, denied + 1)

    kind = requests.schema[group].dataType.simpleString()
    asked = requests.select(group, order, F.coalesce(F.col(units), F.lit(0)).cast("long").alias("units"))
    return folded(asked, group, [order], ["units"], lambda: (0, 0, 0), step, lambda s: s, f"{group} {kind}, used long, granted long, denied long")
