"""Numbers: rounding, clamping, rates, token and cost estimates, dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: Column, digits: int = 2) -> Column:
    """Rounded half up at `digits` decimals, the same in every engine: floor(x 10^n + 0.5) / 10^n."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / F.lit(scale)


def whole(c: Column) -> Column:
    """The nearest integer, halves up."""
    return F.floor(c + 0.5)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def score_or(c: Column, default: float) -> Column:
    """1 to 10; the default for null, NaN and what is not above 0."""
    return F.when(c.isNull() | F.isnan(c) | (c <= 0), F.lit(float(default))).otherwise(clamp(c, 1, 10))


def to_ten(c: Column) -> Column:
    """Values in (0, 1] are tenths."""
    return F.when((c > 0) & (c <= 1.0), c * 10).otherwise(c)


def percent(part: Column, total: Column) -> Column:
    return F.coalesce(whole(F.try_divide(part * 100.0, total)), F.lit(0))


def token_estimate(c: Column, per_token: int = 4) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / per_token)


def output_budget(most: Column, used: Column, total: int, safety: int = 400, least: int = 800) -> Column:
    free = F.lit(total) - F.greatest(F.lit(0), F.ceil(used)) - safety
    return F.when(free < least, F.greatest(F.lit(1), F.least(most, free))).otherwise(F.least(most, free))


def llm_cost(inputs: Column, outputs: Column, per_million_in: str, per_million_out: str) -> Column:
    """Dollars as DECIMAL(18,6)."""
    cost = inputs.cast("decimal(20,0)") * F.lit(per_million_in).cast("decimal(10,4)") + outputs.cast("decimal(20,0)") * F.lit(per_million_out).cast("decimal(10,4)")
    return F.round(cost / F.lit(1_000_000).cast("decimal(8,0)"), 6).cast("decimal(18,6)")


def freshness_days(texts: Column) -> Column:
    """Least age named in any text ('3 weeks ago'); any hours mean 0; none means 0."""
    lower = F.transform(texts, lambda t: F.lower(F.coalesce(t, F.lit(""))))

    def age(t: Column) -> Column:
        number = lambda unit: F.nullif(F.regexp_extract(t, rf"\b(\d+)\s*{unit}s?\s*ago\b", 1), F.lit("")).cast("long")
        return F.coalesce(number("day"), number("week") * 7, number("month") * 30, number("year") * 365)

    hours = F.exists(lower, lambda t: t.rlike(r"\b\d+\s*(hour|hr)s?\s*ago\b"))
    return F.when(hours, F.lit(0)).otherwise(F.coalesce(F.array_min(F.transform(lower, age)), F.lit(0)))


def freshness(days: Column) -> Column:
    return fixed(clamp(F.exp(-0.02 * F.greatest(days, F.lit(0)).cast("double")), 0.20, 1.0))
