"""Order without gathering: distributed ranks and prefix sums, folds over sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briarlake.scratch import Scratch


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: list[str], order: list[Column], scratch: Scratch, name: str = "rank", sums: tuple[str, ...] = ()) -> DataFrame:
    """Add the 0-based position within `group` in `order`, without gathering a group in one task.

    Of each column in `sums`, `<column>_before` is added: its sum over the rows
    of the group that stand before. Rows are range-partitioned by group and
    order, so one hot group spreads over many partitions. What lies before a row
    in its sorted partition and the totals of its group in earlier partitions (a
    table of at most partitions plus groups rows) add up. `df` must not have
    columns that begin with _run_.
    """
    keys = [F.col(c).asc_nulls_last() for c in group] + order
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = scratch.keep(dealt.withColumn("_run_part", F.shiftright(place, 33)).withColumn("_run_place", place.bitwiseAND((1 << 33) - 1)))
    if sums:
        here = Window.partitionBy("_run_part", *group).orderBy("_run_place").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"{c}_before") for c in sums])
    runs = dealt.groupBy("_run_part", *group).agg(F.count("*").alias("_run_n"), F.min("_run_place").alias("_run_first"), *[F.sum(c).alias(f"_run_sum_{c}") for c in sums])
    before = Window.partitionBy(*group).orderBy("_run_part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    runs = scratch.keep(runs.select(F.col("_run_part").alias("_run_p"), *[F.col(c).alias(f"_run_g_{c}") for c in group], (total("_run_n") - F.col("_run_first")).alias("_run_shift"), *[total(f"_run_sum_{c}").alias(f"_run_sum_{c}") for c in sums]))
    same = F.col("_run_part") == F.col("_run_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_run_g_{c}"))
    out = dealt.join(runs, same).withColumn(name, (F.col("_run_place") + F.col("_run_shift")).cast("long"))
    for c in sums:
        out = out.withColumn(f"{c}_before", F.col(f"{c}_before") + F.col(f"_run_sum_{c}"))
    return out.drop(*[c for c in out.columns if c.startswith("_run_")])


def affine_last(rows: DataFrame, group: str, order: list[str], value: str, gain: float, scratch: Scratch) -> DataFrame:
    """(group, last) of each group: where x ends that starts at the first value and then, row by row, moves by `gain` of the way to the value.

    Each step is a map x -> a x + b, and so are steps one after the other. Rows
    are range-partitioned by group and order, so a hot group spreads over many
    partitions; each run of a group in a partition gives one map, and the maps of
    a group, at most one a partition, are joined in order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now = TaskContext.get().partitionId(), None
        for frame in frames:
            keys, values = frame[group].to_numpy(), frame[value].to_numpy(np.float64)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            out = []
            for s, e in zip(np.r_[0, cuts][: len(keys)], np.r_[cuts, len(keys)], strict=False):
                weights = (1.0 - gain) ** np.arange(e - s - 1, -1, -1)
                a, b = (1.0 - gain) ** (e - s), float(weights @ values[s:e]) * gain
                if now is not None and keys[s] == now[1]:
                    now = (part, now[1], now[2] * a, now[3] * a + b, now[4])
                else:
                    out += [now] if now is not None else []
                    now = (part, keys[s], a, b, values[s])
            yield pd.DataFrame(out, columns=["part", group, "a", "b", "first"])
        if now is not None:
            yield pd.DataFrame([now], columns=["part", group, "a", "b", "first"])

    kind = rows.schema[group].dataType.simpleString()
    dealt = rows.where(F.col(group).isNotNull()).select(group, *dict.fromkeys([*order, value])).repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    runs = scratch.keep(dealt.mapInPandas(run, f"part int, {group} {kind}, a double, b double, first double"))
    maps = runs.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "first"))).alias("_maps"))
    return maps.select(group, F.aggregate("_maps", F.get("_maps", F.lit(0))["first"], lambda x, m: x * m["a"] + m["b"]).alias("last"))


def folded(rows: DataFrame, group: str, order: list[str], values: list[str], start: Callable[[], object], step: Callable, finish: Callable[[object], tuple], schema: str) -> DataFrame:
    """(group, *finish(state)) for each group: `step(state, *values)` over its rows in order.

    The rows of a group stream through one task in Arrow batches, sorted by
    Spark, which spills; only the state is held, so a group may be of any size.
    Folds whose steps don't join can't be split further; `ranked` and
    `affine_last` split those that do. `schema` has the group first.
    """
    names = [group, *values]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, some, columns = None, None, False, [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            out = []
            for key, *value in zip(*(frame[n] for n in names), strict=True):
                if not some or key != now:
                    if some:
                        out.append((now, *finish(state)))
                    now, state, some = key, start(), True
                state = step(state, *value)
            yield pd.DataFrame(out, columns=columns)
        if some:
            yield pd.DataFrame([(now, *finish(state))], columns=columns)

    ordered = rows.where(F.col(group).isNotNull()).select(group, *dict.fromkeys([*order, *values])).repartition(group).sortWithinPartitions(group, *order)
    return ordered.mapInPandas(run, schema)
