"""Identity keys: owners, conflicts, sequential duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.operators.graph import components
from briarlake.scratch import Scratch


def key_owners(keys: DataFrame, key: str) -> DataFrame:
    """(key, owner): the earliest lead by creation and id; leads without a date come last."""
    first = F.min(F.struct(F.col("created_at").isNull().alias("undated"), "created_at", "id"))
    return keys.groupBy(key).agg(first.alias("_f")).select(key, F.col("_f.id").alias("owner"))


def without_known(leads: DataFrame, keys: DataFrame, known: DataFrame) -> DataFrame:
    """Leads none of whose keys is known."""
    hit = keys.join(known.select(F.col("k").alias("_known")).distinct(), F.col("k") == F.col("_known"), "left_semi").select(F.col("id").alias("_id")).distinct()
    return leads.join(hit, F.col("id") == F.col("_id"), "left_anti")


def sequential_duplicates(leads: DataFrame, keys: DataFrame, known: DataFrame | None = None, rounds: int = 8) -> DataFrame:
    """(id, duplicate) as if walking leads in order of id: a lead is a duplicate if a kept lead before it has one of its keys.

    Decided in parallel: in each round, a lead that is first at all its keys
    among the undecided is kept, and the others at a kept lead's keys are
    duplicates. A round settles whole groups of copies, however large; only
    chains of leads tied by ever other keys need several. What `rounds` leave is
    split into connected components, each walked in order as a stream that holds
    the kept keys only. A lead with a `known` key is a duplicate too; it is never
    kept, so its keys leave first.
    """
    if known is not None:
        new = without_known(leads, keys, known).select("id")
        rest = sequential_duplicates(new, keys.join(new, "id", "left_semi"), None, rounds)
        return leads.select("id").join(rest, "id", "left").select("id", F.coalesce("duplicate", F.lit(True)).alias("duplicate"))
    scratch = Scratch(leads.sparkSession, "duplicates")
    open_, found = scratch.keep(keys.select("id", "k").distinct()), []
    for _ in range(rounds):
        if open_.isEmpty():
            break
        first = open_.groupBy("k").agg(F.min("id").alias("first"))
        kept = scratch.keep(open_.join(first, "k").groupBy("id").agg(F.bool_and(F.col("id") == F.col("first")).alias("kept")).where("kept").select("id"))
        gone = scratch.keep(open_.join(kept, "id", "left_semi").select("k").distinct())
        hit = scratch.keep(open_.join(gone, "k", "left_semi").select("id").distinct())
        found.append(hit.join(kept, "id", "left_anti").select("id"))
        open_ = scratch.keep(open_.join(hit, "id", "left_anti"))
    if not open_.isEmpty():
        first = scratch.keep(open_.groupBy("k").agg(F.min("id").alias("a")))
        roots = components(open_.join(first, "k").select("a", F.col("id").alias("b")), scratch)
        tied = open_.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        tied = tied.groupBy("root", "id").agg(F.collect_set("k").alias("ks")).repartition("root").sortWithinPartitions("root", "id")
        found.append(tied.mapInPandas(_walk, "id long"))
    duplicates = leads.select("id").limit(0)
    for part in found:
        duplicates = duplicates.unionByName(part)
    duplicates = scratch.keep(duplicates.select(F.col("id").alias("_id")))
    return leads.select("id").join(duplicates, F.col("id") == F.col("_id"), "left").select("id", F.col("_id").isNotNull().alias("duplicate"))


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Duplicates among (root, id, ks) sorted by root and id."""
    now, held = None, set()
    for frame in frames:
        out = []
        for root, lead, own in zip(frame["root"], frame["id"], frame["ks"], strict=True):
            if root != now:
                now, held = root, set()
            if held.isdisjoint(own):
                held.update(own)
            else:
                out.append(lead)
        yield pd.DataFrame({"id": out}, dtype="int64")
