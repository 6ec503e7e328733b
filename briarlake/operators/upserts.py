"""Bulk upserts with identity guard and revisions, exact as a walk row by row, decided in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.operators.graph import components
from briarlake.scratch import Scratch

_ROW = ["seq", "id", "revision", "identity"]


class RolledBack(Exception):
    """A row of an all-or-nothing batch was stale or asked for a lead that is not stored."""


def bulk_upsert(stored: DataFrame, incoming: DataFrame, scratch: Scratch, require_existing: bool = False, atomic: bool = False, rounds: int = 12, few: int = 16384) -> tuple[DataFrame, DataFrame]:
    """(seq, id, disposition, holder) of every incoming row, and (id, revision, identity, seq) of every lead after the batch.

    Rows have id, revision and identity; incoming ones `seq`, by which they are
    taken one after the other. A row whose lead must exist but doesn't is
    `missing`; one whose identity another lead holds is a `duplicate`, and
    `holder` names that lead; one whose revision is not its lead's is a
    `conflict` (a null revision asks for none); the rest are `created` or
    `updated`, raise the revision, claim their identity and release the one that
    their lead held. Only written rows do so. `seq` of a lead is the row that was
    written last, null if none was; its other columns are the caller's to join. Of
    stored leads of one identity the smallest id holds it. With `atomic`, a
    conflict or missing row raises RolledBack.

    In parallel: what a row meets is known once no earlier open row has its id,
    claims its identity, or belongs to the lead that holds it. So the first open
    row of an id and of an identity is decided; and whole groups at once are the
    rows whose identity is held by a lead without open rows before them
    (duplicates), rows older than their lead (never written, so they hold up
    nobody), and runs of updates that ask for no revision and keep the identity.
    Once no more than `few` rows are left, one task walks them. What `rounds` leave
    beyond that, chains tied by ever other ids and identities, is split into
    connected components, each walked as a sorted stream.
    """
    kinds = {c: incoming.schema[c].dataType.simpleString() for c in _ROW}
    open_ = scratch.keep(incoming.select(*_ROW))
    first = stored.where("identity IS NOT NULL").groupBy(F.col("identity").alias("_i")).agg(F.min("id").alias("_holder"))
    leads = stored.select("id", "revision", "identity").join(_shuffled(first), F.col("identity") == F.col("_i"), "left")
    held = F.when(F.col("_holder") == F.col("id"), F.col("identity"))
    leads = scratch.keep(leads.select("id", "revision", held.alias("identity"), F.lit(None).cast(kinds["seq"]).alias("seq")))
    done: list[DataFrame] = []
    n = open_.count()
    for _ in range(rounds):
        if n <= few:
            break
        found = scratch.keep(_decided(open_, leads, scratch, require_existing))
        done.append(found)
        leads = scratch.keep(_after(leads, found))
        open_ = scratch.keep(open_.join(_shuffled(found.select(F.col("seq").alias("_seq"))), F.col("seq") == F.col("_seq"), "left_anti"))
        n = open_.count()
    if n:
        found = scratch.keep(_walked(open_, leads, scratch, require_existing, kinds, n > few))
        done.append(found)
        leads = scratch.keep(_after(leads, found))
    result = done[0] if done else _decided(open_, leads, scratch, require_existing)
    for part in done[1:]:
        result = result.unionByName(part)
    if atomic and not result.where("disposition IN ('conflict', 'missing')").isEmpty():
        raise RolledBack("the batch holds a stale row or one of a lead that is not stored")
    return result.drop("identity"), leads


def _shuffled(side: DataFrame) -> DataFrame:
    """The side of a join that is not broadcast, however small its files are: each broadcast passes through the driver, and every round has several."""
    return side.hint("merge")


def _decided(open_: DataFrame, leads: DataFrame, scratch: Scratch, require_existing: bool) -> DataFrame:
    """(seq, id, identity, disposition, holder) of the rows that can be decided now."""
    now = leads.select(F.col("id").alias("_id"), F.col("revision").alias("_revision"), F.col("identity").alias("_own"))
    holders = leads.where("identity IS NOT NULL").select(F.col("identity").alias("_claimed"), F.col("id").alias("_holder"))
    rows = open_.join(_shuffled(now), F.col("id") == F.col("_id"), "left")
    rows = rows.join(_shuffled(holders), F.col("identity") == F.col("_claimed"), "left").drop("_claimed")
    exists = F.col("_id").isNotNull()
    rows = rows.withColumn("_old", F.coalesce(exists & (F.col("revision") < F.col("_revision")), F.lit(False)) | (~exists if require_existing else F.lit(False)))
    rows = scratch.keep(rows.withColumn("_stays", exists & F.col("revision").isNull() & F.col("identity").eqNullSafe(F.col("_own"))))
    live = rows.where("NOT _old")
    by_id = scratch.keep(live.groupBy(F.col("id").alias("_row_id")).agg(F.min("seq").alias("_first"), F.min(F.when(~F.col("_stays"), F.col("seq"))).alias("_run_end")))
    claims = live.where("identity IS NOT NULL").groupBy(F.col("identity").alias("_name")).agg(F.min("seq").alias("_claim"))
    of_holder = by_id.select(F.col("_row_id").alias("_by"), F.col("_first").alias("_moves"))
    rows = rows.join(_shuffled(by_id), F.col("id") == F.col("_row_id"), "left").join(_shuffled(claims), F.col("identity") == F.col("_name"), "left").join(_shuffled(of_holder), F.col("_holder") == F.col("_by"), "left")
    before = lambda c: F.col(c).isNull() | (F.col("seq") < F.col(c))
    others = F.coalesce(F.col("_holder") != F.col("id"), F.lit(False))
    known = F.col("identity").isNull() | F.when(F.col("_holder").isNotNull(), before("_moves")).otherwise(before("_claim"))  # what holds the identity at this row
    turn = (F.col("seq") == F.col("_first")) & (F.col("identity").isNull() | (F.col("_holder") == F.col("id")) | F.col("_holder").isNull() & (F.col("seq") == F.col("_claim")))
    fits = ~exists | F.col("revision").isNull() | (F.col("revision") == F.col("_revision"))
    written = F.when(exists, "updated").otherwise("created")
    kind = F.when(F.lit(require_existing) & ~exists, "missing").when(known & others, "duplicate").when(F.col("_old") & known, "conflict")
    kind = kind.when(~F.col("_old") & F.col("_stays") & before("_run_end"), "updated").when(~F.col("_old") & turn, F.when(fits, written).otherwise("conflict"))
    holder = F.when(F.col("disposition") == "duplicate", F.col("_holder"))
    found = rows.withColumn("disposition", kind).where("disposition IS NOT NULL")
    return found.select("seq", "id", "identity", "disposition", holder.alias("holder"))


def _after(leads: DataFrame, found: DataFrame) -> DataFrame:
    """The leads after the written rows, of which those of one lead are one run or a single row."""
    new = found.where("disposition IN ('created', 'updated')").groupBy(F.col("id").alias("_new")).agg(F.count("*").alias("_n"), F.max("seq").alias("_seq"), F.max_by(F.struct("identity"), "seq").alias("_last"))
    wrote = F.col("_new").isNotNull()
    joined = leads.join(_shuffled(new), F.col("id") == F.col("_new"), "full_outer")
    pick = lambda a, b: F.when(wrote, a).otherwise(F.col(b)).alias(b)
    revision = F.coalesce("revision", F.lit(0)) + F.col("_n")
    return joined.select(F.coalesce("id", "_new").alias("id"), pick(revision.cast(leads.schema["revision"].dataType), "revision"), pick(F.col("_last.identity"), "identity"), pick(F.col("_seq"), "seq"))


def _walked(open_: DataFrame, leads: DataFrame, scratch: Scratch, require_existing: bool, kinds: dict[str, str], many: bool) -> DataFrame:
    """As `_decided`, of all rows, walked in order: components of ids and identities apart if there are `many`; only the state of their leads is held.

    Ids and identities are nodes by hash: two that collide share a walk, which
    changes nothing.
    """
    row, lead = F.xxhash64(F.lit("id"), F.col("id")), F.xxhash64(F.lit("identity"), F.col("identity"))
    met = leads.join(_shuffled(open_.select(F.col("id").alias("_o")).distinct()), F.col("id") == F.col("_o"), "left_semi")
    met = met.unionByName(leads.join(_shuffled(open_.select(F.col("identity").alias("_o")).distinct()), F.col("identity") == F.col("_o"), "left_semi")).distinct()
    known = met.select(F.lit(None).cast(kinds["seq"]).alias("seq"), "id", "revision", "identity")
    rows = known.unionByName(open_).withColumn("node", row).withColumn("other", F.coalesce(lead, row))
    if not many:
        return _walk(rows.withColumn("root", F.lit(0).cast("long")), require_existing, kinds)
    rows = scratch.keep(rows)
    roots = scratch.keep(components(rows.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch).withColumnRenamed("node", "_node").distinct())
    return _walk(rows.join(_shuffled(roots), F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")), require_existing, kinds)


def _walk(tied: DataFrame, require_existing: bool, kinds: dict[str, str]) -> DataFrame:
    """Rows with a root, those of a root in order of seq; rows without seq are the leads as they stand."""
    ordered = tied.select("root", *_ROW).repartition("root").sortWithinPartitions("root", F.col("seq").asc_nulls_first())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, holder = None, {}, {}
        for frame in frames:
            out = []
            for root, seq, lead_id, revision, identity in zip(*(frame[c].array for c in ("root", *_ROW)), strict=True):
                if root != now:
                    now, state, holder = root, {}, {}
                revision, identity = None if pd.isna(revision) else int(revision), None if pd.isna(identity) else identity
                at, own = state.get(lead_id, (None, None))
                if pd.isna(seq):
                    state[lead_id] = (revision, identity)
                    if identity is not None:
                        holder[identity] = lead_id
                    continue
                by, kind = holder.get(identity) if identity is not None else None, None
                if at is None and require_existing:
                    kind = "missing"
                elif by is not None and by != lead_id:
                    kind = "duplicate"
                elif at is not None and revision is not None and revision != at:
                    kind = "conflict"
                out.append((seq, lead_id, identity, kind or ("created" if at is None else "updated"), by if kind == "duplicate" else None))
                if kind is None:
                    state[lead_id] = ((at or 0) + 1, identity)
                    if own is not None:
                        holder.pop(own, None)
                    if identity is not None:
                        holder[identity] = lead_id
            yield pd.DataFrame(out, columns=["seq", "id", "identity", "disposition", "holder"]).astype({"holder": object})

    return ordered.mapInPandas(run, f"seq {kinds['seq']}, id {kinds['id']}, identity {kinds['identity']}, disposition string, holder {kinds['id']}")


def written_leads(stored: DataFrame, incoming: DataFrame, leads: DataFrame, values: list[str]) -> DataFrame:
    """(id, revision, identity, values) of the leads after a batch: a lead's values are those of the row that was written last, else its stored ones."""
    new = incoming.select(F.col("seq").alias("_seq"), *[F.col(v).alias(f"_new_{v}") for v in values])
    old = stored.select(F.col("id").alias("_id"), F.col("identity").alias("_said"), *values)
    joined = leads.join(_shuffled(old), F.col("id") == F.col("_id"), "left").join(_shuffled(new), F.col("seq") == F.col("_seq"), "left")
    wrote = F.col("_seq").isNotNull()
    identity = F.when(wrote, F.col("identity")).otherwise(F.col("_said"))
    return joined.select("id", "revision", identity.alias("identity"), *[F.when(wrote, F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in values])
