"""Chat formatting with cumulative-snapshot collapse.

Systems that log a conversation after every turn leave snapshots of which each
is the beginning of a longer one. A rolling hash over the turns names every
prefix of every conversation; conversations whose whole hash is a proper prefix
of another are removed by an anti-join, equal ones collapse to the smallest id,
and what remains is rendered.

Defined results: turns stand in order of (turn, role, text), nulls first; rows
that repeat all four columns count once; a null role or text is rendered as
empty but differs from an empty one; rows of null conv_id belong to no
conversation and are left out; conv_id may be of any type that can be ordered;
other columns are left out, whatever their names; texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.llm.text import small_batches
from briarlake.scratch import Scratch

def _coded(value: str | None) -> bytes:
    return b"-" if value is None else b"%d:%s" % (len(data := value.encode()), data)


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn, role, text) sorted, to (conv_id, place, prefix, last): one row per distinct turn.

    One turn is held back to know whether it is the last; nothing is gathered.
    """
    kind = pa.int64()
    now = before = held = None
    digest, place = hashlib.blake2b(digest_size=16), 0
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["conv_id", "place", "prefix", "last"])

    for rows in batches:
        kind = rows.column(0).type
        for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if row == before:
                continue
            before = row
            if held is not None:
                out.append((*held, row[0] != now))
            if row[0] != now:
                now, place, digest = row[0], 0, hashlib.blake2b(digest_size=16)
            digest.update(_coded(row[2]) + _coded(row[3]))
            place += 1
            held = (now, place, digest.digest())
        yield batch()
    if held is not None:
        out.append((*held, True))
        yield batch()


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, prefix, last): the rolling hash after each turn of each conversation."""
    small_batches(turns.sparkSession, 2000)
    ordered = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_rolled, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, place long, prefix binary, last boolean")


def maximal(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, n_turns, n_same): the conversations that no longer one begins with; of equal ones the smallest id.

    Prefixes are made distinct before they meet the conversations, and equal
    conversations are collapsed first: both sides then have each hash once, so
    a very common first turn or conversation is no hot key.
    """
    rolled = scratch.keep(prefixes(turns))
    whole = rolled.where("last").groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.max("place").alias("n_turns"), F.count("*").alias("n_same"))
    proper = rolled.where("NOT last").select(F.col("prefix").alias("_prefix")).distinct()
    return whole.join(proper, F.col("prefix") == F.col("_prefix"), "left_anti").select("conv_id", "n_turns", "n_same")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same, rendered): one text per kept conversation.

    A conversation is one row of the result, so its turns are gathered; no
    other group is.
    """
    begin, middle, end = F.lit("<|im_start|>"), F.lit("\n"), F.lit("<|im_end|>\n")
    chosen = kept.withColumnRenamed("conv_id", "_conv")
    own = turns.join(chosen, F.col("conv_id") == F.col("_conv"), "left_semi")
    shown = own.groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("_turns"))
    text = F.array_join(F.transform("_turns", lambda t: F.concat(begin, F.coalesce(t["role"], F.lit("")), middle, F.coalesce(t["text"], F.lit("")), end)), "")
    return shown.join(chosen, F.col("conv_id") == F.col("_conv")).select("conv_id", "n_turns", "n_same", text.alias("rendered"))


def format_chats(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The rendered maximal conversations of (conv_id, turn, role, text)."""
    own = turns.select("conv_id", "turn", "role", "text")
    return render(own, scratch.keep(maximal(own, scratch)))


#: The same in DuckDB.
SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), coded AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-'), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS prefix
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), whole AS (
  SELECT min(conv_id) AS conv_id, md5(prefix) AS h, max(n) AS n_turns, count(*) AS n_same FROM coded WHERE place = n GROUP BY md5(prefix)
), kept AS (
  SELECT * FROM whole WHERE h NOT IN (SELECT md5(prefix) FROM coded WHERE place < n)
)
SELECT conv_id, n_turns, n_same,
       (SELECT string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) FROM coded c WHERE c.conv_id = kept.conv_id) AS rendered
FROM kept
"""
