"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sources get targets by weight; the expected copies of a document are its
source's target over its source's size. Within a source, documents stand in
order of size and id; their expected copies are summed from the front, one
random offset per source is added, and a document is taken once for each integer
that its part of the sum crosses. In this order a source's taken words miss its
target by less than its largest document. Before a document stand `rank` equal
expectations, so the prefix sum is rank times the source's expectation: nothing
is lost to the rounding of a running sum.

Defined results: a null text has size 0; a null source is a source of its own,
the last; a null doc_id stands first among equal sizes; repeated rows are
separate documents, in any order among equal sizes and ids; in a source without
words nothing is taken; a null size counts as 0; columns of `docs` named like an
added one are replaced, all others pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briarlake.llm.text import named
from briarlake.operators.order import ranked
from briarlake.scratch import Scratch


@dataclass(frozen=True)
class Mix:
    """Sources by code point, null last, weigh `weights` in turn; they share `share` of all sizes, each `cap` times its own at most."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: float = 2.0
    seed: int = 7


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) drawn from seed and source, the same in every run."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000null"))).cast("binary"))
    return F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, mix: Mix, scratch: Scratch) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    A target is min(cap * source_size, level * weight). In order of cap over
    weight, the sources before the level are at their caps; the level is what
    they leave, over the weights of the rest, at the first source that this does
    not lift above its cap. The sums come from a distributed prefix sum.
    """
    weights = F.array(*[F.lit(w) for w in mix.weights])
    placed = ranked(sizes, [], [F.col("source").asc_nulls_last()], scratch, "turn")
    placed = placed.withColumn("weight", F.element_at(weights, (F.col("turn") % len(mix.weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(mix.cap))
    placed = ranked(placed.withColumn("ratio", F.col("cap") / F.col("weight")), [], [F.col("ratio"), F.col("turn")], scratch, "place", ("cap", "weight"))
    placed = scratch.keep(placed)
    total, weight = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(mix.share * (total or 0))) - F.col("cap_before")) / (F.lit(weight or 0) - F.col("weight_before"))
    found = placed.where(level <= F.col("ratio")).agg(F.min_by(level, "place")).first()[0]
    aim = F.col("cap") if found is None else F.least("cap", F.lit(found) * F.col("weight"))
    return placed.select("source", "source_size", aim.alias("target"))


def mix_documents(docs: DataFrame, scratch: Scratch, mix: Mix = Mix(), size: str = "size", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Add source_size, target and copies to every row of `docs`, which has a long column `size`.

    The rank comes from a range partitioning by source, size and id, so a hot
    source spreads over many partitions; sources are partially aggregated.
    """
    added = ("source_size", "target", "copies")
    row = F.struct(*[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")
    words = F.coalesce(named(size).cast("long"), F.lit(0))
    packed = docs.select(row, named(source).alias("source"), words.alias("size"), named(doc_id).alias("doc_id"))
    placed = ranked(packed, ["source"], [F.col("size"), F.col("doc_id").asc_nulls_first()], scratch)
    sizes = docs.select(named(source).alias("source"), words.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = scratch.keep(targets(scratch.keep(sizes), mix, scratch).withColumnRenamed("source", "aimed"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset(F.col("source"), mix.seed)
    upto = lambda n: F.floor(n * expected + start)
    copies = F.least(upto(F.col("rank") + 1) - upto(F.col("rank")), F.ceil(F.lit(mix.cap))).cast("long")
    own = [F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() not in added]
    return placed.join(aims, F.col("source").eqNullSafe(F.col("aimed"))).select(*own, "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as it is taken."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


#: The same in DuckDB for Mix(); `documents` has doc_id, text and source.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM sources
), sorted AS (
  SELECT cap / w AS ratio, coalesce(sum(cap) OVER before, 0) AS held, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS free, row_number() OVER (ORDER BY cap / w, source) AS k
  FROM weighed WINDOW before AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT k, ratio, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - held) / free AS level FROM sorted
), chosen AS (
  SELECT level FROM levels WHERE level <= ratio ORDER BY k LIMIT 1
), aims AS (
  SELECT source, source_size, least(cap, (SELECT level FROM chosen) * w) AS target,
         ('0x' || substr(md5('7:' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM weighed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS r FROM sized
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, floor((r + 1) * e + u) - floor(r * e + u)) AS BIGINT) AS taken
FROM (SELECT p.doc_id, p.size, p.r, a.source_size, a.target, a.u, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS e
      FROM placed p JOIN aims a ON p.source IS NOT DISTINCT FROM a.source)
"""
