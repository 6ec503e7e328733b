"""Ordered, fuzzy, as-of and dominance matching."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.functions import text as T
from briarlake.operators.order import partitions
from briarlake.operators.records import every_pair
from briarlake.scratch import Scratch


def first_match(rows: DataFrame, key: str, probes: str, known: DataFrame, value: str) -> DataFrame:
    """(key, value) by the first probe of each row that is known; null if none is."""
    asked = rows.select(key, F.posexplode(probes).alias("_pos", "_probe"))
    hits = asked.join(known, F.col("_probe") == F.col("k")).groupBy(F.col(key).alias("_key")).agg(F.min_by(value, "_pos").alias(value))
    return rows.select(key).join(hits, F.col(key) == F.col("_key"), "left").drop("_key")


def fuzzy_companies(left: DataFrame, left_name: str, right: DataFrame, right_name: str) -> DataFrame:
    """Pairs of equal normal names, equal compact names of eight letters or more, or a shared distinctive word.

    Equi-joins on these keys instead of comparing all pairs. Both sides are
    written tables, so AQE can split the partition of a word that many share.
    """
    scratch = Scratch(left.sparkSession, "companies")

    def keyed(names: DataFrame, name: str) -> DataFrame:
        norm = T.company_name(F.col(name))
        compact = F.replace(norm, F.lit(" "), F.lit(""))
        keys = F.concat(
            F.array(F.concat(F.lit("n:"), norm)), F.when(F.length(compact) >= 8, F.array(F.concat(F.lit("c:"), compact))).otherwise(F.array().cast("array<string>")),
            F.transform(T.distinctive_words(F.col(name)), lambda w: F.concat(F.lit("w:"), w)),
        )
        return names.where(norm != "").select(name, F.explode(keys).alias("_k"))

    a, b = scratch.keep(keyed(left, left_name)), scratch.keep(keyed(right, right_name).withColumnRenamed("_k", "_j"))
    return a.join(b, F.col("_k") == F.col("_j")).select(left_name, right_name).distinct()


def valid_at(cache: DataFrame, at: str) -> DataFrame:
    """Entries that existed and had not expired at a time."""
    now = F.lit(at).cast("timestamp_ntz")
    return cache.where((F.col("created_at") <= now) & (F.col("expires_at") > now))


def latest(cache: DataFrame, key: str, name: str) -> DataFrame:
    """The newest entry's id per key, by a partial aggregate instead of a window."""
    return cache.groupBy(key).agg(F.max_by("cache_id", F.struct("created_at", "cache_id")).alias(name))


def _front(points: np.ndarray) -> np.ndarray:
    """The points that no other dominates; distinct points in, by falling sum out."""
    points, k = points[np.argsort(-points.sum(axis=1), kind="stable")], 0
    while k < len(points):
        beaten = (points[k] >= points).all(axis=1) & (points[k] > points).any(axis=1)
        k += 1 - int(beaten[:k].sum())
        points = points[~beaten]
    return points


def _undominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The points that none of `by` dominates; those whose corners rule it out are not compared."""
    if not len(points) or not len(by):
        return points
    by = by[(by >= points.min(axis=0)).all(axis=1)]
    beaten = np.zeros(len(points), bool)
    for k in range(0, len(by), 128):
        part = by[k : k + 128]
        some = np.flatnonzero(~beaten & (points <= part.max(axis=0)).all(axis=1))
        own, against = points[some], part[:, None, :]
        beaten[some] = ((against >= own).all(axis=2) & (against > own).any(axis=2)).any(axis=0)
    return points[~beaten]


class _Cells:
    """A complete tree of median cuts of a sample: 2^depth cells of about equal size, whatever the distribution."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dims, self.cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = {0: sample}
        for node in range(len(self.dims)):
            own = parts.pop(node)
            if len(own):
                kinds = np.array([len(np.unique(own[:, d])) for d in range(own.shape[1])])
                turn = np.roll(np.arange(own.shape[1]), -int(np.log2(node + 1)))  # dimensions take turns, but for those of few values
                dim = turn[2 * kinds[turn] >= kinds.max()][0]
                self.dims[node], self.cuts[node] = dim, np.sort(own[:, dim])[(len(own) - 1) // 2]
            right = own[:, self.dims[node]] > self.cuts[node]
            parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dims[node]] > self.cuts[node])
        return node - len(self.dims)


def _points(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy() for n in names], axis=1)


def _made(objectives: list[str], points: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, more.values()), *(pa.array(points[:, d]) for d in range(len(objectives)))], names=[*more, *objectives])


def _front_by_cells(points: DataFrame, objectives: list[str], schema: str, scratch: Scratch, cell: int, most_cells: int, sample: int) -> DataFrame:
    """The front of distinct points, cut into cells; more columns may stand beside the objectives."""
    left = scratch.keep(points)
    n = left.count()
    depth = min(int(math.log2(most_cells)), max(0, math.ceil(math.log2(max(n, 1) / cell))))
    drawn = left.where(F.rand(7) < 2 * sample / max(n, 1)).limit(sample).collect() if depth else []
    cells = _Cells(np.array([list(r) for r in drawn], np.float64).reshape(-1, len(objectives)), depth)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points(batch, objectives)
            yield _made(objectives, points, cell=cells.of(points))

    def by_cell(name: str, finish: Callable[[int, np.ndarray], np.ndarray], filters: bool = False):
        """Over rows sorted by `name`: the points of each cell, or what of them the filters after them leave."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, points = None, [], None
            for batch in batches:
                at, all_points = batch.column(name).to_numpy(), _points(batch, objectives)
                against = batch.column("against").to_numpy() if filters else np.zeros(len(at), np.int64)
                cuts = np.flatnonzero((at[1:] != at[:-1]) | (against[1:] != against[:-1])) + 1
                for s, e in zip(np.r_[0, cuts][: len(at)], np.r_[cuts, len(at)], strict=False):
                    if at[s] != now:
                        if now is not None:
                            out = finish(now, np.concatenate(held) if points is None else points)
                            yield _made(objectives, out, cell=np.full(len(out), now))
                        now, held, points = at[s], [], None
                    if against[s]:
                        points = _undominated(np.concatenate(held) if points is None else points, all_points[s:e])
                    else:
                        held.append(all_points[s:e])
            if now is not None:
                out = finish(now, np.concatenate(held) if points is None else points)
                yield _made(objectives, out, cell=np.full(len(out), now))

        return run

    spread = left.mapInArrow(placed, f"cell long, {schema}").repartition("cell").sortWithinPartitions("cell")
    fronts = scratch.keep(spread.mapInArrow(by_cell("cell", lambda _, points: _front(points)), f"cell long, {schema}"))
    if not depth:
        return fronts
    corners = fronts.groupBy("cell").agg(*[F.min(o).alias(f"low{k}") for k, o in enumerate(objectives)], *[F.max(o).alias(f"high{k}") for k, o in enumerate(objectives)]).orderBy("cell").collect()
    names = np.array([r.cell for r in corners])
    low, high = (np.array([[r[f"{c}{k}"] for k in range(len(objectives))] for r in corners]) for c in ("low", "high"))
    meets: dict[int, list[int]] = {int(c): [] for c in names}
    worst = dict(zip(map(int, names), low, strict=True))
    for k in range(len(names)):
        beaten = ((low >= high[k]).all(axis=1) & (low > high[k]).any(axis=1)).any()
        if not beaten:
            for j in np.flatnonzero((high >= low[k]).all(axis=1)):
                meets[int(names[j])].append(int(names[k]))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, points = batch.column("cell").to_numpy(), _points(batch, objectives)
            for own in np.unique(at):
                mine = points[at == own]
                for to in meets[int(own)]:
                    able = mine if to == own else mine[(mine >= worst[to]).all(axis=1)]
                    if len(able):
                        yield _made(objectives, able, cell=np.full(len(able), to), against=np.full(len(able), int(to != own)))

    dealt = fronts.mapInArrow(sent, f"cell long, against long, {schema}").repartition("cell").sortWithinPartitions("cell", "against")
    return dealt.mapInArrow(by_cell("cell", lambda _, points: points, filters=True), f"cell long, {schema}")


def skyline(rows: DataFrame, key: str, objectives: list[str], cell: int = 1024, most_cells: int = 4096, strong: int = 1024, sample: int = 65536) -> DataFrame:
    """Rows that no other dominates: as good in all objectives and better in one.

    The `strong` distinct vectors of the greatest sums leave few of most tables.
    What they leave is cut into cells of about `cell` vectors, by medians of a
    sample; a cell keeps its own front, in a task of its own. A cell can beat
    another only if its best corner is as good as the other's worst, which holds
    for few neighbours along a front, and one whose worst corner beats the other's
    best drops it whole. Each cell then meets the fronts of those neighbours as a
    stream. So a front of any size is spread over its cells and no task compares
    all pairs; the driver sees `strong` vectors, the sample, and the corners of
    `most_cells` cells.

    Rows with a null objective are not compared and left out; NaN is neither
    better nor worse than anything.
    """
    scratch, schema = Scratch(rows.sparkSession, "front"), ", ".join(f"{o} double" for o in objectives)
    asked = scratch.keep(rows.select(*[F.col(o).cast("double").alias(o) for o in objectives]).where(" AND ".join(f"{o} IS NOT NULL" for o in objectives)).distinct())
    odd = " OR ".join(f"isnan({o})" for o in objectives)
    total = sum((F.col(o) for o in objectives[1:]), F.col(objectives[0]))
    matrix = lambda found: np.array([list(r) for r in found], np.float64).reshape(-1, len(objectives))
    top = matrix(asked.where(f"NOT ({odd})").orderBy(total.desc()).limit(strong + 1).collect())
    best = _front(top[:strong])

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _made(objectives, _undominated(_points(batch, objectives), best))

    if len(top) <= strong:  # these are all
        front = rows.sparkSession.createDataFrame(best.tolist(), schema)
    else:
        front = _front_by_cells(asked.where(f"NOT ({odd})").mapInArrow(strongest, schema), objectives, schema, scratch, cell, most_cells, sample)
    same = F.lit(True)
    for o in objectives:
        same = same & (F.col(o) == F.col(f"_{o}"))
    found = front.select(*objectives).unionByName(asked.where(odd))
    front = scratch.keep(found.select(*[F.col(o).alias(f"_{o}") for o in objectives]))
    return rows.join(front, same, "left_semi")


def assessed(judgments: DataFrame, requirements: DataFrame) -> DataFrame:
    """(candidate_id, requirement_id, status) for every candidate and requirement; what is missing or odd is unknown."""
    first = judgments.groupBy(F.col("candidate_id").alias("_c"), F.col("requirement_id").alias("_r")).agg(F.min(F.struct("line_no", "status")).alias("_s")).select("_c", "_r", F.col("_s.status").alias("status"))
    asked = every_pair(judgments.select("candidate_id").distinct(), "candidate_id", requirements, partitions(judgments.sparkSession))
    joined = asked.join(first, (F.col("candidate_id") == F.col("_c")) & (F.col("requirement_id") == F.col("_r")), "left")
    return joined.select("candidate_id", "requirement_id", F.when(F.col("status").isin("pass", "fail"), F.col("status")).otherwise("unknown").alias("status"))
