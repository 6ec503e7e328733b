"""Hard-negative mining: exact top scores through k-means inverted lists with stored radii.

Vectors become whole numbers; a score is their inner product. Centroids are
fitted on a bounded sample, then every vector joins the list of its nearest
centroid, and each list stores its radius, the largest distance of a member from
the centroid c. By Cauchy-Schwarz no member x of a list scores outside
<a, c> +- |a| radius for an anchor a.

An anchor visits lists by falling upper bound. It skips a list whose bounds lie
outside the window that is asked for, and stops when the bound is strictly below
its k-th score (a bound equal to it may hide a tie of a smaller id). Spark visits
in rounds: 4 lists, then 32, 256 and so on; after each round the k-th scores are
known and only anchors with lists left go on. The index decides what is read, not
what is found: results are exact, recall is 1.

Lists of any size are cut into blocks, and many anchors at one list into chunks;
each block and chunk meet in a group of their own, of which the block is held
and the chunk streams. A group hands on its best k per anchor and window; ranks
cut these again before the shuffle.

Defined results: rows whose label or vector is null or holds null or non-finite
parts take no part. Shorter vectors end in zeros. A null id is no anchor but may
be found; it comes last among ties. Rows of equal id are rows of their own:
an anchor's other rows are all rows but itself, and ties of equal id and score
fall to the smaller vector position in the index. Scores beyond 64 bits stop at
their bounds. An anchor without others of its label, or without rows in a window,
has no result. An empty table has no rows. Columns beside the three are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briarlake.llm.text import small_batches
from briarlake.llm.vectors import longs, matrix, numbers, whole
from briarlake.scratch import Scratch

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Lists:
    """At most `sample` vectors fit at most `most` centroids, one for `rows` vectors; `block` rows and `chunk` anchors meet in a group."""

    rows: int = 1024
    most: int = 1024
    sample: int = 16384
    iterations: int = 8
    block: int = 4096
    chunk: int = 4096
    visits: int = 4
    growth: int = 8
    seed: int = 11


@dataclass(frozen=True)
class Mining:
    """For each of `positives` best rows of the label, `negatives` rows of other labels scoring `low` to `high` percent of it."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def _fitted(x: np.ndarray, k: int, how: Lists) -> np.ndarray:
    """Centroids of a sample, by Lloyd's rounds from distinct rows."""
    draw = np.random.default_rng(how.seed)
    x = x.astype(np.float64)
    centroids = np.unique(x, axis=0)
    centroids = centroids[draw.permutation(len(centroids))[:k]]
    for _ in range(how.iterations):
        near = _nearest(x, centroids)[0]
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.empty(len(x), np.int64)
    for k in range(0, len(x), 1024):
        near[k : k + 1024] = ((centroids * centroids).sum(axis=1)[None, :] - 2 * (x[k : k + 1024] @ centroids.T)).argmin(axis=1)
    return near, np.sqrt(((x - centroids[near]) ** 2).sum(axis=1))


def _listed(centroids: np.ndarray):
    """(vec_id, label, anchor, whole) to (vec_id, label, anchor, vector, list, away)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(3), centroids.shape[1])
            near, away = _nearest(x.astype(np.float64), centroids)
            vectors = pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], vectors, pa.array(near.astype(np.int32)), pa.array(away)], names=["vec_id", "label", "anchor", "vector", "list", "away"])

    return run


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), width).astype(np.int64)


def _next_visits(centroids: np.ndarray, radii: np.ndarray, step: int):
    """(row, label, vector, seen, slots) to one row per list that the anchor visits now, with `next`: where it goes on, null if it is done.

    A slot is (slot, low, high, kth); kth is null while fewer than k are found.
    The lists are in order of upper bound; `seen` of them are behind the anchor.
    An anchor with no list left gives one row of list null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column("vector"), centroids.shape[1]).astype(np.float64)
            seen, slots = batch.column("seen").to_pylist(), batch.column("slots").to_pylist()
            middle, reach = x @ centroids.T, np.sqrt((x * x).sum(axis=1))[:, None] * radii[None, :]
            give = 1e-9 * (np.abs(middle) + reach) + 1e-3
            upper, lower = middle + reach + give, middle - reach - give
            take, lists, goes_on = [], [], []
            for k in range(len(x)):
                order = np.argsort(-upper[k], kind="stable")
                need = np.zeros(len(order), bool)
                for s in slots[k]:
                    least = max(s["low"], _LOW if s["kth"] is None else s["kth"])
                    need |= (upper[k][order] >= least) & (lower[k][order] <= s["high"])
                need[: seen[k]] = False
                places = np.flatnonzero(need)
                now = places[:step]
                take += [k] * max(1, len(now))
                lists += order[now].tolist() or [None]
                goes_on += [int(now[-1]) + 1 if len(places) > step else None] * max(1, len(now))
            out = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*(out.column(n) for n in ("row", "label", "vector", "slots")), pa.array(lists, pa.int32()), pa.array(goes_on, pa.int32())], names=["row", "label", "vector", "slots", "list", "next"])

    return run


def _met(k: int, same: bool, width: int):
    """Over groups sorted with a block's rows before its anchors: the best k of the block for each anchor and slot.

    In (list, block, chunk, kind, row, vec_id, label, vector, slots); out (anchor, slot, row, vec_id, score).
    """
    names = ["list", "block", "chunk"]

    def best(rows: dict[str, list], anchors: pa.RecordBatch, out: list[pa.RecordBatch]) -> None:
        held, labels, order = rows["matrix"], rows["labels"], rows["order"]
        a, b = numbers(_rows(anchors.column("vector"), width), held)
        found = {n: [] for n in ("anchor", "slot", "row", "score", "at")}
        own, asked = anchors.column("row").to_pylist(), anchors.column("slots").to_pylist()
        mine = [rows["codes"].get(x, -1) for x in anchors.column("label").to_pylist()]
        for start in range(0, len(a), 256):
            scores = longs(a[start : start + 256] @ b.T)
            for i, line in enumerate(scores, start):
                fits = (labels == mine[i]) & (rows["row"] != own[i]) if same else labels != mine[i]
                for s in asked[i]:
                    at = np.flatnonzero(fits & (line >= s["low"]) & (line <= s["high"]) & (line >= (_LOW if s["kth"] is None else s["kth"])))
                    if len(at) > k:
                        least = np.partition(line[at], len(at) - k)[len(at) - k]
                        at = at[line[at] >= least]
                    at = at[np.lexsort((order[at], -line[at].astype(object) if line.min() == _LOW else -line[at]))][:k]
                    found["anchor"] += [own[i]] * len(at)
                    found["slot"] += [s["slot"]] * len(at)
                    found["row"] += rows["row"][at].tolist()
                    found["score"] += line[at].tolist()
                    found["at"] += at.tolist()
        if found["at"]:
            ids = rows["vec_id"].take(pa.array(found["at"]))
            out.append(pa.RecordBatch.from_arrays([pa.array(found["anchor"]), pa.array(found["slot"], pa.int32()), pa.array(found["row"]), ids, pa.array(found["score"])], names=["anchor", "slot", "row", "vec_id", "score"]))

    def ready(parts: list[pa.RecordBatch]) -> dict[str, list]:
        whole_block = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        names_of = whole_block.column("label").to_pylist()
        codes = {x: n for n, x in enumerate(dict.fromkeys(names_of))}
        ids, row = whole_block.column("vec_id"), whole_block.column("row").to_numpy()
        order = np.empty(len(row), np.int64)
        order[pa.compute.sort_indices(pa.table({"i": ids, "r": row}), [("i", "ascending"), ("r", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(row))
        return {"matrix": _rows(whole_block.column("vector"), width), "labels": np.array([codes[x] for x in names_of]), "codes": codes, "vec_id": ids, "row": row, "order": order}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            kind = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(key)], strict=True):
                if tuple(key[s]) != now:
                    now, parts, block = tuple(key[s]), [], None
                piece, out = batch.slice(s, e - s), []
                if kind[s] == 0:
                    parts.append(piece)
                elif parts:
                    block = block or ready(parts)
                    best(block, piece, out)
                    yield from out

    return run


class Index:
    """Inverted lists over all rows: the listed rows, and per list centroid, radius and size (`lists`, a written table)."""

    def __init__(self, rows: DataFrame, scratch: Scratch, how: Lists):
        """`rows` has vec_id, label, anchor and whole."""
        self.scratch, self.how, spark = scratch, how, rows.sparkSession
        n, width = rows.agg(F.count("*"), F.max(F.size("whole"))).first()
        self.width = max(1, width or 0)
        drawn = rows.where(F.rand(how.seed) < how.sample / max(n, 1)).select("whole").limit(2 * how.sample).collect() if n else []
        sample = matrix(pa.array([r.whole for r in drawn], pa.list_(pa.int32())), self.width)
        count = min(how.most, max(1, math.ceil(n / how.rows)))
        self.centroids = _fitted(sample, count, how) if len(sample) else np.zeros((1, self.width))
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        listed = rows.mapInArrow(_listed(self.centroids), f"vec_id {kinds['vec_id']}, label {kinds['label']}, anchor boolean, vector binary, list int, away double")
        self.rows = scratch.keep(listed.withColumn("row", F.monotonically_increasing_id()))
        radii = self.rows.groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        centers = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(self.centroids)], "list int, centroid array<double>")
        self.lists = scratch.keep(centers.join(radii, "list", "left").na.fill({"radius": 0.0, "n": 0}))
        self.radii, self.sizes = np.zeros(len(self.centroids)), np.zeros(len(self.centroids), np.int64)
        for r in self.lists.select("list", "radius", "n").collect():  # `most` rows
            self.radii[r.list], self.sizes[r.list] = r.radius * (1 + 1e-9), r.n

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, slot, row, vec_id, score, rank): for each slot of each anchor the best k rows in its window, of the anchor's label or of others.

        `anchors` has row, label, vector and slots, an array of (slot, low, high).
        """
        how, scratch = self.how, self.scratch
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        slots = "array<struct<slot:int,low:bigint,high:bigint,kth:bigint>>"
        shape = f"row long, label {kinds['label']}, vector binary, slots {slots}"
        known = lambda s: F.struct(s["slot"].alias("slot"), s["low"].alias("low"), s["high"].alias("high"), F.lit(None).cast("long").alias("kth"))
        state = anchors.select("row", "label", "vector", F.transform("slots", known).alias("slots"), F.lit(0).alias("seen"))
        best, step = None, how.visits
        order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
        while True:
            asked = scratch.keep(state.mapInArrow(_next_visits(self.centroids, self.radii, step), f"{shape}, list int, next int"))
            found = scratch.keep(self._visited(asked.where("list IS NOT NULL"), k, same, kinds))
            merged = found if best is None else best.drop("rank").unionByName(found)
            ranked = scratch.keep(merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            if best is not None:
                scratch.drop(best)
            scratch.drop(found)
            best = ranked
            left = asked.where("next IS NOT NULL").dropDuplicates(["row"])
            if left.isEmpty():
                scratch.drop(asked)
                return best
            kth = best.where(F.col("rank") == k).groupBy(F.col("anchor").alias("_anchor")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("_kth"))
            joined = left.join(kth, F.col("row") == F.col("_anchor"), "left")
            tighter = lambda s: F.struct(s["slot"].alias("slot"), s["low"].alias("low"), s["high"].alias("high"), F.try_element_at("_kth", s["slot"]).alias("kth"))
            state = scratch.keep(joined.select("row", "label", "vector", F.transform("slots", tighter).alias("slots"), F.col("next").alias("seen")))
            scratch.drop(asked)
            step *= how.growth

    def _visited(self, asked: DataFrame, k: int, same: bool, kinds: dict[str, str]) -> DataFrame:
        how = self.how
        counts = {r.list: r.n for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # `most` rows
        cuts = [(x, max(1, -(-int(self.sizes[x]) // how.block)), -(-n // how.chunk)) for x, n in counts.items()]
        cut = F.broadcast(asked.sparkSession.createDataFrame(cuts, "_list int, _blocks int, _chunks int"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        place = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
        none = F.lit(None)
        rows = self.rows.join(cut, F.col("list") == F.col("_list")).select("list", place("_blocks").alias("block"), spread("_chunks").alias("chunk"), F.lit(0).alias("kind"), "row", "vec_id", "label", "vector", none.cast(asked.schema["slots"].dataType).alias("slots"))
        from_anchor = asked.join(cut, F.col("list") == F.col("_list")).select("list", spread("_blocks").alias("block"), place("_chunks").alias("chunk"), F.lit(1).alias("kind"), "row", none.cast(kinds["vec_id"]).alias("vec_id"), "label", "vector", "slots")
        keys = ["list", "block", "chunk"]
        dealt = rows.unionByName(from_anchor).repartition(*keys).sortWithinPartitions(*keys, "kind")
        return dealt.mapInArrow(_met(k, same, self.width), f"anchor long, slot int, row long, vec_id {kinds['vec_id']}, score long")


def hard_negatives(embeddings: DataFrame, scratch: Scratch, anchor: Column, how: Mining = Mining(), lists: Lists = Lists(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor`, an expression over vec_id and label, holds."""
    small_batches(embeddings.sparkSession)
    rows = whole(embeddings, vec_id, vector, label, scale).where("label IS NOT NULL")
    index = Index(rows.select("vec_id", "label", F.coalesce(anchor, F.lit(False)).alias("anchor"), "whole"), scratch, lists)
    anchors = index.rows.where("anchor").select("row", "label", "vector", F.col("vec_id").alias("anchor_id"))
    whole_range = F.array(F.struct(F.lit(0).alias("slot"), F.lit(_LOW).cast("long").alias("low"), F.lit(_HIGH).cast("long").alias("high")))
    positives = index.search(anchors.select("row", "label", "vector", whole_range.alias("slots")), how.positives, same=True)
    # Whole scores n with low * p <= 100 n <= high * p; a decimal holds the product.
    score = F.col("score").cast("decimal(20,0)")
    window = F.struct(F.col("rank").cast("int").alias("slot"), F.ceil(score * how.low / 100).cast("long").alias("low"), F.floor(score * how.high / 100).cast("long").alias("high"))
    windows = positives.select(F.col("anchor").alias("_anchor"), window.alias("w")).where("w.low <= w.high").groupBy("_anchor").agg(F.collect_list("w").alias("slots"))
    asking = scratch.keep(anchors.join(windows, F.col("row") == F.col("_anchor")).select("row", "label", "vector", "slots"))
    negatives = index.search(asking, how.negatives, same=False)
    named_positives = positives.select(F.col("anchor").alias("_a"), F.col("rank").cast("int").alias("_slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.join(named_positives, (F.col("anchor") == F.col("_a")) & (F.col("slot") == F.col("_slot")))
    ids = anchors.select(F.col("row").alias("_row"), "anchor_id")
    return found.join(ids, F.col("anchor") == F.col("_row")).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, e.vec_id AS vec_id, a.label = e.label AS same, CAST(list_inner_product(a.x, e.x) AS BIGINT) AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
 n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
 SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
