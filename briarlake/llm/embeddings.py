"""Embedding near-duplicates: random-hyperplane tables, exact cosine check, connected components.

Equal vectors of a label are one class. Each class is hashed by the signs of
random projections in several tables; classes that meet in a bucket are compared
by cosine in double precision. A pair is counted in the first table in which it
meets, so links can be counted without writing pairs.

Signs and tables follow from the data: as many signs as leave about `bucket`
classes of the largest label in a bucket (4 to 20), then as many tables as miss a
pair at exactly the least cosine with probability `miss` at most, and pairs above
it more rarely. Two vectors at 0.98 agree in one sign with probability
1 - arccos(0.98) / pi = 0.936; with 4 signs 5 tables miss 0.07 % of such pairs.
Vectors travel as single precision if they came so, which loses nothing.

Defined results: a vector that is null, empty, zero or has null or non-finite
parts, or a null label, links with nothing: 0 links, itself as component, kept.
Vectors of different length do not link. Repeated rows link with each other like
other equal vectors. A null vec_id takes part, but is kept only if no component
id can be given (then component_id is null and kept false). Very large and very
small parts don't overflow: a vector is scaled by its largest part. Columns
beside the three are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.operators.graph import components, local_roots
from briarlake.llm.text import named
from briarlake.scratch import Scratch


@dataclass(frozen=True)
class Tables:
    """Larger buckets than `block` classes are compared block by block, each pair of blocks a group of its own."""

    cosine: float = 0.98
    miss: float = 0.001
    bucket: int = 512
    block: int = 4096
    seed: int = 11

    def sizes(self, largest: int) -> tuple[int, int]:
        """Tables and signs for a largest label of so many classes."""
        bits = min(20, max(4, math.ceil(math.log2(max(largest, 1) / self.bucket))))
        agree = (1 - math.acos(self.cosine) / math.pi) ** bits
        return math.ceil(math.log(self.miss) / math.log(1 - agree)), bits


def _classed(single: bool):
    """(vec_id, label, embedding) to (vec_id, key, label, vector): key and vector are null for what never links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, keys, vectors = batch.column(2), [], []
            parts, ends, given = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_valid().to_pylist()  # a null part becomes NaN
            for k, label in enumerate(batch.column(1).to_pylist()):
                vector = parts[ends[k] : ends[k + 1]] + 0.0 if given[k] and label is not None else None  # -0.0 becomes 0.0
                usable = vector is not None and np.isfinite(vector).all() and vector.any()
                vectors.append((vector.astype(np.float32) if single else vector.astype(np.float64) / np.abs(vector).max()).tobytes() if usable else None)
                keys.append(hashlib.md5(label.encode() + b"\0" + vectors[-1], usedforsecurity=False).digest() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1), pa.array(vectors, pa.binary())], names=["vec_id", "key", "label", "vector"])

    return run


def _matrix(data: list[bytes], single: bool) -> np.ndarray:
    """Vectors of one length in double precision, each of length 1."""
    made = np.frombuffer(b"".join(data), np.float32 if single else np.float64).reshape(len(data), -1).astype(np.float64)
    made /= np.abs(made).max(axis=1)[:, None]
    return made / np.sqrt((made * made).sum(axis=1))[:, None]


def _codes(tables: int, bits: int, seed: int, single: bool):
    """Adds to (cid, copies, label, vector) its codes, one per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            data = batch.column(3).to_pylist()
            codes = np.empty((len(data), tables), np.int32)
            lengths = np.fromiter(map(len, data), np.int64, len(data))
            for size in np.unique(lengths):
                rows = np.flatnonzero(lengths == size)
                matrix = _matrix([data[k] for k in rows], single)
                d = matrix.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((tables * bits, d))
                codes[rows] = (matrix @ planes[d].T > 0).reshape(len(rows), tables, bits) @ weights
            ends = pa.array(np.arange(len(data) + 1) * tables, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(codes.ravel(), pa.int32()))], names=["cid", "copies", "label", "vector", "codes"])

    return run


def _compared(how: Tables, single: bool):
    """Over the rows of each bucket, sorted: link counts and a spanning set of links.

    In (group, table, low, mine, high, cid, copies, vector, codes). A group holds
    the blocks low and high of one bucket; `mine` is the row's block. Out (node,
    other, links): other is null for counts.
    """

    def bucket(table: int, low: int, rows: dict[str, list]) -> pa.RecordBatch:
        cid, copies = np.array(rows["cid"]), np.array(rows["copies"])
        codes = np.array(rows["codes"], np.int32).reshape(len(cid), -1)
        vectors = _matrix(rows["vector"], single)
        mine = np.array(rows["mine"])
        left, right = (np.flatnonzero(mine == low), np.flatnonzero(mine != low)) if rows["high"][0] != low else (np.arange(len(cid)),) * 2
        links, found = np.zeros(len(cid), np.int64), []
        for k in range(0, len(left), 512):
            part = left[k : k + 512]
            a, b = np.nonzero(vectors[part] @ vectors[right].T >= how.cosine)
            a, b = part[a], right[b]
            if left is right or rows["high"][0] == low:
                a, b = a[a < b], b[a < b]
            new = ~(codes[a, :table] == codes[b, :table]).any(axis=1)
            a, b = a[new], b[new]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = local_roots(len(cid), a, b)
            moved = np.flatnonzero(root != np.arange(len(cid)))
            found.append((moved, root[moved]))
        some = np.flatnonzero(links)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int),) * 2
        none = pa.nulls(len(some), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.r_[cid[some], cid[a]]), pa.concat_arrays([none, pa.array(cid[b], pa.int64())]), pa.array(np.r_[links[some], np.zeros(len(a), np.int64)])], names=["node", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, held = ["cid", "copies", "mine", "high", "vector", "codes"], None, {}
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in names}
            for k, key in enumerate(zip(batch.column("group").to_pylist(), batch.column("table").to_pylist(), batch.column("low").to_pylist(), columns["high"], strict=True)):
                if key != now:
                    if now is not None and len(held["cid"]) > 1:
                        yield bucket(now[1], now[2], held)
                    now, held = key, {n: [] for n in names}
                for n in names:
                    held[n].append(columns[n][k])
        if now is not None and len(held["cid"]) > 1:
            yield bucket(now[1], now[2], held)

    return run


def near_duplicates(embeddings: DataFrame, scratch: Scratch, how: Tables = Tables(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    id_kind = embeddings.schema[vec_id].dataType.simpleString()
    single = embeddings.schema[vector].dataType.elementType.simpleString() == "float"
    rows = embeddings.select(named(vec_id).alias("vec_id"), named(label).cast("string").alias("label"), named(vector).cast("array<float>" if single else "array<double>").alias("vector"))
    rows = scratch.keep(rows.mapInArrow(_classed(single), f"vec_id {id_kind}, key binary, label string, vector binary"))
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.min("label").alias("label"), F.min("vector").alias("vector"))
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()))
    largest = classes.groupBy("label", F.length("vector")).count().agg(F.max("count")).first()[0] or 0
    coded = scratch.keep(classes.select("cid", "copies", "label", "vector").mapInArrow(_codes(*how.sizes(largest), how.seed, single), "cid long, copies long, label string, vector binary, codes array<int>"))
    place = F.posexplode("codes").alias("table", "code")
    group = F.concat_ws(":", F.col("code"), F.length("vector"), F.col("label")).alias("group")
    large = coded.select(place, F.length("vector").alias("vector_bytes"), "label").groupBy("table", "code", "vector_bytes", "label").count()
    large = large.where(F.col("count") > how.block).select(F.col("table").alias("_t"), F.concat_ws(":", "code", "vector_bytes", "label").alias("_g"), F.ceil(F.col("count") / how.block).cast("int").alias("_blocks"))
    large = scratch.keep(large)
    dealt = coded.select("cid", "copies", "vector", "codes", "label", place).withColumn("group", group)
    dealt = dealt.join(large, (F.col("table") == F.col("_t")) & (F.col("group") == F.col("_g")), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int")).withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("mine", "_to")).withColumn("high", F.greatest("mine", "_to"))
    keys = ["table", "group", "low", "high"]
    dealt = dealt.select(*keys, "mine", "cid", "copies", "vector", "codes").repartition(*keys).sortWithinPartitions(*keys)
    found = scratch.keep(dealt.mapInArrow(_compared(how, single), "node long, other long, links long"))
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    counts = scratch.keep(counts)
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    rooted = classes.select("cid", "key", "copies", "first_id").join(scratch.keep(roots), F.col("cid") == F.col("node"), "left").drop("node")
    rooted = scratch.keep(rooted.withColumn("root", F.coalesce("root", "cid")).join(counts, F.col("cid") == F.col("node"), "left").drop("node"))
    lowest = scratch.keep(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "_root"))
    known = rooted.join(lowest, F.col("root") == F.col("_root")).select(F.col("key").alias("_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(scratch.keep(known), F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
