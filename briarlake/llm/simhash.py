"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has bit b set if more than half of its shingles' XXH64
values have. Distinct fingerprints are dealt into buckets that share two of
radius + 2 blocks of bits (any two within the radius share at least two), and
within a bucket distances are counted in vertical bit planes, 64 candidates to a
machine word, by carry-save counters; words whose lanes all exceed the radius
are abandoned. Links become connected components. Only buckets of over
BUCKET_LIMIT fingerprints leave this method, as comparing them takes quadratic
time: each of their fingerprints meets its neighbours of one bit, which is exact
for radius 2 and linear.

Defined results: a null or wordless text has fingerprint zero and links like any
other; equal fingerprints are one component; a null doc_id takes part but names
no component unless it is alone (then component_id is null); repeated rows each
get a row; texts are read whole, however long; other columns are left out or, in
`filter_documents`, pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.operators.graph import components, local_roots
from briarlake.llm.text import fresh, named, small_batches
from briarlake.scratch import Scratch

BITS = 64
SEED = 42
#: Buckets with more fingerprints take the exact neighbour path instead.
BUCKET_LIMIT = 2048
#: Words of 64 lanes that are compared at once: bounds the planes to 16 MB.
SLAB_WORDS = 2048


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of one whole text over shingles of lower-cased (A-Z) words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, n, hashed = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return hashed(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    values = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(values), 1 << 15):
        counts += np.unpackbits(values[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(named(doc_id), named(text).cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


def _planes(values: np.ndarray) -> np.ndarray:
    """Bit planes [64, words] of values [words * 64]: bit j of planes[b, w] is bit b of value 64 w + j."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def close_pairs(values: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) within a group that differ in at most `radius` bits.

    `values` (uint64) holds the groups one after another, `sizes` their lengths.
    """
    n, width = len(values), -(-sizes // 64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first_word = (np.cumsum(width) - width)[group]
    slot = first_word * 64 + within
    lanes, words = np.zeros(int(width.sum()) * 64, np.uint64), int(width.sum())
    lanes[slot] = values
    at = np.full(words * 64, -1, np.int64)
    at[slot] = np.arange(n)
    valid = np.packbits((at >= 0).reshape(words, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    planes = _planes(lanes)
    # Each value against its own word and the later words of its group.
    own = within // 64
    reps = width[group] - own
    query = np.repeat(np.arange(n), reps)
    word = (first_word + own)[query] + np.arange(len(query)) - np.repeat(np.cumsum(reps) - reps, reps)
    later = np.where(word == (first_word + own)[query], ~np.uint64(0) << (slot[query] % 64).astype(np.uint64) << np.uint64(1), ~np.uint64(0))
    alive = valid[word] & later
    live = alive != 0
    query, word, alive = query[live], word[live], alive[live]
    counters = [np.zeros(len(query), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(query), np.uint64)
    bits = values[query]
    for b in range(BITS):
        carry = planes[b][word] ^ (np.uint64(0) - ((bits >> np.uint64(b)) & np.uint64(1)))
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        over |= carry
        if b % 4 == 3 or b == BITS - 1:
            more, equal = over.copy(), ~np.uint64(0)
            for k in reversed(range(len(counters))):
                if radius >> k & 1:
                    equal = equal & counters[k]
                else:
                    more |= equal & counters[k]
                    equal = equal & ~counters[k]
            alive = alive & ~more
            live = alive != 0
            if not live.all():
                query, word, alive, bits, over = query[live], word[live], alive[live], bits[live], over[live]
                counters = [c[live] for c in counters]
            if not len(query):
                break
    if not len(query):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[row], at[word[row] * 64 + lane]


def _stars(values: np.ndarray, keys: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among values of equal key, reduced to one per value: its smallest linked value in the slab."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    many = sizes > 1
    values, sizes = values[np.repeat(many, sizes)], sizes[many]
    ends = np.cumsum(-(-sizes // 64))
    found_a, found_b, begin, row = [], [], 0, 0
    while begin < len(sizes):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + SLAB_WORDS, "right")))
        rows = int(sizes[begin:end].sum())
        a, b = close_pairs(values[row : row + rows].view(np.uint64), sizes[begin:end], radius)
        if len(a):
            distinct, number = np.unique(values[row : row + rows], return_inverse=True)
            root = local_roots(len(distinct), number[a], number[b])
            moved = np.flatnonzero(root != np.arange(len(distinct)))
            found_a.append(distinct[moved])
            found_b.append(distinct[root[moved]])
        begin, row = end, row + rows
    none = np.empty(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def _bucket_links(radius: int):
    """For mapInArrow over (key, fp) sorted by key: links within each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            a, b = _stars(values, keys, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        keys = values = np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(keys) >= 1 << 16:  # the last key may go on in the next batch; no key has over BUCKET_LIMIT rows
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield links(keys[:cut], values[:cut])
                    keys, values = keys[cut:], values[cut:]
        if len(keys):
            yield links(keys, values)

    return run


def link(distinct: DataFrame, scratch: Scratch, radius: int = 2) -> DataFrame:
    """(a, b) over distinct fingerprints `fp`: links whose components are those of all pairs within the radius.

    Buckets over BUCKET_LIMIT go another exact way: each of their fingerprints
    is sent to every value one bit away and to itself. Two within 2 bits meet at
    a common value, where at most 65 can meet; so no group grows with the data.
    """
    if radius != 2:
        raise ValueError("the neighbour path for large buckets holds for radius 2")
    size = BITS // (radius + 2)
    block = [f"(shiftrightunsigned(fp, {size * k}) & {(1 << size) - 1})" for k in range(radius + 2)]
    keys = F.expr("explode(array(" + ", ".join(f"({t}L << 40) | ({block[i]} << {size}) | {block[j]}" for t, (i, j) in enumerate(combinations(range(radius + 2), 2))) + "))")
    dealt = distinct.select(keys.alias("key"), "fp")
    large = scratch.keep(dealt.groupBy("key").count().where(F.col("count") > BUCKET_LIMIT).select(F.col("key").alias("large")))
    bounded = dealt.join(large, F.col("key") == F.col("large"), "left_anti").repartition("key").sortWithinPartitions("key")
    links = bounded.mapInArrow(_bucket_links(radius), "a long, b long")
    if not large.isEmpty():
        wide = scratch.keep(dealt.join(large, F.col("key") == F.col("large"), "left_semi").select("fp").distinct())
        flips = F.expr(f"explode(concat(array(fp), transform(sequence(0, {BITS - 1}), i -> fp ^ shiftleft(1L, i))))")
        met = wide.select(flips.alias("at"), "fp").groupBy("at").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        links = links.unionByName(met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b"))
    return links


def near_duplicates(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable by links."""
    prints = scratch.keep(fingerprints(docs, doc_id, text))
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = scratch.keep(components(scratch.keep(link(distinct.select("fp"), scratch, radius)), scratch))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.keep(rooted)
    lowest = scratch.keep(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "_root"))
    classes = scratch.keep(rooted.join(lowest, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id"))
    return prints.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """With the fingerprint as 16 lowercase hex digits."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def filter_documents(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: that of the smallest doc_id. Documents of null doc_id stay.

    If rows repeat a doc_id, one row of it stays. The ids that go are a written
    table, smaller than that of those that stay: Spark broadcasts it if it is
    small, and shuffles the texts only where it is not.
    """
    gone, own = fresh(docs, "_gone"), named(doc_id)
    found = near_duplicates(docs, scratch, doc_id, text).where("doc_id IS NOT NULL")
    ids = scratch.keep(found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n")))
    dropped = scratch.keep(ids.where(~F.col("stays")).select(F.col("doc_id").alias(gone)))
    kept = docs.where(own.isNotNull()).join(dropped, own == F.col(gone), "left_anti")
    if not ids.where("stays AND n > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id])
    return kept.unionByName(docs.where(own.isNull()))
