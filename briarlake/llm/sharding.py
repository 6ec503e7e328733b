"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's hash gives its virtual slot for good: of doc_id alone, so an edited
text stays where it is. Bytes are summed by slot, and the map from slots to
shards is a small versioned table. Each run loads the latest version and edits
it: slots move from full to empty shards, into added shards, out of removed
ones. A version is appended only if a slot moved, so a second run over the same
records changes nothing.

Law `bytes`: sizes of shards are near equal. Equal texts under different ids are
not held together, as a group of copies may hold a third of all rows.

Defined results: a null text counts as an empty one; a null doc_id is hashed by
its text's checksum, and all such rows of one text share a slot; a record larger
than a shard's share makes its shard larger than the rest; repeated rows fall
into the same slot and get places of their own, ties in (slot, doc_id, checksum,
size) in any order; an empty table gives no row and edits nothing; columns
beside doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.llm.text import named
from briarlake.operators.order import ranked
from briarlake.scratch import Scratch

#: Fixed for the life of a dataset; what the driver holds is bounded by it.
SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version and shard of each virtual slot."""

    version: int
    shards: tuple[int, ...]

    @staticmethod
    def first(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, tuple(s % shards for s in range(slots)))

    def loads(self, sizes: dict[int, int], count: int) -> list[int]:
        held = [0] * count
        for slot, size in sizes.items():
            held[self.shards[slot]] += size
        return held

    def balanced(self, sizes: dict[int, int], count: int) -> SlotMap:
        """The next version: slots move from the fullest to the emptiest shard while that narrows the gap."""
        owner = list(self.shards)
        held = self.loads(sizes, count)
        by_shard: list[dict[int, int]] = [{} for _ in range(count)]
        for slot, size in sizes.items():
            if size:
                by_shard[owner[slot]][slot] = size
        while True:
            high, low = max(range(count), key=held.__getitem__), min(range(count), key=held.__getitem__)
            gap = held[high] - held[low]
            fits = [(abs(2 * size - gap), slot) for slot, size in by_shard[high].items() if size < gap]
            if not fits:
                return SlotMap(self.version + 1, tuple(owner))
            slot = min(fits)[1]
            size = by_shard[high].pop(slot)
            by_shard[low][slot] = size
            owner[slot], held[high], held[low] = low, held[high] - size, held[low] + size

    def grown(self, sizes: dict[int, int], count: int) -> SlotMap:
        """The next version, with shard `count` added: slots move only into it, until it holds its share."""
        owner, held = list(self.shards), self.loads(sizes, count)
        share, got = sum(held) / (count + 1), 0
        for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            if size and got + size <= share and held[owner[slot]] - size >= share:
                held[owner[slot]] -= size
                owner[slot], got = count, got + size
        return SlotMap(self.version + 1, tuple(owner))

    def shrunk(self, sizes: dict[int, int], count: int) -> SlotMap:
        """The next version, with shards from `count` on removed: their slots go to the emptiest others."""
        owner, held = list(self.shards), [0] * count
        for slot, shard in enumerate(owner):
            if shard < count:
                held[shard] += sizes.get(slot, 0)
        for slot in sorted((s for s, shard in enumerate(owner) if shard >= count), key=lambda s: (-sizes.get(s, 0), s)):
            owner[slot] = min(range(count), key=held.__getitem__)
            held[owner[slot]] += sizes.get(slot, 0)
        return SlotMap(self.version + 1, tuple(owner))

    def fitted(self, sizes: dict[int, int], count: int) -> SlotMap:
        """For `count` shards and these sizes: this map if it needs no edit, else the next version."""
        fit, had = self, max(self.shards) + 1
        for k in range(had, count):
            fit = fit.grown(sizes, k)
        if count < had:
            fit = fit.shrunk(sizes, count)
        fit = fit.balanced(sizes, count)
        return self if fit.shards == self.shards else SlotMap(self.version + 1, fit.shards)


class MapStore:
    """The versions of a slot map as a Parquet table, a folder for each; an unfinished version is not read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self, slots: int = SLOTS) -> SlotMap | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        table = self.spark.read.schema("virtual_slot int, shard int, version int").parquet(self.path)
        whole = table.groupBy("version").agg(F.count_distinct("virtual_slot").alias("n")).where(F.col("n") == slots).agg(F.max("version")).first()[0]
        if whole is None:
            return None
        rows = table.where(F.col("version") == whole).select("virtual_slot", "shard").distinct().collect()  # SLOTS rows
        return SlotMap(whole, tuple(shard for _, shard in sorted(map(tuple, rows))))

    def append(self, made: SlotMap) -> None:
        rows = self.spark.createDataFrame(list(enumerate(made.shards)), "virtual_slot int, shard int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={made.version}")


def slotted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) for every row."""
    whole = F.coalesce(named(text), F.lit(""))
    sized = docs.select(named(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32")).otherwise(F.xxhash64("doc_id"))
    return sized.withColumn("virtual_slot", F.pmod(key, F.lit(slots)).cast("int"))


def shard_documents(docs: DataFrame, scratch: Scratch, shards: int = 8, versions: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's size, text_crc32, virtual_slot, map_version, shard and place in it.

    The latest map is loaded from the table `versions` (by default a new one in
    the scratch folder) or dealt in turn as version 1, then edited for this
    table's bytes and number of shards. Records are dealt by the stored map.
    """
    spark = docs.sparkSession
    rows = scratch.keep(slotted(docs, doc_id, text))
    sizes = {r[0]: int(r[1]) for r in rows.groupBy("virtual_slot").agg(F.sum("size")).collect()}  # SLOTS rows at most
    store = MapStore(spark, versions or f"{scratch.base}/slot_map")
    if (now := store.latest()) is None:
        store.append(now := SlotMap.first(shards))
    if sizes and (fit := now.fitted(sizes, shards)) is not now:
        store.append(fit)
        now = store.latest()
    current = spark.read.parquet(f"{store.path}/version={now.version}").select(F.col("virtual_slot").alias("_slot"), "shard")
    dealt = rows.join(current, F.col("virtual_slot") == F.col("_slot")).drop("_slot").withColumn("map_version", F.lit(now.version))
    order = [F.col("virtual_slot"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    return ranked(dealt, ["shard"], order, scratch, "slot")


def digest(sharded: DataFrame) -> DataFrame:
    law = F.lit("bytes").alias("law")
    return sharded.select("doc_id", "size", "text_crc32", law, "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
