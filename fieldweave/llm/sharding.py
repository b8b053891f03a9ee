"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of virtual slots. Bytes are summed per slot, and a small
map sends slots to shards. Maps are stored by version; rebalancing edits a version into the
next by moving slots, so a record moves only if its slot does.

Null or empty texts count eight bytes; null ids hash like any value; repeated rows are all
kept, each with its own place, but stay in one slot (so one row repeated beyond a shard's share
would upset the balance). Ties in a slot are ordered by id, checksum and size. Very long texts are
weighed whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldweave.llm.common import shared_path

SLOTS = 8192


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each row; texts go no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", crc), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


class SlotMap:
    """Slot-to-shard map of one version. Its size is the fixed number of slots."""

    def __init__(self, shard_of: list[int], shards: int, version: int = 1):
        self.shard_of, self.shards, self.version = shard_of, shards, version

    @classmethod
    def dealt(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls([s % shards for s in range(slots)], shards)

    def rebalanced(self, weight: dict[int, int], keep_within: float = 0.0) -> SlotMap:
        """Move slots until the shards' bytes are near equal.

        Slots stay where they are while their shard is within its fair share; the surplus,
        smallest slots last, is dealt to the lightest shard. ``keep_within`` is the share of
        the mean by which a shard may exceed it before it gives slots away.
        """
        total = sum(weight.values())
        fair = total / self.shards * (1 + keep_within)
        by_shard: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(self.shard_of):
            if shard < self.shards:
                by_shard[shard].append(slot)
        load, spare = [0] * self.shards, [s for s, x in enumerate(self.shard_of) if x >= self.shards]
        placed = list(self.shard_of)
        for shard, own in enumerate(by_shard):
            for slot in sorted(own, key=lambda s: (-weight.get(s, 0), s)):
                if load[shard] + weight.get(slot, 0) <= fair:
                    load[shard] += weight.get(slot, 0)
                else:
                    spare.append(slot)
        heap = [(x, shard) for shard, x in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(spare, key=lambda s: (-weight.get(s, 0), s)):
            x, shard = heapq.heappop(heap)
            placed[slot] = shard
            heapq.heappush(heap, (x + weight.get(slot, 0), shard))
        return SlotMap(placed, self.shards, self.version + 1)

    def grown(self, weight: dict[int, int]) -> SlotMap:
        """One more shard, which takes whole slots from the heaviest; no slot moves elsewhere."""
        load = [0] * self.shards
        own: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(self.shard_of):
            load[shard] += weight.get(slot, 0)
            own[shard].append(slot)
        want, placed, new = sum(load) / (self.shards + 1), list(self.shard_of), 0
        for x in own:
            x.sort(key=lambda s: (weight.get(s, 0), s))
        heap = [(-x, shard) for shard, x in enumerate(load)]
        heapq.heapify(heap)
        while heap and new < want:
            x, shard = heapq.heappop(heap)
            if not own[shard]:
                continue
            slot = own[shard].pop()
            if weight.get(slot, 0) and new + weight[slot] > want * 1.02 and new:
                heapq.heappush(heap, (x, shard)) if own[shard] else None
                continue
            placed[slot], new = self.shards, new + weight.get(slot, 0)
            heapq.heappush(heap, (x + weight.get(slot, 0), shard))
        return SlotMap(placed, self.shards + 1, self.version + 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        pairs = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(self.shard_of)), "array<int>")).alias("virtual_slot", "shard"))
        return pairs.select(F.lit(self.version).alias("version"), "virtual_slot", "shard")

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version; a version that is there already is refused."""
        self.frame(spark).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions under a map's path, by the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(x.partition("=")[2]) for x in found if x.startswith("version=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/_SUCCESS")))


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}").select("virtual_slot", "shard")


def load_newest(spark: SparkSession, path: str, shards: int) -> SlotMap | None:
    """The newest stored version, for editing; None where nothing is stored."""
    versions = stored_versions(spark, path)
    if not versions:
        return None
    rows = load_map(spark, path, versions[-1]).orderBy("virtual_slot").collect()  # the fixed number of slots
    return SlotMap([r.shard for r in rows], shards, versions[-1])


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Send rows to shards and number each shard's rows from 0 without gaps.

    Rows are ranked inside their virtual slot and shifted by the rows of the shard's earlier
    slots, so no task ever holds a whole shard.
    """
    counts = slot_bytes(rows).join(F.broadcast(slot_map), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("n", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(first), "virtual_slot").withColumn("slot", (F.col("first") + F.col("n")).cast("long"))


def shard_by_bytes(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Rows with shard and place, the shards' bytes near equal.

    The newest map under ``map_path`` is edited into the next version, so that few slots move; where none is
    stored, slots are dealt out first. A map that needs no edit stays as it is.
    """
    spark = docs.sparkSession
    rows = slotted(docs, slots)
    weight = {r.virtual_slot: r.bytes for r in slot_bytes(rows).collect()}  # at most `slots` rows
    path = map_path or shared_path(spark, "slot-map")
    current = load_newest(spark, path, shards)
    if current is None:
        current = SlotMap.dealt(shards, slots)
        current.save(spark, path)
    if len(current.shard_of) != slots:
        raise ValueError("the stored map has another number of slots")
    edited = current.rebalanced(weight)
    if edited.shard_of != current.shard_of:
        edited.save(spark, path)
        current = edited
    return place(rows, load_map(spark, path, current.version))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: 24 shards of near equal bytes over the whole documents table."""
    placed = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
