"""Sharding by fixed virtual slots.

Every record is hashed into one of ``SLOTS`` slots, for good. Bytes and rows are summed up by slot, and a small table, the map, says
which shard each slot lies in. Maps are kept by version in one Parquet table: the first deals the slots out by bytes, the
heaviest first, each to the lightest shard; later ones are edits of the one before, which move slots, and so their records, only
where that evens the shards out. A new shard takes slots from the others until it has its share, and nothing else moves.

The driver handles one row a slot, a fixed number; records never pass through it. A record's place in its shard is its place
in its slot plus the rows of the shard's slots before that, so no task numbers more than a slot.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import discard, scratch, stored, with_row_id

SHARDS, SLOTS = 24, 16_384
HEAD = 8
MAP = "version int, slot int, shard int"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, rid, virtual_slot of every document; no texts.

    The slot is a hash of the doc_id where that is a whole number that tells all rows apart; else of a stored row
    number, so that null and repeated ids spread like others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + HEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return with_row_id(narrow, ["doc_id", "size", "text_crc32"]).withColumn("virtual_slot", F.pmod(F.xxhash64("rid"), F.lit(slots)).cast("int"))


def slot_sums(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """(rows, bytes) by slot: one row a slot reaches the driver."""
    sums = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    return {r["virtual_slot"]: (r["rows"], r["bytes"]) for r in sums.collect()}


def first_map(bytes_of: Mapping[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """The shard of every slot, empty ones too: heaviest first, each to the lightest shard, of equal ones to the lowest."""
    load = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-bytes_of.get(s, 0), s)):
        held, shard = load[0]
        out[slot] = shard
        heapq.heapreplace(load, (held + bytes_of.get(slot, 0), shard))
    return out


def edited_map(old: Mapping[int, int], bytes_of: Mapping[int, int], shards: int) -> dict[int, int]:
    """``old`` for these bytes and this number of shards, with few slots moved.

    A new shard takes slots alone from the heaviest shards, as long as that lowers the larger of the two; no other moves then. With
    the same shards slots go from the heaviest to the lightest one under the same rule. Slots of shards that are no more go to the lightest.
    """
    out = dict(old)
    load, held = [0] * shards, [[] for _ in range(shards)]
    for slot, shard in out.items():
        if shard < shards:
            load[shard] += bytes_of.get(slot, 0)
            held[shard].append(slot)
    for slot in sorted((s for s, shard in out.items() if shard >= shards), key=lambda s: (-bytes_of.get(s, 0), s)):
        out[slot] = to = min(range(shards), key=lambda s: (load[s], s))
        load[to] += bytes_of.get(slot, 0)
        held[to].append(slot)
    new = set(range(shards)) - set(old.values())
    for slots in held:  # the lightest slot last
        slots.sort(key=lambda s: (-bytes_of.get(s, 0), s))
    while True:
        source = max((s for s in range(shards) if s not in new), key=lambda s: (load[s], -s), default=None)
        to = min(new or range(shards), key=lambda s: (load[s], s))
        if source is None or source == to:
            return out
        # the heaviest slot that leaves the source no lighter than the target becomes
        gap = load[source] - load[to]
        slot = next((s for s in held[source] if 0 < 2 * bytes_of.get(s, 0) <= gap), None)
        if slot is None:
            return out
        held[source].remove(slot)
        held[to].append(slot)
        held[to].sort(key=lambda s: (-bytes_of.get(s, 0), s))
        load[source] -= bytes_of[slot]
        load[to] += bytes_of[slot]
        out[slot] = to


class ShardMap:
    """The versions of a slot-to-shard map in one Parquet table, each written once and read back whole."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def add(self, shard_of: Mapping[int, int], version: int) -> None:
        rows = [(version, slot, shard) for slot, shard in sorted(shard_of.items())]
        self.spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        """slot, shard of one version."""
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.path}/version={version}")

    def shard_of(self, version: int) -> dict[int, int]:
        return {r["slot"]: r["shard"] for r in self.read(version).collect()}

    def rebalance(self, version: int, bytes_of: Mapping[int, int], shards: int) -> int:
        """Adds an edit of ``version`` as the next one and gives its number."""
        self.add(edited_map(self.shard_of(version), bytes_of, shards), version + 1)
        return version + 1


def placed(rows: DataFrame, sums: Mapping[int, tuple[int, int]], shard_of: DataFrame) -> DataFrame:
    """``rows`` with shard and slot, their place in it, gapless from 0."""
    spark = rows.sparkSession
    counts = spark.createDataFrame([(s, n) for s, (n, _) in sorted(sums.items())], "virtual_slot int, rows long")
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = shard_of.withColumnRenamed("slot", "virtual_slot").join(counts, "virtual_slot").withColumn("start", F.coalesce(before, F.lit(0)))
    at = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("rid")) - 1
    # one row a slot is sent to all executors
    return rows.withColumn("at", at).join(F.broadcast(starts.select("virtual_slot", "shard", "start")), "virtual_slot").withColumn("slot", F.col("start") + F.col("at")).drop("start", "at")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every row.

    The law is ``bytes``: shards have near equal sizes, as far as single slots and documents allow. size: UTF-8 bytes of the text and ``HEAD``; a null
    text has none and the checksum of an empty one. Null and repeated doc_ids and repeated rows are placed like others, each row once.
    An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = stored(records(docs, slots), "records")
    sums = slot_sums(rows)
    maps = ShardMap(spark, scratch(spark, "shard-map"))
    maps.add(first_map({s: b for s, (_, b) in sums.items()}, shards, slots), 1)
    out = placed(rows, sums, maps.read(1))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version"))


def grown(docs: DataFrame, maps: ShardMap, version: int, shards: int, slots: int = SLOTS) -> tuple[int, DataFrame]:
    """The map's next version for ``shards`` shards and the bytes of ``docs``, and (doc_id, old_shard, shard) of the rows it moves."""
    rows = stored(records(docs, slots), "records")
    sums = slot_sums(rows)
    new = maps.rebalance(version, {s: b for s, (_, b) in sums.items()}, shards)
    moved = maps.read(version).withColumnRenamed("shard", "old_shard").join(maps.read(new), "slot").where("shard <> old_shard")
    out = stored(rows.join(F.broadcast(moved.withColumnRenamed("slot", "virtual_slot")), "virtual_slot").select("doc_id", "old_shard", "shard"), "moved")
    discard(rows)
    return new, out
