"""Sharding by fixed virtual slots.

Every record is hashed into one of ``n_slots`` virtual slots, for good. Only the bytes of each
slot are aggregated; a versioned table maps slots to shards and is edited to rebalance, so a
new shard moves whole slots and records never need a new hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.llm.common import staged

N_SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int"
SlotMap = list[tuple[int, int, int]]


def virtual_slot(n_slots: int, *key: Column) -> Column:
    """The fixed slot of a record; null keys have a slot like any other."""
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def slot_bytes(records: DataFrame, n_slots: int) -> list[int]:
    """Bytes by virtual slot; the driver gets at most ``n_slots`` rows."""
    sizes = [0] * n_slots
    for row in records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():
        sizes[row["virtual_slot"]] = int(row["bytes"])
    return sizes


def first_map(sizes: Sequence[int], n_shards: int, version: int = 1) -> SlotMap:
    """Largest slot first to the lightest shard, so that bytes come out nearly equal."""
    heap = [(0, 0, shard) for shard in range(n_shards)]
    placed: SlotMap = []
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        load, held, shard = heapq.heappop(heap)
        placed.append((version, slot, shard))
        heapq.heappush(heap, (load + sizes[slot], held + 1, shard))
    return sorted(placed)


def grown_map(current: Iterable[tuple[int, int, int]], sizes: Sequence[int]) -> SlotMap:
    """The next version with one more shard, which takes slots and gives none.

    Each step moves the largest slot of the heaviest shard that the new shard can take without
    passing the mean; no slot moves between old shards.
    """
    held: dict[int, list[int]] = {}
    version = 0
    for version, slot, shard in current:
        held.setdefault(shard, []).append(slot)
    new, total = max(held) + 1, sum(sizes)
    goal, load = total / (new + 1), 0
    loads = {shard: sum(sizes[s] for s in slots) for shard, slots in held.items()}
    for slots in held.values():
        slots.sort(key=lambda s: (sizes[s], -s))
    moved: list[int] = []
    open_shards = set(held)
    while open_shards:
        shard = max(open_shards, key=lambda k: (loads[k], -k))
        room = min(goal - load, loads[shard] - goal)
        fit = next((s for s in reversed(held[shard]) if 0 < sizes[s] <= room), None)
        if fit is None:
            open_shards.discard(shard)
            continue
        held[shard].remove(fit)
        moved.append(fit)
        load += sizes[fit]
        loads[shard] -= sizes[fit]
    held[new] = moved
    return sorted((version + 1, slot, shard) for shard, slots in held.items() for slot in slots)


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Appends a version to the stored map."""
    spark.createDataFrame(slot_map, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the stored map, or its latest; at most ``n_slots`` rows."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return sorted(tuple(r) for r in stored.where(F.col("version") == version).collect())


def current_map(spark: SparkSession, sizes: Sequence[int], n_shards: int, path: str) -> SlotMap:
    """The latest stored map, grown and stored as the next version if it has fewer shards.

    Without a stored one the first is made and stored. A map for other slots or more shards
    than asked for is an error, as no slot may move without a stored edit.
    """
    try:
        stored = load_map(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = []
    if not stored:
        stored = first_map(sizes, n_shards)
        save_map(spark, stored, path)
        return stored
    if [slot for _, slot, _ in stored] != list(range(len(sizes))):
        raise ValueError(f"the stored map isn't one of {len(sizes)} slots")
    version, have = stored[0][0], max(shard for _, _, shard in stored) + 1
    if have > n_shards:
        raise ValueError(f"the stored map has {have} shards, more than {n_shards}")
    grown = stored
    for _ in range(n_shards - have):
        grown = grown_map(grown, sizes)
    if any(a[2] != b[2] for a, b in zip(stored, grown, strict=True)):
        grown = [(version + 1, slot, shard) for _, slot, shard in grown]
        save_map(spark, grown, path)
        return grown
    return stored


#: Equal rows that one task makes from their count.
COPIES = 1000


def sized(documents: DataFrame, n_slots: int) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each document; null text has no bytes.

    Rows equal in id and text are counted, numbered and hashed with their number, so that they
    spread over the slots, whatever files they came from.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    rows = staged(rows, "shard-rows")

    def numbered(some: DataFrame, first: Column, last: Column) -> DataFrame:
        return some.withColumn("copy", F.explode(F.sequence(first, last)))

    many = rows.where(F.col("n") > COPIES)
    blocks = numbered(many, F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)).withColumnRenamed("copy", "block").repartition("doc_id", "text_hash", "block")
    begin = F.col("block") * COPIES
    few = numbered(rows.where(F.col("n") <= COPIES), F.lit(0).cast("long"), F.col("n") - 1)
    both = few.unionByName(numbered(blocks, begin, F.least(begin + COPIES, F.col("n")) - 1).drop("block"))
    plain, copied = virtual_slot(n_slots, F.col("doc_id"), F.col("text_hash")), virtual_slot(n_slots, F.col("doc_id"), F.col("text_hash"), F.col("copy"))
    return both.select("doc_id", "size", "text_crc32", F.when(F.col("copy") == 0, plain).otherwise(copied).alias("virtual_slot"))


def shard(documents: DataFrame, n_shards: int, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Puts each document into a shard by the law ``bytes`` and gives its place there.

    The text is read once; after that only narrow rows move. A place in a shard is the slot's
    offset (from per-slot counts) plus the place in the slot, so no task orders more than a
    slot. With ``map_path`` the stored map decides, and more shards than it has extend it; without
    it a map is made for this call. Null ids and texts are hashed and placed like others,
    repeated rows stay separate rows and spread over the slots, extra columns are ignored, and
    an empty table gives no rows. A slot is the unit that is balanced.
    """
    if n_shards < 1 or n_slots < n_shards:
        raise ValueError("n_slots must be at least n_shards, which must be at least 1")
    spark = documents.sparkSession
    rows = staged(sized(documents, n_slots), "shard-sizes")
    per_slot = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    sizes, counts = [0] * n_slots, [0] * n_slots
    for r in per_slot:
        sizes[r["virtual_slot"]], counts[r["virtual_slot"]] = int(r["bytes"]), r["n"]
    slot_map = current_map(spark, sizes, n_shards, map_path) if map_path else first_map(sizes, n_shards)
    filled = [0] * n_shards
    placed = []
    for _, slot, to in slot_map:
        placed.append((slot, to, filled[to]))
        filled[to] += counts[slot]
    # n_slots rows at most, whatever the input: safe to broadcast
    places = F.broadcast(spark.createDataFrame(placed, "virtual_slot int, shard int, offset long"))
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("in_slot", F.row_number().over(in_slot) - 1)
        .join(places, "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("in_slot")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )
