"""Sharding by fixed virtual slots.

A record is hashed, by its id and its text's checksum, into one of ``SLOTS`` virtual slots, which never change; a
versioned table in the shared folder maps slots to shards. Bytes and rows are summed by slot (a bounded table);
rebalancing by them makes a new version that moves single slots until shards are near equal in bytes, and growing makes
one that moves slots into a new shard only. All other slots stay where they are. A record's place in its shard is its slot's offset plus its rank in the
slot, so no task ever sorts a whole shard; ranks are taken in ``PARTS`` parts of a slot by the row's place in the
checkpointed table, so that equal rows don't meet in one task.

Defined cases: a null text has no bytes and the checksum of nothing; repeated rows share a slot and each get a place;
an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, named

SLOTS, PARTS, OVERHEAD = 4096, 16, 8


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: the shard of each slot, dealt in turn."""
    return [slot % shards for slot in range(slots)]


def grow(shard_of: list[int]) -> list[int]:
    """The next version with one more shard, which takes slots from all others and nothing else moves.

    Depends on the map alone, so on the number of shards alone if the map was first made and then grown.
    """
    shards = max(shard_of) + 1
    by_shard: dict[int, list[int]] = defaultdict(list)
    for slot, shard in enumerate(shard_of):
        by_shard[shard].append(slot)
    grown, wanted = list(shard_of), len(shard_of) // (shards + 1)
    for _ in range(wanted):
        donor = max(by_shard, key=lambda s: (len(by_shard[s]), s))
        grown[by_shard[donor].pop()] = shards
    return grown


def rebalance(shard_of: list[int], slot_bytes: dict[int, int], tolerance: float = 0.0) -> list[int]:
    """The next version, in which slots moved from the fullest to the emptiest shard, or changed places with one there, until all are near the mean or nothing brings them nearer."""
    moved, load, shards = list(shard_of), defaultdict(int), max(shard_of) + 1
    own: dict[int, set[int]] = defaultdict(set)
    for slot, shard in enumerate(shard_of):
        load[shard] += slot_bytes.get(slot, 0)
        if slot_bytes.get(slot, 0):
            own[shard].add(slot)
    mean = sum(load.values()) / shards
    for _ in range(4 * len(shard_of)):
        full = max(range(shards), key=lambda s: (load[s], s))
        if load[full] <= mean * (1 + tolerance):
            break
        out = sorted(own[full], key=lambda s: (slot_bytes[s], s))
        best = None
        for free in sorted(range(shards), key=lambda s: (load[s], s))[:4]:
            room = load[full] - load[free]
            back = [(0, -1), *sorted((slot_bytes[s], s) for s in own[free])]
            for slot in out:  # what comes back is about as much less as halves the difference
                at = bisect_left(back, (slot_bytes[slot] - room / 2, -1))
                for size, other in back[max(at - 1, 0) : at + 1]:
                    gain = slot_bytes[slot] - size
                    if 0 < gain < room and (best is None or abs(room / 2 - gain) < best[0]):
                        best = abs(room / 2 - gain), slot, other, free
            if best:
                break
        if not best:
            break
        _, slot, other, free = best
        for x, source, target in ((slot, full, free), (other, free, full)):
            if x >= 0:
                own[source].discard(x)
                own[target].add(x)
                load[source] -= slot_bytes[x]
                load[target] += slot_bytes[x]
                moved[x] = target
    return moved


def map_table(spark: SparkSession, versions: dict[int, list[int]]) -> DataFrame:
    """(version, virtual_slot, shard): at most slots x versions rows."""
    rows = pd.DataFrame([(v, slot, shard) for v, m in versions.items() for slot, shard in enumerate(m)], columns=["version", "virtual_slot", "shard"])
    return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")


def store_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Add a version to the stored map; earlier versions stay."""
    map_table(spark, {version: shard_of}).coalesce(1).write.mode("overwrite").parquet(f"{path}/v={version}")


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.parquet(f"{path}/v={version}").orderBy("virtual_slot").collect()  # bounded: a row per slot
    return [r["shard"] for r in rows]


def slotted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, by_key: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, the virtual slot (by the id alone if ``by_key``) and the row's place; the lineage is cut, so that texts are read once."""
    d = named(docs, doc_id=doc_id, text=text)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    d = d.select("doc_id", (F.octet_length(raw).cast("long") + OVERHEAD).alias("size"), F.crc32(raw).alias("text_crc32"))
    hashed = F.xxhash64(*(["doc_id"] if by_key else ["doc_id", "text_crc32"]))
    return cut(d.select("*", F.pmod(hashed, F.lit(slots)).cast("int").alias("virtual_slot"), F.monotonically_increasing_id().alias("row")))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows by virtual slot: what rebalancing looks at."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def bytes_by_slot(rows: DataFrame) -> dict[int, int]:
    """The summed bytes on the driver: at most a number by slot."""
    return {r["virtual_slot"]: r["bytes"] for r in slot_sizes(rows).collect()}


def place(rows: DataFrame, shard_of: list[int], grown: list[int] | None = None, law: str = "bytes") -> DataFrame:
    """Each row's shard, its gapless place there (slot) and, if a grown map is given, its shard after growing."""
    spark = rows.sparkSession
    both = map_table(spark, {1: shard_of}).drop("version")
    if grown is None:
        both = both.withColumn("grown_shard", F.lit(None).cast("int"))
    else:
        both = both.join(map_table(spark, {2: grown}).select("virtual_slot", F.col("shard").alias("grown_shard")), "virtual_slot")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    sizes = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(F.broadcast(both), "virtual_slot").withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("row"))
    # the offsets have at most SLOTS x PARTS rows, whatever the input
    placed = rows.withColumn("rank", rank.cast("long")).join(F.broadcast(offsets), ["virtual_slot", "part"])
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), "grown_shard", "virtual_slot")
