"""Shards of near equal bytes through fixed virtual slots and a stored, versioned slot map.

A record is hashed into one of ``SLOTS`` slots for good. Only the map from slots to shards changes:
bytes are summed per slot, and the newest version of the map is edited by moving slots from heavy to
light shards. Since the number of slots is fixed, the map and the sums per slot are small at any
size of the table, and only they reach the driver.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, written

SLOTS = 16_384
MAP = "version int, slot int, shard int, bytes long"


def records(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of every row.

    The slot follows from the id and the text's checksum, without an id from the row's number in the table.
    """
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return (id_and_text(docs, id_column, text_column)
            .select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
            .withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", alone), F.lit(SLOTS)).cast("int")))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and rows per slot, at most ``SLOTS`` rows."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def first_map(shards: int) -> dict[int, int]:
    """Version 1: slots dealt out in turn, before any size is known."""
    return {slot: slot % shards for slot in range(SLOTS)}


def edited(slot_map: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The map with slots moved from the heaviest to the lightest shard, as long as a move brings the two closer.

    Shards from 0 to ``shards - 1``; slots of a shard that is no more are dealt to the lightest ones. Slots that need not move stay.
    """
    result = dict(slot_map)
    load = [0] * shards
    own: dict[int, list[tuple[int, int]]] = defaultdict(list)
    homeless = []
    for slot, shard in result.items():
        size = sizes.get(slot, 0)
        if shard < shards:
            load[shard] += size
            if size:
                own[shard].append((size, slot))
        else:
            homeless.append((size, slot))
    for slots in own.values():
        slots.sort()
    for size, slot in sorted(homeless, reverse=True):
        light = min(range(shards), key=load.__getitem__)
        result[slot] = light
        load[light] += size
        bisect.insort(own[light], (size, slot))
    while True:
        heavy, light = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[heavy] - load[light]
        best = bisect.bisect_right(own[heavy], (gap / 2, SLOTS))  # around the size that would level the two
        options = [i for i in (best - 1, best) if 0 <= i < len(own[heavy]) and own[heavy][i][0] < gap]
        if not options:
            return result
        pick = min(options, key=lambda i: abs(gap - 2 * own[heavy][i][0]))
        size, slot = own[heavy].pop(pick)
        bisect.insort(own[light], (size, slot))
        load[heavy] -= size
        load[light] += size
        result[slot] = light


def store(spark: SparkSession, versions: list[dict[int, int]], sizes: dict[int, int]) -> DataFrame:
    """All versions of the map as one written table; ``bytes`` is what each slot held at the last version."""
    rows = [(number, slot, shard, sizes.get(slot, 0)) for number, each in enumerate(versions, 1) for slot, shard in each.items()]
    return written(spark, spark.createDataFrame(rows, MAP), "slot-map")


def latest(stored: DataFrame) -> DataFrame:
    newest = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == newest).drop("version")


def shard(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Shard and gapless place in the shard of every row, under the law ``bytes``.

    A null text has no bytes and checksum 0. Rows without an id are spread by their number. Repeated
    rows each take a place of their own, all in one slot.
    An empty table gives no rows. Columns: ``doc_id, size, text_crc32, law, shard, slot,
    grown_shard`` (null under this law) and ``virtual_slot``.
    """
    if not 0 < shards <= SLOTS:
        raise ValueError(f"between 1 and {SLOTS} shards")
    spark = docs.sparkSession
    rows = written(spark, records(docs, id_column, text_column), "records")
    per_slot = slot_bytes(rows)
    sizes = {r["virtual_slot"]: r["bytes"] for r in per_slot.select("virtual_slot", "bytes").collect()}
    before = first_map(shards)
    stored = latest(store(spark, [before, edited(before, sizes, shards)], sizes)).select(F.col("slot").alias("virtual_slot"), "shard")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = (per_slot.select("virtual_slot", "n").join(F.broadcast(stored), "virtual_slot")  # one row a slot
              .select("virtual_slot", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("inside", F.row_number().over(inside) - 1)
            .join(F.broadcast(places), "virtual_slot")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("inside")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """The rows themselves, one folder a shard. Needs ids that are unique."""
    places = assigned.select(F.col("doc_id").alias("__doc"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    (docs.join(places, F.col(id_column) == F.col("__doc")).drop("__doc")
     .withColumnsRenamed({"__shard": "shard", "__slot": "slot"}).write.partitionBy("shard").parquet(path))
