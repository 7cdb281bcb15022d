"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of 64-bit positions; a key belongs to the first point clockwise of its
hash. A shard takes at most its capacity; keys beyond it continue clockwise to the next shard that has room. With
slack 0 the capacities are n / shards rounded up or down, so counts differ by at most one (law `rows`), and only
keys of overfull arcs leave their home shard.

The ring is cut into a fixed number of segments (points and `CELLS` equal cells). Only counts by segment reach the
driver - at most CELLS + shards * vnodes rows, whatever the input - where overflow is settled: in round r the keys
still waiting in each segment, in ring order, ask the r-th different shard clockwise. The outcome is a table of
rank intervals by segment, broadcast under that same bound; a document's rank within its segment picks its
interval, shard and slot.

Defined results: null text has size 8 and the CRC of the empty text; a null doc_id is placed by the hash of its
text; repeated rows are separate keys and get their own slots; of keys at one position any order may hold among equal
rows; a text of any length counts by its whole bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read, text_or_empty

SHARDS, VNODES, CELL_BITS = 24, 128, 12
CELLS = 1 << CELL_BITS


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Points (position, shard), ascending; positions are signed 64-bit."""
    spot = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big", signed=True)
    return sorted((spot(s, v), s) for s in range(shards) for v in range(vnodes))


def segments(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(cell, first, last, point): positions first..last lie in one cell and belong to one point."""
    width = 1 << (64 - CELL_BITS)
    at = [p for p, _ in points]
    starts = sorted({c * width for c in range(-CELLS // 2, CELLS // 2)} | {p + 1 for p in at if p < (1 << 63) - 1})
    ends = [*[s - 1 for s in starts[1:]], (1 << 63) - 1]
    return [(a // width, a, b, bisect.bisect_left(at, a) % len(points)) for a, b in zip(starts, ends)]


def settle(counts: dict[int, int], parts: list[tuple[int, int, int, int]], points: list[tuple[int, int]], shards: int, slack: float) -> list[tuple[int, int, int, int, int, int]]:
    """(segment, from_rank, to_rank, shard, first_slot, home) for every interval of ranks."""
    total = sum(counts.values())
    demand = [0] * shards
    for i, n in counts.items():
        demand[points[parts[i][3]][1]] += n
    if slack:
        room = [-(-int(total * (1 + slack)) // shards) + 1] * shards
    else:  # the shards most asked for get the rows that don't divide
        room = [total // shards] * shards
        for s in sorted(range(shards), key=lambda s: (-demand[s], s))[: total % shards]:
            room[s] += 1
    orders: dict[int, list[int]] = {}
    for i in counts:
        p = parts[i][3]
        if p not in orders:
            orders[p] = list(dict.fromkeys(s for _, s in points[p:] + points[:p]))
    waiting, used, out = {i: 0 for i in sorted(counts)}, [0] * shards, []
    for r in range(shards):
        for i in [i for i in waiting if waiting[i] < counts[i]]:
            s = orders[parts[i][3]][r]
            if n := min(room[s] - used[s], counts[i] - waiting[i]):
                out.append((i, waiting[i], waiting[i] + n, s, used[s], orders[parts[i][3]][0]))
                used[s] += n
                waiting[i] += n
    return out


def shard(keys: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """keys with a long column `position` (a hash; rows are read twice) -> the same with shard, slot, home_shard."""
    spark = keys.sparkSession
    points = ring(shards, vnodes)
    parts = segments(points)
    cuts = spark.createDataFrame([(i, c, a, b) for i, (c, a, b, _) in enumerate(parts)], "_segment int, _cell long, _first long, _last long")
    inside = (F.shiftright("position", 64 - CELL_BITS) == F.col("_cell")) & F.col("position").between(F.col("_first"), F.col("_last"))
    placed = keys.join(F.broadcast(cuts), inside).drop("_cell", "_first", "_last")
    counts = {r[0]: r[1] for r in placed.groupBy("_segment").count().collect()}  # at most len(parts) rows
    plan = spark.createDataFrame(settle(counts, parts, points, shards, slack), "_s int, _from long, _to long, shard int, _slot long, home_shard int")
    order = Window.partitionBy("_segment").orderBy("position", *[c for c in keys.columns if c != "position"])
    ranked = placed.withColumn("_rank", F.row_number().over(order) - 1)
    found = (F.col("_segment") == F.col("_s")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(plan), found).select(*keys.columns, "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"), "home_shard")


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    keys = durable(
        read(spark, sf_dir, "documents").select(
            "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
            F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id")).alias("position"),
        )
    )
    return shard(keys).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
