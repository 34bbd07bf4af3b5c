"""Sharding by longest-processing-time scheduling of groups that stay together.

All groups are sorted by size over range partitions. The driver's heap schedules them class by class: groups of one size are
alike, so of each class it needs their number only, and says how many go to each shard. Distinct sizes sum up to the
bytes of all groups at most, so there are no more than sqrt(2 * bytes) classes, however many groups. A group's rank among
those of its size picks its shard; ranks and slots are counted within range partitions, so no size, group or shard is one task's.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, numbered, saved


def schedule(items: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """Longest processing time first: each item, by size downwards and then by key, goes to the least-loaded shard, the lowest number on ties."""
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` items of one size each shard gets when each goes to the least-loaded one, the lowest number on ties."""
    out = [0] * len(loads)
    if size == 0:
        out[loads.index(min(loads))] = count
        return out
    if count > 4 * len(loads):
        # Shard i takes items at the loads L, L + size, ...: the `count` smallest of all these are taken. Those under a level at once:
        low, high = min(loads), max(loads) + size * (count // len(loads) + 1)
        under = lambda level: [max(0, -(-(level - x) // size)) for x in loads]
        while low < high:
            level = (low + high + 1) // 2
            low, high = (level, high) if sum(under(level)) <= count else (low, level - 1)
        out = under(low)
    heap = [(x + n * size, i) for i, (x, n) in enumerate(zip(loads, out, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(out)):
        load, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (load + size, i))
    return out


def _in_ranges(scratch: Scratch, df: DataFrame, order: list[Column], ties: list[str], name: str) -> DataFrame:
    """df, sorted by order over range partitions and saved, with part: the number of its partition."""
    spread = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order, *ties)
    return scratch.saved(spread.withColumn("part", F.spark_partition_id()), name)


def lpt_shards(rows: DataFrame, shards: int, size: str, group: Column, order: list[str]) -> DataFrame:
    """The rows with shard (0 to shards - 1) and slot (from 0 without gaps in each shard, by the order columns).

    Rows of equal, non-null `group` (a binary key) stay together; a row with a null group is a group of its own.
    Groups of equal size are dealt by key, such rows by a hash of their order columns; equal rows
    take neighbouring slots in any order. A size is a whole number of at least 0. No rows give no rows.
    """
    spark, columns = rows.sparkSession, rows.columns
    own = F.concat(F.unhex(F.md5(F.to_json(F.struct(*order)))), F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")))
    plain = rows.select(*(F.col(c).alias(n) for c, n in zip(columns, numbered(rows).columns, strict=True)), F.coalesce(group, own).alias("key"), F.col(size).cast("long").alias("size"))
    ranks = [f"c{columns.index(c)}" for c in order]
    with Scratch() as scratch:
        keyed = scratch.saved(plain, "keyed")
        groups = keyed.groupBy("key").agg(F.sum("size").alias("size"))
        groups = _in_ranges(scratch, groups, [F.desc("size")], ["key"], "groups")
        # One row for each size, and one more for each partition that goes on with a size.
        pieces = groups.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["size", "part"], ascending=[False, True], ignore_index=True)
        loads, upto = [0] * shards, []
        for many in pieces.groupby("size", sort=False)["n"].sum().items():
            given = deal(loads, int(many[0]), int(many[1]))
            loads = [x + int(many[0]) * n for x, n in zip(loads, given, strict=True)]
            upto.append(np.cumsum(given).tolist())
        by_size = pieces.groupby("size", sort=False)
        pieces["before"] = by_size["n"].cumsum() - pieces["n"]
        pieces["upto"] = [upto[i] for i in by_size.ngroup()]
        placed = spark.createDataFrame(pieces[["size", "part", "before", "upto"]] if len(pieces) else [], "size long, part int, before long, upto array<long>")
        rank = F.row_number().over(Window.partitionBy("size", "part").orderBy("key")) - 1
        ranked = groups.withColumn("rank", rank).join(placed, ["size", "part"])
        shard = F.size(F.filter("upto", lambda x: x <= F.col("before") + F.col("rank")))
        of = scratch.saved(ranked.select("key", shard.cast("int").alias("shard")), "shards")
        spread = _in_ranges(scratch, keyed.join(of, "key").drop("key", "size").withColumn("at", F.monotonically_increasing_id()), [F.col("shard")], [*ranks, "at"], "spread")
        counts = spread.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["shard", "part"], ignore_index=True)  # one for each shard and partition that goes on with one
        counts["base"] = counts.groupby("shard")["n"].cumsum() - counts["n"]
        bases = spark.createDataFrame(counts[["shard", "part", "base"]] if len(counts) else [], "shard int, part int, base long")
        slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*ranks, "at")) - 1
        done = spread.withColumn("slot", slot).join(F.broadcast(bases), ["shard", "part"]).withColumn("slot", F.col("slot") + F.col("base"))
        out = saved(done.select(*(f"c{i}" for i in range(len(columns))), "shard", "slot"), "sharded")
    return out.toDF(*columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents in shards of nearly equal bytes; equal texts stay together.

    size: UTF-8 bytes of the text plus 8 (null: 8); text_crc32 of a null text: 0. A null text is a group of its own.
    """
    text = F.col("text")
    features = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text)).alias("digest"),
    )
    out = lpt_shards(features, shards, "size", F.col("digest"), ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
