"""Replay of a least-recently-used cache over a log of any length, exact and without one task that reads it all.

What a cache of ``capacity`` keys holds at some access are the ``capacity`` keys used last before it. The log is numbered and cut into
blocks. The keys used last in 2, 4, 8, ... blocks follow from those of their halves, so what the cache holds at the start
of a block comes from a logarithmic number of such lists; from there each block is replayed by itself.
"""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.operators import numbering
from docstrata.sources.shared import stored


def _last(rows: DataFrame, group: str, capacity: int) -> DataFrame:
    """The ``capacity`` keys used last in each group, with the place of that use."""
    used = rows.groupBy(group, "key").agg(F.max("pos").alias("pos"))
    recent = Window.partitionBy(group).orderBy(F.desc("pos"))
    return used.withColumn("r", F.row_number().over(recent)).where(F.col("r") <= capacity).drop("r")


def replay(accesses: DataFrame, capacity: int, *, key_col: str = "key", order_col: str = "at", block_rows: int | None = None) -> DataFrame:
    """``order_col``, ``key_col``, ``hit``, and ``evicted``, the key that the access pushed out, for each access.

    ``accesses`` are taken by ``order_col`` (unique). A key that the cache lacks is put into it; each use makes a key the newest;
    beyond ``capacity`` keys the oldest goes. Null keys are never held: no hit, nothing evicted. A task holds the cache of one
    block, and blocks have ten times its size, or ``block_rows``.
    """
    if capacity < 1:
        raise ValueError("a cache holds at least one key")
    spark, size = accesses.sparkSession, block_rows or max(100_000, 10 * capacity)
    kind = accesses.schema[order_col].dataType.simpleString()
    numbered = numbering.row_numbers(accesses.select(F.col(order_col).alias("at"), F.col(key_col).cast("string").alias("key")), "at", "pos")
    log = stored(numbered.select("at", "key", "pos", F.floor((F.col("pos") - 1) / size).alias("block")))
    blocks = 1 + (log.agg(F.max("block").alias("b")).first()["b"] or 0)
    levels = [stored(_last(log.where("key IS NOT NULL"), "block", capacity).withColumn("level", F.lit(0)))]
    while blocks >> len(levels):
        halves = levels[-1].select(F.floor(F.col("block") / 2).alias("block"), "key", "pos")
        levels.append(stored(_last(halves, "block", capacity).withColumn("level", F.lit(len(levels)))))
    lists = levels[0]
    for more in levels[1:]:
        lists = lists.unionByName(more)
    # the blocks before b are one run of 2**level blocks for each bit of b that is set
    bits = F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))).alias("level")
    runs = spark.range(blocks).select(F.col("id").alias("start"), bits).withColumn("cut", F.floor(F.col("start") / F.pow(F.lit(2), "level")).cast("long")).where("cut % 2 = 1")
    before = runs.select("start", "level", (F.col("cut") - 1).alias("block")).join(lists, ["level", "block"]).select(F.col("start").alias("block"), "key", "pos")
    held = _last(before, "block", capacity).select("block", F.lit(False).alias("asks"), "pos", "key", F.lit(None).cast(kind).alias("at"))
    both = held.unionByName(log.select("block", F.lit(True).alias("asks"), "pos", "key", "at"))

    def run(batches):
        now, cache = None, OrderedDict()
        for batch in batches:
            keep, hits, gone = [], [], []
            for i, (block, asks, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "asks", "key")))):
                if block != now:
                    now, cache = block, OrderedDict()
                hit, out = key in cache, None
                if key is not None:
                    cache[key] = True
                    cache.move_to_end(key)
                    if len(cache) > capacity:
                        out = cache.popitem(last=False)[0]
                if asks:
                    keep.append(i)
                    hits.append(hit)
                    gone.append(out)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("at"), rows.column("key"), pa.array(hits, pa.bool_()), pa.array(gone, pa.string())], names=["at", "key", "hit", "evicted"])

    out = both.repartition(blocks, "block").sortWithinPartitions("block", "asks", "pos").mapInArrow(run, f"at {kind}, key string, hit boolean, evicted string")
    return out.select(F.col("at").alias(order_col), F.col("key").alias(key_col), "hit", "evicted")


def contents(accesses: DataFrame, capacity: int, *, key_col: str = "key", order_col: str = "at") -> DataFrame:
    """``key_col`` and ``order_col`` of the last use of what the cache holds after all accesses."""
    used = accesses.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(F.max(order_col).alias(order_col))
    return used.orderBy(F.desc(order_col)).limit(capacity)
