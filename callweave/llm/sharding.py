"""Sharding by a minimax contiguous partition (DataFrame operations only).

Documents with equal texts are one atomic group. Groups are ordered by a
128-bit hash of their text, so fixed ranges of the hash are an even, sample-free
range partition, and the order of a document can be read from its own text.
The smallest capacity that ``n_shards`` contiguous shards need is found by
search over the groups' running sizes: each round tries ``probes`` capacities
at once, walking them greedily, one aggregation a shard. The seven cut groups
then place every document by comparing hashes; no join with the groups is made.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._support import Scratch

#: Rows that one window partition is meant to hold, and the most partitions.
ROWS_A_BUCKET, MOST_BUCKETS = 50_000, 1 << 16


def _bits(rows: int) -> int:
    return min(int(math.log2(MOST_BUCKETS)), max(4, math.ceil(math.log2(max(1, rows) / ROWS_A_BUCKET + 1))))


def smallest_capacity(prefix: DataFrame, total: int, largest: int, n_shards: int, probes: int = 15) -> tuple[int, list[int]]:
    """The least feasible capacity and the running size at each cut.

    ``prefix`` has ``end``, the running size at the end of each group. Any two
    neighbouring ends differ by at most ``largest``, so the last end at or below
    a bound lies within ``largest`` below it: that window is all a step reads.
    """

    def walk(capacities: list[int]) -> list[list[int]]:
        at, cuts = [0] * len(capacities), [[] for _ in capacities]
        for _ in range(n_shards):
            bounds = [p + c for p, c in zip(at, capacities, strict=True)]
            if min(at) >= total:
                break
            found = prefix.where(F.col("end").between(min(bounds) - largest, max(bounds))).agg(*(F.max(F.expr(f"CASE WHEN end <= {x} THEN end END")).alias(f"c{i}") for i, x in enumerate(bounds))).first()
            at = [total if x >= total else max(p, y or 0) for p, x, y in zip(at, bounds, found, strict=True)]
            for own, p in zip(cuts, at, strict=True):
                own.append(p)
        return cuts

    low = max(-(-total // n_shards), largest)
    high = -(-total // n_shards) + largest
    best: list[int] | None = None
    while low < high or best is None:
        span = high - low
        tried = sorted({low + span * i // probes for i in range(probes + 1)})
        ways = walk(tried)
        ok = next(i for i, cuts in enumerate(ways) if cuts and cuts[-1] >= total)
        best, high = ways[ok], tried[ok]
        low = tried[ok - 1] + 1 if ok else high
    return high, best


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every document.

    Returns one row for each row of ``docs``: id_col, size (UTF-8 bytes plus 1;
    a null text has none, so 1), text_crc32 (of a null text: of no bytes), shard
    (0 to n_shards - 1) and slot (gapless from 0 in each shard, by document id
    within hashed buckets). Null and empty texts are one group. Repeated rows
    are rows of their own. Fewer groups than shards leave shards empty; an empty
    table gives an empty table. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = scratch.save(docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2")))
    rows = keys.count()
    bits = _bits(rows)
    bucket = F.shiftright("g1", 64 - bits)  # arithmetic, so buckets ascend with g1

    sums = keys.groupBy(bucket.alias("b")).agg(F.sum("size").alias("bytes"))
    offsets = sums.select("b", (F.sum("bytes").over(Window.orderBy("b")) - F.col("bytes")).alias("before"))
    groups = keys.groupBy("g1", "g2").agg(F.sum("size").alias("bytes")).withColumn("b", bucket)
    inside = F.sum("bytes").over(Window.partitionBy("b").orderBy("g1", "g2"))
    # at most MOST_BUCKETS rows of two longs: a proven bound
    prefix = scratch.save(groups.join(F.broadcast(offsets), "b").select("g1", "g2", "bytes", (F.col("before") + inside).alias("end")))

    total, largest = prefix.agg(F.sum("bytes"), F.max("bytes")).first()
    shard = F.lit(0)
    if total:
        _, cuts = smallest_capacity(prefix, total, largest, n_shards)
        inner = sorted({c for c in cuts if c < total})
        ends = {r.end: (r.g1, r.g2) for r in prefix.where(F.col("end").isin(inner)).select("end", "g1", "g2").collect()} if inner else {}
        after = [(F.col("g1") > k1) | ((F.col("g1") == k1) & (F.col("g2") > k2)) for k1, k2 in ends.values()]
        shard = reduce(lambda a, b: a + b.cast("int"), after, shard)

    placed = keys.select("*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64(id_col, "g2"), F.lit(1 << bits)).alias("_slot_bucket"))
    counts = placed.groupBy("shard", "_slot_bucket").count()
    starts = counts.select("shard", "_slot_bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("_slot_bucket")) - F.col("count")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("shard", "_slot_bucket").orderBy(F.col(id_col), "g1", "g2"))
    # at most n_shards * MOST_BUCKETS rows
    slots = placed.join(F.broadcast(starts), ["shard", "_slot_bucket"])
    return slots.select(F.col(id_col), "size", "text_crc32", "shard", (F.col("_start") + within - 1).cast("long").alias("slot"))


def op7_minimax_shards(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`shard_documents`: law ``bytes``."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
