"""Sharding (operator 5): longest-processing-time scheduling of groups that stay together.

Groups are rows of equal text. Sizes are added up by group, map-side first; a group of at least 1/`fine` of a shard is
scheduled for itself, smaller ones are bundled by their hash into a fixed number of bundles. So at most
n * fine + bundles sizes reach the driver, however many texts there are: sorted by size, each goes to the least-loaded
shard, which a heap gives. A shard's slots are dealt by adding up counts of chunks of its rows, so no task holds a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import save


def schedule(sizes: list[tuple], n: int) -> list[tuple[int, int]]:
    """(key, shard) of (key, size): longest first, to the least-loaded shard; ties by key and by shard."""
    heap = [(0, s) for s in range(n)]
    out = []
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out.append((key, s))
        heapq.heappush(heap, (load + size, s))
    return out


def shard(docs: DataFrame, n: int = 40, *, fine: int = 50, bundles: int = 8192, overhead: int = 16, chunks: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs (doc_id, text).

    Law `bytes`: sizes are near equal, unless one group alone is larger than a shard's share; it stays together all the
    same. Null and empty texts are one group. Rows that are alike get slots of their own. Within a shard, slots are
    gapless from 0. Texts are told apart by a 64-bit hash and length; two that share both only stay together needlessly.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = save(
        docs.select(
            "doc_id",
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text, F.octet_length(text)).alias("g"),
            F.monotonically_increasing_id().alias("r"),
        ),
        "shard",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = max(1, total // (n * fine))
    own = rows.groupBy("g").agg(F.sum("size").alias("bytes"))
    small = F.pmod(F.xxhash64(F.lit(11), "g"), F.lit(bundles))
    # Bundles have keys below 0, groups of their own are known by g.
    kinds = own.select("g", "bytes", F.when(F.col("bytes") >= large, F.lit(-1)).otherwise(small).alias("bundle"))
    sizes = kinds.groupBy("bundle", F.when(F.col("bundle") < 0, F.col("g")).alias("own")).agg(F.sum("bytes").alias("bytes"))
    got = [((b, o or 0), s) for b, o, s in sizes.collect()]
    plan = schedule(got, n)
    ours = F.broadcast(spark.createDataFrame([(o, s) for (b, o), s in plan if b < 0], "g long, own_shard int"))
    theirs = F.broadcast(spark.createDataFrame([(b, s) for (b, _), s in plan if b >= 0], "bundle long, bundle_shard int"))
    placed = rows.withColumn("bundle", small).join(ours, "g", "left").join(theirs, "bundle", "left")
    placed = placed.select("doc_id", "size", "text_crc32", "r", F.coalesce("own_shard", "bundle_shard").alias("shard"))
    # Chunks follow the row's own number: copies and hot ids are spread, and about equal numbers of rows meet.
    chunks = chunks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("r"), F.lit(chunks)).cast("int"))
    begin = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(begin), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "r")
    dealt = placed.withColumn("i", F.row_number().over(within) - 1).join(starts, ["shard", "chunk"])
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("i")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
