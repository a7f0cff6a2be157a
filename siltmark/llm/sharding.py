"""Sharding by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


def differencing(weights: list[tuple[object, int]], parts: int) -> dict[object, int]:
    """Assign items to parts: the two partial partitions of largest spread are combined in opposite order until one is left.

    Deterministic: ties go by the items' order. An empty list gives an empty assignment.
    """
    heap = []
    for i, (item, w) in enumerate(sorted(weights, key=lambda x: (-x[1], str(x[0])))):
        slots = [(0, [])] * (parts - 1) + [(w, [item])]
        heap.append((-w, i, slots))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted(((x[0] + y[0], x[1] + y[1] if x[1] and y[1] else x[1] or y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda s: s[0])
        low = both[0][0]
        heapq.heappush(heap, (low - both[-1][0], n, [(s - low, m) for s, m in both]))
        n += 1
    return {item: k for k, (_, items) in enumerate(heap[0][2]) for item in items} if heap else {}


def shard_by_bytes(docs: DataFrame, shards: int = 8, bundles: int = 4096, id_col: str = "doc_id", text_col: str = "text", rows_a_block: int = 4096) -> DataFrame:
    """Deal documents to shards of near-equal bytes; equal texts stay together.

    Size is the UTF-8 length plus 1; a null text counts as an empty one and goes with those. Groups of
    over 1/(64 * shards) of all bytes (so fewer than 64 * shards of them) are balanced one by one, the rest in at most
    `bundles` bundles by hash, and differencing runs over those sums only. Returns id, size, text_crc32, shard and slot
    (gapless from 0 in each shard); repeated rows each get a slot; an empty table gives no rows; other columns are dropped.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("_group"),
        )
    )
    n, all_bytes = (int(x or 0) for x in rows.agg(F.count("*"), F.sum("size")).first())
    bundle = F.pmod(F.xxhash64("_group"), F.lit(bundles)).cast("int")
    groups = rows.groupBy("_group").agg(F.sum("size").alias("bytes"))
    heavy = groups.filter(F.col("bytes") * (64 * shards) > all_bytes)
    big = [(bytes(r[0]), int(r[1])) for r in heavy.collect()]
    hot = rows.sparkSession.createDataFrame([(bytearray(g), 0) for g, _ in big], "_group binary, _one int")
    light = rows.join(F.broadcast(hot), "_group", "left_anti")
    small = [(int(r[0]), int(r[1])) for r in light.groupBy(bundle.alias("b")).agg(F.sum("size")).collect()]
    to = differencing(big + small, shards)
    spark = rows.sparkSession
    hot = spark.createDataFrame([(bytearray(g), to[g]) for g, _ in big], "_group binary, _hot int")
    cold = spark.createDataFrame([(b, to[b]) for b, _ in small], "_bundle int, _cold int")
    dealt = (
        rows.withColumn("_bundle", bundle)
        .join(F.broadcast(hot), "_group", "left")
        .join(F.broadcast(cold), "_bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("_hot", "_cold").alias("shard"))
    )
    return numbered(dealt, "shard", "doc_id", max(64, n // rows_a_block), "text_crc32").select("doc_id", "size", "text_crc32", "shard", "slot")


def numbered(df: DataFrame, group: str, by: str, blocks: int, *spread: str) -> DataFrame:
    """Add slot: gapless numbers from 0 in each group. Rows are numbered in blocks by a hash of `by` and the columns of spread, and blocks get running offsets."""
    df = df.withColumn("_block", F.pmod(F.xxhash64(by, *spread, F.lit(7)), F.lit(blocks)).cast("int"))
    counts = df.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    offsets = counts.select(group, "_block", (F.sum("_n").over(Window.partitionBy(group).orderBy("_block")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_block").orderBy(by))
    return df.withColumn("_own", own).join(offsets, [group, "_block"]).withColumn("slot", (F.col("_before") + F.col("_own") - 1).cast("long"))
