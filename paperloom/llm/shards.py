"""Sharding by longest processing time: groups of equal texts go, largest first, to the least-loaded shard."""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.tables import stable


def longest_first(sizes: list[tuple[int, int]], n_shards: int) -> dict[int, list[int]]:
    """How many groups of each size go to each shard, from (size, number of groups).

    The largest first, each to the shard with the least load (a heap). Groups of one size are alike;
    of many, those that fill the shards up to one level are counted rather than put one by one, as
    the heap would put them.
    """
    load, put = [0] * n_shards, {}
    for size, count in sorted(sizes, reverse=True):
        given = [0] * n_shards
        if count > 2 * n_shards:
            up_to = lambda level: [max(0, -(-(level - x) // size)) for x in load]  # noqa: B023, E731
            low, high = min(load), max(load) + size * count
            while low < high:  # the highest level that they can fill
                middle = (low + high + 1) // 2
                low, high = (middle, high) if sum(up_to(middle)) <= count else (low, middle - 1)
            given = up_to(low)
        heap = [(x + size * g, s) for s, (x, g) in enumerate(zip(load, given))]
        heapq.heapify(heap)
        for _ in range(count - sum(given)):
            x, s = heapq.heappop(heap)
            given[s] += 1
            heapq.heappush(heap, (x + size, s))
        load = [x + size * g for x, g in zip(load, given)]
        put[size] = given
    return put


def lpt_shards(docs: DataFrame, n_shards: int = 16, salts: int = 64) -> DataFrame:
    """Shard and slot of every document, equal texts together, the shards' bytes near equal.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law ('bytes'), shard, slot (gapless from 0
    within the shard), grown_shard (null). Every group is scheduled by its size; groups of one size
    are alike, so what comes to the driver is the number of groups of each size, not the groups. They
    take the places of their size in the order of (salt, hash), ranked in ``salts`` pieces a size;
    slots are counted in as many pieces a shard and stretch of hashes.

    A null text counts as empty: size 1, one group with the empty texts. Repeated rows get slots of
    their own. Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = stable(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("_group")))
    salt = F.pmod(F.xxhash64("_group"), F.lit(salts))
    groups = stable(narrow.groupBy("_group").agg(F.sum("size").alias("_bytes")).withColumn("_salt", salt))
    pieces = groups.groupBy("_bytes", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    sizes = [(r["_bytes"], r["_n"]) for r in pieces.groupBy("_bytes").agg(F.sum("_n").alias("_n")).collect()]  # one row a distinct size
    put = longest_first(sizes, n_shards)
    bounds = spark.createDataFrame([(size, list(accumulate(given))) for size, given in put.items()], "_bytes long, _bounds array<long>")
    earlier = Window.partitionBy("_bytes").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(bounds, "_bytes").drop("_n")
    rank = F.row_number().over(Window.partitionBy("_bytes", "_salt").orderBy("_group")) - 1
    ranked = groups.withColumn("_rank", rank).join(pieces, ["_bytes", "_salt"])
    shard = F.size(F.filter("_bounds", lambda b: b <= F.col("_before") + F.col("_rank")))
    placed = stable(narrow.join(ranked.select("_group", shard.alias("shard")), "_group").drop("_group"))
    slot_pieces = max(salts, placed.count() // (n_shards * 100_000))
    placed = placed.withColumn("_piece", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slot_pieces)))
    counts = placed.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("doc_id", "text_crc32"))
    return placed.join(offsets, ["shard", "_piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + at - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
