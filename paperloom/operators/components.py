"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.tables import stable


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    ``edges`` has two columns of one type that can be ordered; order and repeats don't matter, nulls
    link nothing. Nodes may be structs: with a priority as the first field, the root is the member of
    the least priority. A round links every
    larger neighbour to the smallest one, then every node's smaller neighbours to the smallest of
    them; edges never multiply, a hub is met by map-side minima and a join that Spark can split,
    and each round's edges are written to the checkpoint folder. It ends when nothing changes.
    """
    a, b = edges.columns
    both = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = stable(both.distinct())
    mark = _mark(current)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        near = current.union(current.select("v", "u"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hub = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(hub, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stable(small.union(hub.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(current)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
