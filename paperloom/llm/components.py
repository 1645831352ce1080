"""Components of an edge table with all their members, for the joins of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.components import connected_components

__all__ = ["component_members", "connected_components"]


def component_members(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, the smallest of each component included."""
    roots = connected_components(edges)
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
