"""Eras, milestones, timelines and landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scores import era_label

WIDTHS = (1, 3, 5, 10)


def era_width(works: DataFrame, by: str) -> DataFrame:
    """(by, width): 1, 3, 5 or 10 years by the span between the quartile entries, wider until six eras do."""
    years = works.where(F.col("year").isNotNull()).groupBy(by, "year").agg(F.count(F.lit(1)).alias("_c"))
    within = Window.partitionBy(by)
    placed = years.withColumn("_end", F.sum("_c").over(within.orderBy("year"))).withColumn("_n", F.sum("_c").over(within))
    at = lambda i: F.min(F.when(F.col("_end") > i, F.col("year")))  # noqa: E731 - the entry i of all years in order
    n = F.col("_n")
    counted = placed.groupBy(by).agg(F.collect_list("year").alias("_y"), F.max("_n").alias("_n"), at(F.floor(n / 4)).alias("_low"), at(F.floor(3 * n / 4)).alias("_high"), F.min("year").alias("_first"), F.max("year").alias("_last"))
    span = F.when(n >= 4, F.col("_high") - F.col("_low")).otherwise(F.col("_last") - F.col("_first")) + 1
    first = F.when(span <= 4, 1).when(span <= 12, 3).when(span <= 25, 5).otherwise(10)
    eras = lambda w: F.size(F.array_distinct(F.transform("_y", lambda y: F.floor(y / w))))
    width = F.when(first == 10, 10)
    for w in WIDTHS:
        width = width.when((first <= w) & (eras(w) <= 6), w)
    return counted.select(by, width.otherwise(10).alias("width"))


def milestones(works: DataFrame, by: list[str], percentile: float = 0.9, least_cites: int = 100) -> DataFrame:
    """Works at or above the entry at n x percentile of their era's citations, and above ``least_cites``."""
    era = Window.partitionBy(*by)
    i = F.row_number().over(era.orderBy("cited_by_count")) - 1
    n = F.count(F.lit(1)).over(era)
    rows = works.withColumn("_i", i).withColumn("_at", F.least(F.floor(n * percentile), n - 1))
    edge = F.max(F.when(F.col("_i") == F.col("_at"), F.col("cited_by_count"))).over(era)
    return rows.withColumn("_edge", edge).where((F.col("cited_by_count") >= F.col("_edge")) & (F.col("cited_by_count") > least_cites)).drop("_i", "_at", "_edge")


def temporal_map(works: DataFrame, by: str) -> DataFrame:
    """(by, era, n, rank, work_id, year, cited_by_count): works of each era in rows, the most cited first."""
    rows = works.join(era_width(works, by), by, "left").withColumn("era", era_label(F.col("year"), F.coalesce("width", F.lit(10))))
    era = Window.partitionBy(by, "era")
    ranked = rows.withColumn("rank", F.row_number().over(era.orderBy(F.desc("cited_by_count"), "work_id"))).withColumn("n", F.count(F.lit(1)).over(era))
    return ranked.select(by, "era", "n", "rank", "work_id", "year", "cited_by_count")


def node_timeline(parts: DataFrame, width: int = 5) -> DataFrame:
    """(node_id, era, start, work_ids): works around a node by era, each once, eras ascending, unknown last.

    ``parts``: node_id, relation, work_id, year. A work's first relation in the order reference, landmark, citing counts.
    """
    order = F.when(F.col("relation") == "reference", 0).when(F.col("relation") == "landmark", 1).otherwise(2)
    one = parts.groupBy("node_id", "work_id", "year").agg(F.min_by("relation", order).alias("relation"))
    era = one.withColumn("era", era_label(F.col("year"), width)).withColumn("start", F.coalesce((F.col("year") - F.pmod(F.col("year"), F.lit(width))).cast("int"), F.lit(9999)))
    return era.groupBy("node_id", "era", "start").agg(F.sort_array(F.collect_list("work_id")).alias("work_ids"))


def grounding_needs(counts: DataFrame, references: int = 2, landmarks: int = 3, total: int = 5) -> DataFrame:
    """Shortfall of references, landmarks and of the whole. ``counts``: node_id, n_references, n_landmarks."""
    short = lambda n, least: F.greatest(F.lit(least) - n, F.lit(0))
    r, m = F.coalesce("n_references", F.lit(0)), F.coalesce("n_landmarks", F.lit(0))
    return counts.select("node_id", short(r, references).alias("need_references"), short(m, landmarks).alias("need_landmarks"), short(r + m, total).alias("need_total"))


def topic_landmarks(works: DataFrame, by: str, before: int) -> DataFrame:
    """(by, period, work_id): the most cited work of each of k equal periods of a topic's span.

    k = 3 + log2 of a fifth of the span, rounded half-even, within 3 and 6. A period reaches one year
    into the next. Topics whose years agree have one period of all their works.
    """
    known = works.where(F.col("year").isNotNull())
    span = known.groupBy(by).agg(F.min("year").alias("_a"), F.coalesce(F.max(F.when(F.col("year") < before, F.col("year"))), F.max("year")).alias("_b"))
    k = F.greatest(F.lit(3), F.least(F.lit(6), F.bround(3 + F.log2(F.greatest(F.lit(1.0), (F.col("_b") - F.col("_a")) / 5)), 0))).cast("int")
    periods = span.where("_b > _a").withColumn("_k", k).select(by, "_a", ((F.col("_b") - F.col("_a")) / F.col("_k")).alias("_len"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("period"))
    start = F.col("_a") + F.col("period") * F.col("_len")
    inside = known.join(periods, by).where((F.col("year") >= start) & (F.col("year") < start + F.col("_len") + 1) & (F.col("year") < before))
    return inside.groupBy(by, "period").agg(F.max_by("work_id", F.struct(F.col("cited_by_count"), -F.col("work_id"))).alias("work_id"))
