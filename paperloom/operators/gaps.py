"""Gap detection in maps of works, for all maps at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.similar import keep_first, similar_sets
from paperloom.tables import stable


def top(df: DataFrame, by: str, score: str, k: int, *ties: str) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(score), *ties)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def structural_gaps(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(map_id, a, b, similarity, density, gap_score): cluster pairs that share topics but few citations.

    ``nodes``: map_id, cluster, work_id, topics (array); ``edges``: map_id, from_id, to_id.
    Similarity is the Jaccard similarity of the clusters' topic sets, at least 0.10.
    """
    clusters = nodes.groupBy("map_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set("topics"))).alias("t")).where("n >= 2")
    x = clusters.select("map_id", F.col("cluster").alias("a"), F.col("n").alias("na"), F.col("t").alias("ta"))
    y = clusters.select("map_id", F.col("cluster").alias("b"), F.col("n").alias("nb"), F.col("t").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    pairs = x.join(y, "map_id").where("a < b").withColumn("similarity", both / F.greatest(F.size("ta") + F.size("tb") - both, F.lit(1)))
    of = nodes.select("map_id", F.col("work_id").alias("from_id"), F.col("cluster").alias("_ca"))
    to = nodes.select("map_id", F.col("work_id").alias("to_id"), F.col("cluster").alias("_cb"))
    cross = edges.join(of, ["map_id", "from_id"]).join(to, ["map_id", "to_id"]).where("_ca != _cb").groupBy("map_id", F.least("_ca", "_cb").alias("a"), F.greatest("_ca", "_cb").alias("b")).agg(F.count(F.lit(1)).alias("_x"))
    found = pairs.join(cross, ["map_id", "a", "b"], "left").withColumn("density", F.coalesce("_x", F.lit(0)) / (F.col("na") * F.col("nb") * 2))
    found = found.withColumn("gap_score", F.col("similarity") * (1 - F.col("density"))).where("similarity >= 0.10 AND gap_score > 0.15")
    return top(found, "map_id", "gap_score", k, "a", "b").select("map_id", "a", "b", "similarity", "density", "gap_score")


def coverage_gaps(nodes: DataFrame, k: int = 10) -> DataFrame:
    """(map_id, topic, count, gap_score): topics with far fewer works than the map's others.

    A topic of one work counts only if it has half the mean citations a topic.
    """
    n = nodes.groupBy("map_id", "topic").agg(F.count(F.lit(1)).alias("count"), F.sum("cited_by_count").alias("_c"))
    m = Window.partitionBy("map_id")
    n = n.withColumn("_mean", F.avg("count").over(m)).withColumn("_sd", F.stddev_pop("count").over(m)).withColumn("_total", F.sum("count").over(m)).withColumn("_cm", F.avg("_c").over(m))
    z = (F.col("_mean") - F.col("count")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    n = n.withColumn("_z", z).withColumn("gap_score", F.least(F.col("_z") / 2, F.lit(1.0)))
    least = F.when(F.col("_total") < 50, 0.20).otherwise(0.30)
    kept = n.where((F.col("_z") > 0) & ((F.col("count") > 1) | (F.col("_c") >= 0.5 * F.col("_cm"))) & (F.col("gap_score") > least))
    return top(kept, "map_id", "gap_score", k, "topic").select("map_id", "topic", "count", "gap_score")


def yearly(nodes: DataFrame) -> DataFrame:
    """(map_id, year, n, local): works a year over the map's span, years without works included, with the mean of five years around."""
    n = nodes.where(F.col("year").isNotNull()).groupBy("map_id", "year").agg(F.count(F.lit(1)).alias("n"))
    spine = n.groupBy("map_id").agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    around = Window.partitionBy("map_id").orderBy("year").rangeBetween(-2, 2)
    return spine.join(n, ["map_id", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("local", F.avg("n").over(around))


def temporal_gaps(nodes: DataFrame, k: int = 10) -> DataFrame:
    """(map_id, start_year, end_year, rate, reference, gap_score, comeback): runs of two quiet years or more.

    Maps need 15 works and a span of three years. A year is quiet below 0.4 of its local mean, where
    that is above 0.5. A comeback has a lively year within three on either side.
    """
    y = yearly(nodes)
    m, o = Window.partitionBy("map_id"), Window.partitionBy("map_id").orderBy("year")
    y = y.withColumn("_papers", F.sum("n").over(m)).withColumn("_span", F.count(F.lit(1)).over(m)).where("_papers >= 15 AND _span >= 4")
    y = y.withColumn("_low", (F.col("n") < 0.4 * F.col("local")) & (F.col("local") > 0.5)).withColumn("_lively", F.col("n") > 0.5 * F.col("local"))
    y = y.withColumn("_before", F.coalesce(F.max("_lively").over(o.rangeBetween(-3, -1)), F.lit(False))).withColumn("_after", F.coalesce(F.max("_lively").over(o.rangeBetween(1, 3)), F.lit(False)))
    runs = y.where("_low").withColumn("_island", F.col("year") - F.row_number().over(o)).groupBy("map_id", "_island", "_papers", "_span").agg(
        F.min("year").alias("start_year"), F.max("year").alias("end_year"), F.avg("n").alias("rate"), F.min_by("_before", "year").alias("_b"), F.max_by("_after", "year").alias("_a")
    )
    runs = runs.where("end_year > start_year").withColumn("_mid", F.floor((F.col("start_year") + F.col("end_year")) / 2).cast("int"))
    mid = y.select("map_id", F.col("year").alias("_mid"), F.col("local").alias("_local"))
    per = F.col("_papers") / F.col("_span")
    runs = runs.join(mid, ["map_id", "_mid"]).withColumn("reference", F.greatest("_local", 0.5 * per))
    score = F.when(F.col("reference") > 0, (F.col("reference") - F.col("rate")) / F.col("reference")).otherwise(0.0) * F.least(per / 2, F.lit(1.0))
    found = runs.withColumn("gap_score", score).where("gap_score > 0.3").withColumn("comeback", F.col("_b") & F.col("_a"))
    return top(found, "map_id", "gap_score", k, "start_year").select("map_id", "start_year", "end_year", "rate", "reference", "gap_score", "comeback")


def empty_cells(fingerprints: DataFrame, k: int = 10) -> DataFrame:
    """(map_id, method, domain, density, gap_score): method and domain, each with two works or more, that no work joins."""
    f = fingerprints.where("method != 'unknown' AND domain != 'unknown'").select("map_id", "method", "domain")
    axis = lambda c: fingerprints.where(f"{c} != 'unknown'").groupBy("map_id", c).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("map_id", c)
    methods, domains = axis("method"), axis("domain")
    wide = lambda a, c: a.withColumn("_w", F.count(F.lit(1)).over(Window.partitionBy("map_id"))).where("_w >= 2").select("map_id", c)
    grid = wide(methods, "method").join(wide(domains, "domain"), "map_id")  # two short axes
    cells = f.groupBy("map_id", "method", "domain").agg(F.count(F.lit(1)).alias("n"))
    full = grid.join(cells, ["map_id", "method", "domain"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row, col = F.sum("n").over(Window.partitionBy("map_id", "method")), F.sum("n").over(Window.partitionBy("map_id", "domain"))
    found = full.withColumn("_row", row).withColumn("_col", col).where("n = 0 AND _row >= 1 AND _col >= 1").withColumn("density", F.sqrt((F.col("_row") * F.col("_col")).cast("double")))
    found = found.withColumn("gap_score", F.least(F.col("density") / 5, F.lit(1.0))).where("gap_score > 0.3")
    return top(found, "map_id", "gap_score", k, "method", "domain").select("map_id", "method", "domain", "density", "gap_score")


def novelty_gaps(assessed: DataFrame, as_of: int, k: int = 10) -> DataFrame:
    """(map_id, cluster, avg_novelty, max_novelty, gap_score): active clusters without much that is new. ``assessed``: map_id, cluster, novelty, year."""
    recent = F.count_if(F.col("year") >= as_of - 5)
    g = assessed.groupBy("map_id", "cluster").agg(F.count(F.lit(1)).alias("_n"), F.avg("novelty").alias("avg_novelty"), F.max("novelty").alias("max_novelty"), recent.alias("_recent"))
    g = g.where("_n >= 3 AND _recent > 0 AND avg_novelty < 0.5 AND max_novelty < 0.75").withColumn("gap_score", (1 - F.col("max_novelty")) * (0.5 + 0.5 * F.col("_recent") / F.col("_n"))).where("gap_score > 0.25")
    return top(g, "map_id", "gap_score", k, "cluster").select("map_id", "cluster", "avg_novelty", "max_novelty", "gap_score")


def detect_all(found: dict[str, DataFrame]) -> DataFrame:
    """(map_id, kind, gap_score, detail): the detectors' outputs as one table, details as JSON."""
    out = None
    for kind, df in found.items():
        rest = [c for c in df.columns if c not in ("map_id", "gap_score")]
        part = df.select("map_id", F.lit(kind).alias("kind"), "gap_score", F.to_json(F.struct(*rest)).alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


def dedupe_gaps(gaps: DataFrame) -> DataFrame:
    """Gaps (map_id, gap_id, gap_score, words, evidence) without those like a better one of the map that stays.

    Alike: more than half of the smaller evidence set is shared, or the Jaccard similarity of the title
    words is above 0.5. Better is the higher score, of equal ones the smaller gap_id.
    """
    rows = stable(gaps.select("map_id", "gap_id", "gap_score", (-F.col("gap_score")).alias("_o"), "words", "evidence"))
    by = ["map_id"]
    alike = similar_sets(rows, by, "gap_id", "evidence", 50, strict=True, contained=True).unionByName(similar_sets(rows, by, "gap_id", "words", 50, strict=True))
    return keep_first(rows, alike, by, "gap_id", ["_o"]).select("map_id", "gap_id", "gap_score")


def map_rollup(nodes: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """(map_id, section, place, key, n, works): what a map is made of, as rows of its sections.

    ``nodes``: map_id, work_id, topic_id, year, cited_by_count; ``names``: topic_id, name. Section ``cluster`` has
    a row for each topic by size (a null topic is 'uncategorized'), by name where there is one, with its first
    ``k`` works by work_id; ``year`` one for each year in order (none for null or 0), ``top`` the ``k`` most cited
    works. n is the number of works, in ``top`` of citations. Whole maps never lie in one row: lists are cut before they are gathered.
    """
    topic = F.coalesce("topic_id", F.lit("uncategorized"))
    n = nodes.select("map_id", "work_id", topic.alias("topic_id"))
    first = n.withColumn("_r", F.row_number().over(Window.partitionBy("map_id", "topic_id").orderBy("work_id"))).where(F.col("_r") <= k)
    lists = first.groupBy("map_id", "topic_id").agg(F.array_join(F.sort_array(F.collect_list("work_id")), ", ").alias("works"))
    clusters = n.groupBy("map_id", "topic_id").agg(F.count(F.lit(1)).alias("n")).join(lists, ["map_id", "topic_id"]).join(names.groupBy("topic_id").agg(F.min("name").alias("name")), "topic_id", "left")
    by_size = F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("n"), "topic_id"))
    out = clusters.select("map_id", F.lit("cluster").alias("section"), by_size.alias("place"), F.coalesce("name", "topic_id").alias("key"), "n", "works")
    nothing = F.lit(None).cast("string")
    years = nodes.where(F.coalesce("year", F.lit(0)) != 0).groupBy("map_id", "year").agg(F.count(F.lit(1)).alias("n"))
    out = out.union(years.select("map_id", F.lit("year"), F.row_number().over(Window.partitionBy("map_id").orderBy("year")), F.col("year").cast("string"), "n", nothing))
    cited = F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc_nulls_last("cited_by_count"), "work_id"))
    best = nodes.withColumn("_r", cited).where(F.col("_r") <= k)
    return out.union(best.select("map_id", F.lit("top"), "_r", F.col("work_id").cast("string"), F.coalesce("cited_by_count", F.lit(0)).cast("long"), nothing))


def evidence_filter(gaps: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """Gaps with at least ``least`` evidence ids in their map, score 0.4 or more, coverage 60 or less."""
    ids = gaps.where("gap_score >= 0.4 AND coverage <= 60").select("*", F.explode(F.array_distinct("evidence")).alias("work_id"))
    n = ids.join(nodes.select("map_id", "work_id").distinct(), ["map_id", "work_id"]).groupBy("map_id", "gap_id", "gap_score").agg(F.count(F.lit(1)).alias("n_evidence"))
    return n.where(F.col("n_evidence") >= least)
