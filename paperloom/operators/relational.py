"""Filters, joins and merges on tables of works, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.tables import landed


def load_by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids``; ids without a row drop out."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def membership(asked: DataFrame, present: DataFrame, by: list[str]) -> DataFrame:
    """The asked keys with ``missing`` true where they are not present."""
    there = present.select(*by).distinct().withColumn("_there", F.lit(True))
    return asked.join(there, by, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def array_overlap_join(a: DataFrame, b: DataFrame, left: str, right: str, array: str, each_once: bool = False, carry: int = 64, block: int = 2000) -> DataFrame:
    """(left, right, shared) of rows whose arrays share a member: an equi-join on the members. ``left`` and ``right`` are unique.

    ``each_once``: only pairs with ``left`` below ``right``, for a table joined with itself.

    Arrays of at most ``carry`` members go along, so a pair is counted where it first meets and no pair is
    exchanged; pairs with a longer one are counted by key. The rows of a member that more than ``block`` rows of
    either side have are dealt to blocks, and each pair of blocks meets on its own.
    """
    whole = lambda rows, key: rows.select(key, F.array_compact(F.array_distinct(array)).alias("_a"))
    x, y = whole(a, left), whole(b, right)
    members = lambda rows: rows.select(F.explode("_a").alias("_m"))
    often = lambda rows: rows.groupBy("_m").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    crowds = often(members(x)) if each_once else often(members(x)).unionByName(often(members(y))).groupBy("_m").agg(F.max("_n").alias("_n"))
    crowds = landed(crowds.select("_m", F.ceil(F.col("_n") / block).cast("int").alias("_blocks")))
    dealt = not crowds.isEmpty()

    def side(rows: DataFrame, key: str, name: str, own: str, other: str) -> DataFrame:
        carried = F.when(F.size("_a") <= carry, F.col("_a")).alias(f"_c{name}")
        rows = rows.select(key, carried, F.posexplode("_a").alias(f"_i{name}", "_m"))
        if not dealt:
            return rows
        rows = rows.join(crowds, "_m", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        return rows.withColumn(own, F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")

    met = side(x, left, "x", "_p", "_q").join(side(y, right, "y", "_q", "_p"), ["_m", "_p", "_q"] if dealt else ["_m"])
    if each_once:
        met = met.where(F.col(left) < F.col(right))
    short = F.col("_cx").isNotNull() & F.col("_cy").isNotNull()
    before = F.arrays_overlap(F.slice("_cx", 1, F.col("_ix")), F.col("_cy"))
    found = met.where(short & ((F.col("_ix") == 0) | ~before)).select(left, right, F.size(F.array_intersect("_cx", "_cy")).cast("long").alias("shared"))
    if x.where(F.size("_a") > carry).isEmpty() and (each_once or y.where(F.size("_a") > carry).isEmpty()):
        return found
    return found.unionByName(met.where(~short).groupBy(left, right).agg(F.count(F.lit(1)).alias("shared")))


def either_key(rows: DataFrame, keys: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that match a key by ``a`` or by ``b``, once each: a union of two equi-joins, not an OR."""
    return rows.join(keys.select(a).where(F.col(a).isNotNull()).distinct(), a, "left_semi").unionByName(rows.join(keys.select(b).where(F.col(b).isNotNull()).distinct(), b, "left_semi")).distinct()


def focus_filter(works: DataFrame, focus: str, as_of: int, least: int = 10, most: int = 25) -> DataFrame:
    """A query's works by focus: the strict test if it leaves ``least``, else the relaxed one, else all.

    ``works``: query_id, work_id, title, year, cited_by_count, relevance, paper_type. 'foundational'
    and 'recent' are cut to ``most`` in their order; 'surveys' puts surveys first, alone if there are five.
    """
    w = Window.partitionBy("query_id")
    cites, year, rel = F.coalesce("cited_by_count", F.lit(0)), F.coalesce("year", F.lit(0)), F.coalesce("relevance", F.lit(0.0))
    if focus == "surveys":
        titles = ["survey", "review", "meta-analysis", "overview", "tutorial", "state of the art"]
        low = F.lower(F.coalesce("title", F.lit("")))
        is_survey = F.coalesce(F.col("paper_type").isin("review", "survey"), F.lit(False)) | F.exists(F.array(*map(F.lit, titles)), lambda t: low.contains(t))
        rows = works.withColumn("_s", is_survey).withColumn("_n", F.count_if("_s").over(w)).where(F.col("_s") | (F.col("_n") < 5))
        return _first(rows, [F.desc("_s"), F.desc(rel), F.asc("work_id")], most).drop("_s", "_n")
    if focus == "foundational":
        strict, relaxed, order = (cites >= 500) & (rel >= 0.55), (cites >= 100) & (rel >= 0.45), cites
    elif focus == "recent":
        strict, relaxed = (year >= as_of - 3) & (rel >= 0.55), (year >= as_of - 5) & (rel >= 0.45)
        order = rel * 0.4 + F.least(cites / 1000, F.lit(1.0)) * 0.3 + (year - as_of + 5) / 5 * 0.3
    else:
        strict = relaxed = rel >= 0.40
        order = rel
    tier = F.when(F.count_if(strict).over(w) >= least, 0).when(F.count_if(relaxed).over(w) >= least, 1).otherwise(2)
    rows = works.withColumn("_tier", tier).where(F.when(F.col("_tier") == 0, strict).when(F.col("_tier") == 1, relaxed).otherwise(True)).withColumn("_o", F.round(order, 9))
    return (rows if focus not in ("foundational", "recent") else _first(rows, [F.desc("_o"), F.asc("work_id")], most)).drop("_tier", "_o")


def _first(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def suspicious_metadata(works: DataFrame, as_of: int) -> DataFrame:
    """Works from the future, or too much cited for their year."""
    return works.where((F.col("year") > as_of) | ((F.col("year") >= as_of - 1) & (F.col("cited_by_count") >= 5000)))


def repair_from_twin(works: DataFrame, suspect: Column) -> DataFrame:
    """Year of suspect works from the most cited other work of the same lower-case title, if older or 1.5 x as cited."""
    key = F.lower("title")
    best = Window.partitionBy("_t").orderBy(F.desc("cited_by_count"), "work_id")
    rows = works.withColumn("_t", key).withColumn("_s", F.coalesce(suspect, F.lit(False)))
    twins = rows.where("NOT _s").withColumn("_r", F.row_number().over(best)).where("_r = 1").select(F.col("_t").alias("_k"), F.col("year").alias("_y"), F.col("cited_by_count").alias("_c"))
    fix = F.col("_s") & ((F.col("_y") < F.col("year")) | (F.col("_c") > 1.5 * F.col("cited_by_count")))
    out = rows.join(twins, F.col("_t") == F.col("_k"), "left").withColumn("year", F.when(fix, F.col("_y")).otherwise(F.col("year")))
    return out.select(*works.columns)


def upsert_works(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by work_id: most citations, the smaller year, other fields from the stored row where it has them, else the least new value."""
    rest = [c for c in stored.columns if c not in ("work_id", "year", "cited_by_count")]
    rows = stored.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    keep = [F.min(F.when(F.col(c).isNotNull(), F.struct("_p", c)))[c].alias(c) for c in rest]
    return rows.groupBy("work_id").agg(F.max(F.coalesce("cited_by_count", F.lit(0))).alias("cited_by_count"), F.min("year").alias("year"), *keep).select(*stored.columns)


def insert_ignore(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows and the new ones whose key they lack."""
    return stored.unionByName(new.dropDuplicates(key).join(stored.select(*key), key, "left_anti"))


def upsert_last_wins(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("_x")).select(*key, "_x.*")


def best_per_key(works: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key in an order; rows without a key all stay."""
    ranked = works.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where((F.col("_r") == 1) | F.col(key).isNull()).drop("_r")


def thirds_sample(works: DataFrame, by: str, total: int, shares: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> DataFrame:
    """``total`` works of each group from the thirds by citations, a short third borrowing from what the others leave."""
    w = Window.partitionBy(by)
    r, n = F.row_number().over(w.orderBy(F.desc("cited_by_count"), "work_id")), F.count(F.lit(1)).over(w)
    rows = works.withColumn("_i", r).withColumn("_n", n).withColumn("_third", F.when(F.col("_i") <= F.floor(F.col("_n") / 3), 0).when(F.col("_i") <= 2 * F.floor(F.col("_n") / 3), 1).otherwise(2))
    inside = F.row_number().over(Window.partitionBy(by, "_third").orderBy("_i"))
    quota = F.when(F.col("_third") == 0, int(total * shares[0])).when(F.col("_third") == 1, int(total * shares[1])).otherwise(total - int(total * shares[0]) - int(total * shares[1]))
    rows = rows.withColumn("_over", (inside > quota).cast("int"))
    order = Window.partitionBy(by).orderBy("_over", "_i")
    return rows.withColumn("_o", F.row_number().over(order)).where(F.col("_o") <= total).select(*works.columns)


def share_of_total(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    return counts.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(*by)))


def mode_by(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, ties to the smaller one."""
    n = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))).where("_r = 1").drop("_r")
