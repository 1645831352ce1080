"""Activity, ledger and tenant analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Contribution of a comparison by its number of works, its cap, and the penalty for each work seen before.
METHODOLOGY_BASE, METHODOLOGY_CAP, STALE_PENALTY = {2: 0.04, 3: 0.06, 4: 0.08}, 0.30, 0.01


def validate_events(events: DataFrame, known: list[str], creating: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): known types only, and a context unless the type creates one."""
    reason = F.when(~F.coalesce(F.col("activity_type").isin(known), F.lit(False)), "unknown type").when(F.col("map_id").isNull() & ~F.col("activity_type").isin(creating), "no context")
    told = events.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


def activity_summary(events: DataFrame) -> DataFrame:
    """(map_id, activity_type, n, n_works, first_ts, last_ts, first_work): one row a type of each map."""
    return events.groupBy("map_id", "activity_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("work_id").alias("n_works"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("work_id", F.struct("ts", "event_id")).alias("first_work")
    )


def comparison_contribution(comparisons: DataFrame) -> DataFrame:
    """(map_id, total, penalty, n): comparisons in order, each worth its base less what its works were seen before.

    ``comparisons``: map_id, comparison_id, seq (unique order in a map), work_ids. A work is stale if
    an earlier comparison of two works or more had it. Larger sets use the base of four.
    """
    c = comparisons.withColumn("_n", F.size("work_ids")).where("_n >= 2")
    works = c.select("map_id", "comparison_id", "seq", F.explode("work_ids").alias("w"))
    first = F.min("seq").over(Window.partitionBy("map_id", "w"))
    stale = works.withColumn("_stale", (first < F.col("seq")).cast("int")).groupBy("map_id", "comparison_id").agg(F.sum("_stale").alias("_s"))
    base = F.when(F.col("_n") == 2, METHODOLOGY_BASE[2]).when(F.col("_n") == 3, METHODOLOGY_BASE[3]).otherwise(METHODOLOGY_BASE[4])
    worth = c.join(stale, ["map_id", "comparison_id"]).withColumn("_p", STALE_PENALTY * F.col("_s")).withColumn("_v", F.greatest(base - F.col("_p"), F.lit(0.0)))
    return worth.groupBy("map_id").agg(F.least(F.sum("_v"), F.lit(METHODOLOGY_CAP)).alias("total"), F.sum("_p").alias("penalty"), F.count(F.lit(1)).alias("n"))


def coverage(events: DataFrame, comparisons: DataFrame, timeline_type: str, node_types: list[str], unlock: float = 0.40) -> DataFrame:
    """(map_id, timeline, methodology, exploration, coverage, unlocked) of every map with activity."""
    own = events.groupBy("map_id").agg(
        F.when(F.count_if(F.col("activity_type") == timeline_type) > 0, 0.15).otherwise(0.0).alias("timeline"),
        F.least(F.lit(0.30), 0.03 * F.countDistinct(F.when(F.col("activity_type").isin(node_types), F.struct("work_id", "activity_type")))).alias("exploration"),
    )
    both = own.join(comparison_contribution(comparisons).select("map_id", F.col("total").alias("methodology")), "map_id", "left").withColumn("methodology", F.coalesce("methodology", F.lit(0.0)))
    total = F.col("timeline") + F.col("methodology") + F.col("exploration")
    return both.select("map_id", "timeline", "methodology", "exploration", total.alias("coverage"), (F.round(total, 9) >= unlock).alias("unlocked"))


def running_growth(rows: DataFrame, day: Column, before: int = 0, spine: bool = False) -> DataFrame:
    """(day, n, total): rows a day with the running total from ``before``; with ``spine``, days without rows too."""
    n = rows.groupBy(day.cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    if spine:
        days = n.agg(F.min("day").alias("_a"), F.max("day").alias("_b")).select(F.explode(F.sequence("_a", "_b")).alias("day"))
        n = days.join(n, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.withColumn("total", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) + before)


def ledger_audit(ledger: DataFrame) -> DataFrame:
    """Rows of (account, seq, amount, balance_after) whose balance isn't the running sum of amounts."""
    order = Window.partitionBy("account").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("expected", F.sum("amount").over(order)).where("balance_after <> expected")


def retention(users: DataFrame, as_of: Column, days: list[int]) -> DataFrame:
    """(period, total, retained, rate) of cohorts old enough for each period. ``users``: created_at, last_seen."""
    periods = users.sparkSession.createDataFrame([(n,) for n in days], "days int")  # a handful of rows
    old = users.join(F.broadcast(periods)).where(F.col("created_at") + F.make_dt_interval(F.col("days")) <= as_of)
    g = old.groupBy("days").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("last_seen") > F.col("created_at") + F.make_dt_interval(F.col("days"))).alias("retained"))
    return g.select("days", "total", "retained", F.round(100.0 * F.col("retained") / F.col("total"), 1).alias("rate"))


def cost_breakdown(ledger: DataFrame) -> DataFrame:
    """(workspace, reason, n, amount, level): debits by workspace and reason with totals of each workspace and of all."""
    debit = ledger.where("amount < 0")
    return debit.rollup("workspace", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("amount")).alias("amount"), F.grouping_id("workspace", "reason").alias("level"))


# What a credit costs and what a plan brings, in pounds.
COST_PER_CREDIT, PLAN_REVENUE = 0.05, {"pro": 7.99}


def credit_usage(ledger: DataFrame, since: Column, daily: bool = False) -> DataFrame:
    """(reason, n, credits) of the debits from ``since`` on, or with ``daily`` a row for each day and reason.

    ``ledger``: reason, amount (debits are negative), created_at.
    """
    by = [F.to_date("created_at").alias("day"), "reason"] if daily else ["reason"]
    return ledger.where((F.col("amount") < 0) & (F.col("created_at") >= since)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("amount")).alias("credits"))


def user_margins(ledger: DataFrame, billing: DataFrame) -> DataFrame:
    """(user_id, credits, cost, revenue, margin) of every user with billing or debits; ``ledger``: user_id, amount; ``billing``: user_id, plan.

    Cost is rounded to pence before the margin; a plan that brings nothing, or none, has revenue 0.
    """
    used = ledger.where("amount < 0").groupBy("user_id").agg(F.sum(F.abs("amount")).alias("credits"))
    revenue = F.coalesce(*(F.when(F.col("plan") == plan, pounds) for plan, pounds in PLAN_REVENUE.items()), F.lit(0.0))
    both = billing.groupBy("user_id").agg(F.max("plan").alias("plan")).join(used, "user_id", "full_outer").withColumn("credits", F.coalesce("credits", F.lit(0)))
    cost = F.round(F.col("credits") * F.lit(str(COST_PER_CREDIT)).cast("decimal(6,4)"), 2).cast("double")
    return both.select("user_id", "credits", cost.alias("cost"), revenue.alias("revenue"), F.round(revenue - cost, 2).alias("margin"))


def latest(rows: DataFrame, by: list[str], at: str, *ties: str) -> DataFrame:
    """The last row of each group."""
    order = Window.partitionBy(*by).orderBy(F.desc(at), *(F.desc(t) for t in ties))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that were given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of an order that ends in a unique key."""
    return rows.orderBy(*order).offset(offset).limit(limit)
