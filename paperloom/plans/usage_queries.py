"""Queries on activity, ledger and relational shapes."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import relational, usage
from paperloom.plans.registry import query
from paperloom.plans.views import ACTIVITY, AS_OF, JUDGMENTS, QUERIES, WORKS, activity, judgments, with_, works
from paperloom.tables import table


@query(with_(ACTIVITY) + "SELECT map_id, activity_type, count(*) AS n, count(DISTINCT work_id) AS n_works, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(work_id, (ts, event_id)) AS first_work FROM activity GROUP BY 1, 2")
def activity_summary(spark, d):  # noqa: ANN001
    out = usage.activity_summary(activity(spark, d))
    return out.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz")).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query(with_(ACTIVITY) + "SELECT CASE WHEN activity_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'unknown type' ELSE 'no context' END AS reason, count(*) AS n FROM activity WHERE activity_type NOT IN ('view', 'click', 'purchase', 'signup') OR (map_id IS NULL AND activity_type != 'signup') GROUP BY 1")
def rejected_events(spark, d):  # noqa: ANN001
    _, rejected = usage.validate_events(activity(spark, d), ["view", "click", "purchase", "signup"], ["signup"])
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


COMPARISONS = "comp AS (SELECT map_id, event_id AS comparison_id, event_id AS seq, [work_id, (work_id * 7 + 3) % 100, (work_id * 11 + 5) % 100] AS ids FROM activity WHERE activity_type = 'purchase'), comparisons AS (SELECT map_id, comparison_id, seq, list_distinct(ids) AS work_ids FROM comp)"
WORTH = """cw AS (SELECT map_id, comparison_id, seq, len(work_ids) AS n, unnest(work_ids) AS w FROM comparisons WHERE len(work_ids) >= 2), cs AS (SELECT *, min(seq) OVER (PARTITION BY map_id, w) < seq AS stale FROM cw),
cv AS (SELECT map_id, comparison_id, 0.01::DOUBLE * count(CASE WHEN stale THEN 1 END) AS p, greatest(CASE any_value(n) WHEN 2 THEN 0.04 WHEN 3 THEN 0.06 ELSE 0.08 END::DOUBLE - 0.01::DOUBLE * count(CASE WHEN stale THEN 1 END), 0) AS v FROM cs GROUP BY 1, 2),
worth AS (SELECT map_id, least(sum(v), 0.30::DOUBLE) AS total, sum(p) AS penalty, count(*) AS n FROM cv GROUP BY 1)"""


def _comparisons(spark, d):  # noqa: ANN001
    w = F.col("work_id")
    rows = activity(spark, d).where("activity_type = 'purchase'")
    return rows.select("map_id", F.col("event_id").alias("comparison_id"), F.col("event_id").alias("seq"), F.array_distinct(F.array(w, (w * 7 + 3) % 100, (w * 11 + 5) % 100)).alias("work_ids"))


@query(with_(ACTIVITY, COMPARISONS, WORTH) + "SELECT map_id, round(total, 6) AS total, round(penalty, 6) AS penalty, n FROM worth")
def comparison_contribution(spark, d):  # noqa: ANN001
    return usage.comparison_contribution(_comparisons(spark, d)).select("map_id", F.round("total", 6).alias("total"), F.round("penalty", 6).alias("penalty"), "n")


@query(
    with_(ACTIVITY, COMPARISONS, WORTH)
    + """, o AS (SELECT map_id, CASE WHEN count(CASE WHEN activity_type = 'signup' THEN 1 END) > 0 THEN 0.15::DOUBLE ELSE 0 END AS timeline, least(0.30::DOUBLE, 0.03::DOUBLE * count(DISTINCT CASE WHEN activity_type IN ('view', 'click') THEN (work_id, activity_type) END)) AS exploration FROM activity GROUP BY 1)
SELECT map_id, round(timeline, 6) AS timeline, round(coalesce(total, 0), 6) AS methodology, round(exploration, 6) AS exploration, round(timeline + coalesce(total, 0) + exploration, 6) AS coverage, round(timeline + coalesce(total, 0) + exploration, 9) >= 0.40 AS unlocked FROM o LEFT JOIN worth USING (map_id)"""
)
def map_coverage(spark, d):  # noqa: ANN001
    out = usage.coverage(activity(spark, d), _comparisons(spark, d), "signup", ["view", "click"])
    return out.select("map_id", *(F.round(c, 6).alias(c) for c in ("timeline", "methodology", "exploration", "coverage")), "unlocked")


@query(with_(ACTIVITY) + "SELECT day::VARCHAR AS day, n, (100 + sum(n) OVER (ORDER BY day))::BIGINT AS total FROM (SELECT ts::DATE AS day, count(*) AS n FROM activity WHERE activity_type = 'signup' GROUP BY 1)")
def user_growth(spark, d):  # noqa: ANN001
    return usage.running_growth(activity(spark, d).where("activity_type = 'signup'"), F.col("ts"), 100).withColumn("day", F.col("day").cast("string"))


@query(with_(ACTIVITY) + ", u AS (SELECT map_id, min(ts) AS created_at, max(ts) AS last_seen FROM activity GROUP BY 1), p AS (SELECT unnest([1, 7, 14, 30]) AS days) SELECT days::INT AS days, count(*) AS total, count(CASE WHEN last_seen > created_at + to_days(days::INT) THEN 1 END) AS retained, round(100.0::DOUBLE * count(CASE WHEN last_seen > created_at + to_days(days::INT) THEN 1 END) / count(*), 1) AS rate FROM u, p WHERE created_at + to_days(days::INT) <= TIMESTAMP '2024-01-28' GROUP BY 1")
def retention(spark, d):  # noqa: ANN001
    u = activity(spark, d).groupBy("map_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"))
    return usage.retention(u, F.lit("2024-01-28").cast("timestamp"), [1, 7, 14, 30])


@query(with_(ACTIVITY) + "SELECT ts::DATE::VARCHAR AS day, round(sum(abs(CASE WHEN activity_type = 'purchase' THEN -value ELSE 0 END)), 2) AS debits, count(CASE WHEN activity_type = 'purchase' THEN 1 END) AS n, count(DISTINCT map_id) AS users FROM activity GROUP BY 1")
def revenue_by_day(spark, d):  # noqa: ANN001
    a = activity(spark, d).withColumn("amount", F.when(F.col("activity_type") == "purchase", -F.col("value").cast("decimal(12,2)")).otherwise(0))
    return a.groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.sum(F.abs("amount")).cast("double").alias("debits"), F.count_if(F.col("activity_type") == "purchase").alias("n"), F.countDistinct("map_id").alias("users"))


@query(with_(ACTIVITY) + "SELECT map_id % 10 AS workspace, activity_type AS reason, count(*) AS n, round(sum(value), 2) AS amount, grouping_id(map_id % 10, activity_type) AS level FROM activity WHERE value > 0 GROUP BY ROLLUP (map_id % 10, activity_type)")
def cost_breakdown(spark, d):  # noqa: ANN001
    ledger = activity(spark, d).select((F.col("map_id") % 10).alias("workspace"), F.col("activity_type").alias("reason"), (-F.col("value").cast("decimal(12,2)")).alias("amount"))
    return usage.cost_breakdown(ledger).withColumn("amount", F.col("amount").cast("double")).withColumn("level", F.col("level").cast("bigint"))


LEDGER = "ledger AS (SELECT map_id AS user_id, activity_type AS reason, CASE WHEN value > 0 THEN -value ELSE value END::DECIMAL(12,2) AS amount, ts AS created_at FROM activity WHERE event_id % 3 > 0 UNION ALL SELECT map_id, 'top-up', 50, ts FROM activity WHERE event_id % 3 = 0)"


def _debits(spark, d):  # noqa: ANN001, ANN202
    a = activity(spark, d)
    spent = a.where("event_id % 3 > 0").select(F.col("map_id").alias("user_id"), F.col("activity_type").alias("reason"), (-F.abs("value")).cast("decimal(12,2)").alias("amount"), F.col("ts").alias("created_at"))
    return spent.union(a.where("event_id % 3 = 0").select("map_id", F.lit("top-up"), F.lit(50).cast("decimal(12,2)"), "ts"))


@query(with_(ACTIVITY, LEDGER) + "SELECT reason, count(*) AS n, sum(-amount)::DOUBLE AS credits FROM ledger WHERE amount < 0 AND created_at >= (SELECT max(created_at) FROM ledger) - INTERVAL 30 DAY GROUP BY reason")
def credit_usage(spark, d):  # noqa: ANN001
    ledger = _debits(spark, d)
    since = ledger.agg(F.max("created_at")).first()[0] - datetime.timedelta(days=30)
    return usage.credit_usage(ledger, F.lit(since)).withColumn("credits", F.col("credits").cast("double"))


@query(with_(ACTIVITY, LEDGER) + "SELECT created_at::DATE AS day, reason, count(*) AS n, sum(-amount)::DOUBLE AS credits FROM ledger WHERE amount < 0 GROUP BY ALL")
def credit_usage_by_day(spark, d):  # noqa: ANN001
    return usage.credit_usage(_debits(spark, d), F.lit("1970-01-01").cast("timestamp"), daily=True).withColumn("credits", F.col("credits").cast("double"))


@query(
    with_(ACTIVITY, LEDGER)
    + ", plans AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'pro' WHEN c_custkey % 3 = 1 THEN 'free' END AS plan FROM customer), used AS (SELECT user_id, sum(-amount) AS credits FROM ledger WHERE amount < 0 GROUP BY 1),"
    " m AS (SELECT user_id, coalesce(credits, 0) AS credits, round(coalesce(credits, 0) * 0.05::DECIMAL(6,4), 2)::DOUBLE AS cost, CASE WHEN plan = 'pro' THEN 7.99 ELSE 0.0 END::DOUBLE AS revenue FROM plans FULL JOIN used USING (user_id))"
    " SELECT user_id, credits::DOUBLE AS credits, cost, revenue, round(revenue - cost, 2) AS margin FROM m"
)
def user_margins(spark, d):  # noqa: ANN001
    i = F.col("c_custkey")
    billing = table(spark, d, "customer").select(i.alias("user_id"), F.when(i % 3 == 0, "pro").when(i % 3 == 1, "free").alias("plan"))
    return usage.user_margins(_debits(spark, d).select("user_id", "amount"), billing).withColumn("credits", F.col("credits").cast("double"))


@query(with_(ACTIVITY) + ", l AS (SELECT map_id AS account, event_id AS seq, value::DECIMAL(12,2) AS amount, sum(value::DECIMAL(12,2)) OVER (PARTITION BY map_id ORDER BY event_id) AS expected FROM activity) SELECT account, seq, (expected + 1)::DOUBLE AS balance_after, expected::DOUBLE AS expected FROM l WHERE seq % 97 = 0")
def ledger_audit(spark, d):  # noqa: ANN001
    """Every 97th balance is off by one."""
    amount = F.col("value").cast("decimal(12,2)")
    order = Window.partitionBy("map_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    ledger = activity(spark, d).select(F.col("map_id").alias("account"), F.col("event_id").alias("seq"), amount.alias("amount"), (F.sum(amount).over(order) + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).alias("balance_after"))
    return usage.ledger_audit(ledger).select("account", "seq", F.col("balance_after").cast("double").alias("balance_after"), F.col("expected").cast("double").alias("expected"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_order_per_customer(spark, d):  # noqa: ANN001
    return usage.latest(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_name ILIKE '%7%' AND coalesce(c_mktsegment, 'free') = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
def user_page(spark, d):  # noqa: ANN001
    wanted = usage.all_of(F.col("c_acctbal") >= 1000, F.col("c_name").ilike("%7%"), F.coalesce("c_mktsegment", F.lit("free")) == "BUILDING", None)
    return usage.page(table(spark, d, "customer").where(wanted), [F.desc("c_acctbal"), F.asc("c_custkey")], 5, 20).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT n_name, r_name, count(*) AS customers, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS solvent, round(sum(c_acctbal), 2) AS balance, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY r_name), 6) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def customers_by_nation(spark, d):  # noqa: ANN001
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("c_acctbal") > 0).alias("solvent"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return relational.share_of_total(j.select("n_name", "r_name", "customers", "solvent", "balance"), ["r_name"], "customers").withColumn("share", F.round("share", 6))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, d):  # noqa: ANN001
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_nationkey AS nation, l_suppkey AS supplier, l_returnflag AS flag, n FROM (SELECT l_suppkey, l_returnflag, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY 1, 2) JOIN supplier ON l_suppkey = s_suppkey WHERE r = 1")
def most_frequent_flag(spark, d):  # noqa: ANN001
    m = relational.mode_by(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag")
    return m.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("nation"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"), "n")


FOCUS = "fw AS (SELECT topic AS query_id, work_id, title, year, cited_by_count, coalesce(relevance, 0.5) AS relevance FROM works LEFT JOIN judgments USING (work_id))"


def _focus(spark, d):  # noqa: ANN001
    w = works(spark, d).join(judgments(spark, d), "work_id", "left")
    return w.select(F.col("topic").alias("query_id"), "work_id", "title", "year", "cited_by_count", F.coalesce("relevance", F.lit(0.5)).alias("relevance"), F.lit(None).cast("string").alias("paper_type"))


TIERED = """f AS (SELECT *, {strict} AS s, {relaxed} AS x, round({order}, 9) AS o FROM fw), t AS (SELECT *, CASE WHEN count(CASE WHEN s THEN 1 END) OVER w >= 10 THEN 0 WHEN count(CASE WHEN x THEN 1 END) OVER w >= 10 THEN 1 ELSE 2 END AS tier FROM f WINDOW w AS (PARTITION BY query_id)), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, work_id) AS r FROM t WHERE CASE tier WHEN 0 THEN s WHEN 1 THEN x ELSE true END) SELECT query_id, work_id FROM k WHERE r <= 25"""


@query(with_(WORKS, JUDGMENTS, FOCUS, "zz AS (SELECT 1)") + ", " + TIERED.format(strict="cited_by_count >= 500 AND relevance >= 0.55", relaxed="cited_by_count >= 100 AND relevance >= 0.45", order="cited_by_count"))
def focus_foundational(spark, d):  # noqa: ANN001
    return relational.focus_filter(_focus(spark, d), "foundational", AS_OF).select("query_id", "work_id")


@query(with_(WORKS, JUDGMENTS, FOCUS, "zz AS (SELECT 1)") + ", " + TIERED.format(strict="year >= 2023 AND relevance >= 0.55", relaxed="year >= 2021 AND relevance >= 0.45", order="relevance * 0.4 + least(cited_by_count / 1000, 1.0) * 0.3 + (year - 2026 + 5) / 5 * 0.3"))
def focus_recent(spark, d):  # noqa: ANN001
    return relational.focus_filter(_focus(spark, d), "recent", AS_OF).select("query_id", "work_id")


@query(with_(WORKS) + ", r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY cited_by_count DESC, work_id) AS i, count(*) OVER (PARTITION BY topic) AS n FROM works), t AS (SELECT *, CASE WHEN i <= n // 3 THEN 0 WHEN i <= 2 * (n // 3) THEN 1 ELSE 2 END AS third FROM r), q AS (SELECT *, (row_number() OVER (PARTITION BY topic, third ORDER BY i) > CASE third WHEN 0 THEN 12 WHEN 1 THEN 6 ELSE 2 END)::INT AS over_q FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY over_q, i) AS o FROM q) SELECT topic, work_id FROM o WHERE o <= 20")
def thirds_sample(spark, d):  # noqa: ANN001
    return relational.thirds_sample(works(spark, d), "topic", 20).select("topic", "work_id")


@query(with_(WORKS) + ", s AS (SELECT * FROM works WHERE work_id % 3 != 0), n AS (SELECT work_id, CASE WHEN work_id % 5 = 0 THEN NULL ELSE 'new ' || title END AS title, abstract, (year - 1)::INT AS year, (cited_by_count + work_id % 7 - 3)::INT AS cited_by_count, topic, subfield FROM works WHERE work_id % 2 = 0) SELECT work_id, coalesce(s.title, n.title) AS title, coalesce(least(s.year, n.year), s.year, n.year) AS year, CASE WHEN s.work_id IS NULL THEN n.cited_by_count WHEN n.work_id IS NULL THEN s.cited_by_count ELSE greatest(s.cited_by_count, n.cited_by_count) END AS cited_by_count FROM s FULL JOIN n USING (work_id)")
def upsert_works(spark, d):  # noqa: ANN001
    w = works(spark, d)
    new = w.where("work_id % 2 = 0").withColumn("title", F.when(F.col("work_id") % 5 != 0, F.concat(F.lit("new "), "title"))).withColumn("year", F.col("year") - 1).withColumn("cited_by_count", (F.col("cited_by_count") + F.col("work_id") % 7 - 3).cast("int"))
    return relational.upsert_works(w.where("work_id % 3 != 0"), new).select("work_id", "title", "year", "cited_by_count")


@query(with_(ACTIVITY) + "SELECT map_id, activity_type, coalesce(work_id, -1) AS work_id, arg_max(event_id, (ts, event_id)) AS event_id FROM activity GROUP BY 1, 2, 3")
def upsert_last_wins(spark, d):  # noqa: ANN001
    a = activity(spark, d).select("map_id", "activity_type", F.coalesce("work_id", F.lit(-1)).alias("work_id"), "ts", "event_id")
    return relational.upsert_last_wins(a, ["map_id", "activity_type", "work_id"], "ts").select("map_id", "activity_type", "work_id", "event_id")


@query("WITH x AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT x.o AS a, y.o AS b, count(*) AS shared FROM x JOIN x y USING (m) WHERE x.o < y.o GROUP BY 1, 2")
def array_overlap_join(spark, d):  # noqa: ANN001
    orders = table(spark, d, "orders").select("o_orderkey")
    sets = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.collect_set("l_partkey").alias("p"))
    return relational.array_overlap_join(sets.withColumnRenamed("o_orderkey", "a"), sets.withColumnRenamed("o_orderkey", "b"), "a", "b", "p", each_once=True)


@query(with_(WORKS) + ", s AS (SELECT *, year >= 2020 AND cited_by_count >= 4000 AS sus FROM works), t AS (SELECT lower(title) AS k, year AS y, cited_by_count AS c, row_number() OVER (PARTITION BY lower(title) ORDER BY cited_by_count DESC, work_id) AS r FROM s WHERE NOT sus) SELECT work_id, (CASE WHEN sus AND (y < year OR c > 1.5 * cited_by_count) THEN y ELSE year END)::INT AS year FROM s LEFT JOIN t ON k = lower(title) AND r = 1")
def repair_from_title_twin(spark, d):  # noqa: ANN001
    return relational.repair_from_twin(works(spark, d), (F.col("year") >= 2020) & (F.col("cited_by_count") >= 4000)).select("work_id", "year")
