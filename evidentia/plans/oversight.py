"""Dashboards, retention and workload over the case register; a case is an order."""

from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import query

NOW = "TIMESTAMP '2001-09-01'"
BUCKETS = "CASE WHEN age <= 30 THEN '0-30' WHEN age <= 90 THEN '31-90' WHEN age <= 180 THEN '91-180' WHEN age <= 365 THEN '181-365' ELSE '365+' END"


def cases(spark, d):
    return table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")).withColumn("age", F.date_diff(F.lit("2001-09-01").cast("date"), "day").cast("long"))


@query("dashboard_status", "SELECT o_orderstatus AS status, count(*) AS cases, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY 1")
def dashboard_status(spark, d):
    return cases(spark, d).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("cases"), F.count_if(F.col("o_orderpriority").like("1%")).alias("urgent"))


@query("dashboard_age_buckets", f"WITH a AS (SELECT date_diff('day', o_orderdate::DATE, DATE '2001-09-01') AS age FROM orders WHERE o_orderstatus = 'O') SELECT {BUCKETS} AS bucket, count(*) AS cases FROM a GROUP BY 1")
def dashboard_age_buckets(spark, d):
    """First upper bound that is not below the age."""
    return cases(spark, d).where("o_orderstatus = 'O'").groupBy(F.expr(BUCKETS).alias("bucket")).agg(F.count("*").alias("cases"))


@query("dashboard_turnaround_pctl", "WITH t AS (SELECT o_orderpriority AS priority, date_diff('day', o_orderdate::DATE, max(l_shipdate)::DATE) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate) SELECT priority, round(median(days), 2) AS median_days, round(quantile_cont(days, 0.9), 2) AS p90_days, round(avg(days), 2) AS mean_days FROM t GROUP BY 1")
def dashboard_turnaround_pctl(spark, d):
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("last"))
    t = cases(spark, d).join(last, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("days", F.date_diff("last", "day"))
    return t.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.round(F.median("days"), 2).alias("median_days"), F.round(F.percentile("days", 0.9), 2).alias("p90_days"), F.round(F.avg("days"), 2).alias("mean_days"))


def weekly(rows):
    w = rows.groupBy(F.trunc("day", "week").alias("w")).agg(F.count("*").alias("n"))
    weeks = w.agg(F.explode(F.sequence(F.min("w"), F.max("w"), F.expr("INTERVAL 7 DAYS"))).alias("w"))
    return weeks.join(w, "w", "left").select(F.col("w").cast("string").alias("week"), F.coalesce("n", F.lit(0)).cast("long").alias("cases"))


@query("dashboard_weekly_zero_filled", """WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE AS w, count(*) AS n FROM orders WHERE o_custkey % 97 = 3 GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(w) FROM w)::TIMESTAMP, (SELECT max(w) FROM w)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS w)
SELECT s.w::VARCHAR AS week, coalesce(n, 0)::BIGINT AS cases FROM s LEFT JOIN w USING (w)""")
def dashboard_weekly_zero_filled(spark, d):
    """Weeks of the cases of every 97th officer, with zeros for weeks without any."""
    return weekly(cases(spark, d).where("o_custkey % 97 = 3"))


@query("dashboard_weekly_all", """WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE AS w, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(w) FROM w)::TIMESTAMP, (SELECT max(w) FROM w)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS w)
SELECT s.w::VARCHAR AS week, coalesce(n, 0)::BIGINT AS cases FROM s LEFT JOIN w USING (w)""")
def dashboard_weekly_all(spark, d):
    """Weeks of all cases, with zeros for weeks without any."""
    return weekly(cases(spark, d))


@query("dashboard_workload", "SELECT o_custkey AS officer, count(*) FILTER (o_orderstatus = 'O') AS open_cases, count(*) AS cases FROM orders GROUP BY 1 ORDER BY open_cases DESC, officer LIMIT 8")
def dashboard_workload(spark, d):
    return cases(spark, d).groupBy(F.col("o_custkey").alias("officer")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_cases"), F.count("*").alias("cases")).orderBy(F.desc("open_cases"), "officer").limit(8)


@query("retention_due", "WITH a AS (SELECT c_custkey, c_mktsegment = 'BUILDING' AS hold, max(o_orderdate)::DATE AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_custkey AS subject, (last + 365)::DATE::VARCHAR AS due, last + 365 < DATE '2001-09-01' AND NOT hold AS purge FROM a WHERE last IS NOT NULL")
def retention_due(spark, d):
    last = cases(spark, d).groupBy("o_custkey").agg(F.max("day").alias("last"))
    c = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"))
    due = F.date_add("last", 365)
    return c.select(F.col("c_custkey").alias("subject"), due.cast("string").alias("due"), ((due < F.lit("2001-09-01").cast("date")) & (F.col("c_mktsegment") != "BUILDING")).alias("purge"))


@query("purge_inventory", "WITH n AS (SELECT l_partkey AS thing, count(DISTINCT l_suppkey) AS owners, min(l_suppkey) AS owner, bool_or(l_suppkey = 3) AS ours FROM lineitem GROUP BY 1) SELECT CASE WHEN owners = 1 THEN 'delete' ELSE 'detach' END AS action, count(*) AS things FROM n WHERE ours GROUP BY 1")
def purge_inventory(spark, d):
    """What only the purged case owns is deleted; the rest is detached from it."""
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("owners"), F.bool_or(F.col("l_suppkey") == 3).alias("ours"))
    return n.where("ours").groupBy(F.when(F.col("owners") == 1, "delete").otherwise("detach").alias("action")).agg(F.count("*").alias("things"))
