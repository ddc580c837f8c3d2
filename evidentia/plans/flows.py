"""Money flow between nations, and the case register's money figures."""

from pyspark.sql import functions as F

from ..sources.tables import FLOW_SQL as FL
from ..sources.tables import money_flow, table
from .registry import query

EDGES = f"{FL}, edges AS (SELECT src, dst, sum(amount) AS total, count(*) AS n FROM flow WHERE src <> dst GROUP BY 1, 2)"


def edges(spark, d):
    return money_flow(spark, d).where("src <> dst").groupBy("src", "dst").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))


def top_edges(spark, d, n=50):
    return edges(spark, d).orderBy(F.desc("total"), "src", "dst").limit(n)


@query("money_top_edges", f"WITH {EDGES} SELECT src, dst, round(total, 1) AS total, n FROM edges ORDER BY edges.total DESC, src, dst LIMIT 15")
def money_top_edges(spark, d):
    return top_edges(spark, d, 15).select("src", "dst", F.round("total", 1).alias("total"), "n")


@query("money_chains", f"WITH {EDGES}, top AS (SELECT * FROM edges ORDER BY total DESC, src, dst LIMIT 50) SELECT a.src, a.dst AS via, b.dst, round(least(a.total, b.total), 1) AS amount FROM top a JOIN edges b ON a.dst = b.src AND b.dst <> a.src")
def money_chains(spark, d):
    """First legs are the 50 largest edges, second legs any; the amount is the smaller leg."""
    t, e = top_edges(spark, d), edges(spark, d)
    a, b = t.select("src", F.col("dst").alias("via"), F.col("total").alias("x")), e.select(F.col("src").alias("via"), "dst", F.col("total").alias("y"))
    return a.join(b, "via").where("dst <> src").select("src", "via", "dst", F.round(F.least("x", "y"), 1).alias("amount"))


@query("money_circular", f"WITH {EDGES} SELECT x.src AS a, x.dst AS b, round(x.total, 1) AS forth, round(y.total, 1) AS back FROM edges x JOIN edges y ON x.src = y.dst AND x.dst = y.src AND x.src < x.dst")
def money_circular(spark, d):
    e = edges(spark, d)
    a, b = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("total").alias("x")), e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("total").alias("y"))
    return a.where("a < b").join(b, ["a", "b"]).select("a", "b", F.round("x", 1).alias("forth"), F.round("y", 1).alias("back"))


@query("money_high_value", f"WITH {FL} SELECT src, dst, round(amount, 2) AS amount FROM flow ORDER BY flow.amount DESC, src, dst LIMIT 15")
def money_high_value(spark, d):
    return money_flow(spark, d).orderBy(F.desc("amount"), "src", "dst").limit(15).select("src", "dst", F.round("amount", 2).alias("amount"))


@query("money_totals", f"WITH {FL} SELECT round(sum(amount), 0) AS total, count(*) AS n, count(DISTINCT src) AS payers, count(DISTINCT dst) AS payees FROM flow")
def money_totals(spark, d):
    return money_flow(spark, d).agg(F.round(F.sum("amount"), 0).alias("total"), F.count("*").alias("n"), F.countDistinct("src").alias("payers"), F.countDistinct("dst").alias("payees"))


@query("money_pass_through", f"WITH {EDGES}, i AS (SELECT dst AS node, sum(total) AS inn FROM edges GROUP BY 1), o AS (SELECT src AS node, sum(total) AS out FROM edges GROUP BY 1) SELECT node, round(least(inn, out) / greatest(inn, out), 6) AS pass_through FROM i JOIN o USING (node)")
def money_pass_through(spark, d):
    e = edges(spark, d)
    i, o = e.groupBy(F.col("dst").alias("node")).agg(F.sum("total").alias("inn")), e.groupBy(F.col("src").alias("node")).agg(F.sum("total").alias("out"))
    return i.join(o, "node").select("node", F.round(F.least("inn", "out") / F.greatest("inn", "out"), 6).alias("pass_through"))


@query("network_evolution", "WITH e AS (SELECT o_orderdate::DATE::VARCHAR AS day, o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT day, count(*) AS relationships, count(DISTINCT 'C' || o_custkey) + count(DISTINCT 'S' || l_suppkey) AS nodes FROM e GROUP BY 1")
def network_evolution(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    e = o.join(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    n = e.groupBy("day").agg(F.count("*").alias("relationships"))
    nodes = e.select("day", F.explode(F.array(F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("S"), "l_suppkey"))).alias("x")).groupBy("day").agg(F.countDistinct("x").alias("nodes"))
    return n.join(nodes, "day")
