"""Tables of a directory, and their reading as entities, relationships, events and money flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case_events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, ts, entity, related, event_type, value; related is the counterpart in the JSON properties."""
    e = table(spark, d, "events")
    return e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").alias("entity"), F.get_json_object("props", "$.k").cast("long").alias("related"), "event_type", "value")


EVENTS_SQL = "ev AS (SELECT event_id, ts, user_id AS entity, CAST(json_extract_string(props, '$.k') AS BIGINT) AS related, event_type, value FROM events)"


def entities(spark: SparkSession, d: str) -> DataFrame:
    """id, entity_type, name, case_number (region of the nation)."""
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("case_number"))
    c = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("name"), "case_number")
    s = table(spark, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit("ORGANIZATION").alias("entity_type"), F.col("s_name").alias("name"), "case_number")
    n = place.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit("LOCATION").alias("entity_type"), F.col("n_name").alias("name"), "case_number")
    return c.unionByName(s).unionByName(n)


ENTITIES_SQL = """place AS (SELECT n_nationkey, n_name, r_name AS case_number FROM nation JOIN region ON n_regionkey = r_regionkey),
ent AS (SELECT 'C' || c_custkey AS id, 'PERSON' AS entity_type, c_name AS name, case_number FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT 'S' || s_suppkey, 'ORGANIZATION', s_name, case_number FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'N' || n_nationkey, 'LOCATION', n_name, case_number FROM place)"""


def relationships(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, relation, confidence, event_time, source_ref, state."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(
        F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"), (1 - F.col("l_discount")).alias("confidence"),
        F.col("l_shipdate").alias("event_time"), F.col("l_orderkey").alias("source_ref"), F.when(F.col("l_linestatus") == "F", "verified").otherwise("candidate").alias("state"),
    )


RELATIONSHIPS_SQL = "rel AS (SELECT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, l_returnflag AS relation, 1 - l_discount AS confidence, l_shipdate AS event_time, l_orderkey AS source_ref, CASE WHEN l_linestatus = 'F' THEN 'verified' ELSE 'candidate' END AS state FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def money_flow(spark: SparkSession, d: str) -> DataFrame:
    """src, dst (nations), amount: one row per payment."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    flow = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return flow.select("src", "dst", "amount")


FLOW_SQL = "flow AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_extendedprice * (1 - l_discount) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"
