"""Case scoping, search, masking, visibility, imports and upserts."""

from pyspark.sql import functions as F

from ..operators import scope
from ..sources import imports
from ..sources.tables import ENTITIES_SQL as EN
from ..sources.tables import RELATIONSHIPS_SQL as RE
from ..sources.tables import entities, relationships, table
from .registry import query

_OWN = "SELECT id FROM ent WHERE case_number = 'ASIA'"


@query("entity_type_counts", f"WITH {EN} SELECT entity_type, case_number, count(*) AS n FROM ent GROUP BY 1, 2")
def entity_type_counts(spark, d):
    return entities(spark, d).groupBy("entity_type", "case_number").agg(F.count("*").alias("n"))


@query("relation_counts", f"WITH {RE} SELECT relation, state, count(*) AS n, round(avg(confidence), 6) AS confidence FROM rel GROUP BY 1, 2")
def relation_counts(spark, d):
    return relationships(spark, d).groupBy("relation", "state").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("case_relationships", f"WITH {EN}, {RE} SELECT src, dst, relation, source_ref, count(*) AS n FROM rel WHERE state <> 'candidate' AND src IN ({_OWN}) AND dst IN ({_OWN}) GROUP BY ALL")
def case_relationships(spark, d):
    return scope.case_relationships(relationships(spark, d), entities(spark, d), "ASIA").groupBy("src", "dst", "relation", "source_ref").agg(F.count("*").alias("n"))


@query("case_entities", f"WITH {EN} SELECT id, entity_type, name FROM ent WHERE case_number = 'ASIA'")
def case_entities(spark, d):
    return scope.case_entities(entities(spark, d), relationships(spark, d), "ASIA").select("id", "entity_type", "name")


@query("case_events", f"WITH {EN} SELECT event_id, user_id FROM events WHERE 'C' || user_id IN ({_OWN})")
def case_events(spark, d):
    own = entities(spark, d).where("case_number = 'ASIA'").select("id")
    e = table(spark, d, "events").select("event_id", "user_id", F.concat(F.lit("C"), "user_id").alias("id"))
    return e.join(own, "id", "left_semi").select("event_id", "user_id")


@query("search_entities", f"WITH {EN} SELECT id, entity_type, name FROM ent WHERE contains(lower(id || ' ' || name || ' ' || entity_type), '00012') ORDER BY id LIMIT 100")
def search_entities(spark, d):
    return scope.search(entities(spark, d), "00012", 100).select("id", "entity_type", "name")


@query("masked_entities", f"WITH {EN} SELECT id, CASE WHEN length(name) <= 4 THEN repeat('*', length(name)) ELSE left(name, 2) || repeat('*', length(name) - 4) || right(name, 2) END AS masked FROM ent WHERE entity_type = 'PERSON'")
def masked_entities(spark, d):
    return entities(spark, d).where("entity_type = 'PERSON'").select("id", scope.mask(F.col("name")).alias("masked"))


_CASES = "SELECT o_orderkey AS case_number, o_custkey AS created_by, CASE WHEN o_orderpriority LIKE '1%' THEN 'shared' ELSE 'restricted' END AS visibility, o_orderstatus = 'P' AS is_demo FROM orders"


@query("visible_cases", f"WITH c AS ({_CASES}) SELECT case_number, visibility FROM c WHERE NOT is_demo AND (visibility = 'shared' OR created_by = 7 OR case_number IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7))")
def visible_cases(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_number"), F.col("o_custkey").alias("created_by"), F.when(F.col("o_orderpriority").like("1%"), "shared").otherwise("restricted").alias("visibility"), (F.col("o_orderstatus") == "P").alias("is_demo"))
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_number"), F.col("l_suppkey").alias("member"))
    return scope.visible(c, m, 7, "officer").select("case_number", "visibility")


@query("entity_upsert_merge", "SELECT k, count(*) AS records, max(acct) AS best, bool_or(src = 'S') AS is_supplier FROM (SELECT c_nationkey * 100 + c_custkey % 100 AS k, c_acctbal AS acct, 'C' AS src FROM customer UNION ALL SELECT s_nationkey * 100 + s_suppkey % 100, s_acctbal, 'S' FROM supplier) GROUP BY k")
def entity_upsert_merge(spark, d):
    """Records of one key become one entity that keeps the strongest figure and all roles."""
    c = table(spark, d, "customer").select((F.col("c_nationkey") * 100 + F.col("c_custkey") % 100).alias("k"), F.col("c_acctbal").alias("acct"), F.lit("C").alias("src"))
    s = table(spark, d, "supplier").select((F.col("s_nationkey") * 100 + F.col("s_suppkey") % 100).alias("k"), F.col("s_acctbal").alias("acct"), F.lit("S").alias("src"))
    return c.unionByName(s).groupBy("k").agg(F.count("*").alias("records"), F.max("acct").alias("best"), F.bool_or(F.col("src") == "S").alias("is_supplier"))


@query("latest_decision", "SELECT o_custkey AS subject, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS decision, max(o_orderdate)::DATE::VARCHAR AS decided FROM orders GROUP BY 1")
def latest_decision(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("decision"), F.max("o_orderdate").cast("date").cast("string").alias("decided"))


@query("ingest_relationships", "SELECT 'N' || n_nationkey AS source, 'R' || r_regionkey AS target, 'LOCATED_IN' AS relation, sha1('N' || n_nationkey || '|' || 'R' || r_regionkey || '|' || 'LOCATED_IN') AS id FROM nation JOIN region ON n_regionkey = r_regionkey")
def ingest_relationships(spark, d):
    """A table with alias headers, read as relationships."""
    raw = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("Caller"), F.concat(F.lit("R"), "n_regionkey").alias("To"), F.lit("located in").alias("Relation"))
    return imports.relationships(raw).select("source", "target", "relation", "id")


@query("guessed_types", "SELECT CASE WHEN regexp_matches(v, '^[+]?[0-9][0-9 -]{8,14}$') THEN 'PHONE' WHEN regexp_matches(v, '^[^@ ]+@[^@ ]+[.][a-z]+$') THEN 'EMAIL' WHEN regexp_matches(v, '^[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}$') THEN 'VEHICLE' WHEN regexp_matches(v, '^[0-9]{6,18}$') THEN 'ACCOUNT' ELSE 'ENTITY' END AS kind, count(*) AS n FROM (SELECT c_name AS v FROM customer UNION ALL SELECT CAST(100000 + s_suppkey AS VARCHAR) FROM supplier) GROUP BY 1")
def guessed_types(spark, d):
    v = table(spark, d, "customer").select(F.col("c_name").alias("v")).unionByName(table(spark, d, "supplier").select((100000 + F.col("s_suppkey")).cast("string").alias("v")))
    return v.groupBy(imports.guess_type(F.col("v")).alias("kind")).agg(F.count("*").alias("n"))
