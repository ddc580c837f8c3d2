"""Integrity of records, exports, movement and places over the given tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import integrity as i
from ..operators import movement as m
from ..sources import exports as x
from ..sources.tables import ENTITIES_SQL as EN
from ..sources.tables import EVENTS_SQL as EV
from ..sources.tables import RELATIONSHIPS_SQL as RE
from ..sources.tables import case_events, entities, relationships, table
from .registry import query

S = "CAST(floor(epoch(ts)) AS BIGINT)"
_LEAVES = f"{EV}, lv AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY event_id) - 1 AS i, sha256(event_id || '|' || event_type) AS h FROM ev)"
_TREE = f"{_LEAVES}, tr AS (SELECT entity, 0 AS lvl, i, sha256('\\x00'::BLOB || unhex(h)) AS h FROM lv UNION ALL SELECT entity, lvl + 1, i // 2, CASE WHEN count(*) = 2 THEN sha256('\\x01'::BLOB || unhex(min(h) FILTER (i % 2 = 0)) || unhex(min(h) FILTER (i % 2 = 1))) ELSE min(h) END FROM tr WHERE lvl < 20 GROUP BY entity, lvl, i // 2)"


def leaves(spark, d):
    w = Window.partitionBy("entity").orderBy("event_id")
    return case_events(spark, d).select("entity", (F.row_number().over(w) - 1).cast("long").alias("i"), i.fingerprint("event_id", "event_type").alias("h"))


@query("merkle_root", f"WITH RECURSIVE {_TREE} SELECT entity, h AS root FROM tr WHERE lvl = 20")
def merkle_root(spark, d):
    """Root of each entity's events."""
    return i.merkle_roots(leaves(spark, d), "entity", "i", "h")


@query("merkle_proofs", f"WITH {_LEAVES} SELECT entity, i AS position, true AS verified FROM lv")
def merkle_proofs(spark, d):
    """Each event's path, and that it leads to the root of its entity."""
    l_ = leaves(spark, d)
    p = i.merkle_proofs(l_, "entity", "i", "h").join(i.merkle_roots(l_, "entity", "i", "h"), "entity")
    return p.select("entity", "position", i.merkle_verified(F.col("digest"), F.col("path"), F.col("root")).alias("verified"))


@query("row_check", "WITH l AS (SELECT o_orderkey AS id, sha256(o_orderkey || '|' || o_orderstatus) AS h FROM orders), r AS (SELECT o_orderkey AS id, sha256(o_orderkey || '|' || CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END) AS h FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, o_orderkey) SELECT id, CASE WHEN r.h IS NULL THEN 'unrecorded' WHEN l.h IS NULL THEN 'missing' ELSE 'modified' END AS problem FROM l FULL JOIN r USING (id) WHERE l.h IS DISTINCT FROM r.h")
def row_check(spark, d):
    """Orders whose status isn't what their lines recorded."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), i.fingerprint("o_orderkey", "o_orderstatus").alias("digest"))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_linestatus").alias("a"), F.max("l_linestatus").alias("b"))
    r = g.withColumn("s", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("P")).join(o.select("id"), "id", "left_semi").select("id", i.fingerprint("id", "s").alias("digest"))
    return i.row_check(o, r, ["id"])


@query("ledger_verdict", "SELECT o_orderpriority AS scope, count(*) AS checked, CASE WHEN count(*) FILTER (o_totalprice < 0) > 0 THEN 'TAMPERING DETECTED' WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'PARTIAL' ELSE 'INTACT' END AS verdict FROM orders GROUP BY 1")
def ledger_verdict(spark, d):
    """Verdict for each priority: a negative price is a problem, an order in progress is unchecked."""
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("scope")).agg(F.count("*").alias("checked"), F.count_if(F.col("o_totalprice") < 0).alias("p"), F.count_if(F.col("o_orderstatus") == "P").alias("u"))
    return g.select("scope", "checked", i.verdict(F.col("p"), F.col("u")).alias("verdict"))


@query("ledger_payloads", "SELECT event_id, CASE WHEN event_type <> '' THEN event_type END AS event_type, left(sha256(props), 32) AS props_sha256 FROM events")
def ledger_payloads(spark, d):
    """Events as a ledger may hold them: kinds stay, free content only as the start of its hash."""
    e = table(spark, d, "events")
    return e.select("event_id", i.sanitised(F.col("event_type"), F.lit("event_type")).alias("event_type"), i.sanitised(F.col("props"), F.lit("props")).alias("props_sha256"))


_CASE_TABLE = f"{EN}, {RE}"


@query("case_export", f"WITH {_CASE_TABLE}, e AS (SELECT id FROM ent WHERE case_number = 'ASIA') SELECT 'entity' AS section, id, name, entity_type AS type, NULL::VARCHAR AS relation, NULL::VARCHAR AS source, NULL::VARCHAR AS target FROM ent WHERE case_number = 'ASIA' UNION ALL SELECT 'relationship', source_ref::VARCHAR, NULL, NULL, relation, src, dst FROM rel WHERE src IN (SELECT id FROM e) AND dst IN (SELECT id FROM e) AND state = 'verified' UNION ALL SELECT 'alert', o_orderkey::VARCHAR, o_orderpriority, NULL, NULL, NULL, NULL FROM orders WHERE o_totalprice > 350000")
def case_export(spark, d):
    """The table of one case: its entities, the relationships within it, and alerts of large orders."""
    e = entities(spark, d).where("case_number = 'ASIA'")
    ids = e.select("id")
    r = relationships(spark, d).where("state = 'verified'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    a = table(spark, d, "orders").where("o_totalprice > 350000").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    t = x.case_table(e.select("id", "name", F.col("entity_type").alias("type")), r.select(F.col("source_ref").alias("id"), "relation", F.col("src").alias("source"), F.col("dst").alias("target")), a)
    return t.select("section", "id", "name", "type", "relation", "source", "target")


@query("calendar_events", r"""SELECT c_custkey AS id, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:deadline-' || c_custkey || '@evidentia', 'DTSTART;VALUE=DATE:19980301', 'DTEND;VALUE=DATE:19980302', 'SUMMARY:[' || c_mktsegment || '] ' || c_name, 'DESCRIPTION:', 'TRANSP:TRANSPARENT', 'BEGIN:VALARM', 'ACTION:DISPLAY', 'DESCRIPTION:' || c_name, 'TRIGGER:-P1D', 'END:VALARM', 'END:VEVENT') AS ics FROM customer""")
def calendar_events(spark, d):
    """A deadline for each customer."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("case_number"), F.col("c_name").alias("label"), F.lit("").alias("note"), F.lit("1998-03-01").cast("date").alias("due"))
    return x.calendar_events(c)


@query("evidence_index", "WITH c AS (SELECT user_id AS id, count(*) AS events, count(*) FILTER (event_type = 'view') AS verified, count(*) FILTER (event_type = 'purchase') AS exported FROM events GROUP BY 1) SELECT c_mktsegment AS case_number, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)::INTEGER AS no, c_custkey AS id, c_name AS name, sha256(c_name) AS sha256, coalesce(events, 0) AS events, coalesce(verified, 0) AS verified, coalesce(exported, 0) AS exported FROM customer LEFT JOIN c ON c.id = c_custkey")
def evidence_index(spark, d):
    """Customers as numbered items of their segments, with the events that touched them."""
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("case_number"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.sha2("c_name", 256).alias("sha256"))
    act = F.when(F.col("event_type") == "view", "verify").when(F.col("event_type") == "purchase", "export").otherwise("other")
    return x.evidence_index(rows, table(spark, d, "events").select(F.col("user_id").alias("id"), act.alias("action")))


@query("export_labels", "WITH v AS (SELECT 'email' AS kind, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) AS value FROM documents UNION SELECT 'ip', unnest(regexp_extract_all(text, '\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b')) FROM documents UNION SELECT 'phone', unnest(regexp_extract_all(text, '(?:\\+91[ -]?|0)?[6-9][0-9]{4}[ -]?[0-9]{5}')) FROM documents) SELECT kind, count(*) AS n, count(*) AS labels FROM v GROUP BY 1")
def export_labels(spark, d):
    """How many values and how many different labels each kind has in one export."""
    return x.labels(table(spark, d, "documents"), b"export").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


_GAZ = "gz AS (SELECT lower(n_name) AS name, 10.0 + n_nationkey AS glat, 20.0 + n_regionkey AS glon FROM nation)"


def _placed(spark, d):
    """Customers with the text that names their nation; every seventh nation has a position of its own, every fifth event has one."""
    nat = table(spark, d, "nation")
    gaz = nat.select(F.lower("n_name").alias("name"), (F.lit(10.0) + F.col("n_nationkey")).alias("glat"), (F.lit(20.0) + F.col("n_regionkey")).alias("glon"))
    places = nat.where("n_nationkey % 7 = 0").select(F.concat(F.lit("N"), "n_nationkey").alias("place_id"), (F.lit(1.0) + F.col("n_nationkey")).alias("plat"), F.lit(2.0).alias("plon"))
    e = table(spark, d, "customer").join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.col("c_custkey") % 5 == 0
    e = e.select(F.col("c_custkey").alias("id"), F.when(own, 5.0).alias("lat"), F.when(own, 6.0).alias("lon"), F.concat(F.lit("C"), "c_custkey").alias("entity"), F.concat(F.lit("N"), "n_nationkey").alias("related"), F.concat(F.lit("seen near "), "n_name", F.lit(" again")).alias("text"))
    return m.resolved(e, places, gaz)


_PLACED = f"{_GAZ}, pl AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 5.0 WHEN n_nationkey % 7 = 0 THEN 1.0 + n_nationkey ELSE glat END::DOUBLE AS lat, CASE WHEN c_custkey % 5 = 0 THEN 6.0 WHEN n_nationkey % 7 = 0 THEN 2.0 ELSE glon END::DOUBLE AS lon, CASE WHEN c_custkey % 5 = 0 THEN 'event' WHEN n_nationkey % 7 = 0 THEN 'linked_location' ELSE 'gazetteer' END AS geo_source FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN gz ON gz.name = lower(n_name))"


@query("event_geo", f"WITH {_PLACED} SELECT * FROM pl")
def event_geo(spark, d):
    return _placed(spark, d)


@query("event_geo_source", f"WITH {_PLACED} SELECT geo_source, count(*) AS n FROM pl GROUP BY 1")
def event_geo_source(spark, d):
    return _placed(spark, d).groupBy("geo_source").agg(F.count("*").alias("n"))


@query("stays")
def stays(spark, d):
    """Places of each user; positions come from the keys of events, as in movement_legs."""
    e = case_events(spark, d).where("related IS NOT NULL")
    p = e.select(F.col("entity").alias("key"), F.col("event_id").alias("seq"), ev.seconds(F.col("ts")).alias("t"), (10 + (F.col("related") % 37) * 0.01).alias("lat"), F.lit(70.0).alias("lon"), F.lit(None).cast("double").alias("place_lat"), F.lit(None).cast("double").alias("place_lon"))
    return m.stays(m.points(p))


@query("enriched_events", f"WITH {EV} SELECT event_id, coalesce(c.c_name, entity::VARCHAR) AS entity_name, coalesce(r.c_name, related::VARCHAR) AS related_name FROM ev LEFT JOIN customer c ON c.c_custkey = entity LEFT JOIN customer r ON r.c_custkey = related")
def enriched_events(spark, d):
    """Events with the names of both ends; an end without a name shows its id."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    e = case_events(spark, d).select("event_id", "entity", "related")
    e = e.join(c.select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("x")), "entity", "left").join(c.select(F.col("c_custkey").alias("related"), F.col("c_name").alias("y")), "related", "left")
    return e.select("event_id", F.coalesce("x", F.col("entity").cast("string")).alias("entity_name"), F.coalesce("y", F.col("related").cast("string")).alias("related_name"))


@query("event_documents", f"WITH {EV} SELECT event_id, coalesce(source, 'unassigned') AS document FROM ev LEFT JOIN documents ON doc_id = event_id")
def event_documents(spark, d):
    """Events with the document of the same number; those without one are unassigned."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), "source")
    return case_events(spark, d).select("event_id").join(docs, "event_id", "left").select("event_id", F.coalesce("source", F.lit("unassigned")).alias("document"))


@query("event_last_mention", f"WITH {EV}, p AS (SELECT entity, ts, event_id FROM ev WHERE event_type = 'purchase') SELECT event_id, last_purchase FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY entity ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM ev) WHERE event_type = 'error' AND last_purchase IS NOT NULL")
def event_last_mention(spark, d):
    """Each error's most recent purchase of the same user before it."""
    w = Window.partitionBy("entity").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = case_events(spark, d).withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return e.where("event_type = 'error' AND last_purchase IS NOT NULL").select("event_id", "last_purchase")


@query("place_counts", f"WITH {EV} SELECT related AS place, count(*) AS posts, count(DISTINCT entity) AS accounts, min({S}) AS first_t, max({S}) AS last_t FROM ev WHERE related IS NOT NULL GROUP BY 1")
def place_counts(spark, d):
    e = case_events(spark, d).where("related IS NOT NULL").withColumn("t", ev.seconds(F.col("ts")))
    return e.groupBy(F.col("related").alias("place")).agg(F.count("*").alias("posts"), F.countDistinct("entity").alias("accounts"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("usual_hours", f"WITH {EV}, h AS (SELECT entity, list_sort(list(hour(ts))) AS l FROM ev GROUP BY 1) SELECT entity, l[len(l) // 4 + 1]::INTEGER AS hour_from, l[3 * len(l) // 4 + 1]::INTEGER AS hour_to FROM h WHERE len(l) >= 4")
def usual_hours(spark, d):
    """The quarter and three-quarter hours of each user's events, not interpolated; counts by hour, so no list grows."""
    h = case_events(spark, d).groupBy("entity", F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("entity").orderBy("h")
    c = h.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("entity")))
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(k * F.col("total") / 4), F.col("h")))
    return c.where("total >= 4").groupBy("entity").agg(at(1).alias("hour_from"), at(3).alias("hour_to"))


@query("dense_ranks", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer")
def dense_ranks(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(w).alias("rank"))


@query("rank_movement", "WITH r AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2), k AS (SELECT o_custkey, y, row_number() OVER (PARTITION BY y ORDER BY s DESC, o_custkey) AS r FROM r), a AS (SELECT * FROM k WHERE y = 1996 AND r <= 10), b AS (SELECT * FROM k WHERE y = 1997 AND r <= 10) SELECT coalesce(a.o_custkey, b.o_custkey) AS id, CASE WHEN a.r IS NULL THEN 'entered' WHEN b.r IS NULL THEN 'left' WHEN b.r < a.r THEN 'up' WHEN b.r > a.r THEN 'down' ELSE 'same' END AS movement FROM a FULL JOIN b ON a.o_custkey = b.o_custkey")
def rank_movement(spark, d):
    """Who entered, left, rose or fell among the ten best customers from one year to the next."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    best = lambda y, r: o.where(F.col("y") == y).groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("s")).orderBy(F.desc("s"), "id").limit(10).select("id", F.row_number().over(Window.orderBy(F.desc("s"), "id")).alias(r))  # noqa: E731  ten rows
    j = best(1996, "a").join(best(1997, "b"), "id", "full")
    return j.select("id", F.when(F.col("a").isNull(), "entered").when(F.col("b").isNull(), "left").when(F.col("b") < F.col("a"), "up").when(F.col("b") > F.col("a"), "down").otherwise("same").alias("movement"))


@query("pinned_ranks", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 2 ELSE 1 END, o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders")
def pinned_ranks(spark, d):
    """Confirmed first, dismissed last, the others by value between them."""
    tier = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    w = Window.partitionBy("o_orderpriority").orderBy(tier, F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("rank"))


@query("type_pair_lift", f"WITH {_CASE_TABLE}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM rel), t AS (SELECT least(x.entity_type, y.entity_type) AS ta, greatest(x.entity_type, y.entity_type) AS tb, count(*) AS e FROM p JOIN ent x ON x.id = a JOIN ent y ON y.id = b GROUP BY 1, 2), c AS (SELECT entity_type, count(*)::DOUBLE AS n FROM ent GROUP BY 1), b AS (SELECT (SELECT count(*) FROM p) / ((SELECT sum(n) FROM c) * ((SELECT sum(n) FROM c) - 1) / 2) AS base) SELECT ta, tb, e AS edges, round(ln((e + 1) / (CASE WHEN ta = tb THEN x.n * (x.n - 1) / 2 ELSE x.n * y.n END * base + 1)), 6) AS lift FROM t JOIN c x ON x.entity_type = ta JOIN c y ON y.entity_type = tb, b")
def type_pair_lift(spark, d):
    """How much more often two types are linked than any two entities are, as a logarithm."""
    e = entities(spark, d)
    p = relationships(spark, d).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    t = p.join(e.select(F.col("id").alias("a"), F.col("entity_type").alias("x")), "a").join(e.select(F.col("id").alias("b"), F.col("entity_type").alias("y")), "b")
    t = t.groupBy(F.least("x", "y").alias("ta"), F.greatest("x", "y").alias("tb")).agg(F.count("*").alias("edges"))
    c = e.groupBy("entity_type").agg(F.count("*").cast("double").alias("n"))
    n, links = c.agg(F.sum("n").alias("all")), p.agg(F.count("*").alias("links"))
    j = t.join(c.select(F.col("entity_type").alias("ta"), F.col("n").alias("nx")), "ta").join(c.select(F.col("entity_type").alias("tb"), F.col("n").alias("ny")), "tb").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(links))  # one row each
    possible = F.when(F.col("ta") == F.col("tb"), F.col("nx") * (F.col("nx") - 1) / 2).otherwise(F.col("nx") * F.col("ny"))
    base = F.col("links") / (F.col("all") * (F.col("all") - 1) / 2)
    return j.select("ta", "tb", "edges", F.round(F.log((F.col("edges") + 1) / (possible * base + 1)), 6).alias("lift"))


@query("demo_plan", "WITH t AS (SELECT c_custkey, bool_and(o_orderstatus = 'F') AS f, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT CASE WHEN f IS NULL THEN 'orphan' WHEN f THEN 'delete' ELSE 'detach' END AS plan, count(*) AS entities FROM t GROUP BY 1")
def demo_plan(spark, d):
    """What a purge of closed orders would do to customers: those with none are orphans, those with no others go, the rest are detached."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_and(F.col("o_orderstatus") == "F").alias("f"))
    t = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return t.groupBy(F.when(F.col("f").isNull(), "orphan").when(F.col("f"), "delete").otherwise("detach").alias("plan")).agg(F.count("*").alias("entities"))


@query("global_search", f"WITH {_CASE_TABLE} (SELECT 'entity' AS kind, id, name AS label FROM ent WHERE contains(lower(id || ' ' || name || ' ' || entity_type), 'ia') ORDER BY id LIMIT 100) UNION ALL (SELECT 'relationship', source_ref::VARCHAR, src || '>' || dst FROM (SELECT DISTINCT source_ref, src, dst FROM rel WHERE contains(lower(src || ' ' || dst), 'c10')) ORDER BY source_ref, src, dst LIMIT 100)")
def global_search(spark, d):
    """At most a hundred entities and a hundred relationships that hold a needle."""
    e = entities(spark, d).where(F.lower(F.concat_ws(" ", "id", "name", "entity_type")).contains("ia")).orderBy("id").limit(100).select(F.lit("entity").alias("kind"), "id", F.col("name").alias("label"))
    r = relationships(spark, d).where(F.lower(F.concat_ws(" ", "src", "dst")).contains("c10")).select("source_ref", "src", "dst").distinct().orderBy("source_ref", "src", "dst").limit(100)
    return e.unionByName(r.select(F.lit("relationship").alias("kind"), F.col("source_ref").cast("string").alias("id"), F.concat_ws(">", "src", "dst").alias("label")))
