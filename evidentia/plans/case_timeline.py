"""Timelines of cases; a case is what one entity did."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import events as ev
from ..sources.tables import EVENTS_SQL as EV
from ..sources.tables import case_events
from .registry import query

S = "CAST(floor(epoch(ts)) AS BIGINT)"

CAT = "CASE event_type WHEN 'click' THEN 'COMMUNICATION' WHEN 'view' THEN 'COMMUNICATION' WHEN 'purchase' THEN 'TRANSACTION' WHEN 'signup' THEN 'REGISTRATION' WHEN 'error' THEN 'INCIDENT' ELSE 'OTHER' END"


@query("timeline_sequence", f"WITH {EV} SELECT entity, event_id, row_number() OVER (PARTITION BY entity ORDER BY ts NULLS LAST, event_id) AS sequence FROM ev")
def timeline_sequence(spark, d):
    return case_events(spark, d).select("entity", "event_id", F.row_number().over(Window.partitionBy("entity").orderBy(F.col("ts").asc_nulls_last(), "event_id")).cast("long").alias("sequence"))


_GAPS = f"WITH {EV}, g AS (SELECT entity, event_id, {S} - lag({S}) OVER (PARTITION BY entity ORDER BY ts, event_id) AS gap FROM ev) "


@query("timeline_gaps", _GAPS + "SELECT entity, event_id, gap AS gap_s FROM g WHERE gap >= 21600 ORDER BY gap DESC, event_id LIMIT 100")
def timeline_gaps(spark, d):
    g = ev.with_gap(case_events(spark, d), "entity").where("gap >= 21600")
    return g.select("entity", "event_id", F.col("gap").alias("gap_s")).orderBy(F.desc("gap_s"), "event_id").limit(100)


@query("timeline_median_gap", _GAPS + "SELECT entity, round(median(gap) / 3600.0, 3) AS median_gap_h FROM g GROUP BY entity HAVING count(*) >= 3")
def timeline_median_gap(spark, d):
    g = ev.with_gap(case_events(spark, d), "entity").groupBy("entity").agg(F.round(F.median("gap") / 3600.0, 3).alias("median_gap_h"), F.count("*").alias("n"))
    return g.where("n >= 3").drop("n")


@query("timeline_daily", f"WITH {EV}, p AS (SELECT ts::DATE::VARCHAR AS day, e FROM (SELECT ts, 'E' || entity AS e FROM ev UNION ALL SELECT ts, 'K' || related FROM ev)) SELECT a.day, a.events, a.communications, a.transactions, b.endpoints FROM (SELECT ts::DATE::VARCHAR AS day, count(*) AS events, count(*) FILTER ({CAT} = 'COMMUNICATION') AS communications, count(*) FILTER ({CAT} = 'TRANSACTION') AS transactions FROM ev GROUP BY 1) a JOIN (SELECT day, count(DISTINCT e) AS endpoints FROM p GROUP BY 1) b USING (day)")
def timeline_daily(spark, d):
    e = case_events(spark, d).withColumn("day", F.col("ts").cast("date").cast("string")).withColumn("c", ev.category(F.col("event_type")))
    n = e.groupBy("day").agg(F.count("*").alias("events"), F.count_if(F.col("c") == "COMMUNICATION").alias("communications"), F.count_if(F.col("c") == "TRANSACTION").alias("transactions"))
    ends = e.select("day", F.explode(F.array(F.concat(F.lit("E"), "entity"), F.concat(F.lit("K"), "related"))).alias("e")).groupBy("day").agg(F.countDistinct("e").alias("endpoints"))
    return n.join(ends, "day")


@query("timeline_filtered", f"WITH {EV} SELECT event_id, entity, event_type FROM ev WHERE {CAT} = 'COMMUNICATION' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11' AND contains(lower(event_type || ' ' || entity || ' ' || related), 'click')")
def timeline_filtered(spark, d):
    e = case_events(spark, d).where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-11'")
    return e.where((ev.category(F.col("event_type")) == "COMMUNICATION") & F.lower(F.concat_ws(" ", "event_type", "entity", "related")).contains("click")).select("event_id", "entity", "event_type")


@query("timeline_fir_summary", f"WITH {EV} SELECT entity, count(*) AS events, count(DISTINCT {CAT}) AS categories, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM ev GROUP BY 1")
def timeline_fir_summary(spark, d):
    e = case_events(spark, d)
    return e.groupBy("entity").agg(F.count("*").alias("events"), F.countDistinct(ev.category(F.col("event_type"))).alias("categories"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("timeline_overlap_days", f"WITH {EV} SELECT related, ts::DATE::VARCHAR AS day, count(DISTINCT entity) AS cases FROM ev WHERE related IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT entity) > 1")
def timeline_overlap_days(spark, d):
    e = case_events(spark, d).where("related IS NOT NULL")
    return e.groupBy("related", F.col("ts").cast("date").cast("string").alias("day")).agg(F.countDistinct("entity").alias("cases")).where("cases > 1")


@query("login_streaks", f"""WITH {EV}, l AS (SELECT entity, ts, event_id, event_type FROM ev WHERE event_type IN ('error', 'signup')), g AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ts, event_id) AS island FROM l),
c AS (SELECT entity, island, count(*) FILTER (event_type = 'error') AS n FROM g GROUP BY 1, 2) SELECT entity, max(n) AS max_streak, arg_max(n, island) AS current_streak FROM c GROUP BY 1""")
def login_streaks(spark, d):
    """Failures in a row, now and at most; a login resets them."""
    w = Window.partitionBy("entity").orderBy("ts", "event_id")
    e = case_events(spark, d).where("event_type IN ('error', 'signup')").withColumn("island", F.sum((F.col("event_type") == "signup").cast("int")).over(w))
    c = e.groupBy("entity", "island").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return c.groupBy("entity").agg(F.max("n").alias("max_streak"), F.max_by("n", "island").alias("current_streak"))


@query("current_versions", f"WITH {EV} SELECT a.event_id, a.entity FROM ev a WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.entity = a.entity AND b.related = a.related AND b.event_type = a.event_type AND b.event_id > a.event_id)")
def current_versions(spark, d):
    """Entries that no later one of the same entity, type and subject supersedes."""
    e = case_events(spark, d)
    keyed = e.where("related IS NOT NULL").groupBy("entity", "related", "event_type").agg(F.max("event_id").alias("event_id")).select("event_id", "entity")
    return keyed.unionByName(e.where("related IS NULL").select("event_id", "entity"))


_POINT = "10 + (related % 37) * 0.01 AS lat, 70 + (event_id % 53) * 0.01 AS lon"
_KM = "2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))"


@query("movement_legs", f"""WITH {EV}, p AS (SELECT entity, event_id, ts, {S} AS s, {_POINT} FROM ev WHERE related IS NOT NULL), l AS (SELECT *, lag(s) OVER w AS ps, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM p WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)),
k AS (SELECT event_id, entity, s - ps AS dt, {_KM} AS km FROM l WHERE ps IS NOT NULL) SELECT event_id, entity, round(km, 3) AS km, CASE WHEN dt > 0 THEN km * 3600 / dt > 130 ELSE true END AS implausible FROM k WHERE km >= 0.25""")
def movement_legs(spark, d):
    """Legs between consecutive positions; positions are derived from the ids."""
    w = Window.partitionBy("entity").orderBy("ts", "event_id")
    p = case_events(spark, d).where("related IS NOT NULL").select("entity", "event_id", "ts", ev.seconds(F.col("ts")).alias("s"), (10 + (F.col("related") % 37) * 0.01).alias("lat"), (70 + (F.col("event_id") % 53) * 0.01).alias("lon"))
    for c in ("s", "lat", "lon"):
        p = p.withColumn(f"p{c}", F.lag(c).over(w))
    k = p.where("ps IS NOT NULL").select("event_id", "entity", (F.col("s") - F.col("ps")).alias("dt"), F.expr(_KM.replace("pow(", "power(")).alias("km")).where("km >= 0.25")
    return k.select("event_id", "entity", F.round("km", 3).alias("km"), F.when(F.col("dt") > 0, F.col("km") * 3600 / F.col("dt") > 130).otherwise(True).alias("implausible"))
