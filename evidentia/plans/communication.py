"""Communication analytics over the event log."""

from pyspark.sql import functions as F

from ..operators import events as ev
from ..sources.tables import EVENTS_SQL as EV
from ..sources.tables import case_events
from .registry import query

LATE = "(hour(ts) >= 22 OR hour(ts) <= 5)"
S = "CAST(floor(epoch(ts)) AS BIGINT)"


@query("cdr_top_pairs", f"WITH {EV} SELECT least(entity, related) AS a, greatest(entity, related) AS b, count(*) AS calls, round(sum(value), 2) AS duration, round(avg(CASE WHEN {LATE} THEN 1.0 ELSE 0.0 END), 4) AS late_share FROM ev WHERE related IS NOT NULL AND event_type IN ('click', 'view') GROUP BY 1, 2 ORDER BY calls DESC, a, b LIMIT 25")
def cdr_top_pairs(spark, d):
    return ev.undirected_pairs(ev.communication(case_events(spark, d))).orderBy(F.desc("calls"), "a", "b").limit(25)


@query("cdr_top_entities", f"WITH {EV} SELECT e AS entity, count(*) AS calls FROM (SELECT entity AS e FROM ev WHERE event_type IN ('click', 'view') UNION ALL SELECT related FROM ev WHERE related IS NOT NULL AND event_type IN ('click', 'view')) GROUP BY e ORDER BY calls DESC, e LIMIT 15")
def cdr_top_entities(spark, d):
    e = ev.communication(case_events(spark, d)).select(F.explode(F.array("entity", "related")).alias("entity")).where("entity IS NOT NULL")
    return e.groupBy("entity").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "entity").limit(15)


@query("cdr_summary", f"WITH {EV} SELECT count(*) AS events, count(DISTINCT entity) AS entities, round(sum(value), 2) AS duration, count(*) FILTER ({LATE}) AS late FROM ev WHERE event_type IN ('click', 'view')")
def cdr_summary(spark, d):
    return ev.communication(case_events(spark, d)).agg(F.count("*").alias("events"), F.countDistinct("entity").alias("entities"), F.round(F.sum("value"), 2).alias("duration"), F.count_if(ev.late_hour(F.col("ts"))).alias("late"))


@query("late_hour_share", f"WITH {EV} SELECT event_type, round(avg(CASE WHEN {LATE} THEN 1.0 ELSE 0.0 END), 6) AS late_share FROM ev GROUP BY 1")
def late_hour_share(spark, d):
    return case_events(spark, d).groupBy("event_type").agg(F.round(F.avg(ev.late_hour(F.col("ts")).cast("double")), 6).alias("late_share"))


@query("event_category", f"WITH {EV} SELECT CASE event_type WHEN 'click' THEN 'COMMUNICATION' WHEN 'view' THEN 'COMMUNICATION' WHEN 'purchase' THEN 'TRANSACTION' WHEN 'signup' THEN 'REGISTRATION' WHEN 'error' THEN 'INCIDENT' ELSE 'OTHER' END AS category, count(*) AS n FROM ev GROUP BY 1")
def event_category(spark, d):
    return case_events(spark, d).groupBy(ev.category(F.col("event_type")).alias("category")).agg(F.count("*").alias("n"))


@query("activity_heatmap", f"WITH {EV} SELECT CAST(isodow(ts) AS BIGINT) AS weekday, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM ev GROUP BY 1, 2")
def activity_heatmap(spark, d):
    return case_events(spark, d).groupBy((F.weekday("ts") + 1).cast("long").alias("weekday"), F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query("busiest_window", f"""WITH {EV}, h AS (SELECT entity, CAST(hour(ts) AS BIGINT) AS h, count(*) AS c FROM ev GROUP BY 1, 2),
s AS (SELECT entity, (h - i + 24) % 24 AS start_hour, sum(c)::BIGINT AS n FROM h, range(3) r(i) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, start_hour) AS r FROM s) SELECT entity, start_hour::BIGINT AS start_hour, n FROM k WHERE r = 1""")
def busiest_window(spark, d):
    return ev.busiest_window(case_events(spark, d), "entity").withColumn("start_hour", F.col("start_hour").cast("long"))


@query("comm_burst_peak", f"WITH {EV}, n AS (SELECT entity, count(*) OVER (PARTITION BY entity ORDER BY {S} RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS n FROM ev) SELECT entity, max(n) AS peak FROM n GROUP BY entity")
def comm_burst_peak(spark, d):
    return ev.trailing_peak(case_events(spark, d), "entity", 6 * 3600)


@query("key_burst_accounts", f"""WITH {EV}, e AS (SELECT related, entity, {S} AS s FROM ev), w AS (SELECT a.related, a.s, count(DISTINCT b.entity) AS accounts FROM (SELECT DISTINCT related, s FROM e) a JOIN e b ON a.related = b.related AND b.s BETWEEN a.s - 3600 AND a.s GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY related ORDER BY accounts DESC, s) AS r FROM w) SELECT related, accounts, s AS at FROM k WHERE r = 1""")
def key_burst_accounts(spark, d):
    return ev.distinct_burst(case_events(spark, d).where("related IS NOT NULL"), "related", "entity", 3600)


_PAIR = f"""WITH {EV}, e AS (SELECT event_id, entity, related, {S} AS s FROM ev)
SELECT a.event_id AS first_event, b.event_id AS second_event, a.related AS shared, abs(a.s - b.s) AS apart_s FROM e a JOIN e b ON a.related = b.related AND a.entity < b.entity AND abs(a.s - b.s) <= """


def _timed(spark, d):
    return case_events(spark, d).where("related IS NOT NULL").select("event_id", "entity", "related", ev.seconds(F.col("ts")).alias("s"))


def _pairs(spark, d, window_s):
    e = _timed(spark, d)
    j = ev.interval_join(e, e, ["related"], "s", window_s).where("entity < entity_r")
    return j.select(F.col("event_id").alias("first_event"), F.col("event_id_r").alias("second_event"), F.col("related").alias("shared"), F.abs(F.col("s") - F.col("s_r")).alias("apart_s"))


@query("contradiction_pairs", _PAIR + "7200")
def contradiction_pairs(spark, d):
    """The same thing used by two different people within two hours."""
    return _pairs(spark, d, 7200)


@query("copresence_pairs", f"SELECT x.a, x.b, count(*) AS meetings, min(apart) AS closest_s FROM (WITH {EV}, e AS (SELECT entity, related, {S} AS s FROM ev) SELECT a.entity AS a, b.entity AS b, abs(a.s - b.s) AS apart FROM e a JOIN e b ON a.related = b.related AND a.entity < b.entity AND abs(a.s - b.s) <= 1800) x GROUP BY 1, 2")
def copresence_pairs(spark, d):
    e = _timed(spark, d)
    j = ev.interval_join(e, e, ["related"], "s", 1800).where("entity < entity_r")
    return j.groupBy(F.col("entity").alias("a"), F.col("entity_r").alias("b")).agg(F.count("*").alias("meetings"), F.min(F.abs(F.col("s") - F.col("s_r"))).alias("closest_s"))


@query("meeting_sessions", f"""WITH {EV}, g AS (SELECT related, event_id, ts, {S} AS s, {S} - lag({S}) OVER (PARTITION BY related ORDER BY ts, event_id) AS gap FROM ev WHERE related IS NOT NULL),
n AS (SELECT related, s, sum(CASE WHEN gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY related ORDER BY ts, event_id) AS session FROM g) SELECT related, session::BIGINT AS session, min(s) AS start, max(s) AS "end", count(*) AS n FROM n GROUP BY 1, 2""")
def meeting_sessions(spark, d):
    return ev.sessions(case_events(spark, d).where("related IS NOT NULL"), "related", 7200)


@query("visit_runs", f"""WITH {EV}, g AS (SELECT entity, event_type, {S} AS s, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) - row_number() OVER (PARTITION BY entity, event_type ORDER BY ts, event_id) AS i FROM ev) SELECT entity, event_type, min(s) AS start, count(*) AS n FROM g GROUP BY entity, event_type, i""")
def visit_runs(spark, d):
    return ev.runs(case_events(spark, d), "entity", "event_type")


@query("robust_z", f"""WITH {EV}, t AS (SELECT entity, count(*) AS n FROM ev GROUP BY 1), m AS (SELECT median(n) AS m, stddev_pop(n) AS sd, avg(n) AS a FROM t), d AS (SELECT t.*, m.*, (SELECT median(abs(n - m)) FROM t, m) AS mad FROM t, m)
SELECT entity, n, round(CASE WHEN 1.4826 * mad > 1e-9 THEN (n - m) / (1.4826 * mad) WHEN sd > 1e-9 THEN (n - a) / sd ELSE 0 END, 4) AS z FROM d""")
def robust_z(spark, d):
    return ev.robust_z(case_events(spark, d).groupBy("entity").agg(F.count("*").alias("n")), "n")


@query("midrank_percentile", f"WITH {EV}, t AS (SELECT entity, count(*) AS n FROM ev GROUP BY 1) SELECT entity, n, round((rank() OVER (ORDER BY n) - 1 + 0.5 * count(*) OVER (PARTITION BY n)) / count(*) OVER (), 6) AS percentile FROM t")
def midrank_percentile(spark, d):
    return ev.midrank(case_events(spark, d).groupBy("entity").agg(F.count("*").alias("n")), "n")


@query("narratives", f"""WITH {EV}, e AS (SELECT * FROM ev WHERE related IS NOT NULL), f AS (SELECT related, arg_min(entity, (ts, event_id)) AS first_account, max(ts)::DATE::VARCHAR AS last_day, count(*) AS posts, count(DISTINCT entity) AS accounts FROM e GROUP BY 1),
p AS (SELECT related, d, c, row_number() OVER (PARTITION BY related ORDER BY c DESC, d) AS r FROM (SELECT related, ts::DATE::VARCHAR AS d, count(*) AS c FROM e GROUP BY 1, 2)), m AS (SELECT related, median(c) AS daily_median FROM p GROUP BY 1)
SELECT f.*, p.d AS peak_day, p.c AS peak, m.daily_median FROM f JOIN p ON f.related = p.related AND p.r = 1 JOIN m ON f.related = m.related""")
def narratives(spark, d):
    e = case_events(spark, d).where("related IS NOT NULL")
    first = e.groupBy("related").agg(F.min_by("entity", F.struct("ts", "event_id")).alias("first_account"), F.max("ts").cast("date").cast("string").alias("last_day"), F.count("*").alias("posts"), F.countDistinct("entity").alias("accounts"))
    daily = e.groupBy("related", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("c"))
    peak = daily.groupBy("related").agg(F.max_by(F.struct("d", "c"), F.struct("c", (-F.unix_date("d")).alias("x"))).alias("p"), F.median("c").alias("daily_median"))
    return first.join(peak, "related").select("related", "first_account", "last_day", "posts", "accounts", F.col("p.d").cast("string").alias("peak_day"), F.col("p.c").alias("peak"), "daily_median")
