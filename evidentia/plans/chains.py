"""Integrity checks and stream-shaped counts over the event log."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import integrity
from ..sources.tables import EVENTS_SQL as EV
from ..sources.tables import case_events, table
from ..streaming import windows
from .registry import query

S = "CAST(floor(epoch(ts)) AS BIGINT)"


@query("row_fingerprints", "SELECT event_id, sha256(event_id || '|' || user_id || '|' || event_type || '|' || props) AS fingerprint FROM events")
def row_fingerprints(spark, d):
    return table(spark, d, "events").select("event_id", integrity.fingerprint("event_id", "user_id", "event_type", "props").alias("fingerprint"))


@query("hash_chain_verify", f"WITH {EV}, e AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY event_id) AS seq FROM ev) SELECT entity, seq, CASE WHEN event_id % 500 = 7 THEN 'content' ELSE 'link' END AS reason FROM e WHERE event_id % 500 = 7 OR (event_id % 500 <> 7 AND seq > 1 AND event_id IN (SELECT b.event_id FROM e a JOIN e b ON a.entity = b.entity AND b.seq = a.seq + 1 WHERE a.event_id % 500 = 7))")
def hash_chain_verify(spark, d):
    """A chain in which every 500th entry was edited after the fact: the edit and the broken link after it are found."""
    w = Window.partitionBy("entity").orderBy("event_id")
    e = case_events(spark, d).withColumn("seq", F.row_number().over(w).cast("long")).withColumn("body", F.concat_ws("|", "event_id", "event_type"))
    # each entry is anchored to the content before it, so a chain is built without a loop
    e = e.withColumn("prev", F.coalesce(F.sha2(F.concat(F.lit("x"), F.lag("body").over(w)), 256), F.lit("")))
    e = e.withColumn("digest", F.sha2(F.concat(F.lit("x"), F.when(F.col("event_id") % 500 == 7, F.concat("body", F.lit("!"))).otherwise(F.col("body"))), 256))
    before = F.coalesce(F.lag("digest").over(w), F.lit(""))
    e = e.withColumn("before", before)
    reason = F.when(F.col("digest") != F.sha2(F.concat(F.lit("x"), F.col("body")), 256), "content").when(F.col("prev") != F.col("before"), "link")
    return e.select("entity", "seq", reason.alias("reason")).where("reason IS NOT NULL")


@query("stream_sliding_counts", f"WITH {EV}, w AS (SELECT entity, ({S} // 1800 - i) * 1800 AS start FROM ev, range(2) r(i)) SELECT entity, start::BIGINT AS start, count(*) AS n FROM w GROUP BY 1, 2")
def stream_sliding_counts(spark, d):
    e = case_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sliding_counts(e, "entity", "1 hour", "30 minutes")


@query("stream_sessions", f"WITH {EV}, g AS (SELECT entity, ts, {S} AS s, CASE WHEN ts - lag(ts) OVER (PARTITION BY entity ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM ev), n AS (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT entity, min(s) AS start, count(*) AS n FROM n GROUP BY entity, k")
def stream_sessions(spark, d):
    e = case_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.session_counts(e, "entity", "2 hours")


@query("stream_dedupe", f"WITH {EV} SELECT DISTINCT entity, related, event_type FROM ev")
def stream_dedupe(spark, d):
    return windows.first_seen(case_events(spark, d), ["entity", "related", "event_type"]).select("entity", "related", "event_type")


@query("rate_limit", f"WITH {EV} SELECT entity, ({S} // 3600 * 3600)::BIGINT AS start, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) > 2")
def rate_limit(spark, d):
    return windows.over_limit(case_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "entity", "1 hour", 2)
