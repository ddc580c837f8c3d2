"""Operators over event logs: pairs, windows, gaps, runs, sessions, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Event type -> category, and words within other types, in the order in which they are tried.
CATEGORIES = {
    "FIR_REGISTERED": "FIR / Legal", "OCCURRENCE_RECORDED": "Incident", "INVESTIGATION_ASSIGNED": "Investigation", "COMMUNICATION": "Communication", "CALL": "Communication", "CDR": "Communication", "SMS": "Communication",
    "FINANCIAL": "Financial", "TRANSACTION": "Financial", "PAYMENT": "Financial", "VEHICLE": "Vehicle", "VEHICLE_MOVEMENT": "Vehicle", "VEHICLE_SIGHTING": "Vehicle", "LOCATION": "Location", "LOCATION_EVENT": "Location",
    "VISIT": "Location", "MEETING": "Meeting", "MEET": "Meeting", "DOCUMENT": "Evidence", "EVIDENCE": "Evidence",
}
WORDS = (
    (("CALL", "SMS", "MESSAGE", "CHAT", "COMM", "CDR", "WHATSAPP", "TELEGRAM"), "Communication"),
    (("TRANSACT", "PAYMENT", "TRANSFER", "DEPOSIT", "WITHDRAW", "FINANC", "UPI", "NEFT", "IMPS", "CASH"), "Financial"),
    (("VEHICLE", "SIGHT", "ANPR", "TOLL", "CHALLAN"), "Vehicle"),
    (("MEET",), "Meeting"),
    (("LOCATION", "VISIT", "ARRIVE", "DEPART", "TRAVEL", "MOVEMENT"), "Location"),
    (("FIR", "CHARGE", "ARREST", "COURT", "BAIL", "SEIZ", "RECOVER"), "FIR / Legal"),
    (("EVIDENCE", "DOCUMENT", "FORENSIC"), "Evidence"),
    (("THEFT", "ROBBERY", "ASSAULT", "MURDER", "FRAUD", "INCIDENT", "OCCURRENCE", "OFFENCE", "OFFENSE", "KIDNAP"), "Incident"),
)
#: What the given event types stand for.
GIVEN = {"click": "COMMUNICATION", "view": "COMMUNICATION", "purchase": "TRANSACTION", "signup": "REGISTRATION", "error": "INCIDENT"}


def categorised(kind: Column) -> Column:
    """Category of any event type: by its name, else by the first list with a word in it, else Other."""
    k = F.regexp_replace(F.upper(F.trim(F.coalesce(kind, F.lit("EVENT")))), " ", "_")
    out = F.when(k == "", "Other")
    for name, c in CATEGORIES.items():
        out = out.when(k == name, c)
    for words, c in WORDS:
        out = out.when(k.rlike("|".join(words)), c)
    return out.otherwise("Other")


def category(kind: Column) -> Column:
    out = F.lit("OTHER")
    for k, v in GIVEN.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def communication(ev: DataFrame) -> DataFrame:
    return ev.where(category(F.col("event_type")) == "COMMUNICATION")


def late_hour(ts: Column) -> Column:
    """22:00 to 05:59."""
    return (F.hour(ts) >= 22) | (F.hour(ts) <= 5)


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def undirected_pairs(ev: DataFrame) -> DataFrame:
    """a, b, calls, duration, late_share."""
    g = ev.where("related IS NOT NULL").groupBy(F.least("entity", "related").alias("a"), F.greatest("entity", "related").alias("b"))
    return g.agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("duration"), F.round(F.avg(late_hour(F.col("ts")).cast("double")), 4).alias("late_share"))


def with_gap(ev: DataFrame, key: str) -> DataFrame:
    """gap: seconds since the key's previous event."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return ev.withColumn("gap", seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(w))


def trailing_peak(ev: DataFrame, key: str, window_s: int) -> DataFrame:
    """key, peak: most events in an inclusive trailing window."""
    w = Window.partitionBy(key).orderBy("s").rangeBetween(-window_s, 0)
    return ev.withColumn("s", seconds(F.col("ts"))).withColumn("n", F.count("*").over(w)).groupBy(key).agg(F.max("n").alias("peak"))


def distinct_burst(ev: DataFrame, key: str, who: str, window_s: int) -> DataFrame:
    """key, accounts, at: the trailing window with most distinct accounts, the earliest of equals."""
    w = Window.partitionBy(key).orderBy("s").rangeBetween(-window_s, 0)
    n = ev.withColumn("s", seconds(F.col("ts"))).withColumn("accounts", F.size(F.collect_set(who).over(w)).cast("long"))
    best = n.groupBy(key).agg(F.max(F.struct("accounts", (-F.col("s")).alias("m"))).alias("x"))
    return best.select(key, F.col("x.accounts").alias("accounts"), (-F.col("x.m")).alias("at"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, window_s: int) -> DataFrame:
    """Rows of equal keys whose times differ by window_s at most; columns of right end in _r.

    Time is cut into buckets of window_s, so the join is an equality join on keys and bucket: right rows go to their own
    bucket and both neighbours.
    """
    bucket = F.floor(F.col(t) / window_s)
    a = left.withColumn("_b", bucket)
    b = right.select([F.col(c).alias(c if c in keys else f"{c}_r") for c in right.columns])
    b = b.withColumn("_b", F.explode(F.array(*[F.floor(F.col(f"{t}_r") / window_s) + i for i in (-1, 0, 1)])))
    return a.join(b, [*keys, "_b"]).where(F.abs(F.col(t) - F.col(f"{t}_r")) <= window_s).drop("_b")


def sessions(ev: DataFrame, key: str, gap_s: int) -> DataFrame:
    """key, session, start, end, n: a new session after a pause longer than gap_s."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    g = with_gap(ev, key).withColumn("session", F.sum(F.when(F.col("gap") > gap_s, 1).otherwise(0)).over(w))
    return g.groupBy(key, "session").agg(F.min(seconds(F.col("ts"))).alias("start"), F.max(seconds(F.col("ts"))).alias("end"), F.count("*").alias("n"))


def runs(ev: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, start, n: maximal runs of equal values in time order (gaps and islands)."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    inner = Window.partitionBy(key, value).orderBy("ts", "event_id")
    g = ev.withColumn("_i", F.row_number().over(order) - F.row_number().over(inner))
    return g.groupBy(key, value, "_i").agg(F.min(seconds(F.col("ts"))).alias("start"), F.count("*").alias("n")).drop("_i")


def busiest_window(ev: DataFrame, key: str, width: int = 3) -> DataFrame:
    """key, start_hour, n: the circular window of width hours with most events; ties to the smallest start."""
    h = ev.groupBy(key, F.hour("ts").alias("h")).agg(F.count("*").alias("c"))
    spread = h.withColumn("start_hour", F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (F.col("h") - i + 24) % 24)))
    n = spread.groupBy(key, "start_hour").agg(F.sum("c").alias("n"))
    best = n.groupBy(key).agg(F.max(F.struct("n", (-F.col("start_hour")).alias("m"))).alias("x"))
    return best.select(key, (-F.col("x.m")).alias("start_hour"), F.col("x.n").alias("n"))


def robust_z(df: DataFrame, value: str) -> DataFrame:
    """z: distance from the median in units of 1.4826 median absolute deviations; population deviation where that is 0."""
    mid = df.agg(F.median(value).alias("_m"), F.stddev_pop(value).alias("_sd"), F.avg(value).alias("_avg"))
    d = df.crossJoin(F.broadcast(mid))  # one row
    mad = d.agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("_mad"))
    d = d.crossJoin(F.broadcast(mad))  # one row
    scale = 1.4826 * F.col("_mad")
    z = F.when(scale > 1e-9, (F.col(value) - F.col("_m")) / scale).when(F.col("_sd") > 1e-9, (F.col(value) - F.col("_avg")) / F.col("_sd")).otherwise(0.0)
    return d.withColumn("z", F.round(z, 4)).drop("_m", "_sd", "_avg", "_mad")


def midrank(df: DataFrame, value: str) -> DataFrame:
    """percentile: (rows below + half of the equal ones) / rows. Counts per value first, so ties cost nothing."""
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    below = F.sum("_c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    total = df.agg(F.count("*").alias("_n"))
    p = counts.withColumn("_b", F.coalesce(below, F.lit(0))).crossJoin(F.broadcast(total))  # one row
    return df.join(p.select(value, F.round((F.col("_b") + 0.5 * F.col("_c")) / F.col("_n"), 6).alias("percentile")), value)
