"""Made-up cases for trying and judging the evidence model: a ring among people who also call, pay and meet by chance.

All values follow from the seed by hashing row numbers, so a world is the same on every cluster and of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1_700_000_000
DAYS = 60


def _u(seed: int, what: str, *of) -> Column:
    """Evenly between 0 and 1, from the seed, a name and the row's numbers."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def world(spark: SparkSession, seed: int = 1, people: int = 80, ring: int = 6, events_each: int = 12, signal: float = 0.6, roles: float = 0.25) -> dict[str, DataFrame]:
    """actors (actor, role), events (id, t, kind, a, b, amount), truth (actor).

    The first `ring` people are the ring: a share `signal` of their events is with one another, payments among them are passed on.
    `roles` of the ring are known suspects. kind: CALL, PAY, MEET.
    """
    name = lambda c: F.format_string("P%05d", c)
    p = spark.range(people)
    known = (F.col("id") < ring) & (_u(seed, "role", F.col("id")) < roles)
    actors = p.select(name(F.col("id")).alias("actor"), F.when(known, "suspect").otherwise("").alias("role"))
    e = spark.range(people * events_each).select((F.col("id") % people).alias("id"), F.floor(F.col("id") / people).alias("k"))
    inside = (F.col("id") < ring) & (_u(seed, "in", F.col("id"), F.col("k")) < signal) & F.lit(ring > 1)
    among = F.when(inside, ring).otherwise(people)
    other = F.pmod(F.col("id") + 1 + F.floor(_u(seed, "who", F.col("id"), F.col("k")) * (among - 1)), among)
    x = _u(seed, "kind", F.col("id"), F.col("k"))
    kind = F.when(x < 0.6, "CALL").when(x < 0.85, "PAY").otherwise("MEET")
    t = START + F.floor(_u(seed, "t", F.col("id"), F.col("k")) * DAYS * 86400).cast("long")
    amount = F.when(kind == "PAY", F.round(1000 + _u(seed, "amount", F.col("id"), F.col("k")) * F.when(inside, 90000).otherwise(9000), 2))
    ev = e.select(F.format_string("E%05d-%03d", "id", "k").alias("id"), t.alias("t"), kind.alias("kind"), name(F.col("id")).alias("a"), name(other).alias("b"), amount.alias("amount"), inside.alias("inside"))
    on = ev.where("inside AND kind = 'PAY'").select(F.concat("id", F.lit("-on")).alias("id"), (F.col("t") + 3600).alias("t"), "kind", F.col("b").alias("a"), name(F.pmod(F.substring("b", 2, 5).cast("long") + 1, F.lit(ring))).alias("b"), (F.col("amount") * 0.95).alias("amount"))
    events = ev.drop("inside").unionByName(on).where("a <> b")
    return {"actors": actors, "events": events, "truth": actors.where(F.col("actor") < f"P{ring:05d}").select("actor")}
