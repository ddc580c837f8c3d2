"""Work on cases: who is told of what, what waits for approval, what is overdue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of requests that wait, and of deadlines that are over.
PENDING = ("pending", "requested", "submitted", "awaiting", "open")
OVER = ("done", "completed", "complete", "closed", "met", "cancelled", "canceled", "approved", "rejected")


def snapshot(approvals: DataFrame, deadlines: DataFrame, cases: DataFrame, today: Column) -> DataFrame:
    """One row: approvals_pending, deadlines_open, deadlines_overdue of the given cases.

    approvals: case_number, status. deadlines: case_number, status, due (date or null). cases: case_number.
    """
    mine = cases.select("case_number").distinct()
    status = F.lower(F.coalesce("status", F.lit("")))
    a = approvals.join(mine, "case_number", "left_semi").agg(F.count_if(status.isin(*PENDING)).alias("approvals_pending"))
    live = ~status.isin(*OVER)
    d = deadlines.join(mine, "case_number", "left_semi").agg(F.count_if(live).alias("deadlines_open"), F.count_if(live & F.coalesce(F.col("due") < today, F.lit(False))).alias("deadlines_overdue"))
    return a.crossJoin(d)  # one row each


def recipients(users: DataFrame, roles: DataFrame, access: DataFrame, permission: str) -> DataFrame:
    """case_number, user: active users whose role has the permission, for each case they may see.

    users: user, role, active (null: active). roles: role, permission. access: case_number, user.
    """
    may = roles.where(F.col("permission") == permission).select("role").distinct()
    u = users.where(F.coalesce("active", F.lit(True))).join(may, "role", "left_semi").select("user").distinct()
    return access.select("case_number", "user").distinct().join(u, "user", "left_semi").select("case_number", "user")


def undelivered(hits: DataFrame, access: DataFrame, known: DataFrame) -> DataFrame:
    """user, case_number, ref: hits of active watch-lists whose owners may see the case, once each, that no notice told of yet.

    hits: owner, active, case_number, item, source_key. known: user, case_number, ref.
    """
    h = hits.where("active").select(F.col("owner").alias("user"), "case_number", F.concat_ws(":", "item", "source_key").alias("ref")).distinct()
    return h.join(access.select("user", "case_number").distinct(), ["user", "case_number"], "left_semi").join(known.select("user", "case_number", "ref"), ["user", "case_number", "ref"], "left_anti")


def approved(wanted: DataFrame, requests: DataFrame) -> DataFrame:
    """wanted (case_number, kind, ref) with approved: whether a second person has agreed. requests: case_number, kind, ref, status, asked_by, decided_by."""
    two = F.coalesce(F.col("asked_by") != F.col("decided_by"), F.lit(False))
    yes = requests.where((F.col("status") == "approved") & two).select("case_number", "kind", "ref", F.lit(True).alias("approved")).distinct()
    return wanted.join(yes, ["case_number", "kind", "ref"], "left").withColumn("approved", F.coalesce("approved", F.lit(False)))
