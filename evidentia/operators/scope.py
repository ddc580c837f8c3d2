"""What belongs to a case, who may see it, and how it is masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_relationships(rel: DataFrame, ent: DataFrame, case: str, candidates: bool = False) -> DataFrame:
    """Relationships both of whose ends belong to the case; unconfirmed ones only on request."""
    own = ent.where(F.col("case_number") == case).select("id")
    rel = rel if candidates else rel.where(F.col("state") != "candidate")
    return rel.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")


def case_entities(ent: DataFrame, rel: DataFrame, case: str) -> DataFrame:
    """Entities of the case, and all ends of its relationships."""
    inside = case_relationships(rel, ent, case).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ent.where(F.col("case_number") == case).unionByName(ent.join(inside, "id", "left_semi")).distinct()


def mask(text: Column) -> Column:
    """Two characters at either end; all stars if there are four at most."""
    n = F.length(text)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(text, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(2))))


def search(ent: DataFrame, needle: str, limit: int) -> DataFrame:
    """Entities with the needle in id, name or type, in either case."""
    found = F.lower(F.concat_ws(" ", "id", "name", "entity_type")).contains(needle.lower())
    return ent.where(found).orderBy("id").limit(limit)


def visible(cases: DataFrame, members: DataFrame, user, role: str) -> DataFrame:
    """An administrator sees all cases, the demonstration role only demonstrations, an auditor all but those; others see shared cases, their own, and those they are members of."""
    if role == "admin":
        return cases
    if role == "demo":
        return cases.where("is_demo")
    if role == "auditor":
        return cases.where(~F.col("is_demo"))
    joined = members.where(F.col("member") == user).select("case_number").distinct().withColumn("_m", F.lit(True))
    c = cases.join(joined, "case_number", "left").where(~F.col("is_demo"))
    return c.where((F.col("visibility") == "shared") | (F.col("created_by") == user) | F.col("_m").isNotNull()).drop("_m")
