"""Movement of observed subjects: positions, places they stay at, visits, usual hours, companions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal as n

# Radius of the earth and of a place, in kilometres.
EARTH_KM, PLACE_KM = 6371.0088, 0.25


def points(rows: DataFrame) -> DataFrame:
    """key, seq, t, lat, lon, precision: the recorded position, else that of the place, else nothing. Rows without a time are dropped."""
    own, place = n.valid_point(F.col("lat"), F.col("lon")), n.valid_point(F.col("place_lat"), F.col("place_lon"))
    pick = lambda a, b: F.when(own, F.col(a)).when(place, F.col(b))
    return rows.where(F.col("t").isNotNull() & (own | place)).select("key", "seq", "t", pick("lat", "place_lat").alias("lat"), pick("lon", "place_lon").alias("lon"), F.when(own, "recorded").otherwise("approximate").alias("precision"))


def _km(lat: np.ndarray, lon: np.ndarray, a: float, b: float) -> np.ndarray:
    p, q = np.radians(lat), np.radians(a)
    x = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(b - lon) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(x)))


def stays(pts: DataFrame) -> DataFrame:
    """key, place, lat, lon, visits, points, dwell_s, hour_from, hour_to.

    A position belongs to the first place within PLACE_KM of the place's first position, in order of time; so the subject's
    positions are one task. A visit is a run of positions at one place; its dwell is from the first to the last of them. The
    usual hours are the quarter and three-quarter positions of the sorted hours.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "seq"], kind="stable")
        lat, lon, t = pdf.lat.to_numpy(float), pdf.lon.to_numpy(float), pdf.t.to_numpy()
        first: list[int] = []
        where = np.zeros(len(pdf), int)
        for i in range(len(pdf)):
            near = np.flatnonzero(_km(lat[first], lon[first], lat[i], lon[i]) <= PLACE_KM) if first else np.zeros(0, int)
            if len(near):
                where[i] = near[0]
            else:
                where[i] = len(first)
                first.append(i)
        edge = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
        visits, dwell = np.zeros(len(first), int), np.zeros(len(first))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            visits[where[a]] += 1
            dwell[where[a]] += t[b - 1] - t[a]
        rows = []
        for c, i in enumerate(first):
            hours = np.sort(t[where == c] // 3600 % 24)
            rows.append((pdf.key.iloc[0], c + 1, lat[i], lon[i], int(visits[c]), len(hours), int(dwell[c]), int(hours[len(hours) // 4]), int(hours[min(len(hours) - 1, 3 * len(hours) // 4)])))
        return pd.DataFrame(rows, columns=["key", "place", "lat", "lon", "visits", "points", "dwell_s", "hour_from", "hour_to"])

    kind = pts.schema["key"].dataType.simpleString()
    return pts.groupBy("key").applyInPandas(run, f"key {kind}, place long, lat double, lon double, visits long, points long, dwell_s long, hour_from long, hour_to long")


def resolved(events: DataFrame, places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """events (id, lat, lon, entity, related, text) with lat, lon, geo_source: the event's own, that of a linked place, a place named in the text.

    places: place_id, plat, plon. gazetteer: name (lower case, one or two words), glat, glon; the longest name counts, then the
    first in the alphabet. Positions of persons are not used. A text meets the gazetteer by its words and pairs of words.
    """
    p = places.where(n.valid_point(F.col("plat"), F.col("plon")))
    e = events
    for side in ("entity", "related"):
        e = e.join(p.select(F.col("place_id").alias(side), F.col("plat").alias(f"{side}_lat"), F.col("plon").alias(f"{side}_lon")), side, "left")
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 2), " "))
    named = events.select("id", F.explode(F.array_distinct(F.concat(w, pairs))).alias("name")).join(gazetteer, "name")
    best = named.groupBy("id").agg(F.min(F.struct((-F.length("name")).alias("l"), "name", "glat", "glon")).alias("g"))
    e = e.join(best, "id", "left")
    own, one, two = n.valid_point(F.col("lat"), F.col("lon")), F.col("entity_lat").isNotNull(), F.col("related_lat").isNotNull()
    pick = lambda c: F.when(own, F.col(c)).when(one, F.col(f"entity_{c}")).when(two, F.col(f"related_{c}")).otherwise(F.col(f"g.g{c}"))
    source = F.when(own, "event").when(one | two, "linked_location").when(F.col("g").isNotNull(), "gazetteer").otherwise("none")
    return e.select("id", pick("lat").alias("lat"), pick("lon").alias("lon"), source.alias("geo_source"))
