"""Unusual entities of a case: isolation forest and local outlier factor in numpy, their sum, and what explains it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of the two scores, and the limits of review and of high severity.
ISOLATION, OUTLIER, REVIEW, HIGH = 0.65, 0.35, 62, 80
TREES, SAMPLE, SEED, FEWEST = 100, 256, 42, 6


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Score of each row, higher if it is easier to cut off by random splits. Rows that are equal score alike."""
    rng, n = np.random.default_rng(seed), len(x)
    size = min(SAMPLE, n)
    limit, depth = int(np.ceil(np.log2(max(size, 2)))), np.zeros(n)
    for _ in range(TREES):
        todo = [(rng.choice(n, size, replace=False), np.arange(n), 0)]
        while todo:
            inside, rows, level = todo.pop()
            wide = np.flatnonzero(np.ptp(x[inside], axis=0) > 0) if len(inside) > 1 else np.zeros(0, int)
            if level >= limit or not len(wide) or not len(rows):
                depth[rows] += level + _expected(len(inside))
                continue
            f = int(rng.choice(wide))
            at = rng.uniform(x[inside, f].min(), x[inside, f].max())
            for side in (True, False):
                todo.append((inside[(x[inside, f] <= at) == side], rows[(x[rows, f] <= at) == side], level + 1))
    return 2.0 ** (-depth / TREES / max(float(_expected(size)), 1e-9))


def outlier_factor(x: np.ndarray) -> np.ndarray:
    """Density of the nearest rows over a row's own; about 1 inside, larger outside. Blocks of rows bound the memory."""
    n = len(x)
    k = max(2, min(10, n - 1))
    near, dist = np.zeros((n, k), int), np.zeros((n, k))
    size = (x**2).sum(1)
    for a in range(0, n, 1024):
        d = np.sqrt(np.maximum(size[a : a + 1024, None] - 2 * x[a : a + 1024] @ x.T + size[None], 0))
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near[a : a + 1024] = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist[a : a + 1024] = np.take_along_axis(d, near[a : a + 1024], 1)
    reach = np.maximum(dist, dist[near, -1])
    density = 1 / np.maximum(reach.mean(1), 1e-10)
    return density[near].mean(1) / density


def scaled(v: np.ndarray) -> np.ndarray:
    return np.round((v - v.min()) / (v.max() - v.min() + 1e-9), 4)


def both(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores from 0 to 1; zeros for fewer than six rows. Columns count alike, whatever their units."""
    if len(x) < FEWEST:
        return np.zeros(len(x)), np.zeros(len(x))
    spread = x.std(0)
    x = (x - x.mean(0)) / np.where(spread > 0, spread, 1)
    return scaled(isolation(x)), scaled(outlier_factor(x))


def anomaly_scores(features: DataFrame, columns: list[str], key: str = "entity", case: str = "case") -> DataFrame:
    """case, entity, isolation, outlier, score (0 to 100), severity, and driver: the column whose removal lowers the score most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = pdf[columns].astype(float).fillna(0.0).to_numpy()
        a, b = both(x)
        score = np.round(100 * (ISOLATION * a + OUTLIER * b))
        less = []
        for c in range(len(columns)):
            a2, b2 = both(np.delete(x, c, 1)) if len(columns) > 1 else (np.zeros(len(x)), np.zeros(len(x)))
            less.append(score - 100 * (ISOLATION * a2 + OUTLIER * b2))
        driver = np.array(columns, object)[np.argmax(less, axis=0)] if len(pdf) else []
        return pd.DataFrame({"case": pdf[case], "entity": pdf[key], "isolation": a, "outlier": b, "score": score.astype(int), "driver": driver})

    got = features.groupBy(case).applyInPandas(run, "case string, entity string, isolation double, outlier double, score long, driver string")
    return got.withColumn("severity", F.when(F.col("score") >= HIGH, "High").when(F.col("score") >= REVIEW, "Review"))


def factors(features: DataFrame, degree: str, betweenness: str, amount: str, events: str) -> DataFrame:
    """features with the sentences that explain a score."""
    said = F.array_compact(F.array(
        F.when(F.col(degree) >= 4, F.format_string("%d graph connections", F.col(degree).cast("long"))), F.when(F.col(betweenness) >= 0.15, "high betweenness / bridge position"),
        F.when(F.col(amount) > 0, F.format_string("transaction-linked activity %s", F.format_number(amount, 0))), F.when(F.col(events) >= 3, F.format_string("%d observed events", F.col(events).cast("long"))),
    ))
    return features.withColumn("factors", F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("multivariate deviation from network baseline"))))
