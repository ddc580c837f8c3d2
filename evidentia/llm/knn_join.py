"""Exact k nearest by integer inner product: a Voronoi join.

Data and queries are grouped by their nearest pivot; rows drawn by hash are the pivots, as many as the root of the rows, but
PIVOTS at least and MOST_PIVOTS at most, so that no more vectors reach the driver. Each group's summary (rows, radius, largest norm) bounds the product of any query with any member:
q.p + |q| * radius, and |q| * norm. A query first meets its home group; its k-th score there is a floor, and it is copied
only to groups whose bound reaches the floor. Groups are cut into blocks of data (BLOCK) and of queries (QUERIES), so that
a common vector or a popular group loads no single task. Every block is solved exactly and only scores above the floor
leave it.

Components become floor(256 * x). Vectors that are null or hold a null or non-finite component, and rows without id, take
no part. Shorter vectors count as filled up with zeros. Products too large for doubles are computed with whole numbers and
held at the limits of a long. Equal scores go to the smaller id; a query's own id is never an answer, also where rows repeat.
Rows that repeat an id count each, as queries and as answers, as in the SQL: a pair of rows meets once, in the query row's
home group or in another one, and the k ranks of an id are the best pairs of all its rows. An empty table has no answers.
Other columns of the input, of whatever names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PIVOTS, MOST_PIVOTS, BLOCK, QUERIES = 64, 4096, 4096, 1024


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v (array of doubles): rows that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, filled up with zeros."""
    flat, off = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (off == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(off), width))
    rows = np.repeat(np.arange(len(off)), off)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(off) - off, off)] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held in doubles, as longs."""
    if len(q) and len(x) and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] >= 2.0**53:
        low, high = -(1 << 63), (1 << 63) - 1
        whole = lambda m: np.array([[int(c) for c in r] for r in m], object)
        return np.array([[min(max(s, low), high) for s in r] for r in whole(q) @ whole(x).T], np.int64)
    return (q @ x.T).astype(np.int64)


def _solve(q_ids, q, floors, ids, x, k):
    """(query, id, score): for each query its k best that reach the floor."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    s = products(q, x)
    ok = (s >= floors[:, None]) & (q_ids[:, None] != ids[None])
    out = []
    for i in range(len(q)):
        at = np.flatnonzero(ok[i])
        if len(at) > k:
            kth = np.partition(s[i, at], len(at) - k)[len(at) - k]
            at = at[s[i, at] >= kth]
        at = at[np.argsort(-s[i, at], kind="stable")][:k]
        out.append((np.full(len(at), q_ids[i]), ids[at], s[i, at]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def _meet(queries: DataFrame, data: DataFrame, sizes: dict[int, int], width: int, k: int) -> DataFrame:
    """queries: id, v, g, floor. data: id, v, g. Blocks of both that share a group meet."""
    asked = {r[0]: r[1] for r in queries.groupBy("g").count().collect()}  # a row for each pivot at most
    spark = data.sparkSession
    plan = spark.createDataFrame([(g, -(-n // QUERIES), -(-sizes.get(g, 1) // BLOCK)) for g, n in asked.items()], "g int, qb int, db int")
    plan = F.broadcast(plan)  # a row for each pivot at most
    left = queries.join(plan, "g").withColumn("qb", F.pmod(F.xxhash64("id"), "qb")).withColumn("db", F.explode(F.sequence(F.lit(0), F.col("db") - 1)))
    right = data.join(plan, "g").withColumn("db", F.pmod(F.xxhash64("id"), "db")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    keys = ["g", F.col("qb").cast("int").alias("qb"), F.col("db").cast("int").alias("db")]

    def local(a: pa.Table, b: pa.Table) -> pa.Table:
        names, schema = ["query_id", "vec_id", "score"], [pa.int64()] * 3
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in schema], names)
        vec = lambda c: matrix(c.combine_chunks(), width)
        got = _solve(a.column("id").to_numpy(), vec(a.column("v")), a.column("floor").to_numpy(), b.column("id2").to_numpy(), vec(b.column("v2")), k)
        return pa.table([pa.array(c) for c in got], names)

    a = left.select("id", "v", "floor", *keys).groupBy("g", "qb", "db")
    b = right.select(F.col("id").alias("id2"), F.col("v").alias("v2"), F.col("g").alias("g2"), F.col("qb").cast("int").alias("qb2"), F.col("db").cast("int").alias("db2")).groupBy("g2", "qb2", "db2")
    return a.cogroup(b).applyInArrow(local, "query_id long, vec_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, id_col: str, vector: str, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: column function of the id."""
    rows = usable(vectors, id_col, vector).withColumn("v", F.transform("v", _floor))
    width, count = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    drawn = rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(min(max(PIVOTS, int(count**0.5)), MOST_PIVOTS)).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not drawn or not width:
        return empty
    pivots = np.zeros((len(drawn), width))
    for i, r in enumerate(drawn):
        pivots[i, : len(r.v)] = r.v
    pivots = np.unique(pivots, axis=0)

    def nearest(batches):
        for b in batches:
            x = matrix(b.column(1), width)
            far = ((x**2).sum(1)[:, None] - 2 * x @ pivots.T) + (pivots**2).sum(1)[None]
            g = far.argmin(1)
            dist = np.sqrt(((x - pivots[g]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(g.astype(np.int32)), pa.array(dist), pa.array(np.sqrt((x**2).sum(1)))], ["id", "v", "g", "dist", "norm"])

    data = cut(rows.mapInArrow(nearest, "id long, v array<double>, g int, dist double, norm double"))
    summary = data.groupBy("g").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.max("norm").alias("norm")).collect()  # a row for each pivot at most
    sizes = {r.g: r.n for r in summary}
    queries = data.where(is_query(F.col("id")))
    lowest = F.lit(-(1 << 63)).cast("long")
    first = cut(_best(_meet(queries.select("id", "v", "g", lowest.alias("floor")), data.select("id", "v", "g"), sizes, width, k), k))
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))

    def reach(batches):
        group = np.array([r.g for r in summary], np.int32)
        radius, norm = np.array([r.radius for r in summary]), np.array([r.norm for r in summary])
        for b in batches:
            q = matrix(b.column(1), width)
            own, floor = b.column(2).to_numpy(), b.column(3).to_numpy()
            size = np.sqrt((q**2).sum(1))[:, None]
            bound = np.minimum(q @ pivots[group].T + size * radius, size * norm) + 1e-6 * (1 + size * norm)
            i, j = np.nonzero((bound >= floor[:, None]) & (own[:, None] != group[None]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(group[j]), pa.array(floor[i])], ["id", "v", "g", "floor"])

    known = queries.select("id", "v", "g").join(floors, "id", "left").select("id", "v", "g", F.coalesce("floor", lowest).alias("floor"))
    away = cut(known.mapInArrow(reach, "id long, v array<double>, g int, floor long"))
    second = _meet(away, data.select("id", "v", "g"), sizes, width, k)
    found = _best(first.select("query_id", "vec_id", "score").unionByName(second), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floor(x):
    """floor(256 * x) as a double."""
    y = x * F.lit(256.0)
    return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)


def op3_exact_top_k(embeddings: DataFrame) -> DataFrame:
    """Contract columns of op3."""
    return exact_top_k(embeddings, "vec_id", "embedding", lambda i: i % 50 == 0, 5)


def op3_sql() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""
