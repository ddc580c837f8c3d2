"""Entity resolution: which records a value may mean, by n-grams of characters, by spelling and by identifiers."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import normal as n
from .graph import cut

# Weights of the parts, the least score of an equal identifier, the threshold, and the bands.
COSINE, LEXICAL, PARTIAL, EXACT, EXACT_LEAST, THRESHOLD, MEDIUM, HIGH = 0.52, 0.28, 0.14, 0.06, 0.93, 0.60, 0.70, 0.85
#: Most n-grams, and most cells of the queries' matrix, that go to all tasks; beyond them n-grams are joined. Records of one task.
BROADCAST, CELLS, TASK = 1 << 18, 1 << 22, 8192


def grams(text: str | None) -> Counter:
    """Runs of 2 to 5 characters within words that are padded with a blank on both sides."""
    return Counter([p[i : i + k] for p in [f" {w} " for w in (text or "").split(" ") if w] for k in range(2, 6) for i in range(len(p) - k + 1)])


def spread(texts: DataFrame) -> DataFrame:
    """id, gram, n of id, text."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = [grams(t) for t in part.column(1).to_pylist()]
                at = np.repeat(np.arange(len(found)), [len(c) for c in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array([g for c in found for g in c], pa.string()), pa.array([x for c in found for x in c.values()], pa.int64())], ["id", "gram", "n"])

    return texts.mapInArrow(run, StructType([texts.schema["id"], StructField("gram", StringType()), StructField("n", LongType())]))


def frequencies(texts: DataFrame) -> DataFrame:
    """gram, df: in how many texts; counted by batch first."""

    def run(batches):
        for batch in batches:
            c = Counter()
            for t in batch.column(0).to_pylist():
                c.update(grams(t).keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("df"))


def beside(small: DataFrame, rows: int) -> DataFrame:
    """One side of a join, sent to all tasks up to a bound; beyond it both sides are shuffled.

    Spark's own estimate doesn't see that exploding makes rows, so it is never left the choice.
    """
    return F.broadcast(small) if rows <= BROADCAST else small.hint("merge")


def raw_weights(texts: DataFrame, idf: DataFrame, rows: int) -> DataFrame:
    """id, gram, w: logarithmic counts times idf, which has so many rows."""
    tf = spread(texts).groupBy("id", "gram").agg((1 + F.log(F.sum("n"))).alias("tf"))
    return tf.join(beside(idf, rows), "gram").select("id", "gram", (F.col("tf") * F.col("idf")).alias("w"))


def lengths(raw: DataFrame) -> DataFrame:
    return raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))


def by_joins(docs: DataFrame, idf: DataFrame, known: int, v: DataFrame) -> DataFrame:
    """query, id, near, cosine of all pairs with a common n-gram."""
    w = raw_weights(docs, idf, known)
    dot = w.join(beside(v, v.count()), "gram").groupBy("query", "id").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    return dot.join(lengths(w).hint("merge"), "id").select("query", "id", (F.col("dot") / F.col("size")).alias("cosine")).select("query", "id", F.round("cosine", 12).alias("near"), "cosine")


def by_matrix(docs: DataFrame, idf: pa.Table, asked: DataFrame, k: int) -> DataFrame:
    """The same with each batch's k nearest of each query; the queries' vectors and all idf are held in every task."""
    v = asked.toArrow()
    names, col = np.unique(np.array(v["query"].to_pylist(), object), return_inverse=True)
    words, row = np.unique(np.array(v["gram"].to_pylist(), object), return_inverse=True)
    m = np.zeros((len(words), len(names)))
    m[row, col] = v["v"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast((dict(zip(idf["gram"].to_pylist(), idf["idf"].to_pylist(), strict=True)), {w: i for i, w in enumerate(words)}, m, names))
    ident, who, kind = docs.schema["id"], asked.schema["query"], v["query"].type

    def run(batches):
        weight, at, m, names = held.value
        step = max(1, (1 << 22) // (64 * len(names)))
        for batch in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
            ids, cosine = batch.column(0).to_pylist(), np.zeros((batch.num_rows, len(names)))
            for i, t in enumerate(batch.column(1).to_pylist()):
                w = {g: (1 + math.log(c)) * weight[g] for g, c in grams(t).items()}
                if some := [(at[g], x) for g, x in w.items() if g in at]:
                    j, x = zip(*some, strict=True)
                    cosine[i] = np.array(x) @ m[list(j)] / math.sqrt(sum(y * y for y in w.values()))
            near, query, found = cosine.round(12), [], []
            for q in range(len(names)):
                have = np.flatnonzero(cosine[:, q] > 0)
                if len(have) > k:
                    least = np.partition(near[have, q], -k)[-k]
                    have = sorted(have[near[have, q] >= least].tolist(), key=lambda i, q=q: (-near[i, q], ids[i]))[:k]
                query += [q] * len(have)
                found += list(have)
            query, found = np.array(query, int), np.array(found, int)
            yield pa.RecordBatch.from_arrays([pa.array(names[query].tolist(), kind), batch.column(0).take(pa.array(found)), pa.array(near[found, query]), pa.array(cosine[found, query])], ["query", "id", "near", "cosine"])

    return docs.mapInArrow(run, StructType([who, ident, StructField("near", DoubleType()), StructField("cosine", DoubleType())]))


def candidates(queries: DataFrame, records: DataFrame, k: int = 8, threshold: float = THRESHOLD) -> DataFrame:
    """query, id, score, cosine, lexical, identifier, band, rank. queries: query, value. records: id, name, identifiers (array).

    Cosines are of n-grams; the k nearest of each query are scored by spelling and identifiers. Up to a bound the weights of n-grams
    and the queries' vectors go to all tasks, which keep their nearest; beyond it they are joined by n-gram.
    """
    text = n.spaced(F.concat_ws(" | ", F.col("name"), F.array_join("identifiers", " | ")))
    rows = records.select("id", text.alias("text")).repartition(max(1, -(-records.count() // TASK)), "id")
    docs = rows.where("id IS NOT NULL").groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    total = records.agg(F.count("*").alias("n"))
    idf = cut(frequencies(rows).crossJoin(F.broadcast(total)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))  # one row
    known = idf.count()
    asked = queries.select(F.col("query").alias("id"), n.spaced(F.col("value")).alias("text"))
    v = raw_weights(asked, idf, known)
    v = cut(v.join(lengths(v).hint("merge"), "id").select(F.col("id").alias("query"), "gram", (F.col("w") / F.col("size")).alias("v")))
    size = v.agg(F.countDistinct("query"), F.countDistinct("gram")).first()
    fits = known <= BROADCAST and size[0] * size[1] <= CELLS
    cosine = by_matrix(docs, idf.toArrow(), v, k) if fits and size[0] else by_joins(docs, idf, known, v)
    near = Window.partitionBy("query").orderBy(F.desc("near"), "id")
    top = cut(cosine.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k).drop("n", "near"))
    j = records.select("id", "name", "identifiers").join(beside(top.join(queries.select("query", "value").hint("merge"), "query"), top.count()), "id")
    whole = n.compact(F.col("value"))
    each = j.select("query", "id", "value", "cosine", n.similarity(n.spaced(F.col("value")), n.spaced(F.col("name"))).alias("lexical"), F.exists("identifiers", lambda x: (whole != "") & (n.compact(x) == whole)).cast("int").alias("exact"), F.explode_outer("identifiers").alias("identifier"))
    part = each.withColumn("partial", F.when(F.col("identifier").isNull(), 0.0).otherwise(n.similarity(n.spaced(F.coalesce("value", F.lit(""))), n.spaced(F.coalesce("identifier", F.lit(""))))))
    s = part.groupBy("query", "id").agg(F.first("cosine").alias("cosine"), F.first("lexical").alias("lexical"), F.coalesce(F.first("exact"), F.lit(0)).alias("exact"), F.max("partial").alias("identifier"))
    score = F.least(F.lit(1.0), COSINE * F.col("cosine") + LEXICAL * F.col("lexical") + PARTIAL * F.col("identifier") + EXACT * F.col("exact"))
    score = F.round(F.when(F.col("exact") == 1, F.greatest(score, F.lit(EXACT_LEAST))).otherwise(score), 4)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    kept = s.withColumn("score", score).where(F.col("score") >= threshold)
    band = F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("review")
    return kept.select("query", "id", "score", *[F.round(c, 4).alias(c) for c in ("cosine", "lexical", "identifier")], band.alias("band"), F.row_number().over(order).alias("rank"))


def nearest_by_cosine(vectors: DataFrame, is_query: Column, k: int, block: int = 2048) -> DataFrame:
    """query, id, cosine, rank: the k rows of greatest cosine of each query. vectors: id, v.

    The stated queries meet all rows in blocks: each block of queries, of fixed size, is sent to all tasks, which keep their best k.
    """
    spark = vectors.sparkSession
    asked = vectors.where(is_query & F.col("v").isNotNull()).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("h"))
    count = asked.count()
    blocks, found = max(1, -(-count // block)), None
    width = max(1, (1 << 20) // blocks)
    for b in range(blocks):
        ids = asked.where((F.col("h") >= b * width) & (F.col("h") < (b + 1) * width if b < blocks - 1 else F.lit(True))).select("id")
        rows = vectors.join(ids, "id", "left_semi").collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r.id for r in rows]), np.array([r.v for r in rows], float)))

        def local(batches, shared=shared):
            names, q = shared.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for batch in batches:
                ids_, x = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
                if not len(ids_):
                    continue
                s = q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                s[names[:, None] == ids_[None]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                who, score = np.repeat(names, top.shape[1]), np.take_along_axis(s, top, 1).ravel()
                ok = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(who[ok]), pa.array(ids_[top.ravel()][ok]), pa.array(score[ok])], ["query", "id", "cosine"])

        part = vectors.where(F.col("v").isNotNull()).select("id", "v").mapInArrow(local, "query long, id long, cosine double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query long, id long, cosine double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 6)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
