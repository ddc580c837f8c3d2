"""Graphs as edge tables. Iterations are joins; each round is cut by a checkpoint in the shared folder."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: About how many common keys one task goes through.
WAYS = 1 << 25


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared checkpoint folder. Only a local master, as in tests, gets a temporary one where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="evidentia-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def simple(edges: DataFrame, weight: str = "confidence") -> DataFrame:
    """a < b, weight: the undirected simple projection with the strongest edge."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(weight).alias(weight))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def components(pairs: DataFrame) -> DataFrame:
    """node, component (smallest node). Labels move along edges and along labels, so long paths take logarithmic rounds."""
    e = cut(both_ways(pairs))
    label = cut(e.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = e.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = label.join(near, "node").select("node", F.least("component", "m").alias("c"))
        hop = step.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        nxt = cut(step.join(hop, "c").select("node", F.least("c", "cc").alias("component")))
        moved = not nxt.join(label, ["node", "component"], "left_anti").isEmpty()
        label = nxt
        if not moved:
            return label


def distances(pairs: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """source, node, distance: breadth-first from every source; most steps, where the question has a limit. No source is no row."""
    e = cut(both_ways(pairs))
    known = cut(sources.where("node IS NOT NULL").select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("distance")))
    front = known
    step = 0
    while most is None or step < most:
        step += 1
        nxt = front.withColumnRenamed("node", "a").join(e, "a").select("source", F.col("b").alias("node"), (F.col("distance") + 1).alias("distance")).distinct()
        front = cut(nxt.join(known, ["source", "node"], "left_anti"))
        if front.isEmpty():
            break
        known = cut(known.unionByName(front))
    return known


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """node, rank over weighted directed edges src, dst, weight; the rank of nodes without exit is spread evenly."""
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    n = nodes.count()
    total = edges.groupBy("src").agg(F.sum("weight").alias("t"))
    share = cut(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("t")).alias("p")))
    sinks = nodes.join(total.withColumnRenamed("src", "node"), "node", "left_anti")
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds):
        lost = rank.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = share.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("g"))
        rank = nodes.join(got, "node", "left").crossJoin(F.broadcast(lost)).select("node", ((1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))  # lost is one row
        if i % 5 == 4:
            rank = cut(rank)
    return rank


def triangles(pairs: DataFrame) -> DataFrame:
    """node, triangles. Edges point to the higher degree, so a hub's neighbours aren't paired."""
    d = degrees(pairs)
    e = pairs.join(d.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = cut(e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = o.join(o.select("x", F.col("y").alias("z")), "x").where("y <> z")
    closed = wedge.join(o.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"])
    return closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def clustering(pairs: DataFrame) -> DataFrame:
    d = degrees(pairs).join(triangles(pairs), "node", "left")
    k = F.col("degree")
    return d.select("node", F.when(k < 2, 0.0).otherwise(2.0 * F.coalesce("triangles", F.lit(0)) / (k * (k - 1))).alias("clustering"))


def _pairs_of_blocks(entries: np.ndarray, key: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, most: int = 1 << 20) -> Iterator[tuple]:
    """i, j, common, sum of weights of all pairs of a user i of one block and j of the other that have a key in common.

    entries: a user's number for each of his keys, users numbered in order; left, right: which entries are of which block. About so
    many common keys are held at once, one user's at least.
    """
    at = np.flatnonzero(right)[np.argsort(key[right], kind="stable")]
    users, to = np.unique(entries[at], return_inverse=True)
    start = np.searchsorted(key[at], np.arange(key.max(initial=-1) + 2))
    mine = np.flatnonzero(left)[np.argsort(entries[left], kind="stable")]
    size = start[key[mine] + 1] - start[key[mine]]
    ways = np.concatenate([[0], np.cumsum(size)])
    own = np.concatenate([np.flatnonzero(np.diff(entries[mine], prepend=-1)), [len(mine)]])  # where a user begins
    lo = 0
    while lo < len(own) - 1:
        hi = max(lo + 1, int(np.searchsorted(ways[own], ways[own[lo]] + most, "right")) - 1)
        part = slice(own[lo], own[hi])
        n = size[part]
        i = np.repeat(entries[mine[part]], n)
        q = to[np.repeat(start[key[mine[part]]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        who, p = np.unique(entries[mine[part]], return_inverse=True)
        cell, w = np.repeat(p, n) * len(users) + q, np.repeat(weight[mine[part]], n)
        if len(who) * len(users) <= 8 * len(i):
            common, score = np.bincount(cell), np.bincount(cell, w)
            found = np.flatnonzero(common)
            common, score = common[found], score[found]
        else:
            found, cell = np.unique(cell, return_inverse=True)
            common, score = np.bincount(cell), np.bincount(cell, w)
        yield who[found // max(len(users), 1)], users[found % max(len(users), 1)], common, score
        lo = hi


def _in_runs(i: np.ndarray, j: np.ndarray, common: np.ndarray, links: np.ndarray) -> np.ndarray:
    """An order in which the pairs of i, below j and above, stand in runs of equal common and links of j."""
    wide, high = int(links.max(initial=0)) + 1, int(common.max(initial=0)) + 1
    if len(links) * 2 * high * wide < 1 << 62:
        return np.argsort(((i * 2 + (j > i)) * high + common) * wide + links[j], kind="stable")
    return np.lexsort((links[j], common, j > i, i))


def common_neighbours(left: DataFrame, best: int | None = None) -> DataFrame:
    """u < v, common, adamic_adar, links_u, links_v (all keys) of the first side of a two-sided graph with edges u, k.

    Keys of one member add nothing. Users are dealt to blocks; a task has the edges of two blocks and forms their pairs, so edges are
    shuffled once for each block and pairs never. Rows come in runs of equal numbers, which files hold in little room. best: only so many pairs of greatest adamic_adar, then rounded to nine digits, ties
    to smaller u, then v; every task keeps its best.
    """
    size = left.groupBy("k").agg(F.count("*").alias("n"))
    links = left.groupBy("u").agg(F.count("*").alias("d"))
    e = cut(left.where("u IS NOT NULL").join(size.where("n > 1"), "k").join(links, "u"))
    ways = e.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(math.sqrt(ways / WAYS)))
    task = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(F.col("b"), o).alias("x"), F.greatest(F.col("b"), o).alias("y")))
    sent = e.withColumn("b", F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int")).withColumn("t", F.explode(task)).select((F.col("t.y") * (F.col("t.y") + 1) / 2 + F.col("t.x")).cast("int").alias("t"), (F.col("b") == F.col("t.x")).alias("first"), (F.col("t.x") == F.col("t.y")).alias("same"), "u", "k", "n", "d")
    tasks = min(blocks * (blocks + 1) // 2, 1 << 14)
    kind = left.schema["u"].dataType
    fields = [StructField("u", kind), StructField("v", kind), StructField("common", LongType()), StructField("adamic_adar", DoubleType()), StructField("links_u", LongType()), StructField("links_v", LongType())]

    def solve(table: pa.Table) -> Iterator[tuple]:
        first, same, n, d = (table[c].to_numpy() for c in ("first", "same", "n", "d"))
        u, names = pd.factorize(table["u"].to_pandas(), sort=True)
        key, _ = pd.factorize(table["k"].to_pandas(), sort=True)
        links = np.zeros(len(names), np.int64)
        links[u] = d
        for i, j, common, score in _pairs_of_blocks(u, key, 1 / np.log(n), first, same | ~first):
            if same[0]:
                keep = i < j
                i, j, common, score = i[keep], j[keep], common[keep], score[keep]
            if best is None:
                order = _in_runs(i, j, common, links)
                i, j, common, score = i[order], j[order], common[order], score[order]
            yield names, links, np.minimum(i, j), np.maximum(i, j), common, score

    def batch(names, links, i, j, common, score):
        for lo in range(0, len(i), 1 << 16):
            p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(names[p]), pa.array(names[q]), pa.array(common[lo : lo + (1 << 16)]), pa.array(score[lo : lo + (1 << 16)]), pa.array(links[p]), pa.array(links[q])], ["u", "v", "common", "adamic_adar", "links_u", "links_v"])

    def chosen(parts):
        kept = None
        for names, links, i, j, common, score in parts:
            now = [i, j, common, score.round(9)]
            if kept is not None:
                some = now[3] >= (kept[3][-1] if len(kept[3]) == best else 0)
                now = [np.concatenate([x, y[some]]) for x, y in zip(kept, now, strict=True)]
            if len(now[3]) > best:
                least = np.partition(now[3], -best)[-best]
                now = [x[now[3] >= least] for x in now]
            top = np.lexsort((now[1], now[0], -now[3]))[:best]
            kept = [x[top] for x in now]
        if kept is not None:
            yield names, links, *kept

    def run(batches):
        for table in _by_task(batches):
            parts = solve(table)
            for p in parts if best is None else chosen(parts):
                yield from batch(*p)

    dealt = sent.repartitionById(tasks, (F.col("t") % tasks).cast("int")).sortWithinPartitions("t")
    out = dealt.mapInArrow(run, StructType(fields))
    return out if best is None else out.orderBy(F.desc("adamic_adar"), "u", "v").limit(best)


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by t, as one table for each t."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        t = b.column(0).to_numpy()
        ends = [*np.flatnonzero(np.diff(t)) + 1, len(t)]
        for lo, hi in zip([0, *ends], ends, strict=False):
            if hi == lo:
                continue
            if held and held[0].column(0)[0].as_py() != t[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def closeness(dist: DataFrame) -> DataFrame:
    """node, closeness from distances of all nodes: reached / sum of distances, scaled by the share of nodes that is reached."""
    n = dist.agg(F.countDistinct("source").alias("n"))
    c = dist.where("distance > 0").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("k"), F.sum("distance").alias("far"))
    return c.crossJoin(F.broadcast(n)).select("node", (F.col("k") / F.col("far") * F.col("k") / (F.col("n") - 1)).alias("closeness"))  # one row


def hidden(pairs: DataFrame, dist: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """source < node: pairs without an edge that a path of two to four steps joins."""
    return dist.where(F.col("distance").between(least, most) & (F.col("source") < F.col("node"))).select("source", "node", "distance")


def betweenness(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """node, betweenness over the given sources, by counting shortest paths forward and shares backward with joins.

    Normalised by the number of pairs; with fewer sources than nodes (pivots) it is scaled up to all of them.
    """
    e = cut(both_ways(pairs))
    dist = distances(pairs, sources)
    deepest = dist.agg(F.max("distance")).first()[0] or 0
    step = e.join(dist.select("source", F.col("node").alias("a"), F.col("distance").alias("x")), "a").join(dist.select("source", F.col("node").alias("b"), F.col("distance").alias("y")), ["source", "b"]).where("y = x + 1")
    step = cut(step.select("source", "a", "b", F.col("y").alias("level")))
    paths = dist.where("distance = 0").select("source", "node", F.lit(1.0).alias("sigma"))
    for level in range(1, deepest + 1):
        got = step.where(F.col("level") == level).join(paths.withColumnRenamed("node", "a"), ["source", "a"]).groupBy("source", F.col("b").alias("node")).agg(F.sum("sigma").alias("sigma"))
        paths = cut(paths.unionByName(got))
    share = dist.select("source", "node", F.lit(0.0).alias("delta"))
    link = cut(step.join(paths.select("source", F.col("node").alias("a"), F.col("sigma").alias("sa")), ["source", "a"]).join(paths.select("source", F.col("node").alias("b"), F.col("sigma").alias("sb")), ["source", "b"]))
    for level in range(deepest, 0, -1):
        back = link.where(F.col("level") == level).join(share.withColumnRenamed("node", "b"), ["source", "b"]).groupBy("source", F.col("a").alias("node")).agg(F.sum(F.col("sa") / F.col("sb") * (1 + F.col("delta"))).alias("more"))
        share = cut(share.join(back, ["source", "node"], "left").select("source", "node", (F.col("delta") + F.coalesce("more", F.lit(0.0))).alias("delta")))
    n, k = e.select("a").distinct().count(), dist.select("source").distinct().count()
    scale = n / max(k, 1) / max((n - 1) * (n - 2), 1)
    return share.where("source <> node").groupBy("node").agg((F.sum("delta") * scale).alias("betweenness"))


def label_communities(pairs: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community: each node takes its neighbours' most frequent label, the smallest of equals; a fixed number of rounds."""
    e = cut(both_ways(pairs))
    label = e.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        seen = e.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.count("*").alias("c"))
        own = label.withColumn("c", F.lit(1).cast("long"))
        votes = seen.unionByName(own).groupBy("node", "community").agg(F.sum("c").alias("c"))
        w = Window.partitionBy("node").orderBy(F.desc("c"), "community")
        label = cut(votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("node", "community"))
    return label


def link_suggestions(pairs: DataFrame, n: int) -> DataFrame:
    """u, v, common, adamic_adar of unconnected pairs with common neighbours, best first. Hubs weigh little, as usual."""
    two = both_ways(pairs).select(F.col("a").alias("u"), F.col("b").alias("k"))
    c = common_neighbours(two)
    return c.join(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), ["u", "v"], "left_anti").orderBy(F.desc(F.round("adamic_adar", 9)), "u", "v").limit(n).select("u", "v", "common", "adamic_adar")
