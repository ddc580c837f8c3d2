"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

The graph holds DEGREE neighbours of every row. It starts from random-hyperplane buckets and is improved by iterated Spark
joins: each row's neighbours, together with REVERSE rows that name it, meet in one group and offer themselves to each
other; offers better than a row's current list are merged into it. Rounds end when fewer than SETTLED of the list entries
change, or after ROUNDS. One more table deals rows to blocks at random, so that every row has company. Unequal norms are handled by one more component that makes all vectors equally long; it is never
stored, and the distance is computed without it, so that short vectors beside a long one keep their distances.

A query starts at its own node and the HEADS longest vectors, and expands its best WIDTH nodes that are not expanded yet,
until all of them are, or after STEPS rounds. Graph work uses vectors of one byte per component and a scale for each vector;
the answers are scored again on the original vectors, in doubles, and ranked by that.

Every row is indexed. Equal vectors are one node, named by a 64-bit hash; a node among the answers stands for its ids, the
smallest first. Buckets are cut into blocks of BUCKET rows by hash, so many copies of one vector are many blocks. In a
table of at most BUCKET rows every row meets every other one, and the answer is exact. Vectors that are null, zero or hold
a null or non-finite component, and rows without id, take no part; shorter vectors count as filled up with zeros. An id
that repeats counts once, with its smallest vector in the order of arrays. Equal scores go to the smaller id. An empty
table has no answers. Other columns of the input, of whatever names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, deal
from .knn_join import matrix, usable

DEGREE, REVERSE, ROUNDS, SETTLED = 32, 20, 5, 0.1
TABLES, BUCKET = 8, 256
WIDTH, STEPS, ANSWERS = 160, 6, 64
HEADS, SALT = 64, 32
OFFERS = 12
#: At most so many expansions of a step are broadcast to the nodes; more are shuffled.
FEW = 200_000
#: old: the entry was expanded already (in a search).
ENTRY = np.dtype([("id", "<i8"), ("s", "<f4"), ("old", "u1")])


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the end."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in a row, and where each value starts; a null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null(b"") if column.null_count else column
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32, len(column) + 1, column.offset * 4) if off is not None else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of lists, and how many each list has."""
    data, off = _raw(column)
    return np.frombuffer(data.tobytes(), ENTRY), np.diff(off) // ENTRY.itemsize


def _lists(entry: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Entries, cut at edge, as a column of lists."""
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * ENTRY.itemsize).astype(np.int32)), pa.py_buffer(entry.tobytes())])


def _best(owner: np.ndarray, entry: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The keep best entries of each owner, without repeats, best first. An entry is old if any of its copies is."""
    order = np.lexsort((1 - entry["old"], entry["id"], owner))
    owner, entry = owner[order], entry[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (entry["id"][1:] != entry["id"][:-1])
    owner, entry = owner[fresh], entry[fresh]
    order = np.lexsort((entry["id"], -entry["s"], owner))
    owner, entry = owner[order], entry[order]
    edge = _runs(owner)
    among = np.arange(len(owner)) - np.repeat(edge[:-1], np.diff(edge)) < keep
    return owner[among], entry[among]


def _split(raw, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of vectors in a row, and their scales."""
    both = (raw if isinstance(raw, np.ndarray) else np.frombuffer(raw, np.uint8)).reshape(-1, width + 8)
    return both[:, 8:].view(np.int8), np.ascontiguousarray(both[:, :8]).view(np.float64)[:, 0]


def _bytes_matrix(column: pa.Array, width: int) -> np.ndarray:
    q, scale = _split(_raw(column)[0], width)
    return q * scale[:, None]


def _closeness(x: np.ndarray) -> np.ndarray:
    """Minus the squared distances of rows to which a last component gives equal length; components are 1 at most."""
    size = (x**2).sum(1)
    last = np.sqrt(np.maximum(x.shape[1] - size, 0))
    apart = (size[:, None] - size) / np.maximum(last[:, None] + last, 1e-300)
    return 2 * (x @ x.T) - size[:, None] - size - apart**2


def _whole_runs(batches):
    """Tables in which every run of equal first columns is whole; the input is sorted by it."""
    kept = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if kept is None else pa.concat_tables([kept, t])
        if not t.num_rows:
            continue
        key = t.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield t.slice(0, last)
        kept = t.slice(last)
    if kept is not None and kept.num_rows:
        yield kept


def local_join(groups: DataFrame, width: int, rows: int) -> DataFrame:
    """groups: g, id, q, floor. Members of a group offer themselves to each other: id, list (entries above the floor)."""

    def run(batches):
        for t in _whole_runs(batches):
            edge, ids = _runs(t.column(0).to_numpy()), t.column(1).to_numpy()
            q, floor = _bytes_matrix(t.column(2), width), t.column(3).to_numpy()
            to, near, score = [], [], []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a < 2:
                    continue
                own, once = np.unique(ids[a:b], return_index=True)  # a neighbour may name the row, too
                s = _closeness(q[a:b][once])
                np.fill_diagonal(s, -np.inf)
                least, b = floor[a:b][once], a + len(own)
                if b - a < 2:
                    continue
                n = min(OFFERS if b - a < BUCKET // 2 else DEGREE, b - a - 1)
                top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                got = np.take_along_axis(s, top, 1)
                at, which = np.nonzero(got > least[:, None])
                to.append(own[at])
                near.append(own[top[at, which]])
                score.append(got[at, which])
            if not to:
                continue
            to = np.concatenate(to)
            entry = np.zeros(len(to), ENTRY)
            entry["id"], entry["s"] = np.concatenate(near), np.concatenate(score)
            other = entry["id"] != to
            to, entry = _best(to[other], entry[other], DEGREE)
            edge = _runs(to)
            yield pa.RecordBatch.from_arrays([pa.array(to[edge[:-1]]), _lists(entry, edge)], ["id", "list"])

    return deal(groups.select("g", "id", "q", "floor"), "g", rows).sortWithinPartitions("g").mapInArrow(run, "id long, list binary")


def merge(lists: DataFrame, keep: int, rows: int) -> DataFrame:
    """id, q, list: the best entries of all lists of an id, without repeats, best first; floor: the last score, if the list is full.

    lists: id, q, list. A row with q is the id's list so far, whose entries are old; fresh: how many of the list are not.
    """

    def run(batches):
        for t in _whole_runs(batches):
            ids, q = t.column(0).to_numpy(), t.column(2).combine_chunks()
            entry, count = _entries(t.column(1))
            so_far = q.is_valid().to_numpy(zero_copy_only=False)
            entry = entry.copy()
            entry["old"] = np.repeat(so_far, count)
            owner, entry = _best(np.repeat(ids, count), entry, keep)
            edge = _runs(owner)
            full = np.diff(edge) == keep
            floor = np.where(full, entry["s"][edge[1:] - 1], -np.inf) if len(owner) else np.zeros(0)
            new = np.add.reduceat(1 - entry["old"].astype(np.int64), edge[:-1]) if len(owner) else np.zeros(0, np.int64)
            has = np.flatnonzero(so_far)
            where = dict(zip(ids[has].tolist(), has.tolist(), strict=True))
            who = owner[edge[:-1]]
            own = q.take(pa.array([where.get(i) for i in who.tolist()], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(who), own, _lists(entry, edge), pa.array(floor.astype(np.float32)), pa.array(new)], ["id", "q", "list", "floor", "fresh"])

    return deal(lists.select("id", "list", "q"), "id", rows).sortWithinPartitions("id").mapInArrow(run, "id long, q binary, list binary, floor float, fresh long")


def _edges(state: DataFrame) -> DataFrame:
    """a, b for every entry b of the list of a."""

    def run(batches):
        for batch in batches:
            entry, count = _entries(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), count)), pa.array(entry["id"].copy())], ["a", "b"])

    return state.select("id", "list").mapInArrow(run, "a long, b long")


def _circle(state: DataFrame, reverse: int) -> DataFrame:
    """g, id: each node's neighbours, and a bounded draw of the nodes that name it."""
    edges = _edges(state)
    w = Window.partitionBy("b").orderBy(F.xxhash64("a", "b"), "a")
    back = edges.withColumn("n", F.row_number().over(w)).where(F.col("n") <= reverse)
    return edges.select(F.col("a").alias("g"), F.col("b").alias("id")).unionByName(back.select(F.col("b").alias("g"), F.col("a").alias("id")))


def build(nodes: DataFrame, rows: int, width: int) -> DataFrame:
    """nodes: id, q. The graph: id, list, floor."""
    bits = max(0, int(np.log2(max(1, rows / (BUCKET / 2)))))
    planes = np.random.default_rng(29).normal(size=(TABLES, width, bits))

    def codes(batches):
        for b in batches:
            x = _bytes_matrix(b.column(1), width)
            for t in range(TABLES if bits else 0):
                code = ((x @ planes[t]) > 0).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(code * (TABLES + 1) + t), b.column(0)], ["code", "id"])
            block = (b.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(-(-rows // BUCKET))
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64) * (TABLES + 1) + TABLES), b.column(0)], ["code", "id"])  # at random

    coded = cut(nodes.select("id", "q").mapInArrow(codes, "code long, id long"))
    blocks = coded.groupBy("code").agg(F.ceil(F.count("*") / BUCKET).alias("blocks"))
    start = coded.join(blocks, "code").withColumn("g", F.xxhash64("code", F.pmod(F.xxhash64("id", "code"), "blocks")))
    lowest, none = F.lit(float("-inf")).cast("float"), F.lit(None).cast("binary").alias("q")
    offers = local_join(start.join(nodes, "id").select("g", "id", "q", lowest.alias("floor")), width, rows * TABLES)
    empty = nodes.select("id", F.lit(b"").alias("list"), "q")
    state = cut(merge(empty.unionByName(offers.select("id", "list", none)), DEGREE, rows * TABLES))
    for _ in range(ROUNDS):
        offers = local_join(_circle(state, REVERSE).join(state.select("id", "q", "floor"), "id"), width, rows * (DEGREE + REVERSE))
        state = cut(merge(state.select("id", "list", "q").unionByName(offers.select("id", "list", none)), DEGREE, rows * OFFERS))
        if state.agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0] < SETTLED * DEGREE * rows:
            break
    return state


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, width: int, rows: int) -> DataFrame:
    """id, list of the queries' best ANSWERS. Each step sends queries to the nodes that they expand; a node scores its circle."""
    circle = _circle(graph, DEGREE).join(nodes, "id")
    fat = cut(circle.groupBy("g").agg(F.collect_list(F.struct("id", "q")).alias("c")).select("g", F.col("c.id").alias("ids"), F.concat_ws("", F.transform("c.q", F.hex)).alias("h")).select("g", "ids", F.unhex("h").alias("qs")))

    def peak(batches):
        for b in batches:
            size = np.sqrt((_bytes_matrix(b.column(1), width) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size)], ["id", "q", "size"])

    heads = nodes.select("id", "q").mapInArrow(peak, "id long, q binary, size double").orderBy(F.desc("size"), "id").limit(HEADS).collect()
    head_ids = np.array([r.id for r in heads], np.int64)
    head_q = b"".join(bytes(r.q) for r in heads)

    def greet(batches):
        """The query itself, which is expanded first and never an answer of its own, and the heads."""
        x, scale = _split(head_q, width)
        for b in batches:
            ids, (q, unit) = b.column(0).to_numpy(), _split(_raw(b.column(1))[0], width)
            entry = np.zeros((len(ids), len(x) + 1), ENTRY)
            entry["id"], entry["id"][:, 0] = np.append(0, head_ids), ids
            entry["s"][:, 1:] = q.astype(np.float64) @ (x * scale[:, None]).T
            entry["s"][:, 0] = np.inf
            apart = np.ones(entry.shape, bool)
            apart[:, 1:] = entry["id"][:, 1:] != ids[:, None]
            edge = np.concatenate([[0], np.cumsum(apart.sum(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(entry[apart], edge), b.column(1)], ["id", "list", "q"])

    def fresh(batches):
        for b in batches:
            entry, count = _entries(b.column(2))
            at = np.repeat(np.arange(len(count)), count)
            new = entry["old"] == 0
            at, take = at[new], pa.array(at[new])
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(entry["id"][new]), b.column(3).take(take)], ["id", "q", "g", "floor"])

    def expand(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                b = batch.slice(first, 512)
                ids, near, count = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(), np.diff(b.column(1).offsets.to_numpy())
                (y, scale), (x, _) = _split(_raw(b.column(2))[0], width), _split(_raw(b.column(3))[0], width)  # the query's own scale changes no order
                at = np.repeat(np.arange(len(ids)), count)
                s = (np.einsum("ij,ij->i", y.astype(np.float32), x.astype(np.float32)[at]) * scale).astype(np.float32)
                ok = (s > b.column(4).to_numpy()[at]) & (near != ids[at])
                entry = np.zeros(int(ok.sum()), ENTRY)
                entry["id"], entry["s"] = near[ok], s[ok]
                owner, entry = _best(ids[at[ok]], entry, WIDTH)
                edge = _runs(owner)
                yield pa.RecordBatch.from_arrays([pa.array(owner[edge[:-1]]), _lists(entry, edge)], ["id", "list"])

    pool = cut(queries.select("id", "q").mapInArrow(greet, "id long, list binary, q binary").withColumns({"floor": F.lit(float("-inf")).cast("float"), "fresh": F.lit(HEADS).cast("long")}))
    for _ in range(STEPS):
        count = pool.agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0]
        if not count:
            break
        todo = pool.select("id", "q", "list", "floor").mapInArrow(fresh, "id long, q binary, g long, floor float")
        sent = (F.broadcast(todo) if count <= FEW else todo).join(fat, "g").select("id", "ids", "qs", "q", "floor")
        found = sent.mapInArrow(expand, "id long, list binary").withColumn("q", F.lit(None).cast("binary"))
        pool = cut(merge(pool.select("id", "list", "q").unionByName(found), WIDTH, count))
    return pool


def approximate_top_k(vectors: DataFrame, id_col: str, vector: str, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: column function of the id."""
    rows = usable(vectors, id_col, vector).withColumn("peak", F.array_max(F.transform("v", F.abs))).where(F.col("peak") > 0)
    rows = rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("peak", F.array_max(F.transform("v", F.abs)))
    width, largest = rows.agg(F.max(F.size("v")), F.max("peak")).first()
    if not width:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("v", i), F.lit(0.0)) + F.lit(0.0))  # no minus zero
    members = cut(rows.select("id", v.alias("v")).withColumn("node", F.xxhash64("v")))
    unique = cut(members.groupBy("node").agg(F.first("v").alias("v")))

    def squeeze(batches):
        for b in batches:
            x = matrix(b.column(1), width)
            x = x / largest
            scale = np.maximum(np.abs(x).max(1, initial=0.0), 1e-300)[:, None] / 127
            q = np.rint(x / scale).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.tobytes() + r.tobytes() for a, r in zip(scale, q, strict=True)], pa.binary())], ["id", "q"])

    nodes = cut(unique.select("node", "v").mapInArrow(squeeze, "id long, q binary"))
    count = unique.count()
    graph = build(nodes, count, width)
    queries = cut(members.where(is_query(F.col("id"))).select("id", "node", F.pmod(F.xxhash64("id"), F.lit(SALT)).alias("salt")))
    asked = queries.select("node").distinct()
    found = search(graph, nodes, nodes.join(asked.withColumnRenamed("node", "id"), "id", "left_semi"), width, count)
    pairs = _leading(found, ANSWERS + 1).where("a <> b").unionByName(asked.select(F.col("node").alias("a"), F.col("node").alias("b")))  # copies of the query, too
    left = unique.select(F.col("node").alias("a"), F.col("v").alias("x"))
    right = unique.select(F.col("node").alias("b"), F.col("v").alias("y"))
    exact = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", exact.alias("score"))
    first = Window.partitionBy("node").orderBy("id")
    ids = members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select(F.col("node").alias("b"), "id")
    w = Window.partitionBy("a").orderBy(F.desc("score"), "id")
    ranked = scored.join(ids, "b").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    best = ranked.groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_list(F.struct("n", F.col("id").alias("vec_id"), "score"))).alias("best"))
    best = best.join(queries.select("node", "salt").distinct(), "node")  # queries of a common vector are many groups
    named = queries.join(best, ["node", "salt"]).select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("best"))
    return named.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def _leading(state: DataFrame, n: int) -> DataFrame:
    """a, b for the first n entries of each list."""
    size = ENTRY.itemsize * n
    return _edges(state.select("id", F.substring("list", 1, size).alias("list")))


def op9_nearest(embeddings: DataFrame) -> DataFrame:
    """Contract columns of op9."""
    return approximate_top_k(embeddings, "vec_id", "embedding", lambda i: i % 20 == 0, 20)
