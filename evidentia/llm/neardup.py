"""Near duplicates by a chosen-path similarity join over minwise signatures.

1. Each whole text becomes its set of distinct shingles (64-bit hashes of `width` words), the set's 128-bit digest, and
   a signature of SIGNATURE minwise values. Texts of equal sets form a class; only one row per class goes on, so copies
   by the million cost one partial aggregation.
2. TREES independent trees branch the classes: a node chooses one or, with the probability that makes 1/threshold of
   them on average, two places of the signature; the values there lead to its children. One pass over the signatures deals
   each class to its nodes of the first level. A node that would fill more than half a task is hot: its members are compared
   with a leader, and only those that are not surely of the leader's neighbourhood branch on, level by level; hot nodes
   are two a task at most, so their leaders are broadcast. All other nodes are whole in one task, which branches them on in
   the same way down to LEAF members and compares these exhaustively by signature.
3. Two members are near unless their signatures agree far less than linked ones would (six standard deviations). A member
   is surely of a leader's neighbourhood if what it may be linked with is near the leader, too. A leaf gives a spanning
   forest of its near pairs, fewer pairs than members, so pairs never grow with the square of a group. The pairs connect
   neighbourhoods.
4. Within a neighbourhood links are decided on the full sets: 100 * intersection >= percent * union. Up to BLOCK members
   are one exhaustive comparison. Larger ones are first compared in blocks that share some anchors; blocks of different
   components, or of small ones, then meet each other. Only links that join two components leave a block. No node,
   neighbourhood or block is capped or dropped.
5. Links are contracted to components by alternating large-star and small-star rounds in Spark.

A pair at the threshold of 0.85 shares the node of one level with probability 0.85 and more; 16 trees with leaves at the
third level miss it with probability below 1e-6, at the first below 1e-13.

Nulls, empty texts and texts without words have the empty set and are linked with nothing. Texts with fewer words than
`width` have their whole sequence as only shingle. Very long texts are whole sets of their own. Repeated rows and ties: the
smallest id stands for its component; a row repeated with the same id is in one component twice. Rows without id are in
components but name one only if nothing else is there (then null); of those, the one with the smallest text hash stands
for it. An empty table gives no rows. Other columns of the input, of whatever names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import ROWS_A_TASK, cut, deal, parts

SIGNATURE = 64
TREES = 16
LEAF = 256
BLOCK, ANCHORS = 256, 8
FEW = 1_000_000
EDGES_A_TASK = 200_000
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 62, SIGNATURE, dtype=np.uint64) * tb.U(2) + tb.U(1)
_ORDER = tb.U(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, width: int):
    """For each text its sorted distinct shingle hashes, in runs of texts."""
    data, off = tb.flat(texts)
    for a, b in tb.chunks(off):
        low = tb.LOWER[data[off[a] : off[b]]]
        base = off[a : b + 1] - off[a]
        starts, ends, owner = tb.words(low, base, tb.SPACE)
        h = tb.span_hashes(low, starts, ends)
        count = np.bincount(owner, minlength=b - a)
        first = np.cumsum(count) - count
        whole = np.maximum(count - width + 1, np.minimum(count, 1))  # shingles of each text, with repeats
        at = np.repeat(first, whole) + np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
        of = np.repeat(np.arange(b - a), whole)
        size = np.minimum(count[of], width)
        total = np.zeros(len(at), tb.U)
        for k in range(width):
            inside = k < size
            total[inside] = tb.mix(total[inside] * _ORDER + h[at[inside] + k] + tb.U(k + 1))
        total = tb.mix(total + size.astype(tb.U))
        order = np.lexsort((total, of))
        total, of = total[order], of[order]
        fresh = np.ones(len(total), bool)
        fresh[1:] = (total[1:] != total[:-1]) | (of[1:] != of[:-1])
        total, of = total[fresh], of[fresh]
        edge = np.searchsorted(of, np.arange(b - a + 1))
        yield a, b, total, edge


def signatures(total: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """[texts, SIGNATURE] minwise values of 32 bits; zeros for an empty set."""
    n = len(edge) - 1
    out = np.zeros((n, SIGNATURE), np.uint32)
    full = np.flatnonzero(edge[1:] > edge[:-1])
    if len(full):
        for k, m in enumerate(_MULTIPLIERS):
            out[full, k] = np.minimum.reduceat(((total ^ (total >> tb.U(29))) * m) >> tb.U(32), edge[full])
    return out


def sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, n_shingles, digest (null for an empty set), signature."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, total, edge in shingle_sets(batch.column(1), width):
                sig = signatures(total, edge)
                n = np.diff(edge)
                digest = [xxhash.xxh3_128_digest(total[edge[i] : edge[i + 1]].tobytes()) if n[i] else None for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())], ["key", "n_shingles", "digest", "signature"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_shingles long, digest binary, signature binary")


def _limits(percent: int) -> tuple[float, float]:
    """Places of two signatures that agree at least if they are near; and if one is surely in the other's neighbourhood."""
    mean = SIGNATURE * percent / 100
    least = mean - 6 * (mean * (1 - percent / 100)) ** 0.5
    return least, least + SIGNATURE - mean


def _branch(node: np.ndarray, row: np.ndarray, values: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (node, row): one, and a second for the share of nodes that makes 100/percent on average."""
    more = tb.mix(node + tb.U(9)) % tb.U(1000) < tb.U(int(1000 * (100 / percent - 1)))
    first = tb.mix(node + tb.U(1)) % tb.U(SIGNATURE)
    second = (first + tb.U(1) + tb.mix(node + tb.U(2)) % tb.U(SIGNATURE - 1)) % tb.U(SIGNATURE)
    place, row = np.concatenate([first, second[more]]), np.concatenate([row, row[more]])
    node = np.concatenate([node, node[more]])
    return tb.mix(node * _ORDER + (place << tb.U(32) | values[row, place.astype(np.int64)].astype(tb.U))), row


def _routes(sig: np.ndarray, hot, percent: int):
    """Level by level: nodes and rows that go there; of them which are hot, and their places among the hot nodes."""
    row = np.tile(np.arange(len(sig)), TREES)
    node = np.repeat(tb.mix(np.arange(1, TREES + 1, dtype=tb.U)), len(sig))
    keys, low, _ = hot
    mine = sig.astype(np.uint8)
    sure = _limits(percent)[1]
    while len(row):
        node, row = _branch(node, row, sig, percent)
        at = np.minimum(np.searchsorted(keys, node), max(len(keys) - 1, 0))
        is_hot = keys[at] == node if len(keys) else np.zeros(len(node), bool)
        yield node, row, is_hot, at
        node, row, at = node[is_hot], row[is_hot], at[is_hot]
        apart = (mine[row] == low[at]).sum(axis=1) < sure
        node, row = node[apart], row[apart]


def _near(sig_a: np.ndarray, sig_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a link is possible: sizes allow it, and one-byte signatures don't speak against it by six deviations."""
    least = _limits(percent)[0]
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    fits[fits] = (sig_a[fits] == sig_b[fits]).sum(axis=1) >= least
    return fits


def _fixed(column: pa.Array, width: int, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _forest(group: np.ndarray, at: np.ndarray, low: np.ndarray, n: np.ndarray, percent: int):
    """Near pairs that span each near component of each group. group: sorted, LEAF of a kind at most; at: rows of low and n."""
    low, n = low[at], n[at]
    comp = np.arange(len(group))  # the component of each member, by the pairs kept so far
    first, end = np.searchsorted(group, group, "left"), np.searchsorted(group, group, "right")
    for step in range(1, min(LEAF, len(group))):
        i = np.flatnonzero(group[:-step] == group[step:])
        if not len(i):
            return
        i = i[comp[i] != comp[i + step]]
        i = i[_near(low[i], low[i + step], n[i], n[i + step], percent)]
        joined = []
        for x in i.tolist():
            if comp[x] != comp[x + step]:
                own = comp[first[x] : end[x]]
                own[own == comp[x + step]] = comp[x]
                joined.append(x)
        if joined:
            joined = np.array(joined)
            yield at[joined], at[joined + step]


def _descend(node: int, at: np.ndarray, low: np.ndarray, percent: int):
    """Branches a node of more than LEAF members until none is left: pairs with leaders, and leaves of two members or more."""
    near, sure = _limits(percent)
    todo = [(tb.U(node), at)]
    while todo:
        node, at = todo.pop()
        if len(at) <= LEAF:
            if len(at) > 1:
                yield None, at
            continue
        lead = at[int(tb.mix(at.astype(tb.U) + node).argmin())]
        agree = (low[at] == low[lead]).sum(axis=1)
        yield lead, at[(agree >= near) & (at != lead)]
        rest = at[agree < sure]
        kids, row = _branch(np.full(len(rest), node), rest, low, percent)
        order = np.argsort(kids, kind="stable")
        kids, row = kids[order], row[order]
        edge = np.flatnonzero(np.concatenate([[True], kids[1:] != kids[:-1], [True]])) if len(kids) else [0]
        todo += [(kids[a], row[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def node_pairs(rows: DataFrame, percent: int, count: int) -> DataFrame:
    """Near pairs within each node of rows (node, id, n, low), which is whole in one task."""

    def whole(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            node = table.column(0).to_numpy()
            last = int(np.searchsorted(node, node[-1], "left"))
            if last:
                yield table.slice(0, last)
            kept = table.slice(last)
        if kept is not None:
            yield kept

    def run(batches):
        for table in whole(batches):
            node, ids, n = table.column(0).to_numpy(), table.column(1).combine_chunks(), table.column(2).to_numpy()
            low = _fixed(table.column(3), SIGNATURE)
            edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
            size = np.diff(edge)
            group, at = [], []
            for k in np.flatnonzero(size > LEAF):
                for lead, members in _descend(int(node[edge[k]]) & (1 << 64) - 1, np.arange(edge[k], edge[k + 1]), low, percent):
                    if lead is None:
                        group.append(np.full(len(members), len(size) + len(group)))
                        at.append(members)
                    elif len(members):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(members)), ids.take(pa.array(np.full(len(members), lead)))], ["a", "b"])
            small = np.repeat((size > 1) & (size <= LEAF), size)
            group = np.concatenate([np.repeat(np.arange(len(size)), size)[small], *group])
            at = np.concatenate([np.flatnonzero(small), *at])
            cuts = [0, *np.searchsorted(group, group[1 << 16 :: 1 << 16], "left"), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # whole groups
                for x, y in _forest(group[a:b], at[a:b], low, n, percent):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y))], ["a", "b"])

    return deal(rows, "node", count).sortWithinPartitions("node", "id").mapInArrow(run, "a binary, b binary")


def _overlaps(sets: list[np.ndarray], rows: range):
    """For each of rows, the sizes of its set's intersections with all sets."""
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    for i in rows:
        low, high = np.searchsorted(grams, sets[i], "left"), np.searchsorted(grams, sets[i], "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield i, np.bincount(owner[at], minlength=len(sets))


def block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links a, b that join components. rows: key, id, comp, side, grams. In each key, side 0 meets side 1; alone, itself."""

    def run(batches):
        for keys, ids, comps, sides, grams in _blocks(batches):
            sets = [np.frombuffer(g, tb.U) for g in grams]
            size = np.array([len(x) for x in sets])
            parent = {c: c for c in comps.tolist()}

            def find(c, parent=parent):
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            two = bool(sides.any())
            out = []
            left = range(int((sides == 0).sum()))
            for i, both in _overlaps(sets, left):
                ok = 100 * both >= percent * (size[i] + size - both)
                ok[: (len(left) if two else i + 1)] = False
                for j in np.flatnonzero(ok & (comps != comps[i])):
                    x, y = find(int(comps[i])), find(int(comps[j]))
                    if x != y:
                        parent[x] = y
                        out.append((ids[i], ids[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])

    ready = rows.select("key", "id", "comp", "side", "grams").repartition(parts(rows.sparkSession), "key").sortWithinPartitions("key", "side", "id")
    return ready.mapInArrow(run, "a binary, b binary")


def _blocks(batches):
    """Runs of equal keys: key, ids, comps, sides, grams."""
    kept = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if kept is None else pa.concat_tables([kept, t])
        key = t.column(0).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield _block(t.slice(a, b - a))
        kept = t.slice(edge[-1]) if len(edge) else None
    if kept is not None and kept.num_rows:
        yield _block(kept)


def _block(t: pa.Table):
    return t.column(0)[0].as_py(), t.column(1).to_pylist(), t.column(2).to_numpy(), t.column(3).to_numpy(), t.column(4).to_pylist()


def shingles_of(docs: DataFrame, reps: DataFrame, ids: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """id, grams for the classes in ids, read from the text of one row of each class."""

    def run(batches):
        for batch in batches:
            for a, b, total, edge in shingle_sets(batch.column(1), width):
                got = [total[edge[i] : edge[i + 1]].tobytes() for i in range(b - a)]
                digest = [xxhash.xxh3_128_digest(x) if x else None for x in got]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(got, pa.binary())], ["id", "grams"])

    wanted = cut(reps.join(ids, "id", "left_semi").select(F.col("row").alias("key")))
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)  # FEW rows of eight bytes; beyond that, the texts are shuffled
    rows = docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    hashed = rows.join(wanted, "key", "left_semi").select("key", "text").mapInArrow(run, "id binary, grams binary")
    return hashed.where(F.col("id").isNotNull()).join(ids, "id", "left_semi").groupBy("id").agg(F.first("grams").alias("grams"))


def components(links: DataFrame) -> DataFrame:
    """id, root for every id in links (a, b); root is the smallest id of its component.

    Links that fit one task (EDGES_A_TASK, counted first) are joined there. More are joined by alternating large-star and
    small-star rounds in Spark, groupings and joins by node, until nothing changes.
    """

    def joined(batches):
        parent: dict[bytes, bytes] = {}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
                parent[max(x, y)] = min(x, y)
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([find(x) for x in ids], pa.binary())], ["id", "root"])

    links = links.select("a", "b")
    count = links.count()
    if count <= EDGES_A_TASK:
        return links.coalesce(1).mapInArrow(joined, "id binary, root binary")
    turned = lambda df, x, y: df.select(F.explode(F.array(F.struct(F.col(x[0]).alias("u"), F.col(x[1]).alias("v")), F.struct(F.col(y[0]).alias("u"), F.col(y[1]).alias("v")))).alias("e")).select("e.u", "e.v")
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    count = edges.count()
    while True:
        both = turned(edges, "uv", "vu")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = turned(large.join(least, "u"), "vm", "um").where("u <> v").distinct()
        nxt = cut(small)
        left = nxt.count()
        same = left == count and nxt.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges, count = nxt, left
        if same:
            return turned(edges, "uv", "vv").groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))


def hot_size(rows: int, tasks: int) -> int:
    """Members beyond which a node fills more than half of one of the tasks that rows are dealt to."""
    return max(LEAF, rows // (2 * max(tasks, -(-rows // ROWS_A_TASK))))


def hot_nodes(base: DataFrame, classes: int, percent: int):
    """Nodes that would fill more than half a task: sorted keys, and their leaders' low bytes and ids; and the rows dealt.

    One pass for each level that has hot nodes, and one for their leaders. What reaches the driver is two rows a task at most.
    """
    rows = int(classes * TREES * 100 / percent)
    most = hot_size(rows, parts(base.sparkSession))
    hot = (np.zeros(0, tb.U), np.zeros((0, SIGNATURE), np.uint8), [])
    depth = 0
    while True:
        depth += 1

        def reached(batches, hot=hot, depth=depth):
            for batch in batches:
                sig = _fixed(batch.column(0), 4 * SIGNATURE).view(np.uint32)
                for level, (node, *_) in enumerate(_routes(sig, hot, percent), 1):
                    if level == depth:
                        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64))], ["node"])

        found = base.select("signature").mapInArrow(reached, "node long").groupBy("node").count().where(F.col("count") > most)
        found = np.array([r.node for r in found.collect()], np.int64).view(tb.U)
        if not len(found):
            return hot, rows
        found.sort()

        def leading(batches, hot=hot, depth=depth, found=found):
            for batch in batches:
                sig = _fixed(batch.column(1), 4 * SIGNATURE).view(np.uint32)
                for level, (node, row, *_) in enumerate(_routes(sig, hot, percent), 1):
                    if level == depth:
                        mine = np.flatnonzero(np.isin(node, found))
                        draw = tb.mix(batch.column(0).to_numpy().view(tb.U)[row[mine]] ^ node[mine])
                        order = mine[np.lexsort((draw, node[mine]))]
                        order = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])] if len(order) else order
                        draw = tb.mix(batch.column(0).to_numpy().view(tb.U)[row[order]] ^ node[order])
                        lows = [x.tobytes() for x in sig[row[order]].astype(np.uint8)]
                        yield pa.RecordBatch.from_arrays([pa.array(node[order].view(np.int64)), pa.array(draw.view(np.int64)), batch.column(2).take(pa.array(row[order])), pa.array(lows, pa.binary())], ["node", "draw", "id", "low"])

        leaders = base.select(F.xxhash64("id").alias("h"), "signature", "id").mapInArrow(leading, "node long, draw long, id binary, low binary")
        leaders = leaders.groupBy("node").agg(F.min(F.struct("draw", "id", "low")).alias("l")).select("node", "l.id", "l.low").collect()
        keys = np.concatenate([hot[0], np.array([r.node for r in leaders], np.int64).view(tb.U)])
        low = np.concatenate([hot[1], np.frombuffer(b"".join(bytes(r.low) for r in leaders), np.uint8).reshape(-1, SIGNATURE)])
        ids = hot[2] + [bytes(r.id) for r in leaders]
        order = np.argsort(keys)
        hot = (keys[order], low[order], [ids[i] for i in order])


def near_pairs(base: DataFrame, percent: int) -> DataFrame:
    """A spanning set of near pairs (a, b) of classes. base: id, n, signature."""
    spark = base.sparkSession
    hot, count = hot_nodes(base, base.count(), percent)
    shared = spark.sparkContext.broadcast(hot)  # two rows a task at most
    near = _limits(percent)[0]

    def dealt(batches):
        for batch in batches:
            sig = _fixed(batch.column(2), 4 * SIGNATURE).view(np.uint32)
            low = sig.astype(np.uint8)
            lows = pa.array([x.tobytes() for x in low], pa.binary())
            for node, row, is_hot, _ in _routes(sig, shared.value, percent):
                take = pa.array(row[~is_hot])
                yield pa.RecordBatch.from_arrays([pa.array(node[~is_hot].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), lows.take(take)], ["node", "id", "n", "low"])

    def led(batches):
        for batch in batches:
            sig = _fixed(batch.column(2), 4 * SIGNATURE).view(np.uint32)
            low = sig.astype(np.uint8)
            for _, row, is_hot, at in _routes(sig, shared.value, percent):
                row, at = row[is_hot], at[is_hot]
                ok = (low[row] == shared.value[1][at]).sum(axis=1) >= near
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[ok])), pa.array([shared.value[2][k] for k in at[ok]], pa.binary())], ["a", "b"])

    rows = base.select("id", "n", "signature")
    pairs = node_pairs(rows.mapInArrow(dealt, "node long, id binary, n long, low binary"), percent, count)
    if len(hot[0]):
        pairs = pairs.unionByName(rows.mapInArrow(led, "a binary, b binary").where("a <> b"))
    return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def similarity_links(docs: DataFrame, reps: DataFrame, *, key: str, text: str, width: int, percent: int) -> DataFrame:
    """id, root of every class that is linked with another. reps: id, n, row (hash of a text of the class), signature."""
    near = cut(components(near_pairs(reps.select("id", "n", "signature"), percent)).withColumnRenamed("root", "hood"))
    near = near.join(near.groupBy("hood").agg(F.count("*").alias("size")), "hood")
    sets = cut(shingles_of(docs, reps, near.select("id"), key, text, width))

    blocks = F.ceil(F.col("size") / BLOCK)
    anchor = (blocks > 1) & (F.pmod(F.xxhash64("id", F.lit(1)), "size") < ANCHORS)
    block = F.explode(F.when(anchor, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), blocks))))
    rows = near.withColumn("block", block).select(F.xxhash64("hood", "block").alias("key"), "id", F.xxhash64("id").alias("comp"), F.lit(0).alias("side"))
    links = cut(block_links(rows.join(sets, "id"), percent))
    root = cut(components(links))

    large = near.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return root
    large = large.join(root, "id", "left").select("hood", "id", F.xxhash64(F.coalesce("root", "id")).alias("comp"))
    large = large.join(large.groupBy("hood", "comp").agg(F.count("*").alias("n")), ["hood", "comp"])
    large = cut(large.select("hood", "id", "comp", F.when(F.col("n") >= BLOCK // 2, F.col("comp")).otherwise(F.lit(0)).alias("label")))
    counts = large.groupBy("hood", "label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    large = cut(large.join(counts, ["hood", "label"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks"))
    each = cut(counts.select("hood", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")))
    other = each.select("hood", F.col("label").alias("label2"), F.col("block").alias("block2"))
    after = (F.col("label") < F.col("label2")) | (F.col("label") == F.col("label2")) & (F.col("label") == 0) & (F.col("block") <= F.col("block2"))
    meet = cut(each.join(other, "hood").where(after).withColumn("key", F.xxhash64("hood", "label", "block", "label2", "block2")))
    first = large.join(meet, ["hood", "label", "block"]).select("key", "id", "comp", F.lit(0).alias("side"))
    apart = meet.where((F.col("label") != F.col("label2")) | (F.col("block") != F.col("block2")))
    second = large.join(apart.select("hood", F.col("label2").alias("label"), F.col("block2").alias("block"), "key"), ["hood", "label", "block"])
    rows = first.unionByName(second.select("key", "id", "comp", F.lit(1).alias("side")))
    more = cut(block_links(rows.join(sets, "id"), percent))
    if more.isEmpty():
        return root
    return cut(components(links.unionByName(more)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: key, n_shingles, component (smallest key of the component), text_hash, first.

    first: whether the row is the one that stands for its component; rows repeated with key and text are all first, or none.
    """
    made = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sketch = made.withColumn("key", F.struct("key", F.xxhash64("text").alias("row")))
    sketch = cut(sketches(sketch, "key", "text", width).select("key.key", "key.row", "n_shingles", "digest", "signature"))
    name = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    reps = sketch.where(F.col("digest").isNotNull()).groupBy("digest")
    reps = cut(reps.agg(F.min(name).alias("name"), F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")).withColumnRenamed("digest", "id"))
    root = similarity_links(docs, reps, key=key, text=text, width=width, percent=percent)
    named = root.join(reps.select("id", "name"), "id")
    smallest = named.groupBy("root").agg(F.min("name").alias("head"))
    classes = reps.select("id", "name").join(named.select("id", "root").join(smallest, "root").select("id", "head"), "id", "left")
    classes = classes.select(F.col("id").alias("digest"), F.coalesce("head", "name").alias("head"))
    alone = sketch.where(F.col("digest").isNull()).select("key", "row", "n_shingles", name.alias("head"))
    rest = sketch.where(F.col("digest").isNotNull()).join(classes, "digest").select("key", "row", "n_shingles", "head")
    out = rest.unionByName(alone).withColumn("first", F.col("key").eqNullSafe(F.col("head.key")) & F.col("row").eqNullSafe(F.col("head.row")))
    return out.select(F.col("key").alias(key), "n_shingles", F.col("head.key").alias("component"), F.col("row").alias("text_hash"), "first")


def op10_near_duplicates(docs: DataFrame) -> DataFrame:
    """Contract columns of op10 for every row of docs. Of rows without id only one stands for a component that has no id."""
    got = near_duplicates(docs, width=3, percent=85)
    kept = F.when(F.col("doc_id").isNull(), F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("component")))
    return got.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))
