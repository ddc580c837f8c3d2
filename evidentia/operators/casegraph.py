"""Measures of whole case graphs.

A case's graph is a table of edges a < b with the case's name. What counts neighbours or iterates is made of joins. What walks
a graph in order (cut vertices, communities, greedy removal) is solved case by case in numpy; a case is some thousand nodes, and
cases spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import twins
from .graph import both_ways, cut
from .twins import Twins

PIVOTS, MANY = 500, 1000
#: After TIDY visits, empty communities are taken out of the numbering, whose order stays; FEW weighs links against communities.
TIDY, FEW = 4096, 4


class Csr:
    """Neighbours of numbered nodes."""

    def __init__(self, a: Iterable, b: Iterable):
        a, b = np.asarray(a), np.asarray(b)
        a, b = (a, b) if a.dtype.kind in "iu" and b.dtype.kind in "iu" else (a.astype(object), b.astype(object))
        at, names = pd.factorize(np.concatenate([a, b]), sort=True)
        x, y = at[: len(a)].astype(int), at[len(a) :].astype(int)
        left, right = np.concatenate([x, y]), np.concatenate([y, x])
        order = np.lexsort((right, left))
        self.names = names.tolist()
        self.n, self.to = len(self.names), right[order]
        self.edge = np.searchsorted(left[order], np.arange(self.n + 1))
        self.degree = np.diff(self.edge)

    def near(self, i: int) -> np.ndarray:
        return self.to[self.edge[i] : self.edge[i + 1]]

    def spread(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to of all edges that leave the nodes of front."""
        size = self.degree[front]
        at = np.repeat(self.edge[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(front, size), self.to[at]


def components(g: Csr, gone: frozenset | set = frozenset()) -> np.ndarray:
    """Number of each node's component; -1 for nodes that are gone."""
    comp, k, to, edge = np.full(g.n, -1).tolist(), 0, g.to.tolist(), g.edge.tolist()
    for s in range(g.n):
        if comp[s] >= 0 or s in gone:
            continue
        comp[s], todo = k, [s]
        while todo:
            x = todo.pop()
            for y in to[edge[x] : edge[x + 1]]:
                if comp[y] < 0 and y not in gone:
                    comp[y] = k
                    todo.append(y)
        k += 1
    return np.array(comp, int)


def distances(g: Csr, source: int) -> np.ndarray:
    """Steps from source; -1 where there is no way."""
    dist, front, step = np.full(g.n, -1), np.array([source]), 0
    dist[source] = 0
    while len(front):
        step += 1
        new = np.unique(g.spread(front)[1])
        front = new[dist[new] < 0]
        dist[front] = step
    return dist


def betweenness(g: Csr) -> np.ndarray:
    """Share of shortest paths through each node, normalised; PIVOTS sources, drawn with a seed, where there are over MANY nodes."""
    sources = np.arange(g.n) if g.n <= MANY else np.sort(np.random.default_rng(42).choice(g.n, PIVOTS, replace=False))
    out, comp = np.zeros(g.n), components(g)
    size = np.bincount(comp)
    for s in sources:
        dist, sigma, levels, left = np.full(g.n, -1), np.zeros(g.n), [], size[comp[s]] - 1
        dist[s], sigma[s], front = 0, 1.0, np.array([s])
        while left:  # once all are found, no edge leads further down
            x, y = g.spread(front)
            new = dist[y] < 0
            x, y = x[new], y[new]
            dist[y] = len(levels) + 1
            front = np.unique(y) if len(y) < g.n // 8 else np.flatnonzero(dist == len(levels) + 1)
            got = np.bincount(y, sigma[x]) if len(y) > g.n // 8 else None
            if got is None:
                np.add.at(sigma, y, sigma[x])
            else:
                sigma[front] = got[front]
            levels.append((x, y))
            left -= len(front)
        delta = np.zeros(g.n)
        for x, y in reversed(levels):
            more = sigma[x] / sigma[y] * (1 + delta[y])
            if len(x) > g.n // 8:
                delta += np.bincount(x, more, g.n)
            else:
                np.add.at(delta, x, more)
        delta[s] = 0
        out += delta
    scale = (g.n - 1) * (g.n - 2)
    return out * (g.n / len(sources)) / scale if scale > 0 else out


def pagerank(g: Csr, damping: float = 0.85, tolerance: float = 1e-6) -> np.ndarray:
    rank, sink = np.full(g.n, 1 / max(g.n, 1)), g.degree == 0
    x, y = g.spread(np.arange(g.n))
    for _ in range(100):
        got = np.bincount(y, rank[x] / g.degree[x], g.n)
        new = (1 - damping) / g.n + damping * (got + rank[sink].sum() / g.n)
        if np.abs(new - rank).sum() < g.n * tolerance:
            return new
        rank = new
    return rank


def eigenvector(g: Csr) -> np.ndarray:
    """Of the adjacency matrix plus one, so that two-sided graphs converge, too; zeros if there is no edge."""
    v = np.ones(g.n)
    if not len(g.to):
        return np.zeros(g.n)
    x, y = g.spread(np.arange(g.n))
    for _ in range(1000):
        new = v + np.bincount(x, v[y], g.n)
        new /= np.linalg.norm(new)
        if np.abs(new - v).max() < 1e-10:
            break
        v = new
    return new


def closeness(g: Csr, words: int = 256) -> np.ndarray:
    """Reached nodes over their distances, scaled by the share of nodes that is reached; exact, from all nodes.

    Leaves are taken off first: a leaf is one step further from all than its neighbour. Of what is left, 64 * words nodes are
    walked from at once, one bit each, component by component; ways are as long in both directions, so a node's new bits of a step
    are the nodes that it reaches in so many steps. A node's leaves count with it, and nodes of equally many leaves share words.
    """
    comp, out = components(g), np.zeros(g.n)
    if not g.n:
        return out
    size = np.bincount(comp)
    leaf = (g.degree == 1) & (size[comp] > 2)
    mother = g.to[np.minimum(g.edge[:-1], max(len(g.to) - 1, 0))]
    leaves = np.bincount(mother[leaf], minlength=g.n)
    inner = np.flatnonzero(~leaf)
    inner = inner[np.argsort(comp[inner], kind="stable")]
    far = np.zeros(g.n)
    x, y = g.spread(np.arange(g.n))
    kept = ~leaf[x] & ~leaf[y]
    x, y = x[kept], y[kept]
    order = np.argsort(comp[x], kind="stable")
    x, y = x[order], y[order]
    first, row = np.searchsorted(comp[x], np.arange(len(size) + 1)), np.zeros(g.n, int)
    part = np.searchsorted(comp[inner], np.arange(len(size) + 1))
    for c in np.flatnonzero(size > 1):
        nodes, a, b = inner[part[c] : part[c + 1]], x[first[c] : first[c + 1]], y[first[c] : first[c + 1]]
        own = leaves[nodes].sum()  # each leaf is a step further than its neighbour
        row[nodes] = np.arange(len(nodes))
        begin = np.flatnonzero(np.diff(a, prepend=-1)) if len(a) else np.zeros(0, int)
        at, b = row[a[begin]], row[b]
        w = np.sort(np.unique(leaves[nodes]))
        bits = [(int(k), group[i : i + 64]) for k in w for group in [nodes[leaves[nodes] == k]] for i in range(0, len(group), 64)]
        for start in range(0, len(bits), words):
            some = bits[start : start + words]
            seen, weight = np.zeros((len(nodes), len(some)), np.uint64), np.array([1.0 + k for k, _ in some])
            for i, (_, group) in enumerate(some):
                seen[row[group], i] |= np.uint64(1) << np.arange(len(group), dtype=np.uint64)
            front, step = seen.copy(), 0
            while len(begin):
                step += 1
                new = np.zeros_like(seen)
                for lo in range(0, len(some), 32):  # a few columns at once stay small
                    new[at, lo : lo + 32] = np.bitwise_or.reduceat(front[b, lo : lo + 32], begin, axis=0)
                new &= ~seen
                if not new.any():
                    break
                far[nodes] += step * (np.bitwise_count(new) @ weight)
                seen |= new
                front = new
        far[nodes] += own
    far[leaf] = far[mother[leaf]] + size[comp[leaf]] - 2
    reached = (size[comp] - 1).astype(float)
    ok = far > 0
    out[ok] = reached[ok] / far[ok] * reached[ok] / (g.n - 1)
    return out


def core_numbers(g: Csr) -> np.ndarray:
    """Weakest nodes are peeled off together; which of equals goes first makes no difference."""
    degree, core, there, k = g.degree.copy(), np.zeros(g.n, int), np.ones(g.n, bool), 0
    left = np.arange(g.n)
    while len(left):
        k = max(k, int(degree[left].min()))
        front = left[degree[left] <= k]
        while len(front):
            core[front], there[front] = k, False
            y = g.spread(front)[1]
            y, lost = np.unique(y[there[y]], return_counts=True)
            degree[y] -= lost
            front = y[degree[y] <= k]
        left = left[there[left]]
    return core


def cut_vertices(g: Csr) -> np.ndarray:
    """Nodes whose removal parts their component."""
    found, low, is_cut, clock = np.full(g.n, -1), np.zeros(g.n, int), np.zeros(g.n, bool), 0
    for root in range(g.n):
        if found[root] >= 0:
            continue
        kids, stack = 0, [(root, -1, 0)]
        found[root] = low[root] = clock
        clock += 1
        while stack:
            x, above, i = stack.pop()
            near = g.near(x)
            if i < len(near):
                stack.append((x, above, i + 1))
                y = int(near[i])
                if found[y] < 0:
                    found[y] = low[y] = clock
                    clock += 1
                    kids += x == root
                    stack.append((y, x, 0))
                elif y != above:
                    low[x] = min(low[x], found[y])
            elif above >= 0:
                low[above] = min(low[above], low[x])
                if above != root and low[x] >= found[above]:
                    is_cut[above] = True
        is_cut[root] = kids > 1
    return is_cut


def clustering(g: Csr) -> np.ndarray:
    near, out = [set(g.near(i).tolist()) for i in range(g.n)], np.zeros(g.n)
    for i in range(g.n):
        k = len(near[i])
        if k > 1:
            out[i] = sum(len(near[i] & near[j]) for j in near[i]) / (k * (k - 1))
    return out


def louvain(g: Csr | Twins) -> np.ndarray:
    """Communities of locally greatest modularity: nodes move to the best neighbouring community, communities become nodes, until nothing moves.

    Nodes are visited in order and ties go to the smallest community, so the result is the same on every run.
    """
    (to, edge), row = (g.lists(), g.row) if isinstance(g, Twins) else ((g.to, g.edge), np.arange(g.n))
    weight, label, total = np.ones(len(to)), np.arange(g.n), float(g.degree.sum())
    degrees, loop = g.degree.astype(float), g.inner[row].astype(float) if isinstance(g, Twins) else np.zeros(g.n)
    if not total:
        return label
    while True:
        n = len(row)
        degree = degrees.tolist()
        own, inside, moved, again = np.arange(n), degree.copy(), False, True
        filled = np.array(inside)  # as inside
        start, mine, sums = edge.tolist(), list(range(n)), np.zeros(n)
        while again:
            again = False
            for a in range(n):
                if a % TIDY == TIDY - 1:
                    used, own = np.unique(own, return_inverse=True)
                    mine, inside, filled = own.tolist(), [inside[c] for c in used.tolist()], filled[used]
                lo, hi = start[row[a]], start[row[a] + 1]
                here, share = mine[a], degree[a]
                inside[here] -= share
                filled[here] = inside[here]
                best, most, stay = here, None, 0.0
                if hi - lo < 48:
                    links: dict[int, float] = {}
                    for b, w in zip(to[lo:hi].tolist(), weight[lo:hi].tolist(), strict=True):
                        if b != a:
                            c = mine[b]
                            links[c] = links.get(c, 0.0) + w
                    for c, w in links.items():
                        gain = w - inside[c] * share / total
                        if most is None or gain > most or (gain == most and c < best):
                            best, most = c, gain
                    stay = links.get(here, 0.0)
                else:  # weights are whole numbers, so sums in any order are equal
                    c, w = own[to[lo:hi]], weight[lo:hi]
                    if FEW * len(c) < len(filled):  # much fewer links than communities: these are not gone through
                        np.add.at(sums, c, w)
                        sums[here] -= loop[a]  # no node is its own neighbour
                        gains = sums[c] - filled[c] * share / total
                        if len(c):
                            most = float(gains.max())
                            best = int(c[gains == most].min())
                        stay = float(sums[here])
                        sums[c] = sums[here] = 0.0
                    else:
                        added = np.bincount(c, w, here + 1)
                        added[here] -= loop[a]
                        found = np.flatnonzero(added)
                        if len(found):
                            gains = added[found] - filled[found] * share / total
                            x = int(gains.argmax())  # the smallest community of equals
                            best, most = int(found[x]), float(gains[x])
                        stay = float(added[here])
                if (0.0 if most is None else most) > stay - inside[here] * share / total + 1e-12:
                    mine[a], own[a], again, moved = best, best, True, True
                inside[mine[a]] += share
                filled[mine[a]] = inside[mine[a]]
        names = {c: i for i, c in enumerate(dict.fromkeys(mine))}
        renamed = np.array([names[c] for c in mine])
        label = renamed[label]
        if not moved or len(names) == n:
            return label
        k = len(names)
        held, many = np.unique(row * k + renamed, return_counts=True)  # nodes of each list and community
        pair, at = np.unique(np.repeat(np.arange(len(edge) - 1), np.diff(edge)) * k + renamed[to], return_inverse=True)
        both = pd.DataFrame({"row": held // k, "a": held % k, "m": many}).merge(pd.DataFrame({"row": pair // k, "b": pair % k, "w": np.bincount(at, weight)}), on="row")
        own_list = np.zeros(0, int)
        if isinstance(g, Twins) and n == g.n:  # a node is no neighbour of itself, though its twins are
            own_list = renamed[g.inner[row]]
        pair, at = np.unique(np.concatenate([both.a.to_numpy() * k + both.b.to_numpy(), own_list * (k + 1)]), return_inverse=True)
        weight = np.bincount(at, np.concatenate([(both.m * both.w).to_numpy(), np.full(len(own_list), -1.0)]))
        pair, weight = pair[weight > 0], weight[weight > 0]
        to, edge, row = pair % k, np.searchsorted(pair // k, np.arange(k + 1)), np.arange(k)
        degrees, loop = np.bincount(pair // k, weight, k), np.bincount(pair // k, weight * (pair // k == to), k)


def modularity(g: Csr, label: np.ndarray) -> float:
    x, y = g.spread(np.arange(g.n))
    if not len(x):
        return 0.0
    degree = np.bincount(label, weights=g.degree)
    return float((label[x] == label[y]).mean() - ((degree / len(x)) ** 2).sum())


def spectral(g: Csr, k: int = 16) -> np.ndarray:
    """Coordinates of the nodes on the largest singular vectors, each row of length one."""
    if g.n < 3 or not len(g.to):
        return np.zeros((g.n, 1))
    m = np.zeros((g.n, g.n), np.float32)
    x, y = g.spread(np.arange(g.n))
    m[x, y] = 1
    u, s, _ = np.linalg.svd(m)
    k = max(1, min(k, g.n - 1))
    e = u[:, :k] * s[:k]
    size = np.linalg.norm(e, axis=1, keepdims=True)
    return e / np.where(size == 0, 1, size)


def percentile(v: np.ndarray) -> np.ndarray:
    """Share of smaller values and half of the equal ones."""
    order = np.sort(v)
    return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right")) / 2 / max(len(v), 1)


def connected_pairs(comp: np.ndarray) -> int:
    size = np.bincount(comp[comp >= 0])
    return int((size * (size - 1) // 2).sum())


def _by_case(edges: DataFrame, make, schema: str) -> DataFrame:
    """make(Csr) -> columns of one frame, for each case. edges: case, a, b."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = make(Csr(pdf.a, pdf.b))
        out.insert(0, "case", pdf.case.iloc[0])
        return out

    return edges.select("case", "a", "b").distinct().where("a <> b").groupBy("case").applyInPandas(run, f"case string, {schema}")


MEASURES = {
    "degree": ("double", lambda g: g.degree / max(g.n - 1, 1)), "betweenness": ("double", betweenness), "pagerank": ("double", pagerank), "eigenvector": ("double", eigenvector), "closeness": ("double", closeness),
    "clustering": ("double", clustering), "core": ("long", core_numbers), "cut_vertex": ("boolean", cut_vertices), "community": ("long", louvain),
}


WITH_TWINS = {"betweenness": twins.betweenness, "pagerank": twins.pagerank, "core": twins.core_numbers, "community": louvain}


def centralities(edges: DataFrame, only: tuple = tuple(MEASURES)) -> DataFrame:
    """case, node, degree, betweenness, pagerank, eigenvector, closeness, clustering, core, cut_vertex, community; or only those asked for.

    Where edges has a column twin, a and b are classes, and a row whose twin is true says that node b belongs to class a, whose name
    is its first node; betweenness then comes from all nodes, at any size.
    """
    schema = ", ".join(["node string", *[f"{m} {MEASURES[m][0]}" for m in only]])

    def make(g: Csr) -> pd.DataFrame:
        return pd.DataFrame({"node": g.names} | {m: MEASURES[m][1](g) for m in only})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf.twin.to_numpy(bool)
        g = Twins(pdf.a[~same], pdf.b[~same], pdf.a[same], pdf.b[same])
        whole = Csr(*g.pairs()) if set(only) - set(WITH_TWINS) else None
        out = pd.DataFrame({"node": g.names} | {m: WITH_TWINS[m](g) if m in WITH_TWINS else MEASURES[m][1](whole) for m in only})
        out.insert(0, "case", pdf.case.iloc[0])
        return out

    if "twin" in edges.columns:
        return edges.select("case", "a", "b", "twin").distinct().groupBy("case").applyInPandas(run, f"case string, {schema}")
    return _by_case(edges, make, schema)


def roles(edges: DataFrame) -> DataFrame:
    """case, node, role, confidence, by percentiles of the measures; cases of fewer than six nodes have none."""
    edges = cut(edges.select("case", "a", "b").distinct())
    m = cut(centralities(edges, ("betweenness", "pagerank", "clustering", "core", "cut_vertex", "community")))
    e = both_ways_by_case(edges)
    around = e.join(m.select("case", F.col("node").alias("b"), "community"), ["case", "b"]).groupBy("case", F.col("a").alias("node")).agg(F.countDistinct("community").alias("communities"), F.count("*").alias("links"))
    m = m.join(around, ["case", "node"])
    w, n = Window.partitionBy("case"), F.count("*").over(Window.partitionBy("case"))
    for c in ("links", "pagerank", "betweenness"):
        r = F.rank().over(w.orderBy(c))
        same = F.count("*").over(Window.partitionBy("case", c))
        m = m.withColumn(f"p_{c}", ((r - 1) + 0.5 * same) / n)
    m = m.withColumn("size", n).withColumn("top_core", F.max("core").over(w))
    c, one = F.col, F.lit(1.0)
    hub = (c("p_links") >= 0.85) & (c("p_pagerank") >= 0.8) & (c("links") >= 3)
    broker = (c("p_betweenness") >= 0.85) & (c("betweenness") > 0) & ((c("communities") >= 2) | c("cut_vertex"))
    courier = c("links").between(2, 3) & (c("betweenness") > 0) & (c("cut_vertex") | (c("p_betweenness") >= 0.5)) & (c("p_links") < 0.85)
    core = (c("links") >= 3) & (c("core") >= F.greatest(F.lit(2), c("top_core"))) & (c("clustering") >= 0.3)
    edge = (c("links") <= 1) | (c("p_links") <= 0.35)
    kinds = (
        (hub, "Coordinator / Hub", 0.5 + 0.45 * F.least(one, (F.least("p_links", "p_pagerank") - 0.8) / 0.2)), (broker, "Broker / Bridge", 0.5 + 0.45 * F.least(one, (c("p_betweenness") - 0.85) / 0.15)),
        (courier, "Courier / Intermediary", 0.45 + 0.4 * F.least(one, c("p_betweenness"))), (core, "Core member", 0.5 + 0.3 * F.least(one, c("clustering"))), (edge, "Peripheral", 0.6 + 0.3 * (1 - c("p_links"))),
    )
    role, sure = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for when, name, confidence in kinds:
        role, sure = role.when(when, name), sure.when(when, confidence)
    return m.where("size >= 6").select("case", "node", role.otherwise("Member").alias("role"), F.round(sure.otherwise(0.4), 2).alias("confidence"))


def both_ways_by_case(edges: DataFrame) -> DataFrame:
    e = edges.select("case", "a", "b").distinct().where("a <> b")
    return e.unionByName(e.select("case", F.col("b").alias("a"), F.col("a").alias("b")))


def metrics(edges: DataFrame) -> DataFrame:
    """case, nodes, edges, components, largest, avg_path, diameter, communities, modularity, pairs. Paths within the largest component."""

    def make(g: Csr) -> pd.DataFrame:
        comp, label = components(g), louvain(g)
        size = np.bincount(comp)
        big = np.flatnonzero(comp == size.argmax())
        from_ = big if len(big) <= 1200 else np.sort(np.random.default_rng(1).choice(big, 100, replace=False))
        d = np.concatenate([distances(g, s)[big] for s in from_])
        d = d[d > 0]
        return pd.DataFrame({"nodes": [g.n], "edges": [len(g.to) // 2], "components": [len(size)], "largest": [int(size.max())], "avg_path": [float(d.mean())], "diameter": [int(d.max())], "communities": [int((np.bincount(label) > 1).sum())], "modularity": [modularity(g, label)], "pairs": [connected_pairs(comp)]})

    return _by_case(edges, make, "nodes long, edges long, components long, largest long, avg_path double, diameter long, communities long, modularity double, pairs long")


def critical_nodes(edges: DataFrame, k: int = 5, pool: int = 300) -> DataFrame:
    """case, kind, step, node, pairs_after: what each cut vertex parts, most first, and the k nodes that together part most, picked one by one."""

    def make(g: Csr) -> pd.DataFrame:
        base, rows = connected_pairs(components(g)), []
        cuts = np.flatnonzero(cut_vertices(g))
        single = sorted(((connected_pairs(components(g, {int(i)})), g.names[i]) for i in cuts), key=lambda r: (r[0], r[1]))
        rows += [("articulation", s, x, p) for s, (p, x) in enumerate(single, 1)]
        among = range(g.n)
        if g.n > pool:
            b = betweenness(g)
            among = sorted(range(g.n), key=lambda i: (-(b[i] + g.degree[i] / 1000), g.names[i]))[:pool]
        gone: set[int] = set()
        now = base
        for step in range(1, k + 1):
            best = None
            for i in among:
                if i not in gone:
                    comp = components(g, gone | {i})
                    size = np.bincount(comp[comp >= 0])
                    key = (connected_pairs(comp), int(size.max(initial=0)), -len(size), -int(g.degree[i]), g.names[i])
                    if best is None or key < best[0]:
                        best = key, i
            if best is None or best[0][0] >= now:
                break
            now = best[0][0]
            gone.add(best[1])
            rows.append(("greedy", step, g.names[best[1]], now))
        return pd.DataFrame(rows, columns=["kind", "step", "node", "pairs_after"])

    return _by_case(edges, make, "kind string, step long, node string, pairs_after long")


def removal(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """case, nodes_left, pairs_before, pairs_after, isolated: what taking out the nodes of gone (case, node) breaks."""
    kept = edges.join(gone.select("case", F.col("node").alias("a")), ["case", "a"], "left_anti").join(gone.select("case", F.col("node").alias("b")), ["case", "b"], "left_anti").select("case", "a", "b")
    marked = edges.select("case", "a", "b", F.lit(0).alias("k")).unionByName(kept.withColumn("k", F.lit(1)))
    out = gone.groupBy("case").agg(F.collect_set("node").alias("gone"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Csr(pdf.a[pdf.k == 0], pdf.b[pdf.k == 0])
        away = set() if pdf.gone.iloc[0] is None else {i for i, x in enumerate(g.names) if x in set(pdf.gone.iloc[0])}
        before, after = components(g), components(g, away)
        left = np.array([i not in away for i in range(g.n)], bool)
        alone = left & (g.degree > 0) & np.array([after[i] >= 0 and not any(j not in away for j in g.near(i).tolist()) for i in range(g.n)], bool)
        return pd.DataFrame({"case": [pdf.case.iloc[0]], "nodes_left": [int(left.sum())], "pairs_before": [connected_pairs(np.where(left, before, -1))], "pairs_after": [connected_pairs(after)], "isolated": [int(alone.sum())]})

    return marked.join(out, "case", "left").groupBy("case").applyInPandas(run, "case string, nodes_left long, pairs_before long, pairs_after long, isolated long")


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """case, node of the part in which every node has k neighbours or more: weaker nodes are peeled off by joins until none is left."""
    e = cut(both_ways_by_case(edges))
    while True:
        strong = e.groupBy("case", "a").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("case", "a")
        nxt = cut(e.join(strong, ["case", "a"], "left_semi").join(strong.withColumnRenamed("a", "b"), ["case", "b"], "left_semi").select("case", "a", "b"))
        if nxt.count() == e.count():
            return nxt.select("case", F.col("a").alias("node")).distinct()
        e = nxt


def pair_measures(edges: DataFrame) -> DataFrame:
    """case, u, v, common, jaccard, adamic_adar, allocation, attachment of unconnected pairs with common neighbours.

    A node of degree d stands for d * d pairs, as the measure asks for them; nodes that link more than MANY others add nothing.
    """
    e = cut(both_ways_by_case(edges))
    degree = cut(e.groupBy("case", F.col("a").alias("node")).agg(F.count("*").alias("d")))
    mid = e.join(degree.where(F.col("d") <= MANY).withColumnRenamed("node", "b"), ["case", "b"]).select("case", "b", F.col("a").alias("u"), "d")
    wedge = mid.join(mid.select("case", "b", F.col("u").alias("v")), ["case", "b"]).where("u < v")
    got = wedge.groupBy("case", "u", "v").agg(F.count("*").alias("common"), F.sum(1 / F.log(F.col("d") + 1.0)).alias("adamic_adar"), F.sum(1 / F.col("d")).alias("allocation"))
    got = got.join(e.select("case", F.col("a").alias("u"), F.col("b").alias("v")), ["case", "u", "v"], "left_anti")
    for x in ("u", "v"):
        got = got.join(degree.select("case", F.col("node").alias(x), F.col("d").alias(f"d{x}")), ["case", x])
    return got.select("case", "u", "v", "common", (F.col("common") / (F.col("du") + F.col("dv") - F.col("common"))).alias("jaccard"), "adamic_adar", "allocation", F.log1p(F.col("du") * F.col("dv")).alias("attachment"))


def hidden_paths(pairs: DataFrame, source, target, most: int = 4, best: int = 10) -> DataFrame:
    """path, hops, confidence: simple paths of two hops and more from source to target, short and certain ones first. pairs: a, b, confidence."""
    e = cut(pairs.select("a", "b", "confidence").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence")))
    front = e.where(F.col("a") == F.lit(source)).select(F.array("a", "b").alias("path"), F.col("b").alias("end"), F.col("confidence").alias("total"))
    found = None
    for hops in range(2, most + 1):
        grown = front.where(F.col("end") != F.lit(target)).join(e, F.col("end") == F.col("a")).where(~F.array_contains("path", F.col("b")))
        front = cut(grown.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("end"), (F.col("total") + F.col("confidence")).alias("total")))
        hit = front.where(F.col("end") == F.lit(target)).select("path", F.lit(hops).cast("long").alias("hops"), F.round(F.col("total") / hops, 4).alias("confidence"))
        found = hit if found is None else found.unionByName(hit)
    return found.orderBy("hops", F.desc("confidence"), "path").limit(best)


def path_details(edges: DataFrame, path: list) -> DataFrame:
    """hop, src, dst, relation, confidence along a path: an edge in its direction first, else one against it; the most certain one."""
    spark = edges.sparkSession
    hops = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(path, path[1:]), 1)], "hop long, src string, dst string")  # noqa: B905
    e = edges.select("src", "dst", "relation", "confidence")
    both = e.withColumn("back", F.lit(0)).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "confidence").withColumn("back", F.lit(1)))
    w = Window.partitionBy("hop").orderBy("back", F.desc("confidence"), "relation")
    j = F.broadcast(hops).join(both, ["src", "dst"]).withColumn("n", F.row_number().over(w)).where("n = 1")  # a path has few hops
    return j.select("hop", "src", "dst", "relation", "confidence")
