"""Missing links of a case's graph: a logistic regression learned from hidden links, its evaluation, suggestions and reasons.

Rows of a case travel as one table: case, kind, a, b with kind 'edge' (two nodes), 'type' (node, type), 'attr' (node, value),
'event' (two nodes, one row an event) and 'relation' (two nodes; relation in c). A case is one task, as in casegraph.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import casegraph as cg

KEYS = ("common_neighbours", "jaccard", "adamic_adar", "resource_allocation", "preferential_attachment", "inverse_distance", "same_community", "embedding_cosine", "type_lift", "shared_attributes", "direct_events")
# Least nodes, edges, and edges between nodes with other links; share hidden; rounds of training; repeats of the evaluation.
LEAST_NODES, LEAST_EDGES, LEAST_ELIGIBLE, HIDDEN, ROUNDS, REPEATS, NEGATIVES = 8, 12, 8, 0.2, 6, 3, 900
MOST_SURE = 0.5


class Case:
    """Nodes, edges and what is known of them, as arrays."""

    def __init__(self, pdf: pd.DataFrame):
        e = pdf[pdf.kind == "edge"]
        self.names = sorted({*e.a, *e.b})
        at = {x: i for i, x in enumerate(self.names)}
        self.n = len(self.names)
        pair = {(min(at[a], at[b]), max(at[a], at[b])) for a, b in zip(e.a, e.b, strict=True) if a != b}
        self.edges = np.array(sorted(pair), int).reshape(-1, 2)
        kinds = pdf[pdf.kind == "type"].drop_duplicates("a").set_index("a").b
        types = [str(kinds.get(x, "")) for x in self.names]
        self.type_names = sorted(set(types))
        self.type = np.array([self.type_names.index(t) for t in types], int)
        self.attr: list[set] = [set() for _ in self.names]
        for a, v in pdf.loc[pdf.kind == "attr", ["a", "b"]].itertuples(index=False):
            if a in at:
                self.attr[at[a]].add(v)
        met = pdf[pdf.kind == "event"]
        self.events = Counter((min(at[a], at[b]), max(at[a], at[b])) for a, b in zip(met.a, met.b, strict=True) if a in at and b in at and a != b)
        r = pdf[pdf.kind == "relation"]
        self.relations: dict[tuple[int, int], Counter] = {}
        for a, b, c in zip(r.a, r.b, r.c, strict=True):
            if a in at and b in at:
                self.relations.setdefault((min(at[a], at[b]), max(at[a], at[b])), Counter())[c] += 1


class View:
    """What the pairs of a case look like when only some of its edges are known."""

    def __init__(self, case: Case, edges: np.ndarray):
        self.case, n = case, case.n
        left, right = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        self.keys = np.unique(left * n + right)  # of each edge in both directions, in order
        self.to, self.edge = self.keys % n, np.searchsorted(self.keys // n, np.arange(n + 1))
        self.degree = np.diff(self.edge)
        self.ways = self.times(self.degree)
        g = cg.Csr(edges[:, 0], edges[:, 1])
        self.group = -1 - np.arange(n)
        self.group[g.names] = cg.louvain(g)
        self.place = self._place()
        size = np.bincount(case.type, minlength=len(case.type_names)).astype(float)
        linked = np.zeros((len(size), len(size)))
        np.add.at(linked, (case.type[edges].min(1), case.type[edges].max(1)), 1)
        possible = np.triu(np.outer(size, size), 1) + np.diag(size * (size - 1) / 2)
        lift = np.log((np.triu(linked) + 1) / (possible * (len(edges) / max(n * (n - 1) / 2, 1)) + 1))
        self.lift = np.triu(lift) + np.triu(lift, 1).T

    def near(self, i: int) -> np.ndarray:
        return self.to[self.edge[i] : self.edge[i + 1]]

    def spread(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in nodes, and neighbour, of each edge that leaves them."""
        size = self.degree[nodes]
        at = np.repeat(self.edge[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(nodes)), size), self.to[at]

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.asarray(a) * self.case.n + b
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)

    def times(self, q: np.ndarray) -> np.ndarray:
        """The matrix of the edges times q."""
        out, some = np.zeros_like(q), np.flatnonzero(self.degree)
        out[some] = np.add.reduceat(q[self.to], self.edge[some], axis=0)
        return out

    def _place(self, k: int = 16) -> np.ndarray:
        """Rows of the largest singular directions, found by repeated multiplication from a fixed start, of length one."""
        n = self.case.n
        if n < 3 or not self.degree.any():
            return np.zeros((n, 1), np.float32)
        k = max(1, min(k, n - 1))
        q = np.random.default_rng(42).standard_normal((n, min(n, k + 8)), np.float32)
        for _ in range(6):
            q, _ = np.linalg.qr(self.times(q))
        u, s, _ = np.linalg.svd(self.times(q).T, full_matrices=False)
        place = (q @ u[:, :k]) * s[:k]
        size = np.linalg.norm(place, axis=1, keepdims=True)
        return place / np.where(size == 0, 1, size)

    def features(self, pairs: np.ndarray, block: int = 512) -> np.ndarray:
        return np.vstack([self._features(pairs[i : i + block]) for i in range(0, len(pairs), block)] or [np.zeros((0, len(KEYS)))])

    def _features(self, pairs: np.ndarray) -> np.ndarray:
        i, j = pairs[:, 0], pairs[:, 1]
        d, n = self.degree.astype(float), self.case.n
        first, second = np.where(d[i] <= d[j], i, j), np.where(d[i] <= d[j], j, i)
        p, w = self.spread(first)
        hit = self.linked(w, second[p])
        p, w = p[hit], w[hit]
        common = np.bincount(p, minlength=len(pairs)).astype(float)
        any_ = d[i] + d[j] - common
        aa = np.bincount(p, np.where(d > 1, 1 / np.log(np.maximum(d, 2) + 1), 0)[w], len(pairs))
        ra = np.bincount(p, (1 / np.maximum(d, 1))[w], len(pairs))
        near = np.select([self.linked(i, j), common > 0], [1, 1 / 2], 0.0)
        apart = np.flatnonzero(near == 0)
        part = np.cumsum(self.ways[i[apart]] + self.ways[j[apart]]) >> 20  # a bounded number of ways of two steps at once
        for x in np.split(apart, np.flatnonzero(np.diff(part)) + 1):
            p, w = self.spread(i[x])
            q, u = self.spread(w)
            two = np.unique(p[q] * n + u)
            p, w = self.spread(j[x])
            q, u = self.spread(w)
            near[x[np.unique(p[q][np.isin(p[q] * n + u, two)])]] = 1 / 4
            near[x[np.unique(p[np.isin(p * n + w, two)])]] = 1 / 3
        attrs = [len(self.case.attr[a] & self.case.attr[b]) for a, b in pairs]
        events = [self.case.events.get((min(a, b), max(a, b)), 0) for a, b in pairs.tolist()]
        return np.column_stack([
            common, np.divide(common, any_, out=np.zeros_like(common), where=any_ > 0), aa, ra, np.log1p(d[i] * d[j]), near, self.group[i] == self.group[j],
            (self.place[i] * self.place[j]).sum(1), self.lift[self.case.type[i], self.case.type[j]], attrs, np.log1p(events),
        ]).astype(float)


def hide(case: Case, edges: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Which edges are hidden: at most so many, and every end keeps a link."""
    left, hidden, count = np.bincount(edges.ravel(), minlength=case.n), np.zeros(len(edges), bool), 0
    for x in rng.permutation(len(edges)):
        if count >= most:
            break
        a, b = edges[x]
        if left[a] >= 2 and left[b] >= 2:
            hidden[x] = True
            count += 1
            left[a] -= 1
            left[b] -= 1
    return hidden


def no_links(case: Case, view: View, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs without any edge of the case, and whether they were drawn among pairs with a common neighbour; half of each if there are."""
    taken = {tuple(e) for e in case.edges.tolist()}
    active = np.flatnonzero(view.degree > 0)
    centres = np.flatnonzero(view.degree > 1)
    out: dict[tuple[int, int], bool] = {}
    for near, want, tries in ((True, count // 2, 20 * count), (False, count, 60 * count)):
        for _ in range(tries):
            if len(out) >= want or (near and not len(centres)) or len(active) < 2:
                break
            if near:
                a, b = rng.choice(view.near(rng.choice(centres)), 2, replace=False)
            else:
                a, b = rng.choice(active, 2, replace=False)
            p = (int(min(a, b)), int(max(a, b)))
            if p not in taken and p not in out:
                out[p] = near
    return np.array(list(out), int).reshape(-1, 2), np.array(list(out.values()), bool)


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Weights and, last, the offset; classes balanced, squared weights penalised by 1 / c; Newton's steps."""
    z = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, len(y) / (2 * max((y == 1).sum(), 1)), len(y) / (2 * max((y == 0).sum(), 1)))
    ridge = np.diag([1 / c] * x.shape[1] + [1e-9])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, sd = x.mean(0), x.std(0)
        self.sd = np.where(sd == 0, 1, sd)
        self.w = logistic((x - self.mean) / self.sd, y)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """What each feature adds to the logit."""
        return (x - self.mean) / self.sd * self.w[:-1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(x).sum(1) + self.w[-1], -40, 40)))


def eligible(case: Case, edges: np.ndarray) -> int:
    d = np.bincount(edges.ravel(), minlength=case.n)
    return int(((d[edges[:, 0]] >= 2) & (d[edges[:, 1]] >= 2)).sum())


def learn(case: Case, edges: np.ndarray, rounds: int, rng: np.random.Generator) -> Model | None:
    """From pairs whose link was hidden against pairs without one, over several rounds of hiding."""
    xs, ys = [], []
    for _ in range(rounds):
        gone = hide(case, edges, max(2, round(HIDDEN * len(edges))), rng)
        if not gone.any():
            continue
        v = View(case, edges[~gone])
        none, _ = no_links(case, v, min(3 * int(gone.sum()), NEGATIVES), rng)
        xs += [v.features(edges[gone]), v.features(none)]
        ys += [np.ones(int(gone.sum())), np.zeros(len(none))]
    y = np.concatenate(ys) if ys else np.zeros(0)
    return Model(np.vstack(xs), y) if 0 < y.sum() < len(y) else None


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """How often a hidden link scores above a pair without one; equal scores count half. Not a number with one class only."""
    pos, neg = score[y == 1], np.sort(score[y == 0])
    if not len(pos) or not len(neg):
        return float("nan")
    return float((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).mean() / 2 / len(neg))


def evaluate(case: Case) -> list[dict]:
    """Of each repeat: a fifth of the links is hidden from the training and found among pairs without links."""
    out = []
    for repeat in range(REPEATS):
        rng = np.random.default_rng(100 + repeat)
        gone = hide(case, case.edges, max(3, round(HIDDEN * eligible(case, case.edges))), rng)
        known = case.edges[~gone]
        if gone.sum() < 3 or (model := learn(case, known, 4, rng)) is None:
            continue
        v = View(case, known)
        none, near = no_links(case, v, min(3 * int(gone.sum()), NEGATIVES), rng)
        x = np.vstack([v.features(case.edges[gone]), v.features(none)])
        y = np.concatenate([np.ones(int(gone.sum())), np.zeros(len(none))])
        hard = np.concatenate([np.ones(int(gone.sum()), bool), near])
        k, dice = int(y.sum()), rng.random(len(y))
        for method, s in (("model", model(x)), ("common_neighbours", x[:, 0]), ("adamic_adar", x[:, 2])):
            top = np.lexsort((dice, -s))[:k]
            out.append({"repeat": repeat, "method": method, "auc": auc(y, s), "auc_near": auc(y[hard], s[hard]), "precision_at_k": float(y[top].mean()), "k": k})
    return out


def too_small(case: Case) -> bool:
    return case.n < LEAST_NODES or len(case.edges) < LEAST_EDGES or eligible(case, case.edges) < LEAST_ELIGIBLE


def candidates(view: View, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """All pairs without an edge that have a common neighbour, in order and in blocks of about so many ways of two steps, one node's at least."""
    n = view.case.n
    ways = np.concatenate([[0], np.cumsum([view.degree[view.near(i)].sum() for i in range(n)])])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ways, ways[lo] + most, "right")) - 1)
        i, w = view.spread(np.arange(lo, hi))
        at, j = view.spread(w)
        i = i[at] + lo
        key = np.unique(i[i < j] * n + j[i < j])
        key = key[~view.linked(key // n, key % n)]
        if len(key):
            yield np.column_stack([key // n, key % n])
        lo = hi


def likely_relation(case: Case, view: View, a: int, b: int) -> str | None:
    """The commonest relation of the two with those they share; the first in the alphabet of equals."""
    seen: Counter = Counter()
    for w in np.intersect1d(view.near(a), view.near(b)):
        for x in (a, b):
            seen += case.relations.get((min(x, int(w)), max(x, int(w))), Counter())
    return min(seen, key=lambda r: (-seen[r], r), default=None)


def _solved(rows: DataFrame, make, schema: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = make(Case(pdf))
        out.insert(0, "case", pdf.case.iloc[0])
        return out

    rows = rows if "c" in rows.columns else rows.withColumn("c", F.lit(None).cast("string"))
    return rows.select("case", "kind", "a", "b", "c").where("a IS NOT NULL AND b IS NOT NULL").groupBy("case").applyInPandas(run, f"case string, {schema}")


def evaluation(rows: DataFrame) -> DataFrame:
    """case, repeat, method, auc, auc_near, precision_at_k, k. Cases too small to learn from have none."""
    columns = ["repeat", "method", "auc", "auc_near", "precision_at_k", "k"]
    return _solved(rows, lambda c: pd.DataFrame([] if too_small(c) else evaluate(c), columns=columns), "repeat long, method string, auc double, auc_near double, precision_at_k double, k long")


def suggestions(rows: DataFrame, most: int = 20) -> DataFrame:
    """case, a, b, probability, relation, reasons: each case's likeliest missing links; a report of the best.

    reasons: the three features that add most to the logit, name=contribution. Cases too small to learn from have none.
    """
    columns = ["a", "b", "probability", "relation", "reasons"]

    def make(case: Case) -> pd.DataFrame:
        model = None if too_small(case) else learn(case, case.edges, ROUNDS, np.random.default_rng(7))
        v = View(case, case.edges) if model else None
        best, p, out = np.zeros((0, 2), int), np.zeros(0), []
        for pairs in candidates(v) if model else ():
            best, p = np.vstack([best, pairs]), np.concatenate([p, model(v.features(pairs))])
            top = np.lexsort((best[:, 1], best[:, 0], -p.round(9)))[:most]
            best, p = best[top], p[top]
        for (a, b), sure in zip(best.tolist(), p.tolist(), strict=True):
            part = model.parts(v.features(np.array([(a, b)])))[0]
            why = [f"{KEYS[f]}={part[f]:.3f}" for f in np.argsort(-part, kind="stable")[:3] if part[f] > 0]
            out.append((case.names[a], case.names[b], sure, likely_relation(case, v, a, b), ", ".join(why)))
        return pd.DataFrame(out, columns=columns)

    return _solved(rows, make, "a string, b string, probability double, relation string, reasons string")


def explained(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """case, a, b, linked, feature, value, contribution, probability: what the model says of given pairs (case, a, b).

    Pairs travel as rows of kind 'asked'. Pairs of unknown nodes and of cases too small to learn from have no row.
    """
    columns = ["a", "b", "linked", "feature", "value", "contribution", "probability"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        case, asked = Case(pdf), pdf[pdf.kind == "asked"]
        at = {x: i for i, x in enumerate(case.names)}
        pair = [(at[a], at[b]) for a, b in zip(asked.a, asked.b, strict=True) if a in at and b in at and a != b]
        model = learn(case, case.edges, ROUNDS, np.random.default_rng(7)) if pair and not too_small(case) else None
        out = []
        if model:
            v, ij = View(case, case.edges), np.array(pair)
            x = v.features(ij)
            p, parts = model(x), model.parts(x)
            out = [(case.names[a], case.names[b], bool(v.linked([a], [b])[0]), KEYS[f], float(x[i, f]), float(parts[i, f]), float(p[i])) for i, (a, b) in enumerate(pair) for f in range(len(KEYS))]
        res = pd.DataFrame(out, columns=columns)
        res.insert(0, "case", pdf.case.iloc[0])
        return res

    rows = rows if "c" in rows.columns else rows.withColumn("c", F.lit(None).cast("string"))
    both = rows.select("case", "kind", "a", "b", "c").unionByName(pairs.select("case", F.lit("asked").alias("kind"), "a", "b", F.lit(None).cast("string").alias("c")))
    return both.where("a IS NOT NULL AND b IS NOT NULL").groupBy("case").applyInPandas(run, "case string, a string, b string, linked boolean, feature string, value double, contribution double, probability double")


def accepted(chosen: DataFrame, relationships: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Suggestions taken over as candidate relationships, and those refused with a reason.

    chosen: case, a, b, probability, relation. relationships: case, source, target, relation, state. Relations become capitals
    and underscores; confidence is the probability, at most a half. A pair is refused if it is linked, or if a candidate of the
    same relation exists.
    """
    name = F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.coalesce("relation", F.lit("")))), "[^A-Z0-9_]+", "_"), "^_+|_+$", "")
    c = chosen.withColumn("relation", name).withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    known = relationships.groupBy("case", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).agg(
        F.bool_or(~F.col("state").isin("candidate", "unreviewed")).alias("linked"), F.collect_set(F.when(F.col("state").isin("candidate", "unreviewed"), F.col("relation"))).alias("have")
    )
    j = c.join(known, ["case", "lo", "hi"], "left")
    reason = F.when(F.col("a") == F.col("b"), "one entity").when(F.length("relation") < 2, "no relation").when(F.coalesce("linked", F.lit(False)), "linked already").when(F.coalesce(F.array_contains("have", F.col("relation")), F.lit(False)), "candidate already")
    j = j.withColumn("reason", reason)
    new = j.where("reason IS NULL").select("case", F.col("a").alias("source"), F.col("b").alias("target"), "relation", F.round(F.least("probability", F.lit(MOST_SURE)), 3).alias("confidence"), F.lit("candidate").alias("state"), F.lit(by).alias("proposed_by"))
    return new, j.where("reason IS NOT NULL").select("case", "a", "b", "relation", "reason")
