"""Measures of a graph whose nodes fall into classes of twins: nodes with the same neighbours, all or none linked with each other.

Twins have equal measures, so these are solved once a class, with the class's size as weight; the results are those of the whole
graph. Communities depend on the order of nodes and are found node by node, with one list of neighbours a class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Sources that are walked from at once, and rows of the matrix that are unpacked at once.
SOURCES, ROWS = 256, 1024


class Twins:
    """Classes and their neighbours; names, degree, row (class) and n are of nodes. a, b: linked classes, a class with itself if its nodes are linked."""

    def __init__(self, a, b, of, node):
        a, b, of, node = (np.asarray(x, object) for x in (a, b, of, node))
        at, names = pd.factorize(np.concatenate([a, b]), sort=True)
        x, y = at[: len(a)].astype(int), at[len(a) :].astype(int)
        more = pd.Index(names).get_indexer(of) if len(of) else np.zeros(0, int)
        node, more = node[more >= 0], more[more >= 0]  # classes without any link are no part of the graph
        every, row = np.concatenate([np.asarray(names, object), node]), np.concatenate([np.arange(len(names)), more])
        order = pd.Series(every).argsort(kind="stable").to_numpy()
        self.names, self.row, self.n, self.k = every[order].tolist(), row[order], len(every), len(names)
        self.size = np.bincount(row, minlength=self.k).astype(float)
        self.inner = np.zeros(self.k, bool)
        self.inner[x[x == y]] = True
        self.inner &= self.size > 1
        x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0).T
        left, right = np.concatenate([x, y]), np.concatenate([y, x])
        order = np.lexsort((right, left))
        self.x, self.y = left[order], right[order]
        self.first = np.searchsorted(self.x, np.arange(self.k + 1))
        self.links = np.bincount(self.x, self.size[self.y], self.k) + self.inner * (self.size - 1)
        self.degree = self.links[self.row].astype(int)
        kept = self.degree > 0
        if not kept.all():  # a class linked only with itself, of one node
            self.names, self.row, self.degree = [x for x, k in zip(self.names, kept, strict=True) if k], self.row[kept], self.degree[kept]
            self.n = len(self.names)

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """to, edge: the nodes next to each class, its own where they are linked with each other."""
        own = np.flatnonzero(self.inner)
        x, y = np.concatenate([self.x, own]), np.concatenate([self.y, own])
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        member = np.argsort(self.row, kind="stable")
        begin, size = np.searchsorted(self.row[member], np.arange(self.k)), self.size[y].astype(int)
        at = np.repeat(begin[y] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return member[at], np.concatenate([[0], np.cumsum(size)])[np.searchsorted(x, np.arange(self.k + 1))]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All edges of the graph, once each."""
        to, edge = self.lists()
        size = np.diff(edge)[self.row]
        at = np.repeat(edge[self.row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        x, y = np.repeat(np.arange(self.n), size), to[at]
        names = np.array(self.names, object)
        return names[x[x < y]], names[y[x < y]]


def pagerank(g: Twins, damping: float = 0.85, tolerance: float = 1e-6) -> np.ndarray:
    rank = np.full(g.k, 1 / max(g.n, 1))
    degree = np.maximum(g.links, 1)
    for _ in range(100):
        share = rank / degree
        new = (1 - damping) / g.n + damping * (np.bincount(g.x, (share * g.size)[g.y], g.k) + g.inner * (g.size - 1) * share)
        if (np.abs(new - rank) * g.size).sum() < g.n * tolerance:
            return new[g.row]
        rank = new
    return rank[g.row]


def core_numbers(g: Twins) -> np.ndarray:
    """Twins have equal degrees all along, so they are peeled off together."""
    degree, core, there, k = g.links.copy(), np.zeros(g.k, int), np.ones(g.k, bool), 0
    left = np.arange(g.k)
    while len(left):
        k = max(k, int(degree[left].min()))
        front = left[degree[left] <= k]
        while len(front):
            core[front], there[front] = k, False
            size = g.first[front + 1] - g.first[front]
            at = np.repeat(g.first[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            x, y = np.repeat(front, size), g.y[at]
            x, y = x[there[y]], y[there[y]]
            degree -= np.bincount(y, g.size[x], g.k)
            y = np.unique(y)
            front = y[degree[y] <= k]
        left = left[there[left]]
    return core[g.row]


def betweenness(g: Twins) -> np.ndarray:
    """Share of shortest paths through each node, from all nodes, normalised.

    A source's own twins are ends of paths, but never within one: those linked with it are one step away, the others two, and
    what they are linked with is nearer. Graphs with many links are walked as a matrix, from many sources at once.
    """
    out, part = np.zeros(g.k), np.arange(g.k)
    while True:
        new = part.copy()
        np.minimum.at(new, g.x, part[g.y])
        new = new[new]
        if (new == part).all():
            break
        part = new
    order, place = np.argsort(part, kind="stable"), np.zeros(g.k, int)
    start = np.flatnonzero(np.diff(part[order], prepend=-1))
    edges = np.argsort(part[g.x], kind="stable")
    sides = part[g.x][edges]
    for lo, hi in zip(start, [*start[1:], g.k], strict=True):
        if hi - lo > 1:
            some = order[lo:hi]
            place[some] = np.arange(hi - lo)
            a, b = np.searchsorted(sides, part[some[0]]), np.searchsorted(sides, part[some[0]], "right")
            out[some] = _Part(place[g.x[edges[a:b]]], place[g.y[edges[a:b]]], g.size[some], g.inner[some], g.links[some]).shares()
    scale = (g.n - 1) * (g.n - 2)
    return (out / scale if scale > 0 else out)[g.row]


class _Part:
    """A component: x, y: linked classes both ways, ordered by x."""

    def __init__(self, x, y, size, inner, links):
        self.x, self.y, self.size, self.inner, self.links, self.k = x, y, size, inner, links, len(size)
        self.first = np.searchsorted(x, np.arange(self.k + 1))

    def shares(self) -> np.ndarray:
        return _by_matrix(self) if self.k * self.k < 75 * len(self.x) else _by_lists(self)


def _by_matrix(g: _Part) -> np.ndarray:
    packed = []
    for lo in range(0, g.k, ROWS):
        part, a, b = np.zeros((min(ROWS, g.k - lo), g.k), bool), g.first[lo], g.first[min(lo + ROWS, g.k)]
        part[g.x[a:b] - lo, g.y[a:b]] = True
        packed.append(np.packbits(part, axis=1))

    def times(v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.unpackbits(p, axis=1, count=g.k).astype(float) @ v for p in packed])

    out, size = np.zeros(g.k), g.size[:, None]
    for lo in range(0, g.k, SOURCES):
        s = np.arange(lo, min(lo + SOURCES, g.k))
        at, a, b = np.arange(len(s)), g.first[s[0]], g.first[s[-1] + 1]
        seen, front = np.zeros((g.k, len(s)), bool), np.zeros((g.k, len(s)), bool)
        front[g.y[a:b], g.x[a:b] - lo] = True
        seen[s, at] = True
        sigma, levels = front.astype(float), []
        while front.any():
            levels.append(front)
            seen |= front
            if seen.all():
                break
            more = times(np.where(front, sigma, 0.0) * size)
            front = (more > 0) & ~seen
            sigma[front] = more[front]
        delta = np.zeros((g.k, len(s)))
        for far, near in zip(levels[:0:-1], levels[-2::-1], strict=True):
            share = np.divide((1 + delta) * size, sigma, out=np.zeros_like(delta), where=far)
            delta[near] = (sigma * times(share))[near]
        if levels:
            alone = np.where(g.inner[s], 0.0, (g.size[s] - 1) / np.maximum(g.links[s], 1))
            delta += levels[0] * alone
        out += delta @ g.size[s]
    return out


def _by_lists(g: _Part) -> np.ndarray:
    out = np.zeros(g.k)
    for s in range(g.k):
        dist, sigma, levels, front = np.full(g.k, -1), np.zeros(g.k), [], np.array([s])
        dist[s], sigma[s] = 0, 1.0
        weight = sigma  # of the source's class, the source alone
        while len(front):
            size = g.first[front + 1] - g.first[front]
            at = np.repeat(g.first[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            x, y = np.repeat(front, size), g.y[at]
            new = dist[y] < 0
            x, y = x[new], y[new]
            front, where = np.unique(y, return_inverse=True)
            dist[front] = len(levels) + 1
            sigma[front] = np.bincount(where, sigma[x] * (weight if not levels else g.size)[x], len(front))
            levels.append((x, y))
        delta = np.zeros(g.k)
        for x, y in reversed(levels):
            np.add.at(delta, x, g.size[y] * sigma[x] / sigma[y] * (1 + delta[y]))
        if g.size[s] > 1 and not g.inner[s]:
            delta[g.y[g.first[s] : g.first[s + 1]]] += (g.size[s] - 1) / g.links[s]
        delta[s] = 0
        out += delta * g.size[s]
    return out
