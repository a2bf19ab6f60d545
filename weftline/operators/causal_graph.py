"""Causal graph search (PC): a matrix from Spark, the search on the driver over at most a few hundred nodes."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np


class Pdag:
    """Nodes with directed (u, v) and undirected (u < v) edges."""

    def __init__(self, nodes, directed=(), undirected=()):
        self.nodes = sorted(nodes)
        self.directed, self.undirected = set(directed), {tuple(sorted(e)) for e in undirected}

    def adjacent(self, u) -> set:
        return {v for v in self.nodes if v != u and self.linked(u, v)}

    def linked(self, u, v) -> bool:
        return (u, v) in self.directed or (v, u) in self.directed or tuple(sorted((u, v))) in self.undirected

    def orient(self, u, v) -> bool:
        e = tuple(sorted((u, v)))
        if e not in self.undirected:
            return False
        self.undirected.discard(e)
        self.directed.add((u, v))
        return True

    def parents(self, v) -> set:
        return {u for u, w in self.directed if w == v}


def independence(corr: np.ndarray, n: int, alpha: float = 0.01):
    """Test of (i, j | given) by Fisher's z of the partial correlation; remembered by arguments."""

    @lru_cache(maxsize=None)
    def test(i: int, j: int, given: tuple[int, ...]) -> bool:
        sub = corr[np.ix_([i, j, *given], [i, j, *given])]
        try:
            p = np.linalg.inv(sub)
        except np.linalg.LinAlgError:
            p = np.linalg.pinv(sub)
        r = float(np.clip(-p[0, 1] / math.sqrt(max(p[0, 0] * p[1, 1], 1e-300)), -0.999999, 0.999999))
        dof = n - len(given) - 3
        if dof <= 0:
            return True
        z = math.sqrt(dof) * abs(math.atanh(r))
        return math.erfc(z / math.sqrt(2)) > alpha

    return test


def skeleton(corr: np.ndarray, n: int, alpha: float = 0.01, most: int = 3) -> tuple[set, dict]:
    """Edges that no conditioning set of up to most neighbours removes; separating sets of the others."""
    k, test = len(corr), independence(corr, n, alpha)
    near = {i: set(range(k)) - {i} for i in range(k)}
    apart: dict[tuple[int, int], tuple[int, ...]] = {}
    for size in range(most + 1):
        before = {i: set(v) for i, v in near.items()}
        for i, j in combinations(range(k), 2):
            if j not in near[i]:
                continue
            # sets that both sides share come first: they separate most often
            both = sorted((before[i] | before[j]) - {i, j}, key=lambda v: (-(v in before[i]) - (v in before[j]), v))
            for given in combinations(both, size):
                inside = set(given)
                if not (inside <= before[i] or inside <= before[j]):
                    continue
                if test(i, j, tuple(sorted(given))):
                    near[i].discard(j)
                    near[j].discard(i)
                    apart[i, j] = given
                    break
    return {(i, j) for i in near for j in near[i] if i < j}, apart


def meek(g: Pdag) -> Pdag:
    """Orientations that follow from the ones there are (four rules), to the end."""
    moved = True
    while moved:
        moved = False
        for e in sorted(g.undirected):
            for u, v in (e, e[::-1]):
                if tuple(sorted((u, v))) not in g.undirected:
                    break
                up, down = g.parents(u), {w for x, w in g.directed if x == u}
                one = any(not g.linked(w, v) for w in up)
                two = bool(down & g.parents(v))
                side = [w for w in g.nodes if tuple(sorted((u, w))) in g.undirected and w != v]
                three = any(c in g.parents(v) and d in g.parents(v) and not g.linked(c, d) for c, d in combinations(side, 2))
                four = any(
                    c in g.parents(d) and d in g.parents(v) and not g.linked(c, v)
                    for c in side for d in g.nodes if g.linked(u, d) and d != v
                )
                if (one or two or three or four) and g.orient(u, v):
                    moved = True
                    break
    return g


def pc(names: list[str], corr: np.ndarray, n: int, alpha: float = 0.01, most: int = 3, least: int = 30) -> Pdag:
    """The PC algorithm; with fewer than least rows no edge is claimed."""
    if n < least:
        return Pdag(names)
    edges, apart = skeleton(corr, n, alpha, most)
    g = Pdag(range(len(names)), (), edges)
    for j in g.nodes:
        for i, k in combinations(sorted(g.adjacent(j)), 2):
            if not g.linked(i, k) and j not in apart.get((i, k), ()):
                for x in (i, k):
                    if (j, x) not in g.directed:
                        g.orient(x, j)
    g = meek(g)
    return Pdag(names, {(names[u], names[v]) for u, v in g.directed}, {(names[u], names[v]) for u, v in g.undirected})


def intervene(g: Pdag, source) -> tuple[Pdag, list]:
    """Edges at an intervened node point away from it; a neighbour that points at it is a conflict."""
    conflicts = []
    for v in sorted(g.adjacent(source)):
        if (v, source) in g.directed:
            conflicts.append(v)
        else:
            g.orient(source, v)
    return meek(g), conflicts
