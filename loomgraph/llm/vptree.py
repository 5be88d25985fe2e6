"""Vantage-point trees over unit vectors, searched in batches.

The distance is the angle, a metric, so the triangle inequality holds: if a query is at angle d from a vantage point
whose ball has the radius mu, points inside can be within tau of the query only if d - tau <= mu, points outside only if
d + tau > mu. With a factor f the bound tau is taken as tau / f: one restores exact search; a larger one prunes more, as
in many dimensions a neighbour's offset hardly ever points straight at the vantage point.
"""

from __future__ import annotations

import contextlib
import sys
from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Inner nodes as arrays; a child below 0 is leaf ~child. order lists the points leaf by leaf."""

    vantage: np.ndarray
    mu: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    ends: np.ndarray
    order: np.ndarray
    root: int


def angle(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ v, -1.0, 1.0))


def _split(points: np.ndarray, idx: np.ndarray, least: int, rng: np.random.Generator, margin: float) -> tuple[np.ndarray, np.float32]:
    """A vantage point and radius that few points lie near. Of several candidates and radii the pair is taken that has the
    fewest points within `margin` of the ball's surface, against those in the smaller part (of `least` points or more):
    in clustered data a ball around a cluster, elsewhere about the median."""
    probe = points[rng.choice(idx, min(len(idx), 2048), replace=False)]
    candidates = points[rng.choice(idx, min(len(idx), 16), replace=False)]
    d = np.sort(np.arccos(np.clip(probe @ candidates.T, -1, 1)), axis=0)
    n = len(probe)
    part = min(n // 2, max(1, n // 200, -(-least * n // len(idx))))
    at = np.unique(np.linspace(max(1, part), max(1, n - part), 64).astype(int))
    best = (np.inf, 0, np.float32(0))
    for j in range(len(candidates)):
        mu = (d[at - 1, j] + d[np.minimum(at, n - 1), j]) / 2
        straddle = np.searchsorted(d[:, j], mu + margin) - np.searchsorted(d[:, j], mu - margin)
        score = (straddle + 1) / np.minimum(at, n - at)
        i = int(np.argmin(score))
        best = min(best, (float(score[i]), j, np.float32(mu[i])))
    return candidates[best[1]], best[2]


def build(points: np.ndarray, leaf: int, seed: int = 7, margin: float = 0.1) -> Tree:
    """A tree whose leaves hold at most `leaf` points, or more where they can't be told apart."""
    rng = np.random.default_rng(seed)
    vantage, mu, inside, outside, sizes, order = [], [], [], [], [], []

    def grow(idx: np.ndarray) -> int:
        if len(idx) > leaf:
            v, m = _split(points, idx, max(1, leaf // 4), rng, margin)
            d = angle(points[idx], v)
            near = d <= m
            if near.all() or not near.any():
                m = np.float32(np.median(d))
                near = d <= m
                if near.all():
                    m = np.nextafter(m, np.float32(-1))
                    near = d <= m
            if near.any():
                at = len(mu)
                vantage.append(v), mu.append(m), inside.append(0), outside.append(0)
                a, b = grow(idx[near]), grow(idx[~near])
                inside[at], outside[at] = a, b
                return at
        sizes.append(len(idx))
        order.append(idx)
        return ~(len(sizes) - 1)

    with _deep():
        root = grow(np.arange(len(points)))
    width = points.shape[1]
    return Tree(
        np.array(vantage, np.float32).reshape(-1, width), np.array(mu, np.float32), np.array(inside, np.int32), np.array(outside, np.int32),
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.concatenate(order) if order else np.empty(0, np.int64), root,
    )


@contextlib.contextmanager
def _deep():
    """A tree of balls around clusters can be as deep as it has leaves."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 20_000))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def home(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf that each vector belongs to."""
    out = np.zeros(len(x), np.int32)

    def go(node: int, idx: np.ndarray) -> None:
        if not len(idx):
            return
        if node < 0:
            out[idx] = ~node
            return
        near = angle(x[idx], tree.vantage[node]) <= tree.mu[node]
        go(tree.inside[node], idx[near])
        go(tree.outside[node], idx[~near])

    with _deep():
        go(tree.root, np.arange(len(x)))
    return out


def reached(tree: Tree, x: np.ndarray, tau: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, leaves): the leaves that may hold points within tau of each vector, under the relaxed bound."""
    rows, leaves = [], []

    def go(node: int, idx: np.ndarray) -> None:
        if not len(idx):
            return
        if node < 0:
            rows.append(idx)
            leaves.append(np.full(len(idx), ~node, np.int32))
            return
        d, t = angle(x[idx], tree.vantage[node]), tau[idx] / factor
        go(tree.inside[node], idx[d - t <= tree.mu[node]])
        go(tree.outside[node], idx[d + t > tree.mu[node]])

    with _deep():
        go(tree.root, np.arange(len(x)))
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.empty(0, np.int64), np.empty(0, np.int32))


class Best:
    """The k nearest found so far of each query: cosines in descending order, and the points' numbers (-1: none)."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None) -> None:
        self.cos = np.full((n, k), -2.0, np.float32)
        self.who = np.full((n, k), -1, np.int64)
        #: What a point must exceed to be of use.
        self.bar = np.full(n, -2.0, np.float32) if least is None else least.astype(np.float32)

    def offer(self, rows: np.ndarray, cos: np.ndarray, who: np.ndarray) -> None:
        """cos: a matrix of rows x points."""
        k = self.cos.shape[1]
        hit = cos > self.bar[rows, None]
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            return
        rows, cos = rows[some], np.where(hit[some], cos[some], np.float32(-2.0))
        if cos.shape[1] > k:
            top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            cos, who = np.take_along_axis(cos, top, 1), who[top]
        else:
            who = np.broadcast_to(who, cos.shape)
        cos, who = np.concatenate([self.cos[rows], cos], 1), np.concatenate([self.who[rows], np.where(cos > -2, who, -1)], 1)
        by = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        self.cos[rows], self.who[rows] = np.take_along_axis(cos, by, 1), np.take_along_axis(who, by, 1)
        self.bar[rows] = np.maximum(self.bar[rows], self.cos[rows, k - 1])


def search(tree: Tree, points: np.ndarray, x: np.ndarray, best: Best, factor: float, own: bool = False, batch: int = 1024) -> None:
    """Offers the points to the queries x. own: x are the points themselves, and a point isn't its own neighbour."""
    n = len(x)

    def go(node: int, idx: np.ndarray) -> None:
        if not len(idx):
            return
        if node < 0:
            members = tree.order[tree.ends[~node] : tree.ends[~node + 1]]
            p = points[members].T
            for i in range(0, len(idx), batch):
                q = idx[i : i + batch]
                c = x[q] @ p
                if own:
                    c[q[:, None] == members[None, :]] = -2.0
                best.offer(q, c, members)
            return
        v, mu = tree.vantage[node], tree.mu[node]
        d = angle(x[idx], v)
        near = d <= mu
        a, b = tree.inside[node], tree.outside[node]
        go(a, idx[near])
        go(b, idx[~near])
        # with fewer than k found, nothing is ruled out
        t = np.where(best.bar[idx] < -1.0, np.inf, np.arccos(np.clip(best.bar[idx], -1.0, 1.0)) / factor)
        go(b, idx[near & (d + t > mu)])
        go(a, idx[~near & (d - t <= mu)])

    with _deep():
        go(tree.root, np.arange(n))
