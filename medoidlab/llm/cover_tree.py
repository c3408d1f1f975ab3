"""Cover trees over integer vectors and dual-tree search for the largest inner products.

Every node is a point with a covering radius; all points below it lie within that radius.
The children of a node of radius R are points of its own, the node's point first (nesting),
more than R / BASE apart from each other (separation), such that every point below the node
is within R / BASE of one of them (covering); each point belongs to its nearest child. So
radii fall by BASE per level. A node with few points, or one that would need more than NET
children (points too evenly apart to be thinned out), is a leaf; leaves are large enough for
one matrix product to be worth more than further pruning. Besides its level's radius a node
keeps the distance of its farthest point, which bounds: for a query ball (centre q, radius
r) and a data ball (c, s) no pair scores more than  q.c + |q| s + |c| r + r s, so a pair of
nodes is pruned when that is below the worst k-th score of the queries in the ball.
"""

from __future__ import annotations

import numpy as np

LEAF, NET, BASE = 256, 48, 1.3
_SLACK = 1 + 1e-9


class Node:
    __slots__ = ("centre", "norm", "radius", "cover", "rows", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray, at: int, cover: float | None = None):
        self.rows = rows
        self.centre = points[at]
        self.norm = float(np.sqrt(self.centre @ self.centre))
        gaps = points[rows] - self.centre
        self.radius = float(np.sqrt((gaps * gaps).sum(axis=1).max())) * _SLACK
        self.cover = self.radius if cover is None else cover
        self.children: list[Node] = []


def build(points: np.ndarray, leaf: int = LEAF) -> Node:
    """Tree over float copies of the points; iterative, so depth is no limit."""
    middle = points.mean(axis=0)
    root = Node(points, np.arange(len(points)), int(((points - middle) ** 2).sum(axis=1).argmin()))
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.rows) <= leaf or node.radius == 0:
            continue
        # Levels at which the node's own point covers all it holds have one child: skip them.
        cover = node.cover / BASE
        while cover >= node.radius:
            cover /= BASE
        own = points[node.rows]
        gap = ((own - node.centre) ** 2).sum(axis=1)
        owner, centres = np.zeros(len(own), np.int64), [None]
        while len(centres) <= NET and gap.max() > cover * cover:
            far = int(gap.argmax())
            new = ((own - own[far]) ** 2).sum(axis=1)
            owner[new < gap] = len(centres)
            gap = np.minimum(gap, new)
            centres.append(int(node.rows[far]))
        if len(centres) > NET:
            continue
        for n, at in enumerate(centres):
            rows = node.rows[owner == n]
            if len(rows):
                child = Node(points, rows, int(rows[0]) if at is None else at, cover)
                if at is None:
                    child.centre, child.norm = node.centre, node.norm
                    child.radius = float(np.sqrt(((points[rows] - node.centre) ** 2).sum(axis=1).max())) * _SLACK
                node.children.append(child)
        todo += node.children
    return root


class Search:
    """Best ``k`` data rows of every query row but the one with its own uid; keeps
    (-score, id, uid) per query."""

    def __init__(self, queries, query_uids, data, data_ids, data_uids, k: int, floor: np.ndarray):
        self.qu, self.di, self.du, self.k = query_uids, data_ids, data_uids, k
        self.qf, self.df = queries.astype(np.float64), data.astype(np.float64)
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in query_uids]
        self.worst = floor.astype(np.float64).copy()

    def base(self, rows: np.ndarray, node: Node) -> None:
        """All products of some queries with a node's points."""
        scores = self.qf[rows] @ self.df[node.rows].T
        ids, uids = self.di[node.rows], self.du[node.rows]
        good = (scores >= self.worst[rows][:, None]) & (uids != self.qu[rows][:, None])
        for at in np.flatnonzero(good.any(axis=1)).tolist():
            i, some = int(rows[at]), np.flatnonzero(good[at])
            row = scores[at, some]
            if len(some) > self.k:
                cut = np.partition(row, len(row) - self.k)[len(row) - self.k]
                some, row = some[row >= cut], row[row >= cut]
            held = sorted(self.best[i] + list(zip((-row).tolist(), ids[some].tolist(), uids[some].tolist())))[: self.k]
            self.best[i] = held
            if len(held) == self.k:
                self.worst[i] = max(self.worst[i], -held[-1][0])

    def run(self, query_root: Node, data_root: Node) -> None:
        todo = [(query_root, data_root, np.inf)]
        while todo:
            q, d, bound = todo.pop()
            if bound < self.worst[q.rows].min():
                continue
            if d.children and (not q.children or d.radius >= q.radius):
                pairs = [(q, c) for c in d.children]
            elif q.children:
                pairs = [(c, d) for c in q.children]
            else:
                rows = q.rows[self.reach(q.rows, d) >= self.worst[q.rows]]
                if len(rows):
                    self.base(rows, d)
                continue
            scored = [
                (a, b, float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius + 1e-3)
                for a, b in pairs
            ]
            todo += sorted(scored, key=lambda p: p[2])

    def reach(self, rows: np.ndarray, d: Node) -> np.ndarray:
        """Largest score that each query can have with a point of the ball."""
        q = self.qf[rows]
        return q @ d.centre + np.sqrt((q * q).sum(axis=1)) * d.radius + 1e-3
