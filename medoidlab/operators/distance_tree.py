"""Sums of great-circle distances from many places to many others, without all pairs.

Places are held in a tree of cells. Seen from a cell that lies well apart, the distance is
a smooth function of the place, so a polynomial through its values at a few nodes stands
for a cell's places, and sums over pairs of cells become sums over pairs of nodes. Pairs of
cells that do not lie well apart are split until they do, or summed place by place; no
place is left out. The number of nodes and the gap that ``APART`` asks for keep the error
of a sum near the size of its rounding: 1e-13 of it as a rule, below 1e-10 of it where
nearly all places share one cell at just that gap.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from numpy.polynomial.chebyshev import chebvander

from medoidlab.operators.kernels import SERIES, arc_length, haversine_a, unit_vectors

# Nodes along each side of a cell.
NODES = 14
# Two cells lie well apart if their middles are farther from each other than so many times
# the sum of their radii.
APART = 2.0
# Places of a cell that is not split further.
LEAF = 256
# Least half side of a cell (some micrometres), and the largest one of a cell that is
# narrow: the plane that its nodes are laid out in still follows the sphere.
MIN_HALF, MAX_HALF = 1e-12, 0.4
# Bits of a place's number along each side of the map.
MAP_BITS = 26

# One more value for near places (2 km).
_SERIES = [*SERIES, (3e-8, (1 / 6, 1.0))]
_AT = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
# Takes the Chebyshev polynomials at a point to the weights of the nodes there.
_TO_NODES = np.where(np.arange(NODES) > 0, 2.0, 1.0)[:, None] * chebvander(_AT, NODES - 1).T / NODES
_GRID = np.stack(np.meshgrid(_AT, _AT, indexing="ij"), axis=-1).reshape(-1, 2)
_CORNERS = np.array([(-1.0, -1.0), (-1.0, 1.0), (1.0, -1.0), (1.0, 1.0)])
_NONE = np.zeros((0, 3))


class Map:
    """Numbers places along a Z-shaped curve over their box in degrees, so that each square
    of a quadtree over the box is a range of numbers."""

    def __init__(self, lon, lat):
        """``lon`` and ``lat`` are (least, largest)."""
        self.low = lon[0], lat[0]
        shrink = max(float(np.cos(np.radians((lat[0] + lat[1]) / 2))), 0.01)
        side = max((lon[1] - lon[0]) * shrink, lat[1] - lat[0]) or 1.0
        self.scale = 2.0**MAP_BITS / side * shrink, 2.0**MAP_BITS / side

    def codes(self, lon, lat):
        return self._code(lon, 0) | self._code(lat, 1) << 1

    def _code(self, values, side):
        x = ((values - self.low[side]) * self.scale[side]).astype(np.int64).clip(0, 2**MAP_BITS - 1)
        for by in (16, 8, 4, 2, 1):  # bits apart, one zero after each
            x = (x | x << by) & sum(((1 << by) - 1) << at for at in range(0, 62, 2 * by))
        return x


class Box:
    """A rectangle around unit vectors, in the plane that touches the sphere near them. Cells
    too wide for that have no nodes and an endless radius."""

    def __init__(self, vectors):
        self.center, self.radius, self.narrow = np.array([0.0, 0.0, 1.0]), np.inf, False
        middle = (vectors.min(axis=0) + vectors.max(axis=0)) / 2 if len(vectors) else np.zeros(3)
        length = float(np.linalg.norm(middle))
        if length < 0.5:
            return
        up = middle / length
        side = np.array([-up[1], up[0], 0.0])
        if np.linalg.norm(side) < 1e-6:  # a pole
            side = np.array([1.0, 0.0, 0.0]) - up[0] * up
        side /= np.linalg.norm(side)
        self.axes = np.stack([side, np.cross(up, side), up])
        flat = vectors @ self.axes[:2].T
        low, high = flat.min(axis=0), flat.max(axis=0)
        self.mid, self.half = (low + high) / 2, np.maximum((high - low) / 2, MIN_HALF)
        if (np.abs(self.mid) + self.half).max() < MAX_HALF:
            self.narrow, self.center = True, self._at(np.zeros((1, 2)))[0]
            self.radius = float(np.sqrt(((self.corners() - self.center) ** 2).sum(axis=1).max()))

    def _at(self, grid):
        """Unit vectors at places of the rectangle, whose sides run from -1 to 1."""
        flat = self.mid + grid * self.half
        return np.column_stack([flat, np.sqrt(1.0 - (flat * flat).sum(axis=1))]) @ self.axes

    def corners(self):
        return self._at(_CORNERS)

    @cached_property
    def nodes(self):
        return self._at(_GRID)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "nodes"}

    def _shares(self, vectors):
        """The weights of the nodes along each side, at every vector."""
        x = (vectors @ self.axes[:2].T - self.mid) / self.half
        return [chebvander(x[:, i], NODES - 1) @ _TO_NODES for i in (0, 1)]

    def gather(self, vectors, weights):
        """Weights (vectors, clusters) moved to the nodes: (nodes, clusters)."""
        a, b = self._shares(vectors)
        return np.stack([((a * w[:, None]).T @ b).ravel() for w in weights.T], axis=1)

    def spread(self, values, vectors):
        """Values (nodes, clusters) taken to the vectors: (vectors, clusters)."""
        a, b = self._shares(vectors)
        return np.stack([((a @ v.reshape(NODES, NODES)) * b).sum(axis=1) for v in values.T], axis=1)


def apart(center, radius, centers, radii, by=APART):
    """Whether cells lie well apart from one, and from its opposite side of the globe (where
    the distance is not smooth either)."""
    gap = np.minimum(((centers - center) ** 2).sum(axis=-1), ((centers + center) ** 2).sum(axis=-1))
    return gap > (by * (radii + radius)) ** 2


class Tree:
    """Cells, each with its box, its parts and what stands for its places from afar:
    ``sources`` has vectors (none: the box's nodes), clusters and weights (vectors,
    clusters). The places themselves are kept as rows of ``vectors``, ``own`` and ``w``,
    for cells that are not split and whose places are here."""

    def __init__(self, clusters):
        self.clusters = clusters
        self.boxes, self.parts, self.sources, self.rows = [], [], [], []

    def copy(self):
        """A tree that can be added to, over the same cells."""
        other = Tree(self.clusters)
        for name in ("boxes", "parts", "sources", "rows"):
            setattr(other, name, list(getattr(self, name)))
        return other

    def add(self, box, parts, sources, rows=None):
        for kept, value in zip((self.boxes, self.parts, self.sources, self.rows), (box, parts, sources, rows)):
            kept.append(value)
        return len(self.boxes) - 1

    def fill(self, cell, rows):
        """Gives a cell that is known from afar its places, and its parts."""
        self.grow(rows, known=True)
        for kept in (self.boxes, self.sources):
            kept.pop()
        for kept in (self.parts, self.rows):
            kept[cell] = kept.pop()

    def hold(self, lon, lat, own, w):
        """The places that cells are grown over, with cluster and weight."""
        self.vectors, self.w = unit_vectors(lon, lat), w.astype(np.float64)
        self.own = np.searchsorted(self.clusters, own)

    def dense(self, i):
        """Vectors and weights (vectors, all clusters) that stand for a cell."""
        vectors, clusters, weights = self.sources[i]
        vectors = self.boxes[i].nodes if vectors is None else vectors
        out = np.zeros((len(vectors), len(self.clusters)))
        out[:, clusters] = weights
        return vectors, out

    def box_over(self, parts, vectors=_NONE):
        """The box around vectors and the boxes of ``parts``: too wide if one of them is."""
        if not all(self.boxes[i].narrow for i in parts):
            return Box(_NONE)
        return Box(np.concatenate([vectors, *[self.boxes[i].corners() for i in parts]]))

    def join(self, parts):
        """The cell over others, in whose place their sources are gathered."""
        box, sources = self.box_over(parts), None
        if box.narrow:
            vectors, weights = (np.concatenate(x) for x in zip(*(self.dense(i) for i in parts)))
            clusters = np.flatnonzero(weights.any(axis=0))
            sources = None, clusters, box.gather(vectors, weights[:, clusters])
        return self.add(box, parts, sources)

    def grow(self, rows, known=False):
        """The cell over places, split in halves along the longest side; without box and
        sources if they are ``known``."""
        vectors, parts = self.vectors[rows], []
        if len(rows) > LEAF:
            order = rows[np.argsort(vectors[:, np.argmax(np.ptp(vectors, axis=0))], kind="stable")]
            parts = [self.grow(half) for half in np.array_split(order, 2)]
        if known:
            return self.add(None, parts, None, None if parts else rows)
        box, sources = self.box_over(parts, vectors), None
        if box.narrow:
            clusters, at = np.unique(self.own[rows], return_inverse=True)
            weights = np.zeros((len(rows), len(clusters)))
            weights[np.arange(len(rows)), at] = self.w[rows]
            few = len(rows) <= NODES**2
            sources = (vectors, clusters, weights) if few else (None, clusters, box.gather(vectors, weights))
        return self.add(box, parts, sources, None if parts else rows)


class Sums:
    """Sums of distances from places of a tree to all of its places, by cluster."""

    def __init__(self, tree, chunk):
        """``chunk``: rows and columns of the distances held at a time."""
        self.tree, self.chunk = tree, chunk
        self.held = np.empty((2, chunk[0] * max(chunk[1], NODES**2)))
        self.centers = np.array([b.center for b in tree.boxes])
        self.radii = np.array([b.radius for b in tree.boxes])
        self.split = np.array([len(p) > 0 for p in tree.parts])
        self.out = np.zeros((len(tree.vectors), len(tree.clusters)))

    def _far(self, cells):
        """Vectors and weights that stand for cells, about a chunk's columns at a time."""
        step = max(1, self.chunk[1] // NODES**2)
        for i in range(0, len(cells), step):
            yield tuple(np.concatenate(x) for x in zip(*(self.tree.dense(c) for c in cells[i : i + step])))

    def _near(self, cells):
        """Vectors and weights of the places of cells, a chunk's columns at a time."""
        # A cell kept until here without its places would be an error, not a smaller sum.
        rows = np.concatenate([self.tree.rows[c] for c in cells])
        for i in range(0, len(rows), self.chunk[1]):
            some = rows[i : i + self.chunk[1]]
            weights = np.zeros((len(some), len(self.tree.clusters)))
            weights[np.arange(len(some)), self.tree.own[some]] = self.tree.w[some]
            yield self.tree.vectors[some], weights

    def _add(self, to, at, parts, center=None):
        """Add the weighted distances from vectors ``at`` to ``parts`` (vectors, weights) to
        ``to``. With a ``center`` near ``at`` they come from products, right for vectors
        that lie apart."""
        if center is not None:
            # |x - y|^2 = |x|^2 + |y|^2 - 2 x y
            at = 0.5 * (at - center)
            at = np.column_stack([at, (at * at).sum(axis=1), np.ones(len(at))])
        for v, w in parts:
            if center is not None:
                v = 0.5 * (v - center)
                v = np.column_stack([-2.0 * v, np.ones(len(v)), (v * v).sum(axis=1)])
            for i in range(0, len(at), self.chunk[0]):
                some = at[i : i + self.chunk[0]]
                a, scratch = self.held[:, : len(some) * len(v)].reshape(2, len(some), len(v))
                a = haversine_a(some, v, a, scratch) if center is None else np.matmul(some, v.T, out=a)
                to[i : i + len(some)] += arc_length(a, scratch, _SERIES) @ w

    def run(self, cell, near, values=None):
        """Sums of the places of ``cell``: ``near`` are the cells not met so far, ``values``
        the sums of those met, at the nodes of the box."""
        tree, box, near = self.tree, self.tree.boxes[cell], np.asarray(near, np.int64)
        final, far, kept = not self.split[cell], [], []
        while len(near):
            met = apart(box.center, box.radius, self.centers[near], self.radii[near])
            far.append(near[met])
            near = near[~met]
            opened = self.split[near] & (final | (self.radii[near] > box.radius))
            kept.append(near[~opened])
            near = np.array([p for i in near[opened] for p in tree.parts[i]], np.int64)
        far, kept = np.concatenate(far), np.concatenate(kept)
        if len(far):
            values = np.zeros((NODES**2, len(tree.clusters))) if values is None else values
            self._add(values, box.nodes, self._far(far), box.center)
        if not final:
            for part in tree.parts[cell]:
                # Only narrow cells have values, and their parts are narrow.
                self.run(part, kept, None if values is None else box.spread(values, tree.boxes[part].nodes))
            return
        rows = tree.rows[cell]
        to = np.zeros((len(rows), len(tree.clusters))) if values is None else box.spread(values, tree.vectors[rows])
        self._add(to, tree.vectors[rows], self._near(kept))
        self.out[rows] = to
