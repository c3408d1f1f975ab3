"""Vectorised per-bucket search code, run inside ``applyInPandas`` tasks.

A bucket arrives as distinct places with weights (how many rows sit on the place)
and an id (the smallest row id on it). Distances between places are haversine
metres, computed in blocks so memory stays at ``block x places`` doubles.
"""

from __future__ import annotations

import hashlib

import numpy as np

from medoidlab.schema import EARTH_RADIUS_M

# Distances held at once while swaps are costed (1 MB: they stay in a core's cache).
BLOCK_CELLS = 1 << 17
# Candidates of one group of carried bounds: so many, or more where groups times places
# would exceed the second value (looser bounds, the same swaps).
CANDIDATE_GROUP = 48
BOUND_CELLS = 1 << 23
# Candidates costed before the first bound is known; every further lot is twice as large.
FIRST_CANDIDATES = 64
# Metres taken from lower bounds a round, above what rounding can add to them.
BOUND_SLACK = 1e-3
# Up to these values of ``a`` (distances of 127 and 46 km) so many terms of arcsin's series
# are exact in double precision.
SERIES = [(1e-4, (15 / 336, 3 / 40, 1 / 6, 1.0)), (1.3e-5, (3 / 40, 1 / 6, 1.0))]
# A swap must lower phi by more than this many metres to count as an improvement.
IMPROVE_TOL = 1e-6


def haversine_np(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS_M):
    """Same formula and order of operations as the Spark column expression."""
    dlat = np.radians(lat2 - lat1)
    dlon = np.radians(lon2 - lon1)
    a = np.sin(dlat / 2) * np.sin(dlat / 2) + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(
        dlon / 2
    ) * np.sin(dlon / 2)
    a = np.clip(a, 0.0, 1.0)
    return radius * (2.0 * np.arctan2(np.sqrt(a), np.sqrt(1.0 - a)))


def unit_vectors(lon, lat):
    """(n, 3) unit vectors of lon/lat degrees."""
    phi = np.radians(lat)
    lam = np.radians(lon)
    c = np.cos(phi)
    return np.stack([c * np.cos(lam), c * np.sin(lam), np.sin(phi)], axis=1)


def chord_distance(u, v, radius: float = EARTH_RADIUS_M, out=None, diff=None):
    """Pairwise great-circle metres between unit vectors u (n, 3) and v (m, 3), in ``out``
    and with the scratch ``diff``, both (n, m), if given.

    ``a = |u - v|^2 / 4`` is the haversine ``a`` (same value, about 1e-12 relative), so
    the distance needs one sqrt and one arcsin per pair instead of the full formula.
    """
    a = np.empty((len(u), len(v))) if out is None else out
    diff = np.empty_like(a) if diff is None else diff
    return arc_length(haversine_a(u, v, a, diff), diff, SERIES, radius)


def haversine_a(u, v, out, scratch):
    """``|u - v|^2 / 4`` of each pair, in ``out``."""
    u, v = 0.5 * u, 0.5 * v.T
    a = np.subtract(u[:, 0:1], v[0], out=out)
    a *= a
    for j in (1, 2):
        np.subtract(u[:, j : j + 1], v[j], out=scratch)
        scratch *= scratch
        a += scratch
    return a


def arc_length(a, scratch, series, radius: float = EARTH_RADIUS_M):
    """Metres on the sphere of haversine ``a``, in place; ``series`` is like ``SERIES``."""
    top = a.max(initial=0.0)
    if top > series[0][0]:
        np.minimum(a, 1.0, out=a)
        np.sqrt(a, out=a)
        np.arcsin(a, out=a)
        a *= 2.0 * radius
        return a
    # arcsin(x) = x (1 + x^2 / 6 + 3 x^4 / 40 + 15 x^6 / 336 + ...), far cheaper.
    terms = next(t for most, t in reversed(series) if top <= most)
    factor = np.multiply(a, 2.0 * radius * terms[0], out=scratch)
    for c in terms[1:-1]:
        factor += 2.0 * radius * c
        factor *= a
    factor += 2.0 * radius * terms[-1]
    np.sqrt(a, out=a)
    a *= factor
    return a


def dist_cols(lon, lat, idx):
    """Distances from every place to the places ``idx``: shape (u, len(idx))."""
    idx = np.asarray(idx, dtype=np.int64)
    return haversine_np(lon[:, None], lat[:, None], lon[idx][None, :], lat[idx][None, :])


def nearest_two(dm):
    """(d1, d2, nearest slot) per row of a (u, k) distance matrix; ties to the lower slot."""
    k = dm.shape[1]
    order = np.argsort(dm, axis=1, kind="stable")
    rows = np.arange(dm.shape[0])
    d1 = dm[rows, order[:, 0]]
    d2 = dm[rows, order[:, 1]] if k > 1 else np.full(dm.shape[0], np.inf)
    return d1, d2, order[:, 0]


class Swaps:
    """Costs of single swaps from ``medoids``: phi after putting a candidate in a slot.

    With the candidate added and no slot removed, place p costs ``min(d(p, c), d1)``;
    removing its own nearest slot makes that ``min(d(p, c), d2)``. So one pass over the
    distances gives the shared sum, and per slot the loss of the places nearest to it: the
    work does not grow with k. Distances are made for a few candidates at a time and never
    kept: memory grows with the places, not with their square.
    """

    def __init__(self, vectors, w, medoids):
        self.vectors, self.k = vectors, len(medoids)
        d1, d2, near = nearest_two(chord_distance(self.vectors, self.vectors[medoids]))
        self.phi = float((w * d1).sum())
        self.order = order = np.argsort(near, kind="stable")
        self.slots, self.first = np.unique(near[order], return_index=True)
        self.places, self.w = self.vectors[order], w[order]
        self.weighted = bool((w != 1.0).any())
        self.d1, self.d2 = (w * d1)[order], (w * d2)[order]

    def costs(self, cand):
        """Array (len(cand), k)."""
        out = np.empty((len(cand), self.k))
        rows = max(1, BLOCK_CELLS // max(1, len(self.w)))
        held = np.empty((2, min(rows, len(cand)), len(self.w)))
        for i in range(0, len(cand), rows):
            d, kept = held[:, : len(cand) - i]
            chord_distance(self.vectors[cand[i : i + rows]], self.places, out=d, diff=kept)
            if self.weighted:
                d *= self.w
            np.minimum(d, self.d1, out=kept)
            np.minimum(d, self.d2, out=d)
            d -= kept
            out[i : i + rows] = kept.sum(axis=1)[:, None]
            out[i : i + rows, self.slots] += np.add.reduceat(d, self.first, axis=1)
        return out

    def limits(self):
        """Array (k, places): what a place costs at most once a slot is free, ``d1``, in its
        own nearest slot ``d2``."""
        out = np.empty((self.k, len(self.w)))
        out[:, self.order] = self.d1
        ends = np.append(self.first[1:], len(self.w))
        for slot, a, b in zip(self.slots, self.first, ends):
            out[slot, self.order[a:b]] = self.d2[a:b]
        return out


def swap_costs(lon, lat, w, medoids, cand=None):
    """phi after putting each candidate in each slot, array (len(cand), k), and phi now."""
    swaps = Swaps(unit_vectors(lon, lat), w, np.asarray(medoids, dtype=np.int64))
    return swaps.costs(np.arange(lon.shape[0]) if cand is None else cand), swaps.phi


class BestSwap:
    """Best single swaps of one bucket, for changing medoids.

    A candidate's cost in a slot is a sum of ``min(d, limit)`` over the places, and a change
    of the medoids changes the limits only. What that does to the cost at least follows
    from the distances to a middle candidate, for all candidates around it. So costs of
    earlier rounds and those changes are lower bounds, and a candidate whose bounds are all
    above the least cost known is not costed again. No candidate of least cost is left out,
    and bounds are never taken for costs.
    """

    def __init__(self, lon, lat, w, ids):
        self.vectors, self.w, self.ids = unit_vectors(lon, lat), w, ids
        self.bounds = self.limits = self.near = None

    def _near_and_far(self):
        """The candidates in compact groups, and per group and place the least and the
        largest weighted distance."""
        size = max(CANDIDATE_GROUP, -(-2 * len(self.w) ** 2 // BOUND_CELLS))
        self.group = _groups(self.vectors, size)
        n = int(self.group.max()) + 1
        order = np.argsort(self.group, kind="stable")
        first = np.searchsorted(self.group[order], np.arange(n))
        mean = np.add.reduceat(self.vectors[order], first, axis=0) / np.bincount(self.group)[:, None]
        length = np.linalg.norm(mean, axis=1)[:, None]
        middle = np.where(length > 0.5, mean / np.maximum(length, 0.5), self.vectors[order[first]])
        gap = self.vectors - middle[self.group]
        chord = np.sqrt(np.maximum.reduceat((gap * gap).sum(axis=1)[order], first))
        radius = 2.0 * EARTH_RADIUS_M * np.arcsin(np.minimum(chord / 2, 1.0)) + BOUND_SLACK
        d = chord_distance(middle, self.vectors)
        return np.maximum(d - radius[:, None], 0.0) * self.w, (d + radius[:, None]) * self.w

    def _carry(self, limits):
        """Bounds of the last round taken to new limits."""
        if self.near is None:
            self.near, self.far = self._near_and_far()
        for slot, (old, new) in enumerate(zip(self.limits, limits)):
            up, down = np.flatnonzero(new > old), np.flatnonzero(new < old)
            change = -np.full(len(self.near), BOUND_SLACK)
            for at, d in ((up, self.near[:, up]), (down, self.far[:, down])):
                change += (np.minimum(d, new[at]) - np.minimum(d, old[at])).sum(axis=1)
            self.bounds[:, slot] += change[self.group]

    def find(self, medoids):
        """(phi_now, phi_new, cand index, slot), ties by (phi, id, slot)."""
        medoids = np.asarray(medoids, dtype=np.int64)
        swaps = Swaps(self.vectors, self.w, medoids)
        limits = swaps.limits()
        if self.bounds is None:
            self.bounds = np.full((len(self.w), swaps.k), -np.inf)
        else:
            self._carry(limits)
        self.limits = limits
        least = self.bounds.min(axis=1)
        least[medoids] = np.inf  # last in the order, and no candidates
        known, best_at = np.inf, np.zeros(0, np.int64)
        costs = np.zeros((0, swaps.k))
        order = np.argsort(least, kind="stable")[: len(least) - len(medoids)]
        at, step = 0, FIRST_CANDIDATES
        while at < len(order):
            cand = order[at : at + step]
            cand = cand[least[cand] <= known]
            if not len(cand):
                break
            new = swaps.costs(cand)
            self.bounds[cand] = new
            known = min(known, float(new.min()))
            best_at, costs = np.concatenate([best_at, cand]), np.concatenate([costs, new])
            at, step = at + step, 2 * step
        self.bounds[medoids] = -np.inf
        best = costs.min(initial=np.inf)
        if not np.isfinite(best):
            return swaps.phi, best, -1, -1
        rows, slots = np.nonzero(costs == best)
        cands = best_at[rows]
        j = np.lexsort((slots, self.ids[cands]))[0]
        return swaps.phi, float(best), int(cands[j]), int(slots[j])


def _groups(vectors, size):
    """Group numbers of compact groups of about ``size`` vectors: halves along the longest
    side, again and again."""
    group = np.zeros(len(vectors), np.int64)
    parts, n = [np.arange(len(vectors))], 1
    while len(vectors) > size * n:
        halves = []
        for part in parts:
            side = int(np.argmax(np.ptp(vectors[part], axis=0)))
            by = part[np.argsort(vectors[part, side], kind="stable")]
            halves += [by[: len(by) // 2], by[len(by) // 2 :]]
        parts, n = halves, 2 * n
    for number, part in enumerate(parts):
        group[part] = number
    return group


def best_swap(lon, lat, w, ids, medoids):
    """Best single swap: (phi_now, phi_new, cand index, slot), ties by (phi, id, slot)."""
    return BestSwap(lon, lat, w, ids).find(medoids)


def first_distinct(ids, k):
    """Indices of the first k places in id order (places are already distinct)."""
    order = np.argsort(ids, kind="stable")
    return order[:k] if len(order) >= k else None


def pam_search(lon, lat, w, ids, k):
    """Steepest-descent PAM from the first k places in id order.

    Returns (medoid indices, phi, rounds) or None when there are fewer than k places.
    """
    med = first_distinct(ids, k)
    if med is None:
        return None
    med = med.copy()
    swaps = BestSwap(lon, lat, w, ids)
    rounds = 0
    phi = None
    while True:  # phi falls by IMPROVE_TOL at least each round, so this ends
        phi, new_phi, c, s = swaps.find(med)
        if c < 0 or not (new_phi < phi - IMPROVE_TOL):
            break
        med[s] = c
        rounds += 1
    if rounds:
        d1, _, _ = nearest_two(dist_cols(lon, lat, med))
        phi = float((w * d1).sum())
    return med, phi, rounds


def clarans_budget(k, mean_size, distinct=None):
    """Neighbours per round: max(k(m-k)/100, 8m/100), at least 1, at most distinct-k."""
    m = int(mean_size)
    nb = max((k * (m - k)) // 100, (8 * m) // 100)
    if distinct is not None:
        nb = min(nb, max(distinct - k, 1))
    return max(1, nb)


def _closest_pair(lon, lat, med):
    dm = dist_cols(lon, lat, med)[med, :]
    k = len(med)
    best = (np.inf, 0, 1 if k > 1 else 0)
    for i in range(k):
        for j in range(i + 1, k):
            if dm[i, j] < best[0]:
                best = (dm[i, j], i, j)
    return best[1], best[2]


# Fixed value: the prime below 2^31 over which draw orders are computed, so that a product
# of two residues fits a signed 64-bit integer in every engine.
DRAW_PRIME = 2147483647


def draw_params(seed, bucket, start, rnd):
    """(a1, b1, a2, b2) of one round: a place with draw value h comes at
    ``(a1 h + b1) mod p`` in the round's order, and its coin is ``(a2 h + b2) mod p mod 2``.
    A counter and a hash instead of generator state, so any engine can repeat the draws."""
    digest = hashlib.md5(f"{seed}|{bucket}|{start}|{rnd}".encode()).hexdigest()
    w = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    return 1 + w[0] % (DRAW_PRIME - 1), w[1] % DRAW_PRIME, 1 + w[2] % (DRAW_PRIME - 1), w[3] % DRAW_PRIME


def clarans_search(lon, lat, w, ids, h, k, nlocal, nneighbor, seed, bucket):
    """CLARANS over distinct places with draw values ``h``: ``nlocal`` random starts, best
    improving neighbour per round among the first ``nneighbor`` non-centre places of the
    round's order; a candidate replaces one of the two closest centres, by coin. Returns
    (medoid indices in id order, phi).
    """
    u = lon.shape[0]
    if u < k:
        return None
    if k < 2:
        raise ValueError("CLARANS needs k >= 2")
    nneighbor = max(1, min(nneighbor, u - k))
    vectors = unit_vectors(lon, lat)
    h = h.astype(np.int64) % DRAW_PRIME
    best = None
    for start in range(nlocal):
        a, b, _, _ = draw_params(seed, bucket, start, 0)
        drawn = np.lexsort((ids, (a * h + b) % DRAW_PRIME))[:k]
        med = drawn[np.argsort(ids[drawn])]
        d1, _, _ = nearest_two(dist_cols(lon, lat, med))
        phi, rnd = float((w * d1).sum()), 0
        while True:  # phi falls by IMPROVE_TOL at least each round, so this ends
            rnd += 1
            a, b, a2, b2 = draw_params(seed, bucket, start, rnd)
            pool = np.ones(u, dtype=bool)
            pool[med] = False
            order = np.lexsort((ids, (a * h + b) % DRAW_PRIME))
            cand = order[pool[order]][:nneighbor]
            slots = np.array(_closest_pair(lon, lat, med))[((a2 * h[cand] + b2) % DRAW_PRIME) % 2]
            phi_n = Swaps(vectors, w, med).costs(cand)[np.arange(len(cand)), slots]
            j = int(np.argmin(phi_n))
            if not phi_n[j] < phi - IMPROVE_TOL:
                break
            med = med.copy()
            med[slots[j]] = cand[j]
            phi = float(phi_n[j])
        if best is None or phi < best[1]:
            best = med, phi
    med, phi = best
    return med[np.argsort(ids[med])], phi
