import random

import pytest
from conftest import hav

from medoidlab.operators import evaluate as EV
from medoidlab.operators.neighbors import nearest_neighbor
from medoidlab.schema import Box

CENTERS = [(-8.62, 41.14), (-8.55, 41.22), (-8.66, 41.26)]


def _rows(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        c = CENTERS[i % 3]
        out.append((i, round(c[0] + rnd.gauss(0, 0.01), 6), round(c[1] + rnd.gauss(0, 0.01), 6)))
    return out


def test_nearest_neighbor_brute_force(pts):
    rows = _rows(150, 1) + [(1000, -8.62, 41.14), (1001, -8.62, 41.14)]  # duplicate places
    probes = rows[:40] + [(2000, -8.9, 42.5), (2001, -8.0, 40.0)]  # far-away probes too
    got = {r.id: r.nn_dist for r in nearest_neighbor(pts(probes), pts(rows)).collect()}
    for pid, lon, lat in probes:
        ds = [hav(lon, lat, q[1], q[2]) for q in rows]
        want = min(d for d in ds if d > 0)
        assert abs(got[pid] - want) < 1e-6, pid


def test_nearest_neighbor_all_same_place(pts):
    rows = [(i, -8.6, 41.1) for i in range(5)]
    got = nearest_neighbor(pts(rows), pts(rows)).collect()
    assert all(r.nn_dist is None for r in got)


def _silhouette_brute(rows, centers, mode):
    lab = {}
    for i, lon, lat in rows:
        ds = [hav(lon, lat, c[0], c[1]) for c in centers]
        lab[i] = min(range(len(ds)), key=lambda j: (ds[j], j))
    size = {}
    for c in lab.values():
        size[c] = size.get(c, 0) + 1
    total = 0.0
    for i, lon, lat in rows:
        sums = {}
        for j, lo, la in rows:
            sums[lab[j]] = sums.get(lab[j], 0.0) + hav(lon, lat, lo, la)
        own = lab[i]
        if mode == "standard":
            if size[own] <= 1:
                continue
            a = sums[own] / (size[own] - 1)
            others = [sums[c] / size[c] for c in sums if c != own]
            b = min(others) if others else None
        else:
            a = sums[own] / size[own]
            others = [sums[c] for c in sums if c != own]
            b = min(others) / size[own] if others else None
        if b is None or max(a, b) == 0:
            continue
        total += (b - a) / max(a, b)
    return total / len(rows)


@pytest.mark.parametrize("mode", ["standard", "own_size"])
def test_silhouette_brute_force(pts, mode):
    rows = _rows(90, 2)
    got = EV.silhouette(pts(rows), CENTERS, mode=mode, block=32).collect()[0].silhouette
    assert abs(got - _silhouette_brute(rows, CENTERS, mode)) < 1e-9
    assert -1.0 <= got <= 1.0


def test_silhouette_singleton_cluster(pts):
    rows = _rows(30, 3) + [(99, -8.40, 41.40)]
    cs = CENTERS + [(-8.40, 41.40)]
    got = EV.silhouette(pts(rows), cs).collect()[0].silhouette
    assert abs(got - _silhouette_brute(rows, cs, "standard")) < 1e-9


def test_hopkins_lower_on_blobs_than_uniform(pts):
    rnd = random.Random(5)
    uni = [(i, -8.7 + 0.3 * rnd.random(), 41.0 + 0.3 * rnd.random()) for i in range(200)]
    blobs = _rows(200, 6)
    hu = EV.hopkins(pts(uni), seed=1).collect()[0].hopkins
    hb = EV.hopkins(pts(blobs), seed=1).collect()[0].hopkins
    assert 0.0 <= hb < hu <= 1.0
    assert 0.3 < hu < 0.7
    assert hb < 0.3


def test_hopkins_fixed_box_too_tall(pts):
    rnd = random.Random(8)
    uni = [(i, -8.7 + 0.3 * rnd.random(), 41.0 + 0.35 * rnd.random()) for i in range(200)]
    h = EV.hopkins(pts(uni), seed=1, box="fixed").collect()[0].hopkins
    assert h < 0.3  # uniform points landing far from the data push H towards 0


def test_radius_stats(pts):
    rows = _rows(60, 7)
    r = EV.radius_stats(pts(rows), CENTERS).collect()[0]
    radii = {}
    for i, lon, lat in rows:
        ds = [hav(lon, lat, c[0], c[1]) for c in CENTERS]
        j = min(range(3), key=lambda x: (ds[x], x))
        radii[j] = max(radii.get(j, 0.0), ds[j])
    vals = list(radii.values())
    mean = sum(vals) / len(vals)
    std = (sum((v - mean) ** 2 for v in vals) / (len(vals) - 1)) ** 0.5
    assert abs(r.mean_radius - mean) < 1e-6 and abs(r.std_radius - std) < 1e-6 and r.clusters == 3


def test_data_box(pts):
    b = EV.data_box(pts([(1, -8.6, 41.1), (2, -8.5, 41.3)]))
    assert b == Box(-8.6, -8.5, 41.1, 41.3)


def test_repeated_ids_and_places_count_for_themselves(pts):
    rows = [(10, -8.60, 41.10), (10, -8.60, 41.12), (11, -8.60, 41.124)] + [(12, -8.55, 41.22)] * 4
    got = sorted((r.id, round(r.nn_dist, 6)) for r in nearest_neighbor(pts(rows), pts(rows)).collect())
    want = sorted(
        (i, round(min(d for d in (hav(x, y, q[1], q[2]) for q in rows) if d > 0), 6)) for i, x, y in rows
    )
    assert got == want
    w = sum(d for _, d in want)
    assert abs(EV.hopkins(pts(rows), seed=1).collect()[0].w - w) < 1e-4
    # The brute force keys by position in the list, the operator sees the repeated ids.
    keyed = [(n, x, y) for n, (_, x, y) in enumerate(rows)]
    for mode in ("standard", "own_size"):
        s = EV.silhouette(pts(rows), CENTERS, mode=mode, block=2).collect()[0].silhouette
        assert abs(s - _silhouette_brute(keyed, CENTERS, mode)) < 1e-9
    assert EV.silhouette_points(pts(rows), CENTERS).count() == len(rows)


def test_nearest_neighbor_over_the_date_line(pts):
    rows = [(i, -179.0 + i * 0.5, 10.0) for i in range(200)] + [(900, 179.999, 10.0), (901, -179.999, 10.0)]
    got = {r.id: r.nn_dist for r in nearest_neighbor(pts(rows), pts(rows)).collect()}
    for i, lon, lat in rows:
        want = min(d for d in (hav(lon, lat, q[1], q[2]) for q in rows) if d > 0)
        assert abs(got[i] - want) < 1e-4, i


def test_nearest_neighbor_dense_spot_and_missing_coordinates(pts):
    rnd = random.Random(11)
    rows = [(i, -8.6 + rnd.random() * 1e-4, 41.1 + rnd.random() * 1e-4) for i in range(300)]
    rows += [(500, -120.0, -30.0), (501, None, 41.0), (502, -8.6, None)]
    got = {r.id: r.nn_dist for r in nearest_neighbor(pts(rows), pts(rows)).collect()}
    assert got[501] is None and got[502] is None and len(got) == len(rows)
    for i, lon, lat in rows[:301]:
        want = min(d for d in (hav(lon, lat, q[1], q[2]) for q in rows[:301]) if d > 0)
        assert abs(got[i] - want) < 1e-4, i


def test_empty_tables(pts, spark):
    none = pts([(1, -8.6, 41.1)]).limit(0)
    assert nearest_neighbor(none, none).count() == 0
    assert EV.hopkins(none).collect()[0].hopkins is None
    assert EV.silhouette(none, CENTERS).collect()[0].silhouette is None


def test_small_levels_are_broadcast_by_one_key(pts):
    rows = _rows(600, 12)
    near = nearest_neighbor(pts(rows), pts(rows))
    near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString()
    hashed = [line for line in plan.splitlines() if "HashedRelationBroadcastMode" in line]
    # Two-column keys: input[0, bigint, false], input[1, bigint, false].
    assert hashed and not any("input[1, bigint" in line for line in hashed if "bigint" in line)


@pytest.mark.parametrize("n,block", [(300, None), (300, 70)])
def test_chunks_of_a_block_hold_every_pair_once(pts, monkeypatch, n, block):
    monkeypatch.setattr(EV, "_CHUNK_ROWS", 16)
    monkeypatch.setattr(EV, "_CHUNK_COLUMNS", 40)
    rows = _rows(n, 13)
    got = EV.silhouette(pts(rows), CENTERS, block=block).collect()[0].silhouette
    assert abs(got - _silhouette_brute(rows, CENTERS, "standard")) < 1e-9
