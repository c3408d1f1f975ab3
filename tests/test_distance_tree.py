"""Distance sums by cells against sums over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from medoidlab.operators import distance_tree as DT
from medoidlab.operators import evaluate as EV
from medoidlab.operators.kernels import chord_distance, unit_vectors

N = 3000


def _layouts():
    r = np.random.default_rng(3)
    u, v = r.random(N), r.random(N)
    half = N // 2
    return {
        "box": (-8.7 + 0.3 * u, 41 + 0.35 * v),
        "globe": (360 * u - 180, np.degrees(np.arcsin(2 * v - 1))),
        "opposite sides": (np.r_[10 + u[:half], -170 + u[half:]], np.r_[40 + v[:half], -40 - v[half:]]),
        "pole": (360 * u - 180, 89 + v),
        "date line": ((539.5 + u) % 360 - 180, v),
        "line": (np.linspace(-8.7, -8.4, N), np.full(N, 41.2)),
        "dense spot": (-8.6 + np.r_[1e-4 * u[:half], u[half:]], 41 + np.r_[1e-4 * v[:half], v[half:]]),
        "one place, many names": (np.arange(N) * 360.0, np.full(N, 41.2)),
    }


def _all_pairs(lon, lat, own, w, clusters):
    v = unit_vectors(lon, lat)
    return chord_distance(v, v) @ ((own[:, None] == clusters) * w[:, None])


def _tree(lon, lat, own, w, clusters):
    tree = DT.Tree(clusters)
    tree.hold(lon, lat, own, w)
    return tree, tree.grow(np.arange(len(lon)))


@pytest.mark.parametrize("layout", list(_layouts()))
def test_sums_by_cells_are_the_sums_over_all_pairs(layout):
    lon, lat = _layouts()[layout]
    r = np.random.default_rng(4)
    own, w, clusters = r.integers(0, 3, N) * 5, r.integers(1, 4, N).astype(float), np.array([0, 5, 10])
    tree, top = _tree(lon, lat, own, w, clusters)
    sums = DT.Sums(tree, (64, 2048))
    sums.run(top, [top])
    want = _all_pairs(lon, lat, own, w, clusters)
    assert np.abs(sums.out - want).max() <= 1e-10 * max(want.max(), 1.0)


def test_distances_grow_with_the_places_not_their_square(monkeypatch):
    made = []
    arc = DT.arc_length
    monkeypatch.setattr(DT, "arc_length", lambda a, *x: made.append(a.size) or arc(a, *x))
    r, work = np.random.default_rng(5), []
    for n in (8192, 32768):
        made.clear()
        lon, lat = -8.7 + 0.3 * r.random(n), 41 + 0.35 * r.random(n)
        tree, top = _tree(lon, lat, np.zeros(n, int), np.ones(n), np.array([0]))
        DT.Sums(tree, (64, 2048)).run(top, [top])
        work.append(sum(made))
    # All pairs would be 16 times as many.
    assert work[1] < 8 * work[0] and work[1] < 32768**2 / 3


def test_cells_follow_the_density():
    r = np.random.default_rng(6)
    lon, lat = np.r_[r.random(500), 0.3 + 1e-5 * r.random(500), 0.9, 0.9 + 1e-13], np.r_[r.random(1000), 0.9, 0.9]
    lat[500:1000] = 0.3 + 1e-5 * lat[500:1000]
    codes = DT.Map((lon.min(), lon.max()), (lat.min(), lat.max())).codes(lon, lat)

    def counted(level, heavy):
        kept = codes if heavy is None else codes[np.isin(codes >> 2 * (DT.MAP_BITS - heavy[0]), heavy[1])]
        return np.unique(kept >> 2 * (DT.MAP_BITS - level), return_counts=True)

    for size in (1, 20, 5000):
        first, places = EV._cells(counted, size)
        at = np.searchsorted(first, codes, side="right") - 1
        assert (np.bincount(at, minlength=len(first)) == places).all() and places.sum() == len(lon)
        # Only places that no square of the map parts share a cell of one.
        assert places.max() <= max(size, 2)


@pytest.mark.parametrize("layout,block", [("box", 400), ("globe", 700), ("dense spot", 300), ("box", None)])
def test_distance_sums_over_blocks(pts, layout, block):
    lon, lat = _layouts()[layout]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat))]
    rows += [(N + i, *rows[7 * i][1:]) for i in range(100)]
    # Clusters that are not compact: the sums do not rely on nearest centres.
    assigned = pts(rows).withColumn("cluster", (F.hash("lon", "lat") % 3).cast("int"))
    out = EV.distance_sums(assigned, block).toPandas()
    one = out.drop_duplicates(["lon", "lat"]).reset_index(drop=True)
    assert len(one) == N and one["w"].sum() == N + 100
    lon, lat, own, w = (one[c].to_numpy() for c in ("lon", "lat", "own", "w"))
    clusters = np.unique(own)
    want = _all_pairs(lon, lat, own, w.astype(float), clusters)
    got = out.pivot_table(index=["lon", "lat"], columns="cluster", values="s").loc[list(zip(lon, lat))]
    assert len(out) == N * len(clusters) and list(got.columns) == list(clusters)
    assert np.abs(got.to_numpy() - want).max() <= 1e-10 * want.max()


def test_places_go_to_the_blocks_around_them_only():
    r, n = np.random.default_rng(7), 20_000
    lon, lat = -8.7 + 0.3 * r.random(n), 41 + 0.25 * r.random(n)
    square = DT.Map((lon.min(), lon.max()), (lat.min(), lat.max())).codes(lon, lat) >> 2 * (DT.MAP_BITS - 5)
    tree = DT.Tree(np.array([0]))
    vectors = unit_vectors(lon, lat)
    names = np.unique(square)
    for name in names:
        tree.add(DT.Box(vectors[square == name]), [], None)
    block = names // 16
    cells, targets = EV._near_blocks(tree, np.unique(block, return_inverse=True)[1])
    assert set(zip(range(len(names)), np.unique(block, return_inverse=True)[1])) <= set(zip(cells.tolist(), targets.tolist()))
    assert len(cells) < len(names) * len(np.unique(block)) / 5


@pytest.mark.parametrize("mode", ["own_size", "standard"])
def test_silhouette_of_many_blocks_meets_few_places(pts, spark, monkeypatch, mode):
    r, n, block = np.random.default_rng(8), 4000, 100
    lon, lat = -8.7 + 0.3 * r.random(n), 41 + 0.35 * r.random(n)
    met, groups, sums = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), EV._block_sums

    def counting(shared):
        run = sums(shared)

        def counted(pdf):
            met.add(len(pdf))
            groups.add(1)
            return run(pdf)

        return counted

    monkeypatch.setattr(EV, "_block_sums", counting)
    centers = [(-8.62, 41.14), (-8.55, 41.22), (-8.66, 41.26)]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat))]
    got = EV.silhouette(pts(rows), centers, mode=mode, block=block).collect()[0].silhouette
    assert groups.value >= 25 and met.value < n * groups.value / 2
    own = chord_distance(unit_vectors(lon, lat), unit_vectors(*np.array(centers).T)).argmin(axis=1)
    s, size = _all_pairs(lon, lat, own, np.ones(n), np.arange(3)), np.bincount(own)
    mine = own[:, None] == np.arange(3)
    by = size[None, :] if mode == "standard" else size[own][:, None]
    a = s[mine] / (size[own] - (mode == "standard"))
    b = np.where(mine, np.inf, s / by).min(axis=1)
    assert abs(got - ((b - a) / np.maximum(a, b)).mean()) < 1e-10
