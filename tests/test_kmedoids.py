import itertools
import math
import random

import numpy as np
import pytest
from conftest import hav
from pyspark.sql import functions as F

from medoidlab.operators import kernels as K
from medoidlab.operators import kmedoids as KM
from medoidlab.operators.assign import objective


def _phi(rows, centers):
    return sum(min(hav(lon, lat, c[0], c[1]) for c in centers) for _, lon, lat in rows)


def _blobs(n_per=30, seed=4):
    rnd = random.Random(seed)
    heads = [(-8.62, 41.14), (-8.55, 41.22), (-8.66, 41.26), (-8.48, 41.12)]
    rows, i = [], 0
    for hx, hy in heads:
        for _ in range(n_per):
            rows.append((i, hx + rnd.gauss(0, 0.004), hy + rnd.gauss(0, 0.004)))
            i += 1
    return rows


TINY = [(i, -8.6 + 0.01 * x, 41.1 + 0.01 * y) for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 1), (5, 5), (6, 5), (5, 7), (9, 1), (9, 0)])]


@pytest.mark.parametrize("k", [2, 3])
def test_pam_tiny_close_to_brute_force(pts, k):
    best = min(_phi(TINY, [(r[1], r[2]) for r in c]) for c in itertools.combinations(TINY, k))
    df = pts(TINY).withColumn("bucket", F.lit(0))
    med = KM.pam_buckets(df, k).collect()
    got = _phi(TINY, [(r.lon, r.lat) for r in med])
    assert got >= best - 1e-6
    assert got <= best * 1.05 + 1e-6  # single-swap local optimum; exact on this layout
    assert abs(med[0].phi - got) < 1e-6


def test_pam_is_a_swap_local_optimum():
    rows = _blobs(25)
    lon = np.array([r[1] for r in rows])
    lat = np.array([r[2] for r in rows])
    ids = np.array([r[0] for r in rows])
    w = np.ones(len(rows))
    med, phi, _ = K.pam_search(lon, lat, w, ids, 4)
    _, new_phi, c, s = K.best_swap(lon, lat, w, ids, med)
    assert not (new_phi < phi - K.IMPROVE_TOL)
    assert abs(phi - _phi(rows, [(lon[m], lat[m]) for m in med])) < 1e-6


def _uneven(n, seed):
    rnd = np.random.default_rng(seed)
    lon, lat = -8.6 + rnd.normal(0, 0.05, n), 41.2 + rnd.normal(0, 0.05, n)
    return lon, lat, rnd.integers(1, 4, n).astype(float), np.arange(n) * 3


def test_swap_bounds_lose_no_best_swap():
    lon, lat, w, ids = _uneven(400, 5)
    found, med = K.BestSwap(lon, lat, w, ids), np.arange(5)
    for _ in range(6):
        costs, _ = K.swap_costs(lon, lat, w, med)
        costs[med] = np.inf
        _, new_phi, c, s = found.find(med)
        assert (c, s) == np.unravel_index(costs.argmin(), costs.shape) and new_phi == costs.min()
        med = med.copy()
        med[s] = c


def test_searches_hold_no_matrix_of_the_places():
    import tracemalloc

    lon, lat, w, ids = _uneven(2500, 6)
    tracemalloc.start()
    K.pam_search(lon, lat, w, ids, 4)
    K.clarans_search(lon, lat, w, ids, ids * 7919 % 2**32, 4, 2, 40, 1, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 2500**2 / 4


def test_swap_tasks_are_not_coalesced(pts, spark):
    df = pts(_blobs(30)).withColumn("bucket", F.pmod("id", F.lit(40)).cast("int"))
    for out in (KM.swap_cost(df, 2), KM.pam_swap_step(df, 2)):
        out.collect()
        assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_exact_k_bucket_and_too_small_bucket(pts):
    rows = [(0, -8.6, 41.1), (1, -8.5, 41.2), (2, -8.4, 41.3)]  # bucket 0: exactly k = 3
    rows += [(3, -8.6, 41.1), (4, -8.6, 41.1), (5, -8.5, 41.2)]  # bucket 1: 2 distinct places
    df = pts(rows).withColumn("bucket", F.when(F.col("id") < 3, 0).otherwise(1))
    med = KM.pam_buckets(df, 3).collect()
    assert {r.bucket for r in med} == {0}
    assert sorted(r.id for r in med) == [0, 1, 2]
    init = KM.pam_init(df, 3).collect()
    assert {r.bucket for r in init} == {0}


def test_duplicates_weigh_but_seed_distinct(pts):
    rows = [(i, -8.6, 41.1) for i in range(20)] + [(20, -8.5, 41.2), (21, -8.4, 41.3)]
    df = pts(rows).withColumn("bucket", F.lit(0))
    med = KM.pam_buckets(df, 2).collect()
    assert len({(r.lon, r.lat) for r in med}) == 2
    assert (-8.6, 41.1) in {(r.lon, r.lat) for r in med}


def test_clara_picks_argmin_and_centres_are_points(pts):
    rows = _blobs(30)
    df = pts(rows)
    c = KM.clara(df, 4, buckets=3, seed=1).collect()
    places = {(r[1], r[2]) for r in rows}
    assert all((r.lon, r.lat) in places for r in c)
    # four well-separated blobs: one centre per blob
    assert _phi(rows, [(r.lon, r.lat) for r in c]) < 0.5 * _phi(rows, [(rows[0][1], rows[0][2])] * 4)


def test_search_results_repeat_across_layouts(pts):
    df = pts(_blobs(30))
    a = sorted((r.lon, r.lat) for r in KM.pam(df, 4, seed=3).collect())
    b = sorted((r.lon, r.lat) for r in KM.pam(df.repartition(5), 4, seed=3).collect())
    assert a == b
    c1 = sorted((r.lon, r.lat) for r in KM.clarans(df, 4, seed=3).collect())
    c2 = sorted((r.lon, r.lat) for r in KM.clarans(df.repartition(3), 4, seed=3).collect())
    assert c1 == c2


def test_clarafast_and_clarans_give_k_input_points(pts):
    rows = _blobs(40)
    df = pts(rows)
    places = {(r[1], r[2]) for r in rows}
    for res in (KM.clarafast(df, 4, seed=2), KM.clarans(df, 4, seed=2), KM.clara(df, 4, sample_size=30, n_samples=3, seed=2)):
        got = res.collect()
        assert len(got) == 4 and all((r.lon, r.lat) in places for r in got)
        assert objective(df, [(r.lon, r.lat) for r in got]).collect()[0].phi > 0


def test_guards(pts):
    df = pts(_blobs(5))
    with pytest.raises(ValueError):
        KM.clarans(df, 1)
    with pytest.raises(ValueError):
        KM.clarans(df, 3, nlocal=6)
    with pytest.raises(ValueError):
        KM.pam(df, 2, buckets=0)
    with pytest.raises(ValueError):
        KM.clara(df, 2, sample_size=10_000, n_samples=2)


def test_no_bucket_is_too_large(pts):
    df = pts(_blobs(10)).withColumn("bucket", F.lit(0))
    assert KM.pam_buckets(df, 2).count() == 2


@pytest.mark.parametrize("n", [40, 60, 100])
def test_merge_of_several_levels(spark, n):
    rows = [(i, -8.6 + (i % 4) * 0.05 + i * 1e-5, 41.1 + (i % 4) * 0.05) for i in range(n)]
    med = spark.createDataFrame(rows, "id long, lon double, lat double")
    out = KM._merge(med, 4, 1, 20, lambda g: KM.pam_buckets(g, 4)).collect()
    assert len(out) == 4 and {r.id for r in out} <= set(range(n))
    with pytest.raises(ValueError, match="2k"):
        KM._merge(med, 4, 1, 7, lambda g: g)


@pytest.mark.parametrize("buckets", [None, 5])
def test_small_limit_splits_buckets_and_merges(pts, buckets):
    df = pts([(i, -8.69 + (i % 50) * 0.005, 41.05 + (i // 50) * 0.005) for i in range(2500)])
    assert KM.pam(df, 4, buckets=buckets, seed=3, limit=30).count() == 4
    assert KM.clarans(df, 4, buckets=buckets, seed=3, limit=30).count() == 4
    assert KM.clara(df, 4, buckets=buckets, seed=3, limit=30).count() == 4


def test_full_buckets_follow_the_square_root_at_any_size():
    for n in (3, 40_000, 10**8, 4 * 10**8, 10**10):
        assert KM.full_buckets(n, 4) == max(1, math.isqrt(n // 4))


def test_full_clara_does_not_depend_on_the_planned_bucket_size(pts):
    df = pts([(i, -8.69 + (i * 37 % 101) * 0.002, 41.05 + (i * 53 % 97) * 0.003) for i in range(600)])
    runs = [sorted(map(tuple, KM.clara(df, 4, seed=3, limit=limit).collect())) for limit in (KM.BUCKET_ROWS, 20)]
    assert runs[0] == runs[1] and len(runs[0]) == 4


def test_wider_groups_of_bounds_find_the_same_swaps(monkeypatch):
    lon, lat, w, ids = _uneven(400, 7)
    want = K.pam_search(lon, lat, w, ids, 5)
    monkeypatch.setattr(K, "BOUND_CELLS", 2000)
    found = K.BestSwap(lon, lat, w, ids)
    near, far = found._near_and_far()
    assert near.size <= 2000 and far.size <= 2000
    got = K.pam_search(lon, lat, w, ids, 5)
    assert got[0].tolist() == want[0].tolist() and got[1:] == want[1:]


def test_fixed_samples_return_trip_ids(pts):
    df = pts([(1_000_000 + i, -8.6 + i * 1e-4, 41.1 + (i % 7) * 1e-3) for i in range(300)])
    assert all(r.id >= 1_000_000 for r in KM.clara(df, 3, sample_size=40, n_samples=3, seed=1).collect())


def test_clarans_budget():
    assert K.clarans_budget(4, 100) == 8
    assert K.clarans_budget(2, 5) == 1
    assert K.clarans_budget(10, 2000) == (10 * 1990) // 100
    assert K.clarans_budget(4, 100, distinct=6) == 2
