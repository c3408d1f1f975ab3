import random

from conftest import hav
from pyspark.sql import functions as F

from medoidlab.operators.assign import assign_nearest, best_set, objective, objective_many

CENTERS = [(-8.61, 41.15), (-8.58, 41.20), (-8.65, 41.10), (-8.50, 41.30)]


def _rand_rows(n, seed=1):
    rnd = random.Random(seed)
    return [(i, -8.7 + 0.3 * rnd.random(), 41.0 + 0.35 * rnd.random()) for i in range(n)]


def test_assign_matches_brute_force(pts):
    rows = _rand_rows(300)
    got = {r.id: (r.cluster, r.dist) for r in assign_nearest(pts(rows), CENTERS).collect()}
    for i, lon, lat in rows:
        ds = [hav(lon, lat, c[0], c[1]) for c in CENTERS]
        best = min(range(len(ds)), key=lambda j: (ds[j], j))
        assert got[i][0] == best
        assert abs(got[i][1] - ds[best]) < 1e-6


def test_ties_go_to_lower_index(pts):
    # exactly between two centres (symmetric longitudes give bit-equal distances)
    centers = [(-1.0, 0.0), (1.0, 0.0)]
    r = assign_nearest(pts([(1, 0.0, 0.0)]), centers).collect()[0]
    assert r.cluster == 0
    centers = [(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0)]
    assert assign_nearest(pts([(1, 0.0, 0.0)]), centers).collect()[0].cluster == 0


def test_large_k_matches_brute_force(pts):
    rows = _rand_rows(200, 3)
    rnd = random.Random(7)
    cs = [(-8.7 + 0.3 * rnd.random(), 41.0 + 0.35 * rnd.random()) for _ in range(40)]
    got = {r.id: r.cluster for r in assign_nearest(pts(rows), cs).collect()}
    for i, lon, lat in rows:
        ds = [hav(lon, lat, c[0], c[1]) for c in cs]
        assert got[i] == min(range(len(ds)), key=lambda j: (ds[j], j))


def test_objective_many_equals_objective(pts):
    df = pts(_rand_rows(250, 5))
    sets = {0: CENTERS, 1: CENTERS[:2], 7: CENTERS[1:], 3: [CENTERS[2]]}
    many = {r.set_id: r.phi for r in objective_many(df, sets).collect()}
    for s, cs in sets.items():
        one = objective(df, cs).collect()[0].phi
        assert abs(many[s] - one) < 1e-6 * max(1.0, one)
    b = best_set(objective_many(df, sets)).collect()[0]
    assert b.set_id == min(many, key=lambda s: (many[s], s))


def test_assignment_plan_has_no_shuffle_and_no_python(pts):
    df = assign_nearest(pts(_rand_rows(10)), CENTERS).select("id", "cluster", "dist")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan
    assert F is not None


def test_many_centers_agree_with_few(pts):
    from medoidlab.operators import assign as A

    df = pts([(i, -8.69 + i * 1e-3, 41.0 + (i * 37 % 100) * 1e-3) for i in range(200)])
    centers = [(-8.69 + i * 2e-2, 41.0 + (i % 5) * 2e-2) for i in range(12)] + [(-8.69, 41.0)]
    folded = A.assign_nearest(df, centers).orderBy("id").collect()
    total = A.objective(df, centers).collect()[0][0]
    limit, A.UNROLLED_CENTERS = A.UNROLLED_CENTERS, 99
    try:
        unrolled = A.assign_nearest(df, centers).orderBy("id").collect()
    finally:
        A.UNROLLED_CENTERS = limit
    assert [(r.id, r.cluster, r.dist) for r in folded] == [(r.id, r.cluster, r.dist) for r in unrolled]
    assert abs(total - sum(r.dist for r in folded)) < 1e-3


def test_more_set_centers_than_one_batch_holds(pts, spark):
    rows = [(i, -8.6 + 0.001 * i, 41.1 + 0.0007 * i) for i in range(40)]
    sets = {s: [(-8.6 + 0.002 * s, 41.1), (-8.58, 41.12 + 0.001 * s)] for s in range(50)}
    flat = [(s, i, lon, lat) for s, cs in sets.items() for i, (lon, lat) in enumerate(cs)]
    table = spark.createDataFrame(flat, "set_id int, center_id int, lon double, lat double")
    want = {r.set_id: r.phi for r in objective_many(pts(rows), sets).collect()}
    got = {r.set_id: r.phi for r in objective_many(pts(rows), table, max_centers=30).collect()}
    assert got.keys() == want.keys() == sets.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sets)
