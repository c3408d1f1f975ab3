"""Swap costs, draws, k-means rounds, drawings of many runs and guarded copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from medoidlab.operators import kernels as K
from medoidlab.operators.kmeans import kmeans_centers, kmeans_predict
from medoidlab.operators.kmedoids import clarans
from medoidlab.operators.raster import raster, raster_many
from medoidlab.plans.sweep import drawn, sweep
from medoidlab.schema import ALG_CLARA, ALG_KMEANS
from medoidlab.sources.trips import load_positions


def blobs(n=160, seed=1):
    rng = random.Random(seed)
    heads = [(-8.62, 41.14), (-8.55, 41.22), (-8.66, 41.26), (-8.48, 41.12)]
    return [(i, heads[i % 4][0] + rng.gauss(0, 0.004), heads[i % 4][1] + rng.gauss(0, 0.004)) for i in range(n)]


@pytest.mark.parametrize("k", [1, 2, 5, 16])
def test_swap_costs_of_all_slots_match_rescoring(k):
    rng = np.random.default_rng(k)
    lon, lat, w = rng.uniform(-9, -8, 60), rng.uniform(41, 42, 60), rng.integers(1, 5, 60).astype(float)
    med = rng.choice(60, k, replace=False)
    cand = np.setdiff1d(np.arange(60), med)[:20]
    costs, phi = K.swap_costs(lon, lat, w, med, cand)
    near = lambda m: float((w * K.dist_cols(lon, lat, m).min(axis=1)).sum())
    assert abs(phi - near(med)) < 1e-6
    for i, c in enumerate(cand):
        for s in range(k):
            swapped = med.copy()
            swapped[s] = c
            assert abs(costs[i, s] - near(swapped)) < 1e-9 * phi + 1e-6


def test_draws_depend_on_the_counter_only():
    params = {K.draw_params(42, b, s, r) for b in range(3) for s in range(3) for r in range(3)}
    assert len(params) == 27 and K.draw_params(42, 1, 2, 0) == K.draw_params(42, 1, 2, 0)
    for a1, b1, a2, b2 in params:
        assert 0 < a1 < K.DRAW_PRIME and 0 < a2 < K.DRAW_PRIME and 0 <= b1 < K.DRAW_PRIME and 0 <= b2 < K.DRAW_PRIME


def test_results_do_not_depend_on_the_layout(pts):
    df = pts(blobs() + [(900, None, 41.1), (901, -8.6, None)])
    layouts = [df.repartition(1), df.repartition(7, "lat"), df.orderBy(F.desc("id")).repartition(3)]
    centers = [kmeans_centers(d, 4, seed=3) for d in layouts]
    assert centers[0] == centers[1] == centers[2] and len(centers[0]) == 4
    known = df.where("lon is not null and lat is not null")
    runs = [sorted(map(tuple, clarans(d, 3, nlocal=2, seed=5).collect())) for d in (known.repartition(1), known.repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == 3


def test_kmeans_finds_blobs_and_predicts_them(pts):
    rows = blobs(200, 2)
    df = pts(rows)
    centers = kmeans_centers(df, 4, seed=1)
    got = {r.id: r.cluster for r in kmeans_predict(df, centers).collect()}
    x = np.array([p[1:] for p in rows])
    c = np.array([p[1:] for p in centers])
    assert all(got[i] == int(((p - c) ** 2).sum(axis=1).argmin()) for i, p in enumerate(x))
    means = [x[[i for i in got if got[i] == j]].mean(axis=0) for j in range(4)]
    assert np.abs(np.array(means) - c).max() < 1e-4
    assert kmeans_centers(df.limit(0), 4) == []
    assert len(kmeans_centers(pts([(1, -8.6, 41.1)] * 5 + [(2, -8.5, 41.2)]), 4)) == 2


def test_many_rasters_equal_single_ones(pts):
    df = pts(blobs())
    runs = [(0, [(-8.6, 41.2), (-8.5, 41.1)], "haversine"), (7, [(-8.6, 41.2), (-8.5, 41.1), (-8.6, 41.2)], "planar")]
    many = {tuple(r) for r in raster_many(df, runs).collect()}
    want = set()
    for run, centers, metric in runs:
        want |= {(run, *r) for r in raster(df, centers, assign=metric).collect()}
    assert many == want
    with pytest.raises(ValueError):
        raster_many(df, [(0, [(0.0, 0.0)], "other")])


def test_sweep_draws_every_run(pts):
    df = pts(blobs())
    s = sweep(df, 2, 3, 1, ALG_CLARA | ALG_KMEANS, seed=1, buckets=2, drawings=True)
    counts = {(r.k, r.algorithm): r.n for r in s.pixels.groupBy("k", "algorithm").agg(F.sum("n").alias("n")).collect()}
    assert set(counts) == {(k, a) for k in (2, 3) for a in ("CLARA", "KMEANS")} and set(counts.values()) == {160}
    places = s.pixels.groupBy("k", "algorithm").agg(F.count_distinct("x", "y").alias("n"))
    colored = s.colors.groupBy("k", "algorithm").count()
    assert {tuple(r) for r in places.collect()} == {tuple(r) for r in colored.collect()}
    assert {(r.k, r.algorithm): r.n for r in s.centers.groupBy("k", "algorithm").agg(F.count("*").alias("n")).collect()} == {
        key: key[0] for key in counts
    }
    assert drawn(df, s.results).results is s.results


def test_copy_never_replaces_other_files(spark, tmp_path):
    raw, copy = tmp_path / "raw.csv", tmp_path / "copy"
    raw.write_text("TRIP_ID,CALL_TYPE,ORIGIN_CALL,ORIGIN_STAND,TAXI_ID,TIMESTAMP,DAY_TYPE,MISSING_DATA,POLYLINE\n")
    copy.mkdir()
    (copy / "notes.txt").write_text("mine")
    with pytest.raises(FileExistsError):
        load_positions(spark, str(raw), str(copy))
    assert (copy / "notes.txt").read_text() == "mine"
