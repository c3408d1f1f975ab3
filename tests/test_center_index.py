"""Nearest centre through the index against the scan over all centres."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import hav
from medoidlab.operators.assign import assign_nearest, objective, with_nearest
from medoidlab.operators.center_index import MAX_LEVEL, assign_indexed, build_center_index

CENTERS = "center_id int, lon double, lat double"


def uneven(n, seed=1):
    """Most places in a small spot, the others far around it."""
    rng = random.Random(seed)
    spot = [(-8.6 + rng.random() * 0.3, 41.1 + rng.random() * 0.3) for _ in range(n * 3 // 4)]
    return spot + [(rng.uniform(-14, -4), rng.uniform(36, 46)) for _ in range(n - len(spot))]


@pytest.mark.parametrize("leaf", [8])
def test_equal_to_the_scan_with_ties_to_the_lower_id(spark, pts, leaf):
    places = uneven(160)
    centers = [(i, lon, lat) for i, (lon, lat) in enumerate(places[:60] + places[:20] + places[130:])]
    rows = [(i, lon, lat) for i, (lon, lat) in enumerate(places * 2)]
    got = assign_indexed(pts(rows), spark.createDataFrame(centers, CENTERS), leaf=leaf).collect()
    assert len(got) == len(rows)
    for r in got:
        best = min((hav(r.lon, r.lat, lon, lat), i) for i, lon, lat in centers)
        assert abs(r.dist - best[0]) < 1e-6
        same = [i for i, lon, lat in centers if abs(hav(r.lon, r.lat, lon, lat) - best[0]) < 1e-9]
        assert r.cluster == min(same)


def test_settled_cells_are_short_and_do_not_overlap(spark):
    centers = spark.createDataFrame([(i, *p) for i, p in enumerate(uneven(300))], CENTERS)
    index, levels = build_center_index(centers, (-14.0, 36.0, 10.0001, 10.0001))
    rows = index.select("level", "cx", "cy", F.size("near").alias("n")).collect()
    assert all(r.n <= 24 for r in rows if r.level < MAX_LEVEL) and len(rows) < 40 * 300
    share = sum(4.0 ** -r.level for r in rows)
    assert len({(r.level, r.cx, r.cy) for r in rows}) == len(rows) and abs(share - 1) < 1e-9
    assert sorted({r.level for r in rows}) == levels


def test_a_table_of_any_size_goes_through_the_index(spark, pts):
    places = uneven(1100, 2)
    points = pts([(i, *p) for i, p in enumerate(places)] + [(9000, None, 41.0), (9001, None, None)])
    centers = spark.createDataFrame([(i, *p) for i, p in enumerate(places[::2])], CENTERS)
    a = assign_nearest(points, centers)
    assert "Python" not in a._jdf.queryExecution().toString()
    near = with_nearest(points, centers.collect()).select("id", F.round("dist", 6).alias("want"), F.col("cluster").alias("c"))
    bad = a.join(near, "id").where(~F.col("c").eqNullSafe(F.col("cluster")) | ~F.round("dist", 6).eqNullSafe(F.col("want")))
    assert a.count() == 1102 and bad.where("lon is not null").count() == 0
    assert a.where("cluster is null").count() == 2
    phi = near.agg(F.sum("want")).first()[0]
    assert abs(objective(points, centers).first()[0] - phi) < 1e-3


def test_no_centres_and_no_rows(spark, pts):
    none = spark.createDataFrame([], CENTERS)
    with pytest.raises(ValueError):
        assign_indexed(pts([(1, -8.6, 41.1)]), none)
    assert assign_indexed(pts([(1, -8.6, 41.1)]).limit(0), none).count() == 0
    one = spark.createDataFrame([(3, -8.6, 41.1)], CENTERS)
    (row,) = assign_indexed(pts([(1, -8.6, 41.1)]), one).collect()
    assert (row.cluster, row.dist) == (3, 0.0)


def test_cells_are_cut_without_sorting_pairs(spark, monkeypatch):
    """The best centre of a cell's part is a hash aggregate inside the stage."""
    from medoidlab.operators import center_index as C

    plans, cut = [], C.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(C, "cut_lineage", noted)
    centers = spark.createDataFrame([(i, *p) for i, p in enumerate(uneven(300))], CENTERS)
    build_center_index(centers, (-14.0, 36.0, 10.0001, 10.0001))
    assert plans and not any("SortAggregate" in p for p in plans)
