import math

from pyspark.sql import functions as F

from medoidlab.functions.geo import color_cube_side
from medoidlab.operators import raster as RA
from medoidlab.schema import Box

BOX = Box(0.0, 10.0, 0.0, 10.0)  # 10 x 10 pixels of one degree


def _java_round(x):
    return math.floor(x + 0.5)


def test_pixels_round_half_up(pts):
    rows = [(1, 0.5, 9.5), (2, -0.5, 10.5), (3, 9.4, 0.6), (4, 9.6, 0.4), (5, 10.0, 0.0)]
    got = {r.id: (r.x, r.y) for r in RA.with_pixels(pts(rows), BOX, 10, 10).collect()}
    for i, lon, lat in rows:
        assert got[i] == (_java_round(lon), _java_round(10.0 - lat))
    assert got[2] == (0, 0)  # Math.round(-0.5) is 0, not -1


def test_raster_counts_and_dropped(pts):
    rows = [(1, 1.0, 9.0), (2, 1.0, 9.0), (3, 5.0, 5.0), (4, -3.0, 5.0), (5, 5.0, 12.0), (6, 11.0, -2.0)]
    ras = {(r.x, r.y, r.cluster): r.n for r in RA.raster(pts(rows), box=BOX, width=10, height=10).collect()}
    assert ras == {(1, 1, 0): 2, (5, 5, 0): 1}
    drop = {r.reason: (r.n, r.share) for r in RA.raster_dropped(pts(rows), BOX, 10, 10).collect()}
    assert drop["west"] == (1, 1 / 6)
    assert drop["north"] == (1, 1 / 6)
    assert drop["east south"] == (1, 1 / 6)


def _java_colors(k):
    side = color_cube_side(k)
    step = side**3 // (k + 1)
    out = []
    for c in range(k):
        pos = float((c + 1) * step)
        if side == 1:
            out.append((255, 255, 255))
            continue
        r = int(((pos % side) / side) * 255)
        g = int((((pos / side) % side) / side) * 255)
        b = int((((pos / side / side) % side) / side) * 255)
        out.append((r, g, b))
    return out


def test_cluster_colors(spark):
    for k in (1, 2, 4, 7, 26, 30):
        df = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
        got = [(r.r, r.g, r.b) for r in RA.cluster_colors(df, k).orderBy("cluster").collect()]
        assert got == _java_colors(k), k
    assert color_cube_side(0) == 1 and color_cube_side(7) == 2 and color_cube_side(8) == 3


def test_pixel_blend_matches_stepwise(spark):
    ras = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 1, 3), (2, 0, 2, 300)], "x int, y int, cluster int, n bigint")
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in RA.pixel_colors(ras, 4, 0.6).collect()}
    cols = _java_colors(4)
    for x, n, c in ((0, 1, 1), (1, 3, 1), (2, 300, 2)):
        v = [0, 0, 0]
        for _ in range(n):
            v = [int(v[i] * (1 - 0.6) + cols[c][i] * 0.6) for i in range(3)]
        assert got[(x, 0)] == tuple(v)


def test_center_squares(spark):
    cs = [(0, 5.0, 5.0), (1, 0.0, 5.0), (2, 50.0, 50.0)]
    got = {r.center_id: (r.drawn, r.dropped, r.status) for r in RA.raster_centers(cs, spark, BOX, 10, 10, 4).collect()}
    assert got[0] == (16, 0, "inside")
    assert got[1] == (8, 8, "cut")
    assert got[2] == (0, 16, "outside")
    assert RA.center_pixels(cs, spark, BOX, 10, 10, 4).count() == 24
