import re

from medoidlab.operators.clean import clean_trips, in_bbox, pickup_point
from medoidlab.schema import TRIP_COLUMNS, TRIP_SCHEMA


def _trips(spark, rows):
    full = []
    for tid, ct, poly in rows:
        r = {c: None for c in TRIP_COLUMNS}
        r.update(TRIP_ID=tid, CALL_TYPE=ct, POLYLINE=poly)
        full.append(tuple(r[c] for c in TRIP_COLUMNS))
    return spark.createDataFrame(full, TRIP_SCHEMA)


def test_tracks_edge(spark):
    t = _trips(
        spark,
        [
            ("1", "C", "[[-8.618643,41.141412],[-8.6,41.1]]"),
            ("2", "C", "[[-8.6,41.1]]"),
            ("3", "C", "[]"),
            ("4", "C", None),
            ("5", "C", "[[bad,41.1]]"),
            ("6", "C", "[[-8.6]]"),
            ("7", "A", "[[-8.6,41.1]]"),
            ("8", None, "[[-8.6,41.1]]"),
        ],
    )
    got = sorted(tuple(r) for r in clean_trips(t).collect())
    assert got == [(1, -8.618643, 41.141412), (2, -8.6, 41.1)]


def test_pickup_point_keeps_bad_rows_as_null(spark):
    t = _trips(spark, [("9", "C", "[[x,y]]"), ("10", "C", "[[-8.6,41.1,7]]")])
    got = {r.id: (r.lon, r.lat) for r in pickup_point(t).collect()}
    assert got[9] == (None, None)
    assert got[10] == (-8.6, 41.1)


def test_box_is_strict(pts):
    rows = [
        (1, -8.5, 41.0),
        (2, -8.5, 42.0),
        (3, -8.7, 41.5),
        (4, -8.4, 41.5),
        (5, -8.5, 41.000001),
        (6, -8.699999, 41.999999),
    ]
    got = sorted(r.id for r in in_bbox(pts(rows)).collect())
    assert got == [5, 6]


def test_long_ids_survive(spark):
    t = _trips(spark, [("1372636858620000589", "C", "[[-8.6,41.1]]")])
    assert clean_trips(t).collect()[0].id == 1372636858620000589


def test_plan_prunes_raw_columns(spark, tmp_path):
    t = _trips(spark, [("1", "C", "[[-8.6,41.1]]")])
    path = str(tmp_path / "trips.parquet")
    t.write.parquet(path)
    plan = clean_trips(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    m = re.search(r"ReadSchema: struct<([^>]*)>", plan)
    assert {f.split(":")[0] for f in m.group(1).split(",")} == {"TRIP_ID", "CALL_TYPE", "POLYLINE"}


def test_box_filter_reaches_parquet_scan(pts, spark, tmp_path):
    path = str(tmp_path / "positions.parquet")
    pts([(1, -8.5, 41.5)]).write.parquet(path)
    plan = in_bbox(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[([^\]]*)", plan).group(1)  # long lists end in "..."
    assert "GreaterThan(lat,41.0)" in pushed and "LessThan(lat,42.0)" in pushed and "GreaterThan(lon,-8.7)" in pushed
