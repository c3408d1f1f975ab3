import csv
import os

import pytest

from medoidlab.sources.trips import load_positions, path_exists, read_positions, write_positions, write_results

HEADER = ["TRIP_ID", "CALL_TYPE", "ORIGIN_CALL", "ORIGIN_STAND", "TAXI_ID", "TIMESTAMP", "DAY_TYPE", "MISSING_DATA",
          "POLYLINE"]


def _raw(path, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(HEADER)
        for tid, ct, poly in rows:
            w.writerow([tid, ct, "", "", "7", "1372636858", "A", "False", poly])


def test_load_or_materialise(spark, tmp_path):
    raw = str(tmp_path / "train.csv")
    _raw(raw, [("1", "C", "[[-8.6,41.1],[-8.6,41.2]]"), ("2", "B", "[[-8.6,41.1]]"), ("3", "C", "[[-8.9,41.1]]")])
    cache = str(tmp_path / "clean")
    first = load_positions(spark, raw, cache)
    assert sorted(tuple(r) for r in first.collect()) == [(1, -8.6, 41.1)]
    assert path_exists(spark, cache)
    os.remove(raw)  # the second load must come from the cleaned copy
    again = load_positions(spark, raw, cache)
    assert sorted(tuple(r) for r in again.collect()) == [(1, -8.6, 41.1)]
    with pytest.raises(FileNotFoundError):
        load_positions(spark, raw, str(tmp_path / "other"))


def test_json_names_and_error_if_exists(pts, spark, tmp_path):
    path = str(tmp_path / "pos.json")
    write_positions(pts([(1372636858620000589, -8.6, 41.1)]), path)
    raw = spark.read.json(path)
    assert sorted(raw.columns) == ["id", "pickupLatitude", "pickupLongitude"]
    assert read_positions(spark, path).collect()[0].id == 1372636858620000589
    with pytest.raises(Exception):
        write_positions(pts([(2, -8.6, 41.1)]), path)


def test_results_append_and_overwrite(spark, tmp_path):
    from medoidlab.schema import RESULT_SCHEMA

    res = spark.createDataFrame(
        [(2, "CLARA", 12, 3.5, [(41.1, -8.6), (41.2, -8.5)]), (2, "PAM", None, None, None)], RESULT_SCHEMA
    )
    path = str(tmp_path / "results")
    write_results(res, path)
    write_results(res, path)
    got = spark.read.option("header", True).csv(path).collect()
    assert len(got) == 4
    assert {r.algorithm for r in got} == {"2", "1"}
    assert all(r.lat_1 == "NULL" for r in got if r.algorithm == "1")
    write_results(res, path, mode="overwrite")
    assert spark.read.option("header", True).csv(path).count() == 2


def test_trip_columns_bind_by_name(spark, tmp_path):
    from medoidlab.sources.trips import read_trips

    (tmp_path / "t.csv").write_text(
        'CALL_TYPE,TRIP_ID,ORIGIN_CALL,ORIGIN_STAND,TAXI_ID,TIMESTAMP,DAY_TYPE,MISSING_DATA,POLYLINE\n'
        'C,7,,,1,0,A,False,"[[-8.6,41.1]]"\n'
    )
    row = read_trips(spark, str(tmp_path / "t.csv")).first()
    assert (row.TRIP_ID, row.CALL_TYPE) == ("7", "C")


def test_broken_copy_is_written_anew(spark, tmp_path):
    from medoidlab.sources.trips import load_positions

    raw, copy = tmp_path / "raw.csv", tmp_path / "copy"
    raw.write_text(
        'TRIP_ID,CALL_TYPE,ORIGIN_CALL,ORIGIN_STAND,TAXI_ID,TIMESTAMP,DAY_TYPE,MISSING_DATA,POLYLINE\n'
        '7,C,,,1,0,A,False,"[[-8.6,41.1]]"\n'
    )
    (copy / "_temporary").mkdir(parents=True)
    for _ in range(2):
        assert [r.id for r in load_positions(spark, str(raw), str(copy)).collect()] == [7]


def test_appended_results_keep_one_width(spark, tmp_path):
    from medoidlab.plans.sweep import results_wide
    from medoidlab.schema import RESULT_SCHEMA
    from medoidlab.sources.trips import write_results

    def table(k):
        return spark.createDataFrame([(k, "PAM", 1, 2.0, [(41.0, -8.0)] * k)], RESULT_SCHEMA)

    out = str(tmp_path / "results")
    write_results(table(2), out, max_k=3)
    write_results(table(3), out, max_k=3)
    assert spark.read.option("header", True).csv(out).columns == results_wide(table(3), 3).columns
    with pytest.raises(ValueError):
        write_results(table(4), out)


def test_workers_import_the_package_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as E\n"
        "from medoidlab.session import local_session\n"
        "s = local_session(2, 2)\n"
        "print('centres', E.queries()['clarafast'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "centres 4" in done.stdout, done.stderr[-2000:]
