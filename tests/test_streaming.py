import os

from medoidlab.sources.trips import read_positions
from medoidlab.streaming.positions import clean_positions_stream

HEADER = "TRIP_ID,CALL_TYPE,ORIGIN_CALL,ORIGIN_STAND,TAXI_ID,TIMESTAMP,DAY_TYPE,MISSING_DATA,POLYLINE\n"


def _write(path, rows):
    with open(path, "w") as f:
        f.write(HEADER)
        for tid, ct, poly in rows:
            f.write(f'{tid},{ct},,,1,0,A,False,"{poly}"\n')


def test_incremental_cleaning(spark, tmp_path):
    raw, out, ck = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "ck")
    os.makedirs(raw)
    _write(raw / "a.csv", [("1", "C", "[[-8.6,41.1],[-8.6,41.2]]"), ("2", "A", "[[-8.6,41.1]]"), ("3", "C", "[]")])
    q = clean_positions_stream(spark, str(raw), out, ck)
    q.awaitTermination(120)
    assert sorted(r.id for r in read_positions(spark, out, "parquet").collect()) == [1]
    _write(raw / "b.csv", [("4", "C", "[[-8.5,41.3]]"), ("5", "C", "[[-9.5,41.3]]")])
    q = clean_positions_stream(spark, str(raw), out, ck)
    q.awaitTermination(120)
    assert sorted(r.id for r in read_positions(spark, out, "parquet").collect()) == [1, 4]


def test_default_checkpoint_follows_the_output(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    os.makedirs(raw)
    for n, name in ((1, "a.csv"), (2, "b.csv")):
        _write(raw / name, [(str(n), "C", "[[-8.6,41.1]]")])
        clean_positions_stream(spark.newSession(), str(raw), out).awaitTermination(120)
    assert sorted(r.id for r in read_positions(spark, out, "parquet").collect()) == [1, 2]


def test_other_header_order_stops_the_stream(spark, tmp_path):
    raw = tmp_path / "raw"
    os.makedirs(raw)
    (raw / "a.csv").write_text(HEADER.replace("TRIP_ID,CALL_TYPE", "CALL_TYPE,TRIP_ID") + 'C,1,,,1,0,A,False,"[[-8.6,41.1]]"\n')
    try:
        clean_positions_stream(spark, str(raw), str(tmp_path / "out")).awaitTermination(120)
    except Exception as e:
        assert "header" in str(e).lower()
    else:
        raise AssertionError("rows of a file with another header were read")
