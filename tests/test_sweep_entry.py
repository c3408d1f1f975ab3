import json
import os
import subprocess
import sys

from medoidlab.plans.sweep import results_wide, sweep
from medoidlab.schema import ALG_CLARA, ALG_KMEANS, ALG_PAM


def _blobs():
    import random

    rnd = random.Random(1)
    heads = [(-8.62, 41.14), (-8.55, 41.22), (-8.66, 41.26), (-8.48, 41.12)]
    return [(i, heads[i % 4][0] + rnd.gauss(0, 0.003), heads[i % 4][1] + rnd.gauss(0, 0.003)) for i in range(160)]


def test_sweep_rows_and_wide_form(pts):
    res = sweep(pts(_blobs()), 2, 3, 1, ALG_PAM | ALG_CLARA | ALG_KMEANS, seed=1, buckets=2)
    rows = res.collect()
    assert len(rows) == 2 * 5
    ran = [r for r in rows if r.phi is not None]
    assert {r.algorithm for r in ran} == {"PAM", "CLARA", "KMEANS"}
    assert all(len(r.centers) == r.k for r in ran)
    wide = results_wide(res).collect()
    assert len(wide[0]) == 2 * 3 + 4
    skipped = [w for w in wide if w.algorithm == "4"]
    assert skipped and all(w.phi == "NULL" and w.lat_0 == "NULL" for w in skipped)
    # phi does not rise with k for the same algorithm on well-separated blobs
    by = {(r.algorithm, r.k): r.phi for r in ran}
    assert by[("PAM", 3)] <= by[("PAM", 2)] * 1.0001


def test_entry_contract(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["cluster", "n", "sum_dist", "max_dist"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40


def test_bench_prints_one_json_line(tmp_path):
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_QUERIES="objective,raster")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py")], env=env, capture_output=True, text=True,
                         timeout=600)
    line = [x for x in out.stdout.splitlines() if x.startswith("{")][-1]
    rec = json.loads(line)
    assert set(rec["queries"]) == {"objective", "raster"} and rec["unit"] == "sec"
