from medoidlab.operators import sampling as S
from medoidlab.schema import Box


def _rows(n):
    return [(i, -8.6 + (i % 97) * 1e-3, 41.1 + (i % 89) * 1e-3) for i in range(n)]


def test_bernoulli_is_repeatable_and_layout_free(pts):
    df = pts(_rows(2000))
    a = sorted(r.id for r in S.bernoulli_sample(df, 0.2, 3).collect())
    b = sorted(r.id for r in S.bernoulli_sample(df.repartition(7), 0.2, 3).collect())
    assert a == b and 250 < len(a) < 550


def test_buckets_in_range(pts):
    got = {r.bucket for r in S.with_bucket(pts(_rows(500)), 6, 1).collect()}
    assert got <= set(range(6)) and len(got) == 6


def test_exact_sample_sizes(pts):
    df = pts(_rows(1000))
    s = S.exact_sample(df, 120, 9, buckets=5).collect()
    assert len(s) == 120 and len({r.id for r in s}) == 120
    assert sorted({r.bucket for r in s}) == list(range(5))
    assert len(S.exact_sample(df, 5000, 9).collect()) == 1000


def test_exact_sample_with_replacement(pts):
    df = pts(_rows(50))
    s = S.exact_sample_replace(df, 400, 2, buckets=4).collect()
    assert len(s) == 400
    assert sorted(r.draw for r in s) == list(range(400))
    assert len({r.id for r in s}) <= 50
    assert all(r.bucket == r.draw % 4 for r in s)


def test_dense_index_is_a_permutation(pts):
    df = pts(_rows(300))
    idx, n = S.dense_index(df, 4)
    assert n == 300
    assert sorted(r.idx for r in idx.collect()) == list(range(300))


def test_uniform_points_in_box(spark):
    box = Box(-8.7, -8.4, 41.0, 42.0)
    rows = S.uniform_points(spark, 500, box, 1).collect()
    assert len(rows) == 500
    assert all(box.min_lon <= r.lon < box.max_lon and box.min_lat <= r.lat < box.max_lat for r in rows)
