"""Registered queries: one Spark builder and (where SQL can say it) one DuckDB twin.

Every query reads the driver tables of one scale-factor directory (trips are derived
from ``orders``) and runs over the whole tables. Computed columns carry the same
alias on both sides; metres are rounded to 3 decimals, sums over many rows to 1,
ratios to 6, so the two engines' last-bit differences do not show.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medoidlab.functions import sqltext as Q
from medoidlab.operators.assign import assign_nearest, cluster_summary
from medoidlab.operators.clean import clean_trips
from medoidlab.sources.trips import trips_from_tables

# Fixed values of the registered queries: the four assignment centres (lon, lat).
FIXED_CENTERS = [(-8.61, 41.15), (-8.58, 41.20), (-8.65, 41.10), (-8.50, 41.30)]
SEED = 42


@dataclass
class Registered:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Registered] = {}


def register(name: str, sql: str | None, doc: str = ""):
    def deco(fn):
        REGISTRY[name] = Registered(fn, sql, doc)
        return fn

    return deco


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_trips(trips_from_tables(spark, sf_dir))


def stored_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned positions written once to the shared checkpoint folder (S4's cleaned
    copy), for queries that run several jobs over them."""
    from medoidlab.session import cut_lineage

    return cut_lineage(positions(spark, sf_dir))


# ---------------------------------------------------------------- J1-J3, A1
_D, _C = Q.nearest_case("lon", "lat", FIXED_CENTERS)


@register(
    "cluster_summary",
    Q.with_positions(
        f"""SELECT cluster, cast(count(*) AS bigint) AS n, round(sum(d), 1) AS sum_dist,
       round(max(d), 3) AS max_dist
FROM (SELECT {_C} AS cluster, {_D} AS d FROM positions)
GROUP BY cluster"""
    ),
    "points per fixed centre with sum and max distance",
)
def q_cluster_summary(spark, sf_dir):
    s = cluster_summary(positions(spark, sf_dir), FIXED_CENTERS)
    return s.select(
        "cluster",
        F.col("n").cast("bigint").alias("n"),
        F.round("sum_dist", 1).alias("sum_dist"),
        F.round("max_dist", 3).alias("max_dist"),
    )


@register(
    "assign_nearest",
    Q.with_positions(f"SELECT id, {_C} AS cluster, round({_D}, 3) AS dist FROM positions"),
    "nearest fixed centre of every cleaned position",
)
def q_assign_nearest(spark, sf_dir):
    a = assign_nearest(positions(spark, sf_dir), FIXED_CENTERS)
    return a.select("id", "cluster", F.round("dist", 3).alias("dist"))


# ---------------------------------------------------------------- S1-S3, P1-P6
from medoidlab.operators.assign import distances_to_centers, objective, objective_many, best_set  # noqa: E402
from medoidlab.operators.clean import filter_call_type, has_track, pickup_point  # noqa: E402
from medoidlab.sources.trips import read_positions, write_positions, write_results  # noqa: E402
from medoidlab.session import scratch_path  # noqa: E402


@register(
    "read_trips_calltype",
    f"WITH {Q.trips_cte()}\nSELECT TRIP_ID, CALL_TYPE, POLYLINE FROM trips "
    "WHERE contains(CALL_TYPE, 'C') AND length(POLYLINE) > 5",
    "P1, P2: call type and track filters on the raw trips",
)
def q_read_trips_calltype(spark, sf_dir):
    t = has_track(filter_call_type(trips_from_tables(spark, sf_dir)))
    return t.select("TRIP_ID", "CALL_TYPE", "POLYLINE")


@register(
    "pickup_points",
    f"WITH {Q.trips_cte()},\n{Q.pickup_cte()}\nSELECT id, lon, lat FROM pickups",
    "P3, P5: first track pair and numeric id, before the box",
)
def q_pickup_points(spark, sf_dir):
    return pickup_point(has_track(filter_call_type(trips_from_tables(spark, sf_dir))))


@register("clean_positions", Q.with_positions("SELECT id, lon, lat FROM positions"), "P1-P5")
def q_clean_positions(spark, sf_dir):
    return positions(spark, sf_dir)


@register(
    "positions_json_roundtrip",
    Q.with_positions("SELECT id, lon, lat FROM positions"),
    "S3 then S2: write cleaned positions as JSON lines and read them back",
)
def q_positions_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "positions-json")
    write_positions(positions(spark, sf_dir), path, fmt="json")
    return read_positions(spark, path, fmt="json")


_CENTERS_SQL = ", ".join(f"({i}, {Q.lit(lon)}, {Q.lit(lat)})" for i, (lon, lat) in enumerate(FIXED_CENTERS))


@register(
    "haversine_pairs",
    Q.with_positions(
        f"""SELECT p.id, c.center_id, round({Q.haversine('p.lon', 'p.lat', 'c.lon', 'c.lat')}, 3) AS dist
FROM positions p, (VALUES {_CENTERS_SQL}) AS c(center_id, lon, lat)"""
    ),
    "P6: distance from every position to every fixed centre",
)
def q_haversine_pairs(spark, sf_dir):
    d = distances_to_centers(positions(spark, sf_dir), FIXED_CENTERS)
    return d.select("id", F.col("center_id").cast("int").alias("center_id"), F.round("dist", 3).alias("dist"))


@register(
    "objective",
    Q.with_positions(f"SELECT round(sum({_D}), 1) AS phi FROM positions"),
    "A1: sum of nearest-centre distances",
)
def q_objective(spark, sf_dir):
    return objective(positions(spark, sf_dir), FIXED_CENTERS).select(F.round("phi", 1).alias("phi"))


# ---------------------------------------------------------------- sampling
from medoidlab.functions.geo import same_place, salt  # noqa: E402
from medoidlab.operators import sampling as S  # noqa: E402
from medoidlab.operators import kmedoids as KM  # noqa: E402

K_DEMO = 4
L_DEMO = 4


def _full_buckets(n: int, k: int = K_DEMO) -> int:
    import math

    return max(1, math.isqrt(n // k))


_L_SQL = f"(SELECT greatest(1, CAST(floor(sqrt(count(*) // {K_DEMO})) AS BIGINT)) FROM positions)"
_KEYED_CTE = f"""keyed AS (
  SELECT id, lon, lat, CAST({Q.hash32('id', salt(SEED, 'bucket'))} % {_L_SQL} AS INTEGER) AS bucket
  FROM positions)"""


@register(
    "hash_bucket",
    Q.with_positions("SELECT id, bucket FROM keyed", _KEYED_CTE),
    "P9: seeded hash bucket in [0, floor(sqrt(n/k)))",
)
def q_hash_bucket(spark, sf_dir):
    p = positions(spark, sf_dir)
    return S.with_bucket(p, _full_buckets(p.count()), SEED).select("id", "bucket")


@register(
    "bernoulli_sample",
    Q.with_positions(f"SELECT id, lon, lat FROM positions WHERE {Q.hash_unit('id', salt(SEED, 'keep'))} < 0.1"),
    "N1: seeded 10% Bernoulli sample",
)
def q_bernoulli_sample(spark, sf_dir):
    return S.bernoulli_sample(positions(spark, sf_dir), 0.1, SEED)


@register(
    "bucketed_sample",
    Q.with_positions(
        f"""SELECT id, CAST({Q.hash32('id', salt(SEED, 'bucket'))} % {L_DEMO} AS INTEGER) AS bucket FROM positions
WHERE {Q.hash_unit('id', salt(SEED, 'keep'))} < least(1.0, {L_DEMO} / sqrt((SELECT count(*) FROM positions)))"""
    ),
    "N2 + P9: sample at l/sqrt(n) into l buckets (l = 4)",
)
def q_bucketed_sample(spark, sf_dir):
    return S.bucketed_sample(positions(spark, sf_dir), L_DEMO, SEED).select("id", "bucket")


_EXACT = 5 * (40 + 2 * K_DEMO)


@register(
    "exact_sample",
    Q.with_positions(
        f"""SELECT id, lon, lat, CAST(rn - 1 AS BIGINT) AS draw, CAST((rn - 1) % 5 AS INTEGER) AS bucket FROM (
  SELECT id, lon, lat, row_number() OVER (ORDER BY h, id) AS rn FROM (
    SELECT id, lon, lat, {Q.hash32('id', salt(SEED, 'order'))} AS h FROM positions))
WHERE rn <= {_EXACT}"""
    ),
    "N4 + P10: exactly 5*(40+2k) rows without replacement, round-robin into 5 buckets",
)
def q_exact_sample(spark, sf_dir):
    return S.exact_sample(positions(spark, sf_dir), _EXACT, SEED, buckets=5)


_DRAWS = 100 * 4


def _hash60_sql(expr: str, s: str) -> str:
    return f"cast('0x' || substr(md5(concat(cast({expr} as varchar), '{s}')), 1, 15) as bigint)"


@register(
    "exact_sample_replace",
    Q.with_positions(
        """SELECT CAST(d.draw AS BIGINT) AS draw, CAST(d.draw % 4 AS INTEGER) AS bucket, i.id, i.lon, i.lat
FROM draws d JOIN idx i ON d.idx = i.idx""",
        f"""idx AS (
  SELECT id, lon, lat, row_number() OVER (ORDER BY {Q.hash32('id', salt(SEED, 'order'))}, id) - 1 AS idx
  FROM positions)""",
        f"""draws AS (
  SELECT range AS draw, {_hash60_sql('range', salt(SEED, 'draw'))} % (SELECT count(*) FROM positions) AS idx
  FROM range({_DRAWS}))""",
    ),
    "N3 + P10: 4 x 100 draws with replacement by dense hash-order index",
)
def q_exact_sample_replace(spark, sf_dir):
    out = S.exact_sample_replace(positions(spark, sf_dir), _DRAWS, SEED, buckets=4)
    return out.select("draw", "bucket", "id", "lon", "lat")


@register(
    "uniform_points",
    Q.with_positions(
        f"""SELECT range AS id,
       round({Q.lit(-8.7)} + {Q.hash_unit('range', salt(SEED, 'ulon'))} * {Q.lit(0.3000000000000007)}, 9) AS lon,
       round({Q.lit(41.0)} + {Q.hash_unit('range', salt(SEED, 'ulat'))} * {Q.lit(1.0)}, 9) AS lat
FROM range((SELECT count(*) FROM positions))"""
    ),
    "N6: as many hash-uniform points in the cleaning box as there are positions",
)
def q_uniform_points(spark, sf_dir):
    from medoidlab.schema import CLEAN_BOX

    n = positions(spark, sf_dir).count()
    u = S.uniform_points(spark, n, CLEAN_BOX, SEED)
    return u.select("id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


# ---------------------------------------------------------------- T1-T3
@register(
    "distinct_places",
    Q.with_positions("SELECT lon, lat, CAST(count(*) AS BIGINT) AS n, min(id) AS id FROM positions GROUP BY lon, lat"),
    "T2/T3: distinct places (id ignored) with their row counts",
)
def q_distinct_places(spark, sf_dir):
    p = positions(spark, sf_dir)
    return p.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))


@register(
    "not_in_cluster",
    Q.with_positions(
        f"""SELECT cluster, CAST((SELECT count(*) FROM positions) - count(*) AS BIGINT) AS n_not_in
FROM (SELECT {_C} AS cluster FROM positions) GROUP BY cluster"""
    ),
    "T1: rows outside each cluster (difference by cluster, no shuffle of rows)",
)
def q_not_in_cluster(spark, sf_dir):
    from pyspark.sql import Window

    a = assign_nearest(positions(spark, sf_dir), FIXED_CENTERS)
    c = a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return c.select("cluster", (tot - F.col("n")).cast("bigint").alias("n_not_in"))


# ---------------------------------------------------------------- C2, C22, C1, A2, A10
def _keyed(spark, sf_dir, p: DataFrame | None = None) -> DataFrame:
    if p is None:
        p = stored_positions(spark, sf_dir)
    return S.with_bucket(p, _full_buckets(p.count()), SEED)


_HAV_PI = Q.haversine("p.lon", "p.lat", "i.lon", "i.lat")
_PAM_CTES = (
    _KEYED_CTE,
    """pl AS (SELECT bucket, lon, lat, CAST(count(*) AS BIGINT) AS w, min(id) AS id FROM keyed GROUP BY bucket, lon, lat)""",
    f"""init AS (
  SELECT bucket, CAST(rn - 1 AS INTEGER) AS center_id, id, lon, lat FROM (
    SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY id) AS rn,
           count(*) OVER (PARTITION BY bucket) AS np FROM pl)
  WHERE rn <= {K_DEMO} AND np >= {K_DEMO})""",
)
_STEP_CTES = _PAM_CTES + (
    f"""pm AS (SELECT p.bucket, p.id AS pid, p.w, i.center_id AS slot, {_HAV_PI} AS d
  FROM pl p JOIN init i ON p.bucket = i.bucket)""",
    """rk AS (SELECT *, row_number() OVER (PARTITION BY bucket, pid ORDER BY d, slot) AS r FROM pm)""",
    """nn AS (SELECT bucket, pid, any_value(w) AS w, max(CASE WHEN r = 1 THEN d END) AS d1,
  max(CASE WHEN r = 2 THEN d END) AS d2, max(CASE WHEN r = 1 THEN slot END) AS near FROM rk GROUP BY bucket, pid)""",
    """cand AS (SELECT c.* FROM pl c WHERE c.bucket IN (SELECT bucket FROM init)
  AND NOT EXISTS (SELECT 1 FROM init i WHERE i.bucket = c.bucket AND i.id = c.id))""",
    f"""costs AS (
  SELECT c.bucket, c.id AS cand_id, CAST(s.range AS INTEGER) AS slot,
         sum(n.w * least({Q.haversine('pp.lon', 'pp.lat', 'c.lon', 'c.lat')},
                         CASE WHEN n.near = s.range THEN n.d2 ELSE n.d1 END)) AS phi
  FROM cand c JOIN pl pp ON pp.bucket = c.bucket JOIN nn n ON n.bucket = pp.bucket AND n.pid = pp.id
  CROSS JOIN range({K_DEMO}) s
  GROUP BY c.bucket, c.id, s.range)""",
    """phi0 AS (SELECT bucket, sum(w * d1) AS phi_before FROM nn GROUP BY bucket)""",
)


@register(
    "pam_init",
    Q.with_positions("SELECT bucket, center_id, id, lon, lat FROM init", *_PAM_CTES),
    "C2: first k distinct places per bucket in id order",
)
def q_pam_init(spark, sf_dir):
    return KM.pam_init(_keyed(spark, sf_dir), K_DEMO)


_SET_PHI = f"""setphi AS (
  SELECT set_id, sum(d) AS phi FROM (
    SELECT i.bucket AS set_id, p.id, min({_HAV_PI}) AS d FROM positions p CROSS JOIN init i GROUP BY i.bucket, p.id)
  GROUP BY set_id)"""


@register(
    "objective_many",
    Q.with_positions("SELECT set_id, round(phi, 1) AS phi FROM setphi", *_PAM_CTES, _SET_PHI),
    "A2: phi on all positions of every bucket's initial medoid set, one pass",
)
def q_objective_many(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    init = KM.pam_init(_keyed(spark, sf_dir, p), K_DEMO).withColumnRenamed("bucket", "set_id")
    out = objective_many(p, init)
    return out.select("set_id", F.round("phi", 1).alias("phi"))


@register(
    "clara_select",
    Q.with_positions(
        "SELECT set_id, round(phi, 1) AS phi FROM setphi ORDER BY phi, set_id LIMIT 1", *_PAM_CTES, _SET_PHI
    ),
    "A10/C11: the centre set with the lowest phi on the whole data",
)
def q_clara_select(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    init = KM.pam_init(_keyed(spark, sf_dir, p), K_DEMO).withColumnRenamed("bucket", "set_id")
    best = best_set(objective_many(p, init))
    return best.select("set_id", F.round("phi", 1).alias("phi"))


@register(
    "swap_cost",
    Q.with_positions("SELECT bucket, cand_id, slot, round(phi, 1) AS phi FROM costs", *_STEP_CTES),
    "C22: phi after each (candidate, slot) swap from the initial medoids, per bucket",
)
def q_swap_cost(spark, sf_dir):
    c = KM.swap_cost(_keyed(spark, sf_dir), K_DEMO)
    return c.select("bucket", "cand_id", "slot", F.round("phi", 1).alias("phi"))


@register(
    "pam_swap_step",
    Q.with_positions(
        """SELECT b.bucket, round(p.phi_before, 1) AS phi_before, round(b.phi, 1) AS phi_after, b.cand_id, b.slot,
       (b.phi < p.phi_before - 1e-6) AS improves
FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY phi, cand_id, slot) AS r FROM costs) b
JOIN phi0 p ON p.bucket = b.bucket WHERE b.r = 1""",
        *_STEP_CTES,
    ),
    "C1: the best single PAM swap of every bucket from its initial medoids",
)
def q_pam_swap_step(spark, sf_dir):
    s = KM.pam_swap_step(_keyed(spark, sf_dir), K_DEMO)
    return s.select(
        "bucket",
        F.round("phi_before", 1).alias("phi_before"),
        F.round("phi_after", 1).alias("phi_after"),
        "cand_id",
        "slot",
        "improves",
    )


@register(
    "pam_optimality",
    Q.with_positions(
        "SELECT CAST(0 AS BIGINT) AS improvable_buckets, count(DISTINCT bucket) AS buckets_solved, "
        "count(*) AS centers FROM init",
        *_PAM_CTES,
    ),
    "C4 check: buckets solved, their centres, and those where a swap still improves the result (0)",
)
def q_pam_optimality(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return KM.pam_optimality(p, K_DEMO, _full_buckets(p.count()), SEED)


# ---------------------------------------------------------------- J4, E1-E3
from medoidlab.operators import evaluate as EV  # noqa: E402
from medoidlab.operators.neighbors import nearest_neighbor  # noqa: E402
from medoidlab.operators import raster as RA  # noqa: E402

_HAV_PQ = Q.haversine("p.lon", "p.lat", "q.lon", "q.lat")


@register(
    "nearest_neighbor",
    Q.with_positions(
        f"""SELECT p.id, round(min(CASE WHEN {_HAV_PQ} > 0 THEN {_HAV_PQ} END), 3) AS nn_dist
FROM positions p, positions q GROUP BY p.id"""
    ),
    "J4: distance from every position to its nearest other place (distance > 0)",
)
def q_nearest_neighbor(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return nearest_neighbor(p, p).select("id", F.round("nn_dist", 3).alias("nn_dist"))


_UNI_CTES = (
    "box AS (SELECT min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS d FROM positions)",
    f"""uni AS (SELECT range AS id,
    box.a + {Q.hash_unit('range', salt(SEED, 'ulon'))} * (box.b - box.a) AS lon,
    box.c + {Q.hash_unit('range', salt(SEED, 'ulat'))} * (box.d - box.c) AS lat
  FROM range((SELECT count(*) FROM positions)), box)""",
    f"""w AS (SELECT sum(nn) AS w FROM (SELECT p.id, min(CASE WHEN {_HAV_PQ} > 0 THEN {_HAV_PQ} END) AS nn
  FROM positions p, positions q GROUP BY p.id))""",
    f"""u AS (SELECT sum(nn) AS u FROM (SELECT p.id, min(CASE WHEN {_HAV_PQ} > 0 THEN {_HAV_PQ} END) AS nn
  FROM uni p, positions q GROUP BY p.id))""",
)


@register(
    "hopkins",
    Q.with_positions("SELECT round(w, 1) AS w, round(u, 1) AS u, round(w / (w + u), 6) AS hopkins FROM w, u", *_UNI_CTES),
    "E2: Hopkins statistic of all positions, uniform points in the data's own box",
)
def q_hopkins(spark, sf_dir):
    h = EV.hopkins(stored_positions(spark, sf_dir), seed=SEED)
    return h.select(F.round("w", 1).alias("w"), F.round("u", 1).alias("u"), F.round("hopkins", 6).alias("hopkins"))


def _silhouette_sql(mode: str) -> str:
    ctes = (
        f"asg AS (SELECT id, lon, lat, {_C} AS cluster FROM positions)",
        "sz AS (SELECT cluster, count(*) AS size FROM asg GROUP BY cluster)",
        f"""s AS (SELECT p.id AS pid, p.cluster AS own, q.cluster, sum({_HAV_PQ}) AS s
  FROM asg p, asg q GROUP BY p.id, p.cluster, q.cluster)""",
        f"""g AS (SELECT pid, own, max(CASE WHEN s.cluster = own THEN size END) AS size,
  max(CASE WHEN s.cluster = own THEN s END) AS s_own,
  min(CASE WHEN s.cluster <> own THEN {'s / size' if mode == 'standard' else 's'} END) AS b_raw
  FROM s JOIN sz ON s.cluster = sz.cluster GROUP BY pid, own)""",
        (
            """ab AS (SELECT *, CASE WHEN size > 1 THEN s_own / (size - 1) ELSE 0.0 END AS a, b_raw AS b FROM g)"""
            if mode == "standard"
            else """ab AS (SELECT *, s_own / size AS a, b_raw / size AS b FROM g)"""
        ),
        f"""pt AS (SELECT CASE WHEN {'size <= 1 OR ' if mode == 'standard' else ''}b IS NULL OR greatest(a, b) = 0 THEN 0.0
  ELSE (b - a) / greatest(a, b) END AS sil FROM ab)""",
    )
    return Q.with_positions("SELECT round(avg(sil), 6) AS silhouette FROM pt", *ctes)


@register("silhouette", _silhouette_sql("standard"), "E1: mean silhouette of all positions, fixed centres")
def q_silhouette(spark, sf_dir):
    s = EV.silhouette(stored_positions(spark, sf_dir), FIXED_CENTERS, mode="standard")
    return s.select(F.round("silhouette", 6).alias("silhouette"))


@register(
    "silhouette_own_size",
    _silhouette_sql("own_size"),
    "E1, as-written formula: sums divided by the own cluster size",
)
def q_silhouette_own_size(spark, sf_dir):
    s = EV.silhouette(stored_positions(spark, sf_dir), FIXED_CENTERS, mode="own_size")
    return s.select(F.round("silhouette", 6).alias("silhouette"))


@register(
    "radius_stats",
    Q.with_positions(
        f"""SELECT round(avg(r), 3) AS mean_radius, round(stddev_samp(r), 3) AS std_radius,
       CAST(count(*) AS BIGINT) AS clusters
FROM (SELECT cluster, max(d) AS r FROM (SELECT {_C} AS cluster, {_D} AS d FROM positions) GROUP BY cluster)"""
    ),
    "E3/A6/A7: mean and deviation of the largest cluster radius",
)
def q_radius_stats(spark, sf_dir):
    r = EV.radius_stats(positions(spark, sf_dir), FIXED_CENTERS)
    return r.select(
        F.round("mean_radius", 3).alias("mean_radius"),
        F.round("std_radius", 3).alias("std_radius"),
        F.col("clusters").cast("bigint").alias("clusters"),
    )


# ---------------------------------------------------------------- R3-R6, P11-P13, A13, A14
_PX = f"{Q.pixel_x('lon')} AS x, {Q.pixel_y('lat')} AS y"
_INSIDE = "x >= 0 AND x < 2000 AND y >= 0 AND y < 2000"


@register(
    "raster",
    Q.with_positions(
        f"""SELECT x, y, CAST(0 AS INTEGER) AS cluster, CAST(count(*) AS BIGINT) AS n
FROM (SELECT {_PX} FROM positions) WHERE {_INSIDE} GROUP BY x, y"""
    ),
    "R3: whole-dataset picture as pixel counts (2000 x 2000, image box)",
)
def q_raster(spark, sf_dir):
    return RA.raster(positions(spark, sf_dir))


def _color_sql(cluster: str, k: int) -> tuple[str, str, str]:
    from medoidlab.functions.geo import color_cube_side

    side = color_cube_side(k)
    if side == 1:
        return "255", "255", "255"
    step = side**3 // (k + 1)
    pos = f"CAST(({cluster} + 1) * {step} AS DOUBLE)"
    s = f"{float(side)!r}"
    return (
        f"CAST(floor(({pos} % {s}) / {s} * 255.0) AS INTEGER)",
        f"CAST(floor((({pos} / {s}) % {s}) / {s} * 255.0) AS INTEGER)",
        f"CAST(floor((({pos} / {s} / {s}) % {s}) / {s} * 255.0) AS INTEGER)",
    )


_R, _G, _B = _color_sql("cluster", len(FIXED_CENTERS))


@register(
    "raster_clusters",
    Q.with_positions(
        f"""SELECT x, y, cluster, CAST(count(*) AS BIGINT) AS n, {_R} AS r, {_G} AS g, {_B} AS b
FROM (SELECT {_PX}, {_C} AS cluster FROM positions) WHERE {_INSIDE} GROUP BY x, y, cluster"""
    ),
    "R4 + P12: clustering picture, pixel counts per cluster with the cluster colour",
)
def q_raster_clusters(spark, sf_dir):
    r = RA.raster(positions(spark, sf_dir), FIXED_CENTERS)
    return RA.cluster_colors(r, len(FIXED_CENTERS))


@register(
    "cluster_color",
    Q.with_positions(
        f"""SELECT cluster, CAST(count(*) AS BIGINT) AS n, {_R} AS r, {_G} AS g, {_B} AS b
FROM (SELECT {_C} AS cluster FROM positions) GROUP BY cluster"""
    ),
    "P12: colour of every cluster present in the assignment",
)
def q_cluster_color(spark, sf_dir):
    a = assign_nearest(positions(spark, sf_dir), FIXED_CENTERS)
    c = a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return RA.cluster_colors(c, len(FIXED_CENTERS))


@register(
    "raster_dropped",
    Q.with_positions(
        f"""SELECT reason, n, n / (SELECT count(*) FROM positions) AS share FROM (
  SELECT concat_ws(' ', CASE WHEN lon < -8.7 THEN 'west' END,
                        CASE WHEN lon > -8.4 THEN 'east' END,
                        CASE WHEN lat > 41.35 THEN 'north' END,
                        CASE WHEN lat < 41.05 THEN 'south' END) AS reason,
         CAST(count(*) AS BIGINT) AS n
  FROM (SELECT lon, lat, {_PX} FROM positions) WHERE NOT ({_INSIDE}) GROUP BY reason)"""
    ),
    "A13: points outside the picture by reason and share",
)
def q_raster_dropped(spark, sf_dir):
    return RA.raster_dropped(positions(spark, sf_dir))


@register(
    "raster_centers",
    Q.with_positions(
        f"""SELECT center_id, xc, yc, CAST(sum(CASE WHEN {_INSIDE} THEN 1 ELSE 0 END) AS BIGINT) AS drawn,
       CAST(sum(CASE WHEN {_INSIDE} THEN 0 ELSE 1 END) AS BIGINT) AS dropped,
       CASE WHEN bool_and({_INSIDE}) THEN 'inside' WHEN bool_or({_INSIDE}) THEN 'cut' ELSE 'outside' END AS status
FROM (SELECT center_id, xc, yc, unnest(range(xc - 5, xc + 5)) AS x FROM (
        SELECT bucket * {K_DEMO} + center_id AS center_id, {Q.pixel_x('lon')} AS xc, {Q.pixel_y('lat')} AS yc FROM init)) xs,
     LATERAL (SELECT unnest(range(xs.yc - 5, xs.yc + 5)) AS y)
GROUP BY center_id, xc, yc""",
        *_PAM_CTES,
    ),
    "R5: square of every initial medoid (all buckets) on the picture: drawn/dropped pixels",
)
def q_raster_centers(spark, sf_dir):
    return RA.raster_centers(_initial_centers(spark, sf_dir), spark)


def _initial_centers(spark, sf_dir) -> DataFrame:
    init = KM.pam_init(_keyed(spark, sf_dir), K_DEMO)
    return init.select((F.col("bucket") * K_DEMO + F.col("center_id")).cast("int").alias("center_id"), "lon", "lat")


@register(
    "center_pixels",
    Q.with_positions(
        f"""SELECT center_id, x, y
FROM (SELECT center_id, yc, unnest(range(xc - 5, xc + 5)) AS x FROM (
        SELECT bucket * {K_DEMO} + center_id AS center_id, {Q.pixel_x('lon')} AS xc, {Q.pixel_y('lat')} AS yc FROM init)) xs,
     LATERAL (SELECT unnest(range(xs.yc - 5, xs.yc + 5)) AS y)
WHERE {_INSIDE}""",
        *_PAM_CTES,
    ),
    "R5: every drawn pixel of the squares of all initial medoids",
)
def q_center_pixels(spark, sf_dir):
    px = RA.center_pixels(_initial_centers(spark, sf_dir), spark)
    return px.select("center_id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))


# ---------------------------------------------------------------- C4-C26: seeded searches
from medoidlab.plans import search_sql as SQ  # noqa: E402
from medoidlab.operators import kmeans as KMM  # noqa: E402
from medoidlab.plans.sweep import drawn, results_wide, sweep  # noqa: E402
from medoidlab.schema import ALG_CLARA, ALGORITHM_NAMES, KMEANS_ITERATIONS  # noqa: E402


def _scored(p: DataFrame, centers: DataFrame) -> DataFrame:
    """Centres with the whole-data phi attached (k rows)."""
    from medoidlab.operators.assign import objective_value

    cl = centers.select("center_id", "lon", "lat").collect()
    phi = objective_value(p, [(int(r[0]), float(r[1]), float(r[2])) for r in cl])
    kept = [c for c in ("center_id", "id", "lon", "lat") if c in centers.columns]
    return centers.select(*kept).withColumn("phi", F.round(F.lit(phi), 1))


_FULL, _REDUCED = SQ.full(K_DEMO, SEED), SQ.reduced(L_DEMO, SEED)


@register("pam", SQ.pam_sql(_REDUCED[0], K_DEMO), "C6 + C7: PAM on a 4-bucket hash sample, merged by PAM; k = 4")
def q_pam(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return _scored(p, KM.pam(p, K_DEMO, buckets=L_DEMO, seed=SEED))


@register("pam_full", SQ.pam_sql(_FULL[0], K_DEMO), "C5 + C7: PAM on all rows in floor(sqrt(n/k)) buckets, merged by PAM")
def q_pam_full(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return _scored(p, KM.pam(p, K_DEMO, seed=SEED))


@register("clara", SQ.clara_sql(_REDUCED[0], K_DEMO), "C9: CLARA on a 4-bucket hash sample (the shipped demo setting)")
def q_clara(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return _scored(p, KM.clara(p, K_DEMO, buckets=L_DEMO, seed=SEED))


@register("clara_full", SQ.clara_sql(_FULL[0], K_DEMO), "C8: CLARA over all rows in floor(sqrt(n/k)) buckets")
def q_clara_full(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return _scored(p, KM.clara(p, K_DEMO, seed=SEED))


@register("clara_samples", SQ.clara_sql(SQ.drawn_again(100, 4, SEED), K_DEMO), "C10: CLARA on 4 exact samples of 100 rows drawn with replacement")
def q_clara_samples(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return _scored(p, KM.clara(p, K_DEMO, sample_size=100, n_samples=4, seed=SEED))


@register("clarafast", SQ.clara_sql(SQ.drawn(_EXACT, 5, SEED), K_DEMO), "C12: CLARAFAST, 5 exact samples of 40 + 2k rows")
def q_clarafast(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return _scored(p, KM.clarafast(p, K_DEMO, seed=SEED))


@register("clarans", SQ.clarans_sql(_FULL, K_DEMO, 3, SEED), "C13 + C15: CLARANS on all rows, 3 local searches, merged by CLARANS")
def q_clarans(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return _scored(p, KM.clarans(p, K_DEMO, nlocal=3, seed=SEED))


_KMEANS_CTES = SQ.kmeans_ctes(K_DEMO, SEED, KMM.INIT_STEPS, KMM.OVERSAMPLE, KMM.TOLERANCE, KMEANS_ITERATIONS)


@register("kmeans", SQ.kmeans_sql(_KMEANS_CTES), "C23 + C25: k-means|| (60 iterations) centres scored with haversine phi")
def q_kmeans(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    scored = _scored(p, KMM.kmeans(p, K_DEMO, seed=SEED))
    return scored.withColumns({c: F.round(c, 9) for c in ("lon", "lat")})


@register(
    "position_vectors",
    Q.with_positions("SELECT id, lon, lat FROM positions"),
    "P8: every position as a vector and back",
)
def q_position_vectors(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    v = KMM.features(positions(spark, sf_dir)).select("id", vector_to_array("features").alias("v"))
    return v.select("id", F.col("v")[0].alias("lon"), F.col("v")[1].alias("lat"))


@register("sweep", SQ.sweep_sql([4, 5, 6], L_DEMO, SEED), "C26: the shipped sweep, CLARA for k = 4..6 with 4 buckets")
def q_sweep(spark, sf_dir):
    r = sweep(stored_positions(spark, sf_dir), 4, 6, 1, ALG_CLARA, seed=SEED)
    return r.select("k", "algorithm", F.round("phi", 1).alias("phi"), F.size("centers").alias("n_centers"))


@register(
    "medoids_are_points",
    Q.with_positions(
        "SELECT algorithm, CAST(0 AS BIGINT) AS not_points, "
        f"CAST(least({K_DEMO}, (SELECT count(*) FROM (SELECT DISTINCT lon, lat FROM positions))) AS BIGINT) AS centers "
        "FROM (VALUES ('PAM'), ('CLARA'), ('CLARAFAST'), ('CLARANS')) AS t(algorithm)"
    ),
    "C4-C16 check: distinct centres of every k-medoid search, and those that are no input place (0)",
)
def q_medoids_are_points(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    runs = {
        "PAM": KM.pam(p, K_DEMO, buckets=L_DEMO, seed=SEED),
        "CLARA": KM.clara(p, K_DEMO, buckets=L_DEMO, seed=SEED),
        "CLARAFAST": KM.clarafast(p, K_DEMO, seed=SEED),
        "CLARANS": KM.clarans(p, K_DEMO, nlocal=3, seed=SEED),
    }
    out = None
    for name, c in runs.items():
        known = p.select("lon", "lat").distinct().withColumn("known", F.lit(1))
        found = c.select("lon", "lat").distinct().join(known, ["lon", "lat"], "left")
        one = found.agg(
            F.count(F.when(F.col("known").isNull(), 1)).cast("bigint").alias("not_points"),
            F.count(F.lit(1)).cast("bigint").alias("centers"),
        ).select(F.lit(name).alias("algorithm"), "not_points", "centers")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "kmeans_radius_stats", SQ.kmeans_radius_sql(_KMEANS_CTES), "E3 on a k-means model: planar assignment, radii in metres"
)
def q_kmeans_radius_stats(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    r = EV.radius_stats(p, KMM.kmeans_centers(p, K_DEMO, seed=SEED), metric="planar")
    return r.select(F.round("mean_radius", 3).alias("mean_radius"), F.round("std_radius", 3).alias("std_radius"),
                    F.col("clusters").cast("bigint").alias("clusters"))


@register(
    "raster_kmeans",
    SQ.kmeans_raster_sql(_KMEANS_CTES, K_DEMO, _INSIDE, _color_sql),
    "R4 + C24 with a k-means model: pixels coloured by the model's planar prediction",
)
def q_raster_kmeans(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    cs = KMM.kmeans_centers(p, K_DEMO, seed=SEED)
    return RA.cluster_colors(RA.raster(p, cs, assign="planar"), K_DEMO)


# ---------------------------------------------------------------- C26 drawings, R1, S5, S6
_SWEEP_KS = [4, 5, 6]


def _sweep(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return p, sweep(p, 4, 6, 1, ALG_CLARA, seed=SEED)


@register(
    "sweep_rasters",
    SQ.sweep_pixels_sql(_SWEEP_KS, L_DEMO, SEED, _INSIDE, _color_sql),
    "C26 + R4: the drawings of every run of the shipped sweep, one pass",
)
def q_sweep_rasters(spark, sf_dir):
    return drawn(*_sweep(spark, sf_dir)).pixels


@register(
    "sweep_centers",
    SQ.sweep_centers_sql(_SWEEP_KS, L_DEMO, SEED, _INSIDE),
    "C26 + R5: the centre squares of every run of the shipped sweep",
)
def q_sweep_centers(spark, sf_dir):
    return drawn(*_sweep(spark, sf_dir)).centers


_WIDE_SQL = SQ.wide_sql(_SWEEP_KS, L_DEMO, SEED, {str(b): n for b, n in ALGORITHM_NAMES.items()}, 6)


def _plain(wide: DataFrame) -> DataFrame:
    """Wide results without the time, numbers in fixed notation."""
    places = [c for c in wide.columns if c.startswith(("lat_", "lon_"))]

    def fixed(c: str, digits: int):
        number = F.col(c).try_cast("double")
        return F.coalesce(F.format_string(f"%.{digits}f", F.when(number.isNotNull(), number)), F.lit("NULL"))

    return wide.select(
        "k",
        "algorithm",
        F.when(F.col("phi") == "NULL", "NULL").otherwise(fixed("phi", 1)).alias("phi"),
        *[F.when(F.col(c) == "NULL", "NULL").otherwise(fixed(c, 6)).alias(c) for c in places],
    )


@register("results_wide", _WIDE_SQL, "R1: the results of the shipped sweep in the wide form, padded")
def q_results_wide(spark, sf_dir):
    return _plain(results_wide(_sweep(spark, sf_dir)[1]))


@register("results_append", _WIDE_SQL, "S5: result rows appended to one CSV folder run by run, read back")
def q_results_append(spark, sf_dir):
    path = scratch_path(spark, "results-append")
    _, results = _sweep(spark, sf_dir)
    for k in _SWEEP_KS:
        write_results(results.where(F.col("k") == k), path, max_k=max(_SWEEP_KS))
    return _plain(spark.read.option("header", True).csv(path))


@register("results_overwrite", _WIDE_SQL, "S6: a CSV of other rows overwritten by the results, read back")
def q_results_overwrite(spark, sf_dir):
    path = scratch_path(spark, "results-overwrite")
    _, results = _sweep(spark, sf_dir)
    write_results(results.where("k = 4"), path)
    write_results(results, path, mode="overwrite")
    return _plain(spark.read.option("header", True).csv(path))


from medoidlab.schema import ALPHA_CLUSTERING  # noqa: E402


def _blend_sql(channel: str) -> str:
    step = f"CAST(floor(CAST(a AS DOUBLE) * {1.0 - ALPHA_CLUSTERING!r}e0 + CAST(v AS DOUBLE) * {ALPHA_CLUSTERING!r}e0) AS INTEGER)"
    return f"list_reduce(list_prepend(0, list({channel} ORDER BY cluster)), lambda a, v: {step}) AS {channel}"


@register(
    "pixel_colors",
    Q.with_positions(
        f"SELECT x, y, {_blend_sql('r')}, {_blend_sql('g')}, {_blend_sql('b')} FROM ("
        f"SELECT x, y, cluster, {_R} AS r, {_G} AS g, {_B} AS b FROM (SELECT {_PX}, {_C} AS cluster FROM positions) "
        f"WHERE {_INSIDE}) GROUP BY x, y"
    ),
    "A14: blended pixel colours of the clustering picture (alpha 0.6)",
)
def q_pixel_colors(spark, sf_dir):
    r = RA.raster(positions(spark, sf_dir), FIXED_CENTERS)
    return RA.pixel_colors(r, len(FIXED_CENTERS))


@register("clarans_reduced", SQ.clarans_sql(_REDUCED, K_DEMO, 3, SEED), "C14: CLARANS on a 4-bucket hash sample, merged by CLARANS")
def q_clarans_reduced(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return _scored(p, KM.clarans(p, K_DEMO, buckets=L_DEMO, nlocal=3, seed=SEED))


# ---------------------------------------------------------------- J1, A1 with many centres
_HALF = f"{Q.hash_unit('id', salt(SEED, 'half'))} < 0.5"
_HALF_CTE = f"many AS (SELECT CAST(id AS INTEGER) AS center_id, lon, lat FROM positions WHERE {_HALF})"
_HAV_PC = Q.haversine("p.lon", "p.lat", "c.lon", "c.lat")


def _many_centers(p: DataFrame) -> DataFrame:
    """About half of all positions as centres, numbered by their id."""
    half = S.hash_unit("id", salt(SEED, "half")) < F.lit(0.5)
    return p.where(half).select(F.col("id").cast("int").alias("center_id"), "lon", "lat")


@register(
    "assign_many_centers",
    Q.with_positions(
        f"""SELECT p.id, arg_min(c.center_id, ({_HAV_PC}, c.center_id)) AS cluster, round(min({_HAV_PC}), 3) AS dist
FROM positions p CROSS JOIN many c GROUP BY p.id""",
        _HALF_CTE,
    ),
    "J1 with half of the positions as centres, through the centre index",
)
def q_assign_many_centers(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return assign_nearest(p, _many_centers(p)).select("id", "cluster", F.round("dist", 3).alias("dist"))


@register(
    "objective_many_centers",
    Q.with_positions(
        f"SELECT round(sum(d), 1) AS phi FROM (SELECT p.id, min({_HAV_PC}) AS d FROM positions p CROSS JOIN many c GROUP BY p.id)",
        _HALF_CTE,
    ),
    "A1 with half of the positions as centres, through the centre index",
)
def q_objective_many_centers(spark, sf_dir):
    p = stored_positions(spark, sf_dir)
    return objective(p, _many_centers(p)).select(F.round("phi", 1).alias("phi"))


# ---------------------------------------------------------------- S1, S4
from medoidlab.sources.trips import load_positions, read_trips  # noqa: E402


def _trips_csv(spark, sf_dir) -> str:
    """All derived trips as CSV under the shared folder, columns in another order."""
    path = scratch_path(spark, "trips-csv")
    t = trips_from_tables(spark, sf_dir)
    t.select(*reversed(t.columns)).write.option("header", True).csv(path)
    return path


@register(
    "read_trips_csv",
    f"WITH {Q.trips_cte()}\nSELECT TRIP_ID, CALL_TYPE, POLYLINE FROM trips",
    "S1: trips written as CSV in another column order, read back by header name",
)
def q_read_trips_csv(spark, sf_dir):
    return read_trips(spark, _trips_csv(spark, sf_dir)).select("TRIP_ID", "CALL_TYPE", "POLYLINE")


@register(
    "load_positions",
    Q.with_positions("SELECT id, lon, lat FROM positions"),
    "S4: raw CSV cleaned and saved by the first call, the saved copy read by the second",
)
def q_load_positions(spark, sf_dir):
    raw, copy = _trips_csv(spark, sf_dir), scratch_path(spark, "positions-copy")
    load_positions(spark, raw, copy)
    return load_positions(spark, raw, copy)


# ---------------------------------------------------------------- repeated ids, hot places, clusters
# Four blobs on a 0.001-degree grid (offsets that carry the grid to each blob's place) and
# one place that a fifth of the rows share; ten rows of an id range share one id.
_BLOB_LON = "CASE id % 4 WHEN 0 THEN -7.765e0 WHEN 1 THEN -7.725e0 WHEN 2 THEN -7.795e0 ELSE -7.645e0 END"
_BLOB_LAT = "CASE id % 4 WHEN 0 THEN 37.0325e0 WHEN 1 THEN 37.0825e0 WHEN 2 THEN 36.9825e0 ELSE 37.1825e0 END"
_BLOBS = {
    "rid": "id",
    "id": "CAST(floor(id / 10) AS BIGINT)",
    "lon": f"CASE WHEN id % 5 = 0 THEN -8.6e0 ELSE {_BLOB_LON} + floor(lon * 1e2) / 1e3 END",
    "lat": f"CASE WHEN id % 5 = 0 THEN 41.15e0 ELSE {_BLOB_LAT} + floor(lat * 1e2) / 1e3 END",
}
_BLOBS_CTE = f"blobs AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _BLOBS.items())} FROM positions)"


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned positions moved onto the blobs, with repeated ids and places (stored,
    so that later expressions do not repeat the long ones here)."""
    from medoidlab.session import cut_lineage

    p = positions(spark, sf_dir)
    return cut_lineage(p.select(*[F.expr(v).alias(k) for k, v in _BLOBS.items() if k != "rid"]))


_NEAR_BLOB = f"min(CASE WHEN {_HAV_PQ} > 0 THEN {_HAV_PQ} END) AS nn"
_PLACES_CTE = "pl AS (SELECT lon, lat, count(*) AS w FROM blobs GROUP BY lon, lat)"


@register(
    "nearest_neighbor_blobs",
    Q.with_positions(
        f"""SELECT b.id, b.lon, b.lat, round(n.nn, 3) AS nn_dist FROM blobs b JOIN (
  SELECT p.lon, p.lat, {_NEAR_BLOB} FROM pl p, pl q GROUP BY p.lon, p.lat) n ON b.lon = n.lon AND b.lat = n.lat""",
        _BLOBS_CTE,
        _PLACES_CTE,
    ),
    "J4 where ids repeat, places are hot and points are clustered",
)
def q_nearest_neighbor_blobs(spark, sf_dir):
    b = blobs(spark, sf_dir).withColumn("row", F.struct("id", "lon", "lat"))
    near = nearest_neighbor(b, b, id_col="row")
    return near.select("row.id", "row.lon", "row.lat", F.round("nn_dist", 3).alias("nn_dist"))


@register(
    "hopkins_blobs",
    Q.with_positions(
        "SELECT round(w, 1) AS w, round(u, 1) AS u, round(w / (w + u), 6) AS hopkins FROM w, u",
        _BLOBS_CTE,
        _PLACES_CTE,
        _UNI_CTES[0].replace("positions", "blobs"),
        _UNI_CTES[1].replace("positions", "blobs"),
        f"w AS (SELECT sum(w * nn) AS w FROM (SELECT p.lon, p.lat, p.w, {_NEAR_BLOB} FROM pl p, pl q GROUP BY ALL))",
        f"u AS (SELECT sum(nn) AS u FROM (SELECT p.id, {_NEAR_BLOB} FROM uni p, pl q GROUP BY p.id))",
    ),
    "E2 where ids repeat, places are hot and points are clustered",
)
def q_hopkins_blobs(spark, sf_dir):
    h = EV.hopkins(blobs(spark, sf_dir), seed=SEED)
    return h.select(F.round("w", 1).alias("w"), F.round("u", 1).alias("u"), F.round("hopkins", 6).alias("hopkins"))


_ASG_CTE = f"asg AS (SELECT id, lon, lat, {_C} AS cluster FROM positions)"


@register(
    "silhouette_blobs",
    _silhouette_sql("standard").replace(
        _ASG_CTE, f"{_BLOBS_CTE},\nasg AS (SELECT rid AS id, lon, lat, {_C} AS cluster FROM blobs)"
    ),
    "E1 where ids repeat, places are hot and points are clustered",
)
def q_silhouette_blobs(spark, sf_dir):
    s = EV.silhouette(blobs(spark, sf_dir), FIXED_CENTERS, mode="standard")
    return s.select(F.round("silhouette", 6).alias("silhouette"))


_SAME = "p.lon = q.lon AND p.lat = q.lat"


@register(
    "same_places",
    Q.with_positions(
        f"SELECT p.id, count(*) FILTER (WHERE p.rid <> q.rid) AS others FROM blobs p JOIN blobs q ON {_SAME} GROUP BY p.rid, p.id",
        _BLOBS_CTE,
    ),
    "P7: how many other rows share a row's place, by the same-place predicate",
)
def q_same_places(spark, sf_dir):
    rows = blobs(spark, sf_dir)
    counts = rows.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"))
    p, q = rows.alias("p"), counts.alias("q")
    joined = p.join(q, same_place("p.lon", "p.lat", "q.lon", "q.lat"))
    return joined.select("p.id", (F.col("q.n") - 1).alias("others"))


@register(
    "distinct_places_blobs",
    Q.with_positions("SELECT lon, lat, w FROM pl", _BLOBS_CTE, _PLACES_CTE),
    "T2: places and their weights where places are hot",
)
def q_distinct_places_blobs(spark, sf_dir):
    p = KM.places(blobs(spark, sf_dir).withColumn("bucket", F.lit(0)))
    return p.select("lon", "lat", F.col("w").cast("bigint").alias("w"))
