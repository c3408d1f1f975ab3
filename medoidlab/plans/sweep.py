"""Parameter sweep over k and algorithms, and its result tables.

The sweep is a driver loop of Spark jobs (one clustering per k and algorithm); the
input is persisted and counted once. Each run returns k centres, its wall time and
its haversine phi over the whole input; skipped algorithms still get a row (with
nulls), as in the reference's results file. The drawings of all runs come from one pass
over the input.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medoidlab.functions.geo import cluster_color
from medoidlab.operators.assign import as_center_list, objective_value
from medoidlab.operators.kmeans import kmeans
from medoidlab.operators.kmedoids import clara, clarafast, clarans, pam
from medoidlab.operators.raster import blended, raster_centers, raster_many
from medoidlab.schema import (
    ALG_CLARA,
    ALG_CLARAFAST,
    ALG_CLARANS,
    ALG_KMEANS,
    ALG_PAM,
    ALGORITHM_NAMES,
    RESULT_SCHEMA,
)

# Settings of the reference's demo runs: reduced PAM and CLARA use 4 buckets,
# CLARANS runs on all data with 3 local searches.
DEMO_BUCKETS = 4
DEMO_NLOCAL = 3


def run_algorithm(df: DataFrame, k: int, alg: int, seed: int, n: int, buckets: int = DEMO_BUCKETS,
                  nlocal: int = DEMO_NLOCAL) -> list[tuple[int, float, float]]:
    """Centres (center_id, lon, lat) of one algorithm, as in the reference's demo."""
    if alg == ALG_PAM:
        c = pam(df, k, buckets=buckets, seed=seed, n=n)
    elif alg == ALG_CLARA:
        c = clara(df, k, buckets=buckets, seed=seed, n=n)
    elif alg == ALG_CLARAFAST:
        c = clarafast(df, k, seed=seed)
    elif alg == ALG_CLARANS:
        c = clarans(df, k, nlocal=nlocal, seed=seed, n=n)
    elif alg == ALG_KMEANS:
        c = kmeans(df, k, seed=seed)
    else:
        raise ValueError(f"unknown algorithm bit {alg}")
    return as_center_list(c.select("center_id", "lon", "lat"))


class Sweep(NamedTuple):
    """Results of a sweep and its drawings; all but ``results`` are keyed by (k, algorithm)."""

    results: DataFrame
    pixels: DataFrame
    colors: DataFrame
    centers: DataFrame


def _ran(results: DataFrame) -> list:
    """The runs that have centres: few rows, k centres each."""
    rows = results.where(F.col("centers").isNotNull()).select("k", "algorithm", "centers").collect()
    return sorted(rows, key=lambda r: (r["k"], r["algorithm"]))


def _by_run(value: dict) -> Column:
    """``value`` of the row's run, a number, text or column."""
    out = None
    for run, v in value.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(F.col("run") == run, v) if out is None else out.when(F.col("run") == run, v)
    return out


def sweep_pixels(df: DataFrame, results: DataFrame, **picture) -> DataFrame:
    """R4 of every run, in one pass over ``df``: ``(k, algorithm, x, y, cluster, n, r, g, b)``.
    k-means runs are drawn by their own (planar) prediction."""
    runs = _ran(results)
    kmeans_name = ALGORITHM_NAMES[ALG_KMEANS]
    sets = [
        (i, [(c["lon"], c["lat"]) for c in r["centers"]], "planar" if r["algorithm"] == kmeans_name else "haversine")
        for i, r in enumerate(runs)
    ]
    px = raster_many(df, sets, **picture)
    colors = {i: cluster_color(F.col("cluster"), len(r["centers"])) for i, r in enumerate(runs)}
    return px.select(
        _by_run({i: r["k"] for i, r in enumerate(runs)}).cast("int").alias("k"),
        _by_run({i: r["algorithm"] for i, r in enumerate(runs)}).alias("algorithm"),
        "x",
        "y",
        "cluster",
        "n",
        *[_by_run({i: c[j] for i, c in colors.items()}).alias(name) for j, name in enumerate(("r", "g", "b"))],
    )


def sweep_centers(results: DataFrame, **picture) -> DataFrame:
    """R5 of every run: ``(k, algorithm, center_id, xc, yc, drawn, dropped, status)``."""
    flat = results.select("k", "algorithm", F.posexplode("centers").alias("center_id", "c"))
    keyed = flat.select(F.struct("k", "algorithm", "center_id").alias("center_id"), "c.lon", "c.lat")
    squares = raster_centers(keyed, results.sparkSession, **picture)
    return squares.select("center_id.*", *[c for c in squares.columns if c != "center_id"])


def drawn(df: DataFrame, results: DataFrame) -> Sweep:
    """The sweep's results with its drawings."""
    pixels = sweep_pixels(df, results)
    return Sweep(results, pixels, blended(pixels, ["k", "algorithm", "x", "y"]), sweep_centers(results))


def sweep(df: DataFrame, min_k: int, max_k: int, k_step: int = 1, algorithms: int = ALG_CLARA, seed: int = 0,
          buckets: int = DEMO_BUCKETS, nlocal: int = DEMO_NLOCAL, drawings: bool = False) -> DataFrame | Sweep:
    """Results ``(k, algorithm, time_ms, phi, centers)`` for every k and algorithm; with
    ``drawings`` a :class:`Sweep` that also has the pixels, colours and centre squares."""
    if min_k < 2:
        raise ValueError("min_k must be at least 2")
    if k_step < 1 or max_k < min_k:
        raise ValueError("bad k range")
    data = df.select("id", "lon", "lat").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = data.count()
        rows = []
        for k in range(min_k, max_k + 1, k_step):
            for alg in (ALG_PAM, ALG_CLARA, ALG_CLARAFAST, ALG_CLARANS, ALG_KMEANS):
                name = ALGORITHM_NAMES[alg]
                if not algorithms & alg:
                    rows.append((k, name, None, None, None))
                    continue
                t0 = time.perf_counter()
                centers = run_algorithm(data, k, alg, seed, n, buckets, nlocal)
                ms = int((time.perf_counter() - t0) * 1000)
                phi = objective_value(data, centers)
                rows.append((k, name, ms, phi, [(lat, lon) for _, lon, lat in centers]))
        results = df.sparkSession.createDataFrame(rows, RESULT_SCHEMA)
        return drawn(df.select("id", "lon", "lat"), results) if drawings else results
    finally:
        data.unpersist()


def results_wide(results: DataFrame, max_k: int | None = None) -> DataFrame:
    """R1 wide form: k, algorithm bit, time, phi, then lat/lon per centre, 'NULL' padded."""
    if max_k is None:
        max_k = int(results.agg(F.max("k")).collect()[0][0] or 0)
    bits = F.create_map(*[x for b, nme in ALGORITHM_NAMES.items() for x in (F.lit(nme), F.lit(str(b)))])
    null = F.lit("NULL")
    cols = [
        F.col("k").cast("string").alias("k"),
        bits[F.col("algorithm")].alias("algorithm"),
        F.coalesce(F.col("time_ms").cast("string"), null).alias("time_ms"),
        F.coalesce(F.col("phi").cast("string"), null).alias("phi"),
    ]
    for i in range(max_k):
        c = F.get(F.col("centers"), i)
        cols.append(F.coalesce(c["lat"].cast("string"), null).alias(f"lat_{i}"))
        cols.append(F.coalesce(c["lon"].cast("string"), null).alias(f"lon_{i}"))
    return results.select(*cols)
