"""k-means|| on (lon, lat) degrees as rounds of DataFrame aggregates.

The model is planar (squared degrees); its centres are then scored with the same
great-circle objective as the k-medoid searches, so the sweep can compare them.

* Start: the place that comes first in a seeded hash order. Each of ``init_steps`` rounds
  adds every row whose hash draw falls below ``oversample * k * d2 / phi``.
* Reduction: the few candidates (about ``init_steps * oversample * k``) are weighted by the
  rows nearest to them, and k of them drawn one by one with chance weight x d2.
* Lloyd rounds until no centre moves by more than ``tolerance``: one partial aggregate a
  round, k rows to the driver.

Draws are hashes of row ids and sums are exact (squared degrees in units of 1e-12, degrees
in units of 1e-9, added as decimals), so neither the layout of the input nor the number of
partitions changes a centre, and another engine can repeat every round.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medoidlab.functions.geo import hash32, hash_unit, salt
from medoidlab.operators.assign import with_nearest
from medoidlab.schema import KMEANS_ITERATIONS

# Units of the exact sums, per square degree and per degree.
SQUARE_UNITS, DEGREE_UNITS = 1e12, 1e9
# Settings of the default initialisation and of the stop.
INIT_STEPS, OVERSAMPLE, TOLERANCE = 2, 2.0, 1e-4


def features(df: DataFrame) -> DataFrame:
    """A ``features`` vector (lon, lat), for Spark ML stages."""
    return VectorAssembler(inputCols=["lon", "lat"], outputCol="features").transform(df)


def _units(value: Column, units: float) -> Column:
    return F.floor(value * F.lit(units) + F.lit(0.5)).cast("bigint")


def _total(units: Column) -> Column:
    return F.sum(units.cast("decimal(28,0)"))


def _hash_unit(text: str) -> float:
    """The driver's twin of ``hash_unit``."""
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0


def _candidates(data: DataFrame, k: int, seed: int, steps: int, oversample: float) -> list[tuple[int, float, float]]:
    first = data.select("id", "lon", "lat", hash32("id", salt(seed, "first")).alias("h"))
    start = first.agg(F.min(F.struct("h", "id", "lon", "lat")).alias("m")).collect()[0]["m"]
    if start is None:
        return []
    chosen = {(start["id"], start["lon"], start["lat"])}
    for step in range(steps):
        scored = kmeans_predict(data, [(c[1], c[2]) for c in sorted(chosen)]).withColumn("units", _units(F.col("dist"), SQUARE_UNITS))
        phi = scored.agg(_total(F.col("units")).alias("phi")).collect()[0]["phi"]
        if not phi:
            break
        chance = F.lit(float(oversample * k)) * F.col("units").cast("double") / F.lit(float(phi))
        drawn = scored.where(hash_unit("id", salt(seed, f"step{step}")) < chance)
        chosen |= {tuple(r) for r in drawn.select("id", "lon", "lat").distinct().collect()}
    return sorted(chosen)


def _reduced(candidates: list[tuple[int, float, float]], weights: dict[int, int], k: int, seed: int) -> list[int]:
    """Places in the candidate list of k weighted draws."""
    near = [1] * len(candidates)
    picked: list[int] = []
    while len(picked) < k:
        scores = [weights.get(i, 0) * n for i, n in enumerate(near)]
        total = sum(scores)
        if not total:
            break
        target = math.floor(_hash_unit(f"{len(picked)}{salt(seed, 'pick')}") * float(total))
        running = 0
        for i, s in enumerate(scores):
            running += s
            if running > target:
                break
        _, lon, lat = candidates[i]
        d2 = [math.floor(((x - lon) * (x - lon) + (y - lat) * (y - lat)) * SQUARE_UNITS + 0.5) for _, x, y in candidates]
        near = d2 if not picked else [min(a, b) for a, b in zip(near, d2)]
        picked.append(i)
    return picked


def kmeans_centers(df: DataFrame, k: int, seed: int = 0, max_iter: int = KMEANS_ITERATIONS, init_steps: int = INIT_STEPS,
                   oversample: float = OVERSAMPLE, tolerance: float = TOLERANCE) -> list[tuple[int, float, float]]:
    """Centres ``(center_id, lon, lat)``; fewer than k if the rows hold fewer places.

    Rows without a coordinate take no part. ``df`` is read once a round: hand over a stored
    or persisted table.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    data = df.select("id", "lon", "lat").where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    candidates = _candidates(data, k, seed, init_steps, oversample)
    if not candidates:
        return []
    counted = kmeans_predict(data, [(c[1], c[2]) for c in candidates]).groupBy("cluster").count().collect()
    picked = _reduced(candidates, {r["cluster"]: r["count"] for r in counted}, k, seed)
    centers = [(candidates[i][1], candidates[i][2]) for i in picked]
    for _ in range(max_iter):
        means = (
            kmeans_predict(data, centers)
            .groupBy("cluster")
            .agg(
                F.count(F.lit(1)).alias("n"),
                *[_total(_units(F.col(c), DEGREE_UNITS)).alias(c) for c in ("lon", "lat")],
            )
            .collect()
        )
        moved, new = 0.0, list(centers)
        for r in means:
            lon, lat = (float(r[c]) / r["n"] / DEGREE_UNITS for c in ("lon", "lat"))
            old = centers[r["cluster"]]
            moved = max(moved, (lon - old[0]) * (lon - old[0]) + (lat - old[1]) * (lat - old[1]))
            new[r["cluster"]] = (lon, lat)
        centers = new
        if moved <= tolerance * tolerance:
            break
    return [(i, lon, lat) for i, (lon, lat) in enumerate(centers)]


def kmeans_predict(df: DataFrame, centers) -> DataFrame:
    """Rows plus ``cluster`` (planar nearest centre, ties to the lower id) and ``dist``
    (squared degrees)."""
    return with_nearest(df, centers, metric="planar")


def kmeans(df: DataFrame, k: int, seed: int = 0, max_iter: int = KMEANS_ITERATIONS) -> DataFrame:
    """C23 + C25: centres ``(center_id, lon, lat)`` of a k-means|| fit."""
    rows = kmeans_centers(df, k, seed, max_iter)
    return df.sparkSession.createDataFrame(rows, "center_id int, lon double, lat double")
