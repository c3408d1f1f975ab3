"""Exact nearest neighbour at a positive distance.

Probes are reduced to distinct places first and every step is keyed by place, so rows
that share an id or a place cost nothing more and each get their own right answer. For
every probe place the smallest haversine distance > 0 to a target is found by a
top-down descent of a quadtree over the targets, one level per step, all in
DataFrame equi-joins; the first level, of at most ``START_CELLS`` cells, is a literal:

* the targets are reduced to distinct places and summarised per cell at every level
  (cell bbox, place count and its four extreme places, west/east/south/north, with
  ``min_by``/``max_by`` on doubles, so it stays a hash aggregate) in one pass;
* a probe keeps, at each level, only the cells whose lower-bound distance (from the
  cell bbox) is within its upper bound (the nearest extreme place at a distance > 0,
  a real target), then steps to the children of the kept cells;
* at the leaf level, where a cell holds at most ``LEAF_PLACES`` distinct places
  (depth chosen from the data), the kept cells are joined with their places.

The work per probe follows the number of cells near its nearest-neighbour ball, not
the data size; dense spots only deepen the tree. Lower bounds are conservative on
the sphere: latitude gap ``R * dlat`` and meridian gap ``R * asin(cos(lat) sin(dlon))``,
with ``dlon`` taken the shorter way round, so the date line (longitudes in [-180, 180])
is no exception. Rows without a coordinate are no targets and get a null distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medoidlab.functions.geo import haversine
from medoidlab.schema import EARTH_RADIUS_M
from medoidlab.session import cut_lineage

# Leaf cells hold at most this many distinct places (the depth follows the data).
LEAF_PLACES = 32
# Each descent step divides the cell side by this factor (children per cell: its square).
FANOUT = 2
# Deepest level considered (cells of side extent / FANOUT**MAX_LEVEL); a leaf there may
# hold more places.
MAX_LEVEL = 16
# Levels tried beyond the depth that evenly spread places would need; only where the
# leaves are still too full are the levels down to MAX_LEVEL summarised as well.
SPARE_LEVELS = 2
# The descent starts at the deepest level with at most this many occupied cells; every
# probe is paired with all of them (a literal array).
START_CELLS = 64
# Slack on lower bounds, metres, so rounding never prunes the true neighbour.
LB_SLACK = 1e-6


def _lower_bound(radius=EARTH_RADIUS_M) -> Column:
    """Spherical lower bound from probe (plon, plat) to the cell box, as one expression."""
    dlat = "greatest(minlat - plat, plat - maxlat, 0.0D)"
    direct = "greatest(minlon - plon, plon - maxlon, 0.0D)"
    dlon = f"least({direct}, minlon + 360.0D - plon, plon + 360.0D - maxlon)"
    lat_gap = f"{float(radius)!r}D * radians({dlat})"
    s = f"cos(radians(plat)) * sin(radians(least({dlon}, 90.0D)))"
    lon_gap = f"{float(radius)!r}D * asin(least(abs({s}), 1.0D))"
    return F.expr(f"greatest({lat_gap}, {lon_gap}) - {float(LB_SLACK)!r}D")


def _cell_cols(lon: Column, lat: Column, origin, level_scale: Column) -> tuple[Column, Column]:
    lon0, lat0, side = origin
    u = (lon - F.lit(lon0)) / F.lit(side)
    v = (lat - F.lit(lat0)) / F.lit(side)
    return F.floor(u * level_scale).cast("bigint"), F.floor(v * level_scale).cast("bigint")


def _cell_key(cx: Column, cy: Column) -> Column:
    """A cell of one level as one number. Small levels are broadcast: by one long key their
    table takes a few bytes a row, by two columns 32 MB at least."""
    return F.shiftleft(cx.cast("bigint"), 32) + cy.cast("bigint")


CELL_VALUES = ["minlon", "maxlon", "minlat", "maxlat", "lat_w", "lat_e", "lon_s", "lon_n"]


def _summaries(places: DataFrame, origin, top: int) -> DataFrame:
    """Occupied cells of the levels 0 to ``top`` with count, box and extreme places."""
    lv = places.select("lon", "lat", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    cx, cy = _cell_cols(F.col("lon"), F.col("lat"), origin, F.pow(F.lit(float(FANOUT)), F.col("level")))
    return (
        lv.withColumn("cx", cx)
        .withColumn("cy", cy)
        .groupBy("level", "cx", "cy")
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.min("lon").alias("minlon"),
            F.max("lon").alias("maxlon"),
            F.min("lat").alias("minlat"),
            F.max("lat").alias("maxlat"),
            F.min_by("lat", "lon").alias("lat_w"),
            F.max_by("lat", "lon").alias("lat_e"),
            F.min_by("lon", "lat").alias("lon_s"),
            F.max_by("lon", "lat").alias("lon_n"),
        )
    )


def build_index(targets: DataFrame, leaf_places: int = LEAF_PLACES):
    """Distinct target places and their per-level cell summaries (None without places).

    Returns ``(places, cells, origin, depth, start)``; ``places`` carries its leaf cell
    key; the descent runs from level ``start`` (at most ``START_CELLS`` cells) to ``depth``.
    Places and cells are checkpointed: every level of the descent reads them again.
    """
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    pl = cut_lineage(targets.select("lon", "lat").where(known).distinct())
    ext = pl.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat"), F.count(F.lit(1))).collect()[0]
    if ext[4] == 0:
        return None
    side = max(ext[1] - ext[0], ext[3] - ext[2], 1e-9) * 1.000001
    origin = (float(ext[0]), float(ext[2]), float(side))
    even = math.ceil(math.log(max(ext[4] / leaf_places, 1.0), FANOUT**2))
    for top in sorted({min(MAX_LEVEL, even + SPARE_LEVELS), MAX_LEVEL}):
        cells = cut_lineage(_summaries(pl, origin, top))
        rows = cells.groupBy("level").agg(F.max("cnt"), F.count(F.lit(1))).collect()
        stats = {r[0]: (r[1], r[2]) for r in rows}
        if stats[top][0] <= leaf_places:
            break
    depth = next((lv for lv in range(top + 1) if stats[lv][0] <= leaf_places), top)
    start = max(lv for lv in range(depth + 1) if stats[lv][1] <= START_CELLS)
    cells = cells.where(F.col("level").between(start, depth))
    lcx, lcy = _cell_cols(F.col("lon"), F.col("lat"), origin, F.lit(float(FANOUT) ** depth))
    places = pl.select("lon", "lat", lcx.alias("cx"), lcy.alias("cy"))
    return places, cells, origin, depth, start


def _cell_literals(cells: DataFrame, level: int) -> str:
    """The cells of the start level (at most START_CELLS rows) as one SQL array."""
    rows = cells.where(F.col("level") == level).select("cx", "cy", *CELL_VALUES).collect()

    def one(r):
        keys = [f"'{c}', {int(r[c])}L" for c in ("cx", "cy")]
        return f"named_struct({', '.join(keys + [f"'{c}', {float(r[c])!r}D" for c in CELL_VALUES])})"

    return f"array({', '.join(one(r) for r in rows)})"


def nearest_places(places: DataFrame, index) -> DataFrame:
    """``(lon, lat, nn_dist)`` for distinct places ``(lon, lat)`` against a :func:`build_index`
    result; places without a target at a positive distance are left out."""
    targets, cells, origin, depth, start = index
    pr = places.select(F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    root = F.inline(F.expr(_cell_literals(cells, start)))
    cand = pr.select("plon", "plat", root).withColumn("ub_prev", F.lit(None).cast("double"))
    by_probe = Window.partitionBy("plon", "plat")
    for level in range(start, depth + 1):
        reps = [
            haversine("plon", "plat", "minlon", "lat_w"),
            haversine("plon", "plat", "maxlon", "lat_e"),
            haversine("plon", "plat", "lon_s", "minlat"),
            haversine("plon", "plat", "lon_n", "maxlat"),
        ]
        ubc = F.least(*[F.when(d > 0, d) for d in reps])
        cand = cand.withColumn("lb", _lower_bound()).withColumn("ubc", ubc)
        cand = cand.withColumn("ub", F.least(F.min("ubc").over(by_probe), F.col("ub_prev")))
        cand = cand.where(F.col("ub").isNull() | (F.col("lb") <= F.col("ub")))
        if level == depth:
            break
        child = cells.where(F.col("level") == level + 1).select(
            _cell_key(F.floor(F.col("cx") / FANOUT), F.floor(F.col("cy") / FANOUT)).alias("parent"),
            "cx",
            "cy",
            *CELL_VALUES,
        )
        key = _cell_key(F.col("cx"), F.col("cy"))
        parent = cand.select("plon", "plat", key.alias("parent"), F.col("ub").alias("ub_prev"))
        cand = parent.join(child, "parent").drop("parent")
    key = _cell_key(F.col("cx"), F.col("cy")).alias("cell")
    tgt = targets.select(key, F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    leaf = cand.select("plon", "plat", key).join(tgt, "cell")
    d = haversine("plon", "plat", "tlon", "tlat")
    best = leaf.select("plon", "plat", d.alias("d")).where(F.col("d") > 0)
    best = best.groupBy("plon", "plat").agg(F.min("d").alias("nn_dist"))
    return best.select(F.col("plon").alias("lon"), F.col("plat").alias("lat"), "nn_dist")


def nearest_neighbor(probes: DataFrame, targets: DataFrame, id_col: str = "id", index=None) -> DataFrame:
    """``(id, nn_dist)``, one row per probe row: nearest target at a distance > 0.

    Probes with no target at a positive distance get ``nn_dist = null``; rows that share
    an id are probes of their own. ``index`` reuses a :func:`build_index` result.
    """
    idx = index if index is not None else build_index(targets)
    if idx is None:
        return probes.select(id_col, F.lit(None).cast("double").alias("nn_dist"))
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    best = nearest_places(probes.select("lon", "lat").where(known).distinct(), idx)
    return probes.select(id_col, "lon", "lat").join(best, ["lon", "lat"], "left").select(id_col, "nn_dist")
