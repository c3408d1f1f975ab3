"""J1 and A1 for any number of centres: an index of which centres can be nearest where.

The box of the data is cut into sixteen cells again and again. For every cell the centres
that can be nearest to some point of it are kept. Places are unit vectors, so a centre c is
farther from a point p than the centre b when (b - c) . p > 0; with m the middle of the cell
and rho its radius, that holds for every p of the cell when (b - c) . m > |b - c| rho. With b
the centre nearest to the middle, all centres for which it holds drop out: also most of a
far cluster, whose centres lie at nearly equal distances. A cell that keeps at most
``LEAF_CENTERS`` centres is settled; the others go on to the next level. The cells depend on
the centres alone, and the index is built by equi-joins and partial aggregates.

A row then meets its settled cell by one equi-join and takes the nearest of the cell's few
centres: the work per row does not grow with the number of centres, and no centre passes the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medoidlab.functions.geo import haversine
from medoidlab.session import cut_lineage

# A cell with at most this many possible centres is settled.
LEAF_CENTERS = 24
# Cells are cut at most this often (the box's side / 2^26); a cell of that level keeps all
# its possible centres.
MAX_LEVEL = 26
# Levels per round: a cell's side is cut in CUT.
STEP, CUT = 2, 4
# Up to this level a table of all cells (at most 4^6 rows) is broadcast.
SMALL_LEVEL = 6
# Slack of the test on unit vectors, above what rounding can add to it.
SLACK = 1e-15


def _box(df: DataFrame) -> tuple[float, float, float, float] | None:
    r = df.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    if r is None or r[0] is None:
        return None
    return r[0], r[2], max(r[1] - r[0], 1e-9) * 1.000001, max(r[3] - r[2], 1e-9) * 1.000001


def _cell(box, level: Column) -> tuple[Column, Column]:
    lon0, lat0, width, height = (F.lit(float(x)) for x in box)
    cells = F.pow(F.lit(2.0), level)
    return (
        F.floor((F.col("lon") - lon0) / width * cells).cast("bigint").alias("cx"),
        F.floor((F.col("lat") - lat0) / height * cells).cast("bigint").alias("cy"),
    )


def _vector(lon: Column, lat: Column) -> list[Column]:
    lam, phi = F.radians(lon), F.radians(lat)
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


U, M, B = (["ux", "uy", "uz"], ["mx", "my", "mz"], ["bx", "by", "bz"])


def _in_cells(pairs: DataFrame, box, level: int) -> DataFrame:
    """``pairs`` (cx, cy, center_id, clon, clat, u) with the cell's middle m and radius."""
    lon0, lat0, width, height = box
    w, h = width / 2**level, height / 2**level
    lon = F.lit(lon0) + (F.col("cx") + 0.5) * F.lit(w)
    lat = F.lit(lat0) + (F.col("cy") + 0.5) * F.lit(h)
    middle = _vector(lon, lat)
    rho = F.lit(2.0)
    # Within 45 degrees of the middle the farthest point of a cell is a corner.
    if w <= 90 and h <= 90:
        gaps = []
        for side in (-1, 1):
            gap = [c - m for c, m in zip(_vector(lon + w / 2, lat + side * h / 2), middle)]
            gaps.append(F.sqrt(_dot(gap, gap)))
        rho = F.greatest(*gaps)
    return pairs.withColumns(dict(zip(M, middle)) | {"rho": rho})


def _split(pairs: DataFrame, box, level: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of the cells of ``level`` inside those of ``pairs`` whose centre can be
    nearest, and ``(cx, cy, kept)``, their number per cell.

    A pair meets its cell's parts as one array and is opened inside the stage, once for the
    parts' best centres (a hash aggregate) and once for the test, so that only the pairs
    that stay are written; the parts' middles and radii are found once a cell."""
    small = F.broadcast if level <= SMALL_LEVEL else (lambda x: x)
    parent = ["pcx", "pcy"]
    rows = pairs.withColumnsRenamed({"cx": "pcx", "cy": "pcy"})
    part = F.explode(F.sequence(F.lit(0), F.lit(CUT * CUT - 1)))
    kids = rows.select(*parent).distinct().withColumn("part", part).select(
        *parent,
        (F.col("pcx") * CUT + F.col("part") % CUT).alias("cx"),
        (F.col("pcy") * CUT + F.floor(F.col("part") / CUT)).alias("cy"),
    )
    shape = ["cx", "cy", *M, "rho"]

    def opened(cells: DataFrame, columns: list[str]) -> DataFrame:
        sets = cells.groupBy(*parent).agg(F.collect_list(F.struct(*columns)).alias("kids"))
        return rows.join(small(sets), parent).select(*parent, "center_id", "clon", "clat", *U, F.inline("kids"))

    u, m, b = ([F.col(c) for c in names] for names in (U, M, B))
    best = opened(_in_cells(kids, box, level), shape).groupBy(*parent, "cx", "cy").agg(
        *[F.max_by(x, _dot(u, m)).alias(y) for x, y in zip(U, B)],
        *[F.any_value(c).alias(c) for c in (*M, "rho")],
    )
    gap = [x - y for x, y in zip(b, u)]
    out = _dot(gap, m) > F.sqrt(_dot(gap, gap)) * F.col("rho") + F.lit(SLACK)
    near = opened(best, [*shape, *B]).where(~out).select("cx", "cy", "center_id", "clon", "clat", *U)
    near = cut_lineage(near)
    return near, cut_lineage(near.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("kept")))


def build_center_index(centers: DataFrame, box, leaf: int = LEAF_CENTERS) -> tuple[DataFrame, list[int]]:
    """``(level, cx, cy, near)`` with ``near`` an array of (center_id, lon, lat), and the
    levels that occur. ``centers`` is ``(center_id, lon, lat)``; of centres at one place the
    lowest id counts, as it wins every tie. ``leaf`` is 8 at least: along the border of two
    centres' regions no cell, however small, has one possible centre only."""
    if leaf < 8:
        raise ValueError("leaf must be at least 8")
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    places = centers.where(known).groupBy("lon", "lat").agg(F.min("center_id").alias("center_id"))
    unit = [c.alias(n) for c, n in zip(_vector(F.col("lon"), F.col("lat")), U)]
    zero = F.lit(0).cast("bigint")
    pairs = cut_lineage(places.select(
        zero.alias("cx"), zero.alias("cy"), "center_id", F.col("lon").alias("clon"), F.col("lat").alias("clat"), *unit
    ))
    settled, levels, level = [], [], STEP
    while True:
        near, counts = _split(pairs, box, level)
        small = F.broadcast if level <= SMALL_LEVEL else (lambda x: x)
        done = F.lit(True) if level == MAX_LEVEL else F.col("kept") <= leaf
        one = F.struct("center_id", F.col("clon").alias("lon"), F.col("clat").alias("lat"))
        leaves = near.join(small(counts.where(done)), ["cx", "cy"]).groupBy("cx", "cy")
        leaves = leaves.agg(F.sort_array(F.collect_list(one)).alias("near"))
        fewest, most = counts.agg(F.min("kept"), F.max("kept")).first()
        if fewest is not None and (fewest <= leaf or level == MAX_LEVEL):
            settled.append(leaves.select(F.lit(level).alias("level"), "cx", "cy", "near"))
            levels.append(level)
        if level == MAX_LEVEL or most is None or most <= leaf:
            break
        pairs = near.join(small(counts.where(~done)), ["cx", "cy"]).drop("kept")
        level += STEP
    if not levels:
        raise ValueError("no centres")
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out, levels


def assign_indexed(df: DataFrame, centers: DataFrame, cluster: str = "cluster", dist: str = "dist",
                   leaf: int = LEAF_CENTERS) -> DataFrame:
    """J1 by an index of the centres: ``df`` (lon, lat, ...) with ``cluster`` (nearest centre
    id, ties to the lower) and ``dist`` in metres. Rows without a coordinate get nulls."""
    box = _box(df)
    none = df.withColumns({cluster: F.lit(None).cast("int"), dist: F.lit(None).cast("double")})
    if box is None:
        return none
    index, levels = build_center_index(centers.select("center_id", "lon", "lat"), box, leaf)
    at = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), *_cell(box, F.lit(lv))) for lv in levels]))
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    keyed = df.where(known).select("*", at.alias("__at"))
    near = index.select(F.struct("level", "cx", "cy").alias("__at"), F.col("near").alias("__near"))
    # One level at most matches a row: settled cells do not overlap.
    joined = keyed.join(near, "__at").drop("__at")
    far = F.transform("__near", lambda c: F.struct(haversine("lon", "lat", c["lon"], c["lat"]).alias("d"), c["center_id"].alias("c")))
    best = joined.withColumn("__best", F.array_min(far)).drop("__near")
    out = best.withColumns({cluster: F.col("__best.c").cast("int"), dist: F.col("__best.d")}).drop("__best")
    return out.unionByName(none.where(~known))
