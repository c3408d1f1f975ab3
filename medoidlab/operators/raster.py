"""Density rasters of points and clusterings.

A picture is a table, not a canvas: ``(x, y, cluster, n)`` counts per pixel and
cluster, computed with one partial + final aggregate, so its size is bounded by the
pixel count whatever the number of points. Colours and alpha blending are column
maths on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medoidlab.functions.geo import cluster_color, to_pixel_x, to_pixel_y
from medoidlab.operators.assign import METRICS, as_center_list, with_nearest
from medoidlab.schema import ALPHA_CLUSTERING, CENTER_SQUARE, IMAGE_BOX, IMAGE_SIZE, Box


def _with_cluster(df: DataFrame, centers, assign: str) -> DataFrame:
    if centers is None:
        return df.withColumn("cluster", F.lit(0))  # P13: no model, one colour
    return with_nearest(df, centers, dist="__dist", metric=assign).drop("__dist")


def with_pixels(df: DataFrame, box: Box = IMAGE_BOX, width: int = IMAGE_SIZE, height: int = IMAGE_SIZE) -> DataFrame:
    """Add pixel ``x``, ``y`` (rounded half up, y counted from the top)."""
    return df.withColumn("x", to_pixel_x("lon", box, width)).withColumn("y", to_pixel_y("lat", box, height))


def inside(width: int = IMAGE_SIZE, height: int = IMAGE_SIZE) -> Column:
    return (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)


def raster(df: DataFrame, centers=None, box: Box = IMAGE_BOX, width: int = IMAGE_SIZE,
           height: int = IMAGE_SIZE, assign: str = "haversine") -> DataFrame:
    """R3/R4 + A14: ``(x, y, cluster, n)`` point counts per pixel and cluster."""
    px = with_pixels(_with_cluster(df, centers, assign), box, width, height).where(inside(width, height))
    return px.groupBy("x", "y", "cluster").agg(F.count(F.lit(1)).alias("n"))


def raster_many(df: DataFrame, runs, box: Box = IMAGE_BOX, width: int = IMAGE_SIZE, height: int = IMAGE_SIZE) -> DataFrame:
    """The pictures of many clusterings in one pass: ``(run, x, y, cluster, n)``.

    ``runs`` is a list of ``(run, centres, metric)``. All centre sets travel as one literal
    array; a row's pixel is computed once, the row is expanded to its nearest centre of
    every run inside the scan stage, and one partial + final aggregate keyed by run and
    pixel is shuffled. Ties go to the lower centre, as in ``raster``.
    """
    sets = [(run, as_center_list(centers), metric) for run, centers, metric in runs]
    if not sets:
        raise ValueError("no runs")
    most = max(len(cl) for _, cl, _ in sets)

    def literal(run, cl, metric):
        fields = [f"'run', {int(run)}", f"'planar', {'true' if metric == 'planar' else 'false'}"]
        for i in range(most):
            cid, lon, lat = cl[i] if i < len(cl) else (None, None, None)
            place = ("NULL", "NULL") if lon is None else (f"{lon!r}D", f"{lat!r}D")
            fields += [f"'c{i}', CAST({'NULL' if cid is None else cid} AS INT)"]
            fields += [f"'{n}{i}', CAST({v} AS DOUBLE)" for n, v in zip(("lon", "lat"), place)]
        return f"named_struct({', '.join(fields)})"

    unknown = {metric for _, _, metric in sets} - METRICS.keys()
    if unknown:
        raise ValueError(f"metric must be one of {sorted(METRICS)}")
    px = with_pixels(df.select("lon", "lat"), box, width, height).where(inside(width, height))
    rows = px.select("lon", "lat", "x", "y", F.explode(F.expr(f"array({', '.join(literal(*s) for s in sets)})")).alias("s"))
    metrics = {metric for _, _, metric in sets}
    far = []
    for i in range(most):
        d = {m: METRICS[m]("lon", "lat", F.col(f"s.lon{i}"), F.col(f"s.lat{i}")) for m in metrics}
        both = len(d) == 2
        far.append(F.when(F.col("s.planar"), d["planar"]).otherwise(d["haversine"]) if both else d[next(iter(d))])
    rows = rows.select("x", "y", "s", *[d.alias(f"d{i}") for i, d in enumerate(far)])
    least = F.col("d0") if most == 1 else F.least(*[F.col(f"d{i}") for i in range(most)])
    rows = rows.withColumn("least", least)
    cluster = F.coalesce(*[F.when(F.col(f"d{i}") == F.col("least"), F.col(f"s.c{i}")) for i in range(most)])
    return (
        rows.select(F.col("s.run").alias("run"), "x", "y", cluster.alias("cluster"))
        .groupBy("run", "x", "y", "cluster")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def raster_dropped(df: DataFrame, box: Box = IMAGE_BOX, width: int = IMAGE_SIZE, height: int = IMAGE_SIZE) -> DataFrame:
    """Points outside the picture by reason, with their share of all points."""
    px = with_pixels(df, box, width, height)
    reasons = F.concat_ws(
        " ",
        F.when(F.col("lon") < box.min_lon, F.lit("west")),
        F.when(F.col("lon") > box.max_lon, F.lit("east")),
        F.when(F.col("lat") > box.max_lat, F.lit("north")),
        F.when(F.col("lat") < box.min_lat, F.lit("south")),
    )
    tagged = px.select((~inside(width, height)).alias("out"), reasons.alias("reason"))
    counts = tagged.groupBy("out", "reason").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the few reason rows
    return counts.select("out", "reason", "n", (F.col("n") / total).alias("share")).where(F.col("out")).drop("out")


def cluster_colors(df_with_cluster: DataFrame, k: int) -> DataFrame:
    """Add the cluster's ``r, g, b`` for a k-cluster picture."""
    r, g, b = cluster_color(F.col("cluster"), k)
    return df_with_cluster.withColumn("r", r).withColumn("g", g).withColumn("b", b)


def blended(colored: DataFrame, keys: list[str], alpha: float = ALPHA_CLUSTERING) -> DataFrame:
    """``colored`` (keys, cluster, n, r, g, b) blended over black, one row per ``keys``.

    Points of one cluster blend exactly like the reference (truncating each step).
    Where clusters share a pixel, they are drawn in cluster order (the reference's
    order there depends on row order, so it has no fixed answer).
    """
    per = colored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "n", "r", "g", "b"))).alias("runs"))

    def chan(name: str) -> Column:
        keep = F.lit(1.0 - alpha)

        def run(acc, s):
            steps = F.least(s["n"], F.lit(256)).cast("int")
            return F.aggregate(
                F.sequence(F.lit(1), steps),
                acc,
                lambda v, _i: F.floor(v.cast("double") * keep + s[name].cast("double") * F.lit(alpha)).cast("int"),
            )

        return F.aggregate(F.col("runs"), F.lit(0).cast("int"), run)

    return per.select(*keys, *[chan(c).alias(c) for c in ("r", "g", "b")])


def pixel_colors(ras: DataFrame, k: int, alpha: float = ALPHA_CLUSTERING) -> DataFrame:
    """A14 colours of one picture: each pixel's ``r, g, b`` after drawing its points."""
    return blended(cluster_colors(ras, k), ["x", "y"], alpha)


def _centers_frame(centers, spark) -> DataFrame:
    if isinstance(centers, DataFrame):
        return centers.select("center_id", "lon", "lat")
    cl = as_center_list(centers)
    return spark.createDataFrame([(c, lon, lat) for c, lon, lat in cl], "center_id int, lon double, lat double")


def raster_centers(centers, spark, box: Box = IMAGE_BOX, width: int = IMAGE_SIZE, height: int = IMAGE_SIZE,
                   size: int = CENTER_SQUARE) -> DataFrame:
    """Each centre's square of side ``size``: pixel, drawn and dropped counts, status.

    ``centers`` is a list or a DataFrame ``(center_id, lon, lat)`` of any length; each
    centre expands to ``size**2`` pixel rows in-stage.
    """
    cdf = _centers_frame(centers, spark)
    half = size // 2
    px = with_pixels(cdf, box, width, height).withColumnRenamed("x", "xc").withColumnRenamed("y", "yc")
    sq = px.select(
        "center_id",
        "xc",
        "yc",
        F.explode(F.sequence(F.col("xc") - half, F.col("xc") + half - 1)).alias("x"),
    ).select("center_id", "xc", "yc", "x", F.explode(F.sequence(F.col("yc") - half, F.col("yc") + half - 1)).alias("y"))
    agg = sq.groupBy("center_id", "xc", "yc").agg(
        F.sum(inside(width, height).cast("int")).cast("bigint").alias("drawn"),
        F.sum((~inside(width, height)).cast("int")).cast("bigint").alias("dropped"),
    )
    status = (
        F.when(F.col("dropped") == 0, F.lit("inside"))
        .when(F.col("drawn") > 0, F.lit("cut"))
        .otherwise(F.lit("outside"))
    )
    return agg.withColumn("status", status)


def center_pixels(centers, spark, box: Box = IMAGE_BOX, width: int = IMAGE_SIZE, height: int = IMAGE_SIZE,
                  size: int = CENTER_SQUARE) -> DataFrame:
    """R5 pixels: ``(center_id, x, y)`` of every drawn pixel of the centre squares."""
    cdf = _centers_frame(centers, spark)
    half = size // 2
    px = with_pixels(cdf, box, width, height)
    sq = px.select("center_id", F.explode(F.sequence(F.col("x") - half, F.col("x") + half - 1)).alias("x"), "y")
    sq = sq.select("center_id", "x", F.explode(F.sequence(F.col("y") - half, F.col("y") + half - 1)).alias("y"))
    return sq.where(inside(width, height))

