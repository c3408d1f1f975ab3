"""Clustering evaluation (E1-E3): silhouette, Hopkins statistic, radius statistics.

The reference runs two jobs per sample point for each of these; here each is a fixed
number of jobs whatever the input size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medoidlab.functions.geo import hash32, haversine, salt
from medoidlab.operators.assign import as_center_list, assign_nearest, with_nearest
from medoidlab.operators.distance_tree import APART, LEAF, MAP_BITS, Map, Sums, Tree, apart
from medoidlab.operators.neighbors import build_index, nearest_places
from medoidlab.operators.sampling import bernoulli_sample, uniform_points
from medoidlab.schema import CLEAN_BOX, Box
from medoidlab.session import cut_lineage

# Places per block of the silhouette's sums: from the first value, which spreads small
# inputs, blocks grow to the second, and beyond it where there would be more blocks than
# the third. Cells are planned for about as many in a block as the fourth.
SILHOUETTE_BLOCK = 4096
SILHOUETTE_BLOCK_MAX = 65_536
SILHOUETTE_BLOCKS = 4096
CELLS_PER_BLOCK = 16
# Levels of squares counted by the first pass over the places, and by any further one.
_FIRST_LEVELS, _MORE_LEVELS = 8, 3
# Rows and columns of the distances held at a time (1 MB: they stay in a core's cache).
_CHUNK_ROWS, _CHUNK_COLUMNS = 64, 2048


def data_box(df: DataFrame) -> Box:
    """The data's own min/max box (the Hopkins default)."""
    r = df.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).collect()[0]
    return Box(float(r[0]), float(r[1]), float(r[2]), float(r[3]))


def hopkins(df: DataFrame, seed: int = 0, box: Box | str | None = None, n: int | None = None,
            fraction: float = 1.0) -> DataFrame:
    """Hopkins statistic ``W / (W + U)`` as a one-row DataFrame ``(w, u, hopkins)``.

    W sums each point's nearest other point (distance > 0) in ``df``; U does the same
    for as many uniform points drawn in ``box``. ``box=None`` uses the data's own
    extent; ``box="fixed"`` the reference's fixed cleaning box. ``fraction`` below 1
    takes a seeded sample first (the default takes all rows). Rows without a coordinate
    are left out; without rows all three values are null.
    """
    pts = df.select("id", "lon", "lat").where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    if fraction < 1.0:
        pts = bernoulli_sample(pts, fraction, seed)
    index = build_index(pts)
    if index is None:
        null = F.lit(None).cast("double")
        return df.sparkSession.range(1).select(null.alias("w"), null.alias("u"), null.alias("hopkins"))
    weights = pts.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("w"))
    if box is None:
        box = data_box(index[0])
    elif box == "fixed":
        box = CLEAN_BOX
    if n is None:
        n = pts.count()
    near = weights.join(nearest_places(weights, index), ["lon", "lat"])
    uniform = nearest_places(uniform_points(df.sparkSession, n, box, seed).select("lon", "lat").distinct(), index)
    null = F.lit(None).cast("double")
    both = near.select((F.col("w") * F.col("nn_dist")).alias("w"), null.alias("u")).unionByName(
        uniform.select(null.alias("w"), F.col("nn_dist").alias("u"))
    )
    sums = both.agg(F.sum("w").alias("w"), F.sum("u").alias("u"))
    return sums.select("w", "u", (F.col("w") / (F.col("w") + F.col("u"))).alias("hopkins"))


_SUMS_SCHEMA = T.StructType(
    [
        T.StructField("lon", T.DoubleType(), False),
        T.StructField("lat", T.DoubleType(), False),
        T.StructField("own", T.IntegerType(), False),
        T.StructField("w", T.LongType(), False),
        T.StructField("cluster", T.IntegerType(), False),
        T.StructField("s", T.DoubleType(), False),
    ]
)


_CELL_SCHEMA = "cell int, box binary, sources binary"


def _cells(counted: Callable, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The squares of a quadtree that hold at most ``size`` places each, in the order of
    their numbers: (first number of each, its places). ``counted(level, heavy)`` counts the
    places by square of a level (bits a side), within squares ``heavy`` = (level, numbers)."""
    first, places, heavy, level = [], [], None, 0
    while heavy is None or (len(heavy[1]) and level < MAP_BITS):
        below, level = level, min(MAP_BITS, level + (_FIRST_LEVELS if heavy is None else _MORE_LEVELS))
        squares, counts = counted(level, heavy)
        order = np.argsort(squares)
        squares, counts = squares[order], counts[order]
        open_ = np.ones(len(squares), bool)
        for at in range(below, level + 1):
            # Squares of this level, and those of them that need no further cut.
            up = squares[open_] >> 2 * (level - at)
            number, start = np.unique(up, return_index=True)
            total = np.add.reduceat(counts[open_], start) if len(start) else counts[:0]
            done = (total <= size) | (at == MAP_BITS)
            first.append(number[done] << 2 * (MAP_BITS - at))
            places.append(total[done])
            open_[open_] = ~np.isin(up, number[done])
        heavy = level, squares[open_]
    first, places = np.concatenate(first), np.concatenate(places)
    order = np.argsort(first)
    return first[order], places[order]


def _over(tree: Tree, first: np.ndarray) -> int:
    """Joins the cells of a quadtree (the tree's, in order) up to one; returns it."""
    nodes = [(int(code), i) for i, code in enumerate(first)]
    for at in range(2, 2 * MAP_BITS + 2, 2):
        grouped: dict[int, list] = {}
        for code, i in nodes:
            grouped.setdefault(code >> at, []).append((code, i))
        nodes = [(g[0][0], tree.join([i for _, i in g]) if len(g) > 1 else g[0][1]) for g in grouped.values()]
        if len(nodes) == 1:
            break
    return nodes[0][1]


def _sorted(pdf: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    # In one order wherever a cell is grown: its parts come out the same.
    return pdf.sort_values(by + ["lon", "lat"], kind="stable").reset_index(drop=True)


def _held(tree: Tree, pdf: pd.DataFrame) -> list[tuple[int, np.ndarray]]:
    """Gives a tree the places of ``pdf``, sorted by cell; returns the rows of each cell."""
    tree.hold(*(pdf[c].to_numpy(t) for c, t in zip(("lon", "lat", "own", "w"), (float, float, np.int64, float))))
    cell = pdf["cell"].to_numpy()
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    return [(int(cell[i]), rows) for i, rows in zip(starts, np.split(np.arange(len(cell)), starts[1:]))]


def _grown(clusters: np.ndarray):
    """Box and sources of each cell of a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(clusters)
        cells = _held(tree, _sorted(pdf, ["cell"]))
        top = [tree.grow(rows) for _, rows in cells]
        return pd.DataFrame(
            {
                "cell": np.array([c for c, _ in cells], np.int32),
                "box": [pickle.dumps(tree.boxes[i]) for i in top],
                "sources": [pickle.dumps(tree.sources[i]) for i in top],
            }
        )

    return run


def _block_sums(shared):
    """Sums of the places of one block, whose near cells are here with their places;
    ``shared`` holds the tree of all cells, its top and each cell's block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, top, block = shared.value
        target = int(pdf["target"].iloc[0])
        tree = cells.copy()
        pdf = _sorted(pdf, ["cell"])
        for cell, rows in _held(tree, pdf):
            tree.fill(cell, rows)
        mine = np.flatnonzero(block == target)
        start = tree.add(tree.box_over(mine), mine, None)
        sums = Sums(tree, (_CHUNK_ROWS, _CHUNK_COLUMNS))
        sums.run(start, [top])
        own = np.flatnonzero(block[pdf["cell"].to_numpy()] == target)
        k = len(tree.clusters)
        out = pdf.loc[own.repeat(k), ["lon", "lat", "own", "w"]]
        return out.assign(cluster=np.tile(tree.clusters.astype(np.int32), len(own)), s=sums.out[own].reshape(-1))

    return run


def _block_size(n: int, tasks: int, block: int | None) -> int:
    """Places per block, so that blocks fill ``tasks`` within the bounds."""
    if block is not None:
        return block
    return max(SILHOUETTE_BLOCK, min(SILHOUETTE_BLOCK_MAX, -(-n // tasks)), -(-n // SILHOUETTE_BLOCKS))


def _near_blocks(tree: Tree, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and blocks where a cell does not lie well apart from every cell of the block: the
    block's sums need its places. The gap asked for is a little larger than the tree's."""
    n, by = len(block), 1.001 * APART
    centers, radii = np.array([b.center for b in tree.boxes[:n]]), np.array([b.radius for b in tree.boxes[:n]])
    cells, targets = [], []
    for target in range(int(block[-1]) + 1):
        mine = np.flatnonzero(block == target)
        middle, widest = centers[mine].mean(axis=0), radii[mine].max()
        reach = np.sqrt(((centers[mine] - middle) ** 2).sum(axis=1).max())
        # Gaps to the block's cells are those to their middle less its reach at least.
        some = np.arange(n)
        if np.isfinite(widest):
            some = np.flatnonzero(~apart(middle, widest + reach / by, centers, radii, by))
        near = ~apart(centers[mine][:, None], radii[mine][:, None], centers[some], radii[some], by)
        cells.append(some[near.any(axis=0)])
        targets.append(np.full(len(cells[-1]), target))
    return np.concatenate(cells), np.concatenate(targets)


def _weighted_places(assigned: DataFrame) -> DataFrame:
    """``(lon, lat, own, w)``: the distinct places of rows with coordinates, the cluster they
    are assigned to and how many rows they hold (stored)."""
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    places = assigned.where(known).groupBy("lon", "lat").agg(
        F.min("cluster").alias("own"), F.count(F.lit(1)).alias("w")
    )
    return cut_lineage(places)


def distance_sums(assigned: DataFrame, block: int | None = None, places: DataFrame | None = None) -> DataFrame:
    """``(lon, lat, own, w, cluster, s)``: for each distinct place (``w`` rows, assigned to
    ``own``) the sum of distances to every row of each cluster. ``places`` are the rows'
    weighted places, if they are at hand.

    Rows are collapsed to weighted places, so repeated ids and hot places are right and
    cheap. The places fall into the squares of a quadtree that follows their density; what
    stands for each square from afar (``distance_tree``) goes to all tasks. Squares are
    dealt in order to blocks of about equal places, a group each, which also gets the
    places of the squares near it. So every place is summed in one task over all others,
    the work grows with the places and not with their square, and no task holds more than
    a block and its surroundings.
    """
    if places is None:
        places = _weighted_places(assigned)
    spark = places.sparkSession
    ends = (f(c) for c in ("lon", "lat") for f in (F.min, F.max))
    n, clusters, *ends = places.agg(F.count(F.lit(1)), F.collect_set("own"), *ends).collect()[0]
    if not n:
        return spark.createDataFrame([], _SUMS_SCHEMA)
    if not np.isfinite(ends).all():
        raise ValueError("coordinates must be numbers")
    clusters, where = np.array(sorted(clusters), np.int64), Map(ends[:2], ends[2:])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    size = _block_size(n, tasks, block)

    @F.pandas_udf("long")
    def code(lon: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series(where.codes(lon.to_numpy(), lat.to_numpy()))

    coded = places.select(code("lon", "lat").alias("code"))

    def counted(level: int, heavy):
        rows = coded
        if heavy is not None:
            cut = spark.createDataFrame(pa.table({"__heavy": heavy[1]}))
            up = F.shiftright("code", 2 * (MAP_BITS - heavy[0]))
            rows = rows.join(F.broadcast(cut), up == F.col("__heavy"), "left_semi")
        table = rows.groupBy(F.shiftright("code", 2 * (MAP_BITS - level)).alias("c")).count().toArrow()
        return table["c"].to_numpy(), table["count"].to_numpy()

    first, counts = _cells(counted, max(size // CELLS_PER_BLOCK, min(size, LEAF)))
    block_of = np.unique((np.cumsum(counts) - counts) // size, return_inverse=True)[1]

    @F.pandas_udf("int")
    def cell(lon: pd.Series, lat: pd.Series) -> pd.Series:
        at = np.searchsorted(first, where.codes(lon.to_numpy(), lat.to_numpy()), side="right") - 1
        return pd.Series(at.astype(np.int32))

    keyed = places.withColumn("cell", cell("lon", "lat"))
    nb = int(block_of[-1]) + 1
    parts = min(nb, tasks)

    def dealt(cells, targets):
        """The places of cells, copied to the groups that ``targets`` names for each."""
        table = pa.table({"cell": pa.array(cells, pa.int32()), "target": pa.array(targets, pa.int32())})
        rows = keyed.join(F.broadcast(spark.createDataFrame(table)), "cell")
        return rows.repartition(parts, "target").groupBy("target")

    tree = Tree(clusters)
    boxes = dealt(np.arange(len(first)), block_of).applyInPandas(_grown(clusters), _CELL_SCHEMA).toArrow()
    for row in boxes.sort_by("cell").to_pylist():
        tree.add(pickle.loads(row["box"]), [], pickle.loads(row["sources"]))
    top = _over(tree, first)
    shared = spark.sparkContext.broadcast((tree, top, block_of))
    return dealt(*_near_blocks(tree, block_of)).applyInPandas(_block_sums(shared), _SUMS_SCHEMA)


def _place_silhouettes(assigned: DataFrame, mode: str, block: int | None) -> DataFrame:
    """``(lon, lat, own, w, a, b, silhouette)`` per distinct place."""
    if mode not in ("standard", "own_size"):
        raise ValueError("mode must be 'standard' or 'own_size'")
    places = _weighted_places(assigned)
    sums = distance_sums(assigned, block, places)
    sizes = places.groupBy(F.col("own").alias("cluster")).agg(F.sum("w").alias("size"))
    # One row per cluster.
    j = sums.join(F.broadcast(sizes), "cluster")
    own_size = F.max(F.when(F.col("cluster") == F.col("own"), F.col("size")))
    own_sum = F.max(F.when(F.col("cluster") == F.col("own"), F.col("s")))
    if mode == "standard":
        other = F.min(F.when(F.col("cluster") != F.col("own"), F.col("s") / F.col("size")))
    else:
        other = F.min(F.when(F.col("cluster") != F.col("own"), F.col("s")))
    g = j.groupBy("lon", "lat", "own", "w").agg(own_size.alias("size"), own_sum.alias("s_own"), other.alias("b_raw"))
    if mode == "standard":
        a_val = F.when(F.col("size") > 1, F.col("s_own") / (F.col("size") - 1)).otherwise(F.lit(0.0))
        b_val = F.col("b_raw")
    else:
        a_val = F.col("s_own") / F.col("size")
        b_val = F.col("b_raw") / F.col("size")
    g = g.withColumn("a", a_val).withColumn("b", b_val)
    mx = F.greatest("a", "b")
    sil = F.when(F.col("b").isNull() | (mx == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / mx)
    if mode == "standard":
        sil = F.when(F.col("size") <= 1, F.lit(0.0)).otherwise(sil)
    return g.select("lon", "lat", "own", "w", "a", "b", sil.alias("silhouette"))


def _assigned(df: DataFrame, centers) -> DataFrame:
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return assign_nearest(df.select("id", "lon", "lat").where(known), centers).select("id", "lon", "lat", "cluster")


def silhouette_points(df: DataFrame, centers, mode: str = "standard", block: int | None = None) -> DataFrame:
    """E1 per row: ``(id, cluster, a, b, silhouette)``.

    ``standard``: a = own-cluster sum / (|own| - 1), b = min over other clusters of
    the cluster mean; singletons and 0/0 give 0. ``own_size`` (the reference's written
    formula): both sums divided by |own|, b the min of the other clusters' sums. Rows
    without a coordinate are left out.
    """
    a = _assigned(df, centers)
    scores = _place_silhouettes(a, mode, block).drop("own", "w")
    return a.join(scores, ["lon", "lat"]).select("id", "cluster", "a", "b", "silhouette")


def silhouette(df: DataFrame, centers, mode: str = "standard", block: int | None = None,
               fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """Mean silhouette over all rows of ``df`` as a one-row DataFrame; ``fraction``
    below 1 takes a seeded sample first."""
    if fraction < 1.0:
        df = bernoulli_sample(df, fraction, seed)
    scores = _place_silhouettes(_assigned(df, centers), mode, block)
    mean = F.sum(F.col("w") * F.col("silhouette")) / F.sum("w")
    return scores.agg(mean.alias("silhouette"))


def radius_stats(df: DataFrame, centers, metric: str = "haversine") -> DataFrame:
    """Mean and sample deviation of each cluster's largest distance to its centre.

    ``metric="planar"`` assigns by squared degrees (a k-means model's ``predict``)
    and still measures the radius in metres; empty clusters are skipped.
    """
    a = with_nearest(df, centers, metric=metric)
    if metric == "planar":
        cl = as_center_list(centers)
        places = ", ".join(f"{c}, named_struct('lon', {lon!r}D, 'lat', {lat!r}D)" for c, lon, lat in cl)
        at = F.expr(f"map({places})")[F.col("cluster")]
        a = a.withColumn("dist", haversine("lon", "lat", at["lon"], at["lat"]))
    mx = a.groupBy("cluster").agg(F.max("dist").alias("radius"))
    return mx.agg(
        F.avg("radius").alias("mean_radius"),
        F.stddev_samp("radius").alias("std_radius"),
        F.count(F.lit(1)).alias("clusters"),
    )
