"""Exact top-k inner-product search by dual trees, spread over blocks.

Vectors become integers (floor(1024 x)). A bounded sample of them gives pivots; every
vector belongs to its nearest pivot's cell, large cells are cut into blocks. Queries form
groups of neighbouring cells. First each group searches the block it lies in, which gives
every query a floor under its k-th score. Then a group visits only the blocks whose ball
can beat the floor of one of its queries; inside a visit cover trees over both sides prune
pairs of nodes. The results of the visits merge to the k best per query.

Every vector is searched; only pivots (``PIVOTS``) come from a sample. Scores are sums of
products of integers below 2**53, so the arithmetic is exact.

Cases: vectors that are null or hold null or non-finite components take no part, nor do
rows without id; vectors of different lengths are never compared; rows that share an id
are rows of their own, each with its own best and a candidate of the others; equal scores
go by smaller id, then in any fixed order; equal
vectors (radius 0) are one leaf; fewer candidates than k give fewer rows; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medoidlab.llm.common import stored, table
from medoidlab.llm.cover_tree import Search, build

SCALE, TOP, EVERY = 1024, 10, 100
PIVOTS = 16
BLOCK_ROWS, GROUP_QUERIES = 4096, 512

VISIT = "vec_id long, uid long, score long, query_id long, query_uid long"


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(vector) > 0)


def _cells(pivots: dict[int, np.ndarray]):
    """Nearest pivot of each vector among those of its length."""

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int32)
        lengths = vectors.map(len).to_numpy()
        for n in np.unique(lengths) if len(vectors) else []:
            at = np.flatnonzero(lengths == n)
            p = pivots[int(n)]
            x = np.stack(vectors.iloc[at].to_list()).astype(np.float64)
            out[at] = ((p * p).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
        return pd.Series(out)

    return cell


def _pick_pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots per vector length: of 64 n rows by hash, farthest first."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "uid").limit(64 * n).select("v").collect()
    lengths = [r.size for r in vectors.select(F.size("v").alias("size")).distinct().collect()]
    found = {}
    for size in lengths:
        some = [r.v for r in rows if len(r.v) == size]
        if not some:
            some = [vectors.where(F.size("v") == size).first().v]
        x = np.array(some, np.float64)
        picked, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(picked) < n and gap.max() > 0:
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        found[size] = x[picked]
    return found


def _visit(top: int):
    """One (group, block): the queries' best rows of the block."""

    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({c.split()[0]: [] for c in VISIT.split(", ")}).astype("int64")
        q, d = np.stack(queries["v"].to_list()), np.stack(data["v"].to_list())
        ids, uids = queries["vec_id"].to_numpy(), queries["uid"].to_numpy()
        s = Search(q, uids, d, data["vec_id"].to_numpy(), data["uid"].to_numpy(), top, queries["floor"].to_numpy())
        s.run(build(s.qf), build(s.df))
        found = [
            (v, u, int(-score), int(i), int(own)) for i, own, best in zip(ids, uids, s.best) for score, v, u in best
        ]
        return pd.DataFrame(found, columns=[c.split()[0] for c in VISIT.split(", ")]).astype("int64")

    return run


def visits(queries: DataFrame, data: DataFrame, top: int) -> DataFrame:
    """``queries`` (grp, block, vec_id, uid, v, floor) against ``data`` (grp, block, vec_id, uid, v)."""
    # Both sides stem from the same tables; new names keep their columns apart.
    data = data.toDF("data_grp", "data_block", "vec_id", "uid", "v")
    pairs = queries.groupBy("grp", "block").cogroup(data.groupBy("data_grp", "data_block"))
    return pairs.applyInPandas(_visit(top), VISIT)


def best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def top_products(vectors: DataFrame, is_query: Column, top: int = TOP, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` (vec_id, embedding)
    that ``is_query`` selects, against all rows but their own."""
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
        .select("vec_id", integers(F.col("embedding")).alias("v"), F.monotonically_increasing_id().alias("uid"))
    )
    rows = stored(rows, "vectors")
    picked = _pick_pivots(rows, pivots)
    rows = stored(rows.withColumn("dim", F.size("v")).withColumn("cell", _cells(picked)(F.col("v"))), "cells")
    sizes = rows.groupBy("dim", "cell").agg(
        F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("queries")
    )
    # Bounded by the pivots per length. Queries of a length share groups of at least
    # GROUP_QUERIES, neighbouring cells together.
    table_of = {(r.dim, r.cell): r for r in sizes.collect()}
    plan, blocks = [], 0
    for dim in sorted({d for d, _ in table_of}):
        group, filled = 0, 0
        for cell in sorted(c for d, c in table_of if d == dim):
            r = table_of[dim, cell]
            splits = -(-r.n // BLOCK_ROWS)
            shares = max(1, r.queries // GROUP_QUERIES)
            plan.append((dim, cell, blocks, splits, group, shares))
            blocks += splits
            filled += r.queries
            if filled >= GROUP_QUERIES:
                group, filled = group + shares, 0
    spark = vectors.sparkSession
    plan = spark.createDataFrame(plan, "dim int, cell int, base long, splits long, grp0 long, shares long")
    placed = rows.join(F.broadcast(plan), ["dim", "cell"]).select(
        "vec_id",
        "uid",
        "v",
        "dim",
        (F.col("base") + F.pmod(F.xxhash64("uid"), F.col("splits"))).alias("block"),
        (F.col("grp0") + F.pmod(F.xxhash64("uid", F.lit(1)), F.col("shares"))).alias("grp"),
    )
    placed = stored(placed, "placed")
    queries = placed.where(is_query)
    lowest = F.lit(float("-inf"))
    near = visits(
        queries.select(F.col("block").alias("grp"), "block", "vec_id", "uid", "v", lowest.alias("floor")),
        placed.select(F.col("block").alias("grp"), "block", "vec_id", "uid", "v"),
        top,
    )
    near = stored(near, "near")
    floors = near.groupBy("query_uid").agg(
        F.count("*").alias("n"), F.min("score").alias("least")
    ).select(F.col("query_uid").alias("uid"), F.when(F.col("n") >= top, F.col("least")).cast("double").alias("known"))
    queries = stored(
        queries.join(floors, "uid", "left").select(
            "grp", "dim", F.col("block").alias("own"), "vec_id", "uid", "v", F.coalesce("known", lowest).alias("floor")
        ),
        "queries",
    )
    balls = _balls(placed)
    wanted = _visits_wanted(queries, balls)
    asked = queries.join(wanted, ["grp", "dim"]).where("own <> block")
    given = wanted.join(placed.select("dim", "block", "vec_id", "uid", "v"), ["dim", "block"])
    far = visits(
        asked.select("grp", "block", "vec_id", "uid", "v", "floor"), given.select("grp", "block", "vec_id", "uid", "v"), top
    )
    found = best(near.unionByName(far), top)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _mean(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Centre of each key's vectors, component by component (pre-aggregated)."""
    parts = rows.select(*keys, F.posexplode("v").alias("at", "x")).groupBy(*keys, "at").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("centre")
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def _with_radius(rows: DataFrame, keys: list[str], centres: DataFrame, *more: Column) -> DataFrame:
    gap = F.zip_with(F.col("v").cast("array<double>"), F.col("centre"), lambda x, y: x - y)
    return (
        rows.join(F.broadcast(centres), keys)
        .withColumn("gap", _dot(gap, gap))
        .groupBy(*keys, "centre")
        .agg(F.sqrt(F.max("gap")).alias("radius"), *more)
    )


def _balls(placed: DataFrame) -> DataFrame:
    return stored(_with_radius(placed, ["dim", "block"], _mean(placed, ["dim", "block"])), "balls")


def _visits_wanted(queries: DataFrame, balls: DataFrame) -> DataFrame:
    """(grp, dim, block) whose ball may hold a score above the floor of a query. Groups
    and blocks are summaries, thousands of rows for one; they meet by vector length."""
    keys = ["grp", "dim"]
    groups = _with_radius(queries, keys, _mean(queries, keys), F.min("floor").alias("floor")).select(
        *keys, F.col("centre").alias("q"), F.col("radius").alias("r"), "floor"
    )
    reach = (
        _dot(F.col("q"), F.col("centre"))
        + F.sqrt(_dot(F.col("q"), F.col("q"))) * F.col("radius")
        + F.sqrt(_dot(F.col("centre"), F.col("centre"))) * F.col("r")
        + F.col("r") * F.col("radius")
        + 1e-3
    )
    return stored(groups.join(balls, "dim").where(reach >= F.col("floor")).select(*keys, "block"), "visits")


def op5_cover_tree_topk(spark, sf_dir):
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS double)) AS bigint)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.uid AS query_uid, d.vec_id, d.uid,
         cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS bigint) AS score
  FROM v q JOIN v d ON q.uid <> d.uid AND len(q.v) = len(d.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_uid ORDER BY score DESC, vec_id, uid) AS rank FROM s)
WHERE rank <= 10
"""
