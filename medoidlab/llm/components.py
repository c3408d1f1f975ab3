"""Connected components of a graph given as edge rows, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medoidlab.llm.common import stored


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b, both long): root is the smallest
    node reachable from it.

    Each round links every node's larger neighbours to its smallest one, then every
    node's smaller neighbours likewise; the number of edges never grows, and a component
    becomes a star in logarithmically many rounds. Rounds are written to the shared
    folder. Minima are pre-aggregated, so a hub node is not gathered into one task.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, mark = stored(both, name), None
    while True:
        sides = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(
            e.select(F.col("v").alias("n"), F.col("u").alias("m"))
        )
        low = sides.groupBy("n").agg(F.min("m").alias("m1")).select("n", F.least("n", "m1").alias("low"))
        large = sides.where("m > n").join(low, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        e = stored(
            small.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .where("u <> v")
            .unionByName(low.select("u", F.col("low").alias("v")))
            .distinct(),
            name,
        )
        state = e.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
